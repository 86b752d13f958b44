"""Candidates of the pipeline's near-dedup meet by the segment counts of sampled SimHashes."""

import numpy as np

from tagloom.llm import simhash


def counts(fp):
    return [bin(int(fp) >> k & 3).count("1") for k in range(0, 64, 2)]


def test_cells_are_segment_counts():
    """Texts share a cell just when all 32 counts are equal, whether or not the fingerprints are."""
    rng = np.random.default_rng(5)
    same = other = 0
    for n in (1, 6, 40, 300):
        for _ in range(40):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate((a[n // 6 :], rng.integers(0, 1 << 63, n // 6, dtype=np.uint64)))
            x, y = simhash.samples(a), simhash.samples(b)
            assert x.shape == (simhash.BANDS,)
            want = [counts(p) == counts(q) for p, q in zip(x, y, strict=True)]
            assert (simhash.bands(a) == simhash.bands(b)).tolist() == want
            same, other = same + sum(want), other + len(want) - sum(want)
    assert same > 100 and other > 100


def test_manhattan_distance_of_counts_comes_first(monkeypatch):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 63, (200, 4), dtype=np.uint64)
    flips = np.zeros((200, 256), np.uint8)
    for i, row in enumerate(flips):
        row[rng.choice(256, 20 + i // 2, replace=False)] = 1
    b = a ^ np.packbits(flips, axis=1).view(np.uint64)
    assert simhash.near_wide(a, b).tolist() == (flips.sum(axis=1) <= simhash.FLIPS).tolist()
    assert simhash.near_wide(b, a[:1]).tolist() == [sum((int(p) ^ int(q)).bit_count() for p, q in zip(r, a[0], strict=True)) <= simhash.FLIPS for r in b]
    used = []
    real = simhash.embed
    monkeypatch.setattr(simhash, "embed", lambda x: used.append(len(x)) or real(x))
    list(simhash.forest(np.zeros(200, np.int64), np.arange(200), a))
    assert used
