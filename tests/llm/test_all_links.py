"""The pipeline's near-dedup finds every link, also those whose texts share no cell of sampled SimHashes."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tagloom.llm import simhash

from .test_near_and_mix import groups, variants

#: Texts of similarity 0.8 that share no cell of samples.
LOST = (3, 454, 460, 652, 1328, 1564, 1665, 2092)


def pair(seed):
    rng = random.Random(seed)
    a = [f"w{rng.randrange(10**6)}" for _ in range(49)]
    b = list(a)
    b[rng.randrange(10, 40)] = "x"
    return " ".join(a), " ".join(b)


def found(spark, texts):
    got = {}
    for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.root, set()).add(r.doc_id)
    return {frozenset(v) for v in got.values()}


def test_links_without_a_shared_sample(spark):
    texts = [t for seed in LOST for t in pair(seed)]
    for a, b in zip(texts[::2], texts[1::2], strict=True):
        x, y = (simhash._shingles(t, 5) for t in (a, b))
        assert not (simhash.bands(x) == simhash.bands(y)).any() and simhash.similar([x], [y], 0.8)[0, 0]
    assert found(spark, texts) == groups(list(enumerate(texts))) == {frozenset((i, i + 1)) for i in range(0, 16, 2)}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(range(0, 16, 2))


def test_similar_sets_share_a_segment():
    """Of any size, from one to some thousands, and any two sizes that can be similar; parities differ in no more than the sets."""
    rng = np.random.default_rng(3)
    seen = 0
    for _ in range(4000):
        a = np.unique(rng.integers(0, 1 << 64, int(2 ** rng.uniform(0, 9)), dtype=np.uint64))
        less, more = rng.integers(0, len(a) // 5 + 1), rng.integers(0, len(a) // 4 + 2)
        b = np.unique(np.concatenate((a[rng.permutation(len(a))[less:]], rng.integers(0, 1 << 64, more, dtype=np.uint64))))
        same, every = np.intersect1d(a, b).size, np.union1d(a, b).size
        x, y = (np.frombuffer(simhash.parity(s), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= every - same
        if 0.8 * every <= same < every:
            seen += 1
            assert every - same <= simhash.differing(len(a) + len(b), 0.8)
            (p, short), (q, too) = simhash.segments(a, 0.8), simhash.segments(b, 0.8)
            assert short or too or np.intersect1d(p, q).size
    assert seen > 1000


@pytest.mark.parametrize(("cell", "short"), [(4096, False), (3, False), (4096, True)])
def test_segments_alone_find_all(spark, monkeypatch, cell, short):
    """Nothing is left to the samples; cells in parts, and texts that have too few segments."""
    monkeypatch.setattr(simhash, "bands", lambda s: np.array([hash(s.tobytes()) & (2**63 - 1)], np.uint64))
    monkeypatch.setattr(simhash, "CELL", cell)
    if short:
        real = simhash.segments
        monkeypatch.setattr(simhash, "segments", lambda s, j: (real(s, j)[0][:0], True))
    rng = random.Random(9)
    base = lambda n: [f"b{rng.randrange(10**6)}" for _ in range(n)]
    texts = variants(rng, base(200), 30, 2) + variants(rng, base(300), 25, 5) + [" ".join(base(n)) for n in range(12)] + ["", " "] + [pair(3)[0]] * 3 + [pair(3)[1]]
    chain = base(120)
    for k in range(20):  # each step changes one more place
        chain[5 + 5 * k] = f"c{k}"
        texts.append(" ".join(chain))
    for n in (9, 12, 30, 90):  # one word more and one less
        w = base(n)
        texts += [" ".join(w), " ".join(w[1:]), " ".join([*w, "z"])]
    assert found(spark, texts) == groups(list(enumerate(texts)))
