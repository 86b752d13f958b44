"""Near-dedup of large and hot groups, and the mix of rows without ids, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tagloom.llm import mixing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def groups(rows):
    """Sets of ids that links of similarity 0.8 join."""
    sets = [grams(t) for _, t in rows]
    at = list(range(len(rows)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                at[top(i)] = top(j)
    out = {}
    for i, (k, _) in enumerate(rows):
        out.setdefault(top(i), set()).add(k)
    return {frozenset(v) for v in out.values()}


def variants(rng, base, n, places):
    """``n`` texts that have other words at some of the places."""
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(5, len(w), 20), places):
            w[at] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("block", "cell", "hot"), [(400, 4096, 1000), (12, 4096, 1000), (12, 6, 10**9), (5, 10**6, 1000)])
def test_large_and_hot_groups(spark, monkeypatch, block, cell, hot):
    """Tight templates, a loose one whose variants mostly don't link, a chain whose ends are far apart, and single texts."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(8)
    base = lambda n: [f"b{rng.randrange(10**6)}" for _ in range(n)]
    texts = variants(rng, base(200), 60, 2) + variants(rng, base(300), 40, 5) + [" ".join(base(40)) for _ in range(20)]
    chain = base(200)
    for k in range(25):  # each step changes one more place
        chain[5 + 7 * k] = f"c{k}"
        texts.append(" ".join(chain))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    out = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {}
    for r in out:
        got.setdefault(r.root, set()).add(r.doc_id)
    want = groups(rows)
    assert {frozenset(v) for v in got.values()} == want and max(map(len, want)) >= 60
    assert all(r.component_id == min(got[r.root]) for r in out)


def test_a_tight_template_is_not_copied(spark, monkeypatch):
    """Pivots join the variants, so no block of them meets another."""
    monkeypatch.setattr(simhash, "BLOCK", 10)
    rng = random.Random(2)
    texts = variants(rng, [f"b{i}" for i in range(200)], 120, 2)
    seen = []
    real = simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda df, s: seen.append(df) or real(df, s))
    simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert [df.count() for df in seen[1:]] == [0]


def test_recall_of_cells_by_length():
    """Pairs of similarity 0.8 to 0.83 share a cell, and what shares none is unlike, whatever the length."""
    rng = np.random.default_rng(3)
    for n in (6, 20, 100, 600):
        hit = far = 0
        for _ in range(150):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            extra = max(1, int(n / 9))  # (n - extra) shared of n + extra
            a, b = both, np.concatenate((both[extra:], rng.integers(0, 1 << 63, extra, dtype=np.uint64)))
            assert (n - extra) / (n + extra) >= 0.7
            same = np.intersect1d(a, b).size / np.union1d(a, b).size
            hit += bool((simhash.bands(a) == simhash.bands(b)).any()) or same < 0.8
            far += bool((simhash.bands(a) == simhash.bands(rng.integers(0, 1 << 63, n, dtype=np.uint64))).any())
        assert hit >= 147 and far == 0


def words(df):
    return sum(len((r.text or "").split()) for r in df.collect())


def test_mix_gives_what_the_queue_takes(spark):
    """Rows without ids, with one id, and rows that repeat in all or in all but another column."""
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    for rows in (
        [(None, f"a{i} b c", "en", "s", 0) for i in range(400)],
        [(7, f"a{i} b c", "en", "s", 0) for i in range(400)],
        [(7, "a b c", "en", "s", i) for i in range(401)],
        [(None, "a b c", "en", None, 1)] * 90 + [(i, f"x{i} " * (i % 9), "en", ("s", None)[i % 2], 2) for i in range(200)],
    ):
        docs = make(rows)
        queued = sum(r.taken for r in mixing.queue(docs).collect())
        given = corpus_pipeline.mix(spark, docs, "")
        assert words(given) == queued
        total = sum(len(r[1].split()) for r in rows)
        assert abs(queued - 1.5 * total) <= 9
        n, have = Counter(map(tuple, given.collect())), Counter(rows)
        assert all(n[r] <= 2 * have[r] for r in n)
