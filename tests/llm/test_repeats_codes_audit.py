"""Substring dedup, vector codes and the source audit against brute force, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import audit, codes, repeats

from .test_llm import CLASH, ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def clash(df):
    return df.select("*", *[F.lit(f"clash {c}").alias(c) for c in [*CLASH, "t1", "t2", "g", "v", "of", "_h0", "_t0", "at", "slice"] if c not in df.columns])


# substring dedup


def plain_repeats(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def passages(seed, n, window):
    """Texts that share passages of about a window, at any place, within themselves too."""
    rng = random.Random(seed)
    shared = [[f"p{k}.{i}" for i in range(rng.randrange(window - 2, 3 * window))] for k in range(6)]
    texts = []
    for i in range(n):
        w = [f"u{i}.{j}" for j in range(rng.randrange(0, 2 * window))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(0, 4)
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[a : len(p) - rng.randrange(0, 4)]
        if i % 9 == 4:
            w += w
        texts.append(rng.choice([" ", "\n", " \t "]).join(w))
    return texts + [texts[3], texts[3], "loop " * (3 * window), "é\x85ß " * window]


@pytest.mark.parametrize(("window", "chunk"), [(35, 8 << 20), (35, 3000), (6, 500), (5, 2000), (1, 900)])
def test_repeats_against_brute_force(docs, monkeypatch, window, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    texts = passages(window, 60, window)
    rows = [(i, t) for i, t in enumerate(texts)] + ODD
    out = repeats.repeats(clash(docs(rows)), window).collect()
    want = Counter((i, *x) for (i, _), x in zip(rows, plain_repeats([t for _, t in rows], window), strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == want
    by_id = {i: WORD.findall(t or "") for i, t in rows}
    for r in out:
        assert r.n_removed == sum(s.end - s.start for s in r.spans) and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
        if r.doc_id is not None:
            assert r.kept == " ".join(w for j, w in enumerate(by_id[r.doc_id]) if not any(s.start <= j < s.end for s in r.spans))


def test_repeats_odd_tables(docs):
    assert repeats.repeats(docs([])).count() == 0
    assert [(r.n_words, r.n_removed, r.kept) for r in repeats.repeats(docs([(1, None)])).collect()] == [(0, 0, "")]
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long), (2, "x " + " ".join(long.split()[70_000:70_040])), (None, "y"), (None, "y")]
    out = {(r.doc_id, r.n_words): (r.n_removed, r.kept) for r in repeats.repeats(docs(rows), keep="sha256").collect()}
    assert out[1, 200_000][0] == 40 and out[2, 41] == (40, hashlib.sha256(b"x").hexdigest()) and out[None, 1][0] == 0


def test_repeats_read_one_shuffle_of_the_texts(docs, capsys):
    """All three steps read the same exchange, so the texts move once."""
    rows = [(i, t) for i, t in enumerate(passages(1, 20, 35))]
    df = docs(rows)
    seen = []
    real = repeats.cut
    repeats.cut = lambda x: seen.append(x) or real(x)
    try:
        repeats.repeats(df).count()
    finally:
        repeats.cut = real
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.find("+- == Initial Plan ==")] if "Initial Plan" in plan else plan
    assert plan.count("REPARTITION_BY_COL") == 1 and plan.count("ReusedExchange") + plan.count("ReusedQueryStage") >= 2 or plan.count("ReusedExchange") >= 2


# vector codes


def test_exact_products_have_no_rounding():
    rng = np.random.default_rng(5)
    for most, d in ((1 << 8, 4), (1 << 27, 7), (1 << 29, 16), (1, 1), (1 << 30, 1)):
        a, b = (rng.integers(-most, most + 1, (20, d)) for _ in range(2))
        a[0], b[0] = most, -most
        assert (codes.exact_products(a, b) == np.array(a.astype(object) @ b.T.astype(object), dtype=np.int64)).all()
    assert codes.exact_products(np.zeros((3, 0), np.int64), np.zeros((2, 0), np.int64)).tolist() == [[0, 0]] * 3


def plain_codes(rows, parts, entries, rounds, dims):
    """As ``compress_vectors``, in Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and len(v) == dims]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    w = dims // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, v: min((dist(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        of = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in kept:
            for p in range(parts):
                of[p][near(p, v)[1]].append(cut(v, p))
        books = [[[sum(x) // len(of[p][e]) for x in zip(*of[p][e], strict=True)] if of[p][e] else c for e, c in enumerate(books[p])] for p in range(parts)]
    out, total = [], Counter()
    for i, v, lab in kept:
        best = [near(p, v) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
        total[lab] += out[-1][3]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((i, lab, c, e, total[lab], sha) for i, lab, c, e in out)


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n, dims=16, seed=2):
    rng = random.Random(seed)
    f = lambda x: float(np.float32(x))
    rows = [(i * 3 % n, [f(rng.choice([rng.gauss(0, 0.3), rng.randrange(-2, 3) / 4])) for _ in range(dims)], rng.choice([None, 1, 1, 1, 2, 3])) for i in range(n)]
    rows += [rows[5], rows[5], (None, rows[7][1], None), (n + 1, [1000.5] * dims, 9)]
    return rows


@pytest.mark.parametrize(("n", "parts", "entries"), [(150, 16, 64), (150, 4, 10), (12, 8, 64)])
def test_codes_against_plain_integers(spark, n, parts, entries):
    rows = vectors(n)
    odd = [(900, None, 1), (901, [None] + [0.5] * 15, 1), (902, [float("nan")] + [0.5] * 15, 1), (903, [float("inf")] * 16, None)]
    df = clash(spark.createDataFrame(rows + odd, VECTORS))
    out = codes.compress_vectors(df, parts, entries)
    assert Counter(tuple(r) for r in out.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()) == plain_codes(rows, parts, entries, 2, 16)


def test_codes_of_odd_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert codes.compress_vectors(make([])).count() == 0 and codes.compress_vectors(make([(1, None, 1)])).count() == 0
    rows = [(1, [0.0] * 32, 1), (2, [3e38] * 32, 1), (3, [-3e38] * 32, 2), (4, [0.5] * 3, 2), (5, [], 3)]
    out = {r.vec_id: r for r in codes.compress_vectors(make(rows)).collect()}
    assert len(out) == 5 and out[4].code is None and out[4].error is None and out[5].code is None and out[5].label_error is None
    assert all(out[i].error == 0 for i in (1, 2, 3)) and len({out[i].code for i in (1, 2, 3)}) == 3
    assert [(r.code, r.error) for r in codes.compress_vectors(make([(1, [], 1)])).collect()] == [("00" * 16, 0)]
    none = codes.compress_vectors(make(rows[:2]).select("vec_id", "embedding")).collect()
    assert len(none) == 2 and all(r.label is None for r in none)


def test_a_label_of_most_rows_is_no_hot_key(spark):
    """One label holds nine tenths of the rows, another is null."""
    rows = [(i, [float(i % 7), float(i % 5)], None if i % 20 == 0 else 1 if i % 10 else i) for i in range(3000)]
    out = codes.compress_vectors(spark.createDataFrame(rows, VECTORS), 2, 4).collect()
    sums = Counter()
    for r in out:
        sums[r.label] += r.error
    assert len(out) == 3000 and all(r.label_error == sums[r.label] for r in out)


# source audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_audit(rows, min_docs, most):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tf, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        t = TERM.findall((text or "").translate(low))
        tf[lang, source].update(t)
        df[lang].update(set(t))
    out = set()
    for lang in {x for x, _ in groups}:
        kept = sorted((t for t, n in df[lang].items() if n >= min_docs), key=lambda t: t.encode())
        v, mine = len(kept), sorted(s for x, s in groups if x == lang)
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * v)
        p = {s: [share(tf[lang, s][t], sum(tf[lang, s][x] for x in kept)) for t in kept] for s in mine}
        n = {t: sum(tf[lang, s][t] for s in mine) for t in kept}
        q = [share(n[t], sum(n.values())) for t in kept]
        for s in mine:
            pair = sorted(((-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in mine if o != s))
            term = sorted((b - a, t.encode()) for a, b, t in zip(p[s], q, kept, strict=True) if tf[lang, s][t] and a > b)[:most]
            out |= {(lang, s, k, i.decode(), -x, r) for k, part in (("pair", pair), ("term", term)) for r, (x, i) in enumerate(part, 1)}
    return out


@pytest.mark.parametrize("cut_at", [200_000, 40])
def test_audit_against_plain_python(docs, monkeypatch, cut_at):
    monkeypatch.setattr(audit, "SLICE", cut_at)
    rng = random.Random(9)
    rows = []
    for i in range(300):
        lang = rng.choice(["en", "en", "en", "de", "fr", None])
        source = rng.choice(["a", "a", "a", "b", "c", "é", "B", None, "d"]) if lang != "fr" else "only"
        words = [rng.choice(["The", "the", "häuser", "x1y", "a-b", "日本", f"w{rng.randrange(40)}", f"{source}q"]) for _ in range(rng.randrange(30))]
        rows.append((i, " ".join(words), lang, source))
    rows += [(900, None, "en", "empty"), (901, "", "xx", "p"), (902, "1 2 3", "xx", "q"), (903, "rare", "yy", None), (None, None, None, None), (900, None, "en", "empty"), (904, "zebra " * 3000, "en", "d")]
    out = audit.divergence(clash(docs(rows)), 4, 5).collect()
    got = Counter((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in out)
    assert set(got) == plain_audit([r[1:] for r in rows], 4, 5) and max(got.values()) == 1
    assert audit.divergence(docs([])).count() == 0


def test_shares_are_exact():
    rng = random.Random(4)
    for _ in range(200):
        v, total = rng.randrange(1, 10**6), rng.randrange(0, 10**12)
        c = rng.choice([0, total, rng.randrange(0, total + 1)])
        assert int(audit.share(c, total, v)) == 1 + 10**9 * (c + 5) // (total + 5 * v)
