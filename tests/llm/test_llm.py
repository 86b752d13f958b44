"""Operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import fingerprints, language, lines, mixing, packing, search, simhash, tokens, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(801, None), (802, ""), (803, " \t\n "), (None, "null id"), (None, None), (805, "same"), (805, "same"), (806, "é\x85ß x\ny")]


def words(rng, n, of=60):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def corpus(seed=7, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = "\n".join(words(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 6)))
        if i % 10 == 3:
            t = rows[-1][1]
        if i % 10 == 6:
            t = rows[-1][1] + " extra"
        rows.append((i, t, "en", f"src{rng.randrange(4)}", len(t)))
    rows[17] = (17, words(rng, 5000), "en", "src0", 0)
    return rows


def test_packing_places_every_token_once_and_shrinks_bins(docs):
    caps = (16, 64, 256)
    rows = corpus() + [(*r, "x", None, None) for r in ODD]
    out = packing.pack(docs(rows), caps).collect()
    used, spans, sizes = defaultdict(list), defaultdict(list), {}
    for r in out:
        if r.n_tokens == 0:
            assert r.bin_id is None
            continue
        assert r.n_tokens <= 256
        used[r.bin_id].append((r.bin_offset, r.bin_offset + r.n_tokens))
        sizes[r.bin_id] = (r.bin_tokens, r.bin_capacity)
        spans[r.doc_id].append((r.start, r.start + r.n_tokens))
    for b, s in used.items():
        s.sort()
        assert s[0][0] == 0 and all(x[1] == y[0] for x, y in zip(s, s[1:])) and s[-1][1] == sizes[b][0]
        assert sizes[b][1] == min(c for c in caps if c >= sizes[b][0])
    for i, t, *_ in corpus():
        assert sum(b - a for a, b in spans[i]) == len(WORD.findall(t))
    assert len({(r.doc_id, r.piece) for r in out if r.doc_id == 17}) == math.ceil(5000 / 256)
    filled = sum(x for x, _ in sizes.values()) / sum(c for _, c in sizes.values())
    assert filled > 0.95
    assert packing.pack(docs([])).count() == 0


def test_plan_is_best_fit():
    """Piece by piece: each goes to the fullest open bin that takes it; a bin is opened only if none does, of the size that costs least for what it will carry."""
    rng = random.Random(1)
    caps = (16, 32, 64)
    for hist in (Counter(rng.randrange(1, 65) for _ in range(500)), Counter(rng.choice((5, 7, 31, 33, 64)) for _ in range(300)), Counter({3: 1}), Counter({40: 7, 24: 3, 1: 100})):
        seg, runs = packing.plan_bins(hist, caps)
        seg = seg.tolist()
        used, size, left = {}, {}, dict(hist)

        def carried(cap, n):
            todo, full = [x for x in sorted(left, reverse=True) if x <= n for _ in range(left[x])], 0
            for x in todo:  # the largest that still fits, again and again
                if full + x <= cap:
                    full += x
            return full

        for n, rank, k, first, offset in sorted(seg, key=lambda s: (-s[0], s[1])):
            nxt = min([s[1] for s in seg if s[0] == n and s[1] > rank], default=hist[n])
            for p in range(nxt - rank):
                at = first + p // k
                fits = [size[b] - used[b] for b in used if size[b] - used[b] >= n]
                if at not in used:
                    assert not fits and offset + p % k * n == 0
                    if p == 0:
                        best = min((c for c in caps if c >= n), key=lambda c: (packing.bin_cost(c) / carried(c, n), c))
                    used[at], size[at] = 0, best
                else:
                    assert size[at] - used[at] == min(fits)
                assert used[at] == offset + p % k * n
                used[at] += n
                left[n] -= 1
        assert sum(used.values()) == sum(n * c for n, c in hist.items()) and not any(left.values())
        for (a, tokens, cap), b in zip(runs.tolist(), [*runs[1:, 0].tolist(), len(used)]):
            assert all(used[x] == tokens and cap == min(c for c in caps if c >= tokens) for x in range(a, b))


def test_urls_against_plain_python(spark):
    rng = random.Random(3)
    hosts = ["example.org", "a.example.org", "b.org", "fr.example.com", "EXAMPLE.com", "x.net", "org", "notorg", "com"]
    rows = [(i, f"http{'s' * (i % 2)}://{rng.choice(hosts)}/{rng.choice(['es', 'en', 'fr', 'de'])}/{rng.randrange(300)}{rng.choice(['', '?q=1', '#x'])}") for i in range(400)]
    rows += [(900, None), (901, ""), (902, "example.org/es/1"), (903, "http://org?x"), (904, "a://b://org/x"), (906, "http://q.net/out?u=https://example.org/es/9"), (905, "http://example.org"), (None, "http://org/"), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("score", F.lit(1)).withColumn("host", F.lit("x"))
    out = urls.judge_urls(df).collect()
    assert len(out) == len(rows)

    def split(u):
        if not u or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host):])[0]

    def rule(h, p):
        fit = [r for r in urls.RULES if (h == r[0] or h.endswith("." + r[0])) and p.startswith(r[1])]
        return max(fit, key=lambda r: len(r[0] + r[1]), default=None)

    got = {(r.page_id, r.host, r.path): r for r in out}
    # the models, by hand
    def grams(u):
        s = re.sub("[1-9]", "0", (u or "").split("://", 1)[-1].lower())
        c = [0] * 3 + [urls.SYMBOLS.find(x) + 1 for x in s] + [0]
        return [tuple(c[i : i + 4]) for i in range(len(s) + 1)]

    counts = {"allow": [Counter() for _ in range(4)], "block": [Counter() for _ in range(4)]}
    for _, u in rows:
        r = rule(*split(u))
        if r and hashlib.md5((u or "").encode()).hexdigest()[0] < "c":
            for g in grams(u):
                for k in range(4):
                    counts[r[2]][k][g[3 - k :]] += 1
    def prob(c, g):
        p = 1 / 32
        for k in range(4):
            ctx = g[3 - k : 3]
            seen = {x: n for x, n in c[k].items() if x[:-1] == ctx}
            if seen:
                p = (seen.get(g[3 - k :], 0) + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p
    for i, u in rows[::9] + rows[-8:]:
        h, p = split(u)
        r = got[i, h, p]
        fit = rule(h, p)
        assert (r.rule, fit and r.verdict) == ((fit[0] + fit[1], fit[2]) if fit else (None, None))
        gs = grams(u)
        assert r.score == pytest.approx(sum(math.log(prob(counts["allow"], g)) - math.log(prob(counts["block"], g)) for g in gs) / len(gs), abs=1e-6)
        assert r.verdict in ("allow", "block")
    free = [r for r in out if r.rule is None]
    assert max((r.score for r in free if r.verdict == "block"), default=-9) < min((r.score for r in free if r.verdict == "allow"), default=9)
    assert urls.judge_urls(df.limit(0)).count() == 0
    one = urls.judge_urls(spark.createDataFrame([(1, "http://x.net/a"), (2, "http://b.org/")], "page_id long, url string"))
    assert {r.verdict for r in one.collect()} == {"allow"}


def test_fingerprints_against_plain_python(docs):
    rows = sorted(corpus(n=60)) + [(100, "a"), (101, None), (102, ""), (103, "éßx\nyz"), (104, "ab")]
    by_id = sorted(((i, t or "") for i, t, *_ in rows), reverse=True)
    out = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs(rows).repartition(5)).collect()}
    assert len(out) == len(rows)
    for (i, t), (_, nxt) in zip(by_id, by_id[1:] + by_id[:1]):
        n, h = len(t), len(t) // 2
        e = t[: n - h] + nxt[:h]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(e.encode()).hexdigest())
        assert r.fingerprint == str(fingerprints.Fingerprint.of(t)) and r.edited_fingerprint == str(fingerprints.Fingerprint.of(e))
        assert 0 <= r.near_next <= 1 and (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
        assert r.near_edited == pytest.approx(plain_likeness(t, e)) and r.near_next == pytest.approx(plain_likeness(t, nxt))


def test_url_threshold_separates_held_out_rules(spark):
    """On the tables' pages: of the held-out URLs that rules decide, how many the models alone would judge alike."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    out = urls.judge_urls(pages).join(pages, "page_id").collect()
    free = [r for r in out if r.rule is None]
    least = min(r.score for r in free if r.verdict == "allow")
    held = {r.url: r for r in out if r.rule and hashlib.md5(r.url.encode()).hexdigest()[0] >= "c"}.values()
    kept, gone = ([r.score >= least for r in held if r.verdict == v] for v in ("allow", "block"))
    assert len(kept) > 150 and np.mean(kept) > 0.95 and len(gone) > 60 and np.mean(gone) < 0.25


def plain_likeness(a, b):
    """Cosine of the sums of signed hashes of the word triples of each line."""
    if Counter(a.encode().split(b"\n")) == Counter(b.encode().split(b"\n")):
        return 1.0
    mul = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD]
    sums = []
    for text in (a, b):
        lanes = [0] * 128
        for line in text.encode().split(b"\n"):
            h = [0, 0, *(zlib.crc32(w) for w in line.split())]
            for x, y, z in zip(h, h[1:], h[2:]):
                v = (x * mul[0] + y * mul[1] + z * mul[2]) % 2**64
                v = (v ^ v >> 29) * mul[3] % 2**64
                lanes[v >> 57] += 1 if v >> 56 & 1 else -1
        sums.append(lanes)
    x, y = sums
    norm = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return min(1.0, max(0.0, sum(v * w for v, w in zip(x, y)) / norm)) if norm else 0.0


def test_fingerprints_with_text_ids_and_clashing_columns(spark):
    rows = [(f"id{i:05d}", f"some text {i} " * 3, "x", 1) for i in range(2500)]
    df = spark.createDataFrame([*rows, (None, None, None, 2)], "doc_id string, text string, next string, range int")
    out = {r.doc_id: r for r in fingerprints.fingerprint_edits(df.repartition(3)).collect()}
    assert len(out) == 2501 and out["id00007"].near_next == pytest.approx(plain_likeness(rows[7][1], rows[6][1]))


def test_fingerprint_ranges(docs):
    rows = [(i * 7, f"text {i} " * 5) for i in range(500)] + [(None, "n1"), (None, "n2"), (70, "tie")]
    t = fingerprints.with_next(docs(rows), rows_a_range=20)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter((a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1]))
    assert Counter(map(tuple, t.collect())) == want
    assert fingerprints.fingerprint_edits(docs([])).count() == 0
    assert fingerprints.fingerprint_edits(docs([(1, "alone again")])).first().near_next == 1.0


def test_fingerprint_is_homomorphic():
    f = fingerprints.Fingerprint.of
    assert f("a b c\nd e\nf") == f("f\na b c\nd e") != f("a b c\nd e")
    assert f("a b c\nd e") + f("f") == f("f\na b c\nd e") and f("a b\nc") - f("c") == f("a b")
    rng = random.Random(5)
    t, u = words(rng, 400, 5000), words(rng, 400, 5000)
    assert f(t).likeness(f(t[: len(t) // 2] + u[: len(u) // 2])) > 0.3 > f(t).likeness(f(u))


def test_toxicity_on_held_out_labels(spark, docs):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        t = [f"v{rng.randrange(300)}" for _ in range(60)]
        if bad:
            for at in rng.sample(range(60), 4):
                t[at] = rng.choice(["grumpf", "grumpfen", "idiot", "blarg"])
        rows.append((i, " ".join(t) + "."))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "you idiot"), (7, rows[7][1])]
    lab = spark.createDataFrame([*labels, (5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs(rows), lab).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 80 and sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.99 * len(held)
    assert toxicity.score_toxicity(docs([]), lab).count() == 0
    assert {r.predicted for r in toxicity.score_toxicity(docs(rows[1:5]), lab.limit(0)).collect()} <= {0, 1}


def test_grammar_scores_clauses():
    s = toxicity.Scorer({"idiot": 1.0, "blarg*": 1.0})
    found = lambda t: {o for o, x in zip(toxicity.OUTPUTS, s.features(t)) if x > 0}
    prior = np.array([*toxicity.OUTPUTS.values(), 0])
    score = lambda t: float(np.array(s.features(t)) @ prior)
    assert score("you are an idiot") > score("what an idiot") > score("he said idiot") > 0
    assert score("what an idiot") > score("he is not an idiot") > 0
    for t in ("i will kill you", "we will kill them all", "kill you", "you i will kill"):
        assert found(t) == {"Ht"} and score(t) > score("i will kill time") == 0
    assert found("he said i will kill you") == {"Hr"} and found("i will not kill you") == {"Hn"}
    assert 0 < score("he said i will kill you") < score("i will kill you")
    assert score("blargen") == score("blarg") > 0 == score("xblarg idiotic thing")
    ahead, composed = toxicity.grammar()
    assert [y for y, _ in ahead.run("HIOTIH")] == ["H", "I", "O", "T", "I+", "H+"]
    assert [y for y, _ in composed.run("OTNIORIHTH")] == ["O", "T", "N", "In", "O", "R", "Ir", "Hr", "T", "Hr"]


def plain_toxic_features(lexicon, text):
    """The clauses' outputs by their definition, without transducers."""
    low, sums = (text or "").lower(), dict.fromkeys(toxicity.OUTPUTS, 0.0)
    weight = lambda w: max([lexicon.get(w, 0.0), *(lexicon.get(w[:n] + "*", 0.0) for n in range(1, len(w) + 1))])
    for clause in re.split(r"[.!?;:\n]", low):
        ws = re.findall(r"\w+(?:'\w+)?", clause)
        of = {w: weight(w) for w in set(ws)}
        said = lambda words, part: any(not of[x] and x in words for x in part)
        aimed, seen = said(toxicity.TARGETS, set(ws)), 0
        reports = [i for i, x in enumerate(ws) if not of[x] and x in toxicity.REPORTS]
        for i, w in enumerate(ws):
            if not of[w] and (w not in toxicity.THREATS or not aimed):
                continue
            told, negated = bool(reports) and reports[0] < i, said(toxicity.NEGATIONS, ws[max(0, i - 3) : i])
            if of[w]:
                out = "Ir" if told else "In" if negated else "It" if aimed else "I"
                if out in ("I", "It"):
                    seen += 1
                    out = "II" if seen > 1 else out
            else:
                out = "Hr" if told else "Hn" if negated else "Ht"
            sums[out] += of[w] or 1.0
    return [*(math.log1p(x) for x in sums.values()), math.log1p(len(text or ""))]


def test_toxicity_scores_by_hand(spark, docs):
    rng = random.Random(3)
    some = ["you", "idiot", "kill", "not", "said", "them", "the", "a", "never", "hurt", "x"]
    rows = [(i, "".join(rng.choice(some + ["grumpf", "grumpfen"] * (i % 3 == 0) * 3) + rng.choice([" ", " ", " ", ". ", "\n", ", "]) for _ in range(rng.randrange(1, 30)))) for i in range(300)]
    rows += [(900, None), (901, ""), (None, "you idiot"), (903, "word " * 300_000 + "kill you" + " idiot" * 1000), (904, "Kill YOU!"), (904, "Kill YOU!")]
    labels = [(i, int(i % 3 == 0)) for i in range(300)]
    lab = spark.createDataFrame([*labels, (3, 0), (3, 1)], "doc_id long, toxic int")
    df = docs(rows).withColumn("toxic", F.lit(9)).withColumn("score", F.lit("x")).withColumn("held_out", F.lit(0))
    lexicon, w = toxicity.learn(df, lab)
    assert any(x.startswith("grum") for x in lexicon)
    out = Counter((r.doc_id, round(r.score, 9), r.predicted, r.held_out) for r in toxicity.score_toxicity(df, lab).collect())
    want = Counter()
    for i, t in rows:
        z = sum(a * b for a, b in zip(plain_toxic_features(lexicon, t), w)) + w[-1]
        p = 1 / (1 + math.exp(-z))
        want[i, round(p, 9), int(p >= 0.3), i is not None and zlib.crc32(str(i).encode()) % 4 == 2] += 1
    assert out == want


def test_toxicity_on_the_labels_table(spark):
    """Held-out rows of the tables: area under the curve."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    out = toxicity.score_toxicity(read("documents"), read("labels")).where("held_out").join(read("labels").where("toxic is not null").select("doc_id", "toxic"), "doc_id").collect()
    ones, zeros = (np.array([r.score for r in out if r.toxic == k]) for k in (1, 0))
    assert len(ones) > 50
    assert np.mean(ones[:, None] > zeros[None, :]) + 0.5 * np.mean(ones[:, None] == zeros[None, :]) > 0.96
    aimed = toxicity.score_toxicity(spark.createDataFrame([(-2, "i will kill you"), (-1, "i will kill time")], "doc_id long, text string").unionByName(read("documents").select("doc_id", "text")), read("labels")).where("doc_id < 0").orderBy("doc_id").collect()
    assert aimed[0].score > aimed[1].score


def test_mixing_against_plain_python(docs):
    rows = corpus() + [(200 + k, t, None, s) for k, (t, s) in enumerate([(None, None), ("", "src1"), ("a b", None), ("x y z", "tiny"), ("x", "é")])] + [(None, "n n", None, "src2"), (5, "dup", None, "src2"), (5, "dup", None, "src2")]
    out = mixing.queue(docs(rows)).drop("key").collect()
    sizes = defaultdict(int)
    for i, t, _, s, *_ in [(*r, None, None)[:5] for r in rows]:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, left = {}, 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (left - sum(full.values())) / sum(w[s] for s in rest)
        over = [s for s in rest if level * w[s] > 2 * sizes[s]]
        if not over:
            break
        full |= {s: 2 * sizes[s] for s in over}
    target = {s: full.get(s, level * w[s]) for s in names}
    taken, largest = defaultdict(int), defaultdict(int)
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in names:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = mixing.queue(docs(rows).repartition(7)).drop("key").collect()
    assert Counter(again) == Counter(out)
    assert mixing.queue(docs([])).count() == 0
    assert mixing.queue(docs([(1, None, None, "a"), (2, "", None, None)])).where("taken = 0").count() == 2


def bm25(rows, queries, k):
    tf = [(i, toxic_free(t)) for i, t in rows]
    n, avg = len(tf), sum(sum(c.values()) for _, c in tf) / len(tf)
    df = Counter(t for _, c in tf for t in c)
    out = {}
    for q, text in queries:
        scores = []
        for i, c in tf:
            dl = sum(c.values())
            s = sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * dl / avg)) for t in set(toxic_free(text)) if t in c)
            if s > 0:
                scores.append((-round(s, 6), i))
        out[q] = sorted(scores)[:k]
    return out


def toxic_free(t):
    return Counter(re.findall(r"\w+", (t or "").lower()))


def test_search_is_exact(docs, monkeypatch):
    rows = [(i, t) for i, t, *_ in corpus(n=200)] + [(500, None), (501, ""), (550, "zzz unique"), (551, "w1 W1 w2")]
    queries = [r for r in rows if r[0] % 50 == 0] + [(17, rows[17][1])]
    whole = search.build_index
    monkeypatch.setattr(search, "build_index", lambda d, **k: whole(d.repartition(6), shard_docs=40, shard_postings=300, **k))
    df = docs(rows).withColumn("rank", F.lit(1)).withColumn("score", F.lit(2))
    out = defaultdict(list)
    for r in search.top_k(df, df.where(F.col("doc_id") % 50 == 0).unionByName(df.where("doc_id = 17")), k=5, slice_queries=2).orderBy("query_id", "rank").collect():
        out[r.query_id].append((-round(r.score, 6), r.doc_id))
    want = bm25(rows, queries, 5)
    for q, _ in queries:
        assert [s for s, _ in out[q]] == pytest.approx([s for s, _ in want[q]], abs=2e-6)
        top = [x for x in want[q] if x[0] < want[q][-1][0] - 1e-5] if want[q] else []
        assert {i for _, i in top} <= {i for _, i in out[q]}
    assert search.top_k(docs([]), docs([])).count() == 0 and search.top_k(docs([(1, "a")]), docs([])).count() == 0
    twice = search.top_k(docs([(1, "a b"), (1, "a b"), (None, "a")]), docs([(1, "a b"), (1, "a b")])).orderBy("rank").collect()
    assert [r.doc_id for r in twice] == [1, 1, None]


def test_block_max_wand_skips_and_is_exact():
    import pyarrow as pa

    rng = random.Random(4)
    b = search.ShardBuilder()
    texts = []
    for i in range(6000):  # themes, so that the lists' blocks differ
        theme = i % 12
        texts.append(" ".join([f"c{theme}", f"d{theme}", *(f"t{theme}x{rng.randrange(30)}" for _ in range(rng.randrange(1, 25))), *(f"w{rng.randrange(800)}" for _ in range(rng.randrange(1, 40)))]))
        b.add(i, texts[-1])
    s = search.Shard(b.row(pa.int64()).to_pylist()[0], 35.0)
    for t in range(0, len(s.terms), 17):
        post = slice(s.starts[t], s.starts[t + 1])
        entries = slice(s.entry_starts[t], s.entry_starts[t + 1])
        assert s.impact[post].max() == s.max[t] == s.entry_max[entries].max()
        for e in range(entries.start, entries.stop):
            of = slice(s.entry_first[e], s.entry_first[e + 1])
            assert s.impact[of].max() == s.entry_max[e] and set(s.docs[of] >> search.SHIFT) == {s.entry_block[e]}
    df, skipped = np.diff(s.starts), []
    texts = [search.terms_of(texts[i]) for i in s.ids]  # as the shard numbers them
    tfs = [{xxhash.xxh64_intdigest(x): n for x, n in t.items()} for t in texts]
    assert (s.row_of >= 0).any() and (s.counts <= search.RARE).any() and ((s.row_of < 0) & (s.counts > search.RARE)).any()
    for q in (5, 777, 5999):
        terms = np.array([xxhash.xxh64_intdigest(t) for t in texts[q]], np.uint64)
        at = np.searchsorted(s.terms, terms)
        w = np.log1p((6000 - df[at] + 0.5) / (df[at] + 0.5))
        plain = np.zeros(6000)
        for t, v in zip(at, w):
            for p in range(s.starts[t], s.starts[t + 1]):
                tf = tfs[s.docs[p]][int(s.terms[t])]
                plain[s.docs[p]] += v * tf * 2.2 / (tf + s.norm[s.docs[p]])
        plain = np.round(plain, 6)
        for k in (1, 10, 5999, 8000):
            for floor in (0.0, np.sort(plain)[-min(k, 6000)], np.sort(plain)[-3]):
                s.opened = s.asked = 0
                ((_, docs, score),) = s.search_all([(terms, w)], k, [floor])
                assert score == pytest.approx(plain[docs], abs=1e-6)
                assert {i for i in range(6000) if plain[i] > max(floor, np.sort(plain)[-min(k, 6000)]) + 2e-6} <= set(docs.tolist())
                if k == 10:  # postings in blocks that can't reach the threshold are not read
                    skipped.append(1 - s.opened / s.asked)
    assert np.mean(skipped) > 0.1 and max(skipped) > 0.25, skipped
    ((_, docs, score),) = s.search_all([(np.array([1, 2, 3], np.uint64), np.ones(3))], 10, [0.0])
    assert not len(docs) and not len(score)


def test_search_passes_on_few_rows(docs, monkeypatch):
    """What shards pass on grows with the queries and the logarithm of the shards, not with queries times shards."""
    rng = random.Random(8)
    rows = [(i, words(rng, 30, 400)) for i in range(2000)]
    whole, made = search.build_index, []
    monkeypatch.setattr(search, "build_index", lambda d, **k: whole(d.repartition(40), shard_docs=50, **k))
    real = search._searcher

    def counted(n, average, k):
        run = real(n, average, k)
        acc = docs([]).sparkSession.sparkContext.accumulator(0)
        made.append(acc)

        def with_count(batches):
            for b in run(batches):
                acc.add(b.num_rows)
                yield b

        return with_count

    monkeypatch.setattr(search, "_searcher", counted)
    out = search.top_k(docs(rows), docs(rows[::50]), k=5).collect()
    assert len(out) == 40 * 5
    assert 40 * 5 <= sum(a.value for a in made) < 40 * 5 * (1 + 3.5 * 3) < 40 * 5 * 40
    want = bm25(rows, rows[::50], 5)
    for q, _ in rows[::50]:
        assert sorted(-r.score for r in out if r.query_id == q) == pytest.approx([x for x, _ in want[q]], abs=2e-6)


def plain_simhash(t):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_against_all_pairs(docs):
    rng = random.Random(9)
    base = words(rng, 3000, 500).split()
    rows = [(r[0], r[1]) for r in corpus()] + ODD
    for i in range(40):  # a family of near copies
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = "CHANGED"
        rows.append((1000 - i, " ".join(t)))
    out = simhash.near_duplicates(docs(rows)).collect()
    fp = [plain_simhash(t) for _, t in rows]
    assert Counter((r.doc_id, r.fingerprint) for r in out) == Counter((i, f"{x:016x}") for (i, _), x in zip(rows, fp))
    root = list(range(len(rows)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter((d, least.get(find(i))) for i, (d, _) in enumerate(rows))
    assert simhash.near_duplicates(docs([])).count() == 0


def test_cell_links_join_all_that_all_pairs_join(spark):
    rng = random.Random(11)
    fps = {rng.getrandbits(64) for _ in range(400)}
    for c in list(fps)[:15]:
        for _ in range(60):
            x = c
            for _ in range(rng.randrange(1, 7)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = dict(map(tuple, simhash.components(simhash.links(df)).collect()))
    a = np.array(sorted(fps))
    lab = {x: x for x in a.tolist()}
    changed = True
    near = [a[np.bitwise_count((a ^ x).view(np.uint64)) <= 4] for x in a]
    while changed:
        changed = False
        for x, n in zip(a.tolist(), near):
            m = min(lab[y] for y in n.tolist())
            for y in n.tolist():
                if lab[y] != m:
                    lab[y], changed = m, True
    assert {x: got.get(x, x) for x in lab} == lab
    u, v = simhash.embed(a[:-1]), simhash.embed(a[1:])
    assert (np.bitwise_count(u ^ v) <= np.bitwise_count((a[:-1] ^ a[1:]).view(np.uint64))).all()


def test_lines_against_plain_python(docs):
    rng = random.Random(6)
    pool = ["Common line.", "  common LINE. ", "ÉTÉ", "été", "\tx\x0b", "z\r"]
    rows = [(i, "\n".join(rng.choice([*pool, f"own {i}", "", words(rng, 3)]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += ODD + [(700, "\n".join(["Common line."] * 2000 + ["tail"])), (701, "Common line."), (702, "\n\n")]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip("\t\n\x0b\x0c\r "))
    n = Counter()
    for _, t in {(i, t or "") for i, t in rows}:
        n.update({key(x) for x in t.split("\n")} - {""})
    want = Counter()
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if n[key(x)] < 10]
        want[i, len(ls), len(ls) - len(kept), "\n".join(kept)] += 1
    assert any(x[2] for x in want)
    df = docs(rows).withColumn("lines", F.lit(1)).withColumn("_k1", F.lit("clash"))
    out = lines.dedup_lines(df).select("row.doc_id", "n_lines", "n_dropped", "kept_text")
    assert Counter(map(tuple, out.collect())) == want
    assert lines.dedup_lines(docs([])).count() == 0


def test_token_counts_against_plain_viterbi(docs):
    pieces = tokens.load_pieces()
    low = min(pieces.values()) - 10

    def plain(word):
        t = "▁" + word
        best = [(0.0, 0)] + [None] * len(t)
        for i in range(1, len(t) + 1):
            options = [(best[j][0] + pieces[t[j:i]], -(best[j][1] + 1)) for j in range(i) if t[j:i] in pieces]
            if t[i - 1] not in pieces:
                options.append((best[i - 1][0] + low, -(best[i - 1][1] + len(t[i - 1].encode()))))
            s, c = max(options)
            best[i] = (s, -c)
        return best[-1][1]

    rows = [(r[0], r[1]) for r in corpus(n=30)] + ODD + [(900, "Hello wörld 漢字 😀 the internationalization " * 3), (901, "x" * 3000)]
    rng = random.Random(8)
    rows.append((902, " ".join("".join(rng.choice("thesanrioé") for _ in range(rng.randrange(1, 15))) for _ in range(400))))
    out = tokens.count_tokens(docs(rows)).collect()
    want = Counter((i, len(ws), sum(map(plain, ws))) for i, t in rows for ws in [WORD.findall(t or "")])
    assert Counter(map(tuple, out)) == want
    small = tokens.TrieCounter(pieces, room=5)
    for ws in ({"ab", "abc"}, {"abd", "x", "yz"}, {"ab", "q"}):
        small.add(ws)
        assert all(small.known[w] == plain(w) for w in ws)
    assert tokens.count_tokens(docs([])).count() == 0


TEXTS = {"en": "the house and the garden with this thing that they were having", "de": "das haus und der garten mit dem ding das sie nicht haben", "fr": "la maison et le jardin avec cette chose que nous avons"}


def test_language_text_and_evidence(spark, docs):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(rng.choice(TEXTS[lang].split()) for _ in range(40)), lang if i % 7 else None, f"host{lang}" if i % 5 else None, 0))
    rows += [(900, None, "en", None, 0), (901, "", None, "hosten", 0), (902, "12 34 -- !!", "de", "x", 0), (903, "qzx" * 40 + "ξψω" * 40, None, None, 0), (904, "the haus", "fr", "hostfr", 0), (3, rows[3][1], "en", None, 0)]
    out = {r.doc_id: r for r in language.identify(docs(rows).withColumn("ll", F.lit(0)).withColumn("host", F.lit(0))).collect()}
    good = [i for i in range(300) if out[i].lang == ("en", "de", "fr")[i % 3] and out[i].accepted]
    assert len(good) == 300
    assert not any(out[i].accepted for i in (900, 901, 902, 903)) and out[900].lang == "und"
    assert language.identify(docs([])).count() == 0
    assert language.identify(docs([(1, "no label at all")])).first().lang == "und"
    # the prior of a host decides what a word leaves open, and the declaration on a page does too
    pages = [(i, f"<html lang='{x}-X'><script>var the</script><body><p>{TEXTS[x]}</p>", f"http://{x}{i % 4}.example.{x}/p") for i in range(120) for x in [("en", "de")[i % 2]]]
    pages += [(500, "<html><p>in</p>", "http://de1.example.de/"), (501, "<html><p>in</p>", "http://en0.example.en/"), (502, "<html><p>in</p>", "http://new.de/"), (503, "<html><p>in</p>", "http://new.en/"), (504, '<HTML dir=x LANG="de"><p>in</p>', None)]
    got = {r.doc_id: r.lang for r in language.identify(spark.createDataFrame(pages, "page_id long, html string, url string"), "page_id", None, None, None, "url", "html").collect()}
    assert [got[i] for i in (500, 501, 502, 503, 504)] == ["de", "en", "de", "en", "de"]


def plain_posteriors(rows, sample, languages, models, text_weight=300.0, prior_weight=10.0):
    """lang and confidence of (id, text, declared, host, suffix), by the definitions, with dictionaries."""
    c = language.CLASSES
    n3 = {x: Counter() for x in languages}
    for text, lang in sample:
        n3[lang].update(language.trigrams(text).tolist())
    n2 = {x: Counter() for x in languages}
    n1, all2, all3 = ({x: Counter() for x in languages} for _ in range(3))
    for x in languages:
        for g, n in n3[x].items():
            n1[x][g % c] += n
            n2[x][g % c**2] += n
            all2[x][g // c % c] += n
            all3[x][g // c] += n
    total = {x: sum(n1[x].values()) for x in languages}
    pooled = {k: sum(n1[x][k] for x in languages) + 0.5 * len(languages) for k in range(c)}
    everything = sum(pooled.values())

    def p(x, g):
        p1 = (n1[x][g % c] + 0.5) / (total[x] + 0.5 * c)
        p2 = (n2[x][g % c**2] + 10 * p1) / (all2[x][g // c % c] + 10)
        return (n3[x][g] + 10 * p2) / (all3[x][g // c] + 10)

    lls = []
    for _, text, *_ in rows:
        gs = language.trigrams(text or "").tolist()
        ll = {x: sum(math.log(p(x, g)) for g in gs) for x in languages}
        ll["und"] = sum(math.log(pooled[g % c] / everything) for g in gs) + models.margin * len(gs) - models.slack
        lls.append((len(gs), ll))
    names = [*languages, "und"]
    says = [max(names, key=lambda x: ll[x]) if n else "und" for n, ll in lls]  # noqa: B023
    whole = Counter(says)
    whole = {x: (whole[x] + 0.5) / (len(rows) + 0.5 * len(names)) for x in names}
    out = []
    for (i, _, declared, host, suffix), (n, ll), own in zip(rows, lls, says):
        prior = whole
        for at, value in ((4, suffix), (3, host)):
            if value is not None:
                of = Counter(s for r, s in zip(rows, says) if r[at] == value)
                of[own] -= 1
                prior = {x: (of[x] + prior_weight * prior[x]) / (sum(of.values()) + prior_weight) for x in names}
        post = {x: ll[x] * text_weight / (n + text_weight) / 2 + math.log(prior[x]) for x in names}
        if declared:
            of = Counter((r[2], s) for r, s in zip(rows, says) if r[2])
            for x in names:
                post[x] += math.log(of[declared, x] + 0.5) - math.log(sum(v for (_, s), v in of.items() if s == x) + 0.5 * len(names))
        top = max(post.values())
        out.append((i, max(names, key=lambda x: post[x]) if n else "und", 1 / sum(math.exp(v - top) for v in post.values())))  # noqa: B023
    return out


def test_language_against_plain_posteriors(spark):
    rng = random.Random(9)
    rows, pages = [], []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        text = " ".join(rng.choice(TEXTS[lang if rng.random() < 0.9 else "en"].split()) for _ in range(rng.randrange(1, 12)))
        rows.append((i, text, lang if i % 4 else None, f"h{i % 3 if i % 5 else 9}.{lang}" if i % 7 else None))
    rows += [(100, None, None, "h0.en"), (101, "", "de", None), (102, "zzz qqq", None, "h1.de"), (103, "in", None, "h0.en"), (104, "ξψω " * 50, "en", None), (5, rows[5][1], "fr", "h9.fr")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, url string, n int, host string").withColumn("url", F.concat(F.lit("http://"), "url", F.lit("/a")))
    ev = language.evidence(df, "doc_id", "text", "lang", None, "url")
    languages, models = language.train(ev)
    sample = {(t or "", x) for _, t, x, _ in rows if x}
    want = plain_posteriors([(i, t, x, h, h and h.split(".")[-1]) for i, t, x, h in rows], sample, languages, models)
    got = language.identify(df, "doc_id", "text", "lang", None, "url").select("doc_id", "lang", "confidence").collect()
    key = lambda r: (r[0], r[1], r[2])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-6)


def test_documents_and_pages_share_hosts(spark):
    """A host that one table names with a suffix and the other without is one host; so is one without any suffix."""
    rng = random.Random(4)
    text = lambda lang: " ".join(rng.choice(TEXTS[lang].split()) for _ in range(8))
    docs = [(i, text(("en", "de")[i % 2]), ("en", "de", None)[i % 3], ("news.example.org", "b.example.org", None, "bare")[i % 4]) for i in range(40)]
    pages = [(100 + i, f"<html lang='{x}'><p>{text(x)}</p>", f"http://{h}/p") for i in range(10) for x in [("en", "de")[i // 5]] for h in [("news.example.org", "only.example.net")[i % 2]]]
    d = language.evidence(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), "doc_id", "text", "lang", "source", origin="documents")
    p = language.evidence(spark.createDataFrame(pages, "page_id long, html string, url string"), "page_id", None, None, None, "url", "html", origin="pages")
    ev = d.unionByName(p)
    got = language.fuse(ev).select("id", "lang", "confidence").collect()
    assert len(got) == 50
    languages, models = language.train(ev)
    rows = [(r.id, r.text, r.declared, r.host, {"news.example.org": "org", "only.example.net": "net"}.get(r.host)) for r in ev.collect()]
    want = {r[0]: r[1:] for r in plain_posteriors(rows, {(r[1], r[2]) for r in rows if r[2]}, languages, models)}
    assert all(r.lang == want[r.id][0] and r.confidence == pytest.approx(want[r.id][1], abs=1e-6) for r in got)


def test_language_has_no_cut_of_classes(spark, docs):
    """A rare language beside 40 others, and one with under 0.1 % of the rows."""
    rng = random.Random(5)
    tags = [a + b for a in "abcde" for b in "klmnopqr"]
    vocabulary = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8))) for _ in range(15)] for x in [*tags, "zz"]}
    rows = [(i, " ".join(rng.choice(vocabulary[x]) for _ in range(30)), x) for i in range(4400) for x in [tags[i % 40]]]
    rows += [(9000 + i, " ".join(rng.choice(vocabulary["zz"]) for _ in range(30)), "zz") for i in range(3)]
    rows += [(9100, " ".join(vocabulary["zz"]), None), (9101, " ".join(vocabulary["er"]), None)]
    out = {r.doc_id: r for r in language.identify(docs(rows)).collect()}
    assert all(out[i].lang == x and out[i].accepted for i, _, x in rows if x)
    assert (out[9100].lang, out[9101].lang) == ("zz", "er")


def test_likeness_of_a_triple_repeated_often():
    text = "word " * 70_000
    own, half = fingerprints.Fingerprint.of(text), fingerprints.Fingerprint.of(text[: len(text) // 2])
    assert own.likeness(half) > 0.99


CLASH = "id row node fp root least key size n sent part hash bucket rank piece start next range lent toxic score x y lines t gone h1 word host ll says near origin _k1 _k2 comp block cell w0 at shard q1 term page_id_ held_out".split()


def test_clashing_columns_and_odd_rows(spark, docs):
    """Extra columns change nothing; empty tables give nothing; a very long text passes everywhere."""
    rows = [(r[0], r[1], "en", "s", 1) for r in corpus(n=40)] + [(*r, None, None, None) for r in ODD] + [(950, "long text of words " * 60_000, "en", "s", 1)]
    plain = docs(rows)
    more = plain.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASH])
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    every = {
        "pack": packing.pack, "fingerprint_edits": fingerprints.fingerprint_edits, "score_toxicity": lambda d: toxicity.score_toxicity(d, lab), "queue": mixing.queue,
        "near_duplicates": simhash.near_duplicates, "similar_documents": simhash.similar_documents, "count_tokens": tokens.count_tokens, "identify": language.identify,
        "top_k": lambda d: search.top_k(d, d.where("doc_id % 50 = 0")), "dedup_lines": lambda d: lines.dedup_lines(d).select("row.doc_id", "row.text", "kept_text", "n_lines", "n_dropped"),
    }
    for name, f in every.items():
        a, b = (Counter(map(str, f(d).collect())) for d in (plain, more))
        assert a == b and a, name
        assert f(more.limit(0)).count() == 0, name
