"""The pipeline's stages, each on what the one before has written, against brute force."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .test_llm import TEXTS, WORD, plain_simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fixture():
    import random

    rng = random.Random(12)
    rows = []
    for i in range(200):
        lang = ("en", "de", "fr")[i % 3]
        t = "\n".join(" ".join(rng.choice(TEXTS[lang].split()) for _ in range(rng.randrange(5, 40))) for _ in range(rng.randrange(1, 5)))
        if i % 8 == 1:
            t += "\nSubscribe to our letter!"
        if i % 20 == 5:
            t = rows[-3][1]
        rows.append((i, t, lang, f"s{i % 5}" if i % 3 else "big", len(t)))
    rows += [(300, "", "en", "s1", 0), (301, None, None, None, None), (302, "... 123", "en", "s1", 7), (303, "Subscribe to our letter!", "en", None, 24), (7, rows[7][1], *rows[7][2:]), (None, rows[11][1] + " and more", "fr", "s2", 0)]
    return rows


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    df = spark.createDataFrame(fixture(), "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit("clash"))
    df.write.parquet(f"{d}/documents.parquet")
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), [df]
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, str(d)).write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        out.append(docs)
    return out, str(d)


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_stages_and_columns(staged):
    out, _ = staged
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix", "pack"]
    assert all(set(COLUMNS) <= set(df.columns) for df in out[:-1]) and "bin_id" in out[-1].columns


def test_language_keeps_clean_documents(staged):
    before, after = Counter(rows_of(staged[0][0])), Counter(rows_of(staged[0][1]))
    assert not after - before
    gone = before - after
    assert {r[0] for r in gone} == {300, 301, 302}


def test_lines(staged):
    before, after = rows_of(staged[0][1]), rows_of(staged[0][2])
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip("\t\n\x0b\x0c\r "))
    n = Counter(k for i, t in {(r[0], r[1]) for r in before} for k in {key(x) for x in t.split("\n")} - {""})
    assert n["subscribe to our letter!"] >= 10
    want = Counter()
    for i, t, *rest in before:
        kept = "\n".join(x for x in t.split("\n") if n[key(x)] < 10)
        want[(i, kept, *rest[:2], len(kept))] += 1
    assert Counter(after) == want


def test_one_of_each_group_stays(staged):
    before, after = rows_of(staged[0][2]), rows_of(staged[0][3])
    rows = list(dict.fromkeys(before))
    fp = [plain_simhash(r[1]) for r in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (fp[i] ^ fp[j]).bit_count() <= 4 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    best = defaultdict(list)
    for g, r in zip(group, rows):
        best[g].append(r)
    want = {min(v, key=lambda r: (r[0] is None, r[0] or 0))[0] for v in best.values()}
    assert len(after) == len(best) and {r[0] for r in after} == want


def test_mix_is_near_its_targets(staged):
    before, after = rows_of(staged[0][3]), rows_of(staged[0][4])
    size = lambda r: len(WORD.findall(r[1]))
    n = Counter(after)
    assert not set(n) - set(before) and max(n.values()) <= 2
    total = sum(map(size, before))
    assert 0.9 * 1.5 * total < sum(map(size, after)) <= 1.5 * total


def test_packing_keeps_all_words(staged):
    after = Counter()
    for r in staged[0][5].collect():
        after[r.doc_id] += r.n_tokens
    want = Counter()
    for r in rows_of(staged[0][4]):
        want[r[0]] += len(WORD.findall(r[1]))
    assert after == want


def test_run(spark, staged):
    assert corpus_pipeline.run(spark, staged[1]).count() == staged[0][5].count()


def test_null_and_shared_ids_are_no_groups(spark):
    rng = __import__("random").Random(3)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    rows = [(None, text()), (None, text()), (5, text()), (5, text()), (6, text())]
    rows.append((7, rows[4][1]))
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    after = rows_of(corpus_pipeline.near_dedup(spark, docs, ""))
    assert Counter(r[:2] for r in after) == Counter(rows[:5])


def test_copies_of_similarity_08_go(spark):
    rng = __import__("random").Random(4)
    bases = [[f"w{rng.randrange(10**6)}" for _ in range(300)] for _ in range(60)]
    rows = [(i, " ".join(b)) for i, b in enumerate(bases)]
    for i, b in enumerate(bases):  # one word changed in each of k places: about (296 - 5k) / (296 + 5k) of the shingles are shared
        c, k = list(b), (3, 6, 9)[i % 3]
        for at in range(10, 10 + 30 * k, 30):
            c[at] = "x"
        rows.append((100 + i, " ".join(c)))
        rows.append((200 + i, " ".join(b[:150] + bases[(i + 1) % 60][:150])))  # similarity of half or less: stays
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    grams = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    like = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    want = {i for i in range(60) if like(i, 100 + i) >= 0.8}
    after = {r[0] for r in rows_of(corpus_pipeline.near_dedup(spark, docs, ""))}
    assert len(want) == 40 and all(i in after for i in range(60)) and all(200 + i in after for i in range(60))
    assert {100 + i for i in range(60) if i not in want} <= after
    assert len([i for i in want if 100 + i in after]) <= 1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_with_odd_rows(spark, name):
    """Null and empty texts, null ids, repeated rows, a very long text, clashing columns, and an empty table."""
    f = dict(corpus_pipeline.STAGES)[name]
    long = "the house and the garden with this thing " * 40_000
    rows = [(None, None), (1, None), (2, ""), (3, " \t\n"), (None, "the house and the garden"), (None, "a thing that they were having"), (4, "the garden"), (4, "the garden"), (5, long), (6, long), (7, "the house\nand this thing")]
    docs = spark.createDataFrame([(i, t, "en", "s" if i else None, 0, *["clash"] * 8) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, root string, node string, times string, size string, _k1 string, gone string, key string")
    out = f(spark, docs, "")
    got = out.collect()
    assert f(spark, docs.limit(0), "").count() == 0
    if name == "pack":
        assert {r.doc_id for r in got} == {None, 1, 2, 3, 4, 5, 6, 7} and sum(r.n_tokens for r in got) == sum(len(WORD.findall(t or "")) for _, t in rows)
        return
    assert out.columns == docs.columns
    ids = Counter(r.doc_id for r in got)
    want = {
        "language_id": {None: 2, 4: 2, 5: 1, 6: 1, 7: 1}, "line_dedup": {None: 3, 1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1, 7: 1},
        "near_dedup": {None: 2, 1: 1, 4: 1, 5: 1, 7: 1},
    }
    if name == "mix":
        assert ids and not set(ids) & {1, 2, 3} and max(Counter(r.text for r in got).values()) <= 4
    else:
        assert ids == want[name]
