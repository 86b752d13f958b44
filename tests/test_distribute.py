"""Global ranks, request plans, exact quantiles and samples without a task that sees all rows, against plain Python."""

import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tagloom import model
from tagloom.operators import analytics, distribute, evaluate
from tagloom.plans import queries as plans

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_global_rank_and_running_sum(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(40), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k int, n int").repartition(7)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = distribute.global_rank(df, F.desc("k"), F.col("id")).collect()
    assert {r.id: r.rank for r in got} == {r[0]: i for i, r in enumerate(want)}
    sums, total = {}, 0
    for i, _, n in want:
        total += n
        sums[i] = total
    assert {r.id: r.upto for r in distribute.running_sum(df, F.col("n"), F.desc("k"), F.col("id")).collect()} == sums
    assert distribute.global_rank(df.limit(0), F.col("id")).count() == 0 and distribute.running_sum(df.limit(0), F.col("n"), F.col("id")).count() == 0


def test_join_hot(spark):
    rows = spark.createDataFrame([(i, 1 if i % 2 else i) for i in range(400)] + [(400, None)], "id long, k long")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(0, 400, 3)] + [(1, "one")], "k long, v string")
    for share in (1000, 4, 10**9):
        got = Counter((r.id, r.v) for r in distribute.join_hot(rows, table, "k", how="left", hot_share=share).collect())
        known = {k: f"v{k}" for k in range(0, 400, 3)} | {1: "one"}
        assert got == Counter((r.id, known.get(r.k)) for r in rows.collect())
        assert distribute.join_hot(rows, table, "k", hot_share=share).count() == sum(v is not None for _, v in got)


ODD_TAGS = ["plain", 'quo"te', "back\\slash", "new\nline", "\x01\x1f\x7f", "日本", "🗾🏔", "tab\t", "", "a/b", "é "]


def test_question_chars_count_like_json(spark):
    tags = spark.createDataFrame([(t,) for t in ODD_TAGS], "tag_id string")
    for form in ("slim", "full"):
        for p in model.PRIMITIVES:
            got = tags.select("tag_id", evaluate.question_chars(F.col("tag_id"), F.lit(p), form).alias("n")).collect()
            assert {r.tag_id: r.n for r in got} == {t: evaluate.request_chars({t: evaluate.question(t, p, form)}) for t in ODD_TAGS}
    # the constants of the plan's SQL, by hand
    assert evaluate.request_chars({"": {"a": 1}}) == len('{"":{"a":1}}') and evaluate.request_chars("🗾") == 4


def greedy(asked, budget, most, lens="x"):
    """``(primitive, first, tags)`` of each request: one question after the other."""
    out = []
    for p, tags in asked.items():
        held, first = [], 0
        size = evaluate.request_chars({"model": "", "state": evaluate.state(lens), "questions": {}})
        for i, t in enumerate(tags):
            n = len(json.dumps({t: evaluate.question(t, p)}, ensure_ascii=False, separators=(",", ":")).encode("utf-16-le")) // 2
            if held and (size + sum(held) + n > budget or len(held) == most):
                out.append((p, first, tags[first:i]))
                held, first = [], i
            held.append(n)
        if tags:
            out.append((p, first, tags[first:]))
    lists = {p: tuple(t) for p, t in asked.items()}
    place = {p: i for i, p in enumerate(model.PRIMITIVES)}
    group = {p: min(place[q] for q in asked if lists[q] == lists[p]) for p in asked}
    return sorted(out, key=lambda b: (group[b[0]], b[1], place[b[0]]))


@pytest.mark.parametrize(("block", "budget", "most", "n"), [(4096, 3000, 190, 150), (8, 900, 6, 100), (16, 100, 4, 60), (7, 1500, 7, 90), (64, 10**6, 50, 300), (8, 700, 8, 1), (8, 900, 6, 0)])
def test_plan_equals_the_greedy_loop(spark, monkeypatch, block, budget, most, n):
    monkeypatch.setattr(evaluate, "PLAN_BLOCK", block)
    rng = random.Random(block + n)
    tags = [rng.choice(ODD_TAGS)[: rng.randrange(4)] + f"k{i}=" + "v" * rng.choice([1, 5, 40, 300]) for i in range(n)]
    asked = {"noul": tags, "score": [t for t in tags if rng.random() < 0.7], "choice": list(tags)}
    rows = [(i, t, p) for p, some in asked.items() for i, t in enumerate(tags) if t in set(some)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "ord long, tag_id string, primitive string")
    got = sorted(evaluate.plan_batches(df, "x", budget=budget, most=most).collect())
    assert [(r.primitive, r.first, list(r.tags)) for r in got] == greedy({p: t for p, t in asked.items() if t}, budget, most)
    assert [r.batch for r in got] == list(range(len(got))) and all(r.request == r.batch // model.MAX_BATCHES for r in got)


def test_no_window_over_all_tags(spark):
    for name in ("batch_plan", "planned_missing", "random_pairs", "evaluated_tags", "index_quantiles"):
        seen = []
        real = distribute.cut
        keep = lambda df: seen.append(df) or real(df)  # noqa: E731, B023
        old = [(m, m.cut) for m in (distribute, evaluate, analytics) if hasattr(m, "cut")]
        for m, _ in old:
            m.cut = keep
        try:
            seen.append(plans.QUERIES[name](spark, SF))
        finally:
            for m, f in old:
                m.cut = f
        windows = [line for df in seen for line in plan_of(df).splitlines() if "Window [" in line]
        assert all(line.count("], [") >= 2 for line in windows), name  # the values, the partition and the order


@pytest.mark.parametrize(("bins", "few"), [(1024, 10_000), (4, 3), (16, 1)])
def test_index_quantiles_by_selection(spark, bins, few):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([rng.gauss(0, 1e6), rng.random(), 0.5, 0.5, 1e300, -1e300])) for _ in range(800)]
    rows += [("c", 1.0)] * 50 + [("d", float("inf")), ("d", float("-inf")), ("d", 3.0), ("e", None), ("f", float("nan")), ("f", 1.0), ("g", 1.7e308), ("g", -1.7e308), ("g", 0.0), ("h", 5e-324), ("h", 0.0)]
    got = {r.k: r for r in analytics.index_quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", (0.0, 0.5, 0.9, 1.0), bins, few).collect()}
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None:
            groups[k].append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        values.sort(key=lambda x: (math.isnan(x), x))
        for q, c in ((0.0, "q0"), (0.5, "q50"), (0.9, "q90"), (1.0, "q100")):
            want = values[min(int(len(values) * q), len(values) - 1)]
            assert got[k][c] == want or math.isnan(want) and math.isnan(got[k][c]), (k, q)
        assert got[k].n == len(values)
