"""Styles kept up to date by deltas, and points of lists that most of them share."""

import random

from pyspark.sql import functions as F

from tagloom.operators import lens

EVALS = "tag_id string, confidence double, score double, choice array<double>"


def data(spark, n=300):
    """Half the points have one list, and one tag is in most of the lists."""
    rng = random.Random(6)
    rows = [(i, ["a=b"] if i % 2 else sorted({"c=d", *(f"t={rng.randrange(25)}" for _ in range(rng.randrange(4)))})) for i in range(n)] + [(n, [])]
    tags = [f"t={i}" for i in range(25)] + ["a=b", "c=d", "other=x"]
    answers = [(t, rng.choice([None, 0.0, 0.5, 1.0]), rng.choice([None, 1.0, 3.5]), rng.choice([None, [0.2] * 5])) for t in tags]
    return spark.createDataFrame(rows, "id long, tag_ids array<string>"), answers


def plain(df):
    return sorted((r.id, r.total, r.evaluated, r.state, r.score and round(r.score, 9), r.choice and [round(c, 9) for c in r.choice], r.color) for r in df.collect())


def test_deltas_equal_the_whole_fold(spark, tmp_path):
    points, answers = data(spark)
    view = lens.Repaint(points, str(tmp_path / "r"))
    frame = lambda rows: spark.createDataFrame(rows, EVALS)
    assert plain(view.paint(points)) == plain(lens.style_pois(points, frame([])))
    lists = points.select("tag_ids").distinct().collect()
    known = []
    for delta in (answers[:3], answers[3:4], answers[4:20], answers[20:], [("a=b", 0.9, 0.5, None)]):
        known = [a for a in known if a[0] not in {d[0] for d in delta}] + delta
        touched = view.update(frame(delta), frame(known))
        assert touched == sum(bool({d[0] for d in delta} & set(r.tag_ids)) for r in lists)
        assert plain(view.paint(points)) == plain(lens.style_pois(points, frame(known)))
    assert view.update(frame([("nobody=has", 1.0, 1.0, None)]), frame(known)) == 0
    assert view.update(frame([]), frame(known)) == 0


def test_points_of_a_hot_list_are_not_shuffled(spark, monkeypatch):
    points, answers = data(spark)
    ev = spark.createDataFrame(answers, EVALS)
    want = plain(lens.style_pois(points, ev))
    monkeypatch.setattr(lens, "HOT", 1)  # no list is hot
    assert plain(lens.style_pois(points, ev)) == want
    monkeypatch.setattr(lens, "HOT", 10**9)  # all are
    df = lens.style_pois(points, ev)
    assert plain(df) == want
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
    assert lens.style_pois(points.limit(0), ev).count() == 0
