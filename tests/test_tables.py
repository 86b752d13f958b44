"""Tables that are built once, merged sketches, and the gate of keys with many values."""

import os

from pyspark.sql import functions as F

from tagloom.operators import profile
from tagloom.sources import tables

TAGS = "id long, lod_level int, tags map<string,string>"


def test_tables_follow_their_input(spark, tmp_path):
    source = str(tmp_path / "in")
    calls = []

    def make():
        calls.append(1)
        return spark.read.parquet(f"{source}/x.parquet")

    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(f"{source}/x.parquet")
        for _ in range(2):
            assert tables.built_once(spark, source, "rows", make).count() == n
    assert len(calls) == 2


def test_bucketed_pairs_need_no_shuffle(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    pois = spark.createDataFrame([(i, i % 3, {"a": f"v{i % 7}", "b": "x"}) for i in range(60)], TAGS)
    t = tables.built_once(spark, str(tmp_path / "in"), "pairs", lambda: profile.pair_levels(pois), bucket_by=("key", "value"))
    by_pair = t.groupBy("key", "value").agg(F.sum("n").alias("n"))
    assert "Exchange" not in by_pair._jdf.queryExecution().executedPlan().toString()
    assert {(r.key, r.value): r.n for r in by_pair.collect()}["b", "x"] == 60


def test_gate_of_keys_with_many_values(spark):
    pois = spark.createDataFrame([(i, i % 2, {"few": f"v{i % 3}", "many": f"v{i}", "none": None}) for i in range(30)], TAGS)
    levels = profile.pair_levels(pois)
    assert {r.key for r in profile.pair_counts(levels, 3).collect()} == {"few", "none"}
    assert profile.pair_counts(levels, 30).where("key = 'many'").count() == 30
    k = {r.key: r for r in profile.key_profile(levels).collect()}
    assert (k["many"].n, k["many"].nd, k["few"].nd, k["none"].n, k["none"].nd) == (30, 30, 3, 30, 0)


def test_sketches_merge(spark, tmp_path):
    make = lambda lo, hi: spark.createDataFrame([(i, i % 3, {"k": f"v{i % 4000}", "few": "x"}) for i in range(lo, hi)], TAGS)
    path = str(tmp_path / "sketches")
    profile.append_sketches(make(0, 3000), path)
    profile.append_sketches(make(2000, 6000), path)
    got = {r.key: r for r in profile.merged_sketches(spark.read.parquet(path)).collect()}
    assert got["few"].nd_approx == 1 and got["few"].n == 7000 and abs(got["k"].nd_approx - 4000) <= 0.05 * 4000
    assert profile.merged_sketches(spark.read.parquet(path), "key", "lod_level").count() == 6
