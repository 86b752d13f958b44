"""The sample of pairs: what it holds, and that the pairs of a key aren't brought into one task."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tagloom.operators import distribute, profile


def points(spark, n=400):
    rows = [(i, {"name": f"n{i}", "kind": "ab"[i % 2], **({"rare": f"r{i}"} if i % 50 == 0 else {})}, 0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, tags map<string,string>, lod_level int").repartition(8), rows


def test_samples_are_the_smallest_digests(spark, monkeypatch):
    """With all keys broadcast, some, and none."""
    df, rows = points(spark)
    pairs = [(k, v, i) for i, tags, _ in rows for k, v in tags.items()]
    values = defaultdict(set)
    for k, v, _ in pairs:
        values[k].add(v)
    digest = lambda k, v, i: hashlib.md5(f"1|{i}|{k}|{v}".encode()).hexdigest()[:15]
    drawn = sorted((digest(*p), *p) for p in pairs if len(values[p[0]]) > 3)[:100]
    want = {k: [d[2] for d in drawn if d[1] == k][:8] for k in {d[1] for d in drawn}}
    real = distribute.join_hot
    for share in (1000, 10, 1):
        monkeypatch.setattr(profile, "join_hot", lambda *a, share=share, **k: real(*a, **k, hot_share=share), raising=False)
        got = profile.value_samples(df, over=3, rows_sampled=100, exact=True).collect()
        assert {r.key: r.samples for r in got} == want
        assert all(r.n == sum(p[0] == r.key for p in pairs) and r.nd_approx == len(values[r.key]) for r in got)
    assert profile.value_samples(df.limit(0), over=3, rows_sampled=100, exact=True).count() == 0


def test_pairs_of_a_key_stay_in_many_tasks(spark, monkeypatch):
    df, _ = points(spark)
    seen = []
    real = distribute.smallest
    monkeypatch.setattr(profile, "smallest", lambda rows, *a, **k: seen.append(rows.where("key = 'name'").groupBy(F.spark_partition_id()).count().collect()) or real(rows, *a, **k))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to be broadcast unasked
    try:
        profile.value_samples(df, over=3, rows_sampled=100, exact=True).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(seen[0]) == 8
