"""The next document where ids are null, equal or text."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagloom.llm import fingerprints

ODD_IDS = {
    "null": lambda i: None, "one": lambda i: 7, "some": lambda i: None if i % 3 else i // 9, "each": lambda i: i,
}


@pytest.mark.parametrize("kind", ODD_IDS)
def test_next_by_id_and_text(spark, kind):
    rng = random.Random(1)
    rows = [(ODD_IDS[kind](i), f"{rng.choice(['', 'same start of the text ', 'é'])}{rng.randrange(400)}" * rng.randrange(3)) for i in range(600)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = Counter((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    for size in (1000, 40, 7):
        assert Counter(tuple(r) for r in fingerprints.with_next(df, rows_a_range=size, prefix=12).collect()) == want
    named = df.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert fingerprints.with_next(named, rows_a_range=20).count() == len(rows)


def test_rows_without_ids_are_spread(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(None, f"{rng.randrange(10**9)} text") for _ in range(3000)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would put so few rows together
    try:
        out = fingerprints.with_next(df, rows_a_range=100).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(out) == 4 and max(r["count"] for r in out) < 1500 and sum(r["count"] for r in out) == 3000
