"""Requests of sessions: settled ones in a stream and in a log, views answered with their ids, and the latest of those that wait."""

import os

from pyspark.sql import functions as F

from tagloom.functions import text
from tagloom.sources import tiered
from tagloom.streaming import requests

from .test_tiered import points

ASKED = "session string, request_id long, x0 double, y0 double, x1 double, y1 double, max_level int"


def log(spark, rows):
    return spark.createDataFrame(rows, "session string, request_id long, second double").withColumn("at", F.timestamp_seconds(F.lit(1_760_000_000) + F.col("second"))).drop("second")


def kept(df):
    return sorted((r.session, r.request_id) for r in df.collect())


def test_settled_in_log_and_stream(spark, tmp_path):
    """Bursts, one exactly as long as the quiet time, equal times, a burst across slices, rows without session or time, a session with most rows."""
    rows = [("a", 1, 0.0), ("a", 2, 0.1), ("a", 3, 0.2), ("a", 4, 1.0), ("b", 5, 0.0), ("b", 6, 0.15), ("b", 7, 0.4), ("c", 8, 5.0), ("c", 9, 5.0), ("e", 20, 86399.9), ("e", 21, 86400.0)]
    rows += [("hot", 1000 + i, i * 0.1) for i in range(500)] + [(None, 30, 1.0), ("d", 31, None), ("d", None, 2.0)]
    want = [("a", 3), ("a", 4), ("b", 6), ("b", 7), ("c", 9), ("e", 21), ("hot", 1499)]
    df = log(spark, rows)
    got = requests.settled_log(df, "150 milliseconds", "1 second")
    assert kept(got.where("session <> 'd'")) == want and [tuple(r) for r in got.where("session = 'd'").select("request_id").collect()] == [(None,)]
    assert kept(requests.settled_log(df.limit(0), "150 milliseconds")) == []
    df.where("request_id is not null or session is null").repartition(1).write.parquet(str(tmp_path / "in"))
    log(spark, [("end", 99, 200_000.0)]).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=os.path.getmtime)
    for i, f in enumerate(files):
        os.utime(f, (1_760_000_000 + i, 1_760_000_000 + i))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = requests.settled(stream, "150 milliseconds", "1 second")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
    assert kept(spark.read.schema(out.schema).parquet(str(tmp_path / "out"))) == want  # ``end`` itself hasn't settled yet


PLACES = [(i, {}, i % 360 - 180.0, i * 7 % 180 - 90.0, i % 6, None, None) for i in range(1500)] + [(1500 + i, {}, 3.0, 3.0, 2, None, None) for i in range(700)] + [(3000, {}, None, None, 0, None, None)]


def brute(view):
    s, r, x0, y0, x1, y1, level = view
    if None in view[2:]:
        return 0
    return sum(p[2] is not None and y0 <= p[3] <= y1 and p[4] <= level and (x0 <= p[2] <= x1 if x0 <= x1 else p[2] >= x0 or p[2] <= x1) for p in PLACES)


VIEWS = [
    ("a", 1, -180.0, -90.0, 180.0, 90.0, 16), ("a", 2, 2.5, 2.5, 3.5, 3.5, 5), ("b", 1, 170.0, -90.0, -170.0, 90.0, 3), ("b", 1, 170.0, -90.0, -170.0, 90.0, 3), ("b", 2, 3.0, 3.0, 3.0, 3.0, 1),
    ("c", 1, None, 0.0, 1.0, 1.0, 3), ("c", 2, 0.0, 0.0, 1.0, 1.0, None), (None, 3, -50.0, -50.0, 50.0, 50.0, 2), ("d", None, 10.0, 10.0, 10.5, 10.5, 0), ("e", 9, -180.0, -5.0, 180.0, 5.0, 16),
]


def test_many_views_are_counted_by_row_groups(spark, tmp_path):
    out = str(tmp_path / "tiers")
    tiered.write_tiered(points(spark, PLACES), out, file_rows=500, group_rows=40)
    asked = spark.createDataFrame(VIEWS, ASKED)
    got = sorted(map(tuple, tiered.count_views(spark, out, asked.withColumn("n", F.lit(1)).withColumn("whole", F.lit(1)), 1000).collect()), key=repr)
    want = sorted(((v[0], v[1], v[6], min(brute(v), 1000), brute(v) >= 1000) for v in VIEWS), key=repr)
    assert got == want and tiered.count_views(spark, out, asked.limit(0), 5).count() == 0
    tiered.write_tiered(points(spark, []), str(tmp_path / "none"))
    assert {r["count"] for r in tiered.count_views(spark, str(tmp_path / "none"), asked, 5).collect()} == {0}


def test_of_waiting_views_the_latest_is_answered(spark, tmp_path):
    """Two arrivals; the second run starts from the checkpoint and answers what is new only."""
    tiers = str(tmp_path / "tiers")
    tiered.write_tiered(points(spark, PLACES), tiers, file_rows=500, group_rows=40)

    def arrive(rows):
        spark.createDataFrame(rows, ASKED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(ASKED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        requests.answer_views(stream, tiers, str(tmp_path / "out"), str(tmp_path / "cp"), 10_000).awaitTermination(180)
        return {(r.batch, r.session, r.request_id): r["count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    box = lambda s, r, w: (s, r, -w, -w, w, w, 16)
    arrive([box("a", 1, 5.0), box("a", 2, 20.0), box("a", 3, 9.0), box("b", 1, 4.0), (None, 5, 0.0, 0.0, 1.0, 1.0, 1)])
    first = {(0, "a", 3): brute(box("a", 3, 9.0)), (0, "b", 1): brute(box("b", 1, 4.0))}
    assert run() == first
    arrive([box("a", 4, 30.0), box("a", 5, 1.0)])
    assert run() == first | {(1, "a", 5): brute(box("a", 5, 1.0))}
    assert requests.latest(spark.createDataFrame([box("a", 1, 1.0)], ASKED).limit(0)).count() == 0


def test_lenses_as_a_column(spark):
    rows = ["  ｃａｆé　ﬁne.。 ", "", None, "a\n\t b..", "。", "①Ⅷ"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").coalesce(1).select(text.normalised_lens("t"), "i").orderBy("i").collect()]
    assert got == ["café fine", "", None, "a b", "", "1VIII"] == [t if t is None else text.normalise_lens(t) for t in rows]
