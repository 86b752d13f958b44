"""A part of a log may be several files and still is one micro-batch."""

from tagloom.streaming import events


def test_all_files_are_one_micro_batch(spark, tmp_path):
    spark.range(8).selectExpr("'start' AS type", "id AS request_id").repartition(4).write.json(f"{tmp_path}/in")
    seen = []
    stream = events.read_events(spark, f"{tmp_path}/in", None)
    stream.writeStream.foreachBatch(lambda b, n: seen.append(b.count())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert seen == [8]
