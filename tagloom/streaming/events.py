"""Streams: evaluation events into the cache, stale results, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MAX_BATCHES
from ..sources.sinks import EvalCache

#: Lines of an evaluation's event log: start, result, error and done events.
EVENT_SCHEMA = "type string, request_id long, lens string, tag_id string, primitive string, num double, dist array<double>, model string, at timestamp, kind string, batch long"


def read_events(spark: SparkSession, folder: str, files: int | None = MAX_BATCHES) -> DataFrame:
    """Streamed JSON lines, ``files`` at most (None: all that are there) in a micro-batch; a last line without an end is read too, broken lines are null rows and left out."""
    stream = spark.readStream.schema(EVENT_SCHEMA)
    return (stream.option("maxFilesPerTrigger", files) if files else stream).json(folder).where("type is not null")


def current(events: DataFrame) -> DataFrame:
    """Without results of requests that a later request of the lens has replaced. For a batch, or each batch of a stream."""
    last = events.groupBy("lens").agg(F.max("request_id").alias("last"))
    return events.join(last, "lens").where("request_id = last").drop("last")


def replay_into_cache(events: DataFrame, cache: EvalCache, checkpoint: str):
    """Starts a query that upserts result events. Loads take the latest row, so a replayed batch changes nothing.

    Results that a later request in the same batch has replaced are left out; those of an earlier batch are overwritten.
    """

    def put(batch: DataFrame, _: int) -> None:
        rows = current(batch).where("type = 'result' and (num is not null or dist is not null)")
        cache.put(rows.select("lens", "tag_id", "primitive", "num", "dist", "model", "at"))

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failure_tally(events: DataFrame) -> DataFrame:
    """Failures by kind."""
    return events.where("type = 'error'").groupBy("kind").agg(F.count("*").alias("n"))


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """An extension beyond the lens pipelines: event counts and values in tumbling windows, late events dropped by watermark."""
    w = F.window("ts", size)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    n = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return n.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def windowed_batch(spark: SparkSession, sf_dir: str, size: str = "1 hour") -> DataFrame:
    """The windowed counts of the events table."""
    return windowed(spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value"), size=size)
