"""Requests of a lens in a stream: keyed state that drops what a later request has replaced, and an evaluator that asks each request once."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import evaluate
from ..sources import tiered
from ..sources.sinks import EvalCache

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of a lens's results in the state, so that one lens that has most of them isn't one task.
PARTS = 16


class Newest(StatefulProcessor):
    """For each lens and part the highest request that has started; passes on the results of that request or a later one.

    ``idle_ms`` after the last event of a lens, by event time, its state ends. ``columns`` are those that are passed on.
    """

    def __init__(self, columns: list[str], idle_ms: int):
        self.columns, self.idle_ms = columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "request_id long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = self.newest.get() if self.newest.exists() else None
        newest, until = had or (None, -1)
        held, latest = [], until
        for f in rows:  # a start anywhere in the micro-batch counts for all its results
            started = f.loc[f["type"] == "start", "request_id"].max()
            if pd.notna(started):
                newest = int(started) if newest is None else max(newest, int(started))
            seen = f["at"].max()
            if pd.notna(seen):
                latest = max(latest, int(pd.Timestamp(seen).timestamp() * 1000) + self.idle_ms)
            held.append(f[f["type"] == "result"])
        if latest > until:
            if until >= 0:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(latest)
        self.newest.update((newest if newest is not None else -1, latest))
        for f in held:
            f = f if newest is None else f[f["request_id"] >= newest]
            if len(f):
                yield f[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest_results(events: DataFrame, late: str = "1 hour", idle_ms: int = 3_600_000, parts: int = PARTS) -> DataFrame:
    """The result events of a stream that no later request had replaced when they arrived.

    A request of a lens is replaced when a ``start`` event of a later one (``request_id``) arrives, in the same micro-batch or
    before, however long ago: the state is kept across micro-batches and restarts. Results of a lens are dealt to ``parts`` by their
    tag, and starts go to each of them. A lens without events for ``idle_ms`` of event time (``at``) loses its state; what comes
    later than ``late`` behind the stream is dropped as late. Events without lens, request or time are dropped. A result without any
    start counts.
    """
    e = events.where("lens is not null and request_id is not null and at is not null and type in ('start', 'result')")
    part = F.when(F.col("type") == "start", F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.pmod(F.xxhash64("tag_id"), F.lit(parts)).cast("int")))
    columns = [c for c in events.columns if c != "type"]
    kinds = dict(events.dtypes)
    e = e.withColumn("part", F.explode(part)).withWatermark("at", late)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return e.groupBy("lens", "part").transformWithStateInPandas(Newest(columns, idle_ms), ddl, "append", "eventTime")


def with_state_store(spark: SparkSession, start: Callable):
    """``start()`` with the state store that keyed state needs; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        return start()
    finally:
        spark.conf.set(name, had) if had else spark.conf.unset(name)


def results_into_cache(events: DataFrame, cache: EvalCache, checkpoint: str, **options):
    """Starts a query that puts what ``newest_results`` passes on into the cache, whatever micro-batch it arrives in.

    A micro-batch that is written again after a restart changes nothing, as loads take one row for each key.
    """
    rows = newest_results(events, **options).where("num is not null or dist is not null")

    def put(batch: DataFrame, _: int) -> None:
        if not cache.put(batch.select("lens", "tag_id", "primitive", "num", "dist", "model", "at")):
            raise OSError("the cache couldn't be written")  # the micro-batch comes again

    start = lambda: rows.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return with_state_store(events.sparkSession, start)


# --- the evaluator as a stream of requests --------------------------------------------------------------

PLAN = "batch long, request int, primitive string, first long, tags array<string>"


def write_plan(plan: DataFrame, path: str, slice_: int = 200) -> None:
    """A plan as the source of a stream: a file for each request group. A task writes the files of ``slice_`` groups one after another, and
    slices follow each other, so the stream, which reads the oldest first, takes groups in their order."""
    last = plan.agg(F.max("request")).first()[0]
    for low in range(0, -1 if last is None else last + 1, slice_):
        some = plan.where(F.col("request").between(low, low + slice_ - 1)).select("batch", "primitive", "first", "tags", "request")
        some.coalesce(1).sortWithinPartitions("request", "batch").write.mode("append").partitionBy("request").parquet(path)


def evaluate_stream(spark: SparkSession, plan: str, lens: str, client: evaluate.Client, out: str, checkpoint: str, concurrency: int = 2, sleep=time.sleep):
    """Starts a query over a written plan: a micro-batch for each file of a request group, asked by ``evaluate.ask_once`` into ``out``.

    Answers are readable while the rest is still asked. A restart from ``checkpoint`` goes on where it stopped and asks nothing
    again that has an answer.
    """
    lens = evaluate.validate(lens, evaluate.PRIMITIVES)

    def ask(batch: DataFrame, _: int) -> None:
        evaluate.ask_once(batch, lens, client, out, concurrency, sleep)

    stream = spark.readStream.schema(PLAN).option("maxFilesPerTrigger", 1).parquet(plan)
    return stream.writeStream.foreachBatch(ask).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- views of sessions --------------------------------------------------------------------------------


def latest(requests: DataFrame) -> DataFrame:
    """The request with the highest ``request_id`` of each ``session``; those without either are left out. Partial maxima before the shuffle keep a busy session small."""
    columns = F.struct(*requests.columns)
    r = requests.where("session is not null and request_id is not null").groupBy("session").agg(F.max_by(columns, "request_id").alias("r"))
    return r.select("r.*")


def answer_views(requests: DataFrame, tiers: str, out: str, checkpoint: str, cap: int):
    """Starts a query that answers views of a stream of requests (``session, request_id, x0, y0, x1, y1, max_level``) from tiered files.

    While a micro-batch is answered the requests that arrive wait, and of those only the latest of each session is asked. Answers of a
    micro-batch are a folder of ``out`` by its id, written anew when it comes again after a restart.
    """

    def answer(batch: DataFrame, n: int) -> None:
        rows = tiered.count_views(batch.sparkSession, tiers, latest(batch), cap)
        rows.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(requests: DataFrame, quiet: str, late: str = "1 minute") -> DataFrame:
    """Of a stream of requests (``session, request_id, at``) those that no other of the session follows within ``quiet``: ``session, request_id, at``.

    The last of each burst (of two at the same time the higher id), when the stream's time is ``late`` beyond its end. Requests without session or
    time are left out.
    """
    r = requests.where("session is not null and at is not null").withWatermark("at", late)
    last = F.max(F.struct("at", "request_id")).alias("r")
    return r.groupBy("session", F.session_window("at", quiet)).agg(last).select("session", "r.request_id", "r.at")


def settled_log(requests: DataFrame, quiet: str, slice_: str = "1 day") -> DataFrame:
    """``settled`` over a whole log. A session is looked at in slices of time, so that a busy one isn't one task; the last request of a slice meets the first of the session's next one, which is a row a slice."""
    r = requests.where("session is not null and at is not null").select("session", "request_id", "at", F.window("at", slice_)["start"].alias("slice"))
    own = Window.partitionBy("session", "slice").orderBy("at", F.col("request_id").asc_nulls_first())
    r = r.withColumn("follows", F.lead("at").over(own))
    firsts = r.groupBy("session", "slice").agg(F.min("at").alias("first"))
    firsts = firsts.select("session", "slice", F.lead("first").over(Window.partitionBy("session").orderBy("slice")).alias("beyond"))
    ends = r.where("follows is null").join(firsts, ["session", "slice"]).withColumn("follows", F.col("beyond")).drop("beyond")
    done = r.where("follows is not null").unionByName(ends).where(f"follows is null or follows > at + interval {quiet}")
    return done.select("session", "request_id", "at")
