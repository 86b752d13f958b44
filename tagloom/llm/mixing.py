"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, global_rank, join_hot, n_words, pick, row_key

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``, as doubles.

    Sources are numbered by code point, null last, and weigh as ``weights`` repeating. ``share``
    times all sizes is dealt out by weight; a target stops at ``most`` times its source's size,
    and the excess is dealt to the rest until none is above. Each round is one aggregate over the
    sources; only its two sums come to the driver.
    """
    t = global_rank(sizes, F.col("source").asc_nulls_last())
    t = t.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    t = cut(t.select("source", "source_size", "w", (F.col("source_size") * float(most)).alias("cap")))
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level, seen = 0.0, -1
    while True:
        full = F.col("cap") < F.col("w") * level if seen >= 0 else F.lit(False)
        r = t.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)), F.count(F.when(full, 1))).first()
        if r[2] == seen or not r[1]:
            break
        level, seen = (share * total - r[0]) / r[1], r[2]
    return t.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def queue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Each document with ``doc_id, source, size, source_size, target, taken``, its place ``key`` and its row's keys ``_k1, _k2``.

    Documents are shuffled by md5 of the seed and their id, or of their text where they have none. A copy's virtual finish time is the
    words its source has sent up to and with it, divided by the source's target; copies of a
    second pass follow the first. All copies are range-sorted by finish time, and the longest
    prefix within the total budget is taken. Whole documents only, so a source is off its target
    by less than one of its documents.

    The running sums go by source and 4096 ranges of the shuffled key, so a source that holds a
    third of all rows is spread over many tasks, and so are rows without ids. Null text is empty (size 0, nothing taken); null
    sources are a source of their own, the last. Repeated rows are
    queued as rows of their own, and equal places are taken or left together. An empty table
    gives no rows. Other columns are not read.
    """
    t = pick(docs, id=id_col, text=text_col, source=source_col)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))))
    base = cut(t.select("id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), *row_key(F.col("id"), F.col("text"))))
    per = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, float(most))
    part = F.substring("key", 1, 3)
    sums = base.groupBy("source", part.alias("part")).agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
    sums = sums.join(per, sums.source.eqNullSafe(per.source)).select(sums.source.alias("s"), "part", "before", "source_size", "target")
    own = Window.partitionBy("source", "part").orderBy("key", "size", "id", "_k1").rowsBetween(Window.unboundedPreceding, 0)
    run = base.withColumn("part", part).withColumn("run", F.sum("size").over(own))
    run = run.join(sums, run.source.eqNullSafe(sums.s) & (run.part == sums.part))
    run = cut(run.select("id", "source", "size", "source_size", "target", "key", "_k1", "_k2", (F.col("run") + F.col("before")).alias("sent")))

    def finish(k: int | Column) -> Column:
        return F.when(F.col("target") > 0, (F.col("sent") + F.col("source_size") * k) / F.col("target"))

    copies = run.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).select(finish(F.col("copy")).alias("v"), "key", "size")
    copies = cut(copies.where("v is not null").orderBy("v", "key", "size")).withColumn("p", F.spark_partition_id())
    budget = share * (base.agg(F.sum("size")).first()[0] or 0)
    sizes, last, spent = sorted((r["p"], r["s"]) for r in copies.groupBy("p").agg(F.sum("size").alias("s")).collect()), None, 0
    for p, s in sizes:
        if spent + s > budget:
            last = p
            break
        spent += s
    taken = F.lit(0)
    if last is None:
        end = None  # all of it is within the budget
    else:
        w = Window.partitionBy("p").orderBy("v", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
        cutoff = copies.where(F.col("p") == last).withColumn("run", F.sum("size").over(w)).where(F.col("run") + spent > budget)
        end = cutoff.agg(F.min(F.struct("v", "key", "size"))).first()[0]
    for k in range(most):
        here = F.struct(finish(k).alias("v"), F.col("key"), F.col("size"))
        inside = F.lit(True) if end is None else here < F.struct(F.lit(end["v"]).alias("v"), F.lit(end["key"]).alias("key"), F.lit(end["size"]).cast("long").alias("size"))
        taken = taken + F.when((F.col("size") > 0) & finish(k).isNotNull() & inside, F.col("size")).otherwise(0)
    return run.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "key", "_k1", "_k2")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows that ``queue`` takes, as the struct ``row``, each as often as it is taken.

    Rows are told apart by id, text and source. Rows that repeat in all three share what they are given: as often each, and the
    first of them once more, in the order of the whole rows. So the words given are those that the queue takes.
    """
    mixed = cut(queue(docs, id_col, text_col, source_col, **options).select("_k1", "_k2", F.col("source").alias("_s"), F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("long").alias("times")))
    keys = ("_k1", "_k2", "_s")
    per = cut(mixed.groupBy(*keys).agg(F.count("*").alias("_rows"), F.sum("times").alias("_times")).where("_times > 0"))
    d = docs.select(F.struct("*").alias("row"), *row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.col(f"`{source_col}`").alias("_s"))

    t = per.select(*[F.col(k).alias(f"{k}t") for k in keys], "_rows", "_times")
    d = d.join(t.hint("merge"), (d._k1 == t._k1t) & (d._k2 == t._k2t) & d._s.eqNullSafe(t._st))  # a key is one row of the documents, or as many as repeat
    copies = lambda df, n: df.select("row", F.explode(F.sequence(F.lit(1).cast("long"), n))).select("row")
    out = copies(d.where("_rows = 1"), F.col("_times"))
    if not per.where("_rows > 1").isEmpty():
        again = d.where("_rows > 1").select("row", *keys, "_rows", "_times").withColumn("_place", F.monotonically_increasing_id())
        again = cut(global_rank(again, F.col("_k1"), F.col("_k2"), F.col("_s"), F.xxhash64("row"), F.col("_place"), name="_rank"))
        again = join_hot(again, again.groupBy(*keys).agg(F.min("_rank").alias("_first")), *keys)
        times = F.expr("_times div _rows") + (F.col("_rank") - F.col("_first") < F.col("_times") % F.col("_rows")).cast("long")
        out = out.unionByName(copies(again.withColumn("_times", times).where("_times > 0"), F.col("_times")))
    return out
