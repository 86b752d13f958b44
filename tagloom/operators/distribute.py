"""Operations on all rows that no single task sees: ranks and running sums in a global order, joins with hot keys, cut lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_folder

#: A key that more than one of so many rows has is hot; there are fewer hot keys than this.
HOT = 1000
_ROW = (1 << 33) - 1


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, where its lineage ends."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _sorted(df: DataFrame, order: tuple[Column, ...]) -> DataFrame:
    """``df`` range-sorted and written, with the partition ``_p`` and the place in it, ``_at``."""
    done = cut(df.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    return done.select(*df.columns, F.shiftright("_id", 33).cast("int").alias("_p"), F.col("_id").bitwiseAND(_ROW).alias("_at"))


def _offsets(done: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``_p`` and for each sum what the partitions before it hold: a row for each partition."""
    rows = sorted(done.groupBy("_p").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in sums.items()]).collect())
    total, out = [0] * len(sums), []
    for p, *own in rows:
        out.append((p, *total))
        total = [a + b for a, b in zip(total, own, strict=True)]
    return F.broadcast(done.sparkSession.createDataFrame(out, "_p int, " + ", ".join(f"_{n} long" for n in sums)))


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with the 0-based rank in a global order: each partition of the range sort counts its rows, and what stands before it is added."""
    done = _sorted(df, order)
    return done.join(_offsets(done, {"rows": F.lit(1)}), "_p").withColumn(name, F.col("_rows") + F.col("_at")).drop("_p", "_at", "_rows")


def running_sum(df: DataFrame, value: Column, *order: Column, name: str = "upto") -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row in a global order. Windows see one partition of the range sort each."""
    done = _sorted(df, order)
    own = F.sum(value).over(Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return done.withColumn(name, own).join(_offsets(done, {"sum": value}), "_p").withColumn(name, F.col(name) + F.col("_sum")).drop("_p", "_at", "_sum")


def join_hot(rows: DataFrame, table: DataFrame, *keys: str, how: str = "inner", hot_share: int = HOT, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) with ``table``, which has one row for each key at most; null keys meet nothing.

    Keys that hold over a ``hot_share``-th of the rows are broadcast with what the table has for them: they are fewer than ``hot_share``.
    The rows of other keys are shuffled. ``rows`` is read more than once; ``counts`` has the number ``n`` of rows of each key, where that is known.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    total = rows.count() if counts is None else counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = counted.where(F.col("n") * hot_share > total).select(*keys)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found.collect(), found.schema))  # fewer than ``hot_share``
    few = F.broadcast(table.join(hot, list(keys), "left_semi"))
    known = rows.join(hot, list(keys), "left_semi").join(few, list(keys), how)
    return known.unionByName(rows.join(hot, list(keys), "left_anti").join(table.hint("merge"), list(keys), how))


def smallest(df: DataFrame, n: int, key: str, *ties: Column, bits: int = 60, step: int = 12, few: int = 100_000) -> DataFrame:
    """Exactly the ``n`` rows (or all) with the smallest ``key``, a number of ``bits`` bits; ties go by ``ties``.

    Each round counts the values of the next ``step`` bits below the prefix that holds the ``n``-th row, until ``few`` rows share it. Only those are
    sorted; all before them are taken as they are. ``df`` is read for each round and should be written.
    """
    if df.count() <= n:
        return df
    shift, prefix, left = bits, 0, n
    while shift > 0:
        here = df.where(F.shiftright(key, shift) == prefix) if shift < bits else df
        shift -= step
        digit = F.shiftright(key, shift).bitwiseAND((1 << step) - 1)
        counts = sorted((r["digit"], r["count"]) for r in here.groupBy(digit.alias("digit")).count().collect())  # 2 ** step numbers at most
        for d, c in counts:
            if left <= c:
                prefix = prefix << step | d
                break
            left -= c
        if c <= few:
            break
    return df.where(F.shiftright(key, shift) < prefix).unionByName(df.where(F.shiftright(key, shift) == prefix).orderBy(key, *ties).limit(left))
