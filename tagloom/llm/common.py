"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word and line rules: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go where ``spark.checkpoint.dir`` says. Where it is unset, a single machine (tests) gets a temporary folder; a cluster is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tagloom-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder: lineage ends here, and a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else. Pure ASCII text takes the quick ``lower``; other text goes letter by letter."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def n_words(c: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def row_key(id_col: Column, text: Column) -> list[Column]:
    """128 bits that tell rows apart by id and text; nulls are values like any other."""
    i, t = F.coalesce(id_col.cast("string"), F.lit("\x00")), F.coalesce(text, F.lit(""))
    return [F.xxhash64(i, t).alias("_k1"), F.xxhash64(F.lit("k2"), t, i).alias("_k2")]


def pick(df: DataFrame, **cols: str | None) -> DataFrame:
    """Only the named columns under fixed names, so that no other column of the input can clash; None gives null."""
    lower = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{lower[c.lower()]}`") if c and c.lower() in lower else F.lit(None).cast("string")).alias(name) for name, c in cols.items()])


#: A key that holds more than one of so many rows is hot; there are fewer hot keys than this.
HOT = 1000


def join_hot(rows: DataFrame, table: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) with ``table``, which has one row for each key; nulls are keys like any other.

    Keys that hold over a ``HOT``-th of the rows, of which there are less than ``HOT``, are broadcast with what the table has for them, so that none of
    them meets in one task; the rows of the others are shuffled. Both sides are read more than once, so they should be written.
    """
    total = rows.count()
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") * HOT > total).select(*keys)
    h, t = [f"_h{i}" for i in range(len(keys))], [f"_t{i}" for i in range(len(keys))]
    hot = F.broadcast(rows.sparkSession.createDataFrame(counted.collect(), counted.schema).toDF(*h))  # less than HOT keys

    def same(df: DataFrame, names) -> Column:
        out = F.lit(True)
        for k, x in zip(keys, names, strict=True):
            out = out & df[k].eqNullSafe(F.col(x))
        return out

    named = lambda df: df.select(*[F.col(k).alias(x) for k, x in zip(keys, t, strict=True)], *[c for c in df.columns if c not in keys])
    many = rows.join(hot, same(rows, h), "left_anti")
    hots = rows.join(hot, same(rows, h), "left_semi")
    few = F.broadcast(named(table.join(hot, same(table, h), "left_semi")))
    return many.join(named(table).hint("merge"), same(many, t), how).drop(*t).unionByName(hots.join(few, same(hots, t), how).drop(*t))


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with the 0-based rank in the given order, without one task seeing all rows.

    The rows are range-sorted and written; each partition numbers its own rows, and the
    partitions' sizes (a row for each partition) give the offsets.
    """
    done = cut(df.orderBy(*order)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    sizes = sorted((r["p"], r["n"]) for r in done.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for p, n in sizes:
        starts[p], total = total, total + n
    offsets = df.sparkSession.createDataFrame([(int(p), int(s)) for p, s in starts.items()] or [(0, 0)], "_p long, _start long")
    return done.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_start", "_at")
