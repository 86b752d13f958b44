"""Dropping lines that many documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, SPACES, ascii_lower, cut, row_key


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_key_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (as the struct ``row``) with ``kept_text, n_lines, n_dropped``.

    A line's key is the line stripped of white space with A-Z lower-cased. Lines whose key has
    ``min_key_chars`` code points at least and is found in ``min_docs`` documents at least go
    everywhere; the others stay in order. Keys are counted by two 64-bit hashes. Only hashes and
    positions are grouped: the text itself is moved once, to meet the positions dropped from it.

    Null or empty text is one empty line, which has no key and stays. Rows with the same id and
    text are one document for counting, and each gets the same result; a null id is an id.
    An empty table gives no rows. All columns of the input are inside ``row``, so none can clash.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.struct("*").alias("row"), text.alias("t"), *row_key(F.col(f"`{id_col}`"), text))
    lines = base.select("_k1", "_k2", F.posexplode(F.split(ascii_lower(F.col("t")), "\n", -1)).alias("pos", "line"))
    lines = lines.select("_k1", "_k2", "pos", F.btrim("line", F.lit(SPACES)).alias("key")).where(F.length("key") >= min_key_chars)
    lines = lines.select("_k1", "_k2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("h2"), "key").alias("h2"))
    common = lines.groupBy("h1", "h2", "_k1", "_k2").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    common = cut(common)
    total = common.agg(F.sum("n")).first()[0] or 0
    # less than HOT keys are broadcast, so that a line that a third of all documents hold doesn't meet in one task; other keys hold a HOT-th of the lines at most
    hot = F.broadcast(common.where(F.col("n") * HOT > total).select("h1", "h2", F.lit(True).alias("hot")))
    lines = lines.join(hot, ["h1", "h2"], "left")
    own = [F.when(F.col("hot"), F.col(f"_k{i}")).otherwise(F.col(f"h{i}")).alias(f"j{i}") for i in (1, 2)]  # lines of hot keys are spread by document
    lines = lines.select("_k1", "_k2", "pos", "hot", *own).join(common.select(F.col("h1").alias("j1"), F.col("h2").alias("j2"), F.lit(True).alias("met")), ["j1", "j2"], "left")
    gone = lines.where("hot or met").groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    out = base.join(gone, ["_k1", "_k2"], "left").withColumn("lines", F.split("t", "\n", -1))
    ends = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
    # the runs of lines between one dropped line and the next
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size("gone") + 1), lambda i: F.slice("lines", F.element_at("ends", i) + 2, F.element_at("ends", i + 1) - F.element_at("ends", i) - 1)))
    out = out.withColumn("ends", F.when(F.col("gone").isNotNull(), ends))
    return out.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )
