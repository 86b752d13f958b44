"""Points seen through a lens: evaluations folded onto points, and their styles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.style import mix_colour, opacity_for, radius_for, top_choice
from ..model import CHOICES, LENS_MIN_ZOOM, OPACITY_BASE, RADIUS_BASE, UNEVALUATED
from .distribute import HOT, cut, join_hot


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with 128 bits, ``_k1, _k2``, of its ``tag_ids``."""
    return df.withColumn("_k1", F.xxhash64("tag_ids")).withColumn("_k2", F.xxhash64(F.lit("k2"), "tag_ids"))


def fold(tag_lists: DataFrame, evals: DataFrame) -> DataFrame:
    """``_k1, _k2, total, evaluated, score, choice`` of each different tag list.

    ``evals`` has ``tag_id, confidence, score, choice``, all but the id nullable. A tag weighs as its
    confidence; where that is missing, as the mean confidence of the list's other tags. If no
    confidence is above 0, tags weigh alike. Scores and choices are averaged apart, each over the
    tags that have one. A weighted mean doesn't change with the unit of its weights, so weights
    need no normalising by the list's maximum, and all of it is one aggregate of plain sums. Lists
    are told apart by 128 bits, ``_k1, _k2``, which are what is shuffled and joined by; ``tag_lists`` with these keys
    has each list once. Tags that many lists have meet their evaluations in a broadcast.
    """
    lists = tag_lists if "_k1" in tag_lists.columns else keyed(tag_lists.select("tag_ids")).dropDuplicates(["_k1", "_k2"])
    item = lists.select("_k1", "_k2", F.explode_outer("tag_ids").alias("tag_id"))
    j = join_hot(item, evals.select("tag_id", "confidence", "score", "choice"), "tag_id", how="left")
    c, s = F.col("confidence"), F.col("score")
    n = len(CHOICES)
    ch = [F.coalesce(F.element_at("choice", i + 1), F.lit(0.0)) for i in range(n)]
    sums = {"v": [s.isNotNull(), s], **{f"c{i}": [F.col("choice").isNotNull(), ch[i]] for i in range(n)}}
    agg = [
        F.count("tag_id").alias("total"),
        F.count_if(s.isNotNull() | F.col("choice").isNotNull()).alias("evaluated"),
        F.max(c).alias("top"), F.avg(c).alias("mean"),
    ]
    for name, (has, value) in sums.items():
        agg += [F.sum(F.when(has, c * value)).alias(f"{name}_w"), F.sum(F.when(has & c.isNull(), value)).alias(f"{name}_0"), F.sum(F.when(has, value)).alias(f"{name}_1")]
    for name, has in (("v", s.isNotNull()), ("c", F.col("choice").isNotNull())):
        agg += [F.sum(F.when(has, c)).alias(f"{name}_cw"), F.count_if(has & c.isNull()).alias(f"{name}_c0"), F.count_if(has).alias(f"{name}_c1")]
    a = j.groupBy("_k1", "_k2").agg(*agg)
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    weighted = F.coalesce(F.col("top"), F.lit(0.0)) > 0

    def mean(name, group):
        by = F.when(weighted, zero(f"{group}_cw") + F.col("mean") * F.col(f"{group}_c0")).otherwise(F.col(f"{group}_c1"))
        value = F.when(weighted, zero(f"{name}_w") + F.col("mean") * zero(f"{name}_0")).otherwise(zero(f"{name}_1"))
        return F.when(by > 0, value / by)

    choice = [mean(f"c{i}", "c") for i in range(n)]
    return a.select("_k1", "_k2", "total", "evaluated", mean("v", "v").alias("score"), F.when(choice[0].isNotNull(), F.array(*choice)).alias("choice"))


def style(folded: DataFrame) -> DataFrame:
    """State, radius, opacity and colour of each tag list."""
    none = F.col("evaluated") == 0
    state = F.when(none, "none").when(F.col("evaluated") == F.col("total"), "full").otherwise("partial")
    return folded.select(
        "_k1", "_k2", "total", "evaluated", state.alias("state"), F.when(~none, F.col("score")).alias("score"), F.when(~none, F.col("choice")).alias("choice"),
        F.when(none, RADIUS_BASE).otherwise(radius_for(F.col("score"))).alias("radius"),
        F.when(none, OPACITY_BASE).otherwise(opacity_for(F.col("score"))).alias("opacity"),
        F.when(none | F.col("choice").isNull(), UNEVALUATED).otherwise(mix_colour([F.element_at("choice", i + 1) for i in range(len(CHOICES))])).alias("color"),
    )


def list_counts(pois: DataFrame) -> DataFrame:
    """``_k1, _k2, tag_ids, n``: each different tag list and how many points have it."""
    return keyed(pois.select("tag_ids")).groupBy("_k1", "_k2").agg(F.first("tag_ids").alias("tag_ids"), F.count("*").alias("n"))


def style_pois(pois: DataFrame, evals: DataFrame, lens: str = "any", zoom: float = 14) -> DataFrame:
    """Points (``id, tag_ids``) with their styles; each different tag list is folded once.

    Below the lens's least zoom or with a blank lens every point is unevaluated.
    """
    if not lens.strip() or zoom < LENS_MIN_ZOOM:
        evals = evals.limit(0)
    lists = cut(list_counts(pois))
    return paint(pois, lists, cut(style(fold(lists, evals))))


def paint(pois: DataFrame, lists: DataFrame, styles: DataFrame) -> DataFrame:
    """Points with the styles of their lists (``list_counts``).

    Lists of over a ``HOT``-th of the points, less than ``HOT`` of them, are broadcast with their styles, so that
    their points aren't shuffled; those of others meet theirs in a shuffle.
    """
    points = keyed(pois.select("id", "tag_ids"))
    hot = lists.where(F.col("n") * HOT > (lists.agg(F.sum("n")).first()[0] or 0)).select("_k1", "_k2")
    few = F.broadcast(styles.join(F.broadcast(hot), ["_k1", "_k2"], "left_semi"))
    many = points.join(F.broadcast(hot), ["_k1", "_k2"], "left_anti").join(styles.hint("merge"), ["_k1", "_k2"])
    return points.join(few, ["_k1", "_k2"]).unionByName(many).drop("_k1", "_k2")


#: Folders of the index from tags to lists.
INDEX_PARTS = 64


class Repaint:
    """Styles of tag lists that are kept up to date: an answer folds only the lists that have its tag.

    ``folder`` holds the lists, dealt by their keys, an index from tags to the keys of their lists, dealt by tag, and a generation of styles for
    each delta. A delta reads the parts of the index that its tags are in, the parts of the lists that these name, and their lists' items;
    the points are not read.
    """

    def __init__(self, pois: DataFrame, folder: str):
        self.spark, self.folder, self.generation = pois.sparkSession, folder, 0
        part = F.pmod(F.col("_k1"), F.lit(INDEX_PARTS)).cast("int").alias("part")
        list_counts(pois).select("*", part).write.partitionBy("part").parquet(f"{folder}/lists")
        index = self.spark.read.parquet(f"{folder}/lists").select("_k1", "_k2", F.explode(F.array_distinct("tag_ids")).alias("tag_id"))
        index.select("*", self._part("tag_id")).repartition("part").write.partitionBy("part").parquet(f"{folder}/index")
        self.lists = self.spark.read.parquet(f"{folder}/lists")
        nothing = self.spark.createDataFrame([], "tag_id string, confidence double, score double, choice array<double>")
        self._write(style(fold(self.lists.drop("part"), nothing)))

    @staticmethod
    def _part(tag: str):
        return F.pmod(F.xxhash64(tag), F.lit(INDEX_PARTS)).cast("int").alias("part")

    def _write(self, styles: DataFrame) -> None:
        styles.withColumn("generation", F.lit(self.generation)).write.mode("append").parquet(f"{self.folder}/styles/{self.generation}")

    def affected(self, changed: DataFrame) -> DataFrame:
        """``_k1, _k2`` of the lists that have one of the changed tags (``tag_id``)."""
        tags = cut(changed.select("tag_id").distinct())
        parts = [r[0] for r in tags.select(self._part("tag_id")).distinct().collect()]  # INDEX_PARTS at most
        index = self.spark.read.parquet(f"{self.folder}/index").where(F.col("part").isin(parts or [-1]))
        return index.join(tags, "tag_id", "left_semi").select("_k1", "_k2").distinct()

    def update(self, changed: DataFrame, evals: DataFrame) -> int:
        """Folds the lists of the changed tags again, with all evaluations as they are now; how many lists these were."""
        keys = cut(self.affected(changed))
        parts = [r[0] for r in keys.select(F.pmod(F.col("_k1"), F.lit(INDEX_PARTS)).cast("int")).distinct().collect()]
        some = cut(self.lists.where(F.col("part").isin(parts or [-1])).drop("part").join(keys, ["_k1", "_k2"], "left_semi"))
        self.generation += 1
        self._write(style(fold(some, evals)))
        return some.count()

    def styles(self) -> DataFrame:
        """The latest style of each list."""
        all_ = self.spark.read.parquet(*[f"{self.folder}/styles/{g}" for g in range(self.generation + 1)])
        rest = [c for c in all_.columns if c not in ("_k1", "_k2", "generation")]
        return all_.groupBy("_k1", "_k2").agg(F.max_by(F.struct(*rest), "generation").alias("s")).select("_k1", "_k2", "s.*")

    def paint(self, pois: DataFrame) -> DataFrame:
        return paint(pois, self.lists.drop("part"), cut(self.styles()))


def tallies(styled: DataFrame) -> DataFrame:
    """Points by how far they are evaluated."""
    return styled.agg(
        F.count_if(F.col("state") != "none").alias("applied"), F.count_if(F.col("state") == "partial").alias("partial"),
        F.count_if((F.col("state") != "none") & F.col("choice").isNull()).alias("colourless"), F.count_if(F.col("state") == "none").alias("unevaluated"),
    )


def explain_poi(pois: DataFrame, evals: DataFrame, poi_id: int) -> DataFrame:
    """Each tag of one point with its score, choice and confidence."""
    one = pois.where(F.col("id") == poi_id).select("id", F.posexplode("tag_ids").alias("pos", "tag_id"))
    return one.join(evals, "tag_id", "left").select("id", "pos", "tag_id", "confidence", "score", top_choice(F.col("choice")).alias("top"))
