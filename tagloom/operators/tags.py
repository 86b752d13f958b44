"""Tags of points: extraction, counts and the allow-list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import point_inside
from ..functions.text import tag_ids, trim_all
from ..model import ALLOW_MIN, ALLOW_MIN_REGION, BRAND_KEYS, REGION, ROLES, UNKNOWN_VALUES


def with_tag_ids(pois: DataFrame, roles=ROLES) -> DataFrame:
    return pois.withColumn("tag_ids", F.coalesce(tag_ids(F.col("tags"), roles), F.array().cast("array<string>")))


def occurrences(pois: DataFrame, roles=ROLES) -> DataFrame:
    """A row ``id, pos, tag_id`` for each tag of each point, duplicates kept."""
    return with_tag_ids(pois, roles).select("id", F.posexplode("tag_ids").alias("pos", "tag_id"))


def allowed(occ: DataFrame, allowlist: DataFrame) -> DataFrame:
    return occ.join(allowlist.select("tag_id"), "tag_id", "left_semi")


def dropped(occ: DataFrame, allowlist: DataFrame) -> DataFrame:
    """``tag_id, n`` of the tags that the allow-list lacks."""
    return occ.join(allowlist.select("tag_id"), "tag_id", "left_anti").groupBy("tag_id").agg(F.count("*").alias("n"))


def tag_counts(occ: DataFrame) -> DataFrame:
    """Occurrences and, beside them, points of each tag."""
    return occ.groupBy("tag_id").agg(F.count("*").alias("count"), F.countDistinct("id").alias("pois"))


def role_of(tag_id):
    key = F.substring_index(tag_id, "=", 1)
    return F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), key)


def sample_names(pois: DataFrame, roles=ROLES, most: int = 3) -> DataFrame:
    """Up to ``most`` different names for each tag, the first by level and id; a Japanese name wins over the plain one.

    A name is exploded with the tags of its own row. Each name keeps its first place only, and ranks are cut within the group, so no list of all names is ever built.
    """
    named = with_tag_ids(pois, roles).select("id", "lod_level", F.coalesce(F.col("tags")["name:ja"], F.col("tags")["name"]).alias("name"), "tag_ids").where("name is not null")
    first = named.select("id", "lod_level", "name", F.explode("tag_ids").alias("tag_id")).groupBy("tag_id", "name").agg(F.min(F.struct("lod_level", "id")).alias("place"))
    w = Window.partitionBy("tag_id").orderBy("place", "name")
    top = first.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    return top.groupBy("tag_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]).alias("names"))


def viewport_summary(pois: DataFrame, occ: DataFrame, allowlist: DataFrame) -> DataFrame:
    """One row: points, points with an allowed tag, different allowed tags, different dropped tags."""
    flag = occ.join(allowlist.select("tag_id", F.lit(True).alias("ok")), "tag_id", "left")
    a = flag.agg(
        F.countDistinct(F.when(F.col("ok"), F.col("id"))).alias("pois_with_tags"),
        F.countDistinct(F.when(F.col("ok"), F.col("tag_id"))).alias("unique_tags"),
        F.countDistinct(F.when(F.col("ok").isNull(), F.col("tag_id"))).alias("dropped_by_allowlist"),
    )
    return pois.agg(F.count("*").alias("pois")).join(a)


def region_flag():
    return F.coalesce(point_inside(F.col("lon"), F.col("lat"), REGION), F.lit(False))


def parts(pois: DataFrame, keys, brands=BRAND_KEYS) -> DataFrame:
    """``key, value, jp`` after splitting; keys are cut from the map before it is exploded. A brand is one value, counted once."""
    e = pois.select(region_flag().alias("jp"), F.explode(F.map_filter("tags", lambda k, v: k.isin(*keys))).alias("key", "raw"))
    split = F.when(F.col("key").isin(*brands), F.array("raw")).otherwise(F.split(F.lower("raw"), ";", -1))
    return e.select("key", "jp", F.explode(F.transform(split, trim_all)).alias("value")).where("value <> ''")


def build_allowlist(pois: DataFrame, least: int = ALLOW_MIN, least_region: int = ALLOW_MIN_REGION, roles=ROLES) -> DataFrame:
    """``tag_id, key, value, count, count_jp`` of pairs that are frequent in the world or in the region; yes and no only as brands."""
    p = parts(pois, list(roles)).where(F.col("key").isin(*BRAND_KEYS) | ~F.col("value").isin(*UNKNOWN_VALUES))
    n = p.groupBy("key", "value").agg(F.count("*").alias("count"), F.count_if("jp").alias("count_jp"))
    n = n.where((F.col("count") >= least) | (F.col("count_jp") >= least_region))
    return n.select(F.concat("key", F.lit("="), "value").alias("tag_id"), "key", "value", "count", "count_jp")


def allowlist_coverage(pois: DataFrame, allowlist: DataFrame, roles=ROLES) -> DataFrame:
    """``key, role, pairs, occurrences_total, coverage`` for every key of the policy."""
    spark = pois.sparkSession
    policy = spark.createDataFrame(list(roles.items()), "key string, role string")
    total = pois.select(F.explode(F.map_filter("tags", lambda k, v: k.isin(*roles))).alias("key", "value")).groupBy("key").agg(F.count("*").alias("total"))
    got = allowlist.groupBy("key").agg(F.count("*").alias("pairs"), F.sum("count").alias("covered"))
    j = policy.join(total, "key", "left").join(got, "key", "left")
    share = F.least(F.lit(1.0), F.coalesce(F.col("covered"), F.lit(0)) / F.col("total"))
    return j.select("key", "role", F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"), F.coalesce("total", F.lit(0)).cast("long").alias("occurrences_total"), F.round(F.when(F.col("total") > 0, share).otherwise(0.0), 6).alias("coverage"))


def described(tags: DataFrame, descriptions: DataFrame) -> DataFrame:
    """``tag_id, description``: the Japanese text, else the English, else the id."""
    j = tags.select("tag_id").join(descriptions.select("tag_id", "ja", "en"), "tag_id", "left")
    return j.select("tag_id", F.coalesce("ja", "en", "tag_id").alias("description"))


def display_order(counts: DataFrame) -> DataFrame:
    """Most frequent first, ties by the Unicode collation of the id."""
    return counts.orderBy(F.desc("count"), F.collate("tag_id", "UNICODE"), "tag_id")


def viewport_document(summary: DataFrame, counts: DataFrame, names: DataFrame, dropped_top: DataFrame, bbox, max_level: int) -> DataFrame:
    """One JSON document of a viewport's tags; a viewport's different tags are bounded by the allow-list."""
    t = counts.join(names, "tag_id", "left").select("tag_id", F.substring_index("tag_id", "=", 1).alias("key"), F.expr("substring(tag_id, instr(tag_id, '=') + 1)").alias("value"), "count", role_of(F.col("tag_id")).alias("role"), F.coalesce("names", F.array().cast("array<string>")).alias("sample_names"))
    t = t.agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("o"), *t.columns))).alias("tags"))
    d = dropped_top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "tag_id", "n"))).alias("dropped_top"))
    doc = F.struct(F.array(*map(F.lit, bbox)).alias("bbox"), F.lit(max_level).alias("max_level"), *summary.columns, F.transform("tags", lambda x: x.dropFields("o")).alias("tags"), F.transform("dropped_top", lambda x: x.dropFields("o")).alias("dropped_top"))
    return summary.join(t).join(d).select(F.to_json(doc).alias("document"))
