"""Corpus profile: rows, keys, values, levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import point_inside
from ..functions.text import VALUE_CLASSES, key_group, trim_all
from ..model import EXPAND_MAX_DISTINCT, PRIMARY_KEYS, REGION, TOP_VALUES
from .distribute import cut, join_hot, smallest

COVERAGE_POINTS = (10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000)


def rows(pois: DataFrame) -> DataFrame:
    """Points with the number of their tags; a null map has none."""
    return pois.select("id", F.coalesce(F.size("tags"), F.lit(0)).alias("ntags"), "lod_level", "lon", "lat", F.col("tags")["name"].isNotNull().alias("has_name"), "tags")


def pairs(pois: DataFrame) -> DataFrame:
    return pois.select("id", "lod_level", F.explode("tags").alias("key", "value"))


def row_stats(pois: DataFrame) -> DataFrame:
    """One scan for counts, quantiles of the tag count, and extent."""
    q = lambda p: F.percentile("ntags", F.lit(p))
    return rows(pois).agg(
        F.count("*").alias("rows"), F.count_if("has_name").alias("rows_with_name"), F.count_if(F.col("ntags") == 0).alias("rows_empty_tags"),
        F.count_if(point_inside(F.col("lon"), F.col("lat"), REGION)).alias("rows_in_region"),
        F.min("ntags").alias("min"), *[F.round(q(p), 6).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75, 0.95, 0.99)], F.max("ntags").alias("max"), F.round(F.avg("ntags"), 6).alias("mean"),
        F.min("lon").alias("xmin"), F.min("lat").alias("ymin"), F.max("lon").alias("xmax"), F.max("lat").alias("ymax"),
    )


def tags_per_row(pois: DataFrame) -> DataFrame:
    return rows(pois).groupBy("ntags").agg(F.count("*").alias("rows"))


def geo_grid(pois: DataFrame, degrees: float = 10.0) -> DataFrame:
    cell = lambda c: (F.floor(F.col(c) / degrees) * degrees).cast("double")
    return pois.groupBy(cell("lon").alias("lon10"), cell("lat").alias("lat10")).agg(F.count("*").alias("rows"))


def levels(pois: DataFrame) -> DataFrame:
    return rows(pois).groupBy("lod_level").agg(F.count("*").alias("rows"), F.round(F.avg("ntags"), 6).alias("mean_tags"), F.round(F.avg(F.col("has_name").cast("int")), 6).alias("name_ratio"))


def pair_levels(pois: DataFrame) -> DataFrame:
    """``key, value, lod_level, n``: each different pair by level. What the profile of keys and pairs needs of the corpus, and far fewer rows."""
    return pairs(pois).groupBy("key", "value", "lod_level").agg(F.count("*").alias("n"))


def key_profile(levels: DataFrame, exact: bool = True) -> DataFrame:
    """All measures of each key from ``pair_levels``; ``exact`` counts different values exactly, else by HyperLogLog. Patterns are tried once on each different value, not on each occurrence."""
    v, c = F.col("value"), F.col("c")
    size = F.length(v)
    has = lambda test: F.coalesce(F.sum(F.when(test, c)), F.lit(0))
    values = levels.groupBy("key", "value").agg(F.sum("n").alias("c"))
    by_value = values.groupBy("key").agg(
        F.sum("c").alias("n"), (F.count(v) if exact else F.approx_count_distinct(v)).alias("nd"),
        F.round(F.sum(size * c) / F.sum(F.when(v.isNotNull(), c)), 6).alias("avg_len"), F.percentile(size, F.lit(0.5), c).alias("med_len"), F.max(size).alias("max_len"),
        has(v.contains(";")).alias("multi_semicolon"), has(v.isin("yes", "no")).alias("yes_no"), has(v == "yes").alias("yes_only"),
        *[has(v.rlike(p)).alias(name) for name, p in VALUE_CLASSES.items()],
        has(v != F.lower(v)).alias("has_upper"), has(size > 40).alias("len_gt40"),
    )
    by_level = levels.groupBy("key", "lod_level").agg(F.sum("n").alias("c")).groupBy("key").agg(F.min("lod_level").alias("min_level"), F.percentile("lod_level", F.lit(0.5), F.col("c")).alias("med_level"))
    return by_value.join(by_level, "key")


def key_sketches(pois: DataFrame, lg: int = 14) -> DataFrame:
    """``key, lod_level, n, sketch``: counts and HyperLogLog sketches of each key's values by level, which can be stored and merged."""
    return pairs(pois).groupBy("key", "lod_level").agg(F.count("*").alias("n"), F.hll_sketch_agg("value", F.lit(lg)).alias("sketch"))


def append_sketches(pois: DataFrame, path: str) -> None:
    """Adds a part of the corpus to the stored sketches. Only the part is read."""
    key_sketches(pois).write.mode("append").parquet(path)


def merged_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """``n`` and ``nd_approx`` of each key (or ``by``) over all parts; the values themselves aren't read again."""
    return sketches.groupBy(*(by or ("key",))).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("nd_approx"))


def key_ratios(profile: DataFrame, n_rows: DataFrame) -> DataFrame:
    """Ratios of a key's profile; ``n_rows`` is one row with ``rows``."""
    r = lambda c: F.round(F.col(c) / F.col("n"), 4).alias(c.replace("_like", "").replace("_semicolon", "") + "_ratio")
    return profile.join(n_rows).select("key", "n", F.round(F.col("n") / F.col("rows"), 5).alias("row_ratio"), "nd", F.round(1 - F.col("nd") / F.col("n"), 4).alias("dup_ratio"), *map(r, ("multi_semicolon", "yes_no", "numeric_like", "url_like", "phone_like", "wikidata_qid", "has_upper", "non_ascii", "len_gt40", "token_like")), "min_level", "med_level")


def key_groups(levels: DataFrame) -> DataFrame:
    n = levels.groupBy("key").agg(F.sum("n").alias("n"))
    g = n.groupBy(key_group(F.col("key")).alias("key_group")).agg(F.count("*").alias("distinct_keys"), F.sum("n").alias("n"))
    return g.join(g.agg(F.sum("n").alias("total"))).select("key_group", "distinct_keys", "n", F.round(F.col("n") / F.col("total"), 4).alias("pair_share"))


def pair_counts(levels: DataFrame, most: int = EXPAND_MAX_DISTINCT) -> DataFrame:
    """``key, value, n, n_levels, min_level`` of keys with at most ``most`` different values, from ``pair_levels``.

    A pair has a row for each level, so its levels are counted and not told apart, and the number of different values of a key is the number of its pairs.
    """
    n = levels.groupBy("key", "value").agg(F.sum("n").alias("n"), F.count("*").alias("n_levels"), F.min("lod_level").alias("min_level"))
    few = n.groupBy("key").agg(F.count("*").alias("nd")).where(F.col("nd") <= most).select("key")
    return n.join(few, "key", "left_semi")


def top_values(counts: DataFrame, most: int = TOP_VALUES) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc("n"), "value")
    return counts.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= most)


def top_pairs(counts: DataFrame, most: int = 2000) -> DataFrame:
    return counts.orderBy(F.desc("n"), "key", "value").limit(most)


def reuse_buckets(counts: DataFrame) -> DataFrame:
    n = F.col("n")
    names = ((2, "1"), (10, "2-9"), (100, "10-99"), (1000, "100-999"), (10_000, "1k-9.9k"), (100_000, "10k-99k"), (1_000_000, "100k-999k"))
    b = F.when(n < names[0][0], names[0][1])
    for below, name in names[1:]:
        b = b.when(n < below, name)
    return counts.groupBy(b.otherwise("1M+").alias("bucket")).agg(F.count("*").alias("pairs"), F.sum("n").alias("occurrences"), F.min("n").alias("min_n"))


def coverage_curve(counts: DataFrame, points=COVERAGE_POINTS) -> DataFrame:
    """Share of occurrences that the most frequent pairs cover.

    Pairs with equal counts are one group, so the running sums go over the few different counts
    and not over all pairs in one task.
    """
    g = counts.groupBy("n").agg(F.count("*").alias("c"))
    w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    g = g.select("n", "c", F.sum("c").over(w).alias("last"), F.sum(F.col("n") * F.col("c")).over(w).alias("cum"), F.sum(F.col("n") * F.col("c")).over(Window.partitionBy()).alias("total"))
    at = g.withColumn("top_n_pairs", F.explode(F.array(*[F.lit(p).cast("long") for p in points]))).where("top_n_pairs <= last and top_n_pairs > last - c")
    return at.select("top_n_pairs", F.round((F.col("cum") - F.col("n") * (F.col("last") - F.col("top_n_pairs"))) / F.col("total"), 4).alias("coverage"))


def case_variants(counts: DataFrame) -> DataFrame:
    """Keys whose values fall together when case and outer white space don't count."""
    g = counts.groupBy("key").agg(F.count("*").alias("raw_variants"), F.countDistinct(F.lower(trim_all(F.col("value")))).alias("normalized_variants"))
    return g.withColumn("collapsed", F.col("raw_variants") - F.col("normalized_variants")).where("collapsed > 0")


def multi_value_keys(counts: DataFrame) -> DataFrame:
    """Averages over different pairs, not over occurrences."""
    v = counts.where(F.col("value").contains(";"))
    return v.groupBy("key").agg(F.count("*").alias("multi_pairs"), F.sum("n").alias("occurrences"), F.round(F.avg(F.size(F.split("value", ";", -1))), 2).alias("avg_parts"))


def primary_keys(pois: DataFrame, keys=PRIMARY_KEYS):
    return F.filter(F.sort_array(F.map_keys(F.coalesce("tags", F.create_map().cast("map<string,string>")))), lambda k: k.isin(*keys))


def primary_key_count(pois: DataFrame) -> DataFrame:
    """Rows by their number of primary keys, none included: counted in the row, without a join."""
    return pois.groupBy(F.size(primary_keys(pois)).alias("n_primary")).agg(F.count("*").alias("rows"))


def cooccurrence(pois: DataFrame, most: int = 100) -> DataFrame:
    """Pairs of primary keys that rows have together, built within the row instead of by a self-join."""
    k = pois.select(primary_keys(pois).alias("k")).where(F.size("k") > 1)
    p = F.flatten(F.transform("k", lambda a, i: F.transform(F.slice("k", i + 2, F.greatest(F.size("k") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("key_a"), b.alias("key_b")))))
    n = k.select(F.explode(p).alias("p")).groupBy("p.key_a", "p.key_b").agg(F.count("*").alias("rows"))
    return n.orderBy(F.desc("rows"), "key_a", "key_b").limit(most)


def level_top_keys(pois: DataFrame, most: int = 15) -> DataFrame:
    n = pairs(pois).groupBy("lod_level", "key").agg(F.count("*").alias("n"))
    size = pois.groupBy("lod_level").agg(F.count("*").alias("lv_rows"))
    w = Window.partitionBy("lod_level").orderBy(F.desc("n"), "key")
    n = n.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= most).join(size, "lod_level")
    return n.select("lod_level", "key", "n", F.round(F.col("n") / F.col("lv_rows"), 4).alias("row_ratio"))


def region_keys(pois: DataFrame, most: int = 300) -> DataFrame:
    """Keys of rows in the region; the filter runs before the map is exploded, so no join on ids is needed."""
    inside = pois.where(point_inside(F.col("lon"), F.col("lat"), REGION))
    total = inside.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    n = pairs(inside).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(most)
    return n.join(total).select("key", "n", F.round(F.col("n") / F.col("total"), 4).alias("row_ratio_jp"))


def value_samples(pois: DataFrame, over: int = EXPAND_MAX_DISTINCT, rows_sampled: int = 2_000_000, seed: int = 1, most: int = 8, exact: bool = False) -> DataFrame:
    """``key, n, nd_approx, samples``: up to ``most`` values of each key with more than ``over`` different ones, from a sample of exactly ``rows_sampled`` of these keys' pairs (or all).

    Pairs are ordered by 60 bits of an md5 of the seed, id, key and value, so the sample is the same on every engine. ``exact`` counts different values exactly.
    Keys with many pairs are broadcast, so their pairs stay in the tasks that read them.
    """
    p = pairs(pois).where("value is not null")
    nd = F.countDistinct("value") if exact else F.approx_count_distinct("value")
    keys = cut(p.groupBy("key").agg(F.count("*").alias("n"), nd.alias("nd_approx")))
    many = keys.where(F.col("nd_approx") > over)
    text = F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), "key", "value")
    place = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    chosen = cut(join_hot(p.select("key", "value", "id", place.alias("place")), many.select("key"), "key", counts=keys))
    w = Window.partitionBy("key").orderBy("place", "id", "value")
    top = smallest(chosen, rows_sampled, "place", F.col("key"), F.col("id"), F.col("value")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    samples = F.transform(F.sort_array(F.collect_list(F.struct("rn", "value"))), lambda x: x["value"])
    return top.groupBy("key").agg(samples.alias("samples")).join(many, "key").select("key", "n", "nd_approx", "samples")


def key_values(pois: DataFrame, keys) -> DataFrame:
    return pois.select(F.explode(F.map_filter("tags", lambda k, v: k.isin(*keys))).alias("key", "value"))


def extra_top_values(pois: DataFrame, keys, most: int = 40) -> DataFrame:
    return top_values(key_values(pois, keys).groupBy("key", "value").agg(F.count("*").alias("n")), most)


def split_summary(pois: DataFrame, keys) -> DataFrame:
    """Counts before splitting; distinct counts come from the pairs' groups."""
    v = key_values(pois, keys).groupBy("key", "value").agg(F.count("*").alias("n"))
    return v.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("nd_raw"), F.countDistinct(F.lower(trim_all(F.col("value")))).alias("nd_lower"), F.sum(F.when(F.col("value").contains(";"), F.col("n")).otherwise(0)).alias("n_multi"))


def split_parts(pois: DataFrame, keys) -> DataFrame:
    v = key_values(pois, keys).select("key", F.explode(F.split(F.lower("value"), ";", -1)).alias("part")).select("key", trim_all(F.col("part")).alias("part")).where("part <> ''")
    return v.groupBy("key", "part").agg(F.count("*").alias("n"))


def split_top_parts(parts: DataFrame, most: int = 40) -> DataFrame:
    nd = parts.groupBy("key").agg(F.count("*").alias("nd_after_split"))
    w = Window.partitionBy("key").orderBy(F.desc("n"), "part")
    return parts.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= most).join(nd, "key").select("key", "part", "n", "nd_after_split")


def split_distinct(parts: DataFrame) -> DataFrame:
    return parts.groupBy("key").agg(F.count("*").alias("nd_after_split"), F.sum("n").alias("parts_total"))
