"""Analytics of answers (``lens, variant, primitive, tag, num, dist``) and of request attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.style import three_way
from ..model import CHOICES
from .distribute import cut, global_rank


def argmax(dist: Column) -> Column:
    """The first largest entry, counted from 1."""
    return F.array_position(dist, F.array_max(dist)).cast("int")


def pearson(x: str, y: str) -> Column:
    """Correlation over rows with both; null with fewer than three or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when((F.count(a) >= 3) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def histogram(values: DataFrame, lo: float, hi: float, bins: int = 10) -> DataFrame:
    """Mean, population deviation and counts of ``bins`` bins by lens, variant and primitive; the last bin is closed."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("num") - lo) / (hi - lo) * bins)))
    v = values.where("num is not null").withColumn("bin", at)
    return v.groupBy("lens", "variant", "primitive").agg(F.count("*").alias("n"), F.round(F.avg("num"), 6).alias("mean"), F.round(F.stddev_pop("num"), 6).alias("sd"), *[F.count_if(F.col("bin") == i).alias(f"b{i}") for i in range(bins)])


def choice_counts(values: DataFrame) -> DataFrame:
    v = values.where("dist is not null").withColumn("top", argmax(F.col("dist")))
    return v.groupBy("lens", "variant").agg(*[F.count_if(F.col("top") == i + 1).alias(c) for i, c in enumerate(CHOICES)], F.round(F.avg(F.array_max("dist")), 6).alias("mean_top"))


def wide(values: DataFrame) -> DataFrame:
    one = lambda p, c: F.max(F.when(F.col("primitive") == p, F.col(c)))
    return values.groupBy("lens", "variant", "tag").agg(one("noul", "num").alias("confidence"), one("score", "num").alias("score"), one("choice", "dist").alias("choice"))


def confidence_score(values: DataFrame) -> DataFrame:
    """How confidence goes with the score and its distance from neutral, and conditional means and shares."""
    w = wide(values).where("confidence is not null and score is not null").withColumn("far", F.abs(F.col("score") - 2))
    c = F.col("confidence")
    return w.groupBy("lens", "variant").agg(
        F.count("*").alias("n"), F.round(pearson("confidence", "far"), 6).alias("r_far"), F.round(pearson("confidence", "score"), 6).alias("r_score"),
        F.round(F.avg(F.when(c < 0.4, F.col("far"))), 6).alias("far_low"), F.round(F.avg(F.when(c >= 0.7, F.col("far"))), 6).alias("far_high"),
        F.round(F.avg((c >= 0.8).cast("int")), 6).alias("share_high"), F.round(F.avg((c <= 0.2).cast("int")), 6).alias("share_low"),
    )


def paired(values: DataFrame, primitive: str, base: str, new: str) -> DataFrame:
    """``lens, tag`` with both variants' values: one shuffle, no self-join."""
    v = values.where(F.col("primitive") == primitive)
    one = lambda x, c: F.max(F.when(F.col("variant") == x, F.col(c)))
    p = v.groupBy("lens", "tag").agg(one(base, "num").alias("a"), one(new, "num").alias("b"), one(base, "dist").alias("da"), one(new, "dist").alias("db"))
    return p.where("(a is not null and b is not null) or (da is not null and db is not null)")


def score_deltas(values: DataFrame, base: str, new: str) -> DataFrame:
    p = paired(values, "score", base, new).withColumn("d", F.abs(F.col("b") - F.col("a")))
    return p.groupBy("lens").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_abs"), F.round(F.avg((F.col("d") >= 0.5).cast("int")), 6).alias("share_half"))


def top_movers(values: DataFrame, base: str, new: str, most: int = 4) -> DataFrame:
    p = paired(values, "score", base, new).withColumn("delta", F.round(F.col("b") - F.col("a"), 6))
    w = Window.partitionBy("lens").orderBy(F.desc(F.abs("delta")), "tag")
    return p.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= most).select("lens", "tag", "delta", "rk")


def crosstab(values: DataFrame, base: str, new: str) -> DataFrame:
    p = paired(values, "choice", base, new).select("lens", F.element_at(F.array(*map(F.lit, CHOICES)), argmax(F.col("da"))).alias("base"), argmax(F.col("db")).alias("to"))
    return p.groupBy("lens", "base").agg(*[F.count_if(F.col("to") == i + 1).alias(c) for i, c in enumerate(CHOICES)])


def category_means(values: DataFrame) -> DataFrame:
    w = wide(values).where("score is not null and choice is not null")
    name = F.element_at(F.array(*map(F.lit, CHOICES)), argmax(F.col("choice")))
    return w.groupBy("lens", "variant", name.alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg((F.col("score") < 1.5).cast("int")), 6).alias("share_low"))


def paired_diff(values: DataFrame, base: str, new: str) -> DataFrame:
    """Differences of the scores of two variants, and how often both say raise, keep or sink."""
    p = paired(values, "score", base, new)
    d = F.col("b") - F.col("a")
    return p.groupBy("lens").agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean_diff"), F.round(F.avg(F.abs(d)), 6).alias("mean_abs"), F.round(pearson("a", "b"), 6).alias("r"), F.round(F.avg((three_way(F.col("a")) == three_way(F.col("b"))).cast("int")), 6).alias("agreement"))


def choice_distance(values: DataFrame, base: str, new: str) -> DataFrame:
    p = paired(values, "choice", base, new)
    l1 = F.aggregate(F.zip_with("da", "db", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return p.groupBy("lens").agg(F.count("*").alias("n"), F.round(F.avg(l1), 6).alias("l1"), F.round(F.avg((argmax(F.col("da")) == argmax(F.col("db"))).cast("int")), 6).alias("same_top"))


def index_quantiles(df: DataFrame, by: str, value: str, quantiles=(0.5, 0.9), bins: int = 1024, few: int = 10_000) -> DataFrame:
    """``by, n`` and ``sorted[floor(q n)]`` of each group for each quantile, not interpolated. NaN is the largest value; nulls are no values.

    Ranks are found by selection. Each round counts the values of a group's range in ``bins`` equal parts, with the least and largest value of
    each, and keeps the part that holds the rank, until it holds ``few`` values at most, or one value however often. Only
    these are sorted. Counts are all that is shuffled, so a group that has most of the rows is no burden. ``by`` may be null.
    """
    rows = df.select(F.col(by).alias("by"), F.col(value).cast("double").alias("v")).where("v is not null")
    # NaN and infinities are kept apart as codes, so that ranges are finite
    code = F.when(F.isnan("v"), 2).when(F.col("v") == float("inf"), 1).when(F.col("v") == float("-inf"), -1).otherwise(0)
    rows = rows.select("by", code.alias("code"), "v")
    sizes = cut(rows.groupBy("by").agg(F.count("*").alias("n"), *[F.count_if(F.col("code") == c).alias(f"c{i}") for i, c in enumerate((-1, 0, 1))], *[f(F.when(F.col("code") == 0, F.col("v"))).alias(k) for k, f in (("lo", F.min), ("hi", F.max))]))
    each = sizes.select("*", F.posexplode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("at", "q"))
    each = each.withColumn("rank", F.least(F.floor(F.col("n") * F.col("q")), F.col("n") - 1))
    c0, c1, c2 = F.col("c0"), F.col("c0") + F.col("c1"), F.col("c0") + F.col("c1") + F.col("c2")
    special = F.when(F.col("rank") < c0, float("-inf")).when((F.col("rank") >= c1) & (F.col("rank") < c2), float("inf")).when(F.col("rank") >= c2, float("nan"))
    each = cut(each.select("by", "at", "n", "lo", "hi", special.alias("found"), (F.col("rank") - c0).alias("rank"), F.col("c1").alias("left")))
    done = each.where("found is not null").select("by", "at", "found")
    todo = each.where("found is null")
    finite = rows.where("code = 0").select("by", "v")
    while True:
        done = done.unionByName(todo.where("lo = hi").select("by", "at", F.col("lo").alias("found")))
        todo = cut(todo.where("lo < hi").select("by", "at", "lo", "hi", "rank", "left"))
        wide = todo.where(F.col("left") > few)
        if wide.isEmpty():
            break
        near = todo.where(F.col("left") <= few)
        inside = _within(finite, wide)
        half = lambda c: F.col(c) / 2 - F.col("lo") / 2  # noqa: E731  halves, as a range may be wider than the largest number
        part = F.when(half("hi") > 0, F.least(F.lit(bins - 1), F.floor(half("v") / F.when(half("hi") > 0, half("hi")) * bins))).otherwise((F.col("v") > F.col("lo")).cast("long"))
        counts = inside.groupBy("by", "at", "rank", part.alias("part")).agg(F.count("*").alias("left"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        w = Window.partitionBy("by", "at").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``bins`` rows
        counts = counts.withColumn("before", F.coalesce(F.sum("left").over(w), F.lit(0))).where("rank >= before and rank < before + left")
        todo = cut(near.unionByName(counts.select("by", "at", "lo", "hi", (F.col("rank") - F.col("before")).alias("rank"), "left")))
    w = Window.partitionBy("by", "at").orderBy("v")  # at most ``few`` values
    last = _within(finite, todo).withColumn("r", F.row_number().over(w) - 1).where("r = rank").select("by", "at", F.col("v").alias("found"))
    found = done.unionByName(last).groupBy("by").agg(*[F.max(F.when(F.col("at") == i, F.col("found"))).alias(f"q{int(q * 100)}") for i, q in enumerate(quantiles)])
    out = sizes.select("by", "n").withColumnRenamed("by", "_by")
    return out.join(found, F.col("_by").eqNullSafe(F.col("by"))).select(F.col("_by").alias(by), "n", *[f"q{int(q * 100)}" for q in quantiles])


def _within(values: DataFrame, ranges: DataFrame, most: int = 100_000) -> DataFrame:
    """Values (``by, v``) of each range (``by, lo, hi`` and more) of their group. Up to ``most`` ranges are broadcast, more are shuffled."""
    r = ranges.withColumnRenamed("by", "_by")
    r = F.broadcast(r) if ranges.count() <= most else r.hint("shuffle_hash")
    return values.join(r, F.col("by").eqNullSafe(F.col("_by")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).drop("_by")


def usage(attempts: DataFrame) -> DataFrame:
    """Requests, tokens and median latency (interpolated, then cut to an integer) of successful attempts by condition."""
    return attempts.where("status = 200").groupBy("condition").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.percentile("ms", F.lit(0.5)).cast("int").alias("median_ms"))


def usage_by(attempts: DataFrame, *by: str) -> DataFrame:
    """Requests, input and output tokens of successful attempts, in all and for each request."""
    ok = attempts.where("status = 200").groupBy(*by)
    return ok.agg(
        F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.avg("input_tokens"), 4).alias("mean_input"), F.round(F.avg("output_tokens"), 4).alias("mean_output"),
    )


def success_rates(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("condition").agg(F.count("*").alias("n"), F.round(F.avg((F.col("status") == 200).cast("int")), 6).alias("success"), *[F.count_if(F.col("status") == s).alias(f"s{s}") for s in (200, 429, 503)])


def healthy(attempts: DataFrame, control: str) -> DataFrame:
    """Attempts of the rounds whose control condition succeeded."""
    ok = attempts.where((F.col("condition") == control) & (F.col("status") == 200)).select("round").distinct()
    return attempts.join(ok, "round", "left_semi")


def token_reduction(attempts: DataFrame, base: str, new: str) -> DataFrame:
    one = lambda x: F.avg(F.when(F.col("condition") == x, F.col("tokens")))
    a = attempts.where("status = 200").agg(one(base).alias("base"), one(new).alias("new"))
    return a.select(F.round("base", 6).alias("base_tokens"), F.round("new", 6).alias("new_tokens"), F.round(1 - F.col("new") / F.col("base"), 6).alias("reduction"))


def lcg(n: int, seed: int = 42, modulus: int = 2**31) -> list[int]:
    """Draws in double arithmetic, in which products above 2**53 lose their low bits."""
    out, x = [], float(seed)
    for _ in range(n):
        x = (1103515245.0 * x + 12345.0) % modulus
        out.append(int(x))
    return out


def pair_mix(a: Column, b: Column, ca: Column, cb: Column) -> Column:
    """Two scores weighed by confidence; alike if neither confidence is above 0."""
    top = F.greatest(ca, cb)
    return F.when(top > 0, (ca * a + cb * b) / (ca + cb)).otherwise((a + b) / 2)


def token_reduction_by(attempts: DataFrame, base: str, new: str, by: str) -> DataFrame:
    """``token_reduction`` for each value of ``by``."""
    one = lambda x: F.avg(F.when(F.col("condition") == x, F.col("input_tokens")))
    a = attempts.where("status = 200").groupBy(by).agg(one(base).alias("base"), one(new).alias("new"))
    return a.select(by, F.round("base", 6).alias("base_tokens"), F.round("new", 6).alias("new_tokens"), F.round(1 - F.col("new") / F.col("base"), 6).alias("reduction"))


def random_pairs(w: DataFrame, draws: int = 4000) -> DataFrame:
    """``i, tag_a, tag_b, mixed`` of seeded random pairs of tags with score and confidence, met by row number."""
    spark = w.sparkSession
    rows = global_rank(w.where("score is not null and confidence is not null").select("tag", "score", "confidence"), F.col("tag"), name="at")
    n = rows.count()
    x = lcg(2 * draws)
    pairs = spark.createDataFrame([(i, x[2 * i] % max(n, 1), x[2 * i + 1] % max(n, 1)) for i in range(draws)], "i long, pa long, pb long")
    side = lambda s: rows.select(*[F.col(c).alias(f"{c}_{s}") for c in rows.columns])
    j = pairs.join(side("a"), F.col("pa") == F.col("at_a")).join(side("b"), F.col("pb") == F.col("at_b"))
    return j.select("i", "tag_a", "tag_b", F.round(pair_mix(F.col("score_a"), F.col("score_b"), F.col("confidence_a"), F.col("confidence_b")), 6).alias("mixed"))
