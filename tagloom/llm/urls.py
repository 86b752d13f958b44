"""URL filter: host and path rules, and a ratio of character language models for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: With one symbol for all else these make at most 32, so a model has at most 32**4 entries.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz/.-_0"
ORDER = 3
BINS = 2000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/ ? #``, A-Z lower-cased) and path (then up to ``? #``); both empty if there is none."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    path = F.substring_index(F.substring_index(F.substring(rest, F.length(host) + 1, F.length(rest)), "?", 1), "#", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its text, and its verdict; nulls if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer ones win over those before them
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def grams(df: DataFrame) -> DataFrame:
    """``df`` with a row for each character of ``url``: ``gram``, the codes of it and the three before it, five bits each."""
    url = F.coalesce("url", F.lit(""))
    at = F.instr(url, "://")
    low = F.lower(F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(url))  # all after the first ``://``: a URL may hold another
    # digits are one symbol, 0; symbol 0 is any other character and also stands before the start and after the end
    text = F.concat(F.lit("~" * ORDER), F.translate(low, "123456789", "000000000"), F.lit("~"))
    df = df.withColumn("_s", text)
    df = df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("_s") - ORDER)))
    code = F.lit(0)
    for k in range(ORDER + 1):
        one = F.expr(f"instr('{SYMBOLS}', substring(_s, _i + {k}, 1))")  # 1 to 31; 0 for all other characters
        code = code * 32 + one
    return df.withColumn("gram", code.cast("int")).drop("_s", "_i")


def char_models(labelled: DataFrame) -> DataFrame:
    """``gram, delta``: log P(char | context) under the allowed URLs less that under the blocked, for each gram in ``grams``.

    Variable-order Markov models by Witten-Bell: each order's estimate leans on the next shorter
    context's by the number of different characters seen after it, down to the uniform one.
    ``labelled``: ``gram, verdict``. Contexts that a class has never seen get the shorter one's value.
    """
    n = cut(labelled.groupBy("gram").agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("allow", "block")]))  # at most 32**4 rows, read for each order
    table = n
    p = {v: F.lit(1 / 32) for v in ("allow", "block")}
    for order in range(ORDER + 1):
        wide = 32 ** (order + 1)
        own = n.groupBy((F.col("gram") % wide).alias("g")).agg(*[F.sum(v).alias(v) for v in p])
        ctx = own.groupBy(F.floor(F.col("g") / 32).alias("c")).agg(*[x for v in p for x in (F.sum(v).alias(f"n_{v}"), F.count(F.when(F.col(v) > 0, 1)).alias(f"t_{v}"))])
        own = own.join(ctx, F.floor(F.col("g") / 32) == F.col("c")).drop("c")
        own = own.select(F.col("g").alias(f"g{order}"), *[F.struct(F.col(v).alias("n"), F.col(f"n_{v}").alias("all"), F.col(f"t_{v}").alias("kinds")).alias(f"{v}{order}") for v in p])
        table = table.join(own, F.col("gram") % wide == F.col(f"g{order}")).drop(f"g{order}")
        for v in p:
            s = F.col(f"{v}{order}")
            p[v] = F.when(s["all"] > 0, (s["n"] + s["kinds"] * p[v]) / (s["all"] + s["kinds"])).otherwise(p[v])
    return table.select("gram", (F.log(p["allow"]) - F.log(p["block"])).alias("delta"))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Each page with ``page_id, host, path, rule, verdict, score``.

    The longest rule that fits decides. Other URLs are judged by two character models, of the URLs
    that rules allow and of those they block: ``score`` is the length-normalised difference of the
    log-likelihoods, and the verdict is allow if it is at least the threshold that separates
    the rules' own URLs best (the largest sum of both classes' rates). Models come from three
    quarters of the rules' URLs, by a hash of the URL; the threshold from the other quarter.

    Null URLs and those without ``://`` have empty host and path and are judged as the empty
    URL or by their characters. If rules allow none or block none, every other URL is allowed.
    Repeated rows give repeated results; an empty table gives no rows. Other columns are not read.
    Only built-in functions are used. The model has at most 32**4 entries, so it is broadcast;
    n-grams are added up within the task that reads the URL.
    """
    lower = {c.lower(): c for c in pages.columns}
    t = pages.select(F.col(f"`{lower[id_col.lower()]}`").alias("page_id"), F.col(f"`{lower[url_col.lower()]}`").alias("url"))
    host, path = split_url(F.col("url"))
    t = t.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    t = t.withColumn("rule", rule).withColumn("by_rule", verdict)
    held_out = F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 1) >= "c"  # a quarter of the first hex digits
    seen = grams(t.select("url", F.when(~held_out, F.col("by_rule")).alias("verdict")))
    model = F.broadcast(char_models(seen.select("gram", "verdict")))
    # one score for each different URL; a URL's grams are all in one task, so they are summed before the shuffle
    scored = grams(t.select("url", "by_rule", held_out.alias("held_out"))).join(model, "gram", "left")
    key = [F.xxhash64("url").alias("k1"), F.xxhash64(F.lit("k2"), "url").alias("k2")]
    scored = scored.groupBy(*key).agg(F.round(F.avg(F.coalesce("delta", F.lit(0.0))), 9).alias("score"), F.first("by_rule").alias("by_rule"), F.first("held_out").alias("held_out"))
    # calibration on the held-out quarter: at most BINS rows
    cell = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("score") + 5) / 10 * BINS)))
    held = scored.where("held_out and by_rule is not null").groupBy(cell.alias("cell")).agg(*[F.count(F.when(F.col("by_rule") == v, 1)).alias(v) for v in ("allow", "block")])
    up, all_ = Window.orderBy(F.desc("cell")), Window.partitionBy()
    held = held.select("cell", *[F.try_divide(F.sum(v).over(up), F.sum(v).over(all_)).alias(v) for v in ("allow", "block")])
    best = held.where("allow is not null and block is not null").agg(F.max(F.struct((F.col("allow") - F.col("block")).alias("gain"), F.col("cell").alias("cell"))).alias("best"))
    best = best.select(((F.col("best.cell") / BINS * 10) - 5).alias("threshold"))
    scored = scored.select("k1", "k2", "score")
    out = t.withColumn("k1", key[0]).withColumn("k2", key[1]).join(scored, ["k1", "k2"], "left").join(F.broadcast(best), F.lit(True), "left")
    judged = F.when(F.col("threshold").isNull() | (F.col("score") >= F.col("threshold")), F.lit("allow")).otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", judged).alias("verdict"), "score")
