"""Language identification: text, declared language and host priors in one posterior."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, row_key

CLASSES = 64
UNKNOWN = "und"
#: Nats a trigram by which a language has to explain a text better than characters without context do (at most; see ``calibrate``),
#: and nats by which it may fall short all the same (at least), as a few letters are no evidence for anything.
MARGIN, SLACK = 0.3, 10.0
#: A tenth of the sampled documents is held out, and read whole and as their first words, so many of them.
HELD_OUT, SNIPPETS = 10, (1, 2, 4, 8)
#: A language whose text is less likely than the best by so many tempered nats stays behind it with any other evidence
#: (up to some 85 nats at 1e9 documents), and its share is under the rounding of the confidence.
NATS = 120.0


def _classes() -> np.ndarray:
    """UTF-16 units to 64 classes: 0 for all but letters, a-z, and other letters dealt over the rest; case is folded."""
    table = np.zeros(65536, dtype=np.int32)
    for u in range(65536):
        c = chr(u)
        if 0xD800 <= u < 0xE000:
            table[u] = 27 + u % 37
        elif c.isalpha():
            low = c.lower()[0]
            table[u] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) * 2654435761 % 2**32 % 37
    return table


_TABLE: list[np.ndarray] = []


def trigrams(text: str) -> np.ndarray:
    """Codes of the trigrams that end in each letter or word end of a whole text; what stands between two words is one word end."""
    if not _TABLE:
        _TABLE.append(_classes())
    u = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
    c = np.concatenate(([0], _TABLE[0][u], [0]))
    c = c[np.append(True, (c[1:] > 0) | (c[:-1] > 0))]
    c = np.repeat(c, np.where(c > 0, 1, 2))  # two class-0 characters stand before a word, so its letters don't lean on the word before
    g = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
    return g[g % CLASSES**2 > 0]


class Models:
    """Variable-order models of any number of languages; only the trigrams and pairs that a language has are stored.

    Each order leans on the next shorter one, so a log-probability is that of the last character plus corrections
    for the contexts and n-grams that occur. The last column of ``score`` is the unknown language: characters of
    the pooled text without any context, plus ``margin`` for each trigram, less ``slack``. Characters never seen
    are as likely in it as in the languages on average. ``lang, gram, n``: counts, each pair of language and
    trigram once.
    """

    margin, slack = MARGIN, SLACK

    def __init__(self, size: int, lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        c, n, self.size = CLASSES, n.astype(np.float64), size
        n1 = np.bincount(lang * c + gram % c, weights=n, minlength=size * c).reshape(size, c)
        p1 = (n1 + 0.5) / (n1.sum(axis=1, keepdims=True) + 0.5 * c)
        pooled = n1.sum(axis=0) + 0.5 * max(1, size)
        self.none, self.last = np.log(pooled / pooled.sum()), np.log(p1)

        k2, at2 = np.unique(lang * c**2 + gram % c**2, return_inverse=True)  # the last two characters
        n2 = np.bincount(at2, weights=n, minlength=len(k2))
        lang2, pair = k2 // c**2, k2 % c**2
        all2 = np.bincount(lang2 * c + pair // c, weights=n2, minlength=size * c).reshape(size, c)
        self.before = np.log(10 / (all2 + 10))
        own = p1[lang2, pair % c]
        self.pairs = self._rows(pair, lang2, np.log((n2 + 10 * own) / (10 * own)), c**2)
        p2 = (n2 + 10 * own) / (all2[lang2, pair // c] + 10)

        k3, at3 = np.unique(lang * c**2 + gram // c, return_inverse=True)  # the two characters before the last
        n3 = np.bincount(at3, weights=n, minlength=len(k3))
        self.contexts = self._rows(k3 % c**2, k3 // c**2, np.log(10 / (n3 + 10)), c**2)
        self.grams = self._rows(gram, lang, np.log((n + 10 * p2[at2]) / (10 * p2[at2])), c**3)

    @staticmethod
    def _rows(key: np.ndarray, lang: np.ndarray, value: np.ndarray, keys: int):
        order = np.argsort(key, kind="stable")
        return np.concatenate(([0], np.cumsum(np.bincount(key, minlength=keys)))), lang[order].astype(np.int32), value[order].astype(np.float32)

    def score(self, g: np.ndarray) -> np.ndarray:
        """Log-likelihoods of a text's trigrams in each language and in none."""
        c = CLASSES
        last, before = np.bincount(g % c, minlength=c), np.bincount(g // c % c, minlength=c)
        out = self.last @ last + self.before @ before
        for (ends, lang, value), key in ((self.pairs, g % c**2), (self.contexts, g // c), (self.grams, g)):
            start, n = ends[key], ends[key + 1] - ends[key]
            at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
            out = out + np.bincount(lang[at], weights=value[at], minlength=self.size)
        return np.append(out, self.none @ last + self.margin * len(g) - self.slack)

    def gap(self, text: str) -> tuple[int, float]:
        """Trigrams of a text and the nats by which its best language explains it better than no language, margin and slack aside."""
        g = trigrams(text)
        ll = self.score(g)
        return len(g), float(ll[:-1].max() - ll[-1]) + self.margin * len(g) - self.slack

    def calibrate(self, whole: list[tuple[int, float]], short: list[tuple[int, float]]) -> None:
        """Margin and slack from the gaps of held-out documents and of their first words.

        The margin is half of what 99 % of the whole documents show, ``MARGIN`` at most; the slack is what 999 of
        1000 first words need to pass, ``SLACK`` at least.
        """
        each = [gap / n for n, gap in whole if n]
        if each:
            self.margin = float(np.clip(np.quantile(each, 0.01) / 2, 0.0, MARGIN))
        need = [self.margin * n - gap for n, gap in short if n]
        if need:
            self.slack = max(SLACK, float(np.quantile(need, 0.999)))


def normal_tag(c: Column) -> Column:
    """``en-US`` and ``EN_us`` to ``en``; null if it doesn't begin with two or three letters."""
    return F.nullif(F.regexp_extract(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1), F.lit(""))


def evidence(docs: DataFrame, id_col="doc_id", text_col: str | None = "text", declared_col: str | None = None, host_col: str | None = None, url_col: str | None = None, html_col: str | None = None, origin: str = "") -> DataFrame:
    """``origin, id, _k1, _k2, text, declared, host, suffix``. From ``html``: its text without tags and its lang attribute; from ``url``: host and last label."""
    low = {c.lower(): c for c in docs.columns}
    col = lambda name: F.col(f"`{low[name.lower()]}`") if name and name.lower() in low else F.lit(None).cast("string")
    html = F.coalesce(col(html_col), F.lit(""))
    text = F.coalesce(col(text_col), F.lit(""))
    declared, host = normal_tag(col(declared_col)), col(host_col).cast("string")
    if html_col:
        bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", " ")
        text = F.when(text == "", bare).otherwise(text)
        declared = F.coalesce(normal_tag(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", 1)), declared)
    suffix = F.lit(None).cast("string")
    if url_col:
        host = F.coalesce(F.nullif(F.lower(F.regexp_extract(F.coalesce(col(url_col), F.lit("")), r"://([^/?#:]*)", 1)), F.lit("")), host)
        suffix = F.nullif(F.substring_index(host, ".", -1), F.lit(""))
    key = F.coalesce(col(text_col), F.lit("")) if not html_col else F.concat(F.coalesce(col(text_col), F.lit("")), html)  # of what is there, not of what is made of it
    return docs.select(F.lit(origin).alias("origin"), col(id_col).alias("id"), *row_key(col(id_col), key), text.alias("text"), declared.alias("declared"), host.alias("host"), suffix.alias("suffix"))


def train(ev: DataFrame, max_docs: int = 20_000, least_docs: int = 100) -> tuple[list[str], Models]:
    """Every declared language and their models.

    They are counted on about ``max_docs`` documents chosen by hash (a documented bound), dealt evenly to
    the languages, of which each gets ``least_docs`` at least, or all it has. Copies count once. Languages
    with more than ``least_docs`` of them lend a tenth for calibration.
    """
    known = ev.where("declared is not null")
    found = {r["declared"]: r["n"] for r in known.groupBy("declared").agg(F.count("*").alias("n")).collect()}  # tags of two or three letters
    languages = sorted(found)
    if not languages:
        return [], Models(0, *[np.zeros(0, np.int64)] * 3)
    quota, left = {}, max_docs  # what small languages don't need goes to the others
    for i, x in enumerate(sorted(languages, key=lambda x: found[x])):
        quota[x] = min(found[x], max(least_docs, left // (len(languages) - i)))
        left = max(0, left - quota[x])
    spark = ev.sparkSession
    shares = [(x, i, int(min(1.0, quota[x] / found[x]) * (1 << 20)) + 1, quota[x] > least_docs) for i, x in enumerate(languages)]
    shares = F.broadcast(spark.createDataFrame(shares, "declared string, lang int, share int, lends boolean"))  # a row for each language
    place, fold = F.pmod(F.xxhash64(F.lit("lid"), "_k1"), F.lit(1 << 20)), F.pmod(F.xxhash64(F.lit("held"), "text"), F.lit(HELD_OUT))
    sample = known.join(shares, "declared").where(place < F.col("share"))
    sample = sample.select("lang", (F.col("lends") & (fold == 0)).alias("held"), "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("h2"), "text").alias("h2")).dropDuplicates(["lang", "h1", "h2"])

    def count(batches):
        for b in batches:
            codes = [trigrams(text) + lang * CLASSES**3 for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True)]
            k, n = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["k", "n"])

    # only trigrams that occur in the sample
    table = sample.where("not held").select("lang", "text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = table.column("k").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(k)
    models = Models(len(languages), k[order] // CLASSES**3, k[order] % CLASSES**3, n[order])
    sent = spark.sparkContext.broadcast(models)

    def gaps(batches):
        for b in batches:
            for text in b.column("text").to_pylist():
                first = text.split(None, max(SNIPPETS))
                rows = [(0, *sent.value.gap(text)), *((k, *sent.value.gap(" ".join(first[:k]))) for k in SNIPPETS if len(first) > k)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["words", "n", "gap"])

    seen = sample.where("held").select("text").mapInArrow(gaps, "words long, n long, gap double").collect()  # five rows of three numbers for a tenth of the sample
    models.calibrate([(r["n"], r["gap"]) for r in seen if not r["words"]], [(r["n"], r["gap"]) for r in seen if r["words"]])
    return languages, models


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str | None = "text", declared_col: str | None = "lang", host_col: str | None = "source", url_col: str | None = None, html_col: str | None = None, allowed: tuple[str, ...] | None = None, least: float = 0.5, text_weight: float = 300.0, prior_weight: float = 10.0) -> DataFrame:
    """Each document with ``doc_id, lang, confidence, text_lang, declared, accepted`` and its row's keys ``_k1, _k2``.

    The posterior of a language is proportional to three factors. The text's trigram likelihood is
    tempered, as neighbours share characters: a text of n trigrams weighs as n w / 2 (n + w) independent ones (w is
    ``text_weight``). The probability of the declared language comes from how often each is declared
    where the text says which it is. The host's prior is its own count of languages leaning on its
    address suffix's, which leans on that of all documents; counts are grouped aggregates of what
    the other texts say. Evidence that is missing (null) has no factor.

    ``lang`` is ``und`` if characters without context explain the text better than any language, by a margin
    and a slack that are calibrated on held-out documents.
    Accepted: a known language (one of ``allowed``, if given) with confidence ``least`` or more.
    Null, empty and letterless texts are ``und`` and rejected. Repeated rows give repeated
    results, ties go to the first language by name, an empty table gives no rows. Other columns
    are not read.
    """
    out = fuse(evidence(docs, id_col, text_col, declared_col, host_col, url_col, html_col), allowed, least, text_weight, prior_weight)
    return out.withColumnRenamed("id", "doc_id").drop("origin")


def fuse(ev: DataFrame, allowed: tuple[str, ...] | None = None, least: float = 0.5, text_weight: float = 300.0, prior_weight: float = 10.0) -> DataFrame:
    """``identify`` over rows of ``evidence``, which may come from several tables (``origin``); their ids come back as ``id``."""
    languages, models = train(ev)
    names = [*languages, UNKNOWN]
    size = len(names)
    sent = ev.sparkSession.sparkContext.broadcast(models)

    def likelihoods(batches):
        table = sent.value
        for b in batches:
            near, lls, says, count = [], [], [], []
            for text in b.column("text").to_pylist():
                g = trigrams(text)
                ll = table.score(g)
                keep = np.flatnonzero((ll.max() - ll) * text_weight / (len(g) + text_weight) / 2 <= NATS)
                near.append(keep.astype(np.int32))
                lls.append(ll[keep])
                says.append(int(ll.argmax()) if len(g) else size - 1)  # ties go to the first; texts without letters are unknown
                count.append(len(g))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("origin", "id", "_k1", "_k2", "declared", "host", "suffix")), pa.array(near, pa.list_(pa.int32())), pa.array(lls, pa.list_(pa.float64())), pa.array(says, pa.int32()), pa.array(count, pa.int64())], names=["origin", "id", "_k1", "_k2", "declared", "host", "suffix", "near", "ll", "says", "n"])

    kind = dict(ev.dtypes)["id"]
    seen = cut(ev.mapInArrow(likelihoods, f"origin string, id {kind}, _k1 long, _k2 long, declared string, host string, suffix string, near array<int>, ll array<double>, says int, n long"))
    at = {x: i for i, x in enumerate(languages)}
    total = np.full(size, 0.5)
    for r in seen.groupBy("says").count().collect():
        total[r["says"]] += r["count"]
    whole = total / total.sum()
    # declared, by what the text says: only pairs that occur
    said: dict[int, dict[int, int]] = {i: {} for i in range(size)}
    column = np.full(size, 0.5 * size)
    for r in seen.where("declared is not null").groupBy("declared", "says").count().collect():
        said[at[r["declared"]]][r["says"]] = r["count"]
        column[r["says"]] += r["count"]
    told = ev.sparkSession.sparkContext.broadcast((at, whole, said, np.log(column)))

    def counted(each: DataFrame, by: str, *more) -> DataFrame:
        """A map of how often texts say each language; only languages that occur."""
        return each.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("says", "c"))).alias(f"of_{by}"), *more)

    lost = F.lit(None).cast("map<int,double>")
    by = ("origin", "id", "_k1", "_k2", "declared", "says", "near", "ll", "n")
    # one row a host, whichever tables name it: its suffix is the first by name that any of them has, and counts all of the host's rows
    each = seen.where("host is not null").groupBy("host", "says").agg(F.count("*").cast("double").alias("c"), F.min("suffix").alias("suffix"))
    hosts = cut(counted(each, "host", F.min("suffix").alias("suffix")))
    whole_suffix = hosts.where("suffix is not null").select("suffix", F.explode("of_host").alias("says", "c")).groupBy("suffix", "says").agg(F.sum("c").alias("c"))
    hosts = cut(join_hot(hosts, counted(whole_suffix, "suffix"), "suffix", how="left").drop("suffix"))
    # hosts of over a thousandth of all rows, of which there are less than a thousand, are broadcast; the rows of the others meet theirs in a shuffle
    rows = F.aggregate(F.map_values("of_host"), F.lit(0.0), lambda a, x: a + x)
    hot = hosts.where(rows * 1000 > seen.count())
    known = seen.where("host is null").select(*by, lost.alias("of_host"), lost.alias("of_suffix"))
    known = known.unionByName(seen.join(F.broadcast(hot), "host").select(*by, "of_host", "of_suffix"))
    cool = seen.join(F.broadcast(hot.select("host")), "host", "left_anti").where("host is not null")
    known = known.unionByName(cool.join(hosts, "host").select(*by, "of_host", "of_suffix"))

    def shares(of, says: int, keep: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Counts without the document's own over a parent's shares, for the languages in ``keep``."""
        own = dict(of)
        own[says] = max(0.0, own.get(says, 0.0) - 1)
        return (np.array([own.get(i, 0.0) for i in keep.tolist()]) + parent * prior_weight) / (sum(own.values()) + prior_weight)

    def judge(batches):
        at, whole, said, column = told.value
        for b in batches:
            lang, confidence = [], []
            for near, ll, n, says, declared, of_host, of_suffix in zip(*(b.column(c).to_pylist() for c in ("near", "ll", "n", "says", "declared", "of_host", "of_suffix")), strict=True):
                keep = np.array(near)
                prior = whole[keep]
                for of in (of_suffix, of_host):
                    if of is not None:
                        prior = shares(of, says, keep, prior)
                post = np.array(ll) * text_weight / (n + text_weight) / 2 + np.log(prior)
                if declared is not None:
                    own = said[at[declared]]
                    post = post + np.log([own.get(i, 0) + 0.5 for i in keep.tolist()]) - column[keep]
                lang.append(names[keep[post.argmax()]] if n else UNKNOWN)
                confidence.append(1 / float(np.exp(post - post.max()).sum()))
            cols = [*(b.column(c) for c in ("origin", "id", "_k1", "_k2", "declared", "says")), pa.array(lang, pa.string()), pa.array(confidence, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["origin", "id", "_k1", "_k2", "declared", "says", "lang", "confidence"])

    known = known.mapInArrow(judge, f"origin string, id {kind}, _k1 long, _k2 long, declared string, says int, lang string, confidence double").withColumn("confidence", F.round("confidence", 9))
    fits = (F.col("lang") != UNKNOWN) & (F.col("confidence") >= least)
    if allowed is not None:
        fits = fits & F.col("lang").isin(*allowed)
    return known.select("origin", "id", "lang", "confidence", F.element_at(F.lit(names), F.col("says") + 1).alias("text_lang"), "declared", fits.alias("accepted"), "_k1", "_k2")
