"""Source divergence audit: how far the term shares of a language's sources lie from one another."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_hot, pick

#: Bytes of a term: letters, A-Z lower-cased, and all beyond ASCII; the rest separates.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MIN_DOCS, TERMS, SMOOTH, UNIT = 30, 50, 5, 1_000_000_000
#: Postings of a slice of a language's terms, about.
SLICE = 200_000


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and of what is beyond ASCII, A-Z lower-cased."""
    return text.translate(_TERM).split()


def share(count, total, v, smooth: int = SMOOTH) -> np.ndarray:
    """``1 + floor(10**9 * (count + smooth) / (total + smooth * v))`` exactly, by three digits at a time; right for totals below 9 * 10**15."""
    below = np.asarray(total, np.int64) + smooth * v
    rest, out = np.asarray(count, np.int64) + smooth, np.zeros((), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // below, rest % below
    return out + 1


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term; ``docs`` has ``lang, source, text`` without nulls. A batch passes on a row for each of its terms and groups."""

    def run(batches):
        for b in batches:
            n: dict = defaultdict(Counter)
            d: dict = defaultdict(Counter)
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                seen = Counter(terms(text))
                n[lang, source].update(seen)
                d[lang, source].update(seen.keys())
            for (lang, source), of in n.items():
                t = list(of)
                docs_of = d[lang, source]
                cols = [pa.array([lang] * len(t), pa.string()), pa.array([source] * len(t), pa.string()), pa.array(t, pa.binary()), pa.array(list(of.values()), pa.int64()), pa.array([docs_of[x] for x in t], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])

    each = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return each.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def distances(n_terms: int, start: np.ndarray, of: np.ndarray, p: np.ndarray, base: np.ndarray):
    """For each group what a slice of ``n_terms`` terms adds to its row: the distance of ``g < h`` is ``row[g][h] + row[h][g]``.

    The lists of the index are ``of[start[i]:start[i + 1]]``, the groups that have term ``i``, with their shares ``p``. ``base`` has
    each group's share of a term that it lacks.
    """
    by_group = np.argsort(of, kind="stable")
    first = np.searchsorted(of[by_group], np.arange(len(base) + 1))
    term = np.repeat(np.arange(n_terms), np.diff(start))
    for g in range(len(base)):
        mine = by_group[first[g] : first[g + 1]]
        own, gap = p[mine], np.abs(base - base[g])
        # its terms against the others' baselines
        low = np.sort(own)
        sums, k = np.concatenate(([0], np.cumsum(low))), np.searchsorted(low, base)
        row = base * (2 * k - len(own)) + sums[-1] - 2 * sums[k] - len(own) * gap
        row[g + 1 :] += n_terms * gap[g + 1 :]
        # through the lists of its terms: where a later group has the term too, the shares count and not the baselines
        a, b = start[term[mine]], start[term[mine] + 1]
        at = np.repeat(a - np.concatenate(([0], np.cumsum(b - a)[:-1])), b - a) + np.arange((b - a).sum()) if len(mine) else mine
        x, later = np.repeat(own, b - a), of[at] > g
        at, x = at[later], x[later]
        h = of[at]
        np.add.at(row, h, np.abs(p[at] - x) - np.abs(x - base[h]) - np.abs(p[at] - base[g]) + gap[h])
        yield row


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, most_terms: int = TERMS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``: for each group (a source of a language) the other sources of its language by distance
    (part ``pair``, all of them) and the ``most_terms`` terms in which it lies most above its language (part ``term``).

    A language keeps the terms of ``min_docs`` of its documents or more. A group's share of a kept term is smoothed
    (``share``), so terms that it lacks have a share too, its baseline. The distance of two groups is the sum over all kept terms of
    the shares' absolute difference, in units of 10**-9, exactly.

    Terms are the rows of an index, whose lists hold the groups that have the term. The index is cut into slices. In a slice each group
    scatters its terms through the lists into one dense row of its peers: what a term adds over the two
    baselines where both have it. What one of the two has, or neither, comes from sums against the peers' baselines.
    So no pair of postings becomes a row, and the rows of slices are added up. Counts and the index are dealt by term, slices by number, so neither a source nor a term nor
    a language that holds much of the corpus meets in one task. The result has a row for each two sources of a language, and
    a slice's task a number for each source of it.

    Null text, language and source are empty. Groups without kept terms have pairs and no terms; a language without kept terms has
    distances of 0. Repeated rows count each. An empty table gives no rows. Other columns are not read.
    """
    t = pick(docs, lang=lang_col, source=source_col, text=text_col)
    t = t.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = term_counts(t)
    index = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.collect_list(F.struct("source", "n")).alias("of")).where(F.col("docs") >= min_docs)
    index = cut(index.select("lang", "term", "n_lang", "of"))
    kept = index.select("lang", F.explode("of").alias("p")).groupBy("lang", F.col("p.source").alias("source")).agg(F.sum("p.n").alias("n"))
    groups = t.groupBy("lang", "source").agg(F.lit(1).alias("one")).join(kept, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    whole = cut(index.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("n_all"), F.ceil(F.sum(F.size("of")) / SLICE).cast("int").alias("slices")))
    groups = groups.join(whole, "lang", "left").select("lang", "source", "n", *[F.coalesce(c, F.lit(d)).cast(k).alias(c) for c, d, k in (("v", 0, "long"), ("n_all", 0, "long"), ("slices", 1, "int"))])
    groups = cut(groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))
    parts = join_hot(index, whole.select("lang", "slices"), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"), "term", "n_lang", "of")
    peers = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("lang", "slice", "source", "n", "v", "n_all", "at")

    def scatter(index: pa.Table, peers: pa.Table) -> pa.Table:
        peers = peers.sort_by("at")
        lang, source = peers.column("lang")[0].as_py(), peers.column("source").to_pylist()
        total, v, n_all = peers.column("n").to_numpy(), peers.column("v")[0].as_py(), peers.column("n_all")[0].as_py()
        index = index.sort_by("term").combine_chunks()
        out = [([], [], [], [])]
        if v:
            lists = index.column("of").combine_chunks()
            flat = lists.flatten()
            of = pc.index_in(flat.field("source"), pa.array(source, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
            n = flat.field("n").to_numpy(zero_copy_only=False)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
            term = np.repeat(np.arange(len(size)), size)
            p = share(n, total[of], v)
            over = p - share(index.column("n_lang").to_numpy(), n_all, v)[term]
            top = np.flatnonzero((over > 0) & (n > 0))
            top = top[np.lexsort((term[top], -over[top], of[top]))]  # terms are sorted, so places order them
            top = top[np.arange(len(top)) - np.searchsorted(of[top], of[top]) < most_terms]
            names = index.column("term").to_pylist()
            out.append(([source[i] for i in of[top]], [names[i] for i in term[top]], over[top].tolist(), [None] * len(top)))
            start = np.concatenate(([0], np.cumsum(size)))
            rows = [r.tobytes() for r in distances(len(size), start, of, p, share(0, total, v))]
        else:
            rows = [np.zeros(len(source), np.int64).tobytes()] * len(source)
        if len(source) > 1:
            out.append((source, [None] * len(source), [None] * len(source), rows))
        cols = [sum(map(list, c), []) for c in zip(*out, strict=True)]
        return pa.table({"lang": pa.array([lang] * len(cols[0]), pa.string()), "source": pa.array(cols[0], pa.string()), "term": pa.array(cols[1], pa.binary()), "value": pa.array(cols[2], pa.int64()), "row": pa.array(cols[3], pa.binary())})

    # written, as both parts are read from it: at most ``most_terms`` terms and a dense row for each group and slice
    found = cut(parts.groupBy("lang", "slice").cogroup(peers.groupBy("lang", "slice")).applyInArrow(scatter, "lang string, source string, term binary, value long, row binary"))
    own = Window.partitionBy("lang", "source")
    by_term = found.where("term is not null").withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "term"))).where(F.col("rank") <= most_terms)
    by_term = by_term.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")

    def add(rows: pa.Table) -> pa.Table:
        total = 0
        for r in rows.column("row"):
            total = total + np.frombuffer(r.as_py(), np.int64)
        return pa.table({"lang": rows.column("lang")[:1], "source": rows.column("source")[:1], "row": pa.array([total.tolist()], pa.list_(pa.int64()))})

    dense = found.where("row is not null").select("lang", "source", "row").groupBy("lang", "source").applyInArrow(add, "lang string, source string, row array<long>")
    halves = dense.join(groups.select("lang", "source", "at"), ["lang", "source"]).select("lang", F.col("at").alias("g"), F.posexplode("row").alias("h", "value")).where("g != h")
    pairs = halves.groupBy("lang", F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("g").alias("g"), F.col("h").alias("h")), F.struct(F.col("h").alias("g"), F.col("g").alias("h")))).alias("x"))
    names = lambda k, name: groups.select("lang", F.col("at").alias(k), F.col("source").alias(name))
    pairs = pairs.select("lang", "value", "x.g", "x.h").join(names("g", "source"), ["lang", "g"]).join(names("h", "item"), ["lang", "h"])
    by_pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(own.orderBy(F.desc("value"), "item")).alias("rank"))
    return by_pair.unionByName(by_term)
