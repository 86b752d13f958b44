"""How many rectangles views meet, without a row for each pair.

A view from (a0, b0) to (a1, b1) meets ``([x0 <= a1] - [x1 < a0]) * ([y0 <= b1] - [y1 < b0])`` of the rectangles, as one that ends before the view also
starts before its end. So its total is four signed sums, each over the rectangles with two corners below two numbers.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .viewport import meet_boxes

#: Rectangles of a strip, and views of a part of one, that a task holds at once.
STRIP_ROWS = 500_000
_CORNERS = ("x0", "x1", "y0", "y1")
#: How a view's number is held against each corner: ``right`` counts equal ones.
_SIDES = ("right", "left", "right", "left")


def _places(edges: np.ndarray, *sides: str):
    """A column's number of edges below it (``left``) or up to it (``right``), summed over ``sides``."""

    @F.pandas_udf("int")
    def places(v: pd.Series) -> pd.Series:
        return pd.Series(sum(np.searchsorted(edges, v.to_numpy(), s) for s in sides))

    return places


def _below(rank: np.ndarray, sums: np.ndarray, first: np.ndarray, under: np.ndarray) -> np.ndarray:
    """For each query the ``sums`` of those of the ``first`` points whose rank is less than ``under``: all queries at once, bit by bit of the ranks."""
    out = np.zeros((len(sums), len(first)), dtype=np.int64)
    lo, hi = np.zeros_like(first), first
    for bit in reversed(range(len(rank).bit_length())):
        one = (rank >> bit & 1).astype(bool)
        order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
        zeros = np.concatenate([[0], np.cumsum(~one)])
        rank, sums = rank[order], sums[:, order]
        total = np.pad(np.cumsum(sums, axis=1), ((0, 0), (1, 0)))
        up = (under >> bit & 1).astype(bool)
        lo0, hi0 = zeros[lo], zeros[hi]
        out += np.where(up, total[:, hi0] - total[:, lo0], 0)
        lo, hi = np.where(up, zeros[-1] + lo - lo0, lo0), np.where(up, zeros[-1] + hi - hi0, hi0)
    return out


def _strip_totals(points: pa.Table, views: pa.Table) -> pa.Table:
    """What the points of a strip add to each view that ends in it: two signed sums, level by level."""
    got = np.zeros((2, len(views)), dtype=np.int64)
    if len(points) and len(views):
        side = points["side"][0].as_py()
        p = {c: points[c].to_numpy() for c in ("v", "o0", "o1", "lod_level", "n", "ids")}
        q = {c: views[c].to_numpy() for c in ("v", "o0", "o1", "max_level")}
        order = np.lexsort((p["v"], p["lod_level"]))
        p = {c: a[order] for c, a in p.items()}
        new = np.flatnonzero(np.diff(p["lod_level"])) + 1
        for a, b in zip([0, *new], [*new, len(order)], strict=True):
            asks = np.flatnonzero(q["max_level"] >= p["lod_level"][a])
            first = np.searchsorted(p["v"][a:b], q["v"][asks], _SIDES[side])
            for j, o in enumerate(("o0", "o1")):
                by = np.argsort(p[o][a:b], kind="stable")
                rank = np.empty(b - a, dtype=np.int64)
                rank[by] = np.arange(b - a)
                under = np.searchsorted(p[o][a:b][by], q[o][asks], _SIDES[2 + j] if side < 2 else "left")
                got[:, asks] += _below(rank, np.stack([p["n"][a:b], p["ids"][a:b]]), first, under) * (1 if side % 2 == j else -1)
    return pa.table({"view_id": views["view_id"], "n": got[0], "ids": got[1]})


def _each(rows: DataFrame, fields: tuple[tuple[Column, ...], ...], *more: str) -> DataFrame:
    """A row ``side, strip, v, o0, o1`` (and ``more``) for each of the four corners."""
    one = lambda i, f: F.struct(F.lit(i).alias("side"), *[F.col(c).cast(t).alias(n) for c, t, n in zip(f, ("int", "double", "double", "double"), ("strip", "v", "o0", "o1"), strict=True)])
    return rows.select(F.explode(F.array(*[one(i, f) for i, f in enumerate(fields)])).alias("e"), *more).select("e.*", *more)


def _proper_totals(rects: DataFrame, views: DataFrame, rows: int) -> DataFrame:
    """``view_id, n, ids`` in parts that are to be added up, of rectangles and views whose corners are in order.

    Each corner's values are cut into strips, at quantiles that are strips of their own, so that however many rectangles have one value, what lies between
    two of them is bounded. A sum over ``x < a, y < b`` is: the rectangles of the strips of x up to the one that holds ``a``, compared by y, and
    those of that strip, compared by both; the first likewise: the totals of whole cells of the strips of y up to b's, and in that strip the
    rectangles by y and by their strip of x. So a rectangle is in four tasks, and a view in four.
    """
    k = rows // STRIP_ROWS
    cuts = rects.approxQuantile(list(_CORNERS), [i / (k + 1) for i in range(1, k + 1)], 1 / (8 * (k + 1))) if k else [[]] * 4
    edges = [np.unique(np.array(c, dtype=float)) for c in cuts]
    r = rects.select("*", *[_places(e, "left", "right")(c).alias(f"s{i}") for i, (c, e) in enumerate(zip(_CORNERS, edges, strict=True))])  # odd: an edge itself
    points = _each(r, (("s0", "x0", "y0", "y1"), ("s1", "x1", "y0", "y1"), ("s2", "y0", "s0", "s1"), ("s3", "y1", "s0", "s1")), "lod_level", "id")
    points = points.where("strip % 2 = 0").select("side", "strip", "v", "o0", "o1", "lod_level", F.lit(1).cast("long").alias("n"), F.col("id").alias("ids"))

    cell = lambda t, j: F.struct(F.lit(t).alias("side"), F.lit(j).alias("j"), F.col(f"s{t}").alias("at"), F.col(f"s{j}").alias("s"))
    cells = r.select(F.explode(F.array(*[cell(t, j) for t in (2, 3) for j in (0, 1)])).alias("c"), "lod_level", "id").groupBy("c.side", "c.j", "c.s", "lod_level", "c.at").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    w = Window.partitionBy("side", "j", "s", "lod_level").orderBy("at")
    upto = lambda c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c)
    cells = cells.select("side", "j", "s", "lod_level", F.shiftright("at", 1).alias("low"), F.shiftright(F.lead("at", 1, 2 * k).over(w), 1).alias("high"), upto("n"), upto("ids"))
    other = lambda j: F.when(F.col("j") == j, F.col("s")).otherwise(float("inf")).cast("double").alias(f"o{j}")
    whole = cells.where("low < high").select("*", F.explode(F.expr("sequence(low + 1, high)")).alias("strip"))
    whole = whole.select("side", (F.col("strip") * 2).alias("strip"), F.lit(float("-inf")).alias("v"), other(0), other(1), "lod_level", "n", "ids")

    v = views.select("*", *[_places(e, s, s)(c).alias(f"s{i}") for i, (c, e, s) in enumerate(zip(("x1", "x0", "y1", "y0"), edges, _SIDES, strict=True))])
    asked = _each(v, (("s0", "x1", "y1", "y0"), ("s1", "x0", "y1", "y0"), ("s2", "y1", "s0", "s1"), ("s3", "y0", "s0", "s1")), "view_id", "max_level")
    busy = asked.groupBy("side", "strip").agg(F.ceil(F.count("*") / STRIP_ROWS).cast("int").alias("parts")).where("parts > 1")  # strips that many views ask: each part has the strip's points
    busy = F.broadcast(rects.sparkSession.createDataFrame(busy.collect(), busy.schema))  # four for each strip at most
    points = points.unionByName(whole).join(busy, ["side", "strip"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    asked = asked.join(busy, ["side", "strip"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("view_id", "v", "o0", "o1"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    key, tasks = ("side", "strip", "part"), 4 * (k + 1)
    a, b = (x.repartition(tasks, *key).groupBy(*key) for x in (points, asked))
    return a.cogroup(b).applyInArrow(_strip_totals, views.select("view_id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("ids")).schema)


def box_totals(rects: DataFrame, views: DataFrame) -> DataFrame:
    """``view_id, n, ids``: number and sum of ids of the rectangles (``id, lod_level, x0, y0, x1, y1``) that each view (``view_id, max_level`` and the same corners) touches or overlaps.

    Levels are few. A view with ``x0 > x1`` crosses the date line: its two halves are added, and rectangles that lie in both, which are at least as wide as what
    the view leaves out, are taken off once, found as pairs (``meet_boxes``). Rectangles and views whose corners are in the wrong order meet as pairs, too. Rows
    that repeat count each time; rectangles and views without corners or level meet nothing, and views that meet none have no row.
    """
    known = lambda level: reduce(lambda a, c: a & F.col(c).isNotNull(), (*_CORNERS, level), F.lit(True))
    double = [F.col(c).cast("double").alias(c) for c in _CORNERS]
    rects = rects.where(known("lod_level")).select(F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.col("lod_level").cast("int").alias("lod_level"), *double)
    views = views.where(known("max_level")).select("view_id", F.col("max_level").cast("int").alias("max_level"), *double)
    across = F.col("x0") > F.col("x1")
    turned = {"rects": across | (F.col("y0") > F.col("y1")), "views": (F.col("y0") > F.col("y1")) | across & ((F.col("x0") > 180) | (F.col("x1") < -180))}
    gap, odd_views = views.agg(F.min(F.when(across, F.col("x0") - F.col("x1"))), F.count_if(turned["views"])).first()
    wide = F.lit(False) if gap is None else F.col("x1") - F.col("x0") >= gap
    rows, odd_rects, n_wide = rects.agg(F.count("*"), F.count_if(turned["rects"]), F.count_if(wide)).first()
    proper, seen = rects.where(~turned["rects"]), views.where(~turned["views"])
    part = lambda a, b: F.struct(a.alias("x0"), b.alias("x1"))
    halves = F.when(across, F.array(part(F.col("x0"), F.lit(180.0)), part(F.lit(-180.0), F.col("x1")))).otherwise(F.array(part(F.col("x0"), F.col("x1"))))
    asked = seen.select("view_id", "max_level", "y0", "y1", F.explode(halves).alias("h")).select("view_id", "max_level", "h.x0", "y0", "h.x1", "y1")
    out = [_proper_totals(proper, asked, rows)]

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        """Pairs whose ids say which rows they are, as ids may repeat."""
        row = F.monotonically_increasing_id().alias("row")
        return meet_boxes(a.withColumn("id", F.struct("id", row, "x1")), b.withColumn("view_id", F.struct("view_id", row, "over")))

    views, seen = views.withColumn("over", F.lit(None).cast("double")), seen.withColumn("over", F.col("x0"))
    add = lambda p, sign: p.select("view_id.view_id", F.lit(sign).cast("long").alias("n"), (F.col("id.id") * sign).alias("ids"))
    if odd_rects:
        out.append(add(pairs(rects.where(turned["rects"]), views), 1))
    if odd_views:
        out.append(add(pairs(proper, views.where(turned["views"])), 1))
    if n_wide:  # those that reach from the end of a view's second half to the start of its first
        both = pairs(proper.where(wide), seen.where(across).withColumn("x0", F.col("x1")))
        out.append(add(both.where("id.x1 >= view_id.over"), -1))
    total = reduce(DataFrame.unionByName, out).groupBy("view_id").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))
    return total.where("n > 0")
