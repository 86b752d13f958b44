"""Viewport reads."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import intersects, resolve_level
from ..model import COUNT_CAP, VIEWPORT_CAP
from .distribute import HOT, cut


@dataclass(frozen=True)
class Viewport:
    """A box (lon, lat, lon, lat) and the finest level to read."""

    bbox: tuple[float, float, float, float]
    max_level: int


def inside(pois: DataFrame, view: Viewport) -> DataFrame:
    """Rows of the levels up to the view's whose box meets it. Both conditions reach the scan."""
    return pois.where((F.col("lod_level") <= view.max_level) & intersects("bbox", view.bbox))


def read_viewport(pois: DataFrame, view: Viewport, cap: int = VIEWPORT_CAP, order: tuple[str, ...] = ("lod_level", "id")) -> DataFrame:
    """At most ``cap`` rows, coarse levels first, so that a cut always falls on the finest level."""
    return inside(pois, view).orderBy(*order).limit(cap)


def view_for(bbox: tuple[float, float, float, float], resolutions: Sequence[float], degrees_a_pixel: float, offset: int = 0) -> Viewport:
    """The viewport of a screen: its box, and the level for its resolution and the user's offset."""
    return Viewport(bbox, resolve_level(resolutions, degrees_a_pixel, offset))


def view_result(pois: DataFrame, view: Viewport, occ_of: Callable[[DataFrame], DataFrame], allowlist: DataFrame, cap: int = VIEWPORT_CAP) -> DataFrame:
    """What a read says beside its rows: ``level, count, truncated, dropped_tag_kinds``.

    ``count`` is of the rows that have a geometry; ``truncated`` if the cap is reached, exactly or not.
    ``dropped_tag_kinds`` is the number of different tags that the allow-list lacks.
    """
    rows = read_viewport(pois, view, cap)
    gone = occ_of(rows.where("lon is not null")).join(allowlist.select("tag_id"), "tag_id", "left_anti").agg(F.countDistinct("tag_id").alias("dropped_tag_kinds"))
    n = rows.agg(F.count("lon").alias("count"), (F.count("*") >= cap).alias("truncated"))
    return n.join(gone).select(F.lit(view.max_level).alias("level"), "count", "truncated", "dropped_tag_kinds")


def count_viewport(pois: DataFrame, view: Viewport, cap: int = COUNT_CAP) -> DataFrame:
    """``total, capped`` from the box and the level alone; ``capped`` also when exactly at the cap."""
    n = inside(pois.select("bbox", "lod_level"), view).limit(cap).agg(F.count("*").alias("total"))
    return n.select("total", (F.col("total") >= cap).alias("capped"))


def row_group_bytes(groups: DataFrame, q: tuple[float, float, float, float], bbox: str = "bbox") -> DataFrame:
    """``column, bytes, share`` that a viewport reads, from row-group statistics (``row_group, rows, column, bytes, min, max``)."""
    stat = lambda c, f: F.max(F.when(F.col("column") == f"{bbox}.{c}", F.col(f)))
    hit = groups.groupBy("row_group").agg(stat("xmin", "min").alias("x0"), stat("xmax", "max").alias("x1"), stat("ymin", "min").alias("y0"), stat("ymax", "max").alias("y1"))
    hit = hit.where((F.col("x1") >= q[0]) & (F.col("x0") <= q[2]) & (F.col("y1") >= q[1]) & (F.col("y0") <= q[3])).select("row_group")
    by = groups.join(hit, "row_group", "left_semi").groupBy("column").agg(F.sum("bytes").alias("bytes"))
    total = by.agg(F.sum("bytes").alias("total"))
    return by.join(total).select("column", "bytes", F.round(F.col("bytes") / F.col("total"), 6).alias("share"))


def cut_views(pois: DataFrame, views: DataFrame, *more: str) -> DataFrame:
    """``view_id, id`` (and ``more`` columns of the points) for many views (``view_id, x0, y0, x1, y1, max_level``) at once: an equi-join on one-degree cells, then the exact test.

    A view enters every cell it touches and a point one cell, so no pair is met twice.
    """
    cell = lambda c: F.floor(c).cast("int")
    v = views.withColumn("cx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1")))))
    p = pois.where("bbox is not null").select("id", *more, "lod_level", "lon", "lat", cell(F.col("lon")).alias("cx"), cell(F.col("lat")).alias("cy"))
    j = p.join(v, ["cx", "cy"]).where("lon between x0 and x1 and lat between y0 and y1 and lod_level <= max_level")
    return j.select("view_id", "id", *more)


#: Cells of a side of 360 / 2**level degrees.
FINEST = 12
#: Rectangles of a part of a hot cell.
CELL_ROWS = 100_000


def _cells(rects: DataFrame, levels: list[int]) -> DataFrame:
    """``rects`` (``x0, y0, x1, y1``) in the cells ``lv, cx, cy`` that they touch at their own level (``own``) and at those of ``levels`` above it.

    A rectangle's own level is the finest whose cells are as large as it, so it touches four cells of a level at most.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    mine = F.when(side > 0, F.least(F.lit(FINEST), F.greatest(F.lit(0), F.floor(F.log2(360.0 / F.when(side > 0, side)))))).otherwise(FINEST).cast("int")
    r = rects.withColumn("_own", mine)
    up = F.filter(F.lit(levels).cast("array<int>"), lambda k: k < F.col("_own"))
    r = r.withColumn("lv", F.explode(F.concat(F.array("_own"), up)))
    at = lambda c, low: F.floor((F.col(c) + low) / (360.0 / F.pow(F.lit(2.0), F.col("lv"))))
    r = r.withColumn("cx", F.explode(F.sequence(at("x0", 180.0), at("x1", 180.0)))).withColumn("cy", F.explode(F.sequence(at("y0", 90.0), at("y1", 90.0))))
    return r.withColumn("own", F.col("lv") == F.col("_own")).drop("_own")


def meet_boxes(rects: DataFrame, views: DataFrame) -> DataFrame:
    """``view_id, id`` of all rectangles (``id, lod_level, x0, y0, x1, y1``) and views (``view_id, max_level`` and the same corners) that touch or overlap, each pair once.

    Both sides lie in cells of several sizes: each in those of its own size, and in the larger ones that the other side uses. So two meet at the
    level of the larger one, in a few cells each, however large a view is. Of the cells in which two meet, the one that holds
    the lower left corner of what they share counts. Cells that hold over a ``HOT``-th of the rectangles are dealt to parts, each with
    the cell's views. A view with ``x0 > x1`` crosses the date line: it is cut in two, and a rectangle in both parts
    counts once. Rectangles without corners meet nothing.
    """
    rects = rects.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null").select("id", "lod_level", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    across = F.col("x0") > F.col("x1")
    part = lambda a, b, cut_: F.struct(a.alias("x0"), b.alias("x1"), F.lit(cut_).alias("across"))
    halves = F.when(across, F.array(part(F.col("x0"), F.lit(180.0), True), part(F.lit(-180.0), F.col("x1"), True))).otherwise(F.array(part(F.col("x0"), F.col("x1"), False)))
    v = views.withColumn("h", F.explode(halves)).select("view_id", "max_level", F.col("h.x0").alias("x0"), "y0", F.col("h.x1").alias("x1"), "y1", F.col("h.across").alias("across"))
    levels = lambda df: sorted(r[0] for r in df.select("lv").distinct().collect())  # noqa: E731  FINEST + 1 at most
    mine = cut(_cells(rects, levels(_cells(v, []))))
    seen = _cells(v, levels(_cells(rects, [])))
    key = ("lv", "cx", "cy")
    total = mine.count()
    hot = mine.groupBy(*key).agg(F.count("*").alias("n")).where((F.col("n") * HOT > total) & (F.col("n") > CELL_ROWS))
    hot = F.broadcast(rects.sparkSession.createDataFrame([(*r[:3], -(-r["n"] // CELL_ROWS)) for r in hot.collect()], "lv int, cx long, cy long, parts int"))  # fewer than HOT
    mine = mine.join(hot, list(key), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    seen = seen.join(hot, list(key), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    a, b = mine.alias("a"), seen.alias("b")
    same = F.lit(True)
    for c in (*key, "part"):
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    j = a.join(b, same).where("(a.own or b.own) and a.x0 <= b.x1 and a.x1 >= b.x0 and a.y0 <= b.y1 and a.y1 >= b.y0 and a.lod_level <= b.max_level")
    size = 360.0 / F.pow(F.lit(2.0), F.col("a.lv"))
    here = (F.floor((F.greatest("a.x0", "b.x0") + 180.0) / size) == F.col("a.cx")) & (F.floor((F.greatest("a.y0", "b.y0") + 90.0) / size) == F.col("a.cy"))
    j = j.where(here).select("b.view_id", "a.id", "b.across")
    return j.where("not across").select("view_id", "id").unionByName(j.where("across").select("view_id", "id").distinct())


def step_totals(pois: DataFrame, steps: DataFrame) -> DataFrame:
    """``view_id, rows, new_rows``: rows in each step of a session and those that no step before it had."""
    seen = cut_views(pois, steps)
    first = seen.groupBy("id").agg(F.min("view_id").alias("view_id")).groupBy("view_id").agg(F.count("*").alias("new_rows"))
    every = seen.groupBy("view_id").agg(F.count("*").alias("rows")).join(first, "view_id", "left")
    return steps.select("view_id").join(every, "view_id", "left").select("view_id", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("new_rows", F.lit(0)).alias("new_rows"))


def step_bytes(pois: DataFrame, steps: DataFrame, size: str) -> DataFrame:
    """``view_id, bytes, new_bytes``: what each step of a session reads, and what no step before it has read. ``size`` is a column of bytes."""
    seen = cut_views(pois, steps, size).withColumnRenamed(size, "size")
    first = seen.groupBy("id").agg(F.min("view_id").alias("view_id"), F.first("size").alias("size")).groupBy("view_id").agg(F.sum("size").alias("new_bytes"))
    every = seen.groupBy("view_id").agg(F.sum("size").alias("bytes")).join(first, "view_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return steps.select("view_id").join(every, "view_id", "left").select("view_id", none("bytes"), none("new_bytes"))


def level_bounds(pois: DataFrame) -> DataFrame:
    """``lod_level, rows, row_end``: running sums over the few levels."""
    n = pois.groupBy("lod_level").agg(F.count("*").alias("rows"))
    return n.select("lod_level", "rows", F.sum("rows").over(Window.orderBy("lod_level").rowsBetween(Window.unboundedPreceding, 0)).alias("row_end"))
