"""Rectangles against views, and boxes of screens, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions import geo
from tagloom.operators import viewport


@pytest.mark.parametrize(("hot", "rows"), [(1000, 100_000), (10**9, 5)])
def test_boxes_meet_once(spark, monkeypatch, hot, rows):
    """Touching edges count; points, wide boxes, the world, views across the date line, boxes beyond it, equal ids; hot cells in parts."""
    monkeypatch.setattr(viewport, "HOT", hot)
    monkeypatch.setattr(viewport, "CELL_ROWS", rows)
    rng = random.Random(3)
    grid = lambda lo, hi: rng.randrange(lo * 4, hi * 4) / 4
    rects = [(i, rng.randrange(17), x, y, x + rng.choice([0, 0, 0.25, 3, 90, 400]), y + rng.choice([0, 0, 0.5, 20])) for i in range(400) for x, y in [(grid(-180, 180), grid(-90, 90))]]
    rects += [(1000, 3, -180.0, -90.0, 180.0, 90.0), (1001, 3, None, None, None, None), (1002, 3, 180.0, 0.0, 180.0, 0.0), rects[5]]
    views = [(i, rng.randrange(17), x, y, x + rng.choice([0, 0.25, 5, 40]), y + rng.choice([0, 1, 30])) for i in range(60) for x, y in [(grid(-180, 140), grid(-90, 60))]]
    views += [(100, 16, -180.0, -90.0, 180.0, 90.0), (101, 16, 170.0, -20.0, -170.0, 20.0), (102, 5, 179.0, -90.0, -179.0, 90.0)]
    r = spark.createDataFrame(rects, "id long, lod_level int, x0 double, y0 double, x1 double, y1 double")
    v = spark.createDataFrame(views, "view_id long, max_level int, x0 double, y0 double, x1 double, y1 double")
    want = []
    for i, level, x0, y0, x1, y1 in rects:
        for k, most, a0, b0, a1, b1 in views:
            if x0 is not None and level <= most and y0 <= b1 and y1 >= b0:
                parts = [(a0, a1)] if a0 <= a1 else [(a0, 180.0), (-180.0, a1)]
                if any(x0 <= q and x1 >= p for p, q in parts):
                    want.append((k, i))
    got = sorted(map(tuple, viewport.meet_boxes(r, v).collect()))
    # a rectangle that repeats counts each time, but for views across the date line
    across = {k for k, _, a, _, b, _ in views if a > b}
    assert got == sorted([*(w for w in want if w[0] not in across), *{w for w in want if w[0] in across}])
    assert viewport.meet_boxes(r.limit(0), v).count() == 0 and viewport.meet_boxes(r, v.limit(0)).count() == 0


def test_screen_boxes_are_the_scalar_ones(spark):
    rows = [(139.7, 35.6, 14.0, 1280, 800), (0.0, 0.0, 0.0, 512, 512), (-60.5, -70.25, 3.5, 640, 480), (10.0, 84.0, 9.0, 100, 3000)]
    df = geo.screen_boxes(spark.createDataFrame(rows, "lon double, lat double, zoom double, width int, height int"))
    for r in df.collect():
        assert (r.x0, r.y0, r.x1, r.y1) == pytest.approx(geo.viewport_bbox(r.lon, r.lat, r.zoom, r.width, r.height))
        assert r.degrees_a_pixel == pytest.approx(geo.degrees_per_pixel(r.zoom))
    assert df.where(F.col("lat") == 0).first().y1 == pytest.approx(85.0511287)
