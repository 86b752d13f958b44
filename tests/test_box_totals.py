"""Totals of rectangles in views, against plain Python, and that they need no pairs."""

import random

import pytest

from tagloom.operators import boxes, viewport
from tagloom.plans import queries as plans

from . import oracle

SF = "/root/testdata/sf0.001"


def meets(rect, view):
    _, level, x0, y0, x1, y1 = rect
    _, most, a0, b0, a1, b1 = view
    if None in rect[1:] or None in view[1:] or level > most or y0 > b1 or y1 < b0:
        return False
    return any(x0 <= b and x1 >= a for a, b in ([(a0, a1)] if a0 <= a1 else [(a0, 180.0), (-180.0, a1)]))


@pytest.mark.parametrize(("strip", "odd"), [(500_000, True), (7, True), (40, False), (3, False)])
def test_totals_equal_the_pairs(spark, monkeypatch, strip, odd):
    """Edges that touch, points, ties of many rectangles, the world, the date line (with rectangles in both halves), rows that repeat; ``odd``: corners in the wrong order or missing."""
    monkeypatch.setattr(boxes, "STRIP_ROWS", strip)
    rng = random.Random(strip)
    grid = lambda lo, hi: rng.randrange(lo * 4, hi * 4) / 4
    rects = [(i, rng.randrange(5), x, y, x + rng.choice([0, 0, 0.25, 3, 90, 400]), y + rng.choice([0, 0, 0.5, 20])) for i in range(300) for x, y in [(grid(-180, 180), grid(-90, 90))]]
    rects += [(i, i % 5, 10.0, 5.0, 12.0, 6.0) for i in range(1000, 1040)] + [(2000, 3, -180.0, -90.0, 180.0, 90.0), (2001, 0, 180.0, 0.0, 180.0, 0.0), rects[5]]
    views = [(i, rng.randrange(6), x, y, x + rng.choice([0, 0.25, 5, 40]), y + rng.choice([0, 1, 30])) for i in range(80) for x, y in [(grid(-180, 140), grid(-90, 60))]]
    views += [(i, 4, 12.0, 5.5, 20.0, 7.0) for i in range(90, 110)] + [(100, 4, -180.0, -90.0, 180.0, 90.0), (111, 4, 170.0, -20.0, -170.0, 20.0), (112, 3, 179.0, -90.0, -179.0, 90.0), (113, 4, 10.0, -90.0, -10.0, 90.0)]
    if odd:
        rects += [(3000, 1, None, 0.0, 1.0, 1.0), (3001, None, 0.0, 0.0, 1.0, 1.0), (3002, 1, 15.0, 5.0, 11.0, 6.0), (3002, 1, 15.0, 5.0, 11.0, 6.0), (3003, 1, 0.0, 30.0, 100.0, -10.0)]
        views += [(200, None, 0.0, 0.0, 1.0, 1.0), (201, 4, 0.0, 5.75, 20.0, 5.25), (202, 4, 190.0, 0.0, -170.0, 9.0), (203, 4, 170.0, 9.0, -170.0, 0.0), (113, 4, 10.0, -90.0, -10.0, 90.0)]
    want = {}
    for v in views:
        ids = [r[0] for r in rects if meets(r, v)]
        if ids:
            n, total = want.get(v[0], (0, 0))
            want[v[0]] = (n + len(ids), total + sum(ids))
    r = spark.createDataFrame(rects, "id long, lod_level int, x0 double, y0 double, x1 double, y1 double")
    v = spark.createDataFrame(views, "view_id long, max_level int, x0 double, y0 double, x1 double, y1 double")
    got = boxes.box_totals(r, v).collect()
    assert {x.view_id: (x.n, x.ids) for x in got} == want and len(got) == len(want)
    assert boxes.box_totals(r.limit(0), v).count() == 0 and boxes.box_totals(r, v.limit(0)).count() == 0


def test_the_query_makes_no_pairs(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("pairs of rectangles and views")

    monkeypatch.setattr(viewport, "meet_boxes", refuse)
    monkeypatch.setattr(boxes, "meet_boxes", refuse, raising=False)
    assert oracle.compare(spark, plans.QUERIES["extents_in_views"], plans.SQL["extents_in_views"], SF) == ""
