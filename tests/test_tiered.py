"""Tiered files written and read in tasks: whole rows back, bounded files, row groups of one level, views by row groups."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tagloom.operators.viewport import Viewport
from tagloom.sources import poi, tiered

T = "id long, tags map<string,string>, lon double, lat double, lod_level int, file string, path string"


def points(spark, rows):
    box = F.when(F.col("lon").isNotNull(), F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax")))
    return spark.createDataFrame(rows, T).withColumn("bbox", box)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two thirds of the points in one cell, rows without ids, places, tags or levels, repeated rows, levels beyond the ends, clashing columns."""
    rows = [(i, {"a": "b"}, 5.0, 5.0, i % 17, "x", "y") for i in range(2000)] + [(i, {"n": str(i)}, i % 360 - 180.0, i % 170 - 85.0, i % 5, "x", "y") for i in range(2000, 2900)]
    rows += [(None, {"k": str(i)}, 5.0, 5.0, 3, None, None) for i in range(50)] + [(7, None, None, None, None, None, None)] * 2 + [(8, {}, 1.0, 1.0, -4, None, None), (9, {}, 1.0, 1.0, 99, None, None)]
    out = str(tmp_path_factory.mktemp("tiered") / "out")
    tiered.write_tiered(points(spark, rows), out, file_rows=400, group_rows=60)
    return out, rows


def test_rows_come_back_whole(spark, folder):
    out, rows = folder
    got = sorted(repr((r.id, r.tags, r.lon, r.lat, r.lod_level)) for r in tiered.read_rows(spark, out).collect())
    want = sorted(repr((*r[:4], 16 if r[4] is None else min(max(r[4], 0), 16))) for r in rows)
    assert got == want


def test_files_and_groups_are_bounded(spark, folder):
    out, rows = folder
    g = tiered.footers(spark, out)
    files = [r["n"] for r in g.groupBy("path").agg(F.sum("rows").alias("n")).collect()]
    assert sorted(files) == [len(rows) % 400, *[400] * (len(rows) // 400)] and g.agg(F.max("rows")).first()[0] <= 60
    path = g.orderBy("path").first().path
    mine = g.where(F.col("path") == path).orderBy("row_group").collect()
    geo, groups = poi.footer(path)
    assert [x["row_group_end"] for x in geo["lod"]["levels"]] == [max((r.row_group for r in mine if r.lod_level <= k), default=-1) for k in range(17)]
    assert [r.lod_level for r in mine] == sorted(r.lod_level for r in mine) and poi.level_ends(geo, groups)[-1] == 400
    assert {(r.row_index, r.lod_level) for r in poi.read_tiered(spark, path).select("row_index", "lod_level").collect()} == {(r.row_index, r.lod_level) for r in tiered.read_rows(spark, out).where(F.col("path") == path).collect()}


@pytest.mark.parametrize("view", [Viewport((0.0, 0.0, 10.0, 10.0), 3), Viewport((-180.0, -90.0, 180.0, 90.0), 16), Viewport((100.5, 10.0, 100.6, 80.0), 16), Viewport((5.0, 5.0, 5.0, 5.0), 0)])
def test_views_and_counts(spark, folder, view):
    out, rows = folder
    x0, y0, x1, y1 = view.bbox
    level = lambda r: 16 if r[4] is None else min(max(r[4], 0), 16)
    want = [(r[0], r[2], level(r)) for r in rows if r[2] is not None and x0 <= r[2] <= x1 and y0 <= r[3] <= y1 and level(r) <= view.max_level]
    got = [(r.id, r.lon, r.lod_level) for r in tiered.read_view(spark, out, view, "id", "lon").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert tuple(tiered.count_view(spark, out, view, 10_000).first()) == (len(want), False)
    assert tuple(tiered.count_view(spark, out, view, 1).first()) == (min(len(want), 1), len(want) >= 1)


def test_a_second_attempt_leaves_the_same_files(spark, folder):
    out, rows = folder
    before = sorted(map(tuple, tiered.footers(spark, out).collect()), key=repr)
    tiered.write_tiered(points(spark, rows), out, file_rows=400, group_rows=60)
    assert sorted(map(tuple, tiered.footers(spark, out).collect()), key=repr) == before


def test_joined_by_a_shuffle_beyond_few_files(spark, folder, monkeypatch):
    monkeypatch.setattr(tiered, "FEW_FILES", 1)
    assert tiered.read_rows(spark, folder[0]).count() == len(folder[1])


def test_no_rows_and_files_without_levels(spark, tmp_path):
    tiered.write_tiered(points(spark, []), str(tmp_path / "none"))
    world = Viewport((-180.0, -90.0, 180.0, 90.0), 16)
    assert tiered.footers(spark, str(tmp_path / "none")).count() == 0 and tiered.read_rows(spark, str(tmp_path / "none")).count() == 0
    assert tuple(tiered.count_view(spark, str(tmp_path / "none"), world, 5).first()) == (0, False)
    plain = points(spark, [(1, {}, 1.0, 1.0, 5, "", ""), (2, {}, None, None, 5, "", "")]).select(*tiered.ROW_TYPES)
    plain.coalesce(1).write.parquet(str(tmp_path / "plain"))
    assert [(r.rows, r.lod_level, r.boxes) for r in tiered.footers(spark, str(tmp_path / "plain")).collect()] == [(2, 0, 1)]
    assert {(r.id, r.lod_level) for r in tiered.read_rows(spark, str(tmp_path / "plain")).collect()} == {(1, 0), (2, 0)}
    assert pq.ParquetFile(next((tmp_path / "plain").glob("*.parquet"))).metadata.num_row_groups == 1
