"""Tiered files: points in files of a bounded number of rows, coarse levels first in each, whose footers tell where a level ends.

A level is a prefix of the file, so the level of a row follows from its place, and a viewport reads the row groups of its levels that
its box meets. Files are written and read in tasks, through the file systems that Arrow knows by the path's scheme.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import intersects, level_resolution
from ..operators import distribute
from ..operators.viewport import Viewport, meet_boxes
from .poi import level_ends

#: Levels of a pyramid.
LEVELS = 17
#: Rows of a file and of a row group.
FILE_ROWS, GROUP_ROWS = 2_000_000, 50_000
#: Ends of levels are broadcast for up to so many files (some 150 bytes each) and joined by a shuffle beyond.
FEW_FILES = 50_000
ROW_TYPES = {"id": "bigint", "tags": "map<string,string>", "lon": "double", "lat": "double", "bbox": "struct<xmin:double,ymin:double,xmax:double,ymax:double>"}
FOOTER = "path string, row_group int, lod_level int, rows long, first_row long, bytes long, boxes long, xmin double, ymin double, xmax double, ymax double"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


def files_of(pois: DataFrame, file_rows: int = FILE_ROWS, degrees: float = 10.0) -> DataFrame:
    """``pois`` with ``file``, the number of its file: ranks in the order of map cells and ids, cut at every ``file_rows``.

    However many points a cell or an id has, no file has more rows. Points without a place come last; rows of one id go by their tags.
    """
    cells = [F.floor(F.col(c) / degrees).asc_nulls_last() for c in ("lat", "lon")]
    ranked = distribute.global_rank(pois.select(*ROW_TYPES, "lod_level"), *cells, F.col("id").asc(), F.to_json("tags"), name="_rank")
    return ranked.withColumn("file", F.floor(F.col("_rank") / file_rows).cast("long")).drop("_rank")


class _File:
    """One tiered file as it is written; a row group holds one level."""

    def __init__(self, out: str, number: int, group_rows: int):
        self.fs, self.root = _open(out)
        self.name, self.group_rows = f"part-{number:09}.parquet", group_rows
        self.hidden = f"{self.root}/_{uuid.uuid4().hex}"
        self.held: list[pa.RecordBatch] = []
        self.level, self.groups, self.ends, self.writer = 0, 0, [-1] * LEVELS, None

    def add(self, level: int, rows: pa.RecordBatch) -> None:
        if level != self.level:
            self.flush()
            self.level = level
        while rows.num_rows:
            room = self.group_rows - sum(r.num_rows for r in self.held)
            self.held.append(rows.slice(0, room))
            rows = rows.slice(room)
            if rows.num_rows or self.held[-1].num_rows == room:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        group = pa.Table.from_batches(self.held)
        if self.writer is None:
            self.stream = self.fs.open_output_stream(self.hidden)
            self.writer = pq.ParquetWriter(self.stream, group.schema, compression="zstd")
        self.writer.write_table(group, row_group_size=self.group_rows)
        for k in range(self.level, LEVELS):
            self.ends[k] = self.groups
        self.groups, self.held = self.groups + 1, []

    def close(self) -> None:
        """Ends the file. It gets its name at once and whole, so an attempt that broke off or came twice leaves no other rows."""
        self.flush()
        levels = [{"resolution": level_resolution(k), "row_group_end": end} for k, end in enumerate(self.ends)]
        self.writer.add_key_value_metadata({"geo": json.dumps({"version": "1.1.0", "lod": {"levels": levels}})})
        self.writer.close()
        self.stream.close()
        self.fs.move(self.hidden, f"{self.root}/{self.name}")


def write_tiered(pois: DataFrame, out: str, file_rows: int = FILE_ROWS, group_rows: int = GROUP_ROWS) -> None:
    """Writes points (``id, tags, lon, lat, bbox, lod_level``) as tiered files into the new folder ``out``; other columns are left out.

    Levels below 0 are 0; those beyond the last, or null, are the last. Without rows the folder stays empty. A task holds a row group at a time.
    """
    fs, root = _open(out)
    fs.create_dir(root)
    level = F.greatest(F.lit(0), F.least(F.coalesce("lod_level", F.lit(LEVELS - 1)), F.lit(LEVELS - 1))).cast("int")
    rows = files_of(pois, file_rows).withColumn("lod_level", level).repartition("file").sortWithinPartitions("file", "lod_level", "id", F.to_json("tags"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, n = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            file, lv = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("file", "lod_level"))
            data = b.select(list(ROW_TYPES))
            edges = np.flatnonzero((np.diff(file) != 0) | (np.diff(lv) != 0)) + 1
            for a, z in pairwise([0, *edges.tolist(), b.num_rows]):
                if file[a] != number:
                    if now:
                        now.close()
                        n += 1
                    number = int(file[a])
                    now = _File(out, number, group_rows)
                now.add(int(lv[a]), data.slice(a, z - a))
        if now:
            now.close()
            n += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    rows.mapInArrow(write, "files long").agg(F.sum("files")).collect()  # one number


def footers(spark: SparkSession, folder: str) -> DataFrame:
    """The row groups of all tiered files of a folder, from their footers, which tasks read: ``FOOTER``.

    ``boxes`` is the number of rows that have a box, ``bytes`` their compressed size, ``first_row`` the place of its first row in the file.
    A file without levels is all level 0; a row group beyond the last level's end has that level. An empty folder gives no rows.
    """
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select(F.col("_metadata.file_path").alias("path"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                fs, name = _open(path)
                with fs.open_input_file(name) as stream:
                    meta = pq.ParquetFile(stream).metadata
                geo = json.loads((meta.metadata or {}).get(b"geo", b"{}").decode())
                counts = [{"row_group": g, "rows": meta.row_group(g).num_rows} for g in range(meta.num_row_groups)]
                ends, out, first = np.array(level_ends(geo, counts) or [meta.num_rows]), [], 0
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    columns = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
                    corner = {}
                    for c, side in (("xmin", "min"), ("ymin", "min"), ("xmax", "max"), ("ymax", "max")):
                        stats = columns[f"bbox.{c}"].statistics
                        corner[c] = getattr(stats, side) if stats is not None and stats.has_min_max else None
                    stats = columns["bbox.xmin"].statistics
                    boxes = stats.num_values if stats is not None else None
                    level = min(int(np.searchsorted(ends, first, "right")), len(ends) - 1)
                    size = sum(c.total_compressed_size for c in columns.values())
                    out.append({"path": path, "row_group": g, "lod_level": level, "rows": group.num_rows, "first_row": first, "bytes": size, "boxes": boxes} | corner)
                    first += group.num_rows
                yield pd.DataFrame(out, columns=[c.split()[0] for c in FOOTER.split(", ")])

    return paths.mapInPandas(read, FOOTER)


def levels(groups: DataFrame) -> DataFrame:
    """``lod_level, rows, row_end`` of all files together from their row groups: a row for each level, and the running sum over them."""
    n = groups.groupBy("lod_level").agg(F.sum("rows").alias("rows"))
    return n.select("lod_level", "rows", F.sum("rows").over(Window.orderBy("lod_level").rowsBetween(Window.unboundedPreceding, 0)).alias("row_end"))  # LEVELS rows


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All rows with ``path``, ``row_index`` (the place in the file) and ``lod_level``, the level whose part of the file holds the place."""
    steps = F.sort_array(F.collect_list(F.struct("end", "lod_level")))
    ends = footers(spark, folder).groupBy("path", "lod_level").agg(F.max(F.col("first_row") + F.col("rows")).alias("end")).groupBy("path").agg(steps.alias("steps"))
    ends = distribute.cut(ends)
    ends = F.broadcast(ends) if ends.count() <= FEW_FILES else ends.hint("merge")
    types = ", ".join(f"{c} {t}" for c, t in ROW_TYPES.items())
    rows = spark.read.schema(types).parquet(folder).select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_index"))
    level = F.filter("steps", lambda s: s["end"] > F.col("row_index"))[0]["lod_level"]
    return rows.join(ends, "path").withColumn("lod_level", level).drop("steps")


def meets(view: Viewport):
    """Row groups of a view's levels whose box meets the view's."""
    x0, y0, x1, y1 = view.bbox
    return (F.col("lod_level") <= view.max_level) & (F.col("xmax") >= x0) & (F.col("xmin") <= x1) & (F.col("ymax") >= y0) & (F.col("ymin") <= y1)


def read_groups(groups: DataFrame, *columns: str) -> DataFrame:
    """The rows of row groups (``path, row_group, lod_level``), with these three columns and ``columns``. Only these groups' and columns' bytes are read, in tasks of a few groups each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.to_pylist():
                fs, name = _open(g["path"])
                with fs.open_input_file(name) as stream:
                    for rows in pq.ParquetFile(stream).iter_batches(10_000, row_groups=[g["row_group"]], columns=list(columns)):
                        n = rows.num_rows
                        own = [pa.array([g["path"]] * n, pa.string()), *[pa.array(np.full(n, g[c], np.int32)) for c in ("row_group", "lod_level")]]
                        data = [rows.column(rows.schema.get_field_index(c)) for c in columns]
                        yield pa.RecordBatch.from_arrays([*own, *data], ["path", "row_group", "lod_level", *columns])

    types = ", ".join(f"{c} {ROW_TYPES[c]}" for c in columns)
    return groups.select("path", "row_group", "lod_level").repartition("path", "row_group").mapInArrow(read, f"path string, row_group int, lod_level int, {types}")


def read_view(spark: SparkSession, folder: str, view: Viewport, *columns: str) -> DataFrame:
    """The rows of a view: row groups by the footers, rows by their boxes."""
    wanted = list(dict.fromkeys([*columns, "bbox"]))
    return read_groups(footers(spark, folder).where(meets(view)), *wanted).where(intersects("bbox", view.bbox)).select(*columns, "lod_level")


def count_view(spark: SparkSession, folder: str, view: Viewport, cap: int) -> DataFrame:
    """``total, capped`` of a view: row groups that lie in it whole are counted by their footers, only those at its border are read."""
    x0, y0, x1, y1 = view.bbox
    whole = (F.col("xmin") >= x0) & (F.col("xmax") <= x1) & (F.col("ymin") >= y0) & (F.col("ymax") <= y1) & F.col("boxes").isNotNull()
    near = distribute.cut(footers(spark, folder).where(meets(view)).withColumn("whole", whole))
    border = read_groups(near.where("not whole"), "bbox").where(intersects("bbox", view.bbox)).select(F.lit(1).cast("long").alias("n"))
    n = near.where("whole").select(F.col("boxes").alias("n")).unionByName(border).agg(F.least(F.coalesce(F.sum("n"), F.lit(0)), F.lit(cap)).cast("long").alias("total"))
    return n.select("total", (F.col("total") >= cap).alias("capped"))


def count_views(spark: SparkSession, folder: str, requests: DataFrame, cap: int) -> DataFrame:
    """``session, request_id, level, count, capped`` for each of many requests (``session, request_id, x0, y0, x1, y1, max_level``), which the answers are told apart by.

    Requests meet the boxes of row groups. Groups that lie in a view whole count by their footers; those at the border of any view are read once,
    and only their rows meet the views. A view with ``x0 > x1`` crosses the date line. A request that comes twice is answered twice;
    one without corners or level counts 0.
    """
    asked = distribute.cut(requests.select("session", "request_id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "max_level").withColumn("view_id", F.monotonically_increasing_id()))
    groups = distribute.cut(footers(spark, folder).where("xmin is not null").withColumn("id", F.struct("path", "row_group")))
    rects = groups.select("id", "lod_level", *[F.col(a).alias(b) for a, b in (("xmin", "x0"), ("ymin", "y0"), ("xmax", "x1"), ("ymax", "y1"))])
    met = meet_boxes(rects, asked.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null and max_level is not null"))
    met = met.join(groups, "id").join(asked.select("view_id", "x0", "y0", "x1", "y1"), "view_id")
    aside = "case when x0 <= x1 then xmin >= x0 and xmax <= x1 else xmin >= x0 or xmax <= x1 end"
    met = distribute.cut(met.withColumn("whole", F.expr(f"{aside} and ymin >= y0 and ymax <= y1 and boxes is not null")))
    edge = met.where("not whole").select("view_id", "path", "row_group", "x0", "y0", "x1", "y1")
    read = read_groups(met.where("not whole").select("path", "row_group", "lod_level").distinct(), "bbox")
    inside = "case when x0 <= x1 then bbox.xmax >= x0 and bbox.xmin <= x1 else bbox.xmax >= x0 or bbox.xmin <= x1 end and bbox.ymax >= y0 and bbox.ymin <= y1"
    border = read.join(edge, ["path", "row_group"]).where(inside).groupBy("view_id").agg(F.count("*").alias("n"))
    n = met.where("whole").select("view_id", F.col("boxes").alias("n")).unionByName(border).groupBy("view_id").agg(F.sum("n").alias("n"))
    count = F.least(F.coalesce("n", F.lit(0)), F.lit(cap)).cast("long")
    return asked.join(n, "view_id", "left").select("session", "request_id", F.col("max_level").alias("level"), count.alias("count"), (count >= cap).alias("capped"))
