"""Sources: points of interest, their file's metadata, allow-lists and logs."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import POI_SCHEMA

#: Literal rows with the edge cases that the adapter's rows lack: id, tags, lon, lat, level. A null lon is a null geometry.
EDGE_ROWS = (
    (-1, {"amenity": "yes", "cuisine": "Pizza; pasta ;;PIZZA", "brand": "A;B ", "name": "one"}, 139.7, 35.6, 0),
    (-2, {"brand": " ", "shop": "No", "cuisine": ""}, 135.0, 34.0, 1),
    (-3, {}, 0.0, 0.0, 2),
    (-4, {"unknown": "x", "addr:city": "Y", "addr:street": "Z"}, -60.0, 10.0, 3),
    (-5, {"amenity": "cafe", "shop": "bakery", "tourism": "museum", "name:ja": "名", "name": "two"}, 140.0, 36.0, 16),
    (-6, {"amenity": "cafe", "website": "https://example.org/a", "phone": "+81 3-1234", "wikidata": "Q42"}, None, None, 16),
    (-7, {"cuisine": "Ramen"}, 139.0, 35.0, 9),
    (-8, {"cuisine": " ramen"}, 138.0, 35.0, 9),
    (9007199254740993, {"amenity": "bar", "ele": "12,5", "description": "x" * 41}, 10.0, 50.0, 5),
)


def events_as_pois(spark: SparkSession, sf_dir: str, edges: bool = True) -> DataFrame:
    """One point for each event; its tags come from the event and a part. ``lod_level`` is the id modulo 17."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey < 200").select("p_partkey", "p_name", "p_brand", "p_size")
    j = e.join(F.broadcast(p), F.col("p_partkey") == F.col("event_id") % 200)  # 200 parts at every scale
    tags = F.create_map(F.lit("amenity"), "event_type", F.lit("cuisine"), F.replace("p_name", F.lit(" "), F.lit(";")), F.lit("brand"), "p_brand", F.lit("capacity"), F.col("p_size").cast("string"))
    lon = (F.col("event_id") * 7919) % 36000 / F.lit(100.0) - 180.0
    lat = (F.col("event_id") * 6151) % 18000 / F.lit(100.0) - 90.0
    out = j.select(F.col("event_id").alias("id"), tags.alias("tags"), lon.alias("lon"), lat.alias("lat"), (F.col("event_id") % 17).cast("int").alias("lod_level"))
    if edges:
        rows = spark.createDataFrame(list(EDGE_ROWS), "id long, tags map<string,string>, lon double, lat double, lod_level int")
        out = out.unionByName(rows.withColumn("tags", F.map_from_entries(F.array_sort(F.map_entries("tags")))))  # a Python dict's keys come in any order
    box = F.when(F.col("lon").isNotNull(), F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax")))
    return out.select("id", "tags", "lod_level", "lon", "lat", box.alias("bbox"))


#: Points as they are laid out by level.
POINTS = "id bigint, tags map<string,string>, lon double, lat double, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, lod_level int"


def by_level(pois: DataFrame, degrees: float = 10.0) -> DataFrame:
    """Points in the order of level and of cells of a map grid, so that a file holds few levels and a row group few cells; to be written by level."""
    cell = [F.floor(F.col(c) / degrees) for c in ("lat", "lon")]
    return pois.repartitionByRange("lod_level", *cell).sortWithinPartitions("lod_level", *cell, "id")


def edge_sql() -> str:
    """The same rows as DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def tags(m):
        return "MAP{" + ", ".join(f"{q(k)}: {q(v)}" for k, v in sorted(m.items())) + "}" if m else "map_from_entries([]::STRUCT(k VARCHAR, v VARCHAR)[])"

    num = lambda v: "NULL::DOUBLE" if v is None else f"{v}::DOUBLE"
    return " UNION ALL ".join(f"SELECT {i}::BIGINT, {tags(m)}, {num(x)}, {num(y)}, {z}::INTEGER" for i, m, x, y, z in EDGE_ROWS)


POI_SQL = (
    "poi AS (SELECT e.event_id AS id, MAP{'amenity': e.event_type, 'cuisine': replace(p.p_name, ' ', ';'), 'brand': p.p_brand, 'capacity': p.p_size::VARCHAR} AS tags, "
    "((e.event_id * 7919) % 36000) / 100.0e0 - 180 AS lon, ((e.event_id * 6151) % 18000) / 100.0e0 - 90 AS lat, (e.event_id % 17)::INTEGER AS lod_level "
    f"FROM events e JOIN part p ON p.p_partkey = e.event_id % 200 UNION ALL {edge_sql()})"
)


def footer(path: str) -> tuple[dict, list[dict]]:
    """The ``geo`` metadata of a tiered Parquet file and its row groups' rows, bytes and statistics by column.

    Reads the footer only, on the driver, through the file system that the path names.
    """
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, name = pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)
    meta = pq.ParquetFile(fs.open_input_file(name)).metadata
    geo = json.loads((meta.metadata or {}).get(b"geo", b"{}").decode())
    groups = []
    for g in range(meta.num_row_groups):
        rg = meta.row_group(g)
        for c in range(rg.num_columns):
            col = rg.column(c)
            s = col.statistics if col.is_stats_set else None
            groups.append({"row_group": g, "rows": rg.num_rows, "column": col.path_in_schema, "bytes": col.total_compressed_size, "min": float(s.min) if s and s.has_min_max and isinstance(s.min, float) else None, "max": float(s.max) if s and s.has_min_max and isinstance(s.max, float) else None})
    return geo, groups


def level_ends(geo: dict, groups: list[dict]) -> list[int]:
    """The first row beyond each level: levels are prefixes of the file, and ``row_group_end`` is a level's last row group."""
    rows: dict[int, int] = {g["row_group"]: g["rows"] for g in groups}
    return [sum(n for g, n in rows.items() if g <= lv["row_group_end"]) for lv in geo.get("lod", {}).get("levels", [])]


def read_tiered(spark: SparkSession, path: str) -> DataFrame:
    """A tiered file with ``row_index`` and ``lod_level``, the first level whose rows reach the row's."""
    geo, groups = footer(path)
    ends = level_ends(geo, groups)
    df = spark.read.parquet(path).withColumn("row_index", F.col("_metadata.row_index"))
    level = F.lit(max(len(ends) - 1, 0))
    for i in reversed(range(len(ends))):
        level = F.when(F.col("row_index") < ends[i], i).otherwise(level)
    return df.withColumn("lod_level", level.cast("int"))


def ingest_tiered(spark: SparkSession, path: str, out: str) -> None:
    """Rewrites a tiered file by level, so that a viewport's level prunes folders and its box prunes row groups."""
    df = read_tiered(spark, path)
    df.repartitionByRange("lod_level", "row_index").sortWithinPartitions("lod_level", "row_index").write.mode("overwrite").partitionBy("lod_level").parquet(out)


def read_pois(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POI_SCHEMA).parquet(path)


def read_allowlist(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``tag_role(key, role)`` and ``allowlist(tag_id)`` of a slim allow-list document."""
    doc = spark.read.option("multiLine", True).schema("roles map<string,string>, entries array<string>").json(path)
    return doc.select(F.explode("roles").alias("key", "role")), doc.select(F.explode("entries").alias("tag_id"))


def open_sources(spark: SparkSession, pois: str, allowlist: str) -> tuple[DataFrame, DataFrame, DataFrame, list[dict]]:
    """Points, tag roles, allow-list and the levels of a tiered file, opened together; an allow-list that isn't there is empty, and no tag is then allowed."""
    geo, _ = footer(pois)
    try:
        roles, allowed = read_allowlist(spark, allowlist)
    except AnalysisException:
        roles, allowed = spark.createDataFrame([], "key string, role string"), spark.createDataFrame([], "tag_id string")
    return read_tiered(spark, pois), roles, allowed, geo.get("lod", {}).get("levels", [])


def read_successes(spark: SparkSession, path: str, schema: str, answers: bool = True) -> DataFrame:
    """JSON lines whose status is 200 (and that have answers)."""
    df = spark.read.schema(schema).json(path).where("status = 200")
    return df.where("answers is not null") if answers and "answers" in df.columns else df


def remaining(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs that no successful row of ``done`` covers."""
    return jobs.join(done.where("status = 200").select(*keys).distinct(), keys, "left_anti")
