"""Sinks: reports, documents, GeoJSON and the evaluation cache."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_safe_id
from ..model import MAX_SAFE_INTEGER, SCHEMA_VERSION


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_json(df: DataFrame, path: str) -> None:
    """One JSON line for each row, after what is there."""
    df.write.mode("append").json(path)


def stream_json(df: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends a stream as JSON lines, each row once."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def as_document(df: DataFrame, column: str = "document") -> DataFrame:
    """Each row as a JSON document."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(column))


def features(pois: DataFrame) -> DataFrame:
    """GeoJSON point features; rows without geometry are left out. ``name`` is empty where there is none; tags and tag ids are JSON text in the properties."""
    big = F.abs("id") > MAX_SAFE_INTEGER
    props = lambda i: F.struct(i.alias("id"), F.coalesce(F.col("tags")["name"], F.lit("")).alias("name"), F.to_json("tags").alias("tags"), F.to_json("tag_ids").alias("tagIds"))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    one = lambda i: F.to_json(F.struct(F.lit("Feature").alias("type"), i.alias("id"), geometry.alias("geometry"), props(i).alias("properties")))
    return pois.where("lon is not null").select("id", F.when(big, one(json_safe_id(F.col("id")))).otherwise(one(F.col("id"))).alias("feature"))


def feature_collection(pois: DataFrame) -> DataFrame:
    """One collection of the features, in the order of their ids. For viewports, which are capped; larger sets are written as lines of ``features``."""
    f = features(pois).agg(F.sort_array(F.collect_list(F.struct("id", "feature"))).alias("f"))
    return f.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("f", lambda x: x["feature"]), ","), F.lit("]}")).alias("document"))


def role_map(roles: DataFrame) -> DataFrame:
    """The roles (``key, role``) as one map, in the order of their ``place`` if they have one and of their keys otherwise, whichever task has which row."""
    order = ("place", "key") if "place" in roles.columns else ("key",)
    entries = F.transform(F.sort_array(F.collect_list(F.struct(*order, "role"))), lambda x: F.struct(x["key"].alias("key"), x["role"].alias("role")))
    return roles.agg(F.map_from_entries(entries).alias("roles"))


def slim_allowlist(roles: DataFrame, allowlist: DataFrame) -> DataFrame:
    """The slim document: roles (``role_map``) and sorted ids, no counts. One row by definition; an allow-list is small."""
    r = role_map(roles)
    e = allowlist.agg(F.sort_array(F.collect_set("tag_id")).alias("entries"))
    return as_document(r.join(e))


def full_allowlist(roles: DataFrame, allowlist: DataFrame, least: int, least_region: int) -> DataFrame:
    """The full document: thresholds, roles (``role_map``), and the entries with their counts, the most frequent first. One row; an allow-list is small."""
    r = role_map(roles)
    e = allowlist.agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("o"), "tag_id", "key", "value", "count", "count_jp"))).alias("e"))
    e = e.select(F.transform("e", lambda x: x.dropFields("o")).alias("entries"), F.size("e").alias("pairs"))
    return as_document(r.join(e).select(F.lit(least).alias("min_count"), F.lit(least_region).alias("min_count_region"), "pairs", "roles", "entries"))


#: Failed pairs: ``cleared`` rows, without a pair, end what failed before them.
FAILED = "tag_id string, primitive string, kind string, cleared boolean, seq long, lens string"
ROWS = "tag_id string, primitive string, num double, dist array<double>, model string, at timestamp, schema_version int, lens string"


class EvalCache:
    """Evaluations as a Parquet table by schema version and lens. A new version starts empty."""

    def __init__(self, spark: SparkSession, path: str, version: int = SCHEMA_VERSION):
        self.spark, self.path, self.version = spark, path, version

    def put(self, rows: DataFrame) -> bool:
        """Appends ``lens, tag_id, primitive, num, dist, model, at``; the latest row of a key counts. Whether it could be written: a cache that fails costs a question, not the answer."""
        try:
            rows.withColumn("schema_version", F.lit(self.version)).write.mode("append").partitionBy("schema_version", "lens").parquet(self.path)
        except (PySparkException, Py4JJavaError):
            return False
        return True

    def _rows(self) -> DataFrame:
        """What is stored; nothing if the path isn't there yet."""
        try:
            return self.spark.read.schema(ROWS).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], ROWS)

    def load(self, lens: str | None = None) -> DataFrame:
        df = self._rows().where(F.col("schema_version") == self.version)
        return latest(df if lens is None else df.where(F.col("lens") == lens)).drop("schema_version")

    def _failed_rows(self, lens: str) -> DataFrame:
        try:
            rows = self.spark.read.schema(FAILED).parquet(f"{self.path}_failed")
        except AnalysisException:
            rows = self.spark.createDataFrame([], FAILED)
        return rows.where(F.col("lens") == lens)

    def failed(self, lens: str) -> DataFrame:
        """``tag_id, primitive, kind`` that failed since the lens's failures were last cleared."""
        rows = self._failed_rows(lens)
        cleared = rows.where("cleared").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("cleared_at"))
        return rows.where("not cleared").join(F.broadcast(cleared), F.col("seq") > F.col("cleared_at")).groupBy("tag_id", "primitive").agg(F.max_by("kind", "seq").alias("kind"))

    def put_failed(self, rows: DataFrame) -> bool:
        """Appends ``lens, tag_id, primitive, kind``, in one step of the lens's history."""
        return self._step(rows.select("lens", "tag_id", "primitive", "kind", F.lit(False).alias("cleared")))

    def clear_failed(self, lens: str) -> bool:
        """What failed for a lens may be asked again."""
        return self._step(self.spark.createDataFrame([(lens, None, None, None, True)], "lens string, tag_id string, primitive string, kind string, cleared boolean"))

    def _step(self, rows: DataFrame) -> bool:
        try:
            rows.withColumn("seq", F.lit(time.time_ns())).write.mode("append").partitionBy("lens").parquet(f"{self.path}_failed")
        except (PySparkException, Py4JJavaError):
            return False
        return True

    def count(self, lens: str | None = None) -> int:
        return self.load(lens).count()

    def clear(self) -> None:
        self.spark.createDataFrame([], ROWS).write.mode("overwrite").partitionBy("schema_version", "lens").parquet(self.path)
        self.spark.createDataFrame([], FAILED).write.mode("overwrite").partitionBy("lens").parquet(f"{self.path}_failed")

    def compact(self, into: str) -> EvalCache:
        """The latest rows, a file for each lens, at another path, which readers then use."""
        self.load().withColumn("schema_version", F.lit(self.version)).repartition("lens").write.mode("overwrite").partitionBy("schema_version", "lens").parquet(into)
        return EvalCache(self.spark, into, self.version)


def latest(df: DataFrame, *keys: str) -> DataFrame:
    """The latest row (``at``) of each key; ties go to the greatest by the other columns. One aggregate, which tasks begin before the shuffle."""
    by = keys or ("lens", "tag_id", "primitive")
    rest = sorted(c for c in df.columns if c not in by and c != "at")
    top = df.groupBy(*by).agg(F.max(F.struct("at", *rest)).alias("_top"))
    return top.select(*[F.col(c) if c in by else F.col(f"_top.{c}").alias(c) for c in df.columns])
