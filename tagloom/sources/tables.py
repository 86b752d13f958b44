"""Tables that are built once for an input and read from then on: allow-list, tag set, tags of points."""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_BUILT: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, which only a single machine may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return folder or tempfile.mkdtemp(prefix="tagloom-")


def stamp(spark: SparkSession, source: str) -> str:
    """A digest of the names, sizes and times of an input's files, through Spark's file systems."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.md5("\n".join([source, *sorted(found)]).encode()).hexdigest()


def built_once(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame], partition_by: tuple[str, ...] = (), schema: str | None = None, bucket_by: tuple[str, ...] = ()) -> DataFrame:
    """``make()`` as a Parquet table in the shared folder, written at the first use in an application for a ``source`` (the input's path) as it is then; after its files change it is written anew.

    With ``bucket_by`` it is a bucketed table, a file for each bucket, and grouping or joining by these columns needs no shuffle.
    """
    app = spark.sparkContext.applicationId
    key = (app, stamp(spark, source), name)
    if key not in _BUILT:
        path = f"{shared_folder(spark)}/tables/{app}/{key[1]}/{name}"
        if bucket_by:
            n = int(spark.conf.get("spark.sql.shuffle.partitions"))
            table = f"built_{name}_{hashlib.md5(path.encode()).hexdigest()}"
            make().repartition(n, *bucket_by).write.mode("overwrite").bucketBy(n, *bucket_by).sortBy(*bucket_by).option("path", path).saveAsTable(table)
            _BUILT[key] = table
        else:
            make().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
            _BUILT[key] = path
    if bucket_by:
        return spark.table(_BUILT[key])
    return (spark.read.schema(schema) if schema else spark.read).parquet(_BUILT[key])


def folder_once(spark: SparkSession, source: str, name: str, fill: Callable[[str], None]) -> str:
    """A folder that ``fill(path)`` fills at the first use in an application for a ``source`` as it is then."""
    app = spark.sparkContext.applicationId
    key = (app, stamp(spark, source), name)
    if key not in _BUILT:
        path = f"{shared_folder(spark)}/tables/{app}/{key[1]}/{name}"
        fill(path)
        _BUILT[key] = path
    return _BUILT[key]
