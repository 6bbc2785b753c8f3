"""Snapshot sink."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file that readers of a snapshot's folder see, and the hidden folder of all that was ever written.
CURRENT = "current.json"
VERSIONS = "_versions"


def metric_columns(df: DataFrame, names: Mapping[str, str]) -> list[Column]:
    """Columns ``{new name: column}``, counting an absent or NULL metric as 0."""
    present = {c.lower() for c in df.columns}
    return [
        (F.coalesce(F.col(column), F.lit(0)) if column.lower() in present else F.lit(0)).cast("bigint").alias(name)
        for name, column in names.items()
    ]


def rename_metrics(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.select(*metric_columns(df, names))


def write_snapshot(snapshot: DataFrame, path: str) -> str:
    """Write the one-row snapshot as a new version and make it the one that readers of ``path`` see.

    ``path`` shows one JSON file. The version is written beside it, out of sight, and only when it is complete does
    a single rename put it in the last one's place, so readers find the old snapshot or the new one, and a job that
    dies half way leaves the old one as it was. Versions stay; the new one's folder is returned.
    """
    spark = snapshot.sparkSession
    version = f"{path}/{VERSIONS}/{uuid.uuid4().hex}"
    snapshot.coalesce(1).write.json(version)
    fs, at = _file_system(spark, path)
    (part,) = [s.getPath() for s in fs.listStatus(at(version)) if s.getPath().getName().startswith("part-")]
    ready = at(f"{path}/_{uuid.uuid4().hex}")
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, part, fs, ready, False, spark._jsc.hadoopConfiguration())
    _swap(spark, ready, at(f"{path}/{CURRENT}"))
    # Files of a folder that was not written in versions.
    for s in fs.listStatus(at(path)):
        if s.isFile() and s.getPath().getName().startswith("part-"):
            fs.delete(s.getPath(), False)
    return version


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The last complete snapshot."""
    return spark.read.json(f"{path}/{CURRENT}")


def snapshot_versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of the complete versions, the oldest first."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at(f"{path}/{VERSIONS}")):
        return []
    found = [(fs.getFileStatus(done).getModificationTime(), str(s.getPath())) for s in fs.listStatus(at(f"{path}/{VERSIONS}")) if fs.exists(done := at(f"{s.getPath()}/_SUCCESS"))]
    return [version for _, version in sorted(found)]


def _file_system(spark: SparkSession, path: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _swap(spark: SparkSession, ready, current) -> None:
    """Rename over what is there, as one operation of the file system."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(ready, current, options)
