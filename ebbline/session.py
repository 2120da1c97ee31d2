"""Session settings and the shared scratch area.

Intermediate tables that several jobs read are written as Parquet below
``spark.checkpoint.dir``.  A written table survives the loss of an executor
and keeps column pruning, which a cached or locally checkpointed frame does not.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "ebbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow switched on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {key.replace("__", "."): value for key, value in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, for a cluster on which it is not installed."""
    package, folder = Path(__file__).resolve().parent, tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors may fetch the file at any time
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; without the setting there is no safe place."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/ebbline/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder of this application."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to scratch once and read it back, cutting its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> bool:
    """Remove all that this application has staged; frames that read it are of no use afterwards.

    For the end of a job: nothing else removes the folder.
    """
    return remove(spark, _own_folder(spark))


def remove(spark: SparkSession, folder: str) -> bool:
    """Delete a folder on any Hadoop file system; says whether it was there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file, which either is there or is not."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True).close()


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(status.getPath().toString() for status in found or [])


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer partitions than cores one for each core; leave others as they are.

    For costly work per row on a few files.  ``df`` must be a narrow plan:
    asking a plan with shuffles for its partitions would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
