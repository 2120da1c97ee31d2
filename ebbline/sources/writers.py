"""Writers: zones, exports and the two store tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions import roles
from ebbline.operators.dedup import dedup
from ebbline.operators.scores import scores_long
from ebbline.operators.shape import rename_snake, select_available
from ebbline.sources.readers import CSV_DIALECT

BATCH_ROWS = 2000


def write_zone(df: DataFrame, zone: str, name: str, *, format: str = "parquet") -> str:
    """Replace a named table of a zone folder; returns its path."""
    path = f"{zone.rstrip('/')}/{name}"
    writer = df.write.mode("overwrite").format(format)
    (writer.options(**CSV_DIALECT).option("header", True) if format == "csv" else writer).save(path)
    return path


def export_filtered(df: DataFrame, path: str) -> str:
    """CSV with a header, one file per task."""
    df.write.mode("overwrite").options(**CSV_DIALECT).option("header", True).csv(path)
    return path


def users_table(df: DataFrame) -> DataFrame:
    """The rows of the users table: snake-case names, known columns, one row per customer.

    Of several rows of one customer the smallest is kept.
    """
    users = select_available(rename_snake(df), roles.USER_COLUMNS)
    return dedup(users, ["customer_id"])


def predictions_table(wide: DataFrame) -> DataFrame:
    return scores_long(wide, "customer_id" if "customer_id" in wide.columns else roles.ID_COL)


def _columns_ddl(schema: T.StructType) -> str:
    return ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in schema)


def create_tables(
    spark: SparkSession, *, drop_first: bool = False, location: str | None = None, database: str = "default"
) -> list[str]:
    """Create the empty users and predictions tables of a database, managed or below a folder; returns their full names.

    ``drop_first`` replaces the two tables of that database and no others.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    plan = [
        ("users", roles.USERS_SCHEMA, ""),
        ("predictions", roles.PREDICTIONS_SCHEMA, "PARTITIONED BY (model_name)"),
    ]
    for name, schema, partitioning in plan:
        if drop_first:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        place = f"LOCATION '{location.rstrip('/')}/{name}'" if location else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({_columns_ddl(schema)}) USING parquet {partitioning} {place}")
    return [f"{database}.{name}" for name, _, _ in plan]


def _replace(
    df: DataFrame, target: str, partition: str | None, buckets: int | None, jdbc_url: str | None, properties: dict | None
) -> None:
    if jdbc_url:
        options = {"batchsize": str(BATCH_ROWS)} | (properties or {})
        df.write.mode("overwrite").jdbc(jdbc_url, target, properties=options)
        return
    writer = df.write.mode("overwrite").format("parquet")
    writer = writer.partitionBy(partition) if partition else writer
    if "/" in target:
        if buckets:
            raise ValueError("buckets need a table name as target")
        writer.save(target)
    elif buckets:
        # Brought together by bucket first, so that each bucket is one file and not one per task.
        gathered = df.repartition(buckets, "customer_id").write.mode("overwrite").format("parquet")
        gathered = gathered.partitionBy(partition) if partition else gathered
        gathered.bucketBy(buckets, "customer_id").sortBy("customer_id").saveAsTable(target)
    else:
        writer.saveAsTable(target)


def sink_users(
    df: DataFrame, target: str = "users", *, buckets: int | None = None, jdbc_url: str | None = None,
    properties: dict | None = None,
) -> None:
    """Replace the users table; the target is a table name or a path.

    With both tables in the same number of buckets by customer, reports that
    bring them together need no shuffle.
    """
    _replace(users_table(df), target, None, buckets, jdbc_url, properties)


def sink_predictions(
    wide: DataFrame, target: str = "predictions", *, buckets: int | None = None, jdbc_url: str | None = None,
    properties: dict | None = None,
) -> None:
    """Replace the predictions table, partitioned by model so a report reads one model's files."""
    _replace(predictions_table(wide), target, "model_name", buckets, jdbc_url, properties)


def append_predictions(rows: DataFrame, target: str = "predictions", *, more: Sequence[str] = (), batch_id: int | None = None) -> None:
    """Add scored rows to the predictions table, with the columns of ``more`` beside its own.

    With a ``batch_id`` the rows of that batch are a partition of their own below the model and are
    replaced as a whole: writing a batch again adds nothing.
    """
    picked = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in roles.PREDICTIONS_SCHEMA], *more)
    if batch_id is None:
        writer = picked.write.mode("append").format("parquet").partitionBy("model_name")
    else:
        writer = picked.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").format("parquet")
        writer = writer.partitionBy("model_name", "batch_id").option("partitionOverwriteMode", "dynamic")
    if "/" in target:
        writer.save(target)
    else:
        writer.saveAsTable(target)
