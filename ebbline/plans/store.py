"""Scoring a customer table into the store, with its summary."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.functions import roles
from ebbline.operators.models import load_models, score_batch
from ebbline.operators.scores import high_risk_topk, model_stats, store_stats
from ebbline.session import mark, matching, remove, staged
from ebbline.sources.writers import create_tables, sink_predictions, sink_users


READY = "_READY"


def current_store(spark: SparkSession, location: str) -> str | None:
    """The folder of the newest pair of tables that was written whole, or None."""
    ready = matching(spark, f"{location.rstrip('/')}/versions/*/{READY}")
    return ready[-1].rsplit("/", 1)[0] if ready else None


def repeated_customers(wide: DataFrame) -> DataFrame:
    """(customer_id, n) of the customers with several rows, of which the users table keeps one."""
    key = "customer_id" if "customer_id" in wide.columns else roles.ID_COL
    return wide.groupBy(F.col(key).alias("customer_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def load_store(spark: SparkSession, wide: DataFrame, location: str, *, top_n: int = 10) -> dict[str, DataFrame]:
    """Write users and predictions of a scored table below ``location`` and report on them.

    Both tables are written to a fresh version, and become the current pair together, by a mark, when both are
    there and no customer is in ``users`` twice.  A run that fails leaves the pair that was current; the one before it is
    kept for those who still read it, older ones are removed.
    """
    root = location.rstrip("/")
    version = f"{root}/versions/{time.time_ns():020d}"
    users_path, predictions_path = f"{version}/users", f"{version}/predictions"
    sink_users(wide, users_path)
    sink_predictions(wide, predictions_path)
    users, predictions = spark.read.parquet(users_path), spark.read.parquet(predictions_path)
    twice = users.groupBy("customer_id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"customers that are in users more than once: {[r['customer_id'] for r in twice]}")
    before = current_store(spark, location)
    mark(spark, f"{version}/{READY}")
    kept = {path.rsplit("/", 1)[1] for path in (before, version) if path}
    for old in matching(spark, f"{root}/versions/*"):
        if old.rsplit("/", 1)[1] not in kept:
            remove(spark, old)
    return {
        "users": users,
        "predictions": predictions,
        "store_stats": store_stats(users, predictions),
        "model_stats": model_stats(predictions),
        "high_risk": high_risk_topk(users, predictions, top_n),
        "repeated_customers": repeated_customers(wide),
    }


def run_etl(spark: SparkSession, df: DataFrame, model_path: str, location: str, *, top_n: int = 10) -> dict[str, DataFrame]:
    """Extracted customers to scored store tables with the saved models."""
    features, models = load_models(spark, model_path)
    # Scored once, read by both sinks.
    return load_store(spark, staged(score_batch(df, features, models), "scored"), location, top_n=top_n)


def register_store(spark: SparkSession, location: str, database: str = "default") -> None:
    """Declare the store's current tables so that SQL can name them."""
    current = current_store(spark, location)
    if current is None:
        raise FileNotFoundError(f"no store below {location}")
    for name in ("users", "predictions"):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")  # of an older version
    for name in create_tables(spark, location=current, database=database):
        if name.endswith(".predictions"):
            spark.sql(f"MSCK REPAIR TABLE {name}")
        spark.catalog.refreshTable(name)
