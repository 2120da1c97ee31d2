"""All registered queries on the smallest input, against their SQL twins."""

import sys
from pathlib import Path

import duckdb
import pytest

from tests.conftest import SMALL

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check_queries import differences  # noqa: E402

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() == 7


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, db, name):
    found = differences(QUERIES[name](spark, SMALL).toPandas(), db.execute(ORACLES[name]).df())
    assert found is None or found.startswith("ok")


@pytest.mark.parametrize("name", ["high_risk_join", "tenure_bins", "scores_wide", "dedup", "metrics", "kde_by_label", "box_stats"])
def test_no_cross_product(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "CartesianProduct" not in plan


def test_only_needed_columns_are_read(spark):
    plan = QUERIES["tenure_bins"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == {"tenure", "monthly_charges", "churn"}


def test_the_model_filter_reaches_the_files(spark, tmp_path):
    from ebbline.operators.scores import high_risk_join

    spark.createDataFrame([("1", 0.9, 1, "xgboost"), ("1", 0.9, 1, "random_forest")], "customer_id string, probability double, prediction int, model_name string") \
        .write.partitionBy("model_name").parquet(str(tmp_path / "p"))
    users = spark.createDataFrame([("1", 1, 1.0, "a", 1)], "customer_id string, tenure int, monthly_charges double, contract string, last_login_days int")
    plan = high_risk_join(users, spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model_name" in plan and "GreaterThan(probability,0.5)" in plan
