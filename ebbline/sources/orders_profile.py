"""A customer profile derived from order tables: the test data of the reports.

Features come from orders before a cut-off, the label from orders after it, so
no feature knows the label.  Money is summed in whole cents: the result does
not hang on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.functions import roles

CUTOFF = "2001-02-02 00:00:00"
CUTOFF_MONTH = 2001 * 12 + 2


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _month(column: str) -> Column:
    return F.year(column) * 12 + F.month(column)


def _div_half_up(numerator: Column, denominator: Column) -> Column:
    """round(numerator / denominator) in whole numbers, halves up."""
    return F.call_function("div", 2 * numerator + denominator, 2 * denominator)


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with orders before the cut-off, snake-case columns and ``churn``."""
    returned = (
        _read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
        .groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_ret"))
    )
    orders = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority",
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        (F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp")).alias("past"),
    )
    past = F.col("past")
    per_customer = (
        orders.join(returned, orders.o_orderkey == returned.l_orderkey, "left")
        .groupBy("o_custkey").agg(
            F.count_if(past).alias("n_orders"),
            F.min(F.when(past, F.col("o_orderdate"))).alias("first_dt"),
            F.max(F.when(past, F.col("o_orderdate"))).alias("last_dt"),
            F.sum(F.when(past, F.col("cents"))).alias("cents"),
            F.coalesce(F.sum(F.when(past, F.col("n_ret"))), F.lit(0)).alias("n_ret"),
            F.count_if(past & (F.col("o_orderpriority") == "1-URGENT")).alias("n_urgent"),
            F.countDistinct(F.when(past, F.col("o_orderpriority"))).alias("n_prio"),
            F.count_if(~past).alias("n_after"),
        )
        .where("n_orders > 0")
        .withColumn("tenure", (_month("last_dt") - _month("first_dt")).cast("int"))
        # Hundredths of a thousand, so that charges fall into the usual range.
        .withColumn("monthly", _div_half_up(F.col("cents"), F.col("n_orders") * 1000))
    )
    customer, nation = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "nation")
    balance, orders_n = F.col("c_acctbal"), F.col("n_orders")
    total = F.when(F.col("c_custkey") % 10 == 0, _div_half_up(F.col("cents"), F.lit(1000))).otherwise(
        F.col("monthly") * F.col("tenure")
    )
    return (
        customer.join(per_customer, customer.c_custkey == per_customer.o_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        .select(
            F.col("c_custkey").cast("bigint").alias("customer_id"),
            F.col("c_mktsegment").alias("industry"),
            F.when(balance < 0, "Micro (<10)").when(balance < 2500, "Small (10-50)")
            .when(balance < 5000, "Medium (51-250)").when(balance < 7500, "Large (251-1000)")
            .otherwise("Enterprise (1000+)").alias("company_size"),
            F.when(orders_n < 8, "Month-to-month").when(orders_n < 11, "One year").otherwise("Two year").alias("contract"),
            "tenure",
            (F.col("monthly") / 100).alias("monthly_charges"),
            (total / 100).alias("total_charges"),
            F.col("n_ret").cast("int").alias("support_tickets"),
            (F.lit(CUTOFF_MONTH) - _month("last_dt")).cast("int").alias("last_login_days"),
            F.col("n_prio").cast("int").alias("feature_usage_count"),
            F.when(F.col("n_regionkey").isin(0, 1), "Yes").otherwise("No").alias("partner"),
            F.when(F.col("n_urgent") > 0, "Yes").otherwise("No").alias("paperless_billing"),
            F.when(F.col("n_after") == 0, "Yes").otherwise("No").alias("churn"),
        )
    )


def dirty(clean: DataFrame) -> DataFrame:
    """The profile with gaps, outliers and attribute-equal duplicates."""
    key = F.col("customer_id")

    def gap(every: int, column: str) -> Column:
        return F.when(key % every != 0, F.col(column)).alias(column)

    spoiled = clean.select(*[
        {
            "company_size": gap(41, "company_size"),
            "monthly_charges": gap(37, "monthly_charges"),
            "total_charges": gap(53, "total_charges"),
            "support_tickets": F.when(key % 97 == 0, F.lit(500)).otherwise(F.col("support_tickets")).alias("support_tickets"),
        }.get(c, F.col(c))
        for c in clean.columns
    ])
    copies = clean.where(key % 29 == 0).withColumn("customer_id", key + 1000000)
    return spoiled.unionByName(copies)


# Intercepts of the stand-in scores.
SCORE_INTERCEPTS = {"logistic_regression": 0.1, "random_forest": 0.0, "xgboost": -0.1}


def formula_probability(intercept: float | Column) -> Column:
    """A fixed logistic formula over profile columns, 4 decimals."""
    z = (
        F.lit(intercept) + 0.02 * F.col("last_login_days") - 0.015 * F.col("tenure") + 0.03 * F.col("support_tickets")
    )
    return F.round(1 / (1 + F.exp(-z)), 4)


def formula_scores(clean: DataFrame) -> DataFrame:
    """Long scores of the three models by the formula: a repeatable stand-in for trained models."""
    per_model = F.array(*[
        F.struct(F.lit(name).alias("model_name"), formula_probability(b).alias("probability"))
        for name, b in SCORE_INTERCEPTS.items()
    ])
    return clean.select("customer_id", F.inline(per_model)).withColumn(
        "prediction", (F.col("probability") >= 0.5).cast("int")
    )


def formula_scores_wide(clean: DataFrame) -> DataFrame:
    """The same scores as ``<model>_probability`` and ``<model>_prediction`` columns beside the profile."""
    out = clean
    for alias, name in roles.MODEL_NAMES.items():
        out = out.withColumn(f"{alias}_probability", formula_probability(SCORE_INTERCEPTS[name]))
        out = out.withColumn(f"{alias}_prediction", (F.col(f"{alias}_probability") >= 0.5).cast("int"))
    return out
