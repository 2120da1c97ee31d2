"""Churn by segment, login recency and tenure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions import roles
from ebbline.functions.scalar import bin_index, share_yes, yes_flag
from ebbline.operators.quantiles import Summary, exact_summary

LABELS = ["No", "Yes"]


def bins_frame(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The bins as a dimension: its size is the number of labels in the code."""
    rows = [(i, label) for i, label in enumerate(labels)]
    return df.sparkSession.createDataFrame(rows, "bin_index int, bin string")


def bin_dimension_join(aggregated: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Keep every bin, also an empty one.  ``aggregated`` has one row per bin_index at most."""
    return bins_frame(aggregated, labels).join(F.broadcast(aggregated), "bin_index", "left")


def binned(
    df: DataFrame, value: str, edges: Sequence[float], labels: Sequence[str], aggs: list[Column],
    *, right: bool = False, zero: Sequence[str] = (),
) -> DataFrame:
    """Aggregates per bin in bin order; rows outside the edges are left out, ``zero`` counts filled."""
    grouped = (
        df.withColumn("bin_index", bin_index(F.col(value), edges, right=right))
        .where("bin_index is not null").groupBy("bin_index").agg(*aggs)
    )
    return bin_dimension_join(grouped, labels).fillna(0, subset=list(zero)) if zero else bin_dimension_join(grouped, labels)


def _churn_bins(df, value, edges, labels, average: Column, target) -> DataFrame:
    label = F.col(target)
    return binned(
        df, value, edges, labels,
        [
            F.count(label).alias("customer_count"),
            F.sum(yes_flag(label)).alias("churn_count"),
            (share_yes(label) * 100).alias("churn_rate"),
            average,
        ],
        zero=["customer_count", "churn_count"],
    )


def login_bins(df: DataFrame, target: str = roles.TARGET_COL) -> DataFrame:
    return _churn_bins(
        df, "LastLoginDays", roles.LOGIN_EDGES, roles.LOGIN_LABELS, F.avg("LastLoginDays").alias("avg_last_login"), target
    )


def tenure_bins(df: DataFrame, target: str = roles.TARGET_COL) -> DataFrame:
    return _churn_bins(
        df, "Tenure", roles.TENURE_EDGES, roles.TENURE_LABELS,
        F.avg("MonthlyCharges").alias("avg_monthly_charges"), target,
    )


def churn_overall(df: DataFrame, target: str = roles.TARGET_COL) -> DataFrame:
    """(churn, customer_count, share_pct, churn_rate); shares are of all rows, also those without a label."""
    label = F.col(target)
    totals = df.agg(
        F.count(F.lit(1)).alias("rows"), share_yes(label).alias("churn_rate"),
        *[F.count_if(label == name).alias(name) for name in LABELS],
    )
    per_label = F.array(*[
        F.struct(F.lit(name).alias("churn"), F.col(name).alias("customer_count")) for name in LABELS
    ])
    return (
        totals.select("rows", "churn_rate", F.inline(per_label))
        .where("customer_count > 0")
        .select("churn", "customer_count", (F.col("customer_count") * 100 / F.col("rows")).alias("share_pct"), "churn_rate")
    )


def crosstab(df: DataFrame, by: str, output: str, target: str = roles.TARGET_COL) -> DataFrame:
    """Counts and row percentages of both labels per group; a conditional count needs no pivot."""
    label = F.col(target)
    no, yes = F.col("retained"), F.col("churned")
    total = F.nullif(no + yes, F.lit(0))
    return (
        df.where(F.col(by).isNotNull() & label.isNotNull())
        .groupBy(F.col(by).alias(output))
        .agg(F.count_if(label == "No").alias("retained"), F.count_if(label == "Yes").alias("churned"))
        .withColumns({"retained_pct": no * 100 / total, "churned_pct": yes * 100 / total})
    )


def churn_by_contract(df: DataFrame, target: str = roles.TARGET_COL) -> DataFrame:
    return crosstab(df, "Contract", "contract", target)


def churn_by_industry(df: DataFrame, top: int = 10, target: str = roles.TARGET_COL) -> DataFrame:
    """The largest industries with their churn rate; equal sizes by name."""
    return (
        crosstab(df, "Industry", "industry", target)
        .select(
            "industry", "retained", "churned", (F.col("retained") + F.col("churned")).alias("total"),
            F.col("churned_pct").alias("churn_rate"),
        )
        .orderBy(F.desc("total"), "industry").limit(top)
    )


def churn_by_company(df: DataFrame, target: str = roles.TARGET_COL) -> DataFrame:
    """The company sizes that occur, from small to large."""
    order = F.array_position(F.array(*[F.lit(size) for size in roles.COMPANY_SIZES]), F.col("company_size"))
    known = F.col("company_size").isin(roles.COMPANY_SIZES)
    return (
        crosstab(df.where(F.col("CompanySize").isin(roles.COMPANY_SIZES)), "CompanySize", "company_size", target)
        .where(known).withColumn("size_rank", order).orderBy("size_rank")
    )


SEGMENTS = {"overall": None, "churned": "Yes", "retained": "No"}
QUARTILES = [0.25, 0.5, 0.75]

# Per column and segment: count, moments, extremes and quartiles.
SegmentSummaries = dict[str, dict[str, Summary]]


def segment_summaries(df: DataFrame, values: Sequence[str], target: str = roles.TARGET_COL) -> SegmentSummaries:
    """Exact summaries of several columns, overall and by label, from the same passes.

    The reports below take them as ``summaries``, so that a set of reports
    reads the table once for all its quartiles; each computes its own otherwise.
    """
    columns = {
        f"{segment} {value}": F.col(value) if label is None else F.when(F.col(target) == label, F.col(value))
        for value in values for segment, label in SEGMENTS.items()
    }
    found = exact_summary(df, columns, QUARTILES)
    return {value: {segment: found[f"{segment} {value}"] for segment in SEGMENTS} for value in values}


def by_label(df: DataFrame, value: str, target: str, summaries: SegmentSummaries | None) -> dict[str, Summary]:
    """Summaries of the labels that have values, keyed by label."""
    mine = (summaries or segment_summaries(df, [value], target))[value]
    return {label: mine[segment] for segment, label in SEGMENTS.items() if label and mine[segment].count}


def value_stats(
    df: DataFrame, value: str, target: str = roles.TARGET_COL, summaries: SegmentSummaries | None = None
) -> DataFrame:
    """(segment, mean, median, std, min, max) overall, of churned and of retained rows."""
    mine = (summaries or segment_summaries(df, [value], target))[value]
    rows = [(name, s.mean, s.quantiles[1], s.std, s.low, s.high) for name, s in mine.items()]
    return df.sparkSession.createDataFrame(
        rows, "segment string, mean double, median double, std double, min double, max double"
    )


def recency_stats(df: DataFrame, target: str = roles.TARGET_COL, summaries: SegmentSummaries | None = None) -> DataFrame:
    return value_stats(df, "LastLoginDays", target, summaries)


def tenure_stats(df: DataFrame, target: str = roles.TARGET_COL, summaries: SegmentSummaries | None = None) -> DataFrame:
    return value_stats(df, "Tenure", target, summaries)


def median_by_label(
    df: DataFrame, value: str, target: str = roles.TARGET_COL, summaries: SegmentSummaries | None = None
) -> DataFrame:
    rows = [(label, s.quantiles[1]) for label, s in by_label(df, value, target, summaries).items()]
    return df.sparkSession.createDataFrame(rows, "churn string, median double")
