"""All exploratory reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.operators import distributions, eda


#: The columns that name a row of each report; the others are its measures.
REPORT_KEYS = {
    "churn_overall": ["churn"], "churn_by_contract": ["contract"], "churn_by_industry": ["industry"], "churn_by_company": ["company_size"],
    "login_stats": ["segment"], "login_bins": ["bin_index", "bin"], "tenure_stats": ["segment"], "tenure_bins": ["bin_index", "bin"],
    "login_histogram": ["bin_index"], "login_density": ["churn", "point"], "login_box": ["churn"], "login_violin": ["churn"],
    "tenure_histogram": ["bin_index"], "tenure_density": ["churn", "point"], "tenure_box": ["churn"], "tenure_violin": ["churn"],
    "tenure_vs_charges": ["Churn"],
}


def eda_all(df: DataFrame, *, order: Column | None = None) -> dict[str, DataFrame]:
    """Every report by name, each a small frame; ``order`` draws the sample of the scatter report.

    Quartiles, moments and extremes of both columns, overall and by label, are
    taken in the same passes and shared by the reports that need them.
    """
    shared = eda.segment_summaries(df, ["LastLoginDays", "Tenure"])
    reports = {
        "churn_overall": eda.churn_overall(df),
        "churn_by_contract": eda.churn_by_contract(df),
        "churn_by_industry": eda.churn_by_industry(df),
        "churn_by_company": eda.churn_by_company(df),
        "login_stats": eda.recency_stats(df, summaries=shared),
        "login_bins": eda.login_bins(df),
        "tenure_stats": eda.tenure_stats(df, summaries=shared),
        "tenure_bins": eda.tenure_bins(df),
    }
    for name, column in (("login", "LastLoginDays"), ("tenure", "Tenure")):
        reports[f"{name}_histogram"] = distributions.histogram(df, column, summaries=shared)
        reports[f"{name}_density"] = distributions.kde_by_label(df, column, summaries=shared)
        reports[f"{name}_box"] = distributions.box_stats(df, column, summaries=shared)
        reports[f"{name}_violin"] = distributions.violin_quartiles(df, column, summaries=shared)
    reports["tenure_vs_charges"] = distributions.scatter_sample(df, order=order)
    return reports


def eda_long(reports: Mapping[str, DataFrame]) -> DataFrame:
    """(report, item, measure, value): the rows of all reports in one table."""
    found = None
    for name, report in reports.items():
        keys = REPORT_KEYS[name]
        item = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        measures = [
            F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in report.columns if c not in keys
        ]
        part = report.select(F.lit(name).alias("report"), item.alias("item"), F.inline(F.array(*measures)))
        found = part if found is None else found.unionByName(part)
    return found


def key_findings(df: DataFrame) -> DataFrame:
    """(finding, value): churn rate, and mean login gap and tenure of churned and retained customers."""
    churned, retained = F.col("Churn") == "Yes", F.col("Churn") == "No"
    values = df.agg(
        F.avg(F.coalesce(churned.cast("int"), F.lit(0))).alias("churn_rate"),
        F.avg(F.when(churned, F.col("LastLoginDays"))).alias("churned_login_gap"),
        F.avg(F.when(retained, F.col("LastLoginDays"))).alias("retained_login_gap"),
        F.avg(F.when(churned, F.col("Tenure"))).alias("churned_tenure"),
        F.avg(F.when(retained, F.col("Tenure"))).alias("retained_tenure"),
    )
    return values.unpivot([], values.columns, "finding", "value")
