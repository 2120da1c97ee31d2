"""Table profiles and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions import roles
from ebbline.functions.scalar import share_yes
from ebbline.operators.cleaning import CHARGES_RTOL, charges_inconsistent, fence_aggs, iqr_fences, missing, outlier_columns
from ebbline.operators.counts import top_values
from ebbline.operators.dedup import dedup_report
from ebbline.operators.quantiles import exact_summary


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def other_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, T.NumericType)]


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: missing, mean, std, quartiles, extremes (4 decimals)."""
    columns = columns or numeric_columns(df)
    spark = df.sparkSession
    schema = (
        "column string, type string, count bigint, missing bigint, missing_pct double, mean double, std double,"
        " min double, q25 double, q50 double, q75 double, max double"
    )
    if not columns:
        return spark.createDataFrame([], schema)
    rows = df.count()
    types = dict(df.dtypes)
    out = []
    for name, s in exact_summary(df, columns, [0.25, 0.5, 0.75]).items():
        gaps = rows - s.count
        share = gaps * 100.0 / rows if rows else None
        out.append((name, types[name], s.count, gaps, share, s.mean, s.std, s.low, *s.quantiles, s.high))
    result = spark.createDataFrame(out, schema)
    rounded = {c: F.round(c, 4) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")}
    return result.withColumns(rounded | {"missing_pct": F.round("missing_pct", 2)})


def describe_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per other column: missing, distinct values, the top value (smallest on ties) and its count."""
    columns = columns or other_columns(df)
    types = F.create_map(*[F.lit(x) for name, kind in df.dtypes if name in columns for x in (name, kind)])
    return top_values(df, columns).select(
        "column", F.element_at(types, F.col("column")).alias("type"),
        (F.col("rows") - F.col("missing")).alias("count"), "missing",
        F.round(F.col("missing") * 100.0 / F.col("rows"), 2).alias("missing_pct"), "unique", "top", "freq",
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Both descriptions, one row per column."""
    return describe_numeric(df).unionByName(describe_categorical(df), allowMissingColumns=True)


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def column_groups(df: DataFrame) -> DataFrame:
    """(column, column_group): numerical, categorical, binary (also listed as categorical) or target."""
    others = other_columns(df)
    targets = [c for c in others if c.lower() in ("churn", "churn_label")]
    cats = [c for c in others if c not in targets]
    # Only "exactly two" matters, and two values have a smallest and a largest:
    # every value equal to one of them means two, without counting distinct values.
    binary = []
    if cats:
        ends = df.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(cats) for f, p in ((F.min, "a"), (F.max, "z"))]).first()
        between = df.agg(*[
            F.count_if((F.col(c) != F.lit(ends[f"a{i}"])) & (F.col(c) != F.lit(ends[f"z{i}"]))).alias(f"m{i}")
            for i, c in enumerate(cats)
        ]).first()
        binary = [
            c for i, c in enumerate(cats)
            if ends[f"a{i}"] is not None and ends[f"a{i}"] != ends[f"z{i}"] and between[f"m{i}"] == 0
        ]
    rows = [
        *[(c, "categorical") for c in cats], *[(c, "numerical") for c in numeric_columns(df)],
        *[(c, "binary") for c in binary], *[(c, "target") for c in targets],
    ]
    return df.sparkSession.createDataFrame(rows, "column string, column_group string")


def target_counts(df: DataFrame, target: str = roles.TARGET_COL) -> DataFrame:
    """Rows per label; a missing label is left out."""
    return df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def quality_checks(df: DataFrame, rtol: float = CHARGES_RTOL) -> DataFrame:
    """(check, value, passed) for a cleaned table.

    ``charges_deviation`` is reported only: the cleaning tolerates ``rtol``.  Four jobs, and more where values crowd: gaps with
    what the fences have to know, duplicates, quartiles, and the rows outside of the fences with the rest.
    """
    checked = outlier_columns(df)
    gaps = sum((F.count_if(missing(df, c)) for c in df.columns), F.lit(0))
    seen = df.agg(gaps.alias("gaps"), *(fence_aggs(df, checked) if checked else [])).first().asDict()
    total_gaps = seen["gaps"]
    removable = dedup_report(df).first()["removed"]
    fences = iqr_fences(df, checked, seen=seen) if checked else {}
    tenure, monthly, total = F.col("Tenure"), F.col("MonthlyCharges"), F.col("TotalCharges")
    outside = [
        F.count_if((F.col(c) < low) | (F.col(c) > high)).alias(f"out_{c}") for c, (_, _, low, high) in fences.items()
    ]
    row = df.agg(
        F.max(F.abs(total - monthly * tenure)).alias("deviation"),
        F.count_if(charges_inconsistent(monthly, tenure, total, rtol)).alias("inconsistent"),
        share_yes(F.col(roles.TARGET_COL)).alias("rate"),
        *outside,
    ).first()
    rows = [
        ("missing_values", float(total_gaps), total_gaps == 0),
        ("duplicate_rows", float(removable), removable == 0),
        ("charges_deviation", row["deviation"], None),
        ("charges_inconsistent", float(row["inconsistent"]), row["inconsistent"] == 0),
        *[(f"outside_fences_{c}", float(row[f"out_{c}"]), row[f"out_{c}"] == 0) for c in fences],
        ("churn_rate", row["rate"], None),
    ]
    return df.sparkSession.createDataFrame(rows, "check string, value double, passed boolean")
