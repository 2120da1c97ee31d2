"""Imputation, outlier fences and the charges check.

Fill values and fences are fitted state: a handful of numbers that are fetched
once and then used as literals, so the cleaning itself needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions import roles
from ebbline.functions.scalar import clip
from ebbline.operators.counts import few_valued, modes
from ebbline.operators.quantiles import STATS, approx_quantiles, exact_quantiles, summary_aggs
from ebbline.operators.shape import to_number

IQR_MULTIPLIER = 1.5
QUARTILES = [0.25, 0.75]
CHARGES_RTOL = 0.05


def _is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating-point column."""
    value = F.col(name)
    return value.isNull() | F.isnan(value) if _is_float(df, name) else value.isNull()


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> dict[str, int]:
    columns = columns or df.columns
    return df.agg(*[F.count_if(missing(df, c)).alias(c) for c in columns]).first().asDict()


# ── missing values ──────────────────────────────────────────────────────────


def numeric_fills(
    df: DataFrame, columns: list[str], strategy: str = "median", *, exact: bool = True
) -> dict[str, float]:
    """The fill value of each column that has one (an all-null column has none)."""
    if strategy == "median":
        quantiles = exact_quantiles if exact else approx_quantiles
        fills = {c: v[0] for c, v in quantiles(df, columns, [0.5]).items()} if columns else {}
    elif strategy == "mean":
        means = [F.avg(F.when(~missing(df, c), F.col(c))).alias(c) for c in columns]
        fills = df.agg(*means).first().asDict() if columns else {}
    elif strategy == "zero":
        fills = {c: 0.0 for c in columns}
    else:
        raise ValueError(f"numeric strategy must be median, mean or zero, not {strategy!r}")
    return {c: v for c, v in fills.items() if v is not None}


def fill_numeric(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    """Replace missing numbers; a whole-number column stays one if its fill is whole."""
    filled = {}
    for name, fill in fills.items():
        whole = not _is_float(df, name) and float(fill).is_integer()
        kind = df.schema[name].dataType if whole else T.DoubleType()
        literal = F.lit(int(fill) if whole else float(fill)).cast(kind)
        filled[name] = F.when(missing(df, name), literal).otherwise(F.col(name).cast(kind))
    return df.withColumns(filled)


def impute_numeric(
    df: DataFrame, columns: list[str] | None = None, strategy: str = "median", *, exact: bool = True
) -> DataFrame:
    columns = columns or roles.present(roles.CLEAN_NUMERIC, df.columns)
    return fill_numeric(df, numeric_fills(df, columns, strategy, exact=exact))


def categorical_fills(df: DataFrame, columns: list[str], strategy: str = "mode") -> dict[str, str]:
    if strategy == "mode":
        return {c: "Unknown" if v is None else v for c, v in (modes(df, columns) if columns else {}).items()}
    if strategy == "missing_label":
        return {c: "Missing" for c in columns}
    raise ValueError(f"categorical strategy must be mode or missing_label, not {strategy!r}")


def fill_categorical(df: DataFrame, fills: dict[str, str]) -> DataFrame:
    filled = {}
    for name, fill in fills.items():
        kind = df.schema[name].dataType
        value = F.col(name)
        try:
            literal = F.lit(fill if isinstance(kind, T.StringType) else int(fill)).cast(kind)
        except ValueError:  # a text label in a 0/1 column
            value, literal = value.cast("string"), F.lit(fill)
        filled[name] = F.coalesce(value, literal)
    return df.withColumns(filled)


def impute_categorical(
    df: DataFrame, columns: list[str] | None = None, strategy: str = "mode"
) -> DataFrame:
    columns = columns or roles.present(roles.CLEAN_CATEGORICAL, df.columns)
    return fill_categorical(df, categorical_fills(df, columns, strategy))


def impute(df: DataFrame, num_strategy: str = "median", cat_strategy: str = "mode") -> DataFrame:
    """Both imputations, fitted only on the columns that have gaps, then rows without id or label dropped.

    One job counts the gaps, with what the medians and modes have to know before; each of these is one job more.
    """
    num, cat = roles.present(roles.CLEAN_NUMERIC, df.columns), roles.present(roles.CLEAN_CATEGORICAL, df.columns)
    medians, mode = num_strategy == "median" and bool(num), cat_strategy == "mode" and bool(cat)
    aggs = [F.count_if(missing(df, c)).alias(f"_gaps{i}") for i, c in enumerate(df.columns)]
    aggs += (summary_aggs(df, num, [0.5]) if medians else []) + (few_valued(df, cat) if mode else [])
    seen = df.agg(*aggs).first().asDict()
    gaps = {c: seen[f"_gaps{i}"] for i, c in enumerate(df.columns)}
    if medians:
        wanted = [c for c in num if gaps[c]]
        own = {f"_{kind}{wanted.index(c)}{rest}": seen[f"_{kind}{i}{rest}"] for i, c in enumerate(num) if gaps[c] for kind, rest in [("q", ""), *(("c", f"_{k}") for k in range(STATS))]}
        quantiles = exact_quantiles(df, wanted, [0.5], seen=own) if wanted else {}
        fills = {c: v[0] for c, v in quantiles.items() if v[0] is not None}
    else:
        fills = numeric_fills(df, [c for c in num if gaps[c]], num_strategy)
    wanted = [c for c in cat if gaps[c]]
    if mode:
        found = modes(df, wanted, {f"_d{wanted.index(c)}": seen[f"_d{i}"] for i, c in enumerate(cat) if gaps[c]}) if wanted else {}
        labels = {c: "Unknown" if v is None else v for c, v in found.items()}
    else:
        labels = categorical_fills(df, wanted, cat_strategy)
    keys = [c for c in roles.present([roles.ID_COL, roles.TARGET_COL], df.columns) if gaps[c]]
    out = fill_categorical(fill_numeric(df, fills), labels)
    return out.dropna(subset=keys) if keys else out


def missing_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, missing_before, missing_after)."""
    first, second = missing_counts(before), missing_counts(after)
    rows = [(c, first[c], second.get(c)) for c in before.columns]
    return before.sparkSession.createDataFrame(
        rows, "column string, missing_before bigint, missing_after bigint"
    )


# ── outliers ────────────────────────────────────────────────────────────────


def outlier_columns(df: DataFrame) -> list[str]:
    return [c for c in roles.present(roles.CLEAN_NUMERIC, df.columns) if c not in roles.OUTLIER_EXEMPT]


def iqr_fences(
    df: DataFrame, columns: list[str] | None = None, multiplier: float = IQR_MULTIPLIER, *, exact: bool = True, seen: Mapping | None = None
) -> dict[str, tuple[float, float, float, float]]:
    """(q1, q3, lower, upper) per column that has values; ``seen`` as ``fence_aggs`` gives it, if it is known already."""
    columns = columns or outlier_columns(df)
    found = exact_quantiles(df, columns, QUARTILES, seen=seen) if exact else approx_quantiles(df, columns, QUARTILES)
    fences = {}
    for name, (q1, q3) in found.items():
        if q1 is not None:
            reach = multiplier * (q3 - q1)
            fences[name] = (q1, q3, q1 - reach, q3 + reach)
    return fences


def fence_aggs(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Aggregates that ``iqr_fences`` has to know first; they may be part of another job or be observed."""
    return summary_aggs(df, columns or outlier_columns(df), QUARTILES)


def _outside(name: str, fences: dict) -> Column:
    _, _, low, high = fences[name]
    return F.coalesce((F.col(name) < low) | (F.col(name) > high), F.lit(False))


def iqr_bounds(
    df: DataFrame, columns: list[str] | None = None, multiplier: float = IQR_MULTIPLIER
) -> DataFrame:
    """(column, q1, q3, lower, upper, below, above): the fences and the rows outside them."""
    fences = iqr_fences(df, columns, multiplier)
    schema = (
        "column string, q1 double, q3 double, lower double, upper double, below bigint, above bigint"
    )
    if not fences:
        return df.sparkSession.createDataFrame([], schema)
    aggs = []
    for i, (name, (_, _, low, high)) in enumerate(fences.items()):
        aggs += [F.count_if(F.col(name) < low).alias(f"b{i}"), F.count_if(F.col(name) > high).alias(f"a{i}")]
    seen = df.agg(*aggs).first()
    rows = [(name, *fence, seen[f"b{i}"], seen[f"a{i}"]) for i, (name, fence) in enumerate(fences.items())]
    return df.sparkSession.createDataFrame(rows, schema)


def outlier_cap(
    df: DataFrame, columns: list[str] | None = None, multiplier: float = IQR_MULTIPLIER, *, exact: bool = True, seen: Mapping | None = None
) -> DataFrame:
    """Limit values to the fences; null stays null."""
    fences = iqr_fences(df, columns, multiplier, exact=exact, seen=seen)
    return df.withColumns({
        c: clip(F.col(c).cast("double"), low, high) for c, (_, _, low, high) in fences.items()
    })


def outlier_flag(
    df: DataFrame, columns: list[str] | None = None, multiplier: float = IQR_MULTIPLIER, *, exact: bool = True, seen: Mapping | None = None
) -> DataFrame:
    """Add ``<column>_outlier`` 0/1 for every column checked, so the schema does not hang on the data."""
    fences = iqr_fences(df, columns, multiplier, exact=exact, seen=seen)
    return df.withColumns({f"{c}_outlier": _outside(c, fences).cast("int") for c in fences})


# ── total charges against monthly charges × tenure ──────────────────────────

_CHARGES = ["Tenure", "MonthlyCharges", "TotalCharges"]


def charges_inconsistent(
    monthly: Column, tenure: Column, total: Column, rtol: float = CHARGES_RTOL
) -> Column:
    """Total and monthly × tenure differ by more than ``rtol`` of the larger.

    A missing number on either side counts as inconsistent; two zeros agree.
    """
    expected = monthly * tenure
    larger = F.greatest(F.abs(total), F.abs(expected))
    return (
        F.when(total.isNull() | expected.isNull(), F.lit(True))
        .when(larger == 0, F.lit(False))
        .otherwise(F.abs(total - expected) / larger > rtol)
    )


def charges_fix(df: DataFrame, rtol: float = CHARGES_RTOL, *, fix: bool = True) -> DataFrame:
    """Rewrite inconsistent totals as round(monthly × tenure, 2); unchanged without the columns."""
    if len(roles.present(_CHARGES, df.columns)) < len(_CHARGES):
        return df
    tenure, monthly, total = (to_number(df, c) for c in _CHARGES)
    kind = df.schema["Tenure"].dataType
    out = df.withColumns({
        "Tenure": tenure.try_cast(kind) if isinstance(kind, T.IntegralType) else tenure,
        "MonthlyCharges": monthly,
        "TotalCharges": total,
    })
    if not fix:
        return out
    tenure, monthly, total = (F.col(c) for c in _CHARGES)
    wrong = charges_inconsistent(monthly, tenure, total, rtol)
    return out.withColumn("TotalCharges", F.when(wrong, F.round(monthly * tenure, 2)).otherwise(total))


def charges_report(df: DataFrame, rtol: float = CHARGES_RTOL) -> DataFrame:
    """One row: inconsistent rows, and how many are new customers that were charged."""
    tenure, monthly, total = (to_number(df, c) for c in _CHARGES)
    wrong = charges_inconsistent(monthly, tenure, total, rtol)
    charged_new = F.coalesce((tenure == 0) & (total > 0), F.lit(False))
    return df.select(wrong.alias("wrong"), charged_new.alias("charged_new")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("wrong").alias("inconsistent"),
        F.count_if("charged_new").alias("new_but_charged"),
        F.count_if(F.col("wrong") & ~F.col("charged_new")).alias("deviating"),
    )
