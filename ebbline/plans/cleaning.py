"""The whole cleaning job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession

from ebbline.operators.cleaning import IQR_MULTIPLIER, charges_fix, fence_aggs, impute, outlier_cap, outlier_columns, outlier_flag
from ebbline.operators.dedup import dedup_mostly_unique
from ebbline.operators.shape import cast_types
from ebbline.session import staged
from ebbline.sources.readers import read_zone
from ebbline.sources.writers import write_zone

STEPS = ["missing_values", "duplicates", "outliers", "total_charges_fix", "data_types"]


def clean_table(
    df: DataFrame, *, iqr_multiplier: float = IQR_MULTIPLIER, outlier_strategy: str = "cap"
) -> DataFrame:
    """Gaps, duplicates, outliers, charges, types, in this order.

    The fences need the deduplicated rows, so those are staged once, and what the fences have to know of them
    first is observed while they are written.  Five jobs come before the result at most: gaps, medians, modes, the staged
    rows, and the quartiles (more where values crowd); the result is one narrow pass.
    """
    strategies = {"cap": outlier_cap, "flag": outlier_flag}
    if outlier_strategy not in strategies:
        raise ValueError(f"outlier strategy must be cap or flag, not {outlier_strategy!r}")
    imputed = dedup_mostly_unique(impute(df))
    columns = outlier_columns(imputed)
    if not columns:
        return cast_types(charges_fix(strategies[outlier_strategy](staged(imputed, "deduplicated"), multiplier=iqr_multiplier)))
    observed = Observation()
    unique = staged(imputed.observe(observed, *fence_aggs(imputed, columns)), "deduplicated")
    return cast_types(charges_fix(strategies[outlier_strategy](unique, columns, iqr_multiplier, seen=observed.get)))


def run_cleaning(
    spark: SparkSession,
    raw_zone: str,
    processed_zone: str,
    name: str = "customers",
    *,
    format: str = "parquet",
    iqr_multiplier: float = IQR_MULTIPLIER,
    outlier_strategy: str = "cap",
) -> tuple[DataFrame, dict]:
    """Clean a raw-zone table into the processed zone; returns it with a report."""
    raw = read_zone(spark, raw_zone, name, format=format)
    if format == "csv":
        raw = staged(raw, "raw")  # parsed once, read by several passes
    cleaned = clean_table(raw, iqr_multiplier=iqr_multiplier, outlier_strategy=outlier_strategy)
    path = write_zone(cleaned, processed_zone, name)
    written = read_zone(spark, processed_zone, name)
    return written, {
        "rows_before": raw.count(), "cols_before": len(raw.columns),
        "rows_after": written.count(), "cols_after": len(written.columns),
        "steps": STEPS, "output_path": path,
    }
