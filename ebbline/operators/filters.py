"""Row filters of the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.functions import roles


def filter_contract(df: DataFrame, contract: str | None = None, column: str = "contract") -> DataFrame:
    """One contract type, or all rows when none is chosen."""
    return df if contract is None else df.where(F.col(column) == contract)


def filter_risk(
    df: DataFrame, probability: str, threshold: float = 0.5, *, inclusive: bool = True
) -> DataFrame:
    """Rows at risk: ``>=`` as the dashboard has it, or ``>`` as the store's query."""
    value = F.col(probability)
    return df.where(value >= threshold if inclusive else value > threshold)


def split_by_label(df: DataFrame, target: str = roles.TARGET_COL) -> tuple[DataFrame, DataFrame]:
    """(churned, retained).  For statistics by label prefer one conditional aggregate."""
    return df.where(F.col(target) == "Yes"), df.where(F.col(target) == "No")


def drop_null_keys(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Drop rows whose id or label is missing."""
    return df.dropna(subset=roles.present(keys or [roles.ID_COL, roles.TARGET_COL], df.columns))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).dropna().distinct().orderBy(column)
