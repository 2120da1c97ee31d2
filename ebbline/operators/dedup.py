"""Removal of rows equal on a set of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.functions import roles


def _subset(df: DataFrame, subset: list[str] | None) -> list[str]:
    return subset or [c for c in df.columns if c != roles.ID_COL]


def _grouped(df: DataFrame, subset: list[str], keep: str | bool, order_col: str) -> DataFrame:
    """The kept rows by one grouped minimum or maximum, equal rows merged before the shuffle."""
    rest = [c for c in df.columns if c not in subset]
    if not rest:
        grouped = df.groupBy(*subset).agg(F.count(F.lit(1)).alias("_n"))
        return (grouped if keep else grouped.where("_n = 1")).select(*df.columns)
    leading = [order_col] if order_col in rest else []
    ordered = leading + [c for c in rest if c not in leading]
    pick = F.max if keep == "last" else F.min
    payload = F.col(ordered[0]) if len(ordered) == 1 else F.struct(*ordered)
    grouped = df.groupBy(*subset).agg(pick(payload).alias("_kept"), F.count(F.lit(1)).alias("_n"))
    if not keep:
        grouped = grouped.where("_n = 1")
    if len(ordered) == 1:
        back = {ordered[0]: F.col("_kept")}
    else:
        back = {name: F.col(f"_kept.{name}") for name in ordered}
    return grouped.select(*[back[c].alias(c) if c in back else F.col(c) for c in df.columns])


def _split_repeated(df: DataFrame, subset: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with no equal, rows that may have one) by a 64-bit hash of the subset.

    The hashes are counted by a hash aggregate, which both joins share.  They carry no hint:
    adaptive execution sees how many hashes repeat and chooses.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*subset))
    repeated = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_hash")
    return hashed.join(repeated, "_hash", "left_anti").drop("_hash"), hashed.join(repeated, "_hash", "left_semi").drop("_hash")


def dedup(
    df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first", order_col: str = roles.ID_COL
) -> DataFrame:
    """Keep the first or last row of each group of equals, or none of a repeated group.

    The order is ``order_col``, ties by the other columns; nulls are equal.  Rows
    whose hash occurs once are passed on as they are; only the others are grouped
    (and sorted, where text is compared), by the columns themselves, so a hash
    collision changes nothing.  Equal rows merge before the shuffle, so a
    group that holds a third of the table costs no more than any other.
    """
    if keep not in ("first", "last", False):
        raise ValueError(f"keep must be 'first', 'last' or False, not {keep!r}")
    subset = _subset(df, subset)
    unique, candidates = _split_repeated(df, subset)
    return unique.unionByName(_grouped(candidates, subset, keep, order_col))


#: The name of the plan from when there were two.
dedup_mostly_unique = dedup


def dedup_report(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """One row: all members of repeated groups, and the rows a dedup that keeps one removes."""
    subset = _subset(df, subset)
    sizes = _split_repeated(df, subset)[1].groupBy(*subset).agg(F.count(F.lit(1)).alias("n"))
    repeated = sizes.where("n > 1")
    return repeated.agg(
        F.lit(df.count()).cast("bigint").alias("rows"),
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("members"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"),
    )
