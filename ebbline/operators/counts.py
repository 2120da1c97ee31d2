"""Counts of values over many columns in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.session import staged


def _hashed(df: DataFrame, columns: Sequence[str], with_value: bool) -> DataFrame:
    """(column, hash) of every value as text, and the value if wanted; a null has a null hash."""
    def pair(name: str):
        value = F.col(name).cast("string")
        parts = [F.lit(name).alias("column"), F.when(value.isNotNull(), F.xxhash64(value)).alias("hash")]
        return F.struct(*parts, *([value.alias("value")] if with_value else []))

    return df.select(F.inline(F.array(*[pair(name) for name in columns])))


def top_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, missing, unique, top, freq): the most frequent value as text, the smallest on ties.

    Values are counted by a 64-bit hash, so ids and free text are not shuffled; only the text of
    the values that win is fetched.  Where no value repeats that is the smallest one.
    """
    counts = staged(_hashed(df, columns, False).groupBy("column", "hash").agg(F.count(F.lit(1)).alias("n")), "value-hashes")
    known = F.col("hash").isNotNull()
    summary = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"),
        F.count("hash").alias("unique"), F.max(F.when(known, F.col("n"))).alias("freq"),
    )
    best = counts.join(summary.select("column", "freq"), "column").where(known & (F.col("n") == F.col("freq")) & (F.col("freq") > 1))
    winners = staged(best.select("column", "hash"), "top-hashes")
    repeated = _hashed(df, columns, True).join(winners, ["column", "hash"]).groupBy("column").agg(F.min("value").alias("repeated"))
    least = F.array(*[F.struct(F.lit(c).alias("column"), F.min(F.col(c).cast("string")).alias("least")) for c in columns])
    smallest = df.agg(least.alias("ends")).select(F.inline("ends"))
    return summary.join(repeated, "column", "left").join(smallest, "column", "left").select(
        "column", "rows", "missing", "unique", F.coalesce("repeated", "least").alias("top"), "freq"
    )


#: Different values of a column, as estimated, up to which its values are counted as they are.
FEW_VALUES = 1000


def few_valued(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """For each column the estimate that ``modes`` asks for; it may be part of another job."""
    return [F.approx_count_distinct(c).alias(f"_d{i}") for i, c in enumerate(columns)]


def modes(df: DataFrame, columns: Sequence[str], seen: Mapping | None = None) -> dict[str, str | None]:
    """The most frequent value per column as text, the smallest on ties; None if all null.

    Columns of few values are counted in one grouped aggregate, which passes on a count for each value; others by the
    hashes of their values.  ``seen`` holds the ``few_valued`` of the same rows and columns if they are known already.
    """
    if seen is None:
        seen = df.agg(*few_valued(df, columns)).first().asDict()
    few = [c for i, c in enumerate(columns) if seen[f"_d{i}"] <= FEW_VALUES]
    many = [c for c in columns if c not in few]
    found: dict[str, str] = {}
    if few:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in few])
        counts = df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("best"))
        found = {r["column"]: r["best"]["value"] for r in best.collect()}  # one row per column
    if many:
        found |= {r["column"]: r["top"] for r in top_values(df, many).collect()}
    return {name: found.get(name) for name in columns}
