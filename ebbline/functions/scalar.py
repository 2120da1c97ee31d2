"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def yes_flag(column: Column) -> Column:
    """1 for Yes, 0 for anything else and for null."""
    return F.coalesce((column == "Yes").cast("int"), F.lit(0))


def share_yes(column: Column) -> Column:
    """Share of Yes over all rows; a null label counts as not churned."""
    return F.avg(yes_flag(column))


def not_nan(column: Column) -> Column:
    """NaN as null, so both count as missing."""
    return F.when(~F.isnan(column), column)


def clip(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit to [low, high]; null stays null (least and greatest skip nulls)."""
    value = column
    if low is not None:
        value = F.when(value < low, F.lit(low)).otherwise(value)
    if high is not None:
        value = F.when(value > high, F.lit(high)).otherwise(value)
    return value


def bin_index(column: Column, edges: Sequence[float], *, right: bool = False) -> Column:
    """0-based bin of ``column``; [a, b) bins, or (a, b] with ``right``; null outside."""
    index = None
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        inside = (column > low) & (column <= high) if right else (column >= low) & (column < high)
        index = F.when(inside, i) if index is None else index.when(inside, i)
    return index


def bin_label(
    column: Column, edges: Sequence[float], labels: Sequence[str], *, right: bool = False
) -> Column:
    """The label of the bin of ``column``; null outside the edges."""
    names = F.array(*[F.lit(label) for label in labels])
    return F.get(names, bin_index(column, edges, right=right))


def risk_tier(probability: Column) -> Column:
    """Low below .25, Medium below .5, High below .75, else Critical."""
    return (
        F.when(probability < 0.25, "Low")
        .when(probability < 0.50, "Medium")
        .when(probability < 0.75, "High")
        .when(probability.isNotNull(), "Critical")
    )


def request_id(*key: Column) -> Column:
    """``api-`` and 8 hex digits; a function of the key, so a retried task repeats it."""
    return F.concat(F.lit("api-"), F.substring(F.sha2(F.concat_ws("|", *key), 256), 1, 8))


def distinct_estimate(column: Column) -> Column:
    """Approximate number of distinct values (about 2 %), nulls left out, by a sketch of fixed size."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(column.isNotNull(), F.xxhash64(column))))


def hash_order(key: Column, seed: int = 42) -> Column:
    """A pseudo-random sort key that does not depend on the partitioning."""
    return F.xxhash64(key, F.lit(seed))


def uniform(key: Column, salt: str, seed: int = 42) -> Column:
    """A uniform number in [0, 1) for a key; 53 bits of a 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(salt), F.lit(seed)), 11) / F.lit(float(1 << 53))


def portable_uniform(key: Column, salt: str, seed: int = 42) -> Column:
    """As ``uniform``, but from md5, which other SQL engines also have (32 bits, slower)."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(salt), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
