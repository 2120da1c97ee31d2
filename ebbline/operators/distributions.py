"""The tables behind the distribution charts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions import roles
from ebbline.functions.scalar import hash_order
from ebbline.operators.cleaning import IQR_MULTIPLIER
from ebbline.operators.eda import LABELS, SegmentSummaries, bin_dimension_join, by_label


#: Bandwidths over which a kernel is summed.
REACH = 8.7


def histogram(df: DataFrame, value: str, bins: int = 40, summaries: SegmentSummaries | None = None) -> DataFrame:
    """Equal-width bins from minimum to maximum, the maximum in the last bin, empty bins kept."""
    column = F.col(value).cast("double")
    if summaries:
        low, high = summaries[value]["overall"].low, summaries[value]["overall"].high
    else:
        low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        low, high = 0.0, 1.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    index = F.least(F.floor((column - low) / width).cast("int"), F.lit(bins - 1))
    grouped = df.where(column.isNotNull()).groupBy(index.alias("bin_index")).agg(F.count(F.lit(1)).alias("n"))
    joined = bin_dimension_join(grouped, [str(i) for i in range(bins)]).fillna(0, subset=["n"])
    return joined.select(
        "bin_index", (low + F.col("bin_index") * width).alias("bin_start"),
        (low + (F.col("bin_index") + 1) * width).alias("bin_end"), "n",
    )


def _label_moments(df: DataFrame, value: str, target: str) -> dict[str, tuple]:
    """Per label (count, std, low, high), in one aggregate."""
    parts = {name: F.when(F.col(target) == name, F.col(value).cast("double")) for name in LABELS}
    aggs = [f(v).alias(f"{name}{k}") for name, v in parts.items() for k, f in enumerate((F.count, F.stddev, F.min, F.max))]
    row = df.agg(*aggs).first()
    return {name: tuple(row[f"{name}{k}"] for k in range(4)) for name in LABELS}


def kde_by_label(
    df: DataFrame, value: str, target: str = roles.TARGET_COL, summaries: SegmentSummaries | None = None,
    *, points: int = 200, cut: float = 3.0,
) -> DataFrame:
    """Gaussian density per label on an even grid, Scott bandwidth.

    Equal values are merged first, and a value adds only to the grid points within REACH bandwidths, beyond which a kernel is
    below 3e-17 of its height.  Tasks pass on a sum for each label and point.
    """
    column, label = F.col(value).cast("double"), F.col(target)
    if summaries:
        moments = {name: (s.count, s.std, s.low, s.high) for name, s in by_label(df, value, target, summaries).items()}
    else:
        moments = _label_moments(df, value, target)
    grids = {}
    for name, (n, sd, low, high) in moments.items():
        if n >= 2 and sd:
            bandwidth = sd * n ** -0.2
            start = low - cut * bandwidth
            grids[name] = (n, bandwidth, start, (high + cut * bandwidth - start) / (points - 1))
    schema = "churn string, point int, x double, density double"
    if not grids:
        return df.sparkSession.createDataFrame([], schema)

    def of(place: int) -> Column:
        """The bandwidth, start or step of the row's label."""
        return F.element_at(F.create_map(*[part for name, grid in grids.items() for part in (F.lit(name), F.lit(float(grid[place])))]), F.col("label"))

    own = df.select(label.alias("label"), F.when(~F.isnan(column), column).alias("value")).where(F.col("value").isNotNull() & F.col("label").isin(list(grids)))
    counts = own.groupBy("label", "value").agg(F.count(F.lit(1)).alias("n")).select("*", of(1).alias("bandwidth"), of(2).alias("start"), of(3).alias("step"))
    first = F.greatest(F.ceil((F.col("value") - REACH * F.col("bandwidth") - F.col("start")) / F.col("step")), F.lit(0))
    last = F.least(F.floor((F.col("value") + REACH * F.col("bandwidth") - F.col("start")) / F.col("step")), F.lit(points - 1))
    reached = counts.withColumns({"first": first, "last": last}).where("first <= last").withColumn("point", F.explode(F.sequence("first", "last")))
    away = (F.col("start") + F.col("point") * F.col("step") - F.col("value")) / F.col("bandwidth")
    sums = reached.groupBy("label", "point").agg(F.sum(F.col("n") * F.exp(-0.5 * away * away)).alias("total")).collect()  # points for each label at most
    totals = {(r["label"], r["point"]): r["total"] for r in sums}
    rows = [
        (name, i, start + i * step, totals.get((name, i), 0.0) / (n * bandwidth * math.sqrt(2 * math.pi)))
        for name, (n, bandwidth, start, step) in grids.items() for i in range(points)
    ]
    return df.sparkSession.createDataFrame(rows, schema)


def box_stats(
    df: DataFrame, value: str, target: str = roles.TARGET_COL, summaries: SegmentSummaries | None = None,
    *, multiplier: float = IQR_MULTIPLIER,
) -> DataFrame:
    """Per label: quartiles, whisker ends (the outermost values within the fences) and outliers."""
    column, label = F.col(value).cast("double"), F.col(target)
    quartiles = {name: s.quantiles for name, s in by_label(df, value, target, summaries).items()}
    schema = (
        "churn string, q25 double, q50 double, q75 double, whisker_low double, whisker_high double, outliers bigint"
    )
    if not quartiles:
        return df.sparkSession.createDataFrame([], schema)
    aggs = []
    for name, (q1, _, q3) in quartiles.items():
        reach = multiplier * (q3 - q1)
        mine = label == name
        kept = F.when(mine & (column >= q1 - reach) & (column <= q3 + reach), column)
        aggs += [
            F.min(kept).alias(f"{name}_lo"), F.max(kept).alias(f"{name}_hi"),
            F.count_if(mine & ((column < q1 - reach) | (column > q3 + reach))).alias(f"{name}_out"),
        ]
    row = df.agg(*aggs).first()
    rows = [(k, *q, row[f"{k}_lo"], row[f"{k}_hi"], row[f"{k}_out"]) for k, q in quartiles.items()]
    return df.sparkSession.createDataFrame(rows, schema)


def violin_quartiles(
    df: DataFrame, value: str, target: str = roles.TARGET_COL, summaries: SegmentSummaries | None = None
) -> DataFrame:
    rows = [(label, *s.quantiles) for label, s in by_label(df, value, target, summaries).items()]
    return df.sparkSession.createDataFrame(rows, "churn string, q25 double, q50 double, q75 double")


def sample_n(
    df: DataFrame, n: int, key: str = roles.ID_COL, seed: int = roles.SEED, order: Column | None = None
) -> DataFrame:
    """``n`` rows by the smallest hash of the key: the same rows whatever the partitioning.

    A top-n, so each task passes on at most ``n`` rows.
    """
    order = hash_order(F.col(key), seed) if order is None else order
    return df.orderBy(order, key).limit(n)


def scatter_sample(
    df: DataFrame, n: int = 3000, key: str = roles.ID_COL, target: str = roles.TARGET_COL, **sampling
) -> DataFrame:
    return sample_n(df, n, key, **sampling).select("Tenure", "MonthlyCharges", target)
