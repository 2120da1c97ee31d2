"""Exact order statistics without gathering a column in one task or on the driver.

``median`` and ``percentile`` merge one map of all distinct values in a single
task.  Here a bounded sketch only brackets each wanted rank; the values
inside a bracket are counted in cells, and the cell that holds the rank is the next bracket, until it
has one value or few rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions.scalar import distinct_estimate

SKETCH_ACCURACY = 10_000
#: A bracket is cut into so many cells of equal width; the values of a cell of at most so many rows are counted one by one.
CELLS, FEW_ROWS = 256, 10_000
#: Whole numbers pass the sketch as doubles; their bracket is widened by more than that can move them.
INTEGRAL_SLACK = 2048


@dataclass
class Summary:
    """One column: its count of values, moments, extremes, about how many are distinct, and the wanted quantiles."""

    count: int
    mean: float | None
    std: float | None
    low: float | None
    high: float | None
    distinct: int
    quantiles: list[float | None] = field(default_factory=list)


@dataclass
class _Bracket:
    """Values in [low, high] of one column hold the wanted ranks; ``below`` rows are smaller, as far as that is known."""

    name: str
    ranks: list[int]
    low: float
    high: float
    below: int | None = None


def _values(df: DataFrame, columns: Sequence[str] | Mapping[str, Column], integral: bool) -> dict[str, Column]:
    """The wanted columns as doubles without NaN or as 64-bit integers."""
    named = dict(columns) if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    if integral:
        return {name: value.cast("bigint") for name, value in named.items()}
    doubles = {name: value.cast("double") for name, value in named.items()}
    return {name: F.when(~F.isnan(value), value) for name, value in doubles.items()}


def _view(df: DataFrame, columns: Sequence[str] | Mapping[str, Column], integral: bool) -> DataFrame:
    return df.select(*[value.alias(name) for name, value in _values(df, columns, integral).items()])


_STATS = [F.count, F.avg, F.stddev, F.min, F.max, distinct_estimate]
STATS = len(_STATS)


def summary_aggs(
    df: DataFrame, columns: Sequence[str] | Mapping[str, Column], probs: Sequence[float], *, accuracy: int = SKETCH_ACCURACY, integral: bool = False
) -> list[Column]:
    """What ``exact_summary`` has to know of the rows before it looks for quantiles: aggregates that may be part of another job or be observed."""
    values = list(_values(df, columns, integral).values())
    aggs = [f(value).alias(f"_c{i}_{k}") for i, value in enumerate(values) for k, f in enumerate(_STATS)]
    wide = _around(probs, accuracy) if probs else []
    return aggs + ([F.percentile_approx(value, wide, accuracy).alias(f"_q{i}") for i, value in enumerate(values)] if wide else [])


def _summaries(names: Sequence[str], seen: Mapping, sketched: bool) -> tuple[dict[str, Summary], dict[str, list]]:
    """Summaries of all columns, and a sketch's values at the wanted shares, from the aggregates."""
    summaries = {name: Summary(*[seen[f"_c{i}_{k}"] for k in range(len(_STATS))]) for i, name in enumerate(names)}
    return summaries, {name: seen[f"_q{i}"] or [] for i, name in enumerate(names)} if sketched else {}


def _groups(ranks: Sequence[int], count: int) -> list[list[int]]:
    """The valid ranks; neighbours, as interpolation needs them, together."""
    groups: list[list[int]] = []
    for rank in sorted({r for r in ranks if 0 <= r < count}):
        if groups and rank - groups[-1][-1] <= 1:
            groups[-1].append(rank)
        else:
            groups.append([rank])
    return groups


def _inside(view: DataFrame, brackets: list[_Bracket], cell) -> DataFrame:
    """(bracket, cell, value) of the rows for which ``cell`` gives a number."""
    entries = [F.struct(F.lit(i).alias("bracket"), cell(F.col(b.name), b).cast("int").alias("cell"), F.col(b.name).alias("value")) for i, b in enumerate(brackets)]
    return view.select(F.inline(F.array(*entries))).where("cell IS NOT NULL")


def _cell(value: Column, b: _Bracket) -> Column:
    """The cell of a value within the bracket, -1 below it if that is not counted yet, else null."""
    low, width = float(b.low), float(b.high) - float(b.low)
    place = F.least(F.floor((value.cast("double") - low) / width * CELLS), F.lit(CELLS - 1)) if 0 < width < math.inf else F.lit(0)
    if width == math.inf:  # from one end of the doubles to the other: infinite ones and both signs apart
        place = F.when(value == -math.inf, 0).when(value < 0, 1).when(value < math.inf, 2).otherwise(3)
    found = F.when((value >= F.lit(b.low)) & (value <= F.lit(b.high)), F.greatest(place, F.lit(0)))
    return found if b.below is not None else F.when(value < F.lit(b.low), -1).otherwise(found)


def _pick(view: DataFrame, brackets: list[_Bracket]) -> dict[int, dict[int, float]]:
    """The values at the wanted ranks of each bracket, as far as it holds them.

    Each round is one job for all brackets: tasks pass on the count, least and greatest value of each cell.  Cells of few rows
    end in a last job that counts their values, FEW_ROWS at most.
    """
    found: dict[int, dict[int, float]] = {i: {} for i in range(len(brackets))}
    active, few = list(enumerate(brackets)), []
    while active:
        cells = _inside(view, [b for _, b in active], _cell).groupBy("bracket", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        rows: dict[int, list] = {}
        for r in sorted(cells.collect(), key=lambda r: (r["bracket"], r["cell"])):  # CELLS + 1 for each bracket at most
            rows.setdefault(r["bracket"], []).append(r)
        further = []
        for k, (origin, b) in enumerate(active):
            at = b.below or 0
            for r in rows.get(k, []):
                ranks = [rank for rank in b.ranks if at <= rank < at + r["n"]] if r["cell"] >= 0 else []
                if ranks and r["low"] == r["high"]:
                    found[origin] |= dict.fromkeys(ranks, r["low"])
                elif ranks:
                    (few if r["n"] <= FEW_ROWS else further).append((origin, _Bracket(b.name, ranks, r["low"], r["high"], at)))
                at += r["n"]
        active = further
    if few:
        counted = _inside(view, [b for _, b in few], lambda value, b: F.when((value >= F.lit(b.low)) & (value <= F.lit(b.high)), 0))
        values = counted.groupBy("bracket", "value").agg(F.count(F.lit(1)).alias("n")).collect()
        at = [b.below for _, b in few]
        for r in sorted(values, key=lambda r: (r["bracket"], r["value"])):
            origin, b = few[r["bracket"]]
            found[origin] |= {rank: r["value"] for rank in b.ranks if at[r["bracket"]] <= rank < at[r["bracket"]] + r["n"]}
            at[r["bracket"]] += r["n"]
    return found


def _solve(
    view: DataFrame, ranks: Mapping[str, Sequence[int]], summaries: dict[str, Summary], sketches: dict[str, list], probs: Sequence[float],
    integral: bool, accuracy: int,
) -> dict[str, dict[int, float]]:
    """The value at each wanted rank of each column.

    ``sketches`` has values of each column at ``probs``.  The sketch is off by at most 1 / accuracy
    of the rows, so the next values at 2 / accuracy on either side bracket a rank;
    should one ever lie outside, the whole range of the column is its bracket.
    """
    brackets: list[_Bracket] = []
    for name, wanted in ranks.items():
        s = summaries[name]
        for group in _groups(wanted, s.count):
            shares = [rank / max(s.count - 1, 1) for rank in (group[0], group[-1])]
            lower = [v for p, v in zip(probs, sketches[name]) if p <= shares[0] - 2 / accuracy]
            upper = [v for p, v in zip(probs, sketches[name]) if p >= shares[1] + 2 / accuracy]
            low, high = max(lower, default=s.low), min(upper, default=s.high)
            if integral:
                low, high = max(s.low, int(low) - INTEGRAL_SLACK), min(s.high, int(high) + INTEGRAL_SLACK)
            brackets.append(_Bracket(name, group, low, high))
    found: dict[str, dict[int, float]] = {name: {} for name in ranks}
    while brackets:
        missed = []
        for i, values in _pick(view, brackets).items():
            b = brackets[i]
            found[b.name].update(values)
            if len(values) < len(b.ranks):
                missed.append(_Bracket(b.name, b.ranks, summaries[b.name].low, summaries[b.name].high))
        brackets = missed
    return found


def _around(shares: Sequence[float], accuracy: int) -> list[float]:
    """The shares that bracket the wanted ones."""
    slack = 3.0 / accuracy
    return sorted({min(1.0, max(0.0, share + side)) for share in shares for side in (-slack, slack)})


def exact_ranks(
    df: DataFrame,
    columns: Sequence[str] | Mapping[str, Column],
    ranks: Mapping[str, Sequence[int]],
    *,
    integral: bool = False,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, dict[int, float]]:
    """The values at the given 0-based ranks of each column (nulls left out), in four jobs and more only where values crowd.

    ``integral`` keeps 64-bit integers exact instead of going through doubles.
    """
    view = _view(df, columns, integral)
    summaries, _ = _summaries(view.columns, view.agg(*summary_aggs(view, view.columns, [], accuracy=accuracy, integral=integral)).first(), False)
    shares = {rank / max(summaries[name].count - 1, 1) for name, wanted in ranks.items() for rank in wanted if 0 <= rank < summaries[name].count}
    probs = _around(sorted(shares), accuracy)
    if not probs:
        return {name: {} for name in ranks}
    row = view.agg(*[F.percentile_approx(F.col(c), probs, accuracy).alias(c) for c in view.columns]).first()
    return _solve(view, ranks, summaries, {c: row[c] or [] for c in view.columns}, probs, integral, accuracy)


def exact_summary(
    df: DataFrame,
    columns: Sequence[str] | Mapping[str, Column],
    probs: Sequence[float],
    *,
    accuracy: int = SKETCH_ACCURACY,
    seen: Mapping | None = None,
) -> dict[str, Summary]:
    """Moments, extremes and linearly interpolated quantiles of each column, in two jobs, or three and more where values crowd.

    ``seen`` holds the ``summary_aggs`` of the same rows, columns and shares if they are known already.
    """
    view = _view(df, columns, False)
    wide = _around(probs, accuracy) if probs else []
    if seen is None:
        seen = view.agg(*summary_aggs(view, view.columns, probs, accuracy=accuracy)).first().asDict() if view.columns else {}
    summaries, sketches = _summaries(view.columns, seen, bool(wide))
    places = {
        name: [p * (s.count - 1) for p in probs] if s.count else [] for name, s in summaries.items()
    }
    ranks = {name: [r for at in wanted for r in (math.floor(at), math.ceil(at))] for name, wanted in places.items()}
    values = _solve(view, ranks, summaries, sketches, wide, False, accuracy)
    for name, s in summaries.items():
        for at in places[name]:
            low, high = values[name][math.floor(at)], values[name][math.ceil(at)]
            s.quantiles.append(low + (high - low) * (at - math.floor(at)))
        s.quantiles = s.quantiles or [None] * len(probs)
    return summaries


def exact_quantiles(
    df: DataFrame, columns: Sequence[str] | Mapping[str, Column], probs: Sequence[float], **options
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation; None for a column without values."""
    return {name: s.quantiles for name, s in exact_summary(df, columns, probs, **options).items()}


def approx_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], *, accuracy: int = SKETCH_ACCURACY
) -> dict[str, list[float | None]]:
    """One-pass quantiles with a rank error of at most rows / accuracy."""
    view = _view(df, columns, False)
    row = view.agg(*[F.percentile_approx(c, list(probs), accuracy).alias(c) for c in view.columns]).first()
    return {name: list(row[name]) if row[name] else [None] * len(probs) for name in view.columns}
