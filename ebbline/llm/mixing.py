"""Mixing documents to target shares of sources, languages and topics by iterative proportional fitting."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import arrow_map, mix, texts_of, uniform

OTHER = "other"
#: Topics are groups of words; TOPICS of them, over words of at least LONG_WORD bytes.
TOPICS, LONG_WORD = 6, 6
#: A share below this is what rounding leaves of 1.
LEAST = 1e-9


@dataclass(frozen=True)
class Targets:
    """Target shares of the tokens by dimension; what is not named goes to ``other``, which gets what is left.

    If nothing is left, ``other`` gets the share of the tokens it has, and the named values share the rest.
    ``keep`` is the share of all tokens to sample.  The table of cells has at most
    the product of the named values, whatever the size of the corpus.
    """

    source: dict[str, float] = field(default_factory=dict)
    lang: dict[str, float] = field(default_factory=dict)
    topic: dict[str, float] = field(default_factory=dict)
    keep: float = 0.5


def _topic(words: list[bytes], topics: int) -> str:
    """The group that holds most of the longer words, each hashed to a group; without one, ``other``."""
    long_ = [w for w in words if len(w) >= LONG_WORD]
    if not long_:
        return OTHER
    joined = np.array([int.from_bytes(w[:8], "little") for w in long_], np.uint64)
    counts = np.bincount((mix(joined, 4) % np.uint64(topics)).astype(np.int64), minlength=topics)
    return f"topic{int(np.argmax(counts))}"


def with_tokens_and_topic(docs: DataFrame, topics: int = TOPICS) -> DataFrame:
    """The rows with ``n_tokens`` (words) and ``topic``, counted over whole texts."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, names = [], []
        for text in texts_of(batch.column("text")):
            words = text.encode("utf-8", "surrogatepass").lower().split()
            sizes.append(len(words))
            names.append(_topic(words, topics))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(names, pa.string())], [*batch.schema.names, "n_tokens", "topic"])

    return arrow_map(docs, work, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", n_tokens long, topic string")


def _shares(named: dict[str, float]) -> dict[str, float]:
    if not named:
        return {OTHER: 1.0}
    total = sum(named.values())
    return {k: v / max(total, 1.0) for k, v in named.items()} | {OTHER: max(0.0, 1 - total)}


def _goals(shares: list[dict[str, float]], cells: np.ndarray) -> list[np.ndarray]:
    """The targets as arrays; an ``other`` that nothing is left for gets the share it has, so that its documents can be kept."""
    goals = []
    for axis, named in enumerate(shares):
        goal, other = np.array(list(named.values())), list(named).index(OTHER)
        if goal[other] < LEAST:
            has = np.take(cells, other, axis).sum() / max(cells.sum(), 1e-300)
            goal[other] = 0.0
            goal *= (1 - has) / goal.sum()
            goal[other] = has
        goals.append(goal)
    return goals


def fit_weights(cells: np.ndarray, targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Tokens wanted in every cell: the marginals meet ``targets`` and ratios within are kept.

    A target for which there are no tokens is spread over the rest of its dimension.
    """
    wanted = cells / max(cells.sum(), 1e-300)
    goals = []
    for axis, target in enumerate(targets):
        there = wanted.sum(axis=tuple(a for a in range(cells.ndim) if a != axis)) > 0
        goal = np.where(there, target, 0.0)
        goals.append(goal / goal.sum() if goal.sum() else there / max(there.sum(), 1))
    for _ in range(rounds):
        worst = 0.0
        for axis, goal in enumerate(goals):
            now = wanted.sum(axis=tuple(a for a in range(cells.ndim) if a != axis))
            factor = np.divide(goal, now, out=np.ones_like(now), where=now > 0)
            worst = max(worst, np.abs(now - goal).max())
            wanted = wanted * factor.reshape([-1 if a == axis else 1 for a in range(cells.ndim)])
        if worst < tolerance:
            return wanted
    warnings.warn(f"the marginals are still off by {worst:.2g} after {rounds} rounds; the targets may contradict each other", stacklevel=2)
    return wanted


def probabilities(cells: np.ndarray, wanted: np.ndarray, keep: float) -> tuple[np.ndarray, np.ndarray]:
    """Weight of a token in each cell, and the chance of its documents.

    Chances are proportional to weights, at most 1, and scaled so that ``keep`` of all tokens is expected.
    """
    share = cells / max(cells.sum(), 1e-300)
    weight = np.divide(wanted, share, out=np.zeros_like(share), where=share > 0)
    goal = min(keep, share[weight > 0].sum())
    low, high = 0.0, 1.0
    while (share * np.minimum(1, high * weight)).sum() < goal - 1e-12 and high < 1e12:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.minimum(1, middle * weight)).sum() < goal else (low, middle)
    return weight, np.minimum(1, high * weight)


def mix_sources(docs: DataFrame, targets: Targets) -> DataFrame:
    """The rows with ``n_tokens``, ``topic``, ``weight``, ``probability`` and ``kept``.

    Token weights are raked to the marginals of source, language and topic, and a
    document is kept if its draw, the same on every run, is below its
    cell's probability.  Null or unnamed sources and languages count as ``other``;
    an empty text has no tokens and topic ``other`` and goes by its cell, or with weight 1 and probability ``keep``
    if its cell has no tokens.  The draw is that of doc_id and text: equal rows share it, other rows of one
    doc_id or without one do not.  An empty table gives no rows.  Columns of ``docs`` named like a result are replaced, all others stay.
    The result is reproducible; sums are whole numbers, so the layout does not matter.  Targets that no weights can
    meet leave a warning and the weights of the last round.
    """
    docs = with_tokens_and_topic(docs.drop("n_tokens", "topic", "weight", "probability", "kept"))
    names = ["source", "lang", "topic"]
    shares = [_shares(getattr(targets, n)) for n in names]

    def cell(name: str, named: dict):
        return F.when(F.col(name).isin([k for k in named if k != OTHER]), F.col(name)).otherwise(F.lit(OTHER))

    free = "_" * (1 + max(len(c) for c in docs.columns))  # longer than any column, so that no name clashes
    keys = [free + n for n in names]
    placed = docs.withColumns({k: cell(n, s) for k, n, s in zip(keys, names, shares, strict=True)})
    sums = placed.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")).collect()  # one row for each cell of the targets
    places = [{k: i for i, k in enumerate(s)} for s in shares]
    cells = np.zeros([len(s) for s in shares])
    for row in sums:
        cells[tuple(p[row[k]] for p, k in zip(places, keys, strict=True))] = row["tokens"]
    weight, chance = probabilities(cells, fit_weights(cells, _goals(shares, cells)), targets.keep)
    rows = [(*(list(p)[i] for p, i in zip(places, at, strict=True)), float(weight[at]), float(chance[at])) for at in np.ndindex(cells.shape) if cells[at]]
    kinds = ", ".join(f"{k} string" for k in keys) + ", weight double, probability double"
    fitted = docs.sparkSession.createDataFrame(rows, kinds)
    joined = placed.join(F.broadcast(fitted), keys, "left").drop(*keys)
    joined = joined.withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "probability": F.coalesce("probability", F.lit(targets.keep))})
    return joined.withColumn("kept", uniform(F.xxhash64("doc_id", "text"), 44) < F.col("probability"))
