"""Attribution of scores to features, on the log-odds scale."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.operators.trees import TreeEnsemble

NEGLIGIBLE = 1e-6
CHUNK_CELLS = 200_000
#: Levels of splits that share a state, tests that make up a state at most, and rows looked up at once.
STATE_LEVELS, STATE_BITS, STATE_ROWS = 2, 8, 256

# The one function that runs in Python workers travels with the task, so the
# workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ── linear model ────────────────────────────────────────────────────────────


def feature_means(featured: DataFrame) -> list[float]:
    return [float(x) for x in featured.agg(Summarizer.mean(F.col("features"))).first()[0]]


def shap_linear(featured: DataFrame, model, means: Sequence[float]) -> DataFrame:
    """Add ``shap`` (array, one per feature) and ``base_value``: coefficient × distance from the mean."""
    coefficients = [float(c) for c in model.coefficients]
    base = float(model.intercept) + float(np.dot(coefficients, means))
    contributions = F.zip_with(
        F.zip_with(vector_to_array("features"), F.lit(list(means)), lambda x, m: x - m),
        F.lit(coefficients), lambda d, c: d * c,
    )
    return featured.withColumns({"shap": contributions, "base_value": F.lit(base)})


# ── boosted trees ───────────────────────────────────────────────────────────


def _boxes(model: TreeEnsemble) -> list[tuple[dict[int, tuple[float, float, float]], float]]:
    """(path box, value) of each leaf of all trees."""
    leaves = []
    stack = [(int(root), {}) for root in model.roots]
    while stack:
        at, box = stack.pop()
        feature = int(model.feature[at])
        if feature < 0:
            leaves.append((box, float(model.value[at])))
            continue
        threshold = float(model.threshold[at])
        for child, low_side in ((int(model.left[at]), True), (int(model.right[at]), False)):
            low, high, share = box.get(feature, (-np.inf, np.inf, 1.0))
            low, high = (low, min(high, threshold)) if low_side else (max(low, threshold), high)
            stack.append((child, box | {feature: (low, high, share * model.cover[child] / model.cover[at])}))
    return leaves


def leaf_table(model: TreeEnsemble) -> dict[str, Any]:
    """All leaves of a boosted model, each as the box its path cuts out of feature space.

    Column i of the arrays is a leaf, row k one of the features on its path:
    the ``feature``, the interval (``low``, ``high``] it must lie in, and the
    ``share`` of the training weight that the path keeps on account of it.  Unused
    places have an unbounded interval and share 1.

    The size is set by the model (rounds × 2^depth leaves), not by the data.
    """
    leaves = _boxes(model)
    width = max([len(box) for box, _ in leaves] + [1])
    shape = (width, len(leaves))
    feature, share = np.zeros(shape, dtype=np.int32), np.ones(shape)
    low, high = np.full(shape, -np.inf), np.full(shape, np.inf)
    for i, (box, _) in enumerate(leaves):
        for k, (f, (lo, hi, kept)) in enumerate(box.items()):
            feature[k, i], low[k, i], high[k, i], share[k, i] = f, lo, hi, kept
    value = np.array([v for _, v in leaves])
    base = float((value * share.prod(axis=0)).sum())
    return {"feature": feature, "low": low, "high": high, "share": share, "value": value, "base": base}


def leaf_attributions(table: dict[str, Any], x: np.ndarray) -> np.ndarray:
    """Shapley values of each row of ``x``, path-dependent (Lundberg et al., 2018).

    For one leaf the value of feature j is
    v · (o_j - z_j) · ∫₀¹ Π_{i≠j} (z_i (1 - t) + o_i t) dt,
    where o_i says whether the row lies in the interval and z_i is the share.
    The integrand is a polynomial, so a few Gauss points give it exactly.
    """
    feature, share, value = table["feature"], table["share"], table["value"]
    # Per path position, its leaves in the order of their features, to sum up runs of one feature.
    orders = [np.argsort(row, kind="stable") for row in feature]
    starts = [np.flatnonzero(np.r_[True, np.diff(row[order]) > 0]) for row, order in zip(feature, orders)]
    out = np.zeros(x.shape)
    step = max(1, CHUNK_CELLS // feature.size)
    for begin in range(0, len(x), step):
        rows = x[begin:begin + step]
        target = out[begin:begin + step]
        inside = [(rows[:, f] > low) & (rows[:, f] <= high) for f, low, high in zip(feature, table["low"], table["high"])]
        for k, total in enumerate(_contributions(inside, share, value)):
            runs = np.add.reduceat(total[:, orders[k]], starts[k], axis=1)
            target[:, feature[k][orders[k]][starts[k]]] += runs
    return out


def _contributions(inside: list[np.ndarray], share: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
    """What each path position of each leaf (columns) contributes, where ``inside`` says which intervals hold (rows)."""
    points, weights = np.polynomial.legendre.leggauss((len(share) + 1) // 2)
    points, weights = (points + 1) / 2, weights / 2
    totals = [np.zeros(inside[0].shape) for _ in share]
    for t, w in zip(points, weights):
        factors = [z * (1 - t) + o * t for z, o in zip(share, inside)]
        product = w * value * factors[0]
        for factor in factors[1:]:
            product *= factor
        for total, factor in zip(totals, factors):
            total += product / factor
    return [total * (o - z) for total, o, z in zip(totals, inside, share)]


def _groups(model: TreeEnsemble) -> Iterator[tuple[list[tuple[int, float, float]], list[tuple[dict[int, tuple[float, int, int]], float]]]]:
    """(tests, leaves) of the lowest subtrees.

    A test (feature, low, high) asks whether the feature lies in (``low``, ``high``]; its place is a bit of the state.  For each
    feature on its path a leaf has (share, mask, wanted): a row lies in its interval if the masked bits are the wanted ones.
    """
    top = max(0, model.depth - STATE_LEVELS)
    stack = [(int(root), 0, {}) for root in model.roots]
    while stack:
        at, depth, box = stack.pop()
        feature = int(model.feature[at])
        if feature >= 0 and depth < top:
            threshold = float(model.threshold[at])
            for child, low_side in ((int(model.left[at]), True), (int(model.right[at]), False)):
                low, high, share = box.get(feature, (-np.inf, np.inf, 1.0))
                low, high = (low, min(high, threshold)) if low_side else (max(low, threshold), high)
                stack.append((child, depth + 1, box | {feature: (low, high, share * model.cover[child] / model.cover[at])}))
            continue
        tests = [(f, low, high) for f, (low, high, _) in box.items()]
        leaves = []
        below = [(at, {f: (share, 1 << k, 1 << k) for k, (f, (_, _, share)) in enumerate(box.items())})]
        while below:
            node, held = below.pop()
            feature = int(model.feature[node])
            if feature < 0:
                leaves.append((held, float(model.value[node])))
                continue
            bit = 1 << len(tests)
            tests.append((feature, -np.inf, float(model.threshold[node])))
            for child, wanted in ((int(model.left[node]), bit), (int(model.right[node]), 0)):
                share, mask, want = held.get(feature, (1.0, 0, 0))
                below.append((child, held | {feature: (share * model.cover[child] / model.cover[node], mask | bit, want | wanted)}))
        yield tests, leaves


def state_table(model: TreeEnsemble) -> dict[str, Any] | None:
    """What the lowest subtrees of a boosted model contribute to each feature in every state; None if states have too many bits.

    A row's state in a subtree says which of the tests hold that lead to and through it, so a few look-ups replace
    the integrals of its leaves.  ``codes`` has for each feature the bits of all subtrees by its bin among ``edges``, ``worth``
    by (subtree, feature) and state the contribution, sorted by feature.  The size is set by the model.
    """
    groups = list(_groups(model))
    bits = max(len(tests) for tests, _ in groups)
    if bits > STATE_BITS:
        return None
    tested: dict[int, list[tuple[int, int, float, float]]] = {}
    for group, (tests, _) in enumerate(groups):
        for bit, (feature, low, high) in enumerate(tests):
            tested.setdefault(feature, []).append((group, bit, low, high))
    edges, codes = {}, {}
    for feature, own in tested.items():
        ends = edges[feature] = np.unique([e for _, _, *both in own for e in both if np.isfinite(e)])
        code = codes[feature] = np.zeros((len(ends) + 1, len(groups)), np.uint8)
        for group, bit, low, high in own:
            first = np.searchsorted(ends, low) + 1 if np.isfinite(low) else 0
            last = np.searchsorted(ends, high) + 1 if np.isfinite(high) else len(code)
            code[first:last, group] |= 1 << bit
    features = sorted(tested)
    entry = {pair: i for i, pair in enumerate(sorted({(f, g) for g, (_, leaves) in enumerate(groups) for held, _ in leaves for f in held}))}
    worth, states = np.zeros((len(entry) + 1, 1 << bits)), np.arange(1 << bits)[:, None]  # the last one is for unused places
    leaves = [(g, held, value) for g, (_, own) in enumerate(groups) for held, value in own]
    width = max([len(held) for _, held, _ in leaves] + [1])
    step = max(1, CHUNK_CELLS // (width * len(states)))
    for begin in range(0, len(leaves), step):
        part = leaves[begin : begin + step]
        share, mask, want, place = np.ones((width, len(part))), *np.zeros((2, width, len(part)), np.int64), np.full((width, len(part)), len(entry))
        for i, (group, held, _) in enumerate(part):
            for k, (feature, (kept, masked, wanted)) in enumerate(held.items()):
                share[k, i], mask[k, i], want[k, i], place[k, i] = kept, masked, wanted, entry[feature, group]
        inside = [(states & m) == w for m, w in zip(mask, want)]
        for total, at in zip(_contributions(inside, share, np.array([value for *_, value in part])), place):
            np.add.at(worth, at, total.T)
    spans = {f: [i for (g, _), i in entry.items() if g == f] for f in features}
    return {
        "edges": [edges[f] for f in features], "codes": [codes[f] for f in features], "features": features, "worth": worth[:-1],
        "groups": np.array([g for _, g in entry], np.int64), "spans": [(min(own), max(own) + 1) for own in spans.values()],
    }


def state_attributions(table: dict[str, Any], x: np.ndarray) -> np.ndarray:
    """Shapley values of each row of ``x`` as :func:`leaf_attributions` has them, read from the states of the subtrees."""
    out, worth = np.zeros(x.shape), table["worth"]
    size, flat = worth.shape[1], worth.ravel()
    if not table["features"]:
        return out
    for begin in range(0, len(x), STATE_ROWS):
        rows, target = x[begin : begin + STATE_ROWS], out[begin : begin + STATE_ROWS]
        state: Any = 0
        for feature, ends, code in zip(table["features"], table["edges"], table["codes"]):
            state = code[np.searchsorted(ends, rows[:, feature], side="left")] | state
        state = np.ascontiguousarray(state.T)  # a subtree's values lie together, and so do its look-ups
        for feature, (first, last) in zip(table["features"], table["spans"]):
            at = state[table["groups"][first:last]] + (np.arange(first, last) * size)[:, None]
            target[:, feature] = flat.take(at).sum(axis=0)
    return out


def shap_tree(featured: DataFrame, model: TreeEnsemble) -> DataFrame:
    """Add ``shap`` and ``base_value`` of a boosted model; base + sum of shap is the log-odds of the score.

    Only the feature array crosses to Python, in Arrow batches.
    """
    spark = featured.sparkSession
    table = leaf_table(model)
    states = state_table(model)
    attribute = leaf_attributions if states is None else state_attributions
    shared = spark.sparkContext.broadcast(table if states is None else states)

    @F.pandas_udf("array<double>")
    def attributions(rows: pd.Series) -> pd.Series:
        if rows.empty:
            return rows
        return pd.Series(list(attribute(shared.value, np.stack(rows.to_numpy()))))

    return featured.withColumns({"shap": attributions(vector_to_array("features")), "base_value": F.lit(table["base"])})


# ── reading attributions ────────────────────────────────────────────────────


def top_factors(explained: DataFrame, names: Sequence[str], short: int = 5, long: int = 20) -> DataFrame:
    """Add ``shap_explanations`` and ``top_factors``: the largest contributions of each row.

    Contributions below 1e-6 are left out; equal ones keep the feature order.
    """
    labels = F.array(*[F.lit(name) for name in names])
    entries = F.zip_with("shap", vector_to_array("features"), lambda s, v: F.struct(s.alias("s"), v.alias("v")))
    numbered = F.transform(entries, lambda e, i: F.struct(
        (-F.abs(F.round(e["s"], 6))).alias("rank"), i.alias("i"), F.get(labels, i).alias("feature"),
        F.round(e["v"], 4).alias("value"), F.round(e["s"], 6).alias("shap_value"),
        F.when(e["s"] > 0, "+").otherwise("-").alias("contribution"), e["s"].alias("raw"),
    ))
    kept = F.sort_array(F.filter(numbered, lambda e: F.abs(e["raw"]) >= NEGLIGIBLE))
    full = F.transform(F.slice(kept, 1, long), lambda e: F.struct(
        e["feature"].alias("feature"), e["value"].alias("value"), e["shap_value"].alias("shap_value"),
        e["contribution"].alias("contribution"),
    ))
    return explained.withColumn("shap_explanations", full).withColumn(
        "top_factors",
        F.transform(F.slice("shap_explanations", 1, short), lambda e: F.struct(
            e["feature"].alias("feature"), e["shap_value"].alias("shap_value"), e["contribution"].alias("contribution")
        )),
    )


def shap_global(explained: DataFrame, names: Sequence[str], top: int | None = 15) -> DataFrame:
    """(rank, feature, importance): mean absolute contribution; one aggregate, one row of averages."""
    means = explained.agg(*[F.avg(F.abs(F.get("shap", F.lit(i)))).alias(f"m{i}") for i in range(len(names))])
    listed = F.array(*[
        F.struct((-F.col(f"m{i}")).alias("neg"), F.lit(name).alias("feature")) for i, name in enumerate(names)
    ])
    ranked = means.select(F.posexplode(F.sort_array(listed)).alias("pos", "e")).select(
        (F.col("pos") + 1).alias("rank"), "e.feature", (-F.col("e.neg")).alias("importance")
    )
    return ranked.where(F.col("rank") <= top) if top else ranked


def shap_dependence(explained: DataFrame, names: Sequence[str], feature: str | None = None) -> DataFrame:
    """(value, shap_value) of one feature for every row; by default the most important one."""
    feature = feature or shap_global(explained, names, 1).first()["feature"]
    i = list(names).index(feature)
    return explained.select(
        F.lit(feature).alias("feature"),
        F.get(vector_to_array("features"), F.lit(i)).alias("value"), F.get("shap", F.lit(i)).alias("shap_value"),
    )


def shap_waterfall(explained: DataFrame, names: Sequence[str], key: str, key_value, shown: int = 10) -> DataFrame:
    """One row's base value, its largest contributions, the rest as one line, and the resulting log-odds."""
    single = len(names) if shown >= len(names) else shown - 1
    labels = F.array(*[F.lit(name) for name in names])
    ranked = F.sort_array(F.transform("shap", lambda s, i: F.struct(
        (-F.abs(s)).alias("rank"), i.alias("i"), F.get(labels, i).alias("feature"), s.alias("shap_value")
    )))

    def line(name, value):
        return F.struct(name.alias("feature"), value.alias("shap_value"))

    def total(items):
        return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + e["shap_value"])

    first, rest = F.slice("ranked", 1, single), F.slice("ranked", single + 1, len(names))
    steps = F.concat(
        F.array(line(F.lit("base_value"), F.col("base_value"))),
        F.transform(first, lambda e: line(e["feature"], e["shap_value"])),
        *([] if single == len(names) else [F.array(line(F.lit(f"{len(names) - single} other features"), total(rest)))]),
        F.array(line(F.lit("log_odds"), F.col("base_value") + total(F.col("ranked")))),
    )
    return (
        explained.where(F.col(key) == key_value).withColumn("ranked", ranked)
        .select(F.posexplode(steps).alias("step", "e")).select("step", "e.feature", "e.shap_value")
    )
