"""Ensembles of decision trees grown from grouped sums over binned columns.

Training rows are binned once and staged in blocks, which the executors keep while trees grow.  A level of a boosted tree is
one small job, in which each task adds up its blocks and the driver adds up the tasks, as long as these are few.  Otherwise, and for
forests, a level of all open nodes is one grouped aggregate: the sums of three whole numbers by (node, column, bin), from which the best split of each node
is read.  Nodes that few rows have reached are handed, rows and all, to one task each, which grows the rest of their tree
by the same rules.  All sums
are whole numbers and all draws depend on the row, the tree and the node only, so neither the layout of the rows nor
the way a node is grown changes a tree.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.session import staged

# What runs in Python workers travels with the task, so the workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins of a column at most, and rows of smallest draw from which their edges are taken (fewer for very wide vectors).
MAX_BINS, EDGE_ROWS, EDGE_CELLS = 256, 20_000, 20_000_000
#: Rows of a staged block at most, and rows of a node that one task finishes.
BLOCK_ROWS, FINISHED_ROWS = 1 << 16, 1 << 15
#: Open nodes whose sums the driver reads at most; those of more are read by tasks.
DRIVER_NODES = 64
#: Sums of all tasks that the driver adds up itself at most, which saves a shuffle; more are grouped by tasks.
DRIVER_SUMS = 1_000_000
#: Rows, in multiples of FINISHED_ROWS, up to which levels of boosted trees are summed by small jobs, and those worth one more task.
KEPT_NODES, TASK_ROWS = 1024, 1 << 13
#: Cells of the sums that a task holds at once, at most.
HELD_CELLS = 4_000_000
#: Rounds after which the margins of the rows are written anew, which cuts the lineage of the kept ones.
MARGIN_ROUNDS = 10
#: Draws are products modulo this prime, which other engines can compute too.
PRIME = 2147483647
#: A Poisson(1) count of a draw is the number of these it reaches: the first shares of the distribution, cumulated.
POISSON = (np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 13)])) * PRIME).astype(np.int64)


# ── fitted ensembles ────────────────────────────────────────────────────────


@dataclass
class TreeEnsemble:
    """All nodes of all trees in flat arrays; the ``left`` and ``right`` of a leaf is the leaf itself.

    ``boosted``: the log-odds of a row are the sum of its leaves' values.  ``forest``: the probability is their mean.
    ``cover`` is the weight of the training rows of a node, ``gain`` what its split improves.
    """

    kind: str
    width: int
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of each row of ``x``, in chunks of bounded size."""
        split, cut = np.maximum(self.feature, 0), np.where(self.feature < 0, np.inf, self.threshold)
        out, step = np.empty(len(x)), max(1, 2_000_000 // max(len(self.roots), 1))
        for at in range(0, len(x), step):
            rows = x[at : at + step]
            node = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
            for _ in range(self.depth):
                low = np.take_along_axis(rows, split[node], axis=1) <= cut[node]
                node = np.where(low, self.left[node], self.right[node])
            values = self.value[node]
            out[at : at + step] = 1 / (1 + np.exp(-values.sum(axis=1))) if self.kind == "boosted" else values.mean(axis=1)
        return out

    def importances(self) -> np.ndarray:
        """Shares of the features: the mean gain of their splits (boosted), or the mean over the trees of their share of the gains."""
        inner = self.feature >= 0
        if self.kind == "boosted":
            total = np.bincount(self.feature[inner], self.gain[inner], self.width)
            found = total / np.maximum(np.bincount(self.feature[inner], minlength=self.width), 1)
        else:
            tree = np.searchsorted(self.roots, np.arange(len(self.feature)), side="right") - 1
            sums = np.bincount(tree[inner] * self.width + self.feature[inner], self.gain[inner], len(self.roots) * self.width).reshape(-1, self.width)
            found = (sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300)).mean(axis=0)
        return found / max(found.sum(), 1e-300)

    def save(self, spark: SparkSession, path: str) -> None:
        table = pa.table({
            "node": np.arange(len(self.feature)), "tree": np.searchsorted(self.roots, np.arange(len(self.feature)), side="right") - 1,
            **{name: getattr(self, name) for name in _NODE_COLUMNS},
        })
        about = f"'{self.kind}' AS kind, {self.width} AS width, {self.depth} AS depth"
        spark.createDataFrame(table).selectExpr("*", *about.split(", ")).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TreeEnsemble:
        """The saved nodes, as many as the model has."""
        table = spark.read.parquet(f"{path}/trees").orderBy("node").toArrow()
        columns = {name: table.column(name).to_numpy() for name in ("tree", *_NODE_COLUMNS)}
        roots = np.flatnonzero(np.diff(columns.pop("tree"), prepend=-1))
        first = {name: table.column(name)[0].as_py() for name in ("kind", "width", "depth")}
        return TreeEnsemble(**first, roots=roots, **columns)


_NODE_COLUMNS = ["feature", "threshold", "left", "right", "value", "cover", "gain"]


def add_tree_probability(featured: DataFrame, model: TreeEnsemble, output: str) -> DataFrame:
    """Add the probability of the positive class; only the feature array crosses to Python, in Arrow batches."""
    shared = featured.sparkSession.sparkContext.broadcast(model)  # as large as the model, whatever the rows

    @F.pandas_udf("double")
    def probability(rows: pd.Series) -> pd.Series:
        return pd.Series(shared.value.probability(np.stack(rows.to_numpy())) if len(rows) else [], dtype=float)

    return featured.withColumn(output, probability(vector_to_array("features")))


# ── rules ───────────────────────────────────────────────────────────────────


@dataclass
class Rules:
    """How a tree grows; ``kind`` chooses between the two sets of formulas.

    The three sums of a node are, boosted: gradients and Hessians in units of 1 / ``scale``, and rows; forest:
    drawn rows with label 1 and with label 0, each as often as drawn, and different rows.
    """

    kind: str
    depth: int
    scale: float = 1.0
    rate: float = 0.1
    penalty: float = 1.0
    least_hessian: float = 1.0
    least_gain: float = 1e-6
    min_split: int = 10
    min_leaf: int = 5

    def weigh(self, sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Gradient and Hessian, or the weights of both labels."""
        return sums[..., :2] / self.scale if self.kind == "boosted" else sums[..., :2] * weights

    def score(self, sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
        first, second = np.moveaxis(self.weigh(sums, weights), -1, 0)
        if self.kind == "boosted":
            return first * first / (second + self.penalty) / 2
        return (first * first + second * second) / np.maximum(first + second, 1e-300)

    def large(self, sums: np.ndarray) -> np.ndarray:
        """Whether the sums of one side allow a split."""
        return sums[..., 1] >= self.least_hessian * self.scale if self.kind == "boosted" else sums[..., 2] >= self.min_leaf

    def open(self, sums: np.ndarray, depth: int) -> bool:
        """Whether a node is to be split, if a split is found."""
        if depth >= self.depth:
            return False
        if self.kind == "boosted":
            return sums[1] >= 2 * self.least_hessian * self.scale
        return sums[2] >= max(self.min_split, 2 * self.min_leaf) and sums[0] > 0 and sums[1] > 0

    def leaf(self, sums: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
        """(value, cover) of a node."""
        first, second = (float(v) for v in self.weigh(sums, weights))
        if self.kind == "boosted":
            return -self.rate * first / (second + self.penalty), second
        return first / max(first + second, 1e-300), first + second


@dataclass
class Columns:
    """Where the bins of each column lie among all slots."""

    counts: np.ndarray
    offset: np.ndarray = field(init=False)
    owner: np.ndarray = field(init=False)
    inner: np.ndarray = field(init=False)

    def __post_init__(self):
        self.offset = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.inner = np.arange(len(self.owner)) < (self.offset + self.counts - 1)[self.owner]  # behind the last bin nothing is left


def best_split(sums: np.ndarray, total: np.ndarray, columns: Columns, rules: Rules, weights: np.ndarray):
    """(column, last bin of the low side, gain, sums of the low side) of the best split, the first of several; None without one."""
    low = np.cumsum(sums, axis=0)
    begin = np.zeros((len(columns.counts), 3), np.int64)
    begin[1:] = low[columns.offset[1:] - 1]
    low -= begin[columns.owner]
    high = total - low
    allowed = columns.inner & rules.large(low) & rules.large(high)
    if not allowed.any():
        return None
    scores = np.where(allowed, rules.score(low, weights) + rules.score(high, weights), -np.inf)
    slot = int(np.argmax(scores))
    gain = float(scores[slot] - rules.score(total, weights))
    if rules.kind == "boosted" and gain <= rules.least_gain:
        return None
    column = int(columns.owner[slot])
    return column, int(slot - columns.offset[column]), gain, low[slot]


def drawn_columns(seed: int, tree: int, path: int, width: int, share: float | str) -> np.ndarray:
    """The columns a node may be split by: of each node, as many as the root of all of them, or of each tree, a share."""
    if share == "sqrt":
        return np.sort(np.random.default_rng([seed, tree, path]).permutation(width)[: max(1, int(width**0.5))])
    return np.sort(np.random.default_rng([seed, tree]).permutation(width)[: max(1, int(share * width))])


def row_draw(seed: int, tree: int) -> tuple[int, int]:
    """Factor and offset of a tree's draws: (row · factor + offset) modulo PRIME."""
    rng = np.random.default_rng([seed, tree, 1 << 20])
    return int(rng.integers(1, PRIME)), int(rng.integers(PRIME))


def draws(rows: np.ndarray, factor: int, offset: int) -> np.ndarray:
    return (rows % PRIME * factor + offset) % PRIME


# ── binned rows ─────────────────────────────────────────────────────────────


def column_edges(values: np.ndarray) -> list[np.ndarray]:
    """Thresholds of each column: between all values if they are few, else between those at equal shares of the rows."""
    edges = []
    for column in values.T:
        seen = np.unique(column)
        if len(seen) > MAX_BINS:
            places = np.arange(1, MAX_BINS) * len(column) // MAX_BINS
            last = np.unique(np.sort(column)[places - 1])
            at = np.searchsorted(seen, last)
            at = at[at < len(seen) - 1]
            edges.append((seen[at] + seen[at + 1]) / 2)
        else:
            edges.append((seen[1:] + seen[:-1]) / 2)
    return edges


def _edges(rows: DataFrame, count: int, width: int) -> list[np.ndarray]:
    """From the EDGE_ROWS rows of smallest draw; tables that are smaller give all."""
    most = max(1, min(EDGE_ROWS, EDGE_CELLS // max(width, 1)))
    order = F.pmod(F.xxhash64("row"), F.lit(1 << 40))
    few = rows.where(order < int(2.0 * most / count * (1 << 40))) if count > 2 * most else rows
    table = few.orderBy(order, "row", "x").limit(most).select("x").toArrow()
    return column_edges(table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width))


def _blocks(rows: DataFrame, edges: list[np.ndarray], parts: int) -> DataFrame:
    """The rows in blocks of packed arrays: bins, labels and row numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            bins, label, row = (np.concatenate(parts_) for parts_ in zip(*held))
            held.clear()
            return pa.RecordBatch.from_pydict({"bins": [bins.tobytes()], "label": [label.tobytes()], "row": [row.tobytes()], "margin": [np.zeros(len(row)).tobytes()]})

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            bins = np.stack([np.searchsorted(e, x[:, c], side="left") for c, e in enumerate(edges)], axis=1).astype(np.uint8)
            held.append((bins, batch.column("label").to_numpy().astype(np.uint8), batch.column("row").to_numpy()))
            if sum(len(r) for _, _, r in held) >= BLOCK_ROWS:
                yield flush()
        if held:
            yield flush()

    spread = rows.repartition(parts)
    return staged(spread.mapInArrow(pack, _BLOCK), "tree-rows")


_BLOCK = "bins binary, label binary, row binary, margin binary"


def _unpacked(batches: Iterator[pa.RecordBatch], width: int):
    """(bins, label, row, margin) of every block."""
    for batch in batches:
        for values in zip(*(batch.column(c) for c in ("bins", "label", "row", "margin"))):
            bins, label, row, margin = (np.frombuffer(v.as_py(), k) for v, k in zip(values, (np.uint8, np.uint8, np.int64, np.float64)))
            yield bins.reshape(-1, width), label, row, margin


_NODE = "tree long, path long, column long, cut long, value double, cover double, gain double"
_NODE_NAMES = [column.split()[0] for column in _NODE.split(", ")]


# ── growth ──────────────────────────────────────────────────────────────────


def slot_sums(bins: np.ndarray, values: np.ndarray, node: np.ndarray, drawn: np.ndarray, columns: Columns) -> Iterator[tuple[np.ndarray, ...]]:
    """(node, slot, three sums) of the slots that rows reach, by the columns ``drawn`` for each node.

    Whole numbers below 2^53 are exact in the weights of a count.  Nodes are taken in groups, as many as HELD_CELLS allow.
    """
    slots, step = len(columns.owner), max(1, HELD_CELLS // (3 * len(columns.owner)))
    for begin in range(0, len(drawn), step):
        own = drawn[begin : begin + step]
        taken = np.flatnonzero((node >= begin) & (node < begin + len(own))) if step < len(drawn) else slice(None)
        at, wide, rows = node[taken] - begin, bins[taken], values[taken]
        weights = [np.ascontiguousarray(rows[:, k], float) for k in range(3)]
        sums = np.zeros((3, len(own), slots))
        for place in own.T:
            if (place == place[0]).all():  # one column for all nodes
                first, many = columns.offset[place[0]], columns.counts[place[0]]
                codes = at * many + wide[:, place[0]]
                for total, weight in zip(sums, weights):
                    total[:, first : first + many] += np.bincount(codes, weight, len(own) * many).reshape(-1, many)
            else:
                column = place[at]
                codes = at * slots + columns.offset[column] + wide[np.arange(len(at)), column]
                for total, weight in zip(sums, weights):
                    total += np.bincount(codes, weight, len(own) * slots).reshape(-1, slots)
        kept = np.flatnonzero(sums[2])
        yield kept // slots + begin, kept % slots, *(total.ravel()[kept].astype(np.int64) for total in sums)


class Grower:
    """Grows some trees at once over staged blocks; nodes are named by tree and path, 1 for the root and 2p, 2p + 1 below p.

    ``stats`` gives, for a block and a tree, the three whole numbers of each row, and which rows take part.
    """

    def __init__(self, blocks: DataFrame, columns: Columns, rules: Rules, stats: Callable, share: float | str, seed: int, parts: int):
        self.blocks, self.columns, self.rules, self.stats, self.share, self.seed, self.parts = blocks, columns, rules, stats, share, seed, parts

    def grow(self, weights: dict[int, np.ndarray]) -> dict[tuple[int, int], tuple]:
        """{(tree, path): (column or -1, bin, value, cover, gain)} of all nodes of the trees that ``weights`` names."""
        rules = self.rules
        nodes: dict[tuple[int, int], tuple] = {}
        open_: list[tuple[int, int]] = [(tree, 1) for tree in weights]
        small: list[tuple[int, int]] = []

        def place(key: tuple[int, int], sums: np.ndarray) -> None:
            tree, path = key
            if not rules.open(sums, path.bit_length() - 1):
                nodes[key] = (-1, 0, *rules.leaf(sums, weights[tree]), 0.0)
            else:
                (small if sums[2] <= FINISHED_ROWS else open_).append(key)

        while open_:
            now, open_ = sorted(open_), []
            found = self._splits(now, nodes, weights)
            for key in now:
                tree, path = key
                column, cut, gain, low, total = found.get(key, (-1, 0, 0.0, None, np.zeros(3, np.int64)))  # no row may be drawn
                nodes[key] = (column, cut, *rules.leaf(total, weights[tree]), gain)
                if column >= 0:
                    place((tree, 2 * path), low)
                    place((tree, 2 * path + 1), total - low)
            if open_ and len(open_) + len(small) <= DRIVER_NODES:  # the level is summed anyway, with the rows of small nodes
                open_, small = open_ + small, []
        return nodes | self._finished(small, nodes, weights) if small else nodes

    def _routes(self, keys: list[tuple[int, int]], nodes: dict) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
        """For each tree its splits and the numbers of the wanted nodes by path, and the levels down to them."""
        levels = max(path.bit_length() - 1 for _, path in keys)
        found = {t: (np.full(2 << levels, -1, np.int32), np.zeros(2 << levels, np.uint8), np.full(2 << levels, -1, np.int32)) for t in {t for t, _ in keys}}
        for (tree, path), (column, cut, *_) in nodes.items():
            if tree in found and path < 2 << levels:
                found[tree][0][path], found[tree][1][path] = column, cut
        for number, (tree, path) in enumerate(keys):
            found[tree][2][path] = number
        return found, levels

    def totals(self, trees: list[int]) -> dict[int, np.ndarray]:
        """The three sums of every tree over all rows."""
        stats, width = self.stats, len(self.columns.counts)

        def work(batches):
            for block in _unpacked(batches, width):
                sums = np.array([values.sum(axis=0) for values, _ in (stats(block, t) for t in trees)], np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int64()), *(pa.array(sums[:, k]) for k in range(3))], ["tree", "s0", "s1", "s2"])

        rows = self.blocks.mapInArrow(work, "tree long, s0 long, s1 long, s2 long").groupBy("tree").agg(*(F.sum(f"s{k}") for k in range(3))).collect()
        return {r["tree"]: np.array(r[1:], np.int64) for r in rows}

    def _splits(self, keys, nodes, weights) -> dict[tuple[int, int], tuple]:
        """(column or -1, bin, gain, low sums, all sums) of each open node: one grouped aggregate over all rows, then a node at a time."""
        routes, levels = self._routes(keys, nodes)
        columns, rules, stats, width = self.columns, self.rules, self.stats, len(self.columns.counts)
        picked = [drawn_columns(self.seed, t, p, width, self.share) for t, p in keys]
        drawn = np.zeros((len(keys), max(map(len, picked))), np.int64)
        for row, own in zip(drawn, picked):
            row[:] = own
        slots = len(columns.owner)
        own_nodes: dict[int, list[int]] = {}
        for node, (tree, _) in enumerate(keys):
            own_nodes.setdefault(tree, []).append(node)

        def sums(batches):
            for block in _unpacked(batches, width):
                bins = block[0]
                for tree, (feature, cut, number) in routes.items():
                    values, taking = stats(block, tree)
                    at = number[_routed(bins, taking, feature, cut, levels)]
                    rows, at = taking[at >= 0], at[at >= 0]
                    if not len(rows):
                        continue
                    first = own_nodes[tree][0]  # the nodes of a tree are numbered one after the other
                    for node, *found in slot_sums(bins[rows], values[rows], at.astype(np.int64) - first, drawn[own_nodes[tree]], columns):
                        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (node + first, *found)], ["node", "slot", "s0", "s1", "s2"])

        summed = self.blocks.mapInArrow(sums, "node long, slot long, s0 long, s1 long, s2 long")
        weight = np.array([weights[t] for t, _ in keys])

        def chosen(node: int, slot: np.ndarray, values: np.ndarray, path: int):
            dense = np.zeros((slots, 3), np.int64)
            dense[slot] = values
            own = picked[node]
            local = Columns(columns.counts[own])
            dense = dense[np.repeat(columns.offset[own] - local.offset, local.counts) + np.arange(len(local.owner))]
            total = dense[: local.counts[0]].sum(axis=0)
            split = best_split(dense, total, local, rules, weight[node]) if rules.open(total, path.bit_length() - 1) else None
            column, cut, gain, low = split or (-1, 0, 0.0, np.zeros(3, np.int64))
            return node, int(own[column]) if split else -1, cut, gain, *map(int, low), *map(int, total)

        paths = [p for _, p in keys]
        names = ("node", "column", "cut", "gain", "s0", "s1", "s2", "t0", "t1", "t2")

        def listed(found):
            return {keys[r[0]]: (r[1], r[2], r[3], np.array(r[4:7], np.int64), np.array(r[7:], np.int64)) for r in found}

        few = self.parts * len(keys) * slots <= DRIVER_SUMS
        grouped = summed if few else summed.groupBy("node", "slot").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(3)))
        if few or len(keys) <= DRIVER_NODES:  # as many rows as nodes have bins, of each task if they are few
            table = grouped.toArrow()
            node, slot, *values = (table.column(c).to_numpy() for c in ("node", "slot", "s0", "s1", "s2"))
            dense = np.zeros((len(keys), slots, 3), np.int64)
            for k in range(3):
                np.add.at(dense[..., k], (node, slot), values[k])
            return listed(chosen(n, every, dense[n], paths[n]) for every in [np.arange(slots)] for n in np.unique(node).tolist())

        def best(batches):
            held = None
            for batch in [*batches, None]:
                if batch is not None:
                    now = np.stack([batch.column(c).to_numpy() for c in ("node", "slot", "s0", "s1", "s2")], axis=1)
                    held = now if held is None else np.concatenate([held, now])
                    done = int(np.searchsorted(held[:, 0], held[-1, 0])) if len(held) else 0  # the last node may go on
                else:
                    done = 0 if held is None else len(held)
                if not done:
                    continue
                part, held = held[:done], held[done:]
                parts = np.split(part, np.flatnonzero(np.diff(part[:, 0])) + 1)
                rows = [chosen(int(p[0, 0]), p[:, 1], p[:, 2:], paths[p[0, 0]]) for p in parts]
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))

        ordered = grouped.repartition(min(self.parts, len(keys)), "node").sortWithinPartitions("node", "slot")
        rows = ordered.mapInArrow(best, ", ".join(f"{n} {'double' if n == 'gain' else 'long'}" for n in names)).collect()  # one for each open node
        return listed(rows)

    def _finished(self, keys, nodes, weights) -> dict[tuple[int, int], tuple]:
        """The nodes from each of ``keys`` down: its rows, FINISHED_ROWS at most, meet in one task."""
        routes, levels = self._routes(keys, nodes)
        columns, rules, stats, width = self.columns, self.rules, self.stats, len(self.columns.counts)
        seed, share = self.seed, self.share
        weight = np.array([weights[t] for t, _ in keys])
        roots = list(keys)

        def gather(batches):
            for block in _unpacked(batches, width):
                for tree, (feature, cut, number) in routes.items():
                    values, taking = stats(block, tree)
                    at = number[_routed(block[0], taking, feature, cut, levels)]
                    order = np.argsort(at, kind="stable")
                    order = order[at[order] >= 0]
                    for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                        if len(part):
                            rows = taking[part]
                            yield pa.RecordBatch.from_pydict({"node": [int(at[part[0]])], "bins": [block[0][rows].tobytes()], "sums": [values[rows].tobytes()]})

        def grown(node: int, bins: np.ndarray, values: np.ndarray):
            tree, root = roots[node]
            stack = [(root, np.arange(len(bins)))]
            while stack:
                path, rows = stack.pop()
                own = values[rows]
                total, split = own.sum(axis=0), None
                if rules.open(total, path.bit_length() - 1):
                    drawn = drawn_columns(seed, tree, path, width, share)
                    local = Columns(columns.counts[drawn])
                    weights = [own[:, k].astype(float) for k in range(3)]
                    sums = np.empty((len(local.owner), 3), np.int64)
                    for column, first, many in zip(drawn, local.offset, local.counts):
                        codes = bins[rows, column]
                        for k in range(3):
                            sums[first : first + many, k] = np.bincount(codes, weights[k], many)
                    split = best_split(sums, total, local, rules, weight[node])
                leaf = rules.leaf(total, weight[node])
                if split is None:
                    yield tree, path, -1, 0, *leaf, 0.0
                    continue
                column, cut, gain = int(drawn[split[0]]), *split[1:3]
                yield tree, path, column, cut, *leaf, gain
                low = bins[rows, column] <= cut
                stack += [(2 * path, rows[low]), (2 * path + 1, rows[~low])]

        def finish(batches):
            node, held = None, []

            def flush():
                bins = np.concatenate([np.frombuffer(b, np.uint8).reshape(-1, width) for b, _ in held])
                values = np.concatenate([np.frombuffer(v, np.int64).reshape(-1, 3) for _, v in held])
                rows = list(grown(node, bins, values))
                return pa.RecordBatch.from_pydict(dict(zip(_NODE_NAMES, map(list, zip(*rows)))))

            for batch in batches:
                for n, b, v in zip(*(batch.column(c).to_pylist() for c in ("node", "bins", "sums"))):
                    if n != node and held:
                        yield flush()
                        held = []
                    node = n
                    held.append((b, v))
            if held:
                yield flush()

        gathered = self.blocks.mapInArrow(gather, "node long, bins binary, sums binary")
        gathered = gathered.repartition(min(4 * self.parts, len(keys)), "node").sortWithinPartitions("node")
        rows = gathered.mapInArrow(finish, _NODE).toArrow()
        lists = [rows.column(c).to_pylist() for c in rows.column_names]  # as many as the trees have nodes
        return {(t, p): (c, cut, v, cover, g) for t, p, c, cut, v, cover, g in zip(*lists)}


def _routed(bins: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The paths that rows have come to after so many levels; a row stays in a leaf."""
    path = np.ones(len(rows), np.int64)
    for _ in range(levels):
        path = _advanced(path, bins, rows, feature, cut)
    return path


def _advanced(path: np.ndarray, bins: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The paths one level down."""
    column = feature[path]
    low = bins[rows, np.maximum(column, 0)] <= cut[path]
    return np.where(column >= 0, 2 * path + ~low, path)


def assemble(nodes: dict[tuple[int, int], tuple], kind: str, edges: list[np.ndarray]) -> TreeEnsemble:
    """The flat arrays of the grown nodes."""
    keys = sorted(nodes)
    place = {key: i for i, key in enumerate(keys)}
    size = len(keys)
    columns = {name: np.zeros(size, np.int64 if name in ("feature", "left", "right") else float) for name in _NODE_COLUMNS}
    for i, key in enumerate(keys):
        column, cut, value, cover, gain = nodes[key]
        low, high = ((key[0], 2 * key[1] + side) for side in (0, 1))
        columns["feature"][i], columns["value"][i], columns["cover"][i], columns["gain"][i] = column, value, cover, gain
        columns["threshold"][i] = edges[column][cut] if column >= 0 else 0.0
        columns["left"][i], columns["right"][i] = (place[low], place[high]) if column >= 0 else (i, i)
    roots = np.array([place[key] for key in keys if key[1] == 1], np.int64)
    depth = max((path.bit_length() - 1 for _, path in keys), default=0)
    return TreeEnsemble(kind=kind, width=len(edges), depth=depth, roots=roots, **columns)


def _prepared(train: DataFrame, label: str, draw: Column | None, count: int) -> tuple[DataFrame, list[np.ndarray], Columns, int]:
    """(blocks, edges, columns, parts) of the training rows.

    ``draw`` numbers the rows for their draws; by default a hash of what they hold, so equal rows share their draws.
    """
    spark = train.sparkSession
    x = vector_to_array("features")
    row = F.xxhash64(x, F.col(label)) if draw is None else draw
    rows = train.where(F.col(label).isNotNull()).select(x.alias("x"), F.col(label).cast("int").alias("label"), row.cast("long").alias("row"))
    width = len(rows.first()["x"])
    edges = _edges(rows, count, width)
    cores = spark.sparkContext.defaultParallelism
    parts = cores * max(1, -(-count // (BLOCK_ROWS * cores)))  # whole waves of tasks
    return _blocks(rows, edges, parts), edges, Columns(np.array([len(e) + 1 for e in edges])), parts


def _plain_session(blocks: DataFrame) -> DataFrame:
    """The blocks in a session of their own, whose many small jobs need no planning at run time."""
    session = blocks.sparkSession.newSession()
    session.conf.set("spark.sql.adaptive.enabled", "false")
    session.conf.set("spark.sql.shuffle.partitions", str(blocks.sparkSession.sparkContext.defaultParallelism))
    paths = {f.rsplit("/", 1)[0] for f in blocks.inputFiles()}
    return session.read.schema(_BLOCK).parquet(*sorted(paths))


def _derivatives(y: np.ndarray, margin: np.ndarray, positive_weight: float, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and Hessians of the rows in whole units of 1 / ``scale``."""
    p, weight = 1 / (1 + np.exp(-margin)), np.where(y == 1, positive_weight, 1.0)
    return np.rint(weight * (p - y) * scale), np.rint(weight * p * (1 - p) * scale)


@dataclass
class _Rounds:
    """What tasks do with their blocks in a round of boosting; ``feature``, ``cut`` and ``value`` are the tree so far by path."""

    columns: Columns
    rules: Rules
    positive_weight: float
    rows_share: float
    share: float
    seed: int

    def drawn(self, number: int) -> tuple[np.ndarray, Columns]:
        """The columns of a round, and where their bins lie."""
        own = drawn_columns(self.seed, number, 1, len(self.columns.counts), self.share)
        return own, Columns(self.columns.counts[own])

    def sums(self, blocks, number: int, wanted: list[int], feature: np.ndarray, cut: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """Which (node, slot) of the wanted paths rows reach, as bits, and the three sums of those."""
        own, local = self.drawn(number)
        step = max(1, HELD_CELLS // (3 * len(local.owner)))
        levels, place = wanted[0].bit_length() - 1, np.full(len(feature), -1)
        place[wanted] = np.arange(len(wanted))
        total = np.zeros((len(wanted), len(local.owner), 3), np.int64)
        for bins, y, row, margin in blocks:
            taking = np.flatnonzero(draws(row, *row_draw(self.seed, number)) < self.rows_share * PRIME)
            at = place[_routed(bins, taking, feature, cut, levels)]
            rows, at = taking[at >= 0], at[at >= 0]
            weights = _derivatives(y[rows], margin[rows], self.positive_weight, self.rules.scale)
            for begin in range(0, len(wanted), step):
                some = np.flatnonzero((at >= begin) & (at < begin + step)) if step < len(wanted) else slice(None)
                part, near, of = total[begin : begin + step], at[some] - begin, rows[some]
                first, second = (w[some] for w in weights)
                for column, slot, many in zip(own, local.offset, local.counts):
                    codes, size = near * many + bins[:, column][of], len(part) * many
                    for k, found in enumerate((np.bincount(codes, first, size), np.bincount(codes, second, size), np.bincount(codes, minlength=size))):
                        part[:, slot : slot + many, k] += found.reshape(-1, many).astype(np.int64)
        flat = total.reshape(-1, 3)
        there = flat[:, 2] > 0
        yield np.packbits(there).tobytes(), flat[there].tobytes()

    def renewed(self, blocks, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """The blocks with the margins after the tree."""
        for bins, y, row, margin in blocks:
            yield bins, y, row, margin + value[_routed(bins, np.arange(len(bins)), feature, cut, self.rules.depth)]


def _boosted_in_jobs(blocks: DataFrame, steps: _Rounds, rounds: int, tasks: int) -> dict[tuple[int, int], tuple]:
    """The nodes of all rounds as :meth:`Grower.grow` finds them, by one job a level, which returns the sums of each task.

    Of two children only the one of fewer rows is summed; the other one has what is left of their parent.
    """
    session, width, rules, unit = blocks.sparkSession, len(steps.columns.counts), steps.rules, np.ones(2)
    shared = session.sparkContext.broadcast(cloudpickle.dumps(steps))  # as large as the bins are many; sent once, with its code

    def arrays(rows):
        for row in rows:
            bins, label, number, margin = (np.frombuffer(v, k) for v, k in zip(row, (np.uint8, np.uint8, np.int64, np.float64)))
            yield np.asfortranarray(bins.reshape(-1, width)), label, number, margin

    def packed(rows):
        for bins, *others in rows:
            yield tuple(bytearray(np.ascontiguousarray(a).tobytes()) for a in (bins, *others))

    def read(frame):
        return frame.rdd.coalesce(tasks).mapPartitions(arrays)

    state, before = read(blocks).persist(StorageLevel.MEMORY_AND_DISK), None
    nodes: dict[tuple[int, int], tuple] = {}
    try:
        for number in range(rounds):
            own, local = steps.drawn(number)
            size = 2 << rules.depth
            feature, cut, value = np.full(size, -1, np.int32), np.zeros(size, np.uint8), np.zeros(size)

            def summed(wanted, number=number, slots=len(local.owner), feature=feature, cut=cut):
                total = np.zeros((len(wanted) * slots, 3), np.int64)
                for there, told in state.mapPartitions(lambda rows: pickle.loads(shared.value).sums(rows, number, wanted, feature, cut)).collect():
                    reached = np.unpackbits(np.frombuffer(there, np.uint8), count=len(total)).astype(bool)
                    total[reached] += np.frombuffer(told, np.int64).reshape(-1, 3)
                return total.reshape(len(wanted), slots, 3)

            def leaf(path, sums):
                nodes[number, path] = (-1, 0, *rules.leaf(sums, unit), 0.0)

            open_ = {1: summed([1])[0]}
            while open_:
                below: list[tuple[int, int, list[int]]] = []
                for path, sums in open_.items():
                    total = sums[: local.counts[0]].sum(axis=0)
                    split = best_split(sums, total, local, rules, unit) if rules.open(total, path.bit_length() - 1) else None
                    if split is None:
                        leaf(path, total)
                        continue
                    column, last, gain, low = split
                    nodes[number, path] = (int(own[column]), last, *rules.leaf(total, unit), gain)
                    feature[path], cut[path] = own[column], last
                    sides = {2 * path: low, 2 * path + 1: total - low}
                    opened = [child for child, side in sides.items() if rules.open(side, child.bit_length() - 1)]
                    for child in sides.keys() - opened:
                        leaf(child, sides[child])
                    if opened:
                        below.append((path, min(sides, key=lambda child: sides[child][2]), opened))
                found = summed([fewer for _, fewer, _ in below]) if below else []
                above, open_ = open_, {}
                for (path, fewer, opened), sums in zip(below, found):
                    both = {fewer: sums, fewer ^ 1: above[path] - sums}
                    open_ |= {child: both[child] for child in opened}
            if number + 1 == rounds:
                break
            for (tree, path), node in nodes.items():
                if tree == number:
                    value[path] = node[2]

            def renewed(rows, feature=feature, cut=cut, value=value):
                return pickle.loads(shared.value).renewed(rows, feature, cut, value)

            after = state.mapPartitions(renewed)
            if (number + 1) % MARGIN_ROUNDS == 0:
                after = read(staged(session.createDataFrame(after.mapPartitions(packed), _BLOCK), "tree-margins"))
            if before is not None:
                before.unpersist()
            before, state = state, after.persist(StorageLevel.MEMORY_AND_DISK)  # filled by the next round, out of the one before
    finally:
        for kept in (before, state):
            if kept is not None:
                kept.unpersist()
        shared.unpersist()
    return nodes


def grow_boosted(
    train: DataFrame, label: str, counts: dict[int, int], *, rounds: int, depth: int, rate: float, rows_share: float, columns_share: float,
    penalty: float, least_hessian: float, positive_weight: float, seed: int, draw: Column | None,
) -> TreeEnsemble:
    """Second-order boosting of the logistic loss; a round draws rows and columns of its own.

    A leaf is worth -rate · G / (H + penalty) for the sums G and H of the weighted gradients p - y and Hessians
    p · (1 - p); a split gains the half of G² / (H + penalty) of its sides less that of the node.  Either side needs
    a Hessian of ``least_hessian``.
    """
    count = sum(counts.values())
    blocks, edges, columns, parts = _prepared(train, label, draw, count)
    width = len(edges)
    scale = 2.0 ** np.floor(np.log2(2.0**52 / (count * max(positive_weight, 1.0))))
    rules = Rules("boosted", depth, scale=scale, rate=rate, penalty=penalty, least_hessian=least_hessian)
    blocks = _plain_session(blocks)
    nodes: dict[tuple[int, int], tuple] = {}
    tasks = min(blocks.sparkSession.sparkContext.defaultParallelism, max(2, -(-count // TASK_ROWS)))
    if columns_share != "sqrt" and count <= KEPT_NODES * FINISHED_ROWS and tasks * ((1 << depth) // 4 + 1) * len(columns.owner) <= DRIVER_SUMS:
        steps = _Rounds(columns, rules, positive_weight, rows_share, columns_share, seed)
        return assemble(_boosted_in_jobs(blocks, steps, rounds, tasks), "boosted", edges)
    state, before = blocks.persist(StorageLevel.MEMORY_AND_DISK), None
    try:
        for number in range(rounds):
            factor, offset = row_draw(seed, number)

            def stats(block, _, factor=factor, offset=offset):
                _, y, row, margin = block
                taking = np.flatnonzero(draws(row, factor, offset) < rows_share * PRIME)
                return np.stack([*_derivatives(y, margin, positive_weight, scale), np.ones(len(y))], axis=1).astype(np.int64), taking

            grown = Grower(state, columns, rules, stats, columns_share, seed, parts).grow({number: np.ones(2)})
            nodes |= grown
            if number + 1 == rounds:
                break
            size = 2 << depth
            feature, cut, value = np.full(size, -1, np.int32), np.zeros(size, np.uint8), np.zeros(size)
            for (_, path), (column, last, worth, *_) in grown.items():
                feature[path], cut[path], value[path] = column, last, worth

            def renewed(batches, feature=feature, cut=cut, value=value):
                for batch in batches:
                    fresh = [(margin + value[_routed(bins, np.arange(len(bins)), feature, cut, depth)]).tobytes() for bins, _, _, margin in _unpacked([batch], width)]
                    yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("bins", "label", "row")] + [pa.array(fresh, pa.binary())], ["bins", "label", "row", "margin"])

            after = state.mapInArrow(renewed, _BLOCK)
            if (number + 1) % MARGIN_ROUNDS == 0:
                after = staged(after, "tree-margins")
            if before is not None:
                before.unpersist()
            before, state = state, after.persist(StorageLevel.MEMORY_AND_DISK)  # filled by the next round, out of the one before
    finally:
        for kept in (before, state):
            if kept is not None:
                kept.unpersist()
    return assemble(nodes, "boosted", edges)


def grow_forest(
    train: DataFrame, label: str, counts: dict[int, int], *, trees: int, depth: int, min_split: int, min_leaf: int, columns_share: float | str,
    bootstrap: bool, seed: int, draw: Column | None,
) -> TreeEnsemble:
    """Bagged trees by Gini impurity; every tree weighs the labels by their share among the rows it drew.

    A row is drawn by each tree a Poisson number of times.  Every node has columns of its own to be split by; one that none of them
    can split is a leaf.  ``min_split`` and ``min_leaf`` count different rows.
    """
    count = sum(counts.values())
    blocks, edges, columns, parts = _prepared(train, label, draw, count)
    rules = Rules("forest", depth, min_split=min_split, min_leaf=min_leaf)
    blocks = _plain_session(blocks).persist(StorageLevel.MEMORY_AND_DISK)
    constants = [row_draw(seed, t) for t in range(trees)]

    def stats(block, tree):
        _, y, row, _ = block
        times = np.searchsorted(POISSON, draws(row, *constants[tree]), side="right") if bootstrap else np.ones(len(y), np.int64)
        values = np.stack([times * (y == 1), times * (y == 0), (times > 0).astype(np.int64)], axis=1)
        return values, np.flatnonzero(times)

    grower = Grower(blocks, columns, rules, stats, columns_share, seed, parts)
    numbers = list(range(trees))
    weights = {t: np.ones(2) for t in numbers}
    try:
        for tree, (pos, neg, _) in grower.totals(numbers).items():
            weights[tree] = (pos + neg) / 2 / np.maximum(np.array([pos, neg]), 1)
        return assemble(grower.grow(weights), "forest", edges)
    finally:
        blocks.unpersist()
