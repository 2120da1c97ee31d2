"""The trie of dialogue prefixes, and totals of all its subtrees by parallel tree contraction.

Turns are reduced to hashes as soon as they are ordered; a node is the pair of two
running XORs of its turns, each hashed with its place, and its depth.  Totals go up the tree in rounds:
leaves are raked into their parents, and nodes with a single child are spliced out of their chains, so the
rounds grow with the logarithm of the nodes and not with the depth; then the rounds are undone in reverse.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.common import map_batches, stage

#: Ids of a piece of the list that is hashed; pieces are made in parallel.
IDS_PER_PIECE = 512
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "p1", "p2"]


def placed_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, t1, t2, words) of every turn, and (conv_id, n_turns) of every dialogue.

    Turns are numbered from 0 by (turn, role, text), nulls first; a null role or text is empty.  Rows without a
    conv_id belong to no dialogue and take no part.  Repeated rows are turns of their own.

    Rows are sorted over all partitions, so a dialogue may be of any length: its part in each partition is
    numbered by the row's place there, and the sizes of its earlier parts are added.
    """
    order = ["conv_id", "turn", "role", "text"]
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    sorted_ = turns.repartitionByRange(*order, F.xxhash64(F.monotonically_increasing_id())).sortWithinPartitions(*order)
    rows = sorted_.select(
        "conv_id", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("piece"),
        F.xxhash64(F.lit(1), "role", "text").alias("t1"), F.xxhash64(F.lit(2), "role", "text").alias("t2"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )
    rows = stage(rows, "trie-turns")
    parts = rows.groupBy("conv_id", "piece").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    parts = stage(parts.withColumn("offset", F.coalesce(F.sum("size").over(earlier), F.lit(0))), "trie-parts")
    placed = rows.join(parts, ["conv_id", "piece"]).select("conv_id", (F.col("at") - F.col("first") + F.col("offset")).alias("place"), "t1", "t2", "words")
    return placed, parts.groupBy("conv_id").agg(F.sum("size").alias("n_turns"))


def share_heads(placed: DataFrame, sizes: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """The turns after each dialogue c took over the first h turns of dialogue c - c % ``family``.

    h is the CRC-32 of the decimal id modulo ``most``.  The first h turns of c itself go; if the other dialogue
    has fewer they move up, and a dialogue may be left without turns.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))
    placed, sizes = stage(placed, "trie-placed"), stage(sizes, "trie-sizes")
    founders = sizes.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("founder"), F.col("n_turns").alias("there"))
    members = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("founder"), h.alias("h"))
    members = stage(members.join(founders, "founder", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))), "trie-members")
    heads = placed.where((F.col("conv_id") % family == 0) & (F.col("place") < most - 1)).withColumnRenamed("conv_id", "founder")
    heads = members.where("taken > 0").join(heads, "founder").where("place < h").select("conv_id", "place", "t1", "t2", "words")
    # most founders have enough turns; the others' members move up, and are the only ones that are looked up
    moved = members.where("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("up"))
    own = placed.where(F.col("place") >= h).join(moved, "conv_id", "left").withColumn("place", F.col("place") - F.coalesce("up", F.lit(0))).drop("up")
    return heads.unionByName(own)


def _prefixes(placed: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, words) for every prefix of every dialogue, the empty one too.

    (p1, p2) tell the prefix among those of its depth, (q1, q2) the one before it.
    """
    steps = placed.select("conv_id", "place", "words", F.xxhash64("place", "t1").alias("x1"), F.xxhash64("place", "t2").alias("x2"))
    steps = stage(steps.repartitionByRange("conv_id", "place").withColumn("piece", F.spark_partition_id()), "trie-steps")
    parts = steps.groupBy("conv_id", "piece").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "piece", *(F.coalesce(F.bit_xor(b).over(earlier), F.lit(0)).alias(b) for b in ("b1", "b2")))
    before = Window.partitionBy("conv_id", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    run = steps.select("*", *(F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(r) for x, r in (("x1", "r1"), ("x2", "r2"))))
    run = run.join(parts, ["conv_id", "piece"])
    q = [F.col(f"r{k}").bitwiseXOR(F.col(f"b{k}")) for k in (1, 2)]
    p = [q[k - 1].bitwiseXOR(F.col(f"x{k}")) for k in (1, 2)]
    long_ = run.select("conv_id", (F.col("place") + 1).alias("depth"), p[0].alias("p1"), p[1].alias("p2"), q[0].alias("q1"), q[1].alias("q2"), "words")
    empty = members.select("conv_id", *(F.lit(v).cast("long").alias(c) for c, v in (("depth", 0), ("p1", 0), ("p2", 0), ("q1", None), ("q2", None), ("words", 0))))
    return long_.unionByName(empty)


def _coin(node: Column, number: int) -> Column:
    """A fair draw of a node in a round."""
    return F.xxhash64(node, F.lit(number)) % 2 == 0


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(id, *values) with the sums of ``values`` over the subtree of every node, for ``tree`` (id, parent, *values).

    The root is the node whose parent is null; a forest or a table without rows is allowed.

    A round rakes all leaves, whose sums are final, into their parents, and splices nodes with a single child out of
    their chains: those whose draw is heads, if not their child is another such node.  A spliced node's own
    sum is then carried by the edge above its child.  What was taken out in a round is
    resolved in reverse, from nodes that stayed longer, which are ever more as the rounds go back.
    """
    kids = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    edges = [f"up_{v}" for v in values]
    state = tree.join(kids, "id", "left").select("id", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), *values, *(F.lit(0).cast("long").alias(e) for e in edges))
    state = stage(state, "tree-state")
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while not state.where("parent IS NOT NULL").isEmpty():
        number = len(rounds)
        gains = state.where("kids = 0 AND parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
            F.count("*").alias("raked"), *(F.sum(F.col(v) + F.col(e)).alias(f"gain_{v}") for v, e in zip(values, edges))
        )
        rest = state.where("kids > 0").join(gains, "id", "left").select(
            "id", "parent", (F.col("kids") - F.coalesce("raked", F.lit(0))).alias("kids"),
            *((F.col(v) + F.coalesce(f"gain_{v}", F.lit(0))).alias(v) for v in values), *edges,
        )
        rest = stage(rest, "tree-raked")

        chain = rest.where((F.col("kids") == 1) & F.col("parent").isNotNull() & _coin(F.col("id"), number))
        chain = chain.select(F.col("id").alias("out"), F.col("parent").alias("above"), *(F.col(c).alias(f"out_{c}") for c in (*values, *edges)))
        below = rest.where(~((F.col("kids") == 1) & _coin(F.col("id"), number)))
        spliced = below.join(chain, below["parent"] == chain["out"]).select(
            "out", "id", "above", *((F.col(f"out_{v}") + F.col(e)).alias(f"add_{v}") for v, e in zip(values, edges)),
            *((F.col(f"out_{v}") + F.col(f"out_{e}")).alias(f"more_{e}") for v, e in zip(values, edges)),
        )
        spliced = stage(spliced, "tree-spliced")
        told = spliced.select("id", "above", *(f"more_{e}" for e in edges), F.lit(False).alias("gone")).unionByName(
            spliced.select(F.col("out").alias("id"), F.lit(True).alias("gone")), allowMissingColumns=True
        )
        rounds.append((state, spliced))
        state = rest.join(told, "id", "left").where("gone IS NULL OR NOT gone").select(
            "id", F.coalesce("above", "parent").alias("parent"), "kids", *values,
            *((F.col(e) + F.coalesce(f"more_{e}", F.lit(0))).alias(e) for e in edges),
        )
        state = stage(state, "tree-state")

    totals = state.select("id", *values)
    for before, spliced in reversed(rounds):
        opened = spliced.join(totals, "id").select(F.col("out").alias("id"), *((F.col(v) + F.col(f"add_{v}")).alias(v) for v in values))
        raked = before.where("kids = 0").select("id", *values)
        totals = stage(totals.unionByName(opened).unionByName(raked), "tree-totals")
    return totals


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, joined by commas; rows come sorted."""
    node, ids, found = None, [], []

    def flush():
        if ids:
            found.append((*node, ids[0], ",".join(map(str, ids))))

    for batch in batches:
        for *key, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id"))):
            if key != node or len(ids) == IDS_PER_PIECE:
                flush()
                node, ids = key, []
            ids.append(conv)
        if found:
            yield pa.RecordBatch.from_pydict(dict(zip((*NODE, "first", "ids"), zip(*found))))
            found.clear()
    flush()
    if found:
        yield pa.RecordBatch.from_pydict(dict(zip((*NODE, "first", "ids"), zip(*found))))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of the pieces of each node, fed one after the other; rows come sorted."""
    node, state = None, None

    def row():
        return pa.RecordBatch.from_pydict(dict(zip((*NODE, "ends_sha256"), ([v] for v in (*node, state.hexdigest())))))

    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
            if key != node:
                if node is not None:
                    yield row()
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
    if node is not None:
        yield row()


def _ends(prefixes: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of the nodes at which a dialogue ends.

    A hash is sequential by nature.  The ids are sorted and joined in pieces by all tasks, whatever the node;
    the last task of a node only feeds its pieces to the hash, one after the other.
    """
    ends = prefixes.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("end")).select("conv_id", *(f"end.{c}" for c in NODE))
    schema = ", ".join(f"{c} long" for c in NODE)
    ends = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = map_batches(ends, _pieces, f"{schema}, first long, ids string")
    return map_batches(pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first"), _digests, f"{schema}, ends_sha256 string")


def prefix_trie(placed: DataFrame, members: DataFrame) -> DataFrame:
    """A row for every distinct prefix of the dialogues, with totals of its subtree.

    ``placed`` holds turns as ``placed_turns`` returns them, ``members`` every conv_id once, those
    without turns too.  A node of depth d is a distinct sequence of the first d turns (role, text); all dialogues are members of
    the root.  Returns long columns and a string: conv_id, the smallest member; depth; parent_conv_id, that of the
    parent, null for the root; n_convs, the members; n_children; n_leaves, nodes without children in the
    subtree, the node included; saved_tokens, over the subtree, the members but one times the words of the last
    text; ends_sha256, the SHA-256 of the ids, ascending and joined by commas, of the members with d turns.

    Nodes are told apart by 128 bits of hashes.  No members give no rows, not even a root.
    """
    prefixes = stage(_prefixes(placed, members.select("conv_id")), "trie-prefixes")
    nodes = prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("words").alias("words")
    )
    nodes = stage(nodes, "trie-nodes")
    above = stage(nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id")), "trie-parents")
    nodes = stage(nodes.join(above, ["depth", "q1", "q2"], "left").drop("q1", "q2"), "trie-linked")

    # the smallest member and the depth name a node
    node = F.struct("conv_id", "depth")
    parent = F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")))
    kids = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stage(nodes, "trie-counted")
    tree = nodes.select(
        node.alias("id"), parent.alias("parent"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    )
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"]).select("id.conv_id", "id.depth", "n_leaves", "saved_tokens")
    ends = _ends(prefixes.select("conv_id", *NODE))
    return nodes.join(totals, ["conv_id", "depth"]).join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
