"""Exact Jaccard join on word shingles with several global token orders.

Two similar sets must share a token among the first few tokens of each (the
prefix) under *every* global order of the tokens.  The first order finds the
candidates through buckets of equal tokens; further orders must agree before a
pair is verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import arrow_map, map_batches, mix, stage, texts_of
from ebbline.llm.components import connected_components

SHINGLE = 5
#: Similarity as a fraction, to compare in whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
ORDERS = 3
#: Tokens in more documents than FREQUENT come last in every order.  They are counted exactly among the lowest
#: COUNTED of all hashes, where the prefixes lie, and kept in a table of 2**FREQUENT_BITS bits.
FREQUENT, COUNTED, FREQUENT_BITS = 8, 0.3, 23
#: Words of the parity bitmap that bounds the difference of two sets before they are compared.
PARITY = 8
#: Bits of the filter that keeps documents without a candidate from being shuffled.
FILTER_BITS = 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    ``bytes.lower`` and ``bytes.split`` change A-Z and split at ASCII white space only.
    Fewer words than ``width`` make one shingle of them all; no words make none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = total * _STEP + hashes[k : len(words) - size + 1 + k]
    return np.unique(mix(total))


def _ceil(a, b):
    return -(-a // b)


def _enough(shared, nx, ny, numerator: int, denominator: int):
    """Whether two sets of nx and ny tokens whose prefixes share ``shared`` can still be similar.

    Say the prefix of x ends first in the order.  A common token that is not in
    both prefixes then lies behind the prefix of x, where ceil(t * nx) - 1 tokens are.
    """
    behind = F.ceil(F.greatest(nx, ny) * numerator / F.lit(float(denominator))) - 1
    return F.coalesce((shared + behind) * (numerator + denominator) >= (nx + ny) * numerator, F.lit(True))


def prefix(tokens: np.ndarray, frequent: np.ndarray, order: int, numerator: int, denominator: int) -> np.ndarray:
    """The tokens that a similar set must hit under one global order: frequent tokens last, else by hash.

    The first order is that of the hashes themselves, in which ``tokens`` are sorted.
    """
    n = len(tokens)
    if not n:
        return tokens
    length = n - _ceil(n * numerator, denominator) + 1
    late = frequent[tokens >> np.uint64(64 - FREQUENT_BITS)]
    if not order:
        return np.concatenate([tokens[~late], tokens[late]])[:length]
    rank = (mix(tokens, order) >> np.uint64(1)) | (late.astype(np.uint64) << np.uint64(63))
    return tokens[np.argpartition(rank, length - 1)[:length]]


def parity(tokens: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY slots whether an odd number of tokens fall there; equal tokens of two sets cancel."""
    slots = (mix(tokens, 99) % np.uint64(64 * PARITY)).astype(np.int64)
    odd = np.bincount(slots, minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """The table of frequent tokens, by the top bits of their hash."""
    low = np.uint64(int(COUNTED * 2**64))

    def count(batches):
        for batch in batches:
            lows = [np.empty(0, np.uint64)]
            for text in texts_of(batch.column("text")):
                tokens = shingle_set(text, width)
                lows.append(tokens[: np.searchsorted(tokens, low)].copy())  # not a view that keeps the whole set
            tokens, counts = np.unique(np.concatenate(lows), return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(tokens), pa.array(counts.astype(np.int64))], ["token", "n"])

    tokens = map_batches(docs.select("text"), count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    slot = F.shiftrightunsigned("token", 64 - FREQUENT_BITS).alias("slot")
    words = tokens.where(F.col("n") > FREQUENT).select(slot).groupBy(F.expr("CAST(slot DIV 32 AS INT) AS word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(pmod(slot, 32) AS INT))) AS bits")
    ).toArrow()  # at most 2**FREQUENT_BITS / 32 rows
    return _bits(words, FREQUENT_BITS)


def _bits(words: pa.Table, size: int) -> np.ndarray:
    """A table of 2**size bits from its words of 32 that are not empty."""
    table = np.zeros((1 << size) // 32, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return (table[:, None] >> np.arange(32) & 1).astype(bool).ravel()


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), _signed(flat))


def _signatures(docs: DataFrame, frequent: np.ndarray, width: int, numerator: int, denominator: int) -> DataFrame:
    """(doc_id, n_shingles, print, prefix, parity) of every row; equal prints mean equal sets."""
    packed = np.packbits(frequent)

    def work(batches):
        table = np.unpackbits(packed).astype(bool)
        for batch in batches:
            sizes, prints, firsts, parities = [], [], [], []
            for text in texts_of(batch.column("text")):
                tokens = shingle_set(text, width)
                sizes.append(len(tokens))
                prints.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                firsts.append(prefix(tokens, table, 0, numerator, denominator))
                parities.append(parity(tokens).view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), _lists(firsts), _lists(parities)],
                ["doc_id", "n_shingles", "print", "prefix", "parity"],
            )

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, n_shingles long, print binary, prefix array<long>, parity array<long>")


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bit table of the hashed ids, 2**FILTER_BITS bits however many ids there are."""
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    rows = ids.select(slot.alias("slot")).groupBy(F.expr("CAST(slot DIV 32 AS INT) AS word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(pmod(slot, 32) AS INT))) AS bits")
    ).toArrow()
    return _bits(rows, FILTER_BITS)


def _verified(pairs: DataFrame, docs: DataFrame, frequent: np.ndarray, width: int, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose prefixes meet under the other orders and whose sets are similar."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = stage(ids, "ngram-ids")
    wanted = _id_filter(ids)

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(wanted[batch.column("slot").to_numpy(zero_copy_only=False)], pa.bool_())).select(["doc_id", "text"])

    packed = np.packbits(frequent)

    def work(batches):
        table = np.unpackbits(packed).astype(bool)
        for batch in batches:
            sets, others = [], [[] for _ in range(ORDERS - 1)]
            for text in texts_of(batch.column("text")):
                tokens = shingle_set(text, width)
                sets.append(tokens)
                for order, kept in enumerate(others, 1):
                    kept.append(prefix(tokens, table, order, numerator, denominator))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _lists(sets), *map(_lists, others)], ["id", "tokens", *(f"p{k}" for k in range(1, ORDERS))]
            )

    slotted = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("slot")).where("doc_id IS NOT NULL")
    few = arrow_map(slotted, some, "doc_id long, text string").join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    prefixes = [f"p{k}" for k in range(1, ORDERS)]
    sets = map_batches(few.select("doc_id", "text"), work, "id long, tokens array<long>, " + ", ".join(f"{p} array<long>" for p in prefixes))
    sets = stage(sets, "ngram-sets")

    def side(letter: str) -> DataFrame:
        return sets.select(F.col("id").alias(letter), *(F.col(c).alias(f"{letter}_{c}") for c in ["tokens", *prefixes]))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    for p in prefixes:
        shared = F.size(F.array_intersect(f"a_{p}", f"b_{p}"))
        both = both.where(_enough(shared, F.size("a_tokens"), F.size("b_tokens"), numerator, denominator))
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    union = F.size("a_tokens") + F.size("b_tokens") - common
    return both.where(common * denominator >= union * numerator).select("a", "b").distinct()


def ngram_join(
    docs: DataFrame, width: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR,
) -> DataFrame:
    """Documents with the size of their shingle set and the component of the similarity graph they are in.

    Returns (doc_id, n_shingles, component_id), one row per input row; other
    columns are ignored.  Null or empty texts have no shingles and stay alone.
    Rows with the same doc_id are one node of the graph.  A null doc_id takes
    no part and gets a null component.  An empty table gives no rows.

    Exact copies share a fingerprint and count once.  In every bucket one central
    document is first compared with the others, so a large group of near copies
    costs one pair per member; only pairs of documents that are in different
    components afterwards, and share a bucket, are formed, if their sizes and parities allow it.
    """
    docs = docs.select("doc_id", "text")
    frequent = _frequent(docs, width)
    rows = stage(_signatures(docs, frequent, width, numerator, denominator), "ngram-signatures")
    known = rows.where("doc_id IS NOT NULL AND n_shingles > 0")

    firsts = known.groupBy("print").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").select("print", "rep")
    firsts = stage(firsts, "ngram-firsts")  # apart from the join, whose large partitions can then be split
    copies = stage(known.select("doc_id", "print").join(firsts, "print").where("doc_id <> rep").select("doc_id", "rep").distinct(), "ngram-copies")

    # an id of several rows with different texts stays a node of its own, tied to the copies of each
    # text by an edge; its pairs skip the tests on sizes
    several = known.groupBy("doc_id").agg(F.min(F.xxhash64("print")).alias("one"), F.max(F.xxhash64("print")).alias("other"))
    several = stage(several.where("one <> other").select("doc_id"), "ngram-several")
    plain = copies.join(several, "doc_id", "left_anti").select("doc_id")
    bound = copies.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    tokens = known.select("doc_id", "n_shingles", F.posexplode("prefix").alias("place", "token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    indexed = F.col("place") <= F.col("n_shingles") - F.ceil(F.col("n_shingles") * (2 * numerator) / F.lit(float(numerator + denominator)))
    shared = tokens.select("token", "doc_id", "n_shingles", indexed.alias("indexed")).join(counts, "token").join(plain, "doc_id", "left_anti")
    unsized = several.select("doc_id", F.lit(True).alias("unsized"))
    shared = shared.join(unsized, "doc_id", "left").withColumn("n_shingles", F.when(F.col("unsized").isNull(), F.col("n_shingles"))).drop("unsized")
    shared = stage(shared.distinct(), "ngram-shared")
    facts = known.join(shared.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", *(F.col("parity")[k].alias(f"b{k}") for k in range(PARITY)))
    facts = stage(facts.join(several, "doc_id", "left_anti"), "ngram-facts")

    def alike(na: str, nb: str, a: str = "a", b: str = "b"):
        """Whether sizes and parities allow the similarity; sets of unknown size pass."""
        apart = sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(PARITY)), F.lit(0))
        fits = F.least(na, nb) * denominator >= F.greatest(na, nb) * numerator
        near = F.coalesce(apart * (numerator + denominator) <= (F.col(na) + F.col(nb)) * (denominator - numerator), F.lit(True))
        return F.when(F.col(na).isNull() | F.col(nb).isNull(), True).otherwise(fits & near)

    def bits(id_: str, letter: str) -> DataFrame:
        return facts.select(F.col("doc_id").alias(id_), *(F.col(f"b{k}").alias(f"{letter}{k}") for k in range(PARITY)))

    # a star around the document of each bucket that shares most with others
    scores = shared.groupBy("doc_id").agg(F.sum("held").alias("score"))
    centers = shared.join(scores, "doc_id").groupBy("token").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("back"), "n_shingles")).alias("c"))
    centers = centers.select("token", (-F.col("c.back")).alias("b"), F.col("c.n_shingles").alias("nb"))
    stars = shared.select("token", F.col("doc_id").alias("a"), F.col("n_shingles").alias("na")).join(centers, "token").where("a <> b")
    counted = stars.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("shared")).where(_enough(F.col("shared"), F.col("na"), F.col("nb"), numerator, denominator))
    pairs = counted.join(bits("a", "a"), "a", "left").join(bits("b", "b"), "b", "left").where(alike("na", "nb"))
    pairs = stage(pairs.select("a", "b").distinct(), "ngram-pairs")
    edges = stage(_verified(pairs, docs, frequent, width, numerator, denominator).toDF("u", "v").unionByName(bound), "ngram-edges")
    labels = stage(connected_components(edges, "ngram-stars"), "ngram-labels")

    # pairs of documents of different components that share a bucket: the smaller one there with its first tokens
    placed = shared.join(labels, F.col("doc_id") == F.col("node"), "left").select(
        "token", "doc_id", "n_shingles", "indexed", F.coalesce("component", "doc_id").alias("component")
    )
    mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    open_ = stage(placed.join(mixed, "token").join(bits("doc_id", "b"), "doc_id", "left"), "ngram-open")
    small = open_.where("indexed OR n_shingles IS NULL").select(
        "token", F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("component").alias("ca"), *(F.col(f"b{k}").alias(f"a{k}") for k in range(PARITY))
    )
    large = open_.select("token", F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("component").alias("cb"), *(f"b{k}" for k in range(PARITY)))
    after = F.coalesce((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))), F.lit(True))
    across = small.join(large, (small["token"] == large["token"]) & (F.col("ca") != F.col("cb")) & after & alike("na", "nb"))
    pairs = stage(across.select("a", "b").distinct(), "ngram-pairs")
    found = _verified(pairs, docs, frequent, width, numerator, denominator).toDF("u", "v")
    edges = stage(edges.unionByName(found), "ngram-edges")
    labels = stage(connected_components(edges, "ngram-stars"), "ngram-labels")

    places = labels.select(F.col("node").alias("rep"), "component")
    moved = copies.join(places, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    # a row per document that is not alone: members of components, and copies by their first one
    placed = places.select(F.col("rep").alias("doc_id"), "component").unionByName(moved).groupBy("doc_id").agg(F.min("component").alias("component"))
    return rows.select("doc_id", "n_shingles").join(placed, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
