"""Near duplicates by MinHash bands, with odd sketches that judge a pair before its sets are compared.

An odd sketch folds a MinHash sample of a set, its smallest hashes, into a bitmap of parities.  In the XOR of two
sketches the samples that both sets share cancel, and its ones tell how many they do not share: precisely so
for high similarities.  Pairs that pass are compared on their full sets.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import map_batches, mix, stage, texts_of
from ebbline.llm.components import connected_components
from ebbline.llm.ngram_join import shingle_set

SHINGLE = 4
#: Similarity as a fraction, to compare in whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
#: A pair at the similarity shares no band with a chance of (1 - 0.8 ** ROWS) ** BANDS, 5e-8.
BANDS, ROWS = 32, 4
#: Bits of a sketch, and the smallest hashes of a set that are folded into it: of nearly all texts, all of them.
SKETCH_BITS, SAMPLES = 1024, 2048
#: Standard deviations that a similar pair of larger sets may lie off what is expected, a chance of 1e-7.
SLACK = 5.4
#: Comparisons for each member of a band's bucket, on average, beyond which a bucket of members that are mostly unlike its
#: center is split by a second shared band.
COMPARISONS = 256
#: Bits of the filter that keeps texts without a candidate from being shuffled.
FILTER_BITS = 22
#: Ways in which the members of a group of copies are spread when they look up their component.
SALTS = 8
_WORDS = SKETCH_BITS // 64
_CHUNK = 512


@cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    """The offsets and odd factors of the hash functions."""
    numbers = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)
    return mix(numbers, 11), mix(numbers, 12) | np.uint64(1)


def samples(tokens: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each hash function; a long set goes in chunks."""
    offsets, factors = _functions()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), _CHUNK):
        hashed = (tokens[at : at + _CHUNK, None] ^ offsets) * factors
        np.minimum(least, hashed.min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One hash for each band of ROWS samples; bands of different places never agree but by chance."""
    parts = least.reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        total = mix(total, 21) + parts[:, k]
    return mix(total, 22)


def odd_sketch(tokens: np.ndarray) -> np.ndarray:
    """For every slot whether an odd number of the SAMPLES smallest hashes fall there; ``tokens`` are sorted."""
    slots = (mix(tokens[:SAMPLES], 31) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(slots, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def most_ones(small: Column, large: Column, numerator: int, denominator: int) -> Column:
    """The most ones in the XOR of the sketches of two sets, of ``small`` and ``large`` tokens, that are similar.

    Sets that are folded whole differ in (small + large) * (1 - t) / (1 + t) tokens at most, and no more ones can be set.  Of larger
    sets, the share SAMPLES / large of the common tokens is expected in both samples; the ones that the other samples set
    are a sum of parities with known mean and variance.  Both may lie SLACK deviations off.
    """
    whole = (small + large) * (denominator - numerator) / F.lit(float(numerator + denominator))
    common = (small + large) * numerator / F.lit(float(numerator + denominator)) * SAMPLES / large
    apart = F.least(small, F.lit(SAMPLES)) + SAMPLES - 2 * (common - SLACK * F.sqrt(common / 2))
    n = float(SKETCH_BITS)
    mean = n / 2 * (1 - F.pow(F.lit(1 - 2 / n), apart))
    variance = n / 4 + n * (n - 1) / 4 * F.pow(F.lit(1 - 4 / n), apart) - n * n / 4 * F.pow(F.lit(1 - 2 / n), 2 * apart)
    return F.when(large <= SAMPLES, whole).otherwise(mean + SLACK * F.sqrt(F.greatest(variance, F.lit(0.0))))


def _longs(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, p1, p2, bands, sketch) of every row; equal (p1, p2) mean equal sets."""

    def work(batches):
        for batch in batches:
            sizes, prints, keys, sketches = [], [], [], []
            for text in texts_of(batch.column("text")):
                tokens = shingle_set(text, width)
                sizes.append(len(tokens))
                prints.append(np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64))
                least = samples(tokens)
                keys.append(bands(least) if len(tokens) else tokens)
                sketches.append(odd_sketch(tokens))
            both = np.array(prints, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), _longs(keys), _longs(sketches)],
                ["doc_id", "n_shingles", "p1", "p2", "bands", "sketch"],
            )

    return map_batches(docs, work, "doc_id long, n_shingles long, p1 long, p2 long, bands array<long>, sketch array<long>")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of ``ids``; a bit table of the hashed ids lets few others be shuffled.

    The table is broadcast in words of 63 bits: 2**FILTER_BITS bits at most, however many ids there are.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    word, bit = F.floor(slot / 63), (slot % 63).cast("int")
    table = ids.select(F.col("id").alias("doc_id")).select(word.alias("word"), bit.alias("bit"))
    table = table.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    marked = docs.withColumn("word", word).withColumn("bit", bit).join(F.broadcast(table), "word").where("(shiftrightunsigned(bits, bit) & 1) = 1")
    return marked.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("id"), "left_semi")


def _verified(pairs: DataFrame, docs: DataFrame, plural: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) of ids with sets that are similar.  ``plural`` names the ids of several rows."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = stage(ids.join(plural.select(F.col("doc_id").alias("id"), F.lit(True).alias("plural")), "id", "left"), "minhash-ids")

    def work(batches):
        for batch in batches:
            sets = [shingle_set(text, width) for text in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _longs(sets)], ["id", "tokens"])

    texts = _texts(docs, ids.where("plural IS NULL").select("id"))
    several = ids.where("plural").select("id")
    if not several.isEmpty():  # an id of many equal rows is compared once
        texts = texts.unionByName(_texts(docs, several).distinct())
    sets = stage(map_batches(texts, work, "id long, tokens array<long>"), "minhash-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b"
    )
    common = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - common
    return both.where(common * denominator >= union * numerator).select("a", "b")


def _apart(a: str, b: str) -> Column:
    """The ones in the XOR of two sketches."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(_WORDS)), F.lit(0))


def _across(shared: DataFrame, sets: DataFrame, centers: DataFrame, alike) -> DataFrame:
    """The pairs of sets of different components that share a bucket and are alike by size and sketch.

    ``shared`` holds (key, id, component), ``centers`` (key, b).  Members are compared with those outside of the largest component of
    their bucket, so a bucket costs as much as it has pairs to judge.  One that has many for its size, and whose members
    are mostly unlike its center, arose around a passage that unlike texts hold: it is split by each further band its
    members share, of which similar sets have ten more on average.
    """
    counts = shared.groupBy("key", "component").agg(F.count("*").cast("double").alias("n"))
    buckets = counts.groupBy("key").agg(
        F.max_by("component", "n").alias("main"), F.sum("n").alias("members"), F.sum(F.col("n") * F.col("n")).alias("same"), F.count("*").alias("components")
    ).where("components > 1")
    many = (F.col("members") * F.col("members") - F.col("same")) / 2 > F.col("members") * COMPARISONS
    open_ = shared.join(stage(buckets.select("key", "main", many.alias("many")), "minhash-buckets"), "key")
    open_ = stage(open_.join(sets.select("id", "n_shingles", "sketch"), "id"), "minhash-open")

    hubs = centers.select("key", F.col("b").alias("id")).join(sets.select("id", "n_shingles", "sketch"), "id")
    hubs = stage(hubs.select("key", F.col("n_shingles").alias("c_n_shingles"), F.col("sketch").alias("c_sketch")).dropDuplicates(["key"]), "minhash-hubs")
    # half of the ones that equally many samples of two sets without a common one set
    tosses = F.least("n_shingles", F.lit(SAMPLES)) + F.least("c_n_shingles", F.lit(SAMPLES))
    unlike = _apart("sketch", "c_sketch") * 2 > SKETCH_BITS / 2 * (1 - F.pow(F.lit(1 - 2 / SKETCH_BITS), tosses))
    loose = open_.where("many").join(hubs, "key").groupBy("key").agg(F.avg(unlike.cast("int")).alias("share")).where("share > 0.5").select("key", F.lit(True).alias("loose"))
    open_ = stage(open_.join(stage(loose, "minhash-loose"), "key", "left"), "minhash-open")

    split = open_.where("loose").select("key", "id", "component").join(sets.select("id", "bands"), "id")
    parts = split.select("id", "component", "key", F.explode(F.array_remove("bands", F.col("key"))).alias("other"))
    parts = parts.select("id", "component", F.xxhash64(F.least("key", "other"), F.greatest("key", "other")).alias("key")).distinct()
    parts = stage(parts, "minhash-parts")
    again = parts.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", "n").alias("main"), F.count("*").alias("components"))
    parts = parts.join(stage(again.where("components > 1").drop("components"), "minhash-buckets"), "key").join(sets.select("id", "n_shingles", "sketch"), "id")
    members = stage(open_.where("loose IS NULL").drop("many", "loose").unionByName(parts), "minhash-members")

    side = {x: members.select("key", *(F.col(c).alias(f"{x}_{c}") for c in ("id", "component", "main", "n_shingles", "sketch"))) for x in "ab"}
    pairs = side["a"].where("a_component <> a_main").join(
        side["b"].drop("b_main").withColumnRenamed("key", "b_key"),
        (F.col("key") == F.col("b_key")) & (F.col("a_component") != F.col("b_component"))
        & ((F.col("b_component") == F.col("a_main")) | (F.col("a_id") < F.col("b_id"))) & alike("a_", "b_"),
    )
    return pairs.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()


def minhash_dedup(docs: DataFrame, width: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """Documents with the component of near duplicates they are in, and whether they are its first.

    Returns (doc_id, n_shingles, component_id, kept), one row per input row; other columns
    are ignored.  Documents link when the Jaccard similarity of their sets of word shingles reaches the fraction; every
    link is confirmed on the full sets, and one is missed with a chance of about 1e-7, or 1e-6 where all buckets that both
    are in had to be split.  Null or empty texts have no shingles and stay alone, kept, also where other rows have their doc_id.
    Otherwise rows with the same doc_id are one node of the graph.  A null doc_id takes no part and gets a
    null component and null ``kept``.  An empty table gives no rows.

    Exact copies share a fingerprint and are compared once.  Of each bucket of a band one member, the same in many
    buckets, is compared with the others first, once for each of them; then only members of different components are compared.
    """
    docs = docs.select("doc_id", "text")
    rows = stage(_signatures(docs, width).withColumn("row", F.monotonically_increasing_id()), "minhash-signatures")
    known = rows.where("doc_id IS NOT NULL AND n_shingles > 0")

    # one row, with the smallest doc_id, of every distinct set
    firsts = known.groupBy("p1", "p2").agg(F.min("doc_id").alias("id"), F.min_by("row", "doc_id").alias("row"), F.count("*").alias("rows"))
    firsts = stage(firsts, "minhash-firsts")
    sets = rows.select("row", F.col("doc_id").alias("id"), "n_shingles", "bands", "sketch").join(firsts.select("row"), "row", "left_semi").drop("row")
    sets = stage(sets, "minhash-reps")

    # an id of several rows: its different sets are tied by edges to the first of each
    plural = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    plural = stage(plural, "minhash-plural")
    bound = known.select("doc_id", "p1", "p2").join(plural, "doc_id", "left_semi").distinct().join(firsts.select("p1", "p2", "id"), ["p1", "p2"])
    bound = bound.where("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))

    def alike(a: str, b: str) -> Column:
        """Whether sizes and sketches allow the similarity."""
        small, large = (f(f"{a}n_shingles", f"{b}n_shingles") for f in (F.least, F.greatest))
        return (small * denominator >= large * numerator) & (_apart(f"{a}sketch", f"{b}sketch") <= most_ones(small, large, numerator, denominator))

    keys = sets.select("id", F.explode("bands").alias("key")).distinct() if not plural.isEmpty() else sets.select("id", F.explode("bands").alias("key"))
    counts = stage(keys.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "minhash-counts")
    shared = stage(keys.join(counts, "key"), "minhash-shared")

    # a star around the member of each bucket that shares most with others
    scores = shared.groupBy("id").agg(F.sum("held").alias("score"))
    scores = scores.withColumn("score", F.col("score") + F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    centers = shared.join(scores, "id").groupBy("key").agg(F.max_by("id", "score").alias("b"), F.max("score").alias("score"))
    centers = stage(centers, "minhash-centers")
    stars = shared.select("key", F.col("id").alias("a")).join(centers, "key").where("a <> b").select("a", "b", "score").distinct()
    facts = sets.join(shared.select("id").distinct(), "id", "left_semi")
    facts = stage(facts.select("id", "n_shingles", "sketch", "bands"), "minhash-facts")

    def side(x: str) -> DataFrame:
        return facts.select(F.col("id").alias(x), F.col("n_shingles").alias(f"{x}_n_shingles"), F.col("sketch").alias(f"{x}_sketch"))

    near = stars.join(side("a"), "a").join(side("b"), "b").where(alike("a_", "b_"))
    pairs = stage(near.groupBy("a").agg(F.max_by("b", "score").alias("b")), "minhash-pairs")
    edges = _verified(pairs, docs, plural, width, numerator, denominator).toDF("u", "v").unionByName(bound)
    edges = stage(edges, "minhash-edges")
    labels = stage(connected_components(edges, "minhash-stars"), "minhash-labels")

    places = labels.select(F.col("node").alias("id"), "component")
    placed = shared.select("key", "id").join(places, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    pairs = stage(_across(stage(placed, "minhash-placed"), facts, centers, alike), "minhash-pairs")
    found = _verified(pairs, docs, plural, width, numerator, denominator).toDF("u", "v")
    labels = connected_components(stage(edges.unionByName(found), "minhash-edges"), "minhash-stars")

    # the component of every set that has copies or links, several times over so that a large group of copies spreads
    places = stage(labels.select(F.col("node").alias("id"), "component"), "minhash-labels")
    of_set = firsts.join(places, "id", "left").where("rows > 1 OR component IS NOT NULL").select(
        "p1", "p2", F.coalesce("component", "id").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    of_set = stage(of_set, "minhash-components")
    salted = rows.select("doc_id", "n_shingles", "p1", "p2", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    joined = salted.join(of_set, ["p1", "p2", "salt"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
