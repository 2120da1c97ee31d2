"""Allowing and blocking addresses by rules, and by a ratio of two character language models where no rule fits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import LOWER, map_batches, stage, texts_of, UPPER

#: Longest context in characters, weight of the shorter context.
ORDER, BACKOFF = 5, 1.0
#: Symbols are 1 + byte, 257 + byte in a scheme, and two marks; strings of up to ORDER + 1 of them are whole numbers to this base, below 2**63.
SCHEME, BEGIN, END, BASE = 256, 513, 514, 515
#: Characters that are scored together at most, but for longer texts.
BLOCK_CHARS = 1 << 18
#: Scores are compared in this many bins of log-likelihood per character when the threshold is chosen.
BINS, SPAN = 2000, 10.0


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits the host or a parent of it and starts the path; null where none does."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _encoded(text: str) -> tuple[np.ndarray, int]:
    """Symbols of a url, and how many of them stand behind its scheme."""
    scheme, mark, rest = text.partition("://")
    if not mark:
        scheme, rest = "", text
    front, back = (np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64) + 1 for t in (scheme + mark, rest))
    return np.concatenate([front + SCHEME, back]), len(back)


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts behind their begin marks, the places of what is predicted, and the size of every text with its end mark, whole and without scheme."""
    parts = [_encoded(t) for t in texts]
    sizes, lengths = (np.array(n, np.int64) for n in ([len(p) + 1 for p, _ in parts], [n + 1 for _, n in parts]))
    begin, end = np.full(ORDER, BEGIN, np.int64), np.array([END], np.int64)
    symbols = np.concatenate([x for p, _ in parts for x in (begin, p, end)]) if parts else np.empty(0, np.int64)
    places = np.repeat(np.cumsum(sizes + ORDER) - sizes, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return symbols, places, sizes, lengths


def _codes(symbols: np.ndarray, places: np.ndarray, longest: int) -> list[np.ndarray]:
    """Codes of the strings of 1 to ``longest`` symbols that end at each place; different strings have different codes."""
    codes = [symbols[places]]
    for back in range(1, longest):
        codes.append(codes[-1] + symbols[places - back] * BASE**back)
    return codes


def _without(symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Codes of the context without symbols: -1 in a scheme, whose symbols are a set of their own, 0 elsewhere."""
    return np.where((symbols[places] > SCHEME) & (symbols[places] < BEGIN), -1, 0)


def _keys(texts: list[str]) -> np.ndarray:
    """Codes to count: every predicted symbol with each context, and each context of only begin marks or no symbol.

    Any other context is itself a shorter gram, and is followed by a symbol whenever it occurs.
    """
    symbols, places, sizes, _ = _symbols(texts)
    grams = _codes(symbols, places, ORDER + 1)
    first = places[np.cumsum(sizes) - sizes] - 1
    return np.concatenate([_without(symbols, places), *grams, *_codes(symbols, first, ORDER)])


def _slices(texts: list[str]) -> list[tuple[int, int]]:
    """(begin, end) of runs of at most BLOCK_CHARS characters; a longer text is alone."""
    found, begin, held = [], 0, 0
    for i, text in enumerate(texts):
        if i > begin and held + len(text) > BLOCK_CHARS:
            found.append((begin, i))
            begin, held = i, 0
        held += len(text)
    return [*found, (begin, len(texts))] if texts else []


def _in_blocks(pages: DataFrame) -> DataFrame:
    """The rows with the ``block`` they are scored in, at most one Arrow batch and one slice of it."""

    def work(batches):
        block = TaskContext.get().partitionId() << 40
        for batch in batches:
            for begin, end in _slices(list(texts_of(batch.column("address")))):
                block += 1
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(end - begin, block, np.int64))], [*part.schema.names, "block"])

    return map_batches(pages, work, ", ".join(f"{n} {t}" for n, t in pages.dtypes) + ", block long")


def _counts(known: DataFrame) -> DataFrame:
    """(key, c0, c1, c2, c3): how often each gram occurs in the labelled urls of kind 2 * fold + accepted, exactly."""

    def work(batches):
        for batch in batches:
            texts, kinds = list(texts_of(batch.column("address"))), batch.column("kind").to_numpy()
            for begin, end in _slices(texts):
                for kind in np.unique(kinds[begin:end]):
                    keys, n = np.unique(_keys([t for t, k in zip(texts[begin:end], kinds[begin:end], strict=True) if k == kind]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), kind, np.int32)), pa.array(n)], ["key", "kind", "n"])

    rows = map_batches(known.select("address", "kind"), work, "key long, kind int, n long")
    return rows.groupBy("key").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(4)))


def _wanted(blocks: DataFrame) -> DataFrame:
    """(block, key): the grams of each block once, however often they occur there."""

    def work(batches):
        for batch in batches:
            texts, ids = list(texts_of(batch.column("address"))), batch.column("block").to_numpy()
            for block in np.unique(ids):
                keys = np.unique(_keys([texts[i] for i in np.flatnonzero(ids == block)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block, np.int64)), pa.array(keys)], ["block", "key"])

    return map_batches(blocks.select("address", "block"), work, "block long, key long")


def _likelihoods(contexts: list[np.ndarray], grams: list[np.ndarray]) -> np.ndarray:
    """Log-probability of every symbol from the counts of its contexts and grams, each context smoothed by the next shorter one."""
    chance = np.full(len(contexts[0]), 1 / 256)
    for context, gram in zip(contexts, grams, strict=True):
        chance = (gram + BACKOFF * chance) / (context + BACKOFF)
    return np.log(chance)


def _ratios(texts: list[str], folds: np.ndarray, keys: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ratio of every text by all counts, and by those of the fold it is not in, for each character behind the scheme.

    ``keys`` ascend and are not empty; ``counts`` are theirs by kind.
    """
    symbols, places, sizes, lengths = _symbols(texts)
    rows = np.repeat(np.arange(len(texts)), sizes)

    def found(codes: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        at = [np.minimum(np.searchsorted(keys, c), len(keys) - 1) for c in codes]
        return [(i, keys[i] == c) for i, c in zip(at, codes, strict=True)]

    contexts = found([_without(symbols, places), *_codes(symbols, places - 1, ORDER)])
    grams = found(_codes(symbols, places, ORDER + 1))
    other = (folds == 0)[rows]

    def of(accepted: int, crossed: bool) -> np.ndarray:
        first, second = counts[accepted], counts[2 + accepted]

        def take(i: np.ndarray, there: np.ndarray) -> np.ndarray:
            n = np.where(other, second[i], first[i]) if crossed else first[i] + second[i]
            return np.where(there, n, 0.0)

        return _likelihoods([take(*x) for x in contexts], [take(*x) for x in grams])

    whole, cross = (np.bincount(rows, of(1, crossed) - of(0, crossed), len(texts)) / lengths for crossed in (False, True))
    return whole, cross


def _scored(blocks: DataFrame) -> DataFrame:
    """The rows with ``ratio`` by all counts and, of the labelled ones, ``bin`` of their ratio by the counts of the other fold.

    Counts stay in their table: the grams of each block are joined to it, and what they
    find meets the rows of the block again.  Spark takes both sides for as small as the
    urls they are made of, so it is told not to broadcast one.
    """
    looked = _wanted(blocks).join(_counts(blocks.where("kind IS NOT NULL")).hint("merge"), "key")

    def work(rows: pa.Table, found: pa.Table) -> pa.Table:
        keys = found.column("key").to_numpy()
        order = np.argsort(keys)
        counts = [found.column(f"c{k}").to_numpy()[order].astype(np.float64) for k in range(4)]
        keys = keys[order]
        if not len(keys):  # no labelled urls at all
            keys, counts = np.zeros(1, np.int64), [np.zeros(1)] * 4
        kinds = rows.column("kind").fill_null(-1).to_numpy()
        ratio, cross = _ratios([t or "" for t in rows.column("address").to_pylist()], kinds // 2, keys, counts)
        bins = np.clip(np.floor((cross + SPAN) * (BINS / (2 * SPAN))), 0, BINS - 1).astype(np.int32)
        return rows.append_column("ratio", pa.array(ratio, pa.float64())).append_column("bin", pa.array(bins, pa.int32(), mask=kinds < 0))

    schema = ", ".join(f"{n} {t}" for n, t in blocks.dtypes) + ", ratio double, bin int"
    return blocks.groupBy("block").cogroup(looked.groupBy("block")).applyInArrow(work, schema)


def _threshold(scored: DataFrame) -> float:
    """The threshold with the highest mean of the shares judged rightly, the nearest to 0 of several; minus infinity without both kinds."""
    bins = scored.where("kind IS NOT NULL").groupBy((F.col("kind") % 2).alias("accepted"), "bin").count()
    shares = np.zeros((2, BINS))
    for row in bins.collect():  # at most two rows for each bin
        shares[row["accepted"], row["bin"]] = row["count"]
    totals = shares.sum(axis=1)
    if not totals.all():
        return -np.inf
    edges = np.arange(BINS + 1) * (2 * SPAN / BINS) - SPAN
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(shares, axis=1)], axis=1) / totals[:, None]
    right = below[0] + (1 - below[1])
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def url_filter(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, ratio) for every row of ``pages``.

    ``rules`` are ("allow" or "block", "host/path") pairs; the longest that fits
    decides, and the urls it decides are what the two language models are counted on,
    all of them and whole: scheme, query and fragment too.  Each half is scored by the counts of the other half to choose the threshold.
    Other urls are allowed if their log-likelihood under the accepted model less that under the
    rejected one, for each character behind the scheme, reaches that threshold; without urls
    of both kinds nothing is rejected.  A null url, which counts as empty, or one without ``://`` has an empty host and path, and the models judge it like others.
    Counts are exact, in a table that grows with the corpus and is only joined to, never gathered.
    Repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
    """
    parts = pages.select("page_id", F.coalesce("url", F.lit("")).alias("address"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.lit(None).cast("string")
    for verdict, rule in rules:
        verdicts = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(verdicts)
    parts = parts.withColumn("ruled", verdicts)
    fold = F.pmod(F.xxhash64("address", F.lit(10)), F.lit(2))
    kind = F.when(F.col("ruled").isNotNull(), 2 * fold + (F.col("ruled") == "allow").cast("int"))
    blocks = stage(_in_blocks(parts.withColumn("kind", kind.cast("int"))), "url-blocks")
    scored = stage(_scored(blocks), "url-scored")
    method = F.when(F.col("ratio") >= _threshold(scored), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "ratio")
