"""Exact nearest vectors by inner product, the k-th score of every query found in shrinking histograms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.common import stage

#: Bins of a histogram, queries in one block (they go to every task), candidates scored at once.
BINS, QUERY_BLOCK, CHUNK = 512, 4096, 2048


#: Sums of products below this are exact in doubles; vectors whose squares sum up to less than LONG meet in 64 bits.
DOUBLE, LONG = 2.0**53, 2.0**62
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The exact inner products of whole numbers, as longs; one that no long holds becomes the nearest long.

    Small numbers multiply as doubles, which is fast; larger ones as longs if the lengths of both vectors
    bound the product; the rest as integers of any size.
    """
    if np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1] < DOUBLE:
        return np.rint(queries @ vectors.T).astype(np.int64)
    with np.errstate(over="ignore"):
        short = [(m.astype(float) ** 2).sum(axis=1) < LONG for m in (queries, vectors)]
    found = np.zeros((len(queries), len(vectors)), np.int64)
    found[np.ix_(*short)] = queries[short[0]].astype(np.int64) @ vectors[short[1]].astype(np.int64).T
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (queries, vectors)]
    for rows, columns in ((~short[0], np.ones(len(vectors), bool)), (short[0], ~short[1])):
        if rows.any() and columns.any():
            found[np.ix_(rows, columns)] = np.clip(whole[0][rows] @ whole[1][columns].T, LOWEST, HIGHEST).astype(np.int64)
    return found


def _distance(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """high - low of longs, which may need all 64 bits."""
    return high.astype(np.uint64) - low.astype(np.uint64)


def _matrix(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors of a batch by dimension: (ids, matrix).  They are whole numbers."""
    lists, ids = batch.column("vector"), batch.column("vec_id").to_numpy(zero_copy_only=False)
    sizes, flat, found = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), {}
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        found[int(size)] = ids[rows], flat[starts[rows][:, None] + np.arange(size)]
    return found


def _scored(batches, queries: dict[int, tuple[np.ndarray, np.ndarray]]):
    """(queries' positions, candidates' ids, scores, own) in chunks; own marks a query's own row."""
    for batch in batches:
        for size, (ids, matrix) in _matrix(batch).items():
            if size in queries:
                numbers, vectors, query_ids = queries[size]
                for at in range(0, len(ids), CHUNK):
                    part = ids[at : at + CHUNK]
                    scores = products(vectors, matrix[at : at + CHUNK])
                    yield numbers, part, scores, query_ids[:, None] == part[None, :]


def _block(rows: pa.Table) -> tuple[np.ndarray, dict]:
    """Ids of the queries and, for each dimension, their positions, vectors and ids."""
    batch = rows.combine_chunks().to_batches()[0]
    ids, by_size, at = [], {}, 0
    for size, (own, matrix) in _matrix(batch).items():
        by_size[size] = np.arange(at, at + len(own)), matrix, own
        ids.append(own)
        at += len(own)
    return np.concatenate(ids), by_size


def _search(vectors: DataFrame, rows: pa.Table, k: int) -> DataFrame:
    """The best ``k`` of one block of queries."""
    ids, queries = _block(rows)

    def ranges(batches):
        low, high, count = np.full(len(ids), HIGHEST), np.full(len(ids), LOWEST), np.zeros(len(ids), np.int64)
        for numbers, _, scores, own in _scored(batches, queries):
            low[numbers] = np.minimum(low[numbers], np.where(own, HIGHEST, scores).min(axis=1))
            high[numbers] = np.maximum(high[numbers], np.where(own, LOWEST, scores).max(axis=1))
            count[numbers] += (~own).sum(axis=1)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(low[seen]), pa.array(high[seen]), pa.array(count[seen])], ["q", "low", "high", "n"])

    found = vectors.mapInArrow(ranges, "q long, low long, high long, n long").groupBy("q").agg(F.min("low"), F.max("high"), F.sum("n")).toArrow()
    low, high, wanted = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64)
    q, least, most, n = (found.column(i).to_numpy() for i in range(4))
    low[q], high[q], wanted[q] = least, most, np.minimum(k, n)
    # the wanted-th highest score lies in [low, high]; ``wanted`` counts what is still to be found in that range
    while (wanted > 0).any() and _distance(high, low)[wanted > 0].max() > 0:
        step = _distance(high, low) // np.uint64(BINS) + np.uint64(1)

        def histogram(batches, low=low, high=high, step=step):
            counts = np.zeros((len(ids), BINS), np.int64)
            for numbers, _, scores, own in _scored(batches, queries):
                inside = ~own & (scores >= low[numbers, None]) & (scores <= high[numbers, None])
                row, column = np.nonzero(inside)
                bins = (_distance(scores[row, column], low[numbers[row]]) // step[numbers[row]]).astype(np.int64)
                counts += np.bincount(numbers[row] * BINS + bins, minlength=counts.size).reshape(counts.shape)
            row, column = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(column), pa.array(counts[row, column])], ["q", "bin", "n"])

        rows_ = vectors.mapInArrow(histogram, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((len(ids), BINS), np.int64)  # bounded by the block of queries
        counts[rows_.column("q").to_numpy(), rows_.column("bin").to_numpy()] = rows_.column("n").to_numpy()
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        chosen = np.maximum((above >= np.maximum(wanted, 1)[:, None]).sum(axis=1) - 1, 0)
        rest = np.where(chosen + 1 < BINS, np.take_along_axis(above, np.minimum(chosen + 1, BINS - 1)[:, None], 1)[:, 0], 0)
        wanted = np.where(wanted > 0, wanted - rest, 0)
        start = chosen.astype(np.uint64) * step
        first = (low.astype(np.uint64) + start).view(np.int64)
        last = (low.astype(np.uint64) + np.minimum(start + step - np.uint64(1), _distance(high, low))).view(np.int64)
        low, high = np.where(wanted > 0, first, low), np.where(wanted > 0, last, low)

    has = np.zeros(len(ids), bool)
    has[q] = n > 0

    def best(batches):
        """All scores over the k-th, and of those equal to it the ``k`` smallest ids of each task."""
        above: list[tuple] = []
        equal: dict[int, np.ndarray] = {}
        for numbers, part, scores, own in _scored(batches, queries):
            row, column = np.nonzero(~own & has[numbers, None] & (scores > low[numbers, None]))
            above.append((numbers[row], part[column], scores[row, column]))
            row, column = np.nonzero(~own & has[numbers, None] & (scores == low[numbers, None]))
            order = np.lexsort((part[column], row))
            row, column = row[order], column[order]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
            row, column = row[place < k], column[place < k]
            for r in np.unique(row):
                held = np.append(equal.get(numbers[r], np.empty(0, np.int64)), part[column[row == r]])
                equal[numbers[r]] = np.sort(held)[:k]
        above += [(np.full(len(v), q_), v, np.full(len(v), low[q_])) for q_, v in equal.items()]
        if above:
            q_, c, s = (np.concatenate([x[i] for x in above]) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q_.astype(np.int64)], pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(best, "query_id long, vec_id long, score long")


def top_k(embeddings: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of every query row.

    Components become floor(scale * x), so scores are exact whole numbers.  ``is_query``
    is a column that marks the query rows; every row with another vec_id is a candidate,
    ties go to the smaller vec_id, and a query with fewer candidates returns them all.
    Scores of large components are exact too; one that does not fit in a long counts as the nearest long.
    Null vectors, vectors with a null or non-finite component (or one that is not finite times ``scale``), empty vectors and rows without an id
    take no part; vectors of different length do not meet.  Rows that repeat a query's id and
    vector count as one query; repeated candidates fill one rank each.  An empty table gives no rows.

    Queries are taken in blocks of at most QUERY_BLOCK, which go to every task.  For
    each block the range of scores, then histograms within the bin of the k-th score,
    narrow that score down to one value; only what reaches it is ranked.
    """
    sound = F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * float(scale)) == float("inf")))
    vectors = embeddings.withColumn("asked", F.coalesce(is_query, F.lit(False))).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector"), "asked"
    ).where(F.col("vec_id").isNotNull() & sound)

    def floor(x):
        """Doubles from 2**52 on are whole already, and may be too large for the long that floor gives."""
        y = x * float(scale)
        return F.when(F.abs(y) < 2.0**52, F.floor(F.when(F.abs(y) < 2.0**52, y)).cast("double")).otherwise(y)

    vectors = stage(vectors.withColumn("vector", F.transform("vector", floor)), "topk-vectors")
    queries = stage(vectors.where("asked").select("vec_id", "vector").distinct(), "topk-queries")
    count = queries.count()
    blocks = -(-count // QUERY_BLOCK)
    result = None
    for block in range(blocks):
        for part in _bounded(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block) if blocks > 1 else queries):
            rows = _search(vectors.select("vec_id", "vector"), part, k)
            result = rows if result is None else result.unionByName(rows)
    if result is None:
        result = vectors.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bounded(block: DataFrame):
    """A hashed block of about QUERY_BLOCK queries in slices of at most so many."""
    rows = block.toArrow()
    for at in range(0, rows.num_rows, QUERY_BLOCK):
        yield rows.slice(at, QUERY_BLOCK)
