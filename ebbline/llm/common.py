"""Reading, staging and hashing shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.session import staged

#: A-Z only, as the contracts ask; str.lower would also change other letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a worker's function gets at once, for some texts are very long.
BATCH_ROWS = 500
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and survives lost executors.

    While it is written Spark sends rows to the workers in batches of BATCH_ROWS, which bounds what both hold of them;
    afterwards the session is as it was.
    """
    conf = df.sparkSession.conf
    before = conf.get(_ROWS)
    conf.set(_ROWS, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        return staged(df, name)
    finally:
        conf.set(_ROWS, before)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in slices of at most BATCH_ROWS rows."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(batch.slice(at, BATCH_ROWS) for batch in batches for at in range(0, max(batch.num_rows, 1), BATCH_ROWS))

    return df.mapInArrow(sliced, schema)


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``work`` to every Arrow batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield work(batch)

    return map_batches(df, each, schema)


def texts_of(column: pa.Array) -> Iterator[str]:
    """The strings of a column one at a time, null as empty, without a list of them all."""
    for value in column:
        yield value.as_py() or ""


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = values.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def smallest(df: DataFrame, key: str, seed: int, most: int) -> DataFrame:
    """At most ``most`` rows, those whose key has the smallest draw; ties by the key and the other columns.

    A share of the draws that holds about twice as many goes first, so that the tasks together pass on about that and
    not ``most`` rows each.
    """
    rows = df.count()
    draw = uniform(F.col(key), seed)
    few = df.where(draw < 2.0 * most / rows) if rows > 2 * most else df
    return few.orderBy(draw, *df.columns).limit(most)


def uniform(column, seed: int):
    """A draw in [0, 1) that depends on the value only, so it is the same on every run and layout."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
