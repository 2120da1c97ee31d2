"""Readers: CSV and Parquet zones, remote files, SQL and JDBC."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions import roles
from ebbline.operators.shape import drop_id, normalize_columns, plain_number

# Spellings of a missing value in text files.
NULL_SPELLINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
CORRUPT = "_corrupt_record"
#: Quotes inside a quoted field are doubled and fields may hold line breaks, on reading and on writing alike.
CSV_DIALECT = {"quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

# What runs in Python workers travels with the task, so the workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A line read from outside of a quoted field that leaves one open; a quote opens a field only as its first character.
_OPENS = re.compile(r'^(?:(?:"(?:[^"]|"")*+"[^,]*+|(?!")[^,]*+),)*+"(?:[^"]|"")*+$', re.S)
#: The part of a line that still belongs to a field which is open before it, with the quote that closes it.
_CLOSES = re.compile(r'(?:[^"]|"")*+"', re.S)


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.options(**CSV_DIALECT).option("header", True).option("inferSchema", False).csv(path).columns


def _open_after(line: str, open_: bool) -> bool:
    """Whether a quoted field is open after a line, given whether one is before it."""
    if open_:
        closing = _CLOSES.match(line)
        if not closing:
            return True
        comma = line.find(",", closing.end())
        if comma < 0:
            return False
        line = line[comma + 1 :]
    return bool(_OPENS.match(line))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files with the file and the block of it they were read from, and their order in the block."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )


_STATE = ["file", "block", "outside", "outside_opens", "inside", "inside_opens", "returns"]


def _block_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block, what follows from a quoted field being open before it or not: the state behind it, and the records that go on over a line's end.

    ``returns`` tells whether a line has a carriage return inside, which other readers take for a line's end.
    """
    now: dict[tuple[int, int], list] = {}
    for batch in batches:
        for value, *key in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block"))):
            state = now.setdefault(tuple(key), [False, 0, True, 0, False])
            for side in (0, 2):
                before, state[side] = state[side], _open_after(value, state[side])
                state[side + 1] += state[side] and not before
            state[4] = state[4] or "\r" in value[:-1]
    rows = [(*key, *state) for key, state in now.items()]
    if rows:
        yield pa.RecordBatch.from_pydict(dict(zip(_STATE, map(list, zip(*rows)))))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines with ``record``, the number in its file of the record over several lines that a line is part of, else null; ``first`` marks a file's first line.

    Lines of a block come in their order; ``open`` and ``opens`` say whether a field is open before the block, and how many such records began.
    """
    key, open_, opens = None, False, 0
    for batch in batches:
        quoted = pc.match_substring(batch.column("value"), '"').to_pylist()
        records: list[int | None] = []
        firsts: list[bool] = []
        for i, (file, block, start, count) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "block", "open", "opens")))):
            firsts.append((file, block) != key and block == 0)
            if (file, block) != key:
                key, open_, opens = (file, block), start, count
            before = open_
            if quoted[i]:
                open_ = _open_after(batch.column("value")[i].as_py(), open_)
                opens += open_ and not before
            records.append(opens if before or open_ else None)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("value", "file", "block", "at")), pa.array(records, pa.int64()), pa.array(firsts, pa.bool_())], ["value", "file", "block", "at", "record", "first"]
        )


def _records(lines: DataFrame) -> DataFrame | None:
    """(value, first) of every record, those over several lines put together; None if every line is one.

    Quotes decide.  The lines that hold some tell for each block of a file in which state it leaves the next one, and these are summed
    up over the blocks; then all tasks know where their lines stand.  Only the lines of records over several lines are shuffled.
    """
    kinds = "file long, block long, outside boolean, outside_opens long, inside boolean, inside_opens long, returns boolean"
    found = lines.where(F.contains("value", F.lit('"'))).mapInArrow(_block_states, kinds).collect()  # one for each block
    if not any(r["outside_opens"] or r["returns"] for r in found):
        return None
    known, blocks, file = {(r["file"], r["block"]): r for r in found}, [], None
    for r in sorted(map(tuple, lines.select("file", "block").distinct().collect())):
        if r[0] != file:
            file, open_, opens = r[0], False, 0
        blocks.append((*r, open_, opens))
        if r in known:
            side = "inside" if open_ else "outside"
            open_, opens = known[r][side], opens + known[r][f"{side}_opens"]
    before = lines.sparkSession.createDataFrame(blocks, "file long, block long, open boolean, opens long")  # 40 bytes for each block of the input
    kinds = "value string, file long, block long, at long, record long, first boolean"
    numbered = lines.join(F.broadcast(before), ["file", "block"]).select("value", "file", "block", "at", "open", "opens").mapInArrow(_numbered, kinds)
    whole = numbered.where("record IS NULL").select("value", "first")
    line = F.struct("block", "at", "value")
    parts = numbered.where("record IS NOT NULL").groupBy("file", "record").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.max("first").alias("first"))
    return whole.unionByName(parts.select(F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"), "first"))


def _text_columns(spark: SparkSession, path: str) -> DataFrame:
    """The fields of all records as text, under the names of the header."""
    names = _header(spark, path)
    text = T.StructType([T.StructField(name, T.StringType()) for name in names])
    records = _records(_lines(spark, path))
    if records is None:
        reader = spark.read.schema(text).options(**CSV_DIALECT | {"multiLine": False}).option("header", True).option("enforceSchema", False)
        return reader.option("mode", "PERMISSIVE").csv(path)
    stripped = records.withColumn("value", F.regexp_replace("value", "\r$", ""))
    columns = ", ".join("`{}` string".format(name.replace("`", "``")) for name in names)
    parsed = stripped.select("first", "value", F.from_csv("value", columns, {k: str(v) for k, v in CSV_DIALECT.items()} | {"mode": "PERMISSIVE"}).alias("r"))
    for row in parsed.where("first").select("r").distinct().collect():  # as many as there are different headers
        if [str(v).strip() for v in row["r"]] != [name.strip() for name in names]:
            raise ValueError(f"a file has another header: {list(row['r'])}, not {names}")
    return parsed.where("NOT first AND value <> ''").select("r.*")


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType = roles.CUSTOMER_SCHEMA,
    normalize: bool = True,
    drop_ids: bool = True,
    keep_corrupt: bool = False,
) -> DataFrame:
    """Read customer CSV with a declared schema.

    Columns are read as text in file order, so any subset and any known
    spelling of the header works, then cast by name: unknown columns stay text,
    null spellings become null and a value that does not parse becomes null
    (the reason to ``keep_corrupt`` is to see such rows: it adds a flag column).
    All files of a folder must have the same header; another one is an error.
    A file of any size is read by many tasks, also where quoted fields hold line breaks.
    """
    df = _text_columns(spark, path)
    if normalize:
        df = normalize_columns(df)
    known = {field.name: field.dataType for field in schema}
    out, bad = [], F.lit(False)
    for name in df.columns:
        value = F.when(~F.trim(F.col(name)).isin(NULL_SPELLINGS), F.col(name))
        kind = known.get(name, T.StringType())
        if isinstance(kind, T.NumericType):
            cast = plain_number(value).try_cast(kind)
        else:
            cast = value.cast(kind)
        bad = bad | (value.isNotNull() & cast.isNull())
        out.append(cast.alias(name))
    if keep_corrupt:
        out.append(bad.alias(CORRUPT))
    df = df.select(*out)
    return drop_id(df) if drop_ids else df


def read_zone(
    spark: SparkSession, zone: str, name: str, *, format: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Read a named table of a zone folder; a missing one raises AnalysisException."""
    path = f"{zone.rstrip('/')}/{name}"
    if format == "csv":
        return read_csv(spark, path, drop_ids=False)
    reader = spark.read.format(format)
    return (reader.schema(schema) if schema else reader).load(path)


def ingest_uri(
    spark: SparkSession, uri: str, raw_zone: str, name: str, *, drop_ids: bool = True, save_raw: bool = True
) -> DataFrame:
    """Read CSV from any Hadoop file system, land it in the raw zone and return the landed table."""
    df = read_csv(spark, uri, drop_ids=drop_ids)
    if not save_raw:
        return df
    path = f"{raw_zone.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_sql(spark: SparkSession, query: str, **args) -> DataFrame:
    """A parameterised query: ``:name`` markers are bound, not pasted."""
    return spark.sql(query, args=args)


def read_jdbc(
    spark: SparkSession, url: str, table: str, *, partition_column: str, lower: int, upper: int, partitions: int, **properties: str
) -> DataFrame:
    """A database table read in parallel ranges of a numeric column."""
    return spark.read.jdbc(
        url, table, column=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions,
        properties=properties,
    )
