"""The training-data pipeline over ``documents``: toxicity, near duplicates, decontamination, mixing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept, and returns the columns of ``documents``; the last one adds tokens, topic and weights.
Documents without an id or a text pass the stages like others; each stage says how it takes nulls and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.llm.common import stage, table
from ebbline.llm.corpus import TARGETS
from ebbline.llm.decontaminate import find_benchmark
from ebbline.llm.mixing import mix_sources
from ebbline.llm.ngram_join import ngram_join
from ebbline.llm.toxicity import drop_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the lexicon, learned from ``labels``, judges toxic.

    Every row is judged by its own text: rows that repeat a doc_id, or have none, are judged each, and
    repeated rows alike.  Documents without text have no hits and stay; so does every document if no label can be learned from.
    An empty table gives no rows, and columns beside those of ``documents`` are left out.
    """
    return drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of similar documents: that with the smallest doc_id.

    Every row is judged by its own text.  Rows that repeat a doc_id, or have none, get a number of their
    own for the comparison: those that are copies or near copies of others go, unlike texts stay.  Of rows with
    equal doc_id in a component the smallest by a hash of the other columns stays; a doc_id goes before none.  Documents
    without words have no copies and stay.  An empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    repeated = stage(docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 OR doc_id IS NULL").select("doc_id"), "pipeline-repeated")
    if repeated.isEmpty():
        numbered = docs.withColumn("row", F.col("doc_id"))
        gone = ngram_join(numbered).where("doc_id <> component_id").select(F.col("doc_id").alias("row"))
        return numbered.join(gone, "row", "left_anti").select(*COLUMNS)
    least = F.lit(min(docs.agg(F.min("doc_id")).first()[0] or 0, 0) - 1)
    marks = repeated.select(F.col("doc_id").alias("again"), F.lit(True).alias("marked"))
    marked = docs.join(marks, docs["doc_id"].eqNullSafe(marks["again"]), "left").drop("again")
    numbered = marked.withColumn("row", F.when(F.col("marked"), least - F.monotonically_increasing_id()).otherwise(F.col("doc_id"))).drop("marked")
    numbered = stage(numbered, "pipeline-numbered")
    found = ngram_join(numbered.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*COLUMNS[1:]).alias("content"), "row")
    first = numbered.join(found, "row").groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    return numbered.join(first, "row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of ``benchmark``, up to the edits that ``find_benchmark`` allows.

    Every row is judged by its own text, whatever its doc_id; documents without text stay, and all do if no item
    has words enough to be looked for.  An empty table gives no rows, and columns beside those of ``documents`` are left out.
    """
    found = find_benchmark(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), COLUMNS)
    return found.where(F.size("matches") == 0).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample the documents to the target shares of the tokens; the kept rows with their tokens, topic, weight and probability.

    Rows are drawn by their doc_id and text, so equal rows stay or go together and rows without a
    doc_id are drawn by their texts.  Sources and languages that no target names, null ones too, count as ``other``.  An empty table gives no
    rows, and columns beside those of ``documents`` are left out.
    """
    return mix_sources(docs.select(*COLUMNS), TARGETS).where("kept").drop("kept")


STAGES = [
    ("toxicity", toxicity),
    ("ngram_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The first stage scores with a learned lexicon, which SQL cannot express; tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
