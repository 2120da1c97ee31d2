"""The registered queries of this package, each beside its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.llm import corpus, oracles
from ebbline.llm.chat import rotate_perspectives
from ebbline.llm.common import table
from ebbline.llm.decontaminate import find_benchmark
from ebbline.llm.fill_middle import fill_in_middle, restored
from ebbline.llm.html_extract import extract
from ebbline.llm.licenses import scan_licenses
from ebbline.llm.minhash_dedup import minhash_dedup
from ebbline.llm.mixing import mix_sources
from ebbline.llm.ngram_join import ngram_join
from ebbline.llm.prefix_trie import placed_turns, prefix_trie, share_heads
from ebbline.llm.token_counts import count_tokens
from ebbline.llm.topk import top_k
from ebbline.llm.toxicity import toxicity
from ebbline.llm.url_filter import url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@query("op1_license_scan", oracles.licenses())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


@query("op3_ngram_join", oracles.NGRAM_JOIN)
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


@query("op4_source_mixing")
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), corpus.TARGETS)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept")


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size("matches").cast("long").alias("n_items"), items.alias("item_ids"),
        F.array_min(F.transform("matches", lambda m: m["first_word"])).alias("first_word"),
        F.array_min(F.transform("matches", lambda m: m["edits"])).alias("least_edits"),
    )


@query("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).drop("n_blocks")


@query("op7_chat_perspectives", oracles.CHAT)
def op7_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = rotate_perspectives(table(spark, sf_dir, "conversations"))
    masked = F.transform("spans", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string")))
    return views.select("conv_id", "speaker", "part", "n_turns", "n_own", "rendered", F.array_join(masked, ",").alias("masked"))


@query("op8_top_k", oracles.TOP_K)
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "hits", "n_words")


@query("op10_url_filter")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), corpus.URL_RULES)


@query("op11_minhash_dedup", oracles.MINHASH_DEDUP)
def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"))


@query("op12_prefix_trie", oracles.PREFIX_TRIE)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, sizes = placed_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie(share_heads(placed, sizes), sizes)


@query("op13_fill_middle", oracles.FILL_MIDDLE)
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = (F.sha2(c, 256).alias(f"{name}_sha256") for name, c in (("output", F.col("output")), ("restored", restored(F.col("output"), F.col("form")))))
    return samples.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
