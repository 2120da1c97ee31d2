from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from ebbline.llm.catalog import ORACLES, QUERIES
from ebbline.llm.toxicity import held_out, toxicity
from tests.conftest import SMALL
from tests.llm.test_ngram_join import brute
from tools.check_queries import differences

NUMBERS = {f"op{n}" for n in range(1, 14)}


def test_every_operator_is_registered_once():
    assert {name.split("_")[0] for name in QUERIES} == NUMBERS and len(QUERIES) == 13
    assert QUERIES.keys() | {"pipeline"} <= queries().keys() and ORACLES.keys() <= oracle_sql().keys()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "mixing"]


@pytest.mark.parametrize("name", ORACLES)
def test_sql_twin(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    verdict = differences(QUERIES[name](spark, SMALL).toPandas(), db.execute(ORACLES[name]).df())
    assert verdict is None or verdict.startswith("ok")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage."""
    docs, found = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/stage-{name}"
        function(spark, docs, SMALL).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs)
    return found


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_what_brute_force_keeps(spark, stages):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    assert all(s.columns == columns for s in stages[:-1])
    before, clean, single, pure, mixed = (rows_of(d) for d in (docs, *stages))
    judged = {r["doc_id"]: r["predicted"] for r in toxicity(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    assert clean.keys() == {i for i in before if not judged[i]}
    components = brute([(i, r["text"]) for i, r in clean.items()])
    assert single.keys() == {i for i in clean if components[i] == i}
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaking = {i for i, r in single.items() if any(t in r["text"] for t in items)}
    assert leaking and not leaking & pure.keys() and len(single) - len(pure) <= len(leaking) + 0.02 * len(single)
    assert mixed.keys() <= pure.keys() and 0.4 < sum(r["n_tokens"] for r in mixed.values()) / sum(len(r["text"].split()) for r in pure.values()) < 0.8
    assert {i: r["text"] for i, r in mixed.items()} == {i: before[i]["text"] for i in mixed}


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    labels = rows_of(spark.read.parquet(f"{SMALL}/labels.parquet").where(held_out()))
    kept = rows_of(stages[0])
    assert sum(r["toxic"] == 0 and i in kept for i, r in labels.items()) >= 0.97 * sum(r["toxic"] == 0 for r in labels.values())


def test_edges_of_the_input(spark, documents, empty):
    copies = "a b c d e f"
    docs = documents([
        (1, None), (2, ""), (None, copies), (None, copies), (3, copies), (3, copies), (4, copies), (None, "no id but a text of its own"), (None, None),
        (7, "two texts of one id that"), (7, "have nothing at all in common"), (5, "have nothing at all in common"), (8, "k l m n o p q"), (8, "r s t u v w x"), (8, "k l m n o p q"),
    ])
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([
        (1, None), (2, ""), (3, copies), (None, "no id but a text of its own"), (None, None),
        (7, "two texts of one id that"), (5, "have nothing at all in common"), (8, "k l m n o p q"), (8, "r s t u v w x"),
    ], key=repr)
    none = empty("doc_id long, text string, lang string, source string, n_chars long")
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, none, SMALL).collect() == []
        assert function(spark, docs, SMALL).count() <= docs.count()
