import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ebbline.functions import lexicon, roles
from ebbline.operators import phrases, scores, text
from ebbline.plans import store
from ebbline.plans.cleaning import run_cleaning
from ebbline.plans.store import current_store, load_store, register_store
from ebbline.sources import readers, synth, writers


@pytest.mark.parametrize("sentence,check", [
    ("", lambda s: s == 0), (None, lambda s: s == 0), ("nothing of note", lambda s: s == 0),
    ("This is terrible", lambda s: s == -1.0), ("Great!", lambda s: s == 0.8),
    ("not good", lambda s: s == pytest.approx(-0.35)), ("very good", lambda s: s == pytest.approx(0.91)),
    ("not very good", lambda s: s == pytest.approx(-0.455)), ("good, bad", lambda s: s == pytest.approx(0.0)),
    ("VERY EXCELLENT", lambda s: s == 1.0), ("good", lambda s: s == 0.7),
])
def test_sentiment(spark, sentence, check):
    df = spark.createDataFrame([(sentence,)], "ticket_text string")
    assert check(text.text_sentiment(df).first()["ticket_sentiment"])


def test_long_texts_count_whole(spark):
    df = spark.createDataFrame([("word " * 30_000 + "great",)], "ticket_text string")
    assert text.text_sentiment(df).first()["ticket_sentiment"] == 0.8


def test_sentiment_needs_no_shuffle(spark):
    df = text.text_sentiment(spark.createDataFrame([("great",)], "ticket_text string"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_generated_customers(spark):
    df = synth.gen_customers(spark, 20_000)
    assert df.schema.names == [name for name, _ in roles.CUSTOMER_COLUMNS]
    assert df.dtypes == [(f.name, f.dataType.simpleString()) for f in roles.CUSTOMER_SCHEMA]
    row = df.agg(
        F.avg((F.col("Churn") == "Yes").cast("int")).alias("churn"), F.avg("SupportTickets").alias("tickets"),
        F.avg("FeatureUsageCount").alias("usage"), F.avg("LastLoginDays").alias("login"), F.max("LastLoginDays").alias("login_max"),
        F.max("Tenure").alias("tenure_max"), F.min("MonthlyCharges").alias("low"), F.max("MonthlyCharges").alias("high"),
        F.avg((F.col("Contract") == "One year").cast("int")).alias("one_year"), F.countDistinct("CustomerID").alias("ids"),
        F.count_if((F.col("PhoneService") == "No") != (F.col("MultipleLines") == "No phone service")).alias("odd"),
    ).first()
    assert 0.24 < row["churn"] < 0.31 and 1.1 < row["tickets"] < 1.3 and 6.4 < row["usage"] < 6.8
    assert 6.8 < row["login"] < 8.0 and row["login_max"] <= 60 and row["tenure_max"] == 72
    assert row["low"] >= 18.25 and row["high"] <= 118.75 and 0.22 < row["one_year"] < 0.26 and row["ids"] == 20_000
    assert 0 < row["odd"] < 2500  # a tenth of the customers with a phone draw "No phone service" too


def test_generation_does_not_hang_on_partitions(spark):
    keys = spark.range(500)
    parts = [
        sorted(tuple(r) for r in synth.gen_ticket_text(synth.draw_customers(keys.repartition(n), "id")).collect()) for n in (1, 9)
    ]
    assert parts[0] == parts[1]


def test_customers_of_one_file_are_made_by_all_cores(spark, tmp_path):
    from ebbline.catalog.texts import made_customers

    spark.range(500).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = made_customers(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and made.select("CustomerID").distinct().count() == 500


def test_texts_of_churned_customers_are_negative(spark):
    df = text.text_sentiment(synth.gen_ticket_text(synth.gen_customers(spark, 3000)))
    row = text.sentiment_summary(df).first()
    assert row["churned_mean"] < -0.1 and row["retained_mean"] > row["churned_mean"] + 0.1
    assert row["negative_pct"] + row["neutral_pct"] + row["positive_pct"] == pytest.approx(100)
    assert df.where("ticket_text like '%{%'").count() == 0
    assert df.agg(F.min("ticket_sentiment") >= -1, F.max("ticket_sentiment") <= 1).first()[:] == (True, True)


@pytest.mark.parametrize("most", [16 << 20, 0])
def test_lexicon_as_a_table(spark, monkeypatch, most):
    """Entries of several words, of which the longest counts, and a table that is too large to send to every task."""
    monkeypatch.setattr(text, "BROADCAST_BYTES", most)
    entries = spark.createDataFrame(
        [("good", 0.8), ("Not  Good", -0.2), ("good old days", 0.5), ("days", 0.1), ("old", -0.1), ("bad", -0.6), ("bad", -0.4), ("?!", 1.0)], "entry string, weight double")
    texts = {
        "good": 0.8, "not good": -0.2, "very good": 1.0, "not very good": -0.52, "good old days": 0.5, "the good old man": (0.8 - 0.1) / 2,
        "never bad": 0.2, "": 0.0, None: 0.0, "old days": 0.0, "GOOD, days": (0.8 + 0.1) / 2, "nothing": 0.0,
    }
    df = spark.createDataFrame([(t, "x") for t in [*texts, "good"]], "ticket_text string, weight string")
    got = text.text_sentiment_by_table(df, entries, output="score").collect()
    assert len(got) == len(texts) + 1 and all(r["weight"] == "x" for r in got)
    assert {r["ticket_text"]: round(r["score"], 9) for r in got} == {t: pytest.approx(v) for t, v in texts.items()}
    plain = spark.createDataFrame(list(lexicon.POLARITY.items()), "entry string, weight double")
    df = synth.gen_ticket_text(synth.gen_customers(spark, 200))
    both = text.text_sentiment_by_table(text.text_sentiment(df, output="a"), plain, output="b").select("a", "b").collect()
    assert all(r["a"] == pytest.approx(r["b"]) for r in both)


# ── files ───────────────────────────────────────────────────────────────────


def test_a_lexicon_table_does_not_copy_a_text_for_each_of_its_words(spark):
    df = spark.createDataFrame([(1, "very good day " * 400), (2, ""), (3, None)], "id int, ticket_text string")
    entries = spark.createDataFrame([("good day", 0.5), ("good", 0.1)], "entry string, weight double")
    scored = text.text_sentiment_by_table(df, entries, output="score")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate " in line]
    assert len(made) == 1 and "slice(" not in plan  # a slice unpacks all words, and a second explode carries them along
    assert {r["id"]: round(r["score"], 9) for r in scored.collect()} == {1: 0.65, 2: 0.0, 3: 0.0}


@pytest.mark.parametrize("words", [7, 1 << 20])
def test_a_large_lexicon_is_looked_up_by_blocks(spark, monkeypatch, words):
    """Equal to counting by hand whatever the blocks and buckets; no row for each word is shuffled."""
    monkeypatch.setattr(text, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(phrases, "BLOCK_WORDS", words)
    monkeypatch.setattr(phrases, "TABLE_BYTES", 100)
    rng = random.Random(words)
    known = {" ".join(rng.choices("abcdefgh", k=n)): rng.choice([-0.9, -0.3, 0.2, 0.7, 1.5, None, float("nan")]) for n in (1, 1, 1, 2, 2, 2, 2, 3, 3, 5)}
    texts = [" ".join(rng.choices("abcdefgh", k=k % 17)) for k in range(120)] + [None, "", "...", "éé a"]

    def score(line):
        held, scores, covered = (line or "").split(), [], 0
        for at in range(len(held)):
            for n in (5, 3, 2, 1):
                entry = " ".join(held[at:at + n])
                if at + n <= len(held) and entry in known and covered < at + n:
                    before, second = (held[at - k] if at >= k else "" for k in (1, 2))
                    factor = {"c": 1.4}.get(before, 1.0) * (-0.5 if before == "d" or before == "c" and second == "d" else 1.0)
                    weight = known[entry]
                    scores.append(1.0 if weight is None or weight != weight else max(-1.0, min(1.0, weight * factor)))
                    covered = at + n
        return sum(scores) / len(scores) if scores else 0.0

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, ticket_text string").repartition(2)
    entries = spark.createDataFrame(list(known.items()), "entry string, weight double")
    scored = text.text_sentiment_by_table(df, entries, output="score", intensifiers={"c": 1.4}, negators=["d"])
    assert {r["id"]: r["score"] for r in scored.collect()} == {i: pytest.approx(score(t)) for i, t in enumerate(texts)}
    assert "Generate" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_of_equal_hashes_are_told_apart(monkeypatch):
    hashes = phrases._Runs.hashes
    monkeypatch.setattr(phrases._Runs, "hashes", lambda self, begins, sizes: hashes(self, begins, sizes) % np.uint64(2))
    texts = ["a b c d", "b a", "d c b a"]
    words = pa.array([w for t in texts for w in t.split()]).dictionary_encode()
    sizes = np.array([len(t.split()) for t in texts])
    block = phrases._Block(*(phrases._pressed(x.astype(kind).tobytes()) for x, kind in ((np.arange(3), np.int64), (sizes, np.int64))),
                           phrases._joined(words.dictionary), phrases._pressed(words.indices.to_numpy().astype(np.int32).tobytes()))
    entries = ["a", "a b", "b a", "c d", "d b", "x a", "d c b", "c b a"]
    begin, end, weight = phrases._hits(block, pa.array(entries), np.arange(8.0))
    assert [*zip(begin.tolist(), end.tolist(), weight.tolist(), strict=True)] == [(0, 2, 1.0), (2, 4, 3.0), (4, 6, 2.0), (6, 9, 6.0), (7, 10, 7.0)]


def test_shuffles_of_a_staged_frame_are_deleted(spark):
    def shuffles():
        return spark._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()

    before = shuffles()
    kept = phrases.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    assert shuffles() <= before and kept.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_csv_spellings(spark, tmp_path, rows):
    path = tmp_path / "in.csv"
    path.write_text(
        "客户ID, 使用时长 ,月费,合同类型,churn,extra_col\n1,12,70.5,NA,Yes,x\n2,abc,NaN,One year,,null\n3,7.0,1e1,\"a,b\",No,\n",
        encoding="utf-8",
    )
    df = readers.read_csv(spark, str(path), drop_ids=False, keep_corrupt=True)
    assert rows(df.orderBy("CustomerID")) == [
        {"CustomerID": "1", "Tenure": 12, "MonthlyCharges": 70.5, "Contract": None, "Churn": "Yes", "extra_col": "x", "_corrupt_record": False},
        {"CustomerID": "2", "Tenure": None, "MonthlyCharges": None, "Contract": "One year", "Churn": None, "extra_col": None, "_corrupt_record": True},
        {"CustomerID": "3", "Tenure": 7, "MonthlyCharges": 10.0, "Contract": "a,b", "Churn": "No", "extra_col": None, "_corrupt_record": False},
    ]
    assert readers.read_csv(spark, str(path)).columns == ["Tenure", "MonthlyCharges", "Contract", "Churn", "extra_col"]


def quoted(value):
    return value if not set(value) & set('",\n\r') else '"' + value.replace('"', '""') + '"'


@pytest.mark.parametrize("size", [200, 1000])
def test_line_breaks_at_the_seams_of_blocks(spark, tmp_path, size):
    """Every block of some hundred bytes is a task's; fields hold line breaks, doubled quotes, header lines and blank lines."""
    rng = random.Random(size)
    marks = ["a", "é", ",", '"', "\n", "\n\n", " ", "x,y", '"quoted"', 'CustomerID,Contract,note\n', "\r\n"]
    rows = [(str(k), "".join(rng.choices(marks, k=rng.choice([0, 1, 1, 3, 8]))).strip(), rng.choice(["plain", 'in the 5" middle', "end"])) for k in range(600)]
    for number, part in enumerate((rows[:400], rows[400:])):
        lines = ["CustomerID,Contract,note", *(",".join([quoted(i), quoted(c), n]) for i, c, n in part)]
        (tmp_path / f"{number}.csv").write_bytes(("\n\n" if number else "\n").join(lines).encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = readers.read_csv(spark, str(tmp_path), drop_ids=False)
        got = sorted((int(r["CustomerID"]), r["Contract"], r["note"]) for r in df.collect())
        lines = readers._lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(int(i), c if c.strip() else None, n) for i, c, n in rows]


def test_lines_are_read_natively_where_no_field_goes_over_one(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'CustomerID,Contract\r\n1,"a,b"\r\n\r\n2,"say ""x"""\r\n')
    df = readers.read_csv(spark, str(tmp_path), drop_ids=False)
    assert sorted(map(tuple, df.collect())) == [("1", "a,b"), ("2", 'say "x"')]
    assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()


def test_files_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Tenure,Contract\n1,x\n")
    (tmp_path / "b.csv").write_text("Contract,Tenure\nx,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, str(tmp_path)).collect()
    (tmp_path / "c.csv").write_text('Contract,Tenure\n"x\ny",1\n')
    with pytest.raises(ValueError, match="header"):
        readers.read_csv(spark, str(tmp_path))


def test_missing_inputs_raise(spark, tmp_path):
    with pytest.raises(AnalysisException):
        readers.read_csv(spark, str(tmp_path / "no.csv"))
    with pytest.raises(AnalysisException):
        readers.read_zone(spark, str(tmp_path), "no")


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_zone_round_trip(spark, tmp_path, kind):
    df = synth.gen_customers(spark, 300)
    writers.write_zone(df, str(tmp_path), "customers", format=kind)
    back = readers.read_zone(spark, str(tmp_path), "customers", format=kind)
    assert back.dtypes == df.dtypes
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    landed = readers.ingest_uri(spark, f"file://{tmp_path}/customers", str(tmp_path / "raw"), "c") if kind == "csv" else None
    if landed is not None:
        assert landed.count() == 300 and "CustomerID" not in landed.columns


def test_cleaning_job(spark, tmp_path):
    writers.write_zone(synth.gen_customers(spark, 400), str(tmp_path / "raw"), "customers", format="csv")
    table, report = run_cleaning(spark, str(tmp_path / "raw"), str(tmp_path / "processed"), format="csv")
    assert report["rows_before"] == 400 and report["rows_after"] == table.count() and report["cols_after"] == 26
    assert len(report["steps"]) == 5


def scored(spark):
    return synth.gen_customers(spark, 50).selectExpr(
        "*", "Tenure / 100 as lr_probability", "0 as lr_prediction", "0.25D + Tenure / 100 as xgb_probability",
        "cast(Tenure > 25 as int) as xgb_prediction")


def test_store(spark, tmp_path):
    wide = scored(spark)
    reports = load_store(spark, wide.unionByName(wide), str(tmp_path))
    assert reports["users"].count() == 50 and reports["predictions"].count() == 200
    assert "churn" not in reports["users"].columns and "multiple_lines" not in reports["users"].columns
    assert {r["model_name"] for r in reports["model_stats"].collect()} == {"logistic_regression", "xgboost"}
    again = load_store(spark, wide, str(tmp_path))
    assert again["predictions"].count() == 100  # replaced, not added to
    for name in ("users", "predictions"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    register_store(spark, str(tmp_path))
    assert readers.read_sql(spark, "SELECT count(*) n FROM predictions WHERE model_name = :m", m="xgboost").first()["n"] == 50
    new = spark.createDataFrame([("api-1", "xgboost", 0.5, 1)], roles.PREDICTIONS_SCHEMA)
    current = current_store(spark, str(tmp_path))
    writers.append_predictions(new, f"{current}/predictions")
    assert spark.read.parquet(f"{current}/predictions").count() == 101
    load_store(spark, wide, str(tmp_path))
    assert len(list((tmp_path / "versions").iterdir())) == 2


def test_a_failed_run_leaves_the_old_pair(spark, tmp_path, monkeypatch):
    wide = scored(spark)
    load_store(spark, wide, str(tmp_path))
    before = current_store(spark, str(tmp_path))

    def broken(*_):
        raise OSError("disk full")

    monkeypatch.setattr(store, "sink_predictions", broken)
    with pytest.raises(OSError):
        load_store(spark, wide.limit(3), str(tmp_path))
    monkeypatch.undo()
    monkeypatch.setattr(store, "sink_users", lambda frame, path: frame.select(F.col("CustomerID").alias("customer_id")).write.parquet(path))
    with pytest.raises(ValueError, match="more than once"):
        load_store(spark, wide.unionByName(wide), str(tmp_path))
    monkeypatch.undo()
    assert current_store(spark, str(tmp_path)) == before
    assert spark.read.parquet(f"{before}/users").count() == 50 and spark.read.parquet(f"{before}/predictions").count() == 100
    twice = load_store(spark, wide.unionByName(wide.where("Tenure > 25")), str(tmp_path))["repeated_customers"]
    assert twice.count() == wide.where("Tenure > 25").count() and {r["n"] for r in twice.collect()} == {2}
    assert current_store(spark, str(tmp_path)) > before


def test_strict_joins_fan_out(spark):
    users = spark.createDataFrame([("a",), ("b",)], "customer_id string")
    rows = [("a", "xgboost", 0.1, 0), ("a", "xgboost", 0.2, 0), ("a", "random_forest", 0.3, 0), ("a", "random_forest", 0.4, 0), ("b", "logistic_regression", 0.5, 1)]
    predictions = spark.createDataFrame(rows, "customer_id string, model_name string, probability double, prediction int")
    strict = sorted((r["customer_id"], r["xgb_churn_prob"], r["rf_churn_prob"], r["lr_churn_prob"]) for r in scores.scores_wide(users, predictions, strict=True).collect())
    assert strict == [("a", 0.1, 0.3, None), ("a", 0.1, 0.4, None), ("a", 0.2, 0.3, None), ("a", 0.2, 0.4, None), ("b", None, None, 0.5)]
    assert scores.scores_wide(users, predictions).count() == 2


def test_tables_are_created_and_replaced(spark, tmp_path):
    assert writers.create_tables(spark, drop_first=True, location=str(tmp_path / "a")) == ["default.users", "default.predictions"]
    assert spark.table("users").count() == 0 and spark.table("users").schema.names == roles.USER_COLUMNS
    writers.sink_users(scored(spark), "users")
    assert spark.table("users").count() == 50
    writers.create_tables(spark, drop_first=True, location=str(tmp_path / "b"))
    assert spark.table("users").count() == 0
    assert spark.table("predictions").columns == ["customer_id", "probability", "prediction", "model_name"]


def test_bucketed_store_needs_no_shuffle(spark):
    from ebbline.operators.scores import scores_wide

    wide = scored(spark)
    for name in ("users", "predictions"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    writers.sink_users(wide, buckets=4)
    writers.sink_predictions(wide, buckets=4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = scores_wide(spark.table("users"), spark.table("predictions"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in ("users", "predictions"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    with pytest.raises(ValueError):
        writers.sink_users(wide, "/tmp/users", buckets=4)
