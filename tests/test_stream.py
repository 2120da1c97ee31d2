import pytest
from pyspark.sql import functions as F

from ebbline.operators.shape import rename_snake
from ebbline.sources import synth
from ebbline.streaming.scoring import score_stream

REQUIRED = ["tenure", "monthly_charges", "contract"]


def scorer(records):
    return records.withColumn("probability", F.col("tenure") / 72)


def run(spark, source, schema, root, **options):
    query = score_stream(spark, source, schema, scorer, "xgboost", f"{root}/out", f"{root}/progress", required=REQUIRED, **options)
    query.awaitTermination()


@pytest.fixture
def records(spark):
    df = rename_snake(synth.gen_customers(spark, 400))
    return df.withColumn("monthly_charges", F.when(F.crc32("customer_id") % 10 != 0, F.col("monthly_charges")))


def test_stream_equals_batch_and_goes_on_after_a_restart(spark, records, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path)
    first, second = records.where("tenure < 40"), records.where("tenure >= 40")
    first.repartition(3).write.parquet(source)
    run(spark, source, records.schema, root, files_per_batch=1)
    out = spark.read.parquet(f"{root}/out/predictions")
    assert out.count() == first.where("monthly_charges is not null").count()
    assert out.select("batch_id").distinct().count() == 3

    second.write.mode("append").parquet(source)
    run(spark, source, records.schema, root)
    run(spark, source, records.schema, root)  # nothing new: nothing added
    columns = ["customer_id", "probability", "prediction", "risk_level"]
    out = spark.read.parquet(f"{root}/out/predictions")
    wanted = scorer(records.where("monthly_charges is not null"))
    assert sorted((r[0], r[1]) for r in out.select(*columns).collect()) == sorted(
        (r[0], r[1]) for r in wanted.select("customer_id", "probability").collect())
    broken = spark.read.parquet(f"{root}/out/quarantine")
    assert broken.count() == records.where("monthly_charges is null").count()
    assert {tuple(r["violations"]) for r in broken.collect()} == {("monthly_charges",)}


def test_repeated_requests_are_answered_once(spark, records, tmp_path):
    """Over two micro-batches, a restart and a repeated file; one that comes after the delay is a request of its own."""
    source, root = str(tmp_path / "in"), str(tmp_path)
    timed = records.where("monthly_charges is not null").withColumn("asked", F.timestamp_seconds(F.lit(1_700_000_000) + F.crc32("customer_id") % 3600))
    again = timed.where("tenure % 2 = 0").withColumn("asked", F.col("asked") + F.expr("INTERVAL 20 MINUTES"))
    options = {"files_per_batch": 1, "event_time": "asked", "delay": "2 hours"}
    timed.where("tenure < 40").coalesce(1).write.parquet(source)
    again.coalesce(1).write.mode("append").parquet(source)
    run(spark, source, timed.schema, root, **options)
    timed.coalesce(1).write.mode("append").parquet(source)
    run(spark, source, timed.schema, root, **options)
    out = [r[0] for r in spark.read.parquet(f"{root}/out/predictions").select("customer_id").collect()]
    assert sorted(out) == sorted(r[0] for r in timed.select("customer_id").collect())

    for k in range(2):  # other requests move the watermark on, after which the old keys are forgotten
        other = timed.limit(1).withColumns({"customer_id": F.lit(f"other {k}"), "asked": F.timestamp_seconds(F.lit(1_700_000_000 + 86_400 + k))})
        other.write.mode("append").parquet(source)
        run(spark, source, timed.schema, root, **options)
    again.withColumn("asked", F.col("asked") + F.expr("INTERVAL 2 DAYS")).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, timed.schema, root, **options)
    assert spark.read.parquet(f"{root}/out/predictions").count() == timed.count() + 2 + again.count()


def test_a_failed_step_leaves_nothing_behind(spark, records, tmp_path, monkeypatch):
    from ebbline.streaming import scoring

    kept = []
    monkeypatch.setattr(scoring, "scratch_path", lambda _, name: kept.append(str(tmp_path / name)) or kept[-1])
    records.write.parquet(str(tmp_path / "in"))

    def broken(frame):
        return frame.withColumn("probability", F.raise_error(F.lit("no model")).cast("double"))

    with pytest.raises(Exception, match="no model"):
        score_stream(spark, str(tmp_path / "in"), records.schema, broken, "xgboost", f"{tmp_path}/out", f"{tmp_path}/p", required=REQUIRED).awaitTermination()
    assert kept and not (tmp_path / "micro-batch").exists()
