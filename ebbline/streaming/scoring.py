"""Scoring of arriving records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ebbline.operators.features import add_features
from ebbline.operators.models import add_probability, scored_response
from ebbline.operators.shape import rename_camel, validate_records
from ebbline.session import remove, scratch_path
from ebbline.sources.writers import append_predictions

Scorer = Callable[[DataFrame], DataFrame]


def model_scorer(features: PipelineModel, model) -> Scorer:
    """Adds ``probability`` to snake-case records."""

    def score(records: DataFrame) -> DataFrame:
        scored = add_probability(add_features(rename_camel(records), features), model, "probability")
        return scored.drop("features").withColumnRenamed("CustomerID", "customer_id")

    return score


def score_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    scorer: Scorer,
    model_name: str,
    output: str,
    checkpoint: str,
    *,
    required: list[str] | None = None,
    files_per_batch: int = 100,
    trigger: dict | None = None,
    event_time: str | None = None,
    request: Sequence[str] = ("customer_id",),
    delay: str = "10 minutes",
) -> StreamingQuery:
    """Score Parquet files as they arrive in ``source``.

    With an ``event_time`` column, requests that repeat the columns of ``request`` within ``delay`` of the first one are answered
    once, over micro-batches and restarts: the keys are state, kept until the watermark, which is ``delay`` behind
    the latest event, has passed them.  Requests that arrive even later than that are left out.

    Valid records go to the predictions table ``<output>/predictions`` with score, label and risk
    level, others to ``<output>/quarantine`` with the names of the broken rules.
    A micro-batch is read and checked once, into a staged table that both outputs read and
    that is removed afterwards; a repeated batch replaces its own rows.
    """
    root = output.rstrip("/")

    def handle(batch: DataFrame, batch_id: int) -> None:
        session, path = batch.sparkSession, scratch_path(spark, "micro-batch")
        try:
            validate_records(batch, required).write.parquet(path)
            checked = session.read.parquet(path)
            broken = F.size("violations") > 0
            response = scored_response(F.col("probability"))
            scored = scorer(checked.where(~broken).drop("violations")).select(
                "customer_id", F.lit(model_name).alias("model_name"), "probability",
                response["churn_prediction"].alias("prediction"), response["risk_level"].alias("risk_level"),
            )
            append_predictions(scored, f"{root}/predictions", more=["risk_level"], batch_id=batch_id)
            checked.where(broken).write.mode("overwrite").parquet(f"{root}/quarantine/batch_id={batch_id}")
        finally:
            remove(spark, path)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    if event_time:
        stream = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(request))
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
