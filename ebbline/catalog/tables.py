"""Sources, sinks, names, types and record rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ebbline.catalog.base import CAMEL, camel_list, customers, dirty_customers, profile, query, scores, using, wide
from ebbline.functions import roles
from ebbline.functions.scalar import request_id, risk_tier
from ebbline.operators import shape
from ebbline.plans.store import load_store, register_store
from ebbline.session import scratch_path
from ebbline.sources import orders_profile, readers, writers
from ebbline.streaming.scoring import score_stream

# ── readers and writers ─────────────────────────────────────────────────────

_AS_READ = camel_list(customer_id="CAST(customer_id AS VARCHAR)")
_ALIASED = {"Tenure": "使用时长", "Contract": "合同类型", "MonthlyCharges": " 月费 ", "CustomerID": "customer_id", "Churn": "churn"}


#: Text with quotes, commas and line breaks, for one customer in three, and a number that is none for one in seven.
_NOTE = "CASE customer_id % 3 WHEN 1 THEN 'He said \"hi, there\" twice,' || chr(10) || 'then \"\"left ' || CAST(customer_id AS VARCHAR(20)) WHEN 2 THEN ' a,b ' END"
_NOTED = f'{_AS_READ}, {_NOTE} AS "TicketNote"'


_SPARK_NOTE = _NOTE.replace("VARCHAR(20)", "STRING")


def _noted(frame):
    return frame.withColumn("TicketNote", F.expr(_SPARK_NOTE.replace("customer_id", "CustomerID")))


def _csv_of_customers(spark, sf_dir) -> str:
    """The customers as CSV with some columns under other spellings, gaps and bad numbers spelled out, and notes in free text."""
    frame = _noted(dirty_customers(spark, sf_dir))
    bad = F.when(F.col("CustomerID") % 37 == 0, F.when(F.col("CustomerID") % 2 == 0, "12f").otherwise("N/A"))
    frame = frame.withColumn("MonthlyCharges", F.coalesce(F.col("MonthlyCharges").cast("string"), bad, F.lit("10.5d")))
    return writers.export_filtered(frame.withColumnsRenamed(_ALIASED), scratch_path(spark, "csv"))


@query("read_csv", using(f"SELECT {_NOTED} FROM dirty", "dirty"))
def read_csv(spark, sf_dir):
    return readers.read_csv(spark, _csv_of_customers(spark, sf_dir), drop_ids=False)


@query("ingest_uri", using(f'SELECT {camel_list(customer_id="")}, {_NOTE} AS "TicketNote" FROM dirty', "dirty"))
def ingest_uri(spark, sf_dir):
    return readers.ingest_uri(spark, _csv_of_customers(spark, sf_dir), scratch_path(spark, "raw"), "customers")


@query("read_zone", using(f"SELECT {camel_list()} FROM profile", "profile"))
def read_zone(spark, sf_dir):
    zone = scratch_path(spark, "zone")
    writers.write_zone(customers(spark, sf_dir), zone, "customers")
    return readers.read_zone(spark, zone, "customers")


@query("write_zone", using(f"SELECT {_NOTED} FROM profile", "profile"))
def write_zone(spark, sf_dir):
    zone = scratch_path(spark, "zone")
    writers.write_zone(_noted(customers(spark, sf_dir)), zone, "customers", format="csv")
    return readers.read_zone(spark, zone, "customers", format="csv")


@query("export_filtered", using(f"SELECT customer_id, contract, xgb_churn_prob, {_NOTE} AS note FROM wide WHERE contract = 'One year'", "wide"))
def export_filtered(spark, sf_dir):
    chosen = wide(spark, sf_dir).where("contract = 'One year'").select("customer_id", "contract", "xgb_churn_prob", F.expr(_SPARK_NOTE).alias("note"))
    path = writers.export_filtered(chosen, scratch_path(spark, "export"))
    return spark.read.schema(chosen.schema).options(**readers.CSV_DIALECT).option("header", True).csv(path)


def _scored(spark, sf_dir):
    return orders_profile.formula_scores_wide(profile(spark, sf_dir))


@query("sink_users", using("""
SELECT customer_id, industry, company_size, contract, tenure, monthly_charges, total_charges, support_tickets,
  last_login_days, feature_usage_count, partner, paperless_billing FROM profile""", "profile"))
def sink_users(spark, sf_dir):
    scored = shape.rename_camel(_scored(spark, sf_dir))
    path = scratch_path(spark, "users")
    writers.sink_users(scored.unionByName(scored.where("Contract = 'Two year'")), path)
    return spark.read.parquet(path)


@query("sink_predictions", using("SELECT customer_id, model_name, probability, prediction FROM scores", "scores"))
def sink_predictions(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    writers.sink_predictions(_scored(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("append_predictions", using("""
SELECT CAST(customer_id AS VARCHAR) AS customer_id, model_name, probability, prediction FROM scores
UNION ALL SELECT 'api-' || SUBSTR(SHA256(CAST(customer_id AS VARCHAR)), 1, 8), model_name, probability, prediction
FROM scores WHERE model_name = 'xgboost' AND probability > 0.5""", "scores"))
def append_predictions(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    base = scores(spark, sf_dir)
    writers.append_predictions(base, path)
    online = base.where("model_name = 'xgboost' and probability > 0.5")
    writers.append_predictions(online.withColumn("customer_id", request_id(F.col("customer_id"))), path)
    return spark.read.schema(roles.PREDICTIONS_SCHEMA).parquet(path)


@query("create_tables", using("""
SELECT CAST(customer_id AS VARCHAR) AS customer_id, tenure, contract, gender FROM (
  SELECT customer_id, tenure, contract, CAST(NULL AS VARCHAR) AS gender FROM profile)""", "profile"))
def create_tables(spark, sf_dir):
    users, _ = writers.create_tables(spark, drop_first=True, location=scratch_path(spark, "store"), database="ebbline_created")
    have = profile(spark, sf_dir)
    row = [
        (F.col(f.name) if f.name in have.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in roles.USERS_SCHEMA
    ]
    have.select(*row).write.insertInto(users)
    return spark.table(users).select("customer_id", "tenure", "contract", "gender")


@query("read_sql", using(
    "SELECT customer_id, probability FROM scores WHERE model_name = 'random_forest' AND probability > 0.45", "scores"))
def read_sql(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    writers.sink_predictions(_scored(spark, sf_dir), path)
    return readers.read_sql(
        spark, f"SELECT customer_id, probability FROM parquet.`{path}` WHERE model_name = :model AND probability > :above",
        model="random_forest", above=0.45,
    )


@query("etl", using("""
SELECT u.customer_id, u.tenure, u.monthly_charges, u.contract, u.last_login_days, p.model_name,
  p.probability AS churn_probability
FROM profile u JOIN scores p ON u.customer_id = p.customer_id WHERE p.model_name = 'xgboost' AND p.probability > 0.5
ORDER BY p.probability DESC, u.customer_id LIMIT 10""", "scores"))
def etl(spark, sf_dir):
    return load_store(spark, _scored(spark, sf_dir), scratch_path(spark, "store"))["high_risk"]


@query("register_store", using("""
SELECT model_name, COUNT(*) AS n, COUNT(DISTINCT u.contract) AS contracts
FROM scores p JOIN profile u ON p.customer_id = u.customer_id GROUP BY model_name""", "scores"))
def register(spark, sf_dir):
    location = scratch_path(spark, "store")
    strings = _scored(spark, sf_dir).withColumn("customer_id", F.col("customer_id").cast("string"))
    load_store(spark, strings, location)
    database = f"ebbline_{uuid.uuid4().hex[:12]}"  # of this query alone
    register_store(spark, location, database)
    return readers.read_sql(
        spark,
        "SELECT model_name, count(*) AS n, count(DISTINCT u.contract) AS contracts "
        f"FROM {database}.predictions p JOIN {database}.users u ON p.customer_id = u.customer_id GROUP BY model_name",
    )


# ── names and types ─────────────────────────────────────────────────────────


@query("normalize_columns", using(f"SELECT {camel_list()} FROM profile", "profile"))
def normalize_columns(spark, sf_dir):
    return shape.normalize_columns(customers(spark, sf_dir).withColumnsRenamed(_ALIASED))


@query("drop_id", using(f'SELECT {camel_list(customer_id="")} FROM profile', "profile"))
def drop_id(spark, sf_dir):
    return shape.drop_id(customers(spark, sf_dir))


@query("rename_snake", using("SELECT * FROM profile", "profile"))
def rename_snake(spark, sf_dir):
    return shape.rename_snake(customers(spark, sf_dir))


@query("select_available", using("SELECT customer_id, tenure, contract FROM profile", "profile"))
def select_available(spark, sf_dir):
    return shape.select_available(profile(spark, sf_dir), ["customer_id", "no_such", "tenure", "contract"])


@query("preview", using("SELECT * FROM profile ORDER BY customer_id LIMIT 5", "profile"))
def preview(spark, sf_dir):
    return shape.preview(profile(spark, sf_dir), order_by="customer_id")


@query("cast_types", using("""
SELECT customer_id AS "CustomerID",
  CASE WHEN customer_id % 7 = 0 THEN 0 ELSE tenure END AS "Tenure",
  CASE WHEN customer_id % 11 = 0 THEN NULL ELSE monthly_charges END AS "MonthlyCharges",
  CAST(TRUNC(support_tickets + 0.75) AS INTEGER) AS "SupportTickets", contract AS "Contract" FROM profile""", "profile"))
def cast_types(spark, sf_dir):
    key = F.col("CustomerID")
    messy = customers(spark, sf_dir).select(
        "CustomerID",
        F.when(key % 7 == 0, "unknown").otherwise(F.col("Tenure").cast("string")).alias("Tenure"),
        F.when(key % 11 == 0, "12f").otherwise(F.format_string(" %.2f", "MonthlyCharges")).alias("MonthlyCharges"),
        (F.col("SupportTickets") + 0.75).alias("SupportTickets"), "Contract",
    )
    return shape.cast_types(messy)


def _narrow_sql() -> str:
    parts = []
    kinds = {"customer_id": "bigint", "monthly_charges": "double", "total_charges": "double"}
    kinds |= {c: "int" for c in ("tenure", "support_tickets", "last_login_days", "feature_usage_count")}
    for low, name in CAMEL.items():
        kind = kinds.get(low, "string")
        if kind == "string":
            proposed, dictionary = "'string'", f"COUNT(DISTINCT {low}) / COUNT(*) < 0.5"
        elif kind == "double":
            proposed = f"CASE WHEN MAX(ABS({low} - CAST(CAST({low} AS FLOAT) AS DOUBLE))) <= 0.0005 THEN 'float' ELSE 'double' END"
            dictionary = "FALSE"
        else:
            def fits(bits: int) -> str:
                return f"MIN({low}) >= {-(1 << bits)} AND MAX({low}) < {1 << bits}"

            proposed = (
                f"CASE WHEN {fits(7)} THEN 'tinyint' WHEN {fits(15)} THEN 'smallint' WHEN {fits(31)} THEN 'int' ELSE 'bigint' END"
            )
            dictionary = "FALSE"
        parts.append(
            f"SELECT '{name}' AS \"column\", '{kind}' AS type, {proposed} AS proposed, {dictionary} AS dictionary FROM profile"
        )
    return " UNION ALL ".join(parts)


@query("narrow_types", using(_narrow_sql(), "profile"))
def narrow_types(spark, sf_dir):
    return shape.narrow_report(customers(spark, sf_dir))


@query("narrow_types_cast", using("""
SELECT customer_id AS "CustomerID", tenure AS "Tenure", CAST(monthly_charges AS FLOAT) AS "MonthlyCharges",
  contract AS "Contract" FROM profile""", "profile"))
def narrow_types_cast(spark, sf_dir):
    frame = customers(spark, sf_dir).select("CustomerID", "Tenure", "MonthlyCharges", "Contract")
    narrow = shape.narrow_types(frame)
    # Back to common widths, so that only values are compared.
    return narrow.withColumns({"CustomerID": F.col("CustomerID").cast("bigint"), "Tenure": F.col("Tenure").cast("int")})


@query("encode_binary", using("""
SELECT customer_id AS "CustomerID", CAST(partner = 'Yes' AS INTEGER) AS "Partner",
  CAST(paperless_billing = 'Yes' AS INTEGER) AS "PaperlessBilling" FROM profile""", "profile"))
def encode_binary(spark, sf_dir):
    return shape.encode_binary(customers(spark, sf_dir)).select("CustomerID", "Partner", "PaperlessBilling")


@query("encode_target", using("""
SELECT customer_id AS "CustomerID", CAST(churn = 'Yes' AS INTEGER) AS label FROM profile""", "profile"))
def encode_target(spark, sf_dir):
    return shape.encode_target(customers(spark, sf_dir)).select("CustomerID", "label")


_REQUIRED = ["tenure", "monthly_charges", "total_charges", "support_tickets", "company_size", "contract", "partner"]


@query("validate_records", using("""
SELECT customer_id, CONCAT_WS(',',
  CASE WHEN tenure IS NULL OR tenure < 0 OR tenure > 100 THEN 'tenure' END,
  CASE WHEN monthly_charges IS NULL OR monthly_charges <= 0 THEN 'monthly_charges' END,
  CASE WHEN total_charges IS NULL OR total_charges < 0 THEN 'total_charges' END,
  CASE WHEN support_tickets IS NULL OR support_tickets < 0 THEN 'support_tickets' END,
  CASE WHEN company_size IS NULL THEN 'company_size' END) AS violations
FROM (SELECT * REPLACE (CASE WHEN customer_id % 13 = 0 THEN tenure + 100 ELSE tenure END AS tenure,
  CASE WHEN customer_id % 19 = 0 THEN 0.0 ELSE monthly_charges END AS monthly_charges) FROM dirty)""", "dirty"))
def validate_records(spark, sf_dir):
    key = F.col("customer_id")
    records = shape.rename_snake(dirty_customers(spark, sf_dir)).withColumns({
        "tenure": F.when(key % 13 == 0, F.col("tenure") + 100).otherwise(F.col("tenure")),
        "monthly_charges": F.when(key % 19 == 0, F.lit(0.0)).otherwise(F.col("monthly_charges")),
    })
    checked = shape.validate_records(records, _REQUIRED)
    return checked.select("customer_id", F.array_join("violations", ",").alias("violations"))


# ── scalars ─────────────────────────────────────────────────────────────────


@query("risk_tier", using("""
SELECT customer_id, model_name, CASE WHEN probability < 0.25 THEN 'Low' WHEN probability < 0.5 THEN 'Medium'
  WHEN probability < 0.75 THEN 'High' ELSE 'Critical' END AS risk_level FROM scores""", "scores"))
def tiers(spark, sf_dir):
    return scores(spark, sf_dir).select("customer_id", "model_name", risk_tier(F.col("probability")).alias("risk_level"))


@query("request_id", using("""
SELECT customer_id, 'api-' || SUBSTR(SHA256(CAST(customer_id AS VARCHAR) || '|' || contract), 1, 8) AS request FROM profile
""", "profile"))
def request_ids(spark, sf_dir):
    return profile(spark, sf_dir).select("customer_id", request_id(F.col("customer_id"), F.col("contract")).alias("request"))


@query("rounding", using("""
SELECT customer_id, ROUND(monthly_charges * 1.1, 1) AS one, ROUND(monthly_charges / 7, 2) AS two,
  ROUND(monthly_charges / 7, 4) AS four, ROUND(monthly_charges / 7, 6) AS six FROM profile""", "profile"))
def rounding(spark, sf_dir):
    value = F.col("monthly_charges")
    return profile(spark, sf_dir).select(
        "customer_id", F.round(value * 1.1, 1).alias("one"), F.round(value / 7, 2).alias("two"),
        F.round(value / 7, 4).alias("four"), F.round(value / 7, 6).alias("six"),
    )


# ── stream ──────────────────────────────────────────────────────────────────


_STREAMED = "customer_id string, probability double, prediction int, risk_level string, model_name string, batch_id bigint"


def _formula_scorer(records):
    return records.withColumn("probability", orders_profile.formula_probability(orders_profile.SCORE_INTERCEPTS["xgboost"]))


@query("score_stream", using("""
SELECT s.customer_id, 'xgboost' AS model_name, s.probability, s.prediction,
  CASE WHEN probability < 0.25 THEN 'Low' WHEN probability < 0.5 THEN 'Medium' WHEN probability < 0.75 THEN 'High'
  ELSE 'Critical' END AS risk_level
FROM scores s JOIN profile p ON s.customer_id = p.customer_id
WHERE s.model_name = 'xgboost' AND p.monthly_charges > 0 AND p.customer_id % 37 <> 0""", "scores"))
def stream(spark, sf_dir):
    gaps = profile(spark, sf_dir).withColumn(
        "monthly_charges", F.when(F.col("customer_id") % 37 != 0, F.col("monthly_charges"))
    )
    arriving = scratch_path(spark, "arriving")
    gaps.repartition(4, "customer_id").write.parquet(arriving)
    output = scratch_path(spark, "scored")
    score_stream(
        spark, arriving, gaps.schema, _formula_scorer, "xgboost", output, scratch_path(spark, "progress"),
        required=_REQUIRED, files_per_batch=2,
    ).awaitTermination()
    found = spark.read.schema(_STREAMED).parquet(f"{output}/predictions").drop("batch_id")
    return found.withColumn("customer_id", F.col("customer_id").cast("bigint"))


@query("score_stream_once", using("""
SELECT s.customer_id, 'xgboost' AS model_name, s.probability, s.prediction, 1 AS answers
FROM scores s JOIN profile p ON s.customer_id = p.customer_id WHERE s.model_name = 'xgboost' AND p.monthly_charges > 0""", "scores"))
def stream_once(spark, sf_dir):
    """Requests of which a third come again, in another micro-batch or after a restart, are answered once."""
    asked = profile(spark, sf_dir).withColumn("asked", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("customer_id") % 3600))
    again = asked.where("customer_id % 3 = 0").withColumn("asked", F.col("asked") + F.expr("INTERVAL 5 MINUTES"))
    arriving, output, progress = (scratch_path(spark, name) for name in ("arriving", "scored", "progress"))

    def run():
        score_stream(
            spark, arriving, asked.schema, _formula_scorer, "xgboost", output, progress, required=_REQUIRED, files_per_batch=1, event_time="asked", delay="1 day",
        ).awaitTermination()

    asked.where("customer_id % 2 = 0").unionByName(again).repartition(2).write.parquet(arriving)
    run()
    asked.repartition(2).write.mode("append").parquet(arriving)
    run()
    found = spark.read.schema(_STREAMED).parquet(f"{output}/predictions")
    counted = found.groupBy("customer_id", "model_name", "probability", "prediction").agg(F.count("*").alias("answers"))
    return counted.withColumn("customer_id", F.col("customer_id").cast("bigint"))
