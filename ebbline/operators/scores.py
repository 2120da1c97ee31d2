"""Score tables: long and wide form, ranked lists and KPIs of the store and the dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.functions import roles
from ebbline.functions.scalar import bin_index
from ebbline.operators.eda import bin_dimension_join
from ebbline.operators.filters import filter_contract, filter_risk

PROBABILITY_COLUMNS = {
    "xgboost": "xgb_churn_prob", "logistic_regression": "lr_churn_prob", "random_forest": "rf_churn_prob",
}


_STRICT = {"xgboost": ("xgb_churn_prob", "xgb_pred"), "logistic_regression": ("lr_churn_prob", None), "random_forest": ("rf_churn_prob", None)}


def scores_long(wide: DataFrame, key: str = "CustomerID") -> DataFrame:
    """One row per customer and model; models whose two columns are absent are skipped."""
    models = [
        (alias, name) for alias, name in roles.MODEL_NAMES.items()
        if {f"{alias}_probability", f"{alias}_prediction"} <= set(wide.columns)
    ]
    if not models:
        raise ValueError("no <model>_probability and <model>_prediction columns")
    per_model = F.array(*[
        F.struct(
            F.lit(name).alias("model_name"),
            F.col(f"{alias}_probability").cast("double").alias("probability"),
            F.col(f"{alias}_prediction").cast("int").alias("prediction"),
        )
        for alias, name in models
    ])
    return wide.select(F.col(key).alias("customer_id"), F.inline(per_model))


def pivot_scores(predictions: DataFrame) -> DataFrame:
    """One row per customer; of repeated scores of one model the highest score and label are kept.

    Maxima of plain numbers, so the rows are merged by a hash aggregate, without sorting.
    """
    def of(model: str, column: str):
        return F.max(F.when(F.col("model_name") == model, F.col(column)))

    return predictions.groupBy("customer_id").agg(
        of("xgboost", "probability").alias("xgb_churn_prob"),
        of("xgboost", "prediction").alias("xgb_pred"),
        of("logistic_regression", "probability").alias("lr_churn_prob"),
        of("random_forest", "probability").alias("rf_churn_prob"),
    )


def scores_wide(users: DataFrame, predictions: DataFrame, *, strict: bool = False) -> DataFrame:
    """Every user with the score of each model.

    Scores are brought to one row per customer first: one shuffle instead of
    three joins, and repeated scores cannot multiply.  ``strict`` joins the scores of each model as they are, so a user
    has a row for every combination of repeated scores; ``repeated_scores`` tells whether there are any.
    """
    if strict:
        out = users
        for model, (score, label) in _STRICT.items():
            own = predictions.where(F.col("model_name") == model)
            out = out.join(own.select("customer_id", F.col("probability").alias(score), *([F.col("prediction").alias(label)] if label else [])), "customer_id", "left")
        return out
    return users.join(pivot_scores(predictions), "customer_id", "left")


def repeated_scores(predictions: DataFrame) -> DataFrame:
    """Customers scored more than once by one model."""
    return (
        predictions.groupBy("customer_id", "model_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )


def attach_profile(scores: DataFrame, profile: DataFrame, columns: Sequence[str], key: str = "CustomerID") -> DataFrame:
    """Profile columns for scored rows; not needed where scoring carries the columns along."""
    return scores.join(profile.select(key, *[c for c in roles.present(list(columns), profile.columns) if c != key]), key, "left")


def high_risk_join(
    users: DataFrame, predictions: DataFrame, model: str = "xgboost", threshold: float = 0.5
) -> DataFrame:
    """Users that one model puts above the threshold; model and score are filtered before the join."""
    risky = filter_risk(predictions.where(F.col("model_name") == model), "probability", threshold, inclusive=False)
    return users.join(risky, "customer_id").select(
        "customer_id", "tenure", "monthly_charges", "contract", "last_login_days", "model_name", "probability"
    )


def high_risk_topk(
    users: DataFrame, predictions: DataFrame, top_n: int = 10, model: str = "xgboost", threshold: float = 0.5
) -> DataFrame:
    """The highest scores, equal ones by id."""
    return (
        high_risk_join(users, predictions, model, threshold)
        .orderBy(F.desc("probability"), "customer_id").limit(top_n)
        .withColumn("churn_probability", F.round("probability", 4)).drop("probability")
    )


def orphan_predictions(users: DataFrame, predictions: DataFrame) -> DataFrame:
    """Scores of customers the users table does not have, such as online requests."""
    return predictions.join(users.select("customer_id"), "customer_id", "left_anti")


def model_stats(predictions: DataFrame) -> DataFrame:
    """Per model: rows, predicted churn and its share, mean score (4 decimals)."""
    return predictions.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("prediction").alias("predicted_churn"),
        F.round(F.avg("probability"), 4).alias("avg_prob"),
        (F.sum("prediction") * 100 / F.count(F.lit(1))).alias("churn_pct"),
    )


def store_stats(users: DataFrame, predictions: DataFrame) -> DataFrame:
    """(name, value): number of users and of models."""
    return users.agg(F.count(F.lit(1)).alias("value")).select(F.lit("total_users").alias("name"), "value").union(
        predictions.agg(F.countDistinct("model_name").alias("value")).select(F.lit("total_models").alias("name"), "value")
    )


def kpi_overview(wide: DataFrame, model: str = "xgboost") -> DataFrame:
    """Total customers, predicted churn and its share, mean score, number of models."""
    return wide.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(F.col("xgb_pred") == 1).alias("predicted_churn"),
        (F.count_if(F.col("xgb_pred") == 1) / F.count(F.lit(1))).alias("predicted_share"),
        F.avg(PROBABILITY_COLUMNS[model]).alias("avg_probability"),
    ).withColumn("models_deployed", F.lit(len(PROBABILITY_COLUMNS)))


def kpi_filtered(
    wide: DataFrame, contract: str | None = None, threshold: float = 0.5, model: str = "xgboost"
) -> DataFrame:
    probability = F.col(PROBABILITY_COLUMNS[model])
    return filter_contract(wide, contract).agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(probability >= threshold).alias("high_risk"),
        F.avg(probability).alias("avg_probability"),
    )


def risk_profile(
    wide: DataFrame, contract: str | None = None, threshold: float = 0.5, model: str = "xgboost"
) -> DataFrame:
    """Averages over the customers at risk, their most frequent contract, the share of negative sentiment.

    Sums per contract first, then one row of them: the mode comes from the
    same pass as the averages.
    """
    risky = filter_risk(filter_contract(wide, contract), PROBABILITY_COLUMNS[model], threshold)
    averages = {
        "avg_tenure": "tenure", "avg_monthly": "monthly_charges",
        "avg_login_gap": "last_login_days", "avg_tickets": "support_tickets",
    }
    sentiment = "ticket_sentiment" in wide.columns
    partial = [F.count(F.lit(1)).alias("n")]
    for column in averages.values():
        partial += [F.sum(column).alias(f"s_{column}"), F.count(column).alias(f"n_{column}")]
    if sentiment:
        partial.append(F.count_if(F.col("ticket_sentiment") < 0).alias("negative"))
    total = [F.sum("n").alias("high_risk")]
    total += [
        (F.sum(f"s_{column}") / F.nullif(F.sum(f"n_{column}"), F.lit(0))).alias(name) for name, column in averages.items()
    ]
    known = F.when(F.col("contract").isNotNull(), F.struct((-F.col("n")).alias("neg"), F.col("contract")))
    total.append(F.min(known)["contract"].alias("top_contract"))
    if sentiment:
        total.append((F.sum("negative") / F.sum("n")).alias("negative_sentiment_share"))
    return risky.groupBy("contract").agg(*partial).agg(*total).fillna(0, subset=["high_risk"])


def prob_by_contract(wide: DataFrame, model: str = "xgboost") -> DataFrame:
    """Mean score per contract, and over all rows as the line without a contract; one grouped pass."""
    return (
        wide.rollup("contract")
        .agg(F.avg(PROBABILITY_COLUMNS[model]).alias("avg_probability"), (F.grouping("contract") == 1).alias("overall"))
        .where("overall or contract is not null")
    )


def prob_by_tenure(wide: DataFrame, model: str = "xgboost") -> DataFrame:
    """Mean score and rows per tenure bracket, brackets closed on the right (so tenure 0 is outside)."""
    grouped = (
        wide.withColumn("bin_index", bin_index(F.col("tenure"), roles.TENURE_EDGES, right=True))
        .where("bin_index is not null").groupBy("bin_index")
        .agg(F.avg(PROBABILITY_COLUMNS[model]).alias("avg_probability"), F.count("customer_id").alias("customers"))
    )
    return bin_dimension_join(grouped, roles.TENURE_LABELS).fillna(0, subset=["customers"])


def high_risk_table(
    wide: DataFrame, contract: str | None = None, threshold: float = 0.5, model: str = "xgboost", n: int = 50
) -> DataFrame:
    """The dashboard's ranked list of customers at risk."""
    probability = PROBABILITY_COLUMNS[model]
    shown = [
        "customer_id", "tenure", "monthly_charges", "contract", "last_login_days", "support_tickets",
        "ticket_sentiment", probability,
    ]
    risky = filter_risk(filter_contract(wide, contract), probability, threshold)
    return (
        risky.select(*roles.present(shown, wide.columns)).orderBy(F.desc(probability), "customer_id").limit(n)
    )


def raw_table(wide: DataFrame, contract: str | None = None, model: str = "xgboost", n: int = 200) -> DataFrame:
    return filter_contract(wide, contract).orderBy(F.desc(PROBABILITY_COLUMNS[model]), "customer_id").limit(n)
