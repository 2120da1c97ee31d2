"""Attributions of a scored table and their summaries, and scored requests with reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.functions import roles
from ebbline.functions.scalar import request_id
from ebbline.operators.explain import (
    shap_dependence, shap_global, shap_linear, shap_tree, shap_waterfall, top_factors,
)
from ebbline.operators.features import add_features, feature_names
from ebbline.operators.models import add_probability, scored_response
from ebbline.operators.shape import rename_camel
from ebbline.session import staged


def attributions(featured: DataFrame, model, means: Sequence[float] | None = None) -> DataFrame:
    """Tree attributions, or linear ones for the fallback model.

    Linear ones are measured from ``means``, those of the training rows, so that
    a request gets the same reasons whatever it is answered with.
    """
    if hasattr(model, "coefficients"):
        if means is None:
            raise ValueError("linear attributions need the feature means of the training rows")
        return shap_linear(featured, model, means)
    return shap_tree(featured, model)


def explain_all(
    df: DataFrame, features: PipelineModel, model, *, key: str = roles.ID_COL, waterfall_key=None,
    means: Sequence[float] | None = None,
) -> dict[str, DataFrame]:
    """Attributions of every row with the global, dependence and waterfall tables."""
    names = feature_names(features)
    explained = staged(attributions(add_features(df, features), model, means), "attributions")
    if waterfall_key is None:
        waterfall_key = explained.agg(F.min(key)).first()[0]
    return {
        "attributions": explained,
        "shap_global": shap_global(explained, names),
        "shap_dependence": shap_dependence(explained, names),
        "shap_waterfall": shap_waterfall(explained, names, key, waterfall_key),
    }


def answer_requests(
    requests: DataFrame, features: PipelineModel, model, model_name: str, *, key: Sequence[str], reasons: bool = True,
    means: Sequence[float] | None = None,
) -> DataFrame:
    """The response to each (valid, snake-case) scoring request; the batch form leaves the reasons out.

    Ids come from the request's key columns, so a retried task answers with the same id.
    """
    featured = add_features(rename_camel(requests.withColumn("_request", request_id(*[F.col(k) for k in key]))), features)
    scored = add_probability(featured, model, "_probability")
    extra = []
    if reasons:
        scored = top_factors(attributions(scored, model, means), feature_names(features))
        extra = ["top_factors", "shap_explanations"]
    return scored.select(
        F.col("_request").alias("customer_id"),
        *[value.alias(name) for name, value in scored_response(F.col("_probability")).items()],
        F.lit(model_name).alias("model_used"), *extra,
        F.col("_probability").alias("probability"),
    )
