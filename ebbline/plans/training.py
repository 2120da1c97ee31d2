"""Training and evaluation of the three models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions import roles
from ebbline.operators.evaluate import metrics
from ebbline.operators.explain import feature_means
from ebbline.operators.features import add_features, feature_names, fit_features, stratified_split
from ebbline.operators.models import TRAINERS, add_probability, save_models
from ebbline.operators.shape import encode_target
from ebbline.session import staged


@dataclass
class Trained:
    features: PipelineModel
    names: list[str]
    models: dict[str, object]
    train: DataFrame
    test: DataFrame
    means: list[float]


def train_all(
    df: DataFrame,
    aliases: Sequence[str] = ("lr", "rf", "xgb"),
    *,
    key: str = roles.ID_COL,
    fit_scope: str = "train",
    test_share: float = roles.TEST_SHARE,
    seed: int = roles.SEED,
    order: Column | None = None,
    include_binary: bool = False,
    save_to: str | None = None,
    params: Mapping[str, Mapping] | None = None,
) -> Trained:
    """Split, fit features, fit the models; the feature means of the training part go with them.

    The feature state comes from the training part; ``fit_scope="all"`` takes
    all rows.  Both parts are staged with their vectors: the learners read the
    training part many times.
    """
    if fit_scope not in ("train", "all"):
        raise ValueError(f"fit_scope must be train or all, not {fit_scope!r}")
    labelled = encode_target(df)
    train, test = stratified_split(labelled, key, test_share=test_share, seed=seed, order=order)
    features = fit_features(labelled if fit_scope == "all" else train, include_binary=include_binary)
    train_vectors = staged(add_features(train, features), "train")
    models = {alias: TRAINERS[alias](train_vectors, **(params or {}).get(alias, {})) for alias in aliases}
    means = feature_means(train_vectors)
    if save_to:
        save_models(save_to, features, models, means)
    test_vectors = staged(add_features(test, features), "test")
    return Trained(features, feature_names(features), models, train_vectors, test_vectors, means)


def scored_test(trained: Trained) -> DataFrame:
    """(label, model_name, probability, prediction) of the test rows, long."""
    wide = trained.test
    for alias, model in trained.models.items():
        wide = add_probability(wide, model, f"_{alias}")
    per_model = F.array(*[
        F.struct(
            F.lit(roles.MODEL_NAMES[alias]).alias("model_name"), F.col(f"_{alias}").alias("probability"),
            (F.col(f"_{alias}") > 0.5).cast("int").alias("prediction"),
        )
        for alias in trained.models
    ])
    return wide.select("label", F.inline(per_model))


def train_eval(df: DataFrame, **options) -> tuple[Trained, DataFrame]:
    """The trained models and one row of test metrics for each."""
    trained = train_all(df, **options)
    return trained, metrics(scored_test(trained), by=["model_name"])
