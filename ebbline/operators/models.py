"""The three classifiers, scoring and importances."""

from __future__ import annotations

import sys
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.functions import roles
from ebbline.functions.scalar import risk_tier
from ebbline.operators.features import add_features, class_weights
from ebbline.operators.trees import TreeEnsemble, add_tree_probability, grow_boosted, grow_forest

# What runs in Python workers travels with the task, so the workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHT_COL = "_weight"
MEANS = "feature_means"


#: Widest vectors whose fit is carried on by Newton steps; their matrix of second derivatives has the square of it in cells.
NEWTON_WIDTH, NEWTON_STEPS, NEWTON_STEP = 512, 8, 1e-10


@dataclass
class LinearModel:
    """Log-odds as a sum of products."""

    coefficients: DenseVector
    intercept: float

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(-1, self.intercept), *((i, float(c)) for i, c in enumerate(self.coefficients))]
        spark.createDataFrame(rows, "place int, value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/linear")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearModel:
        """The saved terms, one for each feature."""
        values = [r["value"] for r in spark.read.parquet(f"{path}/linear").orderBy("place").collect()]
        return LinearModel(DenseVector(values[1:]), values[0])


def _weights(train: DataFrame, label: str) -> dict[int, tuple[int, float, float]]:
    """Per label (n, balanced weight, scale of positives): two rows."""
    rows = {r["label"]: (r["n"], r["balanced_weight"], r["scale_pos_weight"]) for r in class_weights(train, label).collect()}
    if set(rows) != {0, 1}:
        raise ValueError(f"training needs both labels, found {sorted(rows)}")
    return rows


def _weighted(train: DataFrame, label: str, positive: float, negative: float) -> DataFrame:
    """The columns a learner needs, with weights."""
    weight = F.when(F.col(label) == 1, float(positive)).otherwise(float(negative))
    return train.select(F.col(label).cast("double").alias(label), "features", weight.alias(WEIGHT_COL))


def _balanced(train: DataFrame, label: str) -> tuple[DataFrame, float]:
    """Rows weighted by n / (2 · n_label), and the number of rows, which is also the sum of the weights."""
    rows = _weights(train, label)
    return _weighted(train, label, rows[1][1], rows[0][1]), sum(n for n, _, _ in rows.values())


def train_lr(train: DataFrame, label: str = "label", *, c: float = 1.0, max_iter: int = 2000, tol: float = 1e-6) -> LinearModel:
    """Balanced L2 logistic regression.

    The loss is averaged over the weights here, hence the penalty 1 / (C · Σw)
    for the usual objective C · loss + |coef|²/2.  The quasi-Newton fit stops where the loss hardly falls any more;
    Newton steps carry it on until the coefficients hardly move.  Vectors wider than NEWTON_WIDTH keep the first fit.
    """
    data, total = _balanced(train, label)
    fit = LogisticRegression(
        labelCol=label, weightCol=WEIGHT_COL, regParam=1.0 / (c * total), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=tol,
    ).fit(data)
    terms = np.array([fit.intercept, *fit.coefficients])
    if len(terms) <= NEWTON_WIDTH:
        terms = _newton(data, label, terms, c)
    return LinearModel(DenseVector(terms[1:]), float(terms[0]))


def _newton(data: DataFrame, label: str, terms: np.ndarray, c: float) -> np.ndarray:
    """Steps to the least of C · Σ w · loss + |coef|²/2; each sums gradient and second derivatives over all rows in one aggregate."""
    size = len(terms)
    ridge = np.diag([0.0, *[1.0 / c] * (size - 1)])  # the intercept is not penalised
    rows = data.select(vector_to_array("features").alias("x"), F.col(label).alias("y"), F.col(WEIGHT_COL).alias("w"))
    for _ in range(NEWTON_STEPS):

        def sums(batches, terms=terms):
            total = np.zeros((size, size + 1))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.c_[np.ones(batch.num_rows), batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)]
                y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
                p = 1 / (1 + np.exp(-(x @ terms)))
                total[:, 0] += x.T @ (w * (p - y))
                total[:, 1:] += x.T @ ((w * p * (1 - p))[:, None] * x)
            yield pa.RecordBatch.from_pydict({"sums": [total.ravel()]})

        found = rows.mapInArrow(sums, "sums array<double>").agg(Summarizer.sum(array_to_vector("sums"))).first()[0].toArray().reshape(size, size + 1)
        step = np.linalg.solve(found[:, 1:] + ridge, found[:, 0] + ridge @ terms)
        terms = terms - step
        if np.abs(step).max() < NEWTON_STEP:
            return terms
    warnings.warn(f"the coefficients still move by {np.abs(step).max():.2g} after {NEWTON_STEPS} Newton steps", stacklevel=3)
    return terms


def train_rf(
    train: DataFrame, label: str = "label", *, trees: int = 200, depth: int = 12, min_split: int = 10, min_leaf: int = 5, seed: int = roles.SEED,
    bootstrap: bool = True, columns_share: float | str = "sqrt", draw: Column | None = None,
) -> TreeEnsemble:
    """Random forest whose trees balance the labels of the rows they drew."""
    counts = {value: n for value, (n, _, _) in _weights(train, label).items()}
    return grow_forest(
        train, label, counts, trees=trees, depth=depth, min_split=min_split, min_leaf=min_leaf, columns_share=columns_share, bootstrap=bootstrap, seed=seed, draw=draw,
    )


def train_gbt(
    train: DataFrame, label: str = "label", *, rounds: int = 200, depth: int = 6, rate: float = 0.1, rows_share: float = 0.8,
    columns_share: float = 0.8, penalty: float = 1.0, least_hessian: float = 1.0, seed: int = roles.SEED, draw: Column | None = None,
) -> TreeEnsemble:
    """Second-order boosted trees, positives weighted by negatives per positive, with rows and columns drawn for each tree."""
    rows = _weights(train, label)
    return grow_boosted(
        train, label, {value: n for value, (n, _, _) in rows.items()}, rounds=rounds, depth=depth, rate=rate, rows_share=rows_share, columns_share=columns_share,
        penalty=penalty, least_hessian=least_hessian, positive_weight=rows[1][2], seed=seed, draw=draw,
    )


TRAINERS = {"lr": train_lr, "rf": train_rf, "xgb": train_gbt}


# ── saved state ─────────────────────────────────────────────────────────────


def save_models(
    path: str, features: PipelineModel, models: Mapping[str, object], means: Sequence[float] | None = None
) -> list[str]:
    """Save the feature pipeline, the models and the feature means below a folder; returns the names written."""
    root = path.rstrip("/")
    features.write().overwrite().save(f"{root}/features")
    for alias, model in models.items():
        model.save(SparkSession.active(), f"{root}/{roles.MODEL_NAMES[alias]}")
    if means is not None:
        rows = [(i, float(m)) for i, m in enumerate(means)]
        spark = SparkSession.active()
        spark.createDataFrame(rows, "place int, mean double").coalesce(1).write.mode("overwrite").parquet(f"{root}/{MEANS}")
    return ["features", *[roles.MODEL_NAMES[alias] for alias in models], *([MEANS] if means is not None else [])]


def load_means(spark: SparkSession, path: str) -> list[float]:
    """The feature means of the training rows, from which linear reasons are measured."""
    rows = spark.read.parquet(f"{path.rstrip('/')}/{MEANS}").orderBy("place").collect()  # one row for each feature
    return [r["mean"] for r in rows]


def _there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException:
        return False
    return True


def _load(spark: SparkSession, path: str):
    """The model below a folder, or None."""
    if _there(spark, f"{path}/trees"):
        return TreeEnsemble.load(spark, path)
    return LinearModel.load(spark, path) if _there(spark, f"{path}/linear") else None


def load_models(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, object]]:
    """The feature pipeline and the models found; absent models are skipped, none at all is an error."""
    root = path.rstrip("/")
    found = {alias: _load(spark, f"{root}/{name}") for alias, name in roles.MODEL_NAMES.items()}
    models = {alias: model for alias, model in found.items() if model is not None}
    if not models or not _there(spark, f"{root}/features/metadata"):
        raise FileNotFoundError(f"no feature pipeline with a trained model below {root}")
    return PipelineModel.load(f"{root}/features"), models


# ── scoring ─────────────────────────────────────────────────────────────────


def add_probability(featured: DataFrame, model, output: str) -> DataFrame:
    """Add the positive-class probability of one model; ``featured`` has the feature vector."""
    if isinstance(model, TreeEnsemble):
        return add_tree_probability(featured, model, output)
    products = F.zip_with(vector_to_array("features"), F.lit([float(c) for c in model.coefficients]), lambda x, c: x * c)
    odds = F.aggregate(products, F.lit(float(model.intercept)), lambda total, x: total + x)
    return featured.withColumn(output, 1 / (1 + F.exp(-odds)))


def score_batch(
    df: DataFrame, features: PipelineModel, models: Mapping[str, object], *, digits: int | None = 4
) -> DataFrame:
    """All columns of ``df`` with ``<model>_probability`` and ``<model>_prediction``.

    One narrow pass: the profile columns ride along, so no join brings them
    back.  A prediction is 1 above 0.5 of the unrounded probability.
    """
    out = add_features(df, features)
    for alias, model in models.items():
        out = add_probability(out, model, "_probability")
        value = F.col("_probability")
        out = out.withColumns({
            f"{alias}_probability": F.round(value, digits) if digits is not None else value,
            f"{alias}_prediction": (value > 0.5).cast("int"),
        }).drop("_probability")
    return out.drop("features")


def scored_response(probability: Column) -> dict[str, Column]:
    """The result fields of a scoring request: score, label (1 from 0.5 on) and risk level."""
    return {
        "churn_probability": F.round(probability, 4),
        "churn_prediction": (probability >= 0.5).cast("int"),
        "risk_level": risk_tier(probability),
    }


# ── importances ─────────────────────────────────────────────────────────────


def importance(spark: SparkSession, model, names: Sequence[str], top: int = 20) -> DataFrame:
    """(rank, feature, importance, sign): |coefficient| of a linear model, share of the split gains of trees.

    As many rows as the model has features, at most ``top``.
    """
    if hasattr(model, "coefficients"):
        weights = [float(w) for w in model.coefficients.toArray()]
    else:
        weights = model.importances().tolist()
    ranked = sorted(zip(names, weights), key=lambda item: (-abs(item[1]), item[0]))[:top]
    rows = [(i, name, abs(w), "+" if w >= 0 else "-") for i, (name, w) in enumerate(ranked, 1)]
    return spark.createDataFrame(rows, "rank int, feature string, importance double, sign string")
