"""Features, models, evaluation and attribution."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from ebbline.catalog.base import customers, key_order, labelled_scores, profile, query, read, rounded, using
from ebbline.catalog.texts import enriched
from ebbline.functions import roles
from ebbline.operators import evaluate, explain, features, models, shape
from ebbline.plans import explain as explain_plan
from ebbline.plans.store import run_etl
from ebbline.plans.training import Trained, scored_test, train_all, train_eval
from ebbline.session import scratch_path, spread

# ── features ────────────────────────────────────────────────────────────────

_NUM = {"tenure": "Tenure", "monthly_charges": "MonthlyCharges", "support_tickets": "SupportTickets"}
_Z = "ROUND(({c} - (SELECT AVG({c}) FROM profile)) / (SELECT STDDEV_POP({c}) FROM profile), 6)"
_CONTRACTS = ["Month-to-month", "One year", "Two year"]
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _hot(column: str, prefix: str, values: list[str]) -> str:
    return ", ".join(f"CAST({column} = '{v}' AS DOUBLE) AS \"{prefix}_{v}\"" for v in values)


@query("standardize", using(
    'SELECT customer_id AS "CustomerID", ' + ", ".join(f'{_Z.format(c=c)} AS "{n}_z"' for c, n in _NUM.items())
    + " FROM profile", "profile"))
def standardize(spark, sf_dir):
    frame = customers(spark, sf_dir).select("CustomerID", *_NUM.values())
    return rounded(features.standardize(frame, list(_NUM.values())).select("CustomerID", *[f"{n}_z" for n in _NUM.values()]))


@query("onehot", using(
    f'SELECT customer_id AS "CustomerID", {_hot("contract", "Contract", _CONTRACTS)}, '
    f'{_hot("industry", "Industry", _SEGMENTS)} FROM profile', "profile"))
def onehot(spark, sf_dir):
    return features.onehot(customers(spark, sf_dir), ["Contract", "Industry"], keep=["CustomerID"])


@query("assemble", using(
    'SELECT customer_id AS "CustomerID", ' + ", ".join(f'{_Z.format(c=c)} AS "{n}"' for c, n in _NUM.items())
    + f', {_hot("contract", "Contract", _CONTRACTS)} FROM profile', "profile"))
def assemble(spark, sf_dir):
    frame = customers(spark, sf_dir)
    fitted = features.fit_features(frame, list(_NUM.values()), ["Contract"])
    vectors = features.add_features(frame, fitted)
    return rounded(features.feature_columns(vectors, features.feature_names(fitted), keep=["CustomerID"]))


_WEIGHTS = """
SELECT label, n, ROUND((SELECT COUNT(*) FROM {t}) / (2.0 * n), 6) AS balanced_weight,
  ROUND((SELECT COUNT(*) FROM {t} WHERE {c} = 0) / (SELECT COUNT(*) FROM {t} WHERE {c} = 1), 6) AS scale_pos_weight
FROM (SELECT {c} AS label, COUNT(*) AS n FROM {t} GROUP BY {c})"""


@query("class_weights", _WEIGHTS.format(t="labels", c="quality"))
def class_weights(spark, sf_dir):
    return rounded(features.class_weights(read(spark, sf_dir, "labels"), "quality"))


@query("stratified_split", using("""
SELECT customer_id, label, CASE WHEN rn <= CAST(FLOOR(0.25 * n + 0.5) AS BIGINT) THEN 'test' ELSE 'train' END AS part
FROM (SELECT customer_id, CAST(churn = 'Yes' AS INTEGER) AS label,
        ROW_NUMBER() OVER (PARTITION BY churn ORDER BY (customer_id * 48271 + 42) % 2147483647) AS rn,
        COUNT(*) OVER (PARTITION BY churn) AS n FROM profile)""", "profile"))
def stratified_split(spark, sf_dir):
    frame = profile(spark, sf_dir).select("customer_id", (F.col("churn") == "Yes").cast("int").alias("label"))
    train, test = features.stratified_split(frame, "customer_id", order=key_order("customer_id"))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


# ── evaluation, over the formula scores ─────────────────────────────────────

_CELLS = """cells AS (SELECT model_name, COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
  COUNT(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, COUNT(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
  COUNT(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM labelled GROUP BY model_name)"""
_AUC = """ranks AS (SELECT model_name, label, RANK() OVER (PARTITION BY model_name ORDER BY probability)
    + (COUNT(*) OVER (PARTITION BY model_name, probability) - 1) / 2.0 AS r FROM labelled),
area AS (SELECT model_name, (SUM(r) FILTER (WHERE label = 1) - COUNT(*) FILTER (WHERE label = 1)
    * (COUNT(*) FILTER (WHERE label = 1) + 1) / 2.0) / (COUNT(*) FILTER (WHERE label = 1) * COUNT(*) FILTER (WHERE label = 0)) AS roc_auc
  FROM ranks GROUP BY model_name)"""


@query("confusion_matrix", using("""
SELECT model_name, 0 AS label, 0 AS prediction, tn AS n FROM cells UNION ALL SELECT model_name, 0, 1, fp FROM cells
UNION ALL SELECT model_name, 1, 0, fn FROM cells UNION ALL SELECT model_name, 1, 1, tp FROM cells""",
    "labelled", extra=_CELLS))
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(labelled_scores(spark, sf_dir), by=["model_name"])


@query("metrics", using("""
SELECT c.model_name, ROUND((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  ROUND(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  ROUND(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  ROUND(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, ROUND(roc_auc, 6) AS roc_auc
FROM cells c JOIN area a ON c.model_name = a.model_name""", "labelled", extra=_CELLS + ",\n" + _AUC))
def metrics(spark, sf_dir):
    return rounded(evaluate.metrics(labelled_scores(spark, sf_dir), by=["model_name"]))


@query("roc_auc", using("SELECT model_name, ROUND(roc_auc, 6) AS roc_auc FROM area", "labelled", extra=_AUC))
def roc_auc(spark, sf_dir):
    return rounded(evaluate.roc_auc(labelled_scores(spark, sf_dir), by=["model_name"]))


@query("roc_curve", using("""
SELECT model_name, probability AS threshold,
  ROUND(SUM(neg) OVER w / SUM(neg) OVER (PARTITION BY model_name), 6) AS fpr,
  ROUND(SUM(pos) OVER w / SUM(pos) OVER (PARTITION BY model_name), 6) AS tpr
FROM (SELECT model_name, probability, COUNT(*) FILTER (WHERE label = 1) AS pos, COUNT(*) FILTER (WHERE label = 0) AS neg
      FROM labelled GROUP BY model_name, probability)
WINDOW w AS (PARTITION BY model_name ORDER BY probability DESC)""", "labelled"))
def roc_curve(spark, sf_dir):
    return rounded(evaluate.roc_curve(labelled_scores(spark, sf_dir), by=["model_name"]))


@query("class_report", using("""
SELECT model_name, "row", ROUND(p, 6) AS precision, ROUND(r, 6) AS recall, ROUND(f, 6) AS f1, support FROM (
  SELECT model_name, 'Retained (0)' AS "row", p0 AS p, r0 AS r, f0 AS f, s0 AS support FROM parts
  UNION ALL SELECT model_name, 'Churned (1)', p1, r1, f1, s1 FROM parts
  UNION ALL SELECT model_name, 'accuracy', acc, acc, acc, s0 + s1 FROM parts
  UNION ALL SELECT model_name, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM parts
  UNION ALL SELECT model_name, 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
    (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM parts)""", "labelled", extra=_CELLS + """,
parts AS (SELECT model_name, (tp + tn) / (tp + tn + fp + fn) AS acc, tn + fp AS s0, tp + fn AS s1,
  COALESCE(tn / NULLIF(tn + fn, 0), 0) AS p0, COALESCE(tn / NULLIF(tn + fp, 0), 0) AS r0,
  COALESCE(2 * tn / NULLIF(2 * tn + fn + fp, 0), 0) AS f0, COALESCE(tp / NULLIF(tp + fp, 0), 0) AS p1,
  COALESCE(tp / NULLIF(tp + fn, 0), 0) AS r1, COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0) AS f1 FROM cells)"""))
def class_report(spark, sf_dir):
    return rounded(evaluate.class_report(labelled_scores(spark, sf_dir), by=["model_name"]))


# ── models, over the generated customers with ticket sentiment ──────────────
# ``*_full`` fit the library's defaults to all features; the same operators over models that SQL can follow are in ``stated``.

_trained: dict[tuple[str, str], Trained] = {}


def trained(spark, sf_dir) -> Trained:
    """The three models, fitted once per application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _trained:
        _trained[key] = train_all(enriched(spark, sf_dir))
    return _trained[key]


def _test_scores(spark, sf_dir, alias: str):
    fit = trained(spark, sf_dir)
    scored = models.add_probability(fit.test, fit.models[alias], "probability")
    return scored.select("CustomerID", "label", F.round("probability", 4).alias("probability"))


@query("train_lr_full")
def train_lr(spark, sf_dir):
    return _test_scores(spark, sf_dir, "lr")


@query("train_rf_full")
def train_rf(spark, sf_dir):
    return _test_scores(spark, sf_dir, "rf")


@query("train_gbt_full")
def train_gbt(spark, sf_dir):
    return _test_scores(spark, sf_dir, "xgb")


@query("train_eval_full")
def train_and_evaluate(spark, sf_dir):
    fit = trained(spark, sf_dir)
    return rounded(evaluate.metrics(scored_test(fit), by=["model_name"]))


@query("train_eval_lr_all_scope")
def train_eval_lr(spark, sf_dir):
    _, result = train_eval(enriched(spark, sf_dir), aliases=["lr"], fit_scope="all", include_binary=True)
    return rounded(result)


@query("save_model_full")
def save_model(spark, sf_dir):
    fit = trained(spark, sf_dir)
    path = scratch_path(spark, "models")
    names = models.save_models(path, fit.features, fit.models)
    return spark.createDataFrame([(name,) for name in names], "artefact string")


@query("load_model_full")
def load_model(spark, sf_dir):
    fit = trained(spark, sf_dir)
    path = scratch_path(spark, "models")
    models.save_models(path, fit.features, {"lr": fit.models["lr"], "xgb": fit.models["xgb"]})
    loaded_features, loaded = models.load_models(spark, path)
    scored = models.score_batch(enriched(spark, sf_dir), loaded_features, loaded)
    return scored.select("CustomerID", "lr_probability", "lr_prediction", "xgb_probability", "xgb_prediction")


@query("score_batch_full")
def score_batch(spark, sf_dir):
    fit = trained(spark, sf_dir)
    scored = models.score_batch(enriched(spark, sf_dir), fit.features, fit.models)
    return scored.select("CustomerID", *[f"{a}_{c}" for a in fit.models for c in ("probability", "prediction")])


@query("etl_models")
def etl_models(spark, sf_dir):
    fit = trained(spark, sf_dir)
    path = scratch_path(spark, "models")
    models.save_models(path, fit.features, fit.models)
    return run_etl(spark, enriched(spark, sf_dir), path, scratch_path(spark, "store"))["model_stats"]


def _importance(spark, sf_dir, alias: str):
    fit = trained(spark, sf_dir)
    return rounded(models.importance(spark, fit.models[alias], fit.names))


@query("importance_lr_full")
def importance_lr(spark, sf_dir):
    return _importance(spark, sf_dir, "lr")


@query("importance_rf_full")
def importance_rf(spark, sf_dir):
    return _importance(spark, sf_dir, "rf")


@query("importance_gbt_full")
def importance_gbt(spark, sf_dir):
    return _importance(spark, sf_dir, "xgb")


# ── attribution ─────────────────────────────────────────────────────────────


def _vectors(spark, sf_dir):
    return features.add_features(spread(enriched(spark, sf_dir)), trained(spark, sf_dir).features)


def _tree_attributions(spark, sf_dir):
    return explain.shap_tree(_vectors(spark, sf_dir), trained(spark, sf_dir).models["xgb"])


def _long(explained, names, key="CustomerID"):
    """(key, feature, shap): one row per customer and feature."""
    labels = F.array(*[F.lit(n) for n in names])
    return rounded(explained.select(key, F.posexplode("shap").alias("i", "shap")).select(
        key, F.get(labels, F.col("i")).alias("feature"), "shap"
    ))


def _factors(explained, names):
    ranked = explain.top_factors(explained, names)
    return ranked.select("CustomerID", F.posexplode("top_factors").alias("i", "f")).select(
        "CustomerID", (F.col("i") + 1).alias("rank"), "f.feature", "f.shap_value", "f.contribution"
    )


@query("shap_tree_full")
def shap_tree(spark, sf_dir):
    return _long(_tree_attributions(spark, sf_dir), trained(spark, sf_dir).names)


@query("shap_linear_trained")
def shap_linear_trained(spark, sf_dir):
    fit = trained(spark, sf_dir)
    vectors = _vectors(spark, sf_dir)
    return _long(explain.shap_linear(vectors, fit.models["lr"], fit.means), fit.names)


@query("top_factors_tree")
def top_factors_tree(spark, sf_dir):
    return _factors(_tree_attributions(spark, sf_dir), trained(spark, sf_dir).names)


@query("shap_global_tree")
def shap_global_tree(spark, sf_dir):
    return rounded(explain.shap_global(_tree_attributions(spark, sf_dir), trained(spark, sf_dir).names))


@query("shap_dependence_tree")
def shap_dependence_tree(spark, sf_dir):
    names = trained(spark, sf_dir).names
    return rounded(explain.shap_dependence(_tree_attributions(spark, sf_dir), names))


@query("shap_waterfall_tree")
def shap_waterfall_tree(spark, sf_dir):
    explained = _tree_attributions(spark, sf_dir)
    first = enriched(spark, sf_dir).agg(F.min(roles.ID_COL)).first()[0]
    return rounded(explain.shap_waterfall(explained, trained(spark, sf_dir).names, roles.ID_COL, first))


# The same readings over a linear model with stated coefficients, which SQL can follow.
_FIXED = SimpleNamespace(coefficients=[0.5, -0.3, 0.8, 0.4, -0.2, 0.1], intercept=0.25)
_FIXED_NAMES = ["Tenure", "MonthlyCharges", "SupportTickets", "Contract_Month-to-month", "Contract_One year", "Contract_Two year"]


def _linear_sql() -> str:
    z = ", ".join(
        f"({c} - (SELECT AVG({c}) FROM profile)) / (SELECT STDDEV_POP({c}) FROM profile) AS f{i}" for i, c in enumerate(_NUM)
    )
    hot = ", ".join(f"CAST(contract = '{v}' AS DOUBLE) AS f{i}" for i, v in enumerate(_CONTRACTS, len(_NUM)))
    count = len(_FIXED_NAMES)
    lines = " UNION ALL ".join(
        f"SELECT customer_id, {i} AS i, '{name}' AS feature, f{i} AS v, {w}::DOUBLE * (f{i} - a{i}) AS s FROM x, mean"
        for i, (name, w) in enumerate(zip(_FIXED_NAMES, _FIXED.coefficients))
    )
    base = " + ".join(f"{w}::DOUBLE * a{i}" for i, w in enumerate(_FIXED.coefficients))
    return f"""x AS (SELECT customer_id, {z}, {hot} FROM profile),
mean AS (SELECT {', '.join(f'AVG(f{i}) AS a{i}' for i in range(count))} FROM x),
shap AS ({lines}),
base AS (SELECT 0.25::DOUBLE + {base} AS b FROM mean)"""


def _linear_attributions(spark, sf_dir):
    frame = customers(spark, sf_dir)
    vectors = features.add_features(frame, features.fit_features(frame, list(_NUM.values()), ["Contract"]))
    return explain.shap_linear(vectors, _FIXED, explain.feature_means(vectors))


@query("shap_linear", using(
    'SELECT customer_id AS "CustomerID", feature, ROUND(s, 6) AS shap FROM shap', "profile", extra=_linear_sql()))
def shap_linear(spark, sf_dir):
    return _long(_linear_attributions(spark, sf_dir), _FIXED_NAMES)


@query("top_factors", using("""
SELECT customer_id AS "CustomerID", CAST(rank AS INTEGER) AS rank, feature, ROUND(s, 6) AS shap_value,
  CASE WHEN s > 0 THEN '+' ELSE '-' END AS contribution
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY ABS(ROUND(s, 6)) DESC, i) AS rank
      FROM shap WHERE ABS(s) >= 1e-6) WHERE rank <= 5""", "profile", extra=_linear_sql()))
def top_factors(spark, sf_dir):
    return _factors(_linear_attributions(spark, sf_dir), _FIXED_NAMES)


@query("shap_global", using("""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY m DESC, feature) AS INTEGER) AS rank, feature, ROUND(m, 6) AS importance
FROM (SELECT feature, AVG(ABS(s)) AS m FROM shap GROUP BY feature)""", "profile", extra=_linear_sql()))
def shap_global(spark, sf_dir):
    return rounded(explain.shap_global(_linear_attributions(spark, sf_dir), _FIXED_NAMES))


@query("shap_dependence", using("""
SELECT feature, ROUND(v, 6) AS value, ROUND(s, 6) AS shap_value FROM shap
WHERE feature = (SELECT feature FROM shap GROUP BY feature ORDER BY AVG(ABS(s)) DESC, feature LIMIT 1)""",
    "profile", extra=_linear_sql()))
def shap_dependence(spark, sf_dir):
    return rounded(explain.shap_dependence(_linear_attributions(spark, sf_dir), _FIXED_NAMES))


@query("shap_waterfall", using("""
SELECT CAST(step AS INTEGER) AS step, feature, ROUND(shap_value, 6) AS shap_value FROM (
  SELECT 0 AS step, 'base_value' AS feature, b AS shap_value FROM base
  UNION ALL SELECT r, feature, s FROM one WHERE r <= 3
  UNION ALL SELECT 4, '3 other features', SUM(s) FROM one WHERE r > 3
  UNION ALL SELECT 5, 'log_odds', MAX(b) + SUM(s) FROM one, base)""", "profile", extra=_linear_sql() + """,
one AS (SELECT feature, s, ROW_NUMBER() OVER (ORDER BY ABS(s) DESC, i) AS r FROM shap
  WHERE customer_id = (SELECT MIN(customer_id) FROM profile))"""))
def shap_waterfall(spark, sf_dir):
    explained = _linear_attributions(spark, sf_dir)
    first = explained.agg(F.min(roles.ID_COL)).first()[0]
    return rounded(explain.shap_waterfall(explained, _FIXED_NAMES, roles.ID_COL, first, shown=4))


@query("explain_all_full")
def explain_all(spark, sf_dir):
    fit = trained(spark, sf_dir)
    return rounded(explain_plan.explain_all(spread(enriched(spark, sf_dir)), fit.features, fit.models["xgb"])["shap_global"])


@query("score_requests")
def score_requests(spark, sf_dir):
    fit = trained(spark, sf_dir)
    valid, _ = shape.split_valid(shape.rename_snake(spread(enriched(spark, sf_dir))))
    answers = explain_plan.answer_requests(valid, fit.features, fit.models["xgb"], "xgboost", key=["customer_id"])
    return answers.select(
        "customer_id", "churn_probability", "churn_prediction", "risk_level", "model_used",
        F.array_join(F.transform("top_factors", lambda f: F.concat(f["contribution"], f["feature"])), ", ").alias("reasons"),
    )
