import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebbline.operators import evaluate, explain, features, models, shape, text, trees
from ebbline.plans.explain import answer_requests, explain_all
from ebbline.plans.training import train_eval
from ebbline.session import staged
from ebbline.sources import synth


@pytest.fixture(scope="module")
def enriched(spark):
    return staged(text.text_sentiment(synth.gen_ticket_text(synth.gen_customers(spark, 3000))), "enriched")


@pytest.fixture(scope="module")
def trained(enriched):
    return train_eval(enriched, params={"rf": {"trees": 20, "depth": 8}, "xgb": {"rounds": 12, "depth": 4}})


# ── features ────────────────────────────────────────────────────────────────


def test_unseen_and_constant(spark):
    seen = spark.createDataFrame([("a", 5.0, 1.0), ("b", 5.0, 3.0), (None, 5.0, 5.0)], "Contract string, Tenure double, MonthlyCharges double")
    fitted = features.fit_features(seen)
    names = features.feature_names(fitted)
    assert names == ["Tenure", "MonthlyCharges", "Contract_a", "Contract_b", "Contract_nan"]
    new = spark.createDataFrame([("zz", 5.0, 3.0), ("b", 5.0, 5.0)], seen.schema)
    out = features.feature_columns(features.add_features(new, fitted), names).collect()
    assert tuple(out[0]) == (0.0, 0.0, 0.0, 0.0, 0.0)
    assert math.isclose(out[1][1], 2 / math.sqrt(8 / 3)) and tuple(out[1][2:]) == (0.0, 1.0, 0.0)


def test_binary_columns_only_on_demand(spark):
    df = spark.createDataFrame([("Yes", 1, 3.0), ("No", 0, 4.0)], "Partner string, SeniorCitizen int, Tenure double")
    assert features.feature_names(features.fit_features(df)) == ["Tenure"]
    assert features.feature_names(features.fit_features(df, include_binary=True)) == ["Tenure", "SeniorCitizen", "Partner"]


def test_many_categories_are_all_encoded(spark):
    df = spark.range(3000).selectExpr("cast(id as string) Contract")
    fitted = features.fit_features(df, numeric=[], categorical=["Contract"])
    assert len(features.feature_names(fitted)) == 3000
    assert features.add_features(df, fitted).first()["features"].numNonzeros() == 1


def test_split_sizes_and_independence_of_partitions(spark):
    df = spark.range(1003).selectExpr("cast(id as string) CustomerID", "cast(id % 3 = 0 as int) label")
    parts = []
    for n in (1, 7):
        train, test = features.stratified_split(df.repartition(n))
        assert train.count() + test.count() == 1003
        sizes = {r["label"]: r["count"] for r in test.groupBy("label").count().collect()}
        assert sizes == {1: 84, 0: 167}
        parts.append(sorted(r[0] for r in test.collect()))
    assert parts[0] == parts[1]
    train, test = features.stratified_split(df, exact=False)
    assert train.count() + test.count() == 1003 and 200 < test.count() < 300


def test_class_weights(spark, rows):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2 + [(None,)], "label int")
    out = {r["label"]: r for r in rows(features.class_weights(df))}
    assert (out[0]["balanced_weight"], out[1]["balanced_weight"], out[1]["scale_pos_weight"]) == (8 / 12, 2.0, 3.0)


# ── evaluation ──────────────────────────────────────────────────────────────


def brute_auc(pairs):
    positives = [p for p, y in pairs if y == 1]
    negatives = [p for p, y in pairs if y == 0]
    ordered = sum((p > n) + 0.5 * (p == n) for p in positives for n in negatives)
    return ordered / len(positives) / len(negatives)


@pytest.mark.parametrize("partitions", ["1", "3", "16"])
def test_roc_in_any_number_of_pieces(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rng = np.random.default_rng(3)
    # A third of all rows share one score.
    pairs = [(0.5 if rng.random() < 0.33 else round(float(rng.random()) ** 3, 3), int(rng.random() < 0.3)) for _ in range(900)]
    df = spark.createDataFrame(pairs, "probability double, label int")
    area = evaluate.roc_auc(df).first()["roc_auc"]
    assert math.isclose(area, brute_auc(pairs), rel_tol=1e-12)
    curve = evaluate.roc_curve(df).orderBy(F.desc("threshold")).collect()
    total_pos, total_neg = sum(y for _, y in pairs), sum(1 - y for _, y in pairs)
    for row in curve[:: max(1, len(curve) // 25)]:
        assert math.isclose(row["tpr"], sum(y for p, y in pairs if p >= row["threshold"]) / total_pos)
        assert math.isclose(row["fpr"], sum(1 - y for p, y in pairs if p >= row["threshold"]) / total_neg)
    assert curve[-1]["tpr"] == curve[-1]["fpr"] == 1.0


def test_one_class_only(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.9)], "label int, prediction int, probability double")
    row = evaluate.metrics(df).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"], row["roc_auc"]) == (0.5, 0.0, 0.0, 0.0, None)
    assert [tuple(r) for r in evaluate.confusion_matrix(df).collect()] == [(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 0)]


def test_report_rows(spark):
    df = spark.createDataFrame([(0, 0)] * 5 + [(0, 1)] + [(1, 1)] * 3 + [(1, 0)] * 1, "label int, prediction int")
    out = {r["row"]: r for r in evaluate.class_report(df).collect()}
    assert out["Churned (1)"]["precision"] == 0.75 and out["Churned (1)"]["recall"] == 0.75
    assert out["accuracy"]["f1"] == 0.8 and out["macro avg"]["support"] == 10
    assert math.isclose(out["weighted avg"]["recall"], 0.8)


# ── models ──────────────────────────────────────────────────────────────────


def test_models_find_the_signal(trained):
    _, result = trained
    rows = {r["model_name"]: r for r in result.collect()}
    assert set(rows) == {"logistic_regression", "random_forest", "xgboost"}
    assert all(0.72 < r["roc_auc"] < 0.95 and 0.6 < r["accuracy"] < 0.9 for r in rows.values())


def test_logistic_regression_is_the_penalised_optimum(trained):
    fit, _ = trained
    data = fit.train.select(vector_to_array("features").alias("x"), "label").collect()
    x, y = np.array([r["x"] for r in data]), np.array([r["label"] for r in data], dtype=float)
    weight = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum())
    model = fit.models["lr"]
    coefficients = model.coefficients.toArray()
    score = 1 / (1 + np.exp(-(x @ coefficients + model.intercept)))
    # Gradient of C · Σ w · loss + |coef|² / 2.
    gradient = x.T @ (weight * (score - y)) + coefficients
    assert np.abs(gradient).max() < 1e-6 and abs((weight * (score - y)).sum()) < 1e-6


def test_training_needs_both_labels(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0)], "label int, Tenure double")
    with pytest.raises(ValueError, match="both labels"):
        models.train_lr(features.add_features(df, features.fit_features(df)))


def test_saved_models_score_alike(spark, enriched, trained, tmp_path):
    fit, _ = trained
    models.save_models(str(tmp_path), fit.features, fit.models)
    loaded_features, loaded = models.load_models(spark, str(tmp_path))
    assert set(loaded) == {"lr", "rf", "xgb"}
    some = enriched.limit(200)
    before = models.score_batch(some, fit.features, fit.models)
    assert before.collect() == models.score_batch(some, loaded_features, loaded).collect()
    row = before.first().asDict()
    assert row["xgb_prediction"] in (0, 1) and 0 <= row["xgb_probability"] <= 1
    with pytest.raises(FileNotFoundError):
        models.load_models(spark, str(tmp_path / "nothing"))


def test_importances_are_ranked(spark, trained):
    fit, _ = trained
    for model in fit.models.values():
        rows = models.importance(spark, model, fit.names).collect()
        assert len(rows) == 20 and rows == sorted(rows, key=lambda r: -r["importance"])
        assert {"Contract_Month-to-month", "ticket_sentiment"} & {r["feature"] for r in rows[:3]}


# ── attribution ─────────────────────────────────────────────────────────────


def tree_value(model, at, x, known):
    """The expected value of a tree when only some features are known."""
    feature, left, right = (int(getattr(model, name)[at]) for name in ("feature", "left", "right"))
    if feature < 0:
        return model.value[at]
    if feature in known:
        return tree_value(model, left if x[feature] <= model.threshold[at] else right, x, known)
    share = model.cover[left] / model.cover[at]
    return share * tree_value(model, left, x, known) + (1 - share) * tree_value(model, right, x, known)


def test_tree_attributions_equal_the_definition(spark):
    df = spark.range(600).selectExpr(
        "cast(id as string) CustomerID", "cast(id * 7 % 13 as double) Tenure", "cast(id * 5 % 11 as double) MonthlyCharges",
        "if(id % 3 = 0, 'a', 'b') Contract", "cast((id * 7 % 13 + id * 5 % 11 + if(id % 3 = 0, 9, 0) + id % 5) > 14 as int) label")
    fitted = features.fit_features(df)
    names = features.feature_names(fitted)
    vectors = features.add_features(df, fitted)
    model = models.train_gbt(vectors, rounds=4, depth=3)
    n = len(names)
    for row in explain.shap_tree(vectors, model).select(vector_to_array("features").alias("x"), "shap", "base_value").limit(6).collect():
        def worth(known):
            return sum(tree_value(model, root, row["x"], known) for root in model.roots)

        assert math.isclose(row["base_value"], worth(set()), abs_tol=1e-9)
        for j in range(n):
            others = [i for i in range(n) if i != j]
            wanted = sum(
                math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n) * (worth({*group, j}) - worth(set(group)))
                for size in range(n) for group in itertools.combinations(others, size)
            )
            assert math.isclose(row["shap"][j], wanted, abs_tol=1e-9)


def test_attributions_add_up(enriched, trained):
    fit, _ = trained
    vectors = features.add_features(enriched.limit(300), fit.features)
    total = F.col("base_value") + F.aggregate("shap", F.lit(0.0), lambda a, s: a + s)
    for alias in ("xgb", "lr"):
        model = fit.models[alias]
        if alias == "xgb":
            explained = explain.shap_tree(vectors, model)
        else:
            explained = explain.shap_linear(vectors, model, explain.feature_means(fit.train))
        odds = models.add_probability(explained, model, "p").select(F.abs(F.log(F.col("p") / (1 - F.col("p"))) - total).alias("e"))
        assert odds.agg(F.max("e")).first()[0] < 1e-6


def test_reading_attributions(spark, rows):
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0], [0.5, -0.5, 1e-9], 0.1), ("b", [0.0, 0.0, 0.0], [-0.1, 0.2, 0.0], 0.1)],
                               "CustomerID string, x array<double>, shap array<double>, base_value double")
    df = df.withColumn("features", array_to_vector("x"))
    names = ["f0", "f1", "f2"]
    top = explain.top_factors(df, names).collect()
    assert [(f["feature"], f["shap_value"], f["contribution"]) for f in top[0]["top_factors"]] == [("f0", 0.5, "+"), ("f1", -0.5, "-")]
    assert [f["value"] for f in top[0]["shap_explanations"]] == [1.0, 2.0]
    ranked = rows(explain.shap_global(df, names))
    assert [(r["rank"], r["feature"]) for r in ranked] == [(1, "f1"), (2, "f0"), (3, "f2")]
    assert rows(explain.shap_dependence(df, names))[0] == {"feature": "f1", "value": 2.0, "shap_value": -0.5}
    steps = [(r["feature"], round(r["shap_value"], 6)) for r in rows(explain.shap_waterfall(df, names, "CustomerID", "a", shown=2))]
    assert steps == [("base_value", 0.1), ("f0", 0.5), ("2 other features", -0.5), ("log_odds", 0.1)]


def test_explanations_and_answers(enriched, trained):
    fit, _ = trained
    some = enriched.limit(100)
    reports = explain_all(some, fit.features, fit.models["xgb"])
    assert reports["shap_global"].count() == 15 and reports["shap_dependence"].count() == 100
    assert reports["shap_waterfall"].count() == 12
    requests = shape.rename_snake(some)
    answers = answer_requests(requests, fit.features, fit.models["xgb"], "xgboost", key=["customer_id"]).collect()
    plain = answer_requests(requests, fit.features, fit.models["xgb"], "xgboost", key=["customer_id"], reasons=False).collect()
    assert [a["customer_id"] for a in answers] == [p["customer_id"] for p in plain]
    for a in answers:
        assert a["customer_id"].startswith("api-") and 1 <= len(a["top_factors"]) <= 5 and len(a["shap_explanations"]) <= 20
        assert a["churn_prediction"] == int(a["probability"] >= 0.5)
        assert a["risk_level"] in ("Low", "Medium", "High", "Critical")


def test_forests_do_not_hang_on_the_input_layout(spark):
    df = spark.range(400).selectExpr("cast(id as string) CustomerID", "cast(pmod(hash(id), 7) as double) a", "cast(pmod(hash(id, 1), 50) as double) b").selectExpr(
        "*", "cast(pmod(hash(CustomerID), 10) + a > 8 as int) label")
    scores = {}
    for n in (1, 7):
        part = df.repartition(n)
        vectors = features.add_features(part, features.fit_features(df, ["a", "b"], []))
        for train, options in ((models.train_rf, {"trees": 5, "depth": 4}), (models.train_gbt, {"rounds": 3, "depth": 3})):
            scored = models.add_probability(vectors, train(vectors, **options), "p").select("CustomerID", F.round("p", 9)).collect()
            scores[train.__name__, n] = sorted(map(tuple, scored))
    assert scores["train_rf", 1] == scores["train_rf", 7] and scores["train_gbt", 1] == scores["train_gbt", 7]


def grid(spark, count=1500):
    df = spark.range(count).selectExpr("cast(id as string) CustomerID", *(f"cast(pmod(hash(id, {k}), {size}) as double) f{k}" for k, size in enumerate((7, 50, 1000, 2))))
    return df.selectExpr("*", "cast(pmod(hash(CustomerID), 10) + f0 + f1 / 10 > 9 as int) label")


def ensemble(model):
    return {name: getattr(model, name).tolist() for name in ("roots", "feature", "threshold", "left", "right", "value", "cover", "gain")}


def test_nodes_grow_alike_by_levels_and_in_one_task(spark, monkeypatch):
    df = grid(spark)
    vectors = features.add_features(df, features.fit_features(df, ["f0", "f1", "f2", "f3"], []))
    found = []
    for rows, blocks, margins in ((0, 1 << 16, 10), (200, 100, 2), (10**9, 1 << 16, 1)):
        monkeypatch.setattr(trees, "FINISHED_ROWS", rows)
        monkeypatch.setattr(trees, "BLOCK_ROWS", blocks)
        monkeypatch.setattr(trees, "MARGIN_ROUNDS", margins)
        found.append((ensemble(models.train_rf(vectors, trees=4, depth=5)), ensemble(models.train_gbt(vectors, rounds=4, depth=4))))
    assert found[0] == found[1] == found[2]
    assert len(found[0][0]["roots"]) == len(found[0][1]["roots"]) == 4 and max(found[0][0]["feature"]) == 3


def test_sums_are_the_same_on_the_driver_and_by_tasks_and_few_need_no_shuffle(spark, monkeypatch):
    df = grid(spark)
    vectors = features.add_features(df, features.fit_features(df, ["f0", "f1", "f2", "f3"], []))
    context, found, shuffled = spark.sparkContext, [], []
    monkeypatch.setattr(trees, "FINISHED_ROWS", 0)
    for sums, cells in ((10**6, 4_000_000), (0, 4_000_000), (10**6, 1)):
        monkeypatch.setattr(trees, "DRIVER_SUMS", sums)
        monkeypatch.setattr(trees, "HELD_CELLS", cells)
        splits, stages = trees.Grower._splits, []

        def counted(grower, keys, *others):
            group = f"level-{sums}-{cells}-{len(stages)}"
            context.setJobGroup(group, group)
            done = splits(grower, keys, *others)
            stages.append(max(len(context.statusTracker().getJobInfo(j).stageIds) for j in context.statusTracker().getJobIdsForGroup(group)))
            return done

        with monkeypatch.context() as patched:
            patched.setattr(trees.Grower, "_splits", counted)
            boosted = models.train_gbt(vectors, rounds=2, depth=3)
        shuffled.append(max(stages))
        found.append((ensemble(models.train_rf(vectors, trees=2, depth=4)), ensemble(boosted)))
    context.setJobGroup("tests", "tests")
    assert found[0] == found[1] == found[2]
    assert shuffled == [1, 2, 1]


def test_boosting_by_small_jobs_gives_the_same_trees_and_needs_no_shuffle(spark, monkeypatch):
    df = grid(spark)
    vectors = features.add_features(df, features.fit_features(df, ["f0", "f1", "f2", "f3"], []))
    context, found = spark.sparkContext, []
    for nodes, tasks, cells, margins in ((0, 1 << 13, 4_000_000, 10), (1024, 1 << 13, 4_000_000, 10), (1024, 100, 1, 2)):
        monkeypatch.setattr(trees, "KEPT_NODES", nodes)
        monkeypatch.setattr(trees, "TASK_ROWS", tasks)
        monkeypatch.setattr(trees, "HELD_CELLS", cells)
        monkeypatch.setattr(trees, "MARGIN_ROUNDS", margins)
        for options in ({"rounds": 5, "depth": 4}, {"rounds": 2, "depth": 3, "least_hessian": 60.0}, {"rounds": 2, "depth": 2, "rows_share": 0.0}):
            found.append(ensemble(models.train_gbt(vectors, **options)))
    assert found[:3] == found[3:6] == found[6:]
    prepared, edges, columns, parts = trees._prepared(vectors, "label", None, 1500)
    steps = trees._Rounds(columns, trees.Rules("boosted", 3, scale=1024.0), 1.0, 0.8, 0.8, 1)
    before = {j for j in context.statusTracker().getJobIdsForGroup("small-jobs")}
    context.setJobGroup("small-jobs", "small-jobs")
    nodes = trees._boosted_in_jobs(prepared, steps, 4, 2)
    jobs = set(context.statusTracker().getJobIdsForGroup("small-jobs")) - before
    context.setJobGroup("tests", "tests")
    assert {tree for tree, _ in nodes} == {0, 1, 2, 3} and len(jobs) < 4 * 4  # one for each level, no more for the margins
    assert all(len(context.statusTracker().getJobInfo(j).stageIds) == 1 for j in jobs)


def test_attributions_by_states_equal_those_by_leaves(spark):
    df = grid(spark)
    vectors = features.add_features(df, features.fit_features(df, ["f0", "f1", "f2", "f3"], []))
    x = np.array([r[0] for r in vectors.select(vector_to_array("features")).collect()])
    for depth in (0, 1, 3, 5):
        model = models.train_gbt(vectors, rounds=6, depth=depth, columns_share=1.0)
        states = explain.state_table(model)
        np.testing.assert_allclose(explain.state_attributions(states, x), explain.leaf_attributions(explain.leaf_table(model), x), atol=1e-12)
        # a subtree of up to four leaves is looked up once, where each leaf was integrated over
        assert states["codes"] == [] or len(states["groups"]) < explain.leaf_table(model)["feature"].size
    deep = models.train_gbt(vectors, rounds=2, depth=8, columns_share=1.0, least_hessian=0.1)
    assert max(len(tests) for tests, _ in explain._groups(deep)) <= explain.STATE_BITS or explain.state_table(deep) is None
    assert explain.shap_tree(vectors, deep).select("shap").count() == len(x)


def test_more_values_than_bins_and_equal_values(spark):
    rng = np.random.default_rng(1)
    values = np.stack([rng.random(3000), np.ones(3000), rng.integers(0, 3, 3000), np.where(rng.random(3000) < 0.9, 5.0, rng.random(3000))], axis=1)
    edges = trees.column_edges(values)
    assert [len(e) for e in edges[:3]] == [255, 0, 2] and 20 <= len(edges[3]) <= 255
    assert all((np.diff(e) > 0).all() and not np.isin(e, values[:, c]).any() for c, e in enumerate(edges))
    sizes = np.bincount(np.searchsorted(edges[0], values[:, 0], side="left"))
    assert sizes.min() >= 10 and sizes.max() <= 13


def test_training_rows_are_dealt_to_all_cores(spark, monkeypatch):
    vectors = features.add_features(df := grid(spark, 400), features.fit_features(df, ["f0"], []))
    blocks, *_ = trees._prepared(vectors.coalesce(1), "label", None, 400)
    assert blocks.count() >= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(trees, "BLOCK_ROWS", 10)
    blocks, *_, parts = trees._prepared(vectors.coalesce(1), "label", None, 400)
    assert parts == 40 and blocks.count() >= 30


def test_forests_respect_their_least_sizes(spark):
    df = grid(spark)
    vectors = features.add_features(df, features.fit_features(df, ["f0", "f1", "f2", "f3"], []))
    plain = models.train_rf(vectors, trees=1, depth=12, bootstrap=False, min_split=60, min_leaf=20, columns_share=1.0)
    x = np.array([r[0] for r in vectors.select(vector_to_array("features")).collect()])
    at = np.zeros(len(x), int)
    for _ in range(plain.depth):
        inner = plain.feature[at] >= 0
        low = x[np.arange(len(x)), np.maximum(plain.feature[at], 0)] <= plain.threshold[at]
        at = np.where(inner, np.where(low, plain.left[at], plain.right[at]), at)
    assert np.unique(at, return_counts=True)[1].min() >= 20
    labels = np.array([r[0] for r in vectors.select("label").collect()])
    weight = len(labels) / 2 / np.bincount(labels)
    for leaf in np.unique(at):
        p, q = weight[1] * labels[at == leaf].sum(), weight[0] * (1 - labels[at == leaf]).sum()
        assert plain.value[leaf] == pytest.approx(p / (p + q)) and plain.cover[leaf] == pytest.approx(p + q)


def test_one_request_gets_the_reasons_it_gets_in_a_batch(spark):
    from ebbline.plans.explain import answer_requests, attributions

    df = spark.range(200).selectExpr("cast(id as string) CustomerID", "cast(id % 40 as double) Tenure", "cast(id * 7 % 90 as double) MonthlyCharges").selectExpr("*", "cast(Tenure < 15 as int) label")
    fitted = features.fit_features(df, ["Tenure", "MonthlyCharges"], [])
    vectors = features.add_features(df, fitted)
    model, means = models.train_lr(vectors), explain.feature_means(vectors)
    requests = df.selectExpr("CustomerID AS customer_id", "Tenure AS tenure", "MonthlyCharges AS monthly_charges")
    many = answer_requests(requests.limit(100), fitted, model, "lr", key=["customer_id"], means=means)
    wanted = {r["customer_id"]: r["top_factors"] for r in many.collect()}
    (alone,) = answer_requests(requests.where("customer_id = '5'"), fitted, model, "lr", key=["customer_id"], means=means).collect()
    assert alone["top_factors"] and alone["top_factors"] == wanted[alone["customer_id"]]
    with pytest.raises(ValueError, match="training rows"):
        attributions(vectors, model)


def test_a_missing_number_takes_the_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (9.0,), (None,), (float("nan"),)], "Tenure double")
    fitted = features.fit_features(df.where("Tenure < 100"), ["Tenure"], [])
    found = [r["features"][0] for r in features.add_features(df, fitted).collect()]
    assert found[3] == found[4] == found[1]
