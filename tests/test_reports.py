import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.operators import distributions, eda, filters
from ebbline.operators import scores as score_ops
from ebbline.plans.eda import eda_all, key_findings

SCHEMA = "CustomerID string, Tenure int, LastLoginDays int, MonthlyCharges double, Contract string, Industry string, CompanySize string, Churn string"
ROWS = [
    ("1", 0, 0, 10.0, "One year", "Media", "Small (10-50)", "Yes"),
    ("2", 6, 3, 20.0, "One year", "Media", "Micro (<10)", "No"),
    ("3", 6, 61, 30.0, "Two year", "Other", "Small (10-50)", None),
    ("4", 73, 5, 40.0, "Two year", "Other", "Unheard of", "No"),
]


@pytest.fixture
def customers(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_overall_rate_counts_a_missing_label_as_kept(customers, rows):
    out = {r["churn"]: r for r in rows(eda.churn_overall(customers))}
    assert out["Yes"] == {"churn": "Yes", "customer_count": 1, "share_pct": 25.0, "churn_rate": 0.25}
    assert out["No"]["customer_count"] == 2


def test_bins_keep_empty_brackets(customers, rows):
    out = rows(eda.tenure_bins(customers).orderBy("bin_index"))
    assert [r["customer_count"] for r in out] == [1, 1, 0, 0, 0, 0, 0]
    assert [r["churn_rate"] for r in out] == [100.0, 0.0, None, None, None, None, None]
    # The row without a label is not counted but is part of the rate and the mean.
    assert out[1]["avg_monthly_charges"] == 25.0


def test_login_beyond_the_last_edge_is_left_out(customers):
    assert eda.login_bins(customers).agg(F.sum("customer_count")).first()[0] == 3


def test_company_sizes_in_order(customers, rows):
    assert [r["company_size"] for r in rows(eda.churn_by_company(customers))] == ["Micro (<10)", "Small (10-50)"]


def test_industries_by_size_then_name(spark, rows):
    df = spark.createDataFrame([(f"i{j:02d}", "No") for j in range(12)] + [("i05", "Yes")], "Industry string, Churn string")
    out = rows(eda.churn_by_industry(df))
    assert len(out) == 10 and out[0] == {"industry": "i05", "retained": 1, "churned": 1, "total": 2, "churn_rate": 50.0}
    assert [r["industry"] for r in out[1:3]] == ["i00", "i01"]


def test_reports_of_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    for name, report in eda_all(df).items():
        report.collect()
    assert key_findings(df).count() == 5


def test_histogram_counts_every_row(spark, rows):
    values = [0.0, 1.0, 1.5, 9.99, 10.0, None]
    out = rows(distributions.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", 10).orderBy("bin_index"))
    assert [r["n"] for r in out] == np.histogram([v for v in values if v is not None], 10)[0].tolist()
    flat = distributions.histogram(spark.createDataFrame([(5.0,)] * 3, "v double"), "v", 4)
    assert flat.agg(F.sum("n"), F.min("bin_start"), F.max("bin_end")).first()[:] == (3, 4.5, 5.5)


def test_density_integrates_to_one(spark):
    df = spark.range(400).selectExpr("cast(id % 17 as int) v", "if(id % 3 = 0, 'Yes', 'No') Churn")
    out = distributions.kde_by_label(df, "v").toPandas().sort_values(["churn", "point"])
    for label, part in out.groupby("churn"):
        assert len(part) == 200
        assert math.isclose(np.trapezoid(part["density"], part["x"]), 1.0, abs_tol=0.01)


def test_shared_summaries_change_nothing(spark, rows):
    df = spark.range(300).selectExpr(
        "cast(id as string) CustomerID", "cast(id % 23 as int) LastLoginDays", "cast(id % 71 as int) Tenure", "1D MonthlyCharges",
        "'a' Contract", "'b' Industry", "'Micro (<10)' CompanySize", "if(id % 3 = 0, 'Yes', 'No') Churn")
    together = eda_all(df)
    for name, alone in {
        "login_stats": eda.recency_stats(df), "tenure_histogram": distributions.histogram(df, "Tenure"),
        "login_density": distributions.kde_by_label(df, "LastLoginDays"), "tenure_box": distributions.box_stats(df, "Tenure"),
        "login_violin": distributions.violin_quartiles(df, "LastLoginDays"),
    }.items():
        first, second = sorted(map(str, rows(together[name]))), sorted(map(str, rows(alone)))
        assert first == second, name


def test_sample_is_the_same_for_any_partitioning(spark):
    df = spark.range(5000).selectExpr("cast(id as string) CustomerID")
    picks = [sorted(r[0] for r in distributions.sample_n(df.repartition(n), 100).collect()) for n in (1, 6)]
    assert picks[0] == picks[1] and len(set(picks[0])) == 100


# ── scores ──────────────────────────────────────────────────────────────────

USERS = [(1, 5, 10.0, "a", 1, 2), (2, 6, 20.0, "b", 2, 3), (3, 7, 30.0, "b", 3, 4)]
PREDICTIONS = [
    (1, "xgboost", 0.5, 1), (2, "xgboost", 0.9, 1), (2, "xgboost", 0.8, 1), (2, "random_forest", 0.1, 0),
    (-9, "xgboost", 0.99, 1),
]


@pytest.fixture
def store(spark):
    users = spark.createDataFrame(
        USERS, "customer_id bigint, tenure int, monthly_charges double, contract string, last_login_days int, support_tickets int")
    return users, spark.createDataFrame(PREDICTIONS, "customer_id bigint, model_name string, probability double, prediction int")


def test_the_threshold_itself(store):
    _, predictions = store
    xgb = predictions.where("model_name = 'xgboost'")
    assert filters.filter_risk(xgb, "probability", 0.5).count() == 4
    assert filters.filter_risk(xgb, "probability", 0.5, inclusive=False).count() == 3


def test_orphans_are_counted_but_not_joined(store, rows):
    users, predictions = store
    assert [r["customer_id"] for r in rows(score_ops.orphan_predictions(users, predictions))] == [-9]
    assert {r["customer_id"] for r in rows(score_ops.high_risk_join(users, predictions))} == {2}
    stats = {r["model_name"]: r for r in rows(score_ops.model_stats(predictions))}
    assert stats["xgboost"]["total"] == 4


def test_repeated_scores_do_not_multiply_users(store, rows):
    users, predictions = store
    out = {r["customer_id"]: r for r in rows(score_ops.scores_wide(users, predictions))}
    assert len(out) == 3
    assert (out[2]["xgb_churn_prob"], out[2]["rf_churn_prob"], out[2]["lr_churn_prob"]) == (0.9, 0.1, None)
    assert out[3]["xgb_churn_prob"] is None
    assert rows(score_ops.repeated_scores(predictions)) == [{"customer_id": 2, "model_name": "xgboost", "n": 2}]


def test_ranked_list_breaks_ties_by_id(store, rows):
    users, predictions = store
    more = predictions.unionByName(predictions.selectExpr("3 as customer_id", "model_name", "0.9 as probability", "prediction").limit(1))
    assert [r["customer_id"] for r in rows(score_ops.high_risk_topk(users, more, 2))] == [2, 3]


def test_risk_profile(store, rows):
    wide = score_ops.scores_wide(*store)
    assert rows(score_ops.risk_profile(wide)) == [{
        "high_risk": 2, "avg_tenure": 5.5, "avg_monthly": 15.0, "avg_login_gap": 1.5, "avg_tickets": 2.5, "top_contract": "a",
    }]
    nobody = rows(score_ops.risk_profile(wide, threshold=1.0))[0]
    assert nobody["high_risk"] == 0 and nobody["top_contract"] is None


def test_tenure_zero_has_no_bracket_on_the_dashboard(store):
    users, predictions = store
    wide = score_ops.scores_wide(users.withColumn("tenure", F.lit(0)), predictions)
    assert score_ops.prob_by_tenure(wide).agg(F.sum("customers")).first()[0] == 0


def test_long_form_skips_absent_models(spark):
    wide = spark.createDataFrame([("1", 0.2, 0)], "CustomerID string, lr_probability double, lr_prediction int")
    assert [tuple(r) for r in score_ops.scores_long(wide).collect()] == [("1", "logistic_regression", 0.2, 0)]
    with pytest.raises(ValueError):
        score_ops.scores_long(wide.select("CustomerID"))
