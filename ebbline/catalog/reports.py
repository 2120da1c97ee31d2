"""Segment, recency, tenure and distribution reports, and the reports over scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbline.catalog.base import (
    ORACLES, bins_case, customers, key_order, profile, query, read, rounded, scores, using, values_table, wide,
)
from ebbline.functions import roles
from ebbline.functions.scalar import bin_label
from ebbline.operators import distributions, eda, filters, profiling
from ebbline.operators import scores as score_ops
from ebbline.plans.eda import REPORT_KEYS, eda_all, eda_long, key_findings

# ── churn by segment ────────────────────────────────────────────────────────


@query("churn_overall", using("""
SELECT churn, COUNT(*) AS customer_count, ROUND(COUNT(*) * 100.0 / MAX(rows), 6) AS share_pct,
       ROUND(MAX(rate), 6) AS churn_rate
FROM profile, (SELECT COUNT(*) AS rows, AVG(CASE WHEN churn = 'Yes' THEN 1.0 ELSE 0.0 END) AS rate FROM profile)
GROUP BY churn""", "profile"))
def churn_overall(spark, sf_dir):
    return rounded(eda.churn_overall(customers(spark, sf_dir)))


_CROSSTAB = """SELECT {by}, COUNT(*) FILTER (WHERE churn = 'No') AS retained,
  COUNT(*) FILTER (WHERE churn = 'Yes') AS churned,
  ROUND(COUNT(*) FILTER (WHERE churn = 'No') * 100.0 / COUNT(*), 6) AS retained_pct,
  ROUND(COUNT(*) FILTER (WHERE churn = 'Yes') * 100.0 / COUNT(*), 6) AS churned_pct{more}
FROM profile GROUP BY {by}"""


@query("churn_by_contract", using(_CROSSTAB.format(by="contract", more=""), "profile"))
def churn_by_contract(spark, sf_dir):
    return rounded(eda.churn_by_contract(customers(spark, sf_dir)))


@query("churn_by_industry", using("""
SELECT industry, COUNT(*) FILTER (WHERE churn = 'No') AS retained, COUNT(*) FILTER (WHERE churn = 'Yes') AS churned,
  COUNT(*) AS total, ROUND(COUNT(*) FILTER (WHERE churn = 'Yes') * 100.0 / COUNT(*), 6) AS churn_rate
FROM profile GROUP BY industry ORDER BY total DESC, industry LIMIT 10""", "profile"))
def churn_by_industry(spark, sf_dir):
    return rounded(eda.churn_by_industry(customers(spark, sf_dir)))


_SIZE_RANK = "CASE company_size " + " ".join(
    f"WHEN '{size}' THEN {i}" for i, size in enumerate(roles.COMPANY_SIZES, 1)
) + " END"


@query("churn_by_company", using(
    _CROSSTAB.format(by="company_size", more=f",\n  CAST({_SIZE_RANK} AS BIGINT) AS size_rank"), "profile"))
def churn_by_company(spark, sf_dir):
    return rounded(eda.churn_by_company(customers(spark, sf_dir)))


_STATS = """
SELECT segment, ROUND(AVG(v), 6) AS mean, MEDIAN(v) AS median, ROUND(STDDEV_SAMP(v), 6) AS std, MIN(v) AS min, MAX(v) AS max
FROM (SELECT 'overall' AS segment, CAST({c} AS DOUBLE) AS v FROM profile
      UNION ALL SELECT 'churned', {c} FROM profile WHERE churn = 'Yes'
      UNION ALL SELECT 'retained', {c} FROM profile WHERE churn = 'No')
GROUP BY segment"""


@query("recency_stats", using(_STATS.format(c="last_login_days"), "profile"))
def recency_stats(spark, sf_dir):
    return rounded(eda.recency_stats(customers(spark, sf_dir)))


@query("tenure_stats", using(_STATS.format(c="tenure"), "profile"))
def tenure_stats(spark, sf_dir):
    return rounded(eda.tenure_stats(customers(spark, sf_dir)))


def _churn_bins(column: str, edges, labels, average: str) -> str:
    return using(f"""
SELECT b.bin_index, b.bin, COUNT(p.churn) AS customer_count, COUNT(*) FILTER (WHERE churn = 'Yes') AS churn_count,
  ROUND(AVG(CASE WHEN p.customer_id IS NULL THEN NULL WHEN churn = 'Yes' THEN 100.0 ELSE 0.0 END), 6) AS churn_rate,
  ROUND(AVG({average}), 6) AS {'avg_last_login' if column == 'last_login_days' else 'avg_monthly_charges'}
FROM bins b LEFT JOIN (SELECT *, {bins_case(column, edges)} AS bin_index FROM profile) p ON b.bin_index = p.bin_index
GROUP BY b.bin_index, b.bin""", "profile", extra=values_table("bins", labels))


@query("login_bins", _churn_bins("last_login_days", roles.LOGIN_EDGES, roles.LOGIN_LABELS, "last_login_days"))
def login_bins(spark, sf_dir):
    return rounded(eda.login_bins(customers(spark, sf_dir)))


@query("tenure_bins", _churn_bins("tenure", roles.TENURE_EDGES, roles.TENURE_LABELS, "monthly_charges"))
def tenure_bins(spark, sf_dir):
    return rounded(eda.tenure_bins(customers(spark, sf_dir)))


@query("bin_dimension_join", using(f"""
SELECT b.bin_index, b.bin, p.n FROM bins b LEFT JOIN (
  SELECT {bins_case('tenure', [0, 20, 40, 60, 80, 100, 120])} AS bin_index, COUNT(*) AS n FROM profile GROUP BY 1) p
ON b.bin_index = p.bin_index""", "profile", extra=values_table("bins", ["0", "20", "40", "60", "80", "100"])))
def bin_dimension_join(spark, sf_dir):
    labels = ["0", "20", "40", "60", "80", "100"]
    return eda.binned(
        customers(spark, sf_dir), "Tenure", [0, 20, 40, 60, 80, 100, 120], labels, [F.count(F.lit(1)).alias("n")]
    )


@query("binning", using(f"""
SELECT customer_id, tenure,
  (SELECT bin FROM bins WHERE bin_index = {bins_case('p.tenure', roles.TENURE_EDGES)}) AS left_closed,
  (SELECT bin FROM bins WHERE bin_index = {bins_case('p.tenure', roles.TENURE_EDGES, right=True)}) AS right_closed
FROM profile p""", "profile", extra=values_table("bins", roles.TENURE_LABELS)))
def binning(spark, sf_dir):
    tenure = F.col("tenure")
    return profile(spark, sf_dir).select(
        "customer_id", "tenure",
        bin_label(tenure, roles.TENURE_EDGES, roles.TENURE_LABELS).alias("left_closed"),
        bin_label(tenure, roles.TENURE_EDGES, roles.TENURE_LABELS, right=True).alias("right_closed"),
    )


@query("median_by_label", using(
    "SELECT churn, MEDIAN(CAST(last_login_days AS DOUBLE)) AS median FROM profile GROUP BY churn", "profile"))
def median_by_label(spark, sf_dir):
    return eda.median_by_label(customers(spark, sf_dir), "LastLoginDays")


@query("target_counts", using("SELECT churn AS label, COUNT(*) AS n FROM profile GROUP BY churn", "profile"))
def target_counts(spark, sf_dir):
    return profiling.target_counts(customers(spark, sf_dir))


@query("split_by_label", using("""
SELECT churn, COUNT(*) AS n, ROUND(AVG(tenure), 6) AS avg_tenure FROM profile GROUP BY churn""", "profile"))
def split_by_label(spark, sf_dir):
    churned, retained = filters.split_by_label(customers(spark, sf_dir))
    both = churned.unionByName(retained).groupBy(F.col("Churn").alias("churn"))
    return rounded(both.agg(F.count(F.lit(1)).alias("n"), F.avg("Tenure").alias("avg_tenure")))


_FINDINGS = """
SELECT finding, ROUND(value, 6) AS value FROM (
  SELECT 'churn_rate' AS finding, AVG(CASE WHEN churn = 'Yes' THEN 1.0 ELSE 0.0 END) AS value FROM profile
  UNION ALL SELECT 'churned_login_gap', AVG(last_login_days) FROM profile WHERE churn = 'Yes'
  UNION ALL SELECT 'retained_login_gap', AVG(last_login_days) FROM profile WHERE churn = 'No'
  UNION ALL SELECT 'churned_tenure', AVG(tenure) FROM profile WHERE churn = 'Yes'
  UNION ALL SELECT 'retained_tenure', AVG(tenure) FROM profile WHERE churn = 'No')"""


@query("key_findings", using(_FINDINGS, "profile"))
def findings(spark, sf_dir):
    return rounded(key_findings(customers(spark, sf_dir)))


# ── distributions ───────────────────────────────────────────────────────────


def _histogram(source: str, column: str, bins: int) -> str:
    return f"""ends AS (SELECT MIN(CAST({column} AS DOUBLE)) AS lo, (MAX(CAST({column} AS DOUBLE)) - MIN(CAST({column} AS DOUBLE))) / {bins} AS w FROM {source}),
counted AS (SELECT LEAST(CAST(FLOOR((CAST({column} AS DOUBLE) - lo) / w) AS INTEGER), {bins - 1}) AS i, COUNT(*) AS n
  FROM {source}, ends WHERE {column} IS NOT NULL GROUP BY 1),
slots AS (SELECT CAST(UNNEST(RANGE({bins})) AS INTEGER) AS i)"""


_HISTOGRAM_BODY = """
SELECT s.i AS bin_index, ROUND(lo + s.i * w, 6) AS bin_start, ROUND(lo + (s.i + 1) * w, 6) AS bin_end, COALESCE(c.n, 0) AS n
FROM ends, slots s LEFT JOIN counted c ON s.i = c.i"""


@query("histogram", using(_HISTOGRAM_BODY, "profile", extra=_histogram("profile", "last_login_days", 40)))
def histogram(spark, sf_dir):
    return rounded(distributions.histogram(customers(spark, sf_dir), "LastLoginDays"))


@query("histogram_probability", using(_HISTOGRAM_BODY, "wide", extra=_histogram("wide", "xgb_churn_prob", 50)))
def histogram_probability(spark, sf_dir):
    return rounded(distributions.histogram(wide(spark, sf_dir), "xgb_churn_prob", 50))


@query("histogram_lineitem", "WITH " + _histogram("lineitem", "l_extendedprice", 40) + _HISTOGRAM_BODY)
def histogram_lineitem(spark, sf_dir):
    return rounded(distributions.histogram(read(spark, sf_dir, "lineitem"), "l_extendedprice"))


def _density(column: str) -> str:
    return using(f"""
SELECT churn, CAST(i AS INTEGER) AS point, ROUND(start + i * step, 6) AS x,
  ROUND(SUM(EXP(-0.5 * POW((start + i * step - v) / h, 2))) / (MAX(n) * MAX(h) * SQRT(2 * PI())), 6) AS density
FROM grid JOIN (SELECT churn, CAST({column} AS DOUBLE) AS v FROM profile) USING (churn), RANGE(200) AS r(i)
GROUP BY churn, i, start, step""", "profile", extra=f"""
band AS (SELECT churn, COUNT(*) AS n, STDDEV_SAMP({column}) * POW(COUNT(*), -0.2) AS h,
  MIN({column}) AS lo, MAX({column}) AS hi FROM profile GROUP BY churn),
grid AS (SELECT churn, n, h, lo - 3 * h AS start, (hi + 3 * h - (lo - 3 * h)) / 199 AS step FROM band)""")


@query("kde_by_label", _density("last_login_days"))
def kde_by_label(spark, sf_dir):
    return rounded(distributions.kde_by_label(customers(spark, sf_dir), "LastLoginDays"))


_QUARTILES = """QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25) AS q25, QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5) AS q50,
  QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75) AS q75"""


def _violin(column: str) -> str:
    return using(f"SELECT churn, {_QUARTILES.format(c=column)} FROM profile GROUP BY churn", "profile")


@query("violin_quartiles", _violin("tenure"))
def violin_quartiles(spark, sf_dir):
    return distributions.violin_quartiles(customers(spark, sf_dir), "Tenure")


def _box(column: str) -> str:
    return using(f"""
SELECT q.churn, q25, q50, q75,
  MIN(v) FILTER (WHERE v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS whisker_low,
  MAX(v) FILTER (WHERE v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS whisker_high,
  COUNT(*) FILTER (WHERE v < q25 - 1.5 * (q75 - q25) OR v > q75 + 1.5 * (q75 - q25)) AS outliers
FROM q JOIN (SELECT churn, CAST({column} AS DOUBLE) AS v FROM profile) p ON q.churn = p.churn
GROUP BY q.churn, q25, q50, q75""", "profile",
        extra=f"q AS (SELECT churn, {_QUARTILES.format(c=column)} FROM profile GROUP BY churn)")


@query("box_stats", _box("last_login_days"))
def box_stats(spark, sf_dir):
    return distributions.box_stats(customers(spark, sf_dir), "LastLoginDays")


@query("sample_n", using("""
SELECT customer_id FROM profile ORDER BY (customer_id * 48271 + 42) % 2147483647, customer_id LIMIT 500""", "profile"))
def sample_n(spark, sf_dir):
    frame = profile(spark, sf_dir).select("customer_id")
    return distributions.sample_n(frame, 500, "customer_id", order=key_order("customer_id"))


@query("scatter_sample", using("""
SELECT tenure AS "Tenure", monthly_charges AS "MonthlyCharges", churn AS "Churn"
FROM profile ORDER BY (customer_id * 48271 + 42) % 2147483647, customer_id LIMIT 3000""", "profile"))
def scatter_sample(spark, sf_dir):
    return distributions.scatter_sample(customers(spark, sf_dir), order=key_order())


def _eda_sql() -> str:
    """The rows of every report, from the SQL of each."""
    bounds = {"login": "last_login_days", "tenure": "tenure"}
    sources = {
        "churn_overall": (ORACLES["churn_overall"], ["customer_count", "share_pct", "churn_rate"]),
        "churn_by_contract": (ORACLES["churn_by_contract"], ["retained", "churned", "retained_pct", "churned_pct"]),
        "churn_by_industry": (ORACLES["churn_by_industry"], ["retained", "churned", "total", "churn_rate"]),
        "churn_by_company": (ORACLES["churn_by_company"], ["retained", "churned", "retained_pct", "churned_pct", "size_rank"]),
        "login_stats": (ORACLES["recency_stats"], ["mean", "median", "std", "min", "max"]),
        "tenure_stats": (ORACLES["tenure_stats"], ["mean", "median", "std", "min", "max"]),
        "login_bins": (ORACLES["login_bins"], ["customer_count", "churn_count", "churn_rate", "avg_last_login"]),
        "tenure_bins": (ORACLES["tenure_bins"], ["customer_count", "churn_count", "churn_rate", "avg_monthly_charges"]),
        "tenure_vs_charges": (ORACLES["scatter_sample"], ["Tenure", "MonthlyCharges"]),
    }
    for name, column in bounds.items():
        sources[f"{name}_histogram"] = using(_HISTOGRAM_BODY, "profile", extra=_histogram("profile", column, 40)), ["bin_start", "bin_end", "n"]
        sources[f"{name}_density"] = _density(column), ["x", "density"]
        sources[f"{name}_box"] = _box(column), ["q25", "q50", "q75", "whisker_low", "whisker_high", "outliers"]
        sources[f"{name}_violin"] = _violin(column), ["q25", "q50", "q75"]
    parts = []
    for name, (sql, measures) in sources.items():
        item = " || '|' || ".join(f'CAST("{k}" AS VARCHAR)' for k in REPORT_KEYS[name])
        rows = ", ".join(f"{{'measure': '{m}', 'value': ROUND(CAST(\"{m}\" AS DOUBLE), 6)}}" for m in measures)
        parts.append(f"SELECT '{name}' AS report, {item} AS item, UNNEST([{rows}], recursive := true) FROM ({sql})")
    return "\nUNION ALL\n".join(parts)


@query("eda_all", _eda_sql())
def eda_everything(spark, sf_dir):
    return rounded(eda_long(eda_all(customers(spark, sf_dir), order=key_order())))


# ── scores ──────────────────────────────────────────────────────────────────


@query("scores_long", using("SELECT customer_id, model_name, probability, prediction FROM scores", "scores"))
def scores_long(spark, sf_dir):
    from ebbline.sources.orders_profile import formula_scores_wide

    return score_ops.scores_long(formula_scores_wide(profile(spark, sf_dir)), "customer_id")


@query("scores_wide", using("SELECT * FROM wide", "wide"))
def scores_wide(spark, sf_dir):
    return wide(spark, sf_dir)


_TWICE = """scored AS (SELECT * FROM scores UNION ALL SELECT customer_id, model_name, probability / 2, 0 FROM scores WHERE customer_id % 20 = 0),
strict AS (SELECT u.*, x.probability AS xgb_churn_prob, x.prediction AS xgb_pred, l.probability AS lr_churn_prob, r.probability AS rf_churn_prob
  FROM profile u LEFT JOIN scored x ON u.customer_id = x.customer_id AND x.model_name = 'xgboost'
  LEFT JOIN scored l ON u.customer_id = l.customer_id AND l.model_name = 'logistic_regression'
  LEFT JOIN scored r ON u.customer_id = r.customer_id AND r.model_name = 'random_forest')"""


@query("scores_wide_strict", using("SELECT * FROM strict", "scores", extra=_TWICE))
def scores_wide_strict(spark, sf_dir):
    """One customer in twenty has two scores of each model, and so eight rows."""
    plain = scores(spark, sf_dir)
    again = plain.where("customer_id % 20 = 0").withColumns({"probability": F.col("probability") / 2, "prediction": F.lit(0)})
    return score_ops.scores_wide(profile(spark, sf_dir), plain.unionByName(again), strict=True)


@query("attach_profile", using("""
SELECT s.customer_id, model_name, probability, contract, tenure
FROM scores s LEFT JOIN profile p ON s.customer_id = p.customer_id""", "scores"))
def attach_profile(spark, sf_dir):
    joined = score_ops.attach_profile(
        scores(spark, sf_dir), profile(spark, sf_dir), ["contract", "tenure", "not_there"], "customer_id"
    )
    return joined.select("customer_id", "model_name", "probability", "contract", "tenure")


@query("high_risk_join", using("""
SELECT u.customer_id, u.tenure, u.monthly_charges, u.contract, u.last_login_days, p.model_name, p.probability
FROM profile u JOIN scores p ON u.customer_id = p.customer_id WHERE p.model_name = 'xgboost' AND p.probability > 0.5
""", "scores"))
def high_risk_join(spark, sf_dir):
    return score_ops.high_risk_join(profile(spark, sf_dir), scores(spark, sf_dir))


@query("high_risk_topk", using("""
SELECT u.customer_id, u.tenure, u.monthly_charges, u.contract, u.last_login_days, p.model_name,
  ROUND(p.probability, 4) AS churn_probability
FROM profile u JOIN scores p ON u.customer_id = p.customer_id WHERE p.model_name = 'xgboost' AND p.probability > 0.5
ORDER BY p.probability DESC, u.customer_id LIMIT 10""", "scores"))
def high_risk_topk(spark, sf_dir):
    return score_ops.high_risk_topk(profile(spark, sf_dir), scores(spark, sf_dir))


_ORPHANS = """mixed AS (
  SELECT CASE WHEN customer_id % 7 = 0 THEN -customer_id - 1 ELSE customer_id END AS customer_id, model_name, probability,
         prediction FROM scores)"""


@query("orphan_predictions", using("""
SELECT * FROM mixed m WHERE NOT EXISTS (SELECT 1 FROM profile p WHERE p.customer_id = m.customer_id)""",
    "scores", extra=_ORPHANS))
def orphan_predictions(spark, sf_dir):
    key = F.col("customer_id")
    mixed = scores(spark, sf_dir).withColumn("customer_id", F.when(key % 7 == 0, -key - 1).otherwise(key))
    return score_ops.orphan_predictions(profile(spark, sf_dir), mixed)


@query("repeated_scores", using("""
SELECT customer_id, model_name, COUNT(*) AS n FROM (
  SELECT customer_id, model_name FROM scores UNION ALL SELECT customer_id, model_name FROM scores WHERE probability > 0.5)
GROUP BY 1, 2 HAVING COUNT(*) > 1""", "scores"))
def repeated_scores(spark, sf_dir):
    frame = scores(spark, sf_dir)
    return score_ops.repeated_scores(frame.unionByName(frame.where("probability > 0.5")))


@query("model_stats", using("""
SELECT model_name, COUNT(*) AS total, CAST(SUM(prediction) AS BIGINT) AS predicted_churn,
  ROUND(AVG(probability), 4) AS avg_prob, ROUND(SUM(prediction) * 100.0 / COUNT(*), 6) AS churn_pct
FROM scores GROUP BY model_name""", "scores"))
def model_stats(spark, sf_dir):
    return rounded(score_ops.model_stats(scores(spark, sf_dir)))


@query("store_stats", using("""
SELECT 'total_users' AS name, COUNT(*) AS value FROM profile
UNION ALL SELECT 'total_models', COUNT(DISTINCT model_name) FROM scores""", "scores"))
def store_stats(spark, sf_dir):
    return score_ops.store_stats(profile(spark, sf_dir), scores(spark, sf_dir))


@query("kpi_overview", using("""
SELECT COUNT(*) AS total_customers, COUNT(*) FILTER (WHERE xgb_pred = 1) AS predicted_churn,
  ROUND(COUNT(*) FILTER (WHERE xgb_pred = 1) / COUNT(*), 6) AS predicted_share,
  ROUND(AVG(xgb_churn_prob), 6) AS avg_probability, 3 AS models_deployed FROM wide""", "wide"))
def kpi_overview(spark, sf_dir):
    return rounded(score_ops.kpi_overview(wide(spark, sf_dir)))


@query("kpi_filtered", using("""
SELECT COUNT(*) AS customers, COUNT(*) FILTER (WHERE lr_churn_prob >= 0.45) AS high_risk,
  ROUND(AVG(lr_churn_prob), 6) AS avg_probability FROM wide WHERE contract = 'One year'""", "wide"))
def kpi_filtered(spark, sf_dir):
    return rounded(score_ops.kpi_filtered(wide(spark, sf_dir), "One year", 0.45, "logistic_regression"))


@query("risk_profile", using("""
SELECT CAST(COUNT(*) AS BIGINT) AS high_risk, ROUND(AVG(tenure), 6) AS avg_tenure, ROUND(AVG(monthly_charges), 6) AS avg_monthly,
  ROUND(AVG(last_login_days), 6) AS avg_login_gap, ROUND(AVG(support_tickets), 6) AS avg_tickets,
  (SELECT contract FROM risky GROUP BY contract ORDER BY COUNT(*) DESC, contract LIMIT 1) AS top_contract,
  ROUND(AVG(CASE WHEN ticket_sentiment < 0 THEN 1.0 ELSE 0.0 END), 6) AS negative_sentiment_share
FROM risky""", "wide", extra="""risky AS (
  SELECT *, (support_tickets % 5 - 2) / 4.0 AS ticket_sentiment FROM wide WHERE xgb_churn_prob >= 0.45)"""))
def risk_profile(spark, sf_dir):
    frame = wide(spark, sf_dir).withColumn("ticket_sentiment", (F.col("support_tickets") % 5 - 2) / 4)
    return rounded(score_ops.risk_profile(frame, threshold=0.45))


@query("prob_by_contract", using("""
SELECT contract, ROUND(AVG(xgb_churn_prob), 6) AS avg_probability, GROUPING(contract) = 1 AS overall
FROM wide GROUP BY ROLLUP (contract)""", "wide"))
def prob_by_contract(spark, sf_dir):
    return rounded(score_ops.prob_by_contract(wide(spark, sf_dir)))


@query("prob_by_tenure", using(f"""
SELECT b.bin_index, b.bin, ROUND(AVG(xgb_churn_prob), 6) AS avg_probability, COUNT(w.customer_id) AS customers
FROM bins b LEFT JOIN (SELECT *, {bins_case('tenure', roles.TENURE_EDGES, right=True)} AS i FROM wide) w ON b.bin_index = w.i
GROUP BY b.bin_index, b.bin""", "wide", extra=values_table("bins", roles.TENURE_LABELS)))
def prob_by_tenure(spark, sf_dir):
    return rounded(score_ops.prob_by_tenure(wide(spark, sf_dir)))


@query("high_risk_table", using("""
SELECT customer_id, tenure, monthly_charges, contract, last_login_days, support_tickets, rf_churn_prob
FROM wide WHERE rf_churn_prob >= 0.4 AND contract = 'Two year' ORDER BY rf_churn_prob DESC, customer_id LIMIT 50""", "wide"))
def high_risk_table(spark, sf_dir):
    return score_ops.high_risk_table(wide(spark, sf_dir), "Two year", 0.4, "random_forest")


@query("raw_table", using("SELECT * FROM wide ORDER BY xgb_churn_prob DESC, customer_id LIMIT 200", "wide"))
def raw_table(spark, sf_dir):
    return score_ops.raw_table(wide(spark, sf_dir))


@query("filter_contract", using("SELECT * FROM wide WHERE contract = 'Month-to-month'", "wide"))
def filter_contract(spark, sf_dir):
    return filters.filter_contract(wide(spark, sf_dir), "Month-to-month")


@query("filter_risk", using("SELECT customer_id, xgb_churn_prob FROM wide WHERE xgb_churn_prob >= 0.5", "wide"))
def filter_risk(spark, sf_dir):
    return filters.filter_risk(wide(spark, sf_dir), "xgb_churn_prob").select("customer_id", "xgb_churn_prob")


@query("distinct_sorted", using("SELECT DISTINCT contract FROM profile WHERE contract IS NOT NULL ORDER BY contract", "profile"))
def distinct_sorted(spark, sf_dir):
    return filters.distinct_sorted(profile(spark, sf_dir), "contract")
