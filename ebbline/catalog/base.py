"""Registration, shared inputs and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.operators.scores import scores_wide
from ebbline.operators.shape import rename_camel
from ebbline.session import staged
from ebbline.sources import orders_profile

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Floating-point columns to a fixed number of digits: sums may differ in their last bits."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in doubles})


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# The profile is the processed-zone table of all reports: written once per
# application and input folder, then read by every query that needs it.
_shared: dict[tuple[str, str, str], DataFrame] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _shared:
        _shared[key] = staged(build(), name)
    return _shared[key]


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "profile", lambda: orders_profile.profile(spark, sf_dir))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile under the customer table's own column names."""
    return rename_camel(profile(spark, sf_dir))


def dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename_camel(orders_profile.dirty(profile(spark, sf_dir)))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_profile.formula_scores(profile(spark, sf_dir))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_wide(profile(spark, sf_dir), scores(spark, sf_dir))


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer_id, label, model_name, probability, prediction)."""
    labels = profile(spark, sf_dir).select("customer_id", (F.col("churn") == "Yes").cast("int").alias("label"))
    return scores(spark, sf_dir).join(labels, "customer_id")


def key_order(column: str = "CustomerID"):
    """A scrambled order that other engines can compute: a product modulo the prime 2^31 - 1."""
    return F.pmod(F.col(column).cast("bigint") * 48271 + 42, F.lit(2147483647))


# ── SQL ─────────────────────────────────────────────────────────────────────

_PROFILE = """
ret AS (SELECT l_orderkey, COUNT(*) AS n_ret FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey),
ord AS (
  SELECT o_custkey, o_orderdate, o_orderpriority, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents,
         COALESCE(n_ret, 0) AS n_ret, o_orderdate < TIMESTAMP '2001-02-02 00:00:00' AS past
  FROM orders LEFT JOIN ret ON o_orderkey = l_orderkey),
agg AS (
  SELECT o_custkey, COUNT(*) FILTER (WHERE past) AS n_orders,
         MIN(o_orderdate) FILTER (WHERE past) AS first_dt, MAX(o_orderdate) FILTER (WHERE past) AS last_dt,
         CAST(SUM(cents) FILTER (WHERE past) AS BIGINT) AS cents,
         CAST(COALESCE(SUM(n_ret) FILTER (WHERE past), 0) AS INTEGER) AS n_ret,
         COUNT(*) FILTER (WHERE past AND o_orderpriority = '1-URGENT') AS n_urgent,
         CAST(COUNT(DISTINCT o_orderpriority) FILTER (WHERE past) AS INTEGER) AS n_prio,
         COUNT(*) FILTER (WHERE NOT past) AS n_after
  FROM ord GROUP BY o_custkey),
part_profile AS (
  SELECT agg.*, CAST(YEAR(last_dt) * 12 + MONTH(last_dt) - YEAR(first_dt) * 12 - MONTH(first_dt) AS INTEGER) AS tenure,
         (2 * cents + n_orders * 1000) // (2 * n_orders * 1000) AS monthly
  FROM agg WHERE n_orders > 0),
profile AS (
  SELECT CAST(c_custkey AS BIGINT) AS customer_id, c_mktsegment AS industry,
    CASE WHEN c_acctbal < 0 THEN 'Micro (<10)' WHEN c_acctbal < 2500 THEN 'Small (10-50)'
         WHEN c_acctbal < 5000 THEN 'Medium (51-250)' WHEN c_acctbal < 7500 THEN 'Large (251-1000)'
         ELSE 'Enterprise (1000+)' END AS company_size,
    CASE WHEN n_orders < 8 THEN 'Month-to-month' WHEN n_orders < 11 THEN 'One year' ELSE 'Two year' END AS contract,
    tenure, CAST(monthly AS DOUBLE) / 100 AS monthly_charges,
    CAST(CASE WHEN c_custkey % 10 = 0 THEN (2 * cents + 1000) // 2000 ELSE monthly * tenure END AS DOUBLE) / 100
      AS total_charges,
    n_ret AS support_tickets,
    CAST(24014 - (YEAR(last_dt) * 12 + MONTH(last_dt)) AS INTEGER) AS last_login_days,
    n_prio AS feature_usage_count,
    CASE WHEN n_regionkey IN (0, 1) THEN 'Yes' ELSE 'No' END AS partner,
    CASE WHEN n_urgent > 0 THEN 'Yes' ELSE 'No' END AS paperless_billing,
    CASE WHEN n_after = 0 THEN 'Yes' ELSE 'No' END AS churn
  FROM customer JOIN part_profile ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""

_DIRTY = """
dirty AS (
  SELECT customer_id, industry, CASE WHEN customer_id % 41 <> 0 THEN company_size END AS company_size, contract, tenure,
    CASE WHEN customer_id % 37 <> 0 THEN monthly_charges END AS monthly_charges,
    CASE WHEN customer_id % 53 <> 0 THEN total_charges END AS total_charges,
    CASE WHEN customer_id % 97 = 0 THEN 500 ELSE support_tickets END AS support_tickets,
    last_login_days, feature_usage_count, partner, paperless_billing, churn
  FROM profile
  UNION ALL
  SELECT customer_id + 1000000, industry, company_size, contract, tenure, monthly_charges, total_charges,
    support_tickets, last_login_days, feature_usage_count, partner, paperless_billing, churn
  FROM profile WHERE customer_id % 29 = 0)"""

_SCORES = """
scores AS (
  SELECT customer_id, model_name, probability, CAST(probability >= 0.5 AS INTEGER) AS prediction
  FROM (SELECT customer_id, m.model_name,
          ROUND(1 / (1 + EXP(-(m.b + 0.02::DOUBLE * last_login_days - 0.015::DOUBLE * tenure
            + 0.03::DOUBLE * support_tickets))), 4) AS probability
        FROM profile CROSS JOIN (VALUES ('logistic_regression', 0.1::DOUBLE), ('random_forest', 0.0::DOUBLE),
          ('xgboost', -0.1::DOUBLE)) AS m(model_name, b)))"""

_WIDE = """
wide AS (
  SELECT u.*, x.probability AS xgb_churn_prob, x.prediction AS xgb_pred, l.probability AS lr_churn_prob,
         r.probability AS rf_churn_prob
  FROM profile u
  LEFT JOIN scores x ON u.customer_id = x.customer_id AND x.model_name = 'xgboost'
  LEFT JOIN scores l ON u.customer_id = l.customer_id AND l.model_name = 'logistic_regression'
  LEFT JOIN scores r ON u.customer_id = r.customer_id AND r.model_name = 'random_forest')"""

_LABELLED = """
labelled AS (
  SELECT s.customer_id, CAST(p.churn = 'Yes' AS INTEGER) AS label, model_name, probability, prediction
  FROM scores s JOIN profile p ON s.customer_id = p.customer_id)"""

_BLOCKS = {"profile": _PROFILE, "dirty": _DIRTY, "scores": _SCORES, "wide": _WIDE, "labelled": _LABELLED}
_NEEDS = {
    "profile": [], "dirty": ["profile"], "scores": ["profile"], "wide": ["profile", "scores"],
    "labelled": ["profile", "scores"],
}

CAMEL = {
    "customer_id": "CustomerID", "industry": "Industry", "company_size": "CompanySize", "contract": "Contract",
    "tenure": "Tenure", "monthly_charges": "MonthlyCharges", "total_charges": "TotalCharges",
    "support_tickets": "SupportTickets", "last_login_days": "LastLoginDays",
    "feature_usage_count": "FeatureUsageCount", "partner": "Partner", "paperless_billing": "PaperlessBilling",
    "churn": "Churn",
}


def camel_list(**changed: str) -> str:
    """The profile columns under their customer-table names; some replaced by an expression."""
    return ", ".join(f'{changed.get(low, low)} AS "{name}"' for low, name in CAMEL.items() if changed.get(low) != "")


def using(body: str, *tables: str, extra: str = "") -> str:
    """``body`` after the definitions of the tables it names; ``extra`` adds further definitions."""
    wanted: list[str] = []
    for table in tables:
        for needed in [*_NEEDS[table], table]:
            if needed not in wanted:
                wanted.append(needed)
    blocks = [_BLOCKS[t] for t in wanted]
    if extra:
        blocks.append("\n" + extra.strip())
    return "WITH" + ",".join(blocks) + "\n" + body.strip()


def bins_case(column: str, edges: list[float], right: bool = False) -> str:
    cases = []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        test = f"{column} > {low} AND {column} <= {high}" if right else f"{column} >= {low} AND {column} < {high}"
        cases.append(f"WHEN {test} THEN {i}")
    return f"CASE {' '.join(cases)} END"


def values_table(name: str, labels: list[str]) -> str:
    rows = ", ".join("({}, '{}')".format(i, label.replace("'", "''")) for i, label in enumerate(labels))
    return f"{name}(bin_index, bin) AS (VALUES {rows})"
