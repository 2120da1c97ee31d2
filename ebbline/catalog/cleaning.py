"""Cleaning steps, duplicates, profiles and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbline.catalog.base import CAMEL, camel_list, customers, dirty_customers, profile, query, read, rounded, shared, using
from ebbline.functions.scalar import clip
from ebbline.operators import cleaning, dedup, filters, profiling
from ebbline.plans.cleaning import clean_table

_NUM = ["tenure", "monthly_charges", "total_charges", "support_tickets", "last_login_days", "feature_usage_count"]
_TEXT = ["industry", "company_size", "contract", "partner", "paperless_billing"]
_FENCED = ["monthly_charges", "support_tickets", "last_login_days", "feature_usage_count"]


def _mode(column: str, source: str) -> str:
    return (
        f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} "
        f"ORDER BY COUNT(*) DESC, {column} LIMIT 1)"
    )


_FILLED = {
    "company_size": f"COALESCE(company_size, {_mode('company_size', 'dirty')})",
    "monthly_charges": "COALESCE(monthly_charges, (SELECT MEDIAN(monthly_charges) FROM dirty))",
    "total_charges": "COALESCE(total_charges, (SELECT MEDIAN(total_charges) FROM dirty))",
}


@query("impute_numeric", using(
    "SELECT " + camel_list(**{k: v for k, v in _FILLED.items() if k != "company_size"}) + " FROM dirty", "dirty"))
def impute_numeric(spark, sf_dir):
    frame = dirty_customers(spark, sf_dir)
    return cleaning.impute_numeric(frame, ["MonthlyCharges", "TotalCharges"])


@query("impute_numeric_mean", using("""
SELECT customer_id AS "CustomerID",
  ROUND(COALESCE(monthly_charges, (SELECT AVG(monthly_charges) FROM dirty)), 6) AS "MonthlyCharges" FROM dirty""", "dirty"))
def impute_numeric_mean(spark, sf_dir):
    frame = dirty_customers(spark, sf_dir)
    return rounded(cleaning.impute_numeric(frame, ["MonthlyCharges"], "mean").select("CustomerID", "MonthlyCharges"))


@query("impute_categorical", using(
    f'SELECT customer_id AS "CustomerID", {_FILLED["company_size"]} AS "CompanySize" FROM dirty', "dirty"))
def impute_categorical(spark, sf_dir):
    return cleaning.impute_categorical(dirty_customers(spark, sf_dir)).select("CustomerID", "CompanySize")


@query("impute_categorical_label", using(
    "SELECT customer_id AS \"CustomerID\", COALESCE(company_size, 'Missing') AS \"CompanySize\" FROM dirty", "dirty"))
def impute_categorical_label(spark, sf_dir):
    frame = cleaning.impute_categorical(dirty_customers(spark, sf_dir), strategy="missing_label")
    return frame.select("CustomerID", "CompanySize")


@query("missing_report", using(
    " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", COUNT(*) FILTER (WHERE {low} IS NULL) AS missing_before, CAST(0 AS BIGINT) AS missing_after FROM dirty"
        for low, name in CAMEL.items()
    ), "dirty"))
def missing_report(spark, sf_dir):
    frame = dirty_customers(spark, sf_dir)
    return cleaning.missing_report(frame, cleaning.impute(frame))


@query("drop_null_keys", using("""
SELECT customer_id AS "CustomerID", CASE WHEN customer_id % 31 <> 0 THEN churn END AS "Churn"
FROM profile WHERE customer_id % 31 <> 0""", "profile"))
def drop_null_keys(spark, sf_dir):
    frame = customers(spark, sf_dir).select(
        "CustomerID", F.when(F.col("CustomerID") % 31 != 0, F.col("Churn")).alias("Churn")
    )
    return filters.drop_null_keys(frame)


# ── duplicates ──────────────────────────────────────────────────────────────

_REST = ", ".join(low for low in CAMEL if low != "customer_id")


@query("dedup", using(
    "SELECT " + camel_list() + f" FROM (SELECT MIN(customer_id) AS customer_id, {_REST} FROM dirty GROUP BY {_REST})", "dirty"))
def dedup_first(spark, sf_dir):
    return dedup.dedup(dirty_customers(spark, sf_dir))


_BY = "contract, industry, support_tickets, last_login_days"
_PICKED = ["CustomerID", "Tenure", "Contract", "Industry", "SupportTickets", "LastLoginDays"]


def _window(order: str, keep: str) -> str:
    shown = ", ".join(f'{low} AS "{CAMEL[low]}"' for low in CAMEL if CAMEL[low] in _PICKED)
    return (
        f"SELECT {shown} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_BY} ORDER BY customer_id {order}) AS rn, "
        f"COUNT(*) OVER (PARTITION BY {_BY}) AS n FROM dirty) WHERE {keep}"
    )


_SUBSET = ["Contract", "Industry", "SupportTickets", "LastLoginDays"]


@query("dedup_last", using(_window("DESC", "rn = 1"), "dirty"))
def dedup_last(spark, sf_dir):
    return dedup.dedup(dirty_customers(spark, sf_dir).select(*_PICKED), _SUBSET, "last")


@query("dedup_none", using(_window("ASC", "n = 1"), "dirty"))
def dedup_none(spark, sf_dir):
    return dedup.dedup(dirty_customers(spark, sf_dir).select(*_PICKED), _SUBSET, False)


@query("dedup_report", using(f"""
SELECT CAST(SUM(n) AS BIGINT) AS rows, COUNT(*) FILTER (WHERE n > 1) AS groups,
  CAST(SUM(n) FILTER (WHERE n > 1) AS BIGINT) AS members, CAST(SUM(n - 1) FILTER (WHERE n > 1) AS BIGINT) AS removed
FROM (SELECT COUNT(*) AS n FROM dirty GROUP BY {_BY})""", "dirty"))
def dedup_report(spark, sf_dir):
    return dedup.dedup_report(dirty_customers(spark, sf_dir), _SUBSET)


# ── outliers and charges ────────────────────────────────────────────────────


def _bounds(columns: list[str], source: str, names: dict[str, str]) -> str:
    parts = [
        f"SELECT '{names.get(c, c)}' AS \"column\", q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper, "
        f"(SELECT COUNT(*) FROM {source} WHERE {c} < q1 - 1.5 * (q3 - q1)) AS below, "
        f"(SELECT COUNT(*) FROM {source} WHERE {c} > q3 + 1.5 * (q3 - q1)) AS above "
        f"FROM (SELECT QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25) AS q1, QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source})"
        for c in columns
    ]
    inner = " UNION ALL ".join(parts)
    return (
        f'SELECT "column", ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3, ROUND(lower, 6) AS lower, ROUND(upper, 6) AS upper, '
        f"below, above FROM ({inner})"
    )


@query("iqr_bounds", using(_bounds(_FENCED, "dirty", CAMEL), "dirty"))
def iqr_bounds(spark, sf_dir):
    return rounded(cleaning.iqr_bounds(dirty_customers(spark, sf_dir)))


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("iqr_bounds_lineitem", _bounds(_LINE, "lineitem", {}))
def iqr_bounds_lineitem(spark, sf_dir):
    return rounded(cleaning.iqr_bounds(read(spark, sf_dir, "lineitem"), _LINE))


def _fences(source: str) -> str:
    cols = ", ".join(
        f"QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25) AS {c}_q1, QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75) AS {c}_q3" for c in _FENCED
    )
    bounds = ", ".join(
        f"{c}_q1 - 1.5 * ({c}_q3 - {c}_q1) AS {c}_lo, {c}_q3 + 1.5 * ({c}_q3 - {c}_q1) AS {c}_hi" for c in _FENCED
    )
    return f"fences AS (SELECT {bounds} FROM (SELECT {cols} FROM {source}))"


_CAPPED = {
    c: f"CASE WHEN {c} < {c}_lo THEN {c}_lo WHEN {c} > {c}_hi THEN {c}_hi ELSE CAST({c} AS DOUBLE) END" for c in _FENCED
}
_IN_ORDER = [(low, name) for low, name in CAMEL.items()]


@query("outlier_cap", using(
    'SELECT customer_id AS "CustomerID", ' + ", ".join(f'ROUND({_CAPPED[c]}, 6) AS "{CAMEL[c]}"' for c in _FENCED)
    + " FROM dirty, fences", "dirty", extra=_fences("dirty")))
def outlier_cap(spark, sf_dir):
    capped = cleaning.outlier_cap(dirty_customers(spark, sf_dir))
    return rounded(capped.select("CustomerID", *[CAMEL[c] for c in _FENCED]))


@query("outlier_flag", using(
    'SELECT customer_id AS "CustomerID", ' + ", ".join(
        f'CAST(COALESCE({c} < {c}_lo OR {c} > {c}_hi, FALSE) AS INTEGER) AS "{CAMEL[c]}_outlier"' for c in _FENCED
    ) + " FROM dirty, fences", "dirty", extra=_fences("dirty")))
def outlier_flag(spark, sf_dir):
    flagged = cleaning.outlier_flag(dirty_customers(spark, sf_dir))
    return flagged.select("CustomerID", *[f"{CAMEL[c]}_outlier" for c in _FENCED])


_WRONG = """CASE WHEN total_charges IS NULL OR monthly_charges * tenure IS NULL THEN TRUE
  WHEN GREATEST(ABS(total_charges), ABS(monthly_charges * tenure)) = 0 THEN FALSE
  ELSE ABS(total_charges - monthly_charges * tenure) / GREATEST(ABS(total_charges), ABS(monthly_charges * tenure)) > 0.05 END"""
_FIXED = f"CASE WHEN {_WRONG} THEN ROUND(monthly_charges * tenure, 2) ELSE total_charges END"


@query("charges_fix", using(f"""
SELECT customer_id AS "CustomerID", tenure AS "Tenure", monthly_charges AS "MonthlyCharges", {_FIXED} AS "TotalCharges"
FROM dirty""", "dirty"))
def charges_fix(spark, sf_dir):
    fixed = cleaning.charges_fix(dirty_customers(spark, sf_dir))
    return fixed.select("CustomerID", "Tenure", "MonthlyCharges", "TotalCharges")


@query("charges_report", using(f"""
SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE wrong) AS inconsistent, COUNT(*) FILTER (WHERE fresh) AS new_but_charged,
  COUNT(*) FILTER (WHERE wrong AND NOT fresh) AS deviating
FROM (SELECT {_WRONG} AS wrong, COALESCE(tenure = 0 AND total_charges > 0, FALSE) AS fresh FROM dirty)""", "dirty"))
def charges_report(spark, sf_dir):
    return cleaning.charges_report(dirty_customers(spark, sf_dir))


@query("clip", using("""
SELECT customer_id, CASE WHEN monthly_charges < 200 THEN 200.0 WHEN monthly_charges > 300 THEN 300.0
  ELSE monthly_charges END AS clipped FROM dirty""", "dirty"))
def clipped(spark, sf_dir):
    frame = dirty_customers(spark, sf_dir)
    return frame.select(F.col("CustomerID").alias("customer_id"), clip(F.col("MonthlyCharges"), 200.0, 300.0).alias("clipped"))


# ── the whole job ───────────────────────────────────────────────────────────

_CLEAN = f"""
filled AS (SELECT customer_id, {', '.join(f'{_FILLED.get(c, c)} AS {c}' for c in CAMEL if c != 'customer_id')} FROM dirty),
uniq AS (SELECT MIN(customer_id) AS customer_id, {_REST} FROM filled GROUP BY {_REST}),
{_fences('uniq')},
capped AS (SELECT customer_id, {', '.join(f'{_CAPPED.get(c, c)} AS {c}' for c in CAMEL if c != 'customer_id')}
  FROM uniq, fences),
cleaned AS (SELECT customer_id, industry, company_size, contract, CAST(TRUNC(tenure) AS INTEGER) AS tenure, monthly_charges,
  {_FIXED} AS total_charges, CAST(TRUNC(support_tickets) AS INTEGER) AS support_tickets,
  CAST(TRUNC(last_login_days) AS INTEGER) AS last_login_days,
  CAST(TRUNC(feature_usage_count) AS INTEGER) AS feature_usage_count, partner, paperless_billing, churn FROM capped)"""


def cleaned(spark, sf_dir):
    return shared(spark, sf_dir, "cleaned", lambda: clean_table(dirty_customers(spark, sf_dir)))


@query("clean_table", using(
    "SELECT " + camel_list(monthly_charges="ROUND(monthly_charges, 6)", total_charges="ROUND(total_charges, 6)")
    + " FROM cleaned", "dirty", extra=_CLEAN))
def clean_everything(spark, sf_dir):
    return rounded(clean_table(dirty_customers(spark, sf_dir)))


_CLEAN_FENCES = _fences("cleaned").replace("fences AS", "after AS", 1)


@query("quality_checks", using(f"""
SELECT "check", ROUND(value, 6) AS value, passed FROM (
  SELECT 'missing_values' AS "check", 0.0 AS value, TRUE AS passed
  UNION ALL SELECT 'duplicate_rows', COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {_REST} FROM cleaned)),
    COUNT(*) = (SELECT COUNT(*) FROM (SELECT DISTINCT {_REST} FROM cleaned)) FROM cleaned
  UNION ALL SELECT 'charges_deviation', MAX(ABS(total_charges - monthly_charges * tenure)), NULL FROM cleaned
  UNION ALL SELECT 'charges_inconsistent', COUNT(*) FILTER (WHERE {_WRONG}), COUNT(*) FILTER (WHERE {_WRONG}) = 0 FROM cleaned
  """ + "\n  ".join(
    f"UNION ALL SELECT 'outside_fences_{CAMEL[c]}', COUNT(*) FILTER (WHERE {c} < {c}_lo OR {c} > {c}_hi), "
    f"COUNT(*) FILTER (WHERE {c} < {c}_lo OR {c} > {c}_hi) = 0 FROM cleaned, after" for c in _FENCED
) + """
  UNION ALL SELECT 'churn_rate', AVG(CASE WHEN churn = 'Yes' THEN 1.0 ELSE 0.0 END), NULL FROM cleaned)""",
    "dirty", extra=_CLEAN + ",\n" + _CLEAN_FENCES))
def quality_checks(spark, sf_dir):
    return rounded(profiling.quality_checks(cleaned(spark, sf_dir)))


# ── profiles ────────────────────────────────────────────────────────────────


def _describe(source: str, numeric: dict[str, tuple[str, str]], text: dict[str, tuple[str, str]]) -> str:
    parts = []
    for column, (name, kind) in numeric.items():
        v = f"CAST({column} AS DOUBLE)"
        parts.append(
            f"SELECT '{name}' AS \"column\", '{kind}' AS type, COUNT({column}) AS count, "
            f"COUNT(*) - COUNT({column}) AS missing, ROUND((COUNT(*) - COUNT({column})) * 100.0 / COUNT(*), 2) AS missing_pct, "
            f"ROUND(AVG({v}), 4) AS mean, ROUND(STDDEV_SAMP({v}), 4) AS std, ROUND(MIN({v}), 4) AS min, "
            f"ROUND(QUANTILE_CONT({v}, 0.25), 4) AS q25, ROUND(QUANTILE_CONT({v}, 0.5), 4) AS q50, "
            f"ROUND(QUANTILE_CONT({v}, 0.75), 4) AS q75, ROUND(MAX({v}), 4) AS max, "
            f"CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM {source}"
        )
    for column, (name, kind) in text.items():
        parts.append(
            f"SELECT '{name}', '{kind}', COUNT({column}), COUNT(*) - COUNT({column}), "
            f"ROUND((COUNT(*) - COUNT({column})) * 100.0 / COUNT(*), 2), NULL, NULL, NULL, NULL, NULL, NULL, NULL, "
            f"COUNT(DISTINCT {column}), {_mode(column, source)}, "
            f"(SELECT COUNT(*) FROM {source} WHERE {column} = {_mode(column, source)}) FROM {source}"
        )
    return " UNION ALL ".join(parts)


_KINDS = {c: "int" for c in _NUM} | {"monthly_charges": "double", "total_charges": "double"}


@query("column_profile", using(_describe(
    "dirty", {c: (CAMEL[c], _KINDS[c]) for c in _NUM}, {c: (CAMEL[c], "string") for c in [*_TEXT, "churn"]}), "dirty"))
def column_profile(spark, sf_dir):
    return profiling.column_profile(dirty_customers(spark, sf_dir).drop("CustomerID"))


@query("column_profile_lineitem", _describe(
    "lineitem",
    {c: (c, "double") for c in _LINE} | {"l_linenumber": ("l_linenumber", "int")},
    {c: (c, "string") for c in ("l_returnflag", "l_linestatus")}))
def column_profile_lineitem(spark, sf_dir):
    frame = read(spark, sf_dir, "lineitem").select(*_LINE, "l_linenumber", "l_returnflag", "l_linestatus")
    return profiling.column_profile(frame)


@query("table_shape", using("SELECT COUNT(*) AS rows, 13 AS columns FROM profile", "profile"))
def table_shape(spark, sf_dir):
    return profiling.table_shape(customers(spark, sf_dir))


def _binary(column: str) -> str:
    return f"SELECT '{CAMEL[column]}', 'binary' FROM profile HAVING COUNT(DISTINCT {column}) = 2"


@query("column_groups", using(
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{CAMEL[c]}', 'categorical')" for c in _TEXT)
    + ", " + ", ".join(f"('{CAMEL[c]}', 'numerical')" for c in ["customer_id", *_NUM])
    + ", ('Churn', 'target')) AS t(\"column\", column_group) UNION ALL "
    + " UNION ALL ".join(_binary(c) for c in _TEXT), "profile"))
def column_groups(spark, sf_dir):
    return profiling.column_groups(customers(spark, sf_dir))


@query("dedup_mostly_unique", using(
    "SELECT " + camel_list() + f" FROM (SELECT MIN(customer_id) AS customer_id, {_REST} FROM dirty GROUP BY {_REST})", "dirty"))
def dedup_by_hash(spark, sf_dir):
    return dedup.dedup_mostly_unique(dirty_customers(spark, sf_dir))


_LINE_KEYS = "l_partkey, l_quantity, l_discount"


@query("dedup_lineitem", f"""
SELECT {_LINE_KEYS}, l_orderkey, l_linenumber FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {_LINE_KEYS} ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_lineitem(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    return dedup.dedup(lines, ["l_partkey", "l_quantity", "l_discount"], order_col="l_orderkey")
