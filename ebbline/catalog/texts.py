"""Generated customers and tickets, and text sentiment."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ebbline.catalog.base import query, read, rounded, shared
from ebbline.functions import lexicon, roles
from ebbline.functions.scalar import portable_uniform
from ebbline.operators import text
from ebbline.operators.phrases import in_blocks
from ebbline.session import spread
from ebbline.sources import synth

# As in operators/phrases.py: the workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ── SQL twins of the generator ──────────────────────────────────────────────


def _u(salt: str, key: str = "c_custkey") -> str:
    digest = f"SUBSTR(MD5(CAST({key} AS VARCHAR) || '|{salt}|{roles.SEED}'), 1, 8)"
    return f"(CAST(CAST('0x' || {digest} AS BIGINT) AS DOUBLE) / 4294967296)"


def _literal(value) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _pick(u: str, values, steps) -> str:
    cases = " ".join(f"WHEN {u} < {step!r}::DOUBLE THEN {_literal(v)}" for v, step in zip(values, steps))
    return f"CASE {cases} ELSE {_literal(values[-1])} END"


def _drawn_sql() -> str:
    columns = {
        name: _pick(_u(name), values, synth.cumulative(weights)[:-1])
        for name, (values, weights) in synth.CATEGORY_WEIGHTS.items()
    }
    columns["CustomerID"] = "CASE WHEN c_custkey < 10000 THEN LPAD(CAST(c_custkey AS VARCHAR), 4, '0') ELSE CAST(c_custkey AS VARCHAR) END || '-XXXXX'"
    columns["Tenure"] = f"CAST(FLOOR({_u('Tenure')} * 73) AS INTEGER)"
    columns["MonthlyCharges"] = f"ROUND(18.25::DOUBLE + {_u('MonthlyCharges')} * 100.5::DOUBLE, 2)"
    columns["SupportTickets"] = _pick(_u("SupportTickets"), list(range(10)), synth.poisson_steps(1.2, 9))
    columns["LastLoginDays"] = f"CAST(FLOOR(LEAST(60.0::DOUBLE, -8.0::DOUBLE * LN(1 - {_u('LastLoginDays')}))) AS INTEGER)"
    columns["FeatureUsageCount"] = _pick(_u("FeatureUsageCount"), list(range(13)), synth.binomial_steps(12, 0.55))
    columns["MultipleLines"] = f"CASE WHEN {columns['PhoneService']} = 'Yes' THEN {columns['MultipleLines']} ELSE 'No phone service' END"
    drawn = ", ".join(f'{sql} AS "{name}"' for name, sql in columns.items())
    chance = """CASE Contract WHEN 'Month-to-month' THEN 0.45::DOUBLE - Tenure * 0.003::DOUBLE
      WHEN 'One year' THEN 0.15::DOUBLE - Tenure * 0.002::DOUBLE ELSE 0.05::DOUBLE - Tenure * 0.001::DOUBLE END
      + SupportTickets * 0.035::DOUBLE + CASE WHEN LastLoginDays > 20 THEN 0.15::DOUBLE ELSE 0 END
      + CASE WHEN FeatureUsageCount < 3 THEN 0.1::DOUBLE ELSE 0 END"""
    out = ", ".join(
        f'"{name}"' for name, _ in roles.CUSTOMER_COLUMNS if name not in ("TotalCharges", "Churn")
    )
    return f"""drawn AS (SELECT {drawn}, {_u('Churn')} AS u FROM customer),
made AS (SELECT {out}, ROUND("MonthlyCharges" * "Tenure", 2) AS "TotalCharges",
  CASE WHEN u < LEAST(0.95::DOUBLE, GREATEST(0.02::DOUBLE, {chance})) THEN 'Yes' ELSE 'No' END AS "Churn" FROM drawn)"""


def _one_of(u: str, values: list[str]) -> str:
    listed = ", ".join(_literal(v) for v in values)
    return f"LIST_EXTRACT([{listed}], CAST(FLOOR({u} * {len(values)}) AS INTEGER) + 1)"


def _tickets_sql() -> str:
    def u(salt):
        return _u(salt, '"CustomerID"')

    def mix(i):
        mixes = [m[i] for m in (synth.CHURNED_MIX, synth.AT_RISK_MIX, synth.QUIET_MIX, synth.OTHER_MIX)]
        return (
            f"CASE WHEN \"Churn\" = 'Yes' THEN {mixes[0]} WHEN \"SupportTickets\" >= 3 OR \"LastLoginDays\" > 20 THEN {mixes[1]} "
            f"WHEN \"SupportTickets\" <= 1 THEN {mixes[2]} ELSE {mixes[3]} END"
        )

    template = (
        f"CASE WHEN {u('mood')} < {mix(0)} THEN {_one_of(u('template'), synth.NEGATIVE_TEMPLATES)} "
        f"WHEN {u('mood')} < {mix(1)} THEN {_one_of(u('template'), synth.NEUTRAL_TEMPLATES)} "
        f"ELSE {_one_of(u('template'), synth.POSITIVE_TEMPLATES)} END"
    )
    filled = f"REPLACE({template}, '{{detail}}', {_one_of(u('detail'), synth.DETAILS)})"
    return f"""tickets AS (SELECT "CustomerID", "Churn",
  REPLACE({filled}, '{{feature}}', {_one_of(u('feature'), synth.FEATURES)}) AS ticket_text FROM made)"""


def _sentiment_sql(source: str, key: str, column: str, polarity, intensifiers, negators) -> str:
    def table(name, weights):
        rows = ", ".join(f"({_literal(w)}, {float(v)!r}::DOUBLE)" for w, v in weights.items())
        return f"{name}(w, v) AS (VALUES {rows})"

    negs = ", ".join(_literal(n) for n in negators)
    return f"""{table('pol', polarity)},
{table('strong', intensifiers)},
words AS (SELECT {key} AS k, REGEXP_EXTRACT_ALL(LOWER({column}), '[\\p{{L}}'']+') AS ws FROM {source}),
tok AS (SELECT k, GENERATE_SUBSCRIPTS(ws, 1) AS i, UNNEST(ws) AS w FROM words),
ctx AS (SELECT k, i, w, LAG(w, 1, '') OVER (PARTITION BY k ORDER BY i) AS p1, LAG(w, 2, '') OVER (PARTITION BY k ORDER BY i) AS p2 FROM tok),
hits AS (SELECT k, GREATEST(-1.0::DOUBLE, LEAST(1.0::DOUBLE, pol.v * COALESCE(strong.v, 1.0::DOUBLE)
    * CASE WHEN p1 IN ({negs}) OR (strong.v IS NOT NULL AND p2 IN ({negs})) THEN -0.5::DOUBLE ELSE 1.0::DOUBLE END)) AS s
  FROM ctx JOIN pol ON ctx.w = pol.w LEFT JOIN strong ON ctx.p1 = strong.w),
felt AS (SELECT k, AVG(s) AS score FROM hits GROUP BY k)"""


# ── queries ─────────────────────────────────────────────────────────────────


def made_customers(spark, sf_dir):
    """One generated customer per row of the customer table."""
    keys = spread(read(spark, sf_dir, "customer").select("c_custkey"))
    return synth.draw_customers(keys, "c_custkey", draw=portable_uniform)


@query("gen_customers", "WITH " + _drawn_sql() + "\nSELECT * FROM made")
def gen_customers(spark, sf_dir):
    return made_customers(spark, sf_dir)


def made_tickets(spark, sf_dir):
    return synth.gen_ticket_text(made_customers(spark, sf_dir), draw=portable_uniform)


@query("gen_ticket_text", "WITH " + _drawn_sql() + ",\n" + _tickets_sql() + '\nSELECT "CustomerID", ticket_text FROM tickets')
def gen_ticket_text(spark, sf_dir):
    return made_tickets(spark, sf_dir).select("CustomerID", "ticket_text")


_TICKET_SENTIMENT = ",\n".join([
    "WITH " + _drawn_sql(), _tickets_sql(),
    _sentiment_sql("tickets", '"CustomerID"', "ticket_text", lexicon.POLARITY, lexicon.INTENSIFIERS, lexicon.NEGATORS),
])


def enriched(spark, sf_dir):
    """Generated customers with ticket text and its sentiment: the training table of the models."""
    return shared(spark, sf_dir, "enriched", lambda: text.text_sentiment(made_tickets(spark, sf_dir)))


@query("ticket_sentiment", _TICKET_SENTIMENT + """
SELECT "CustomerID", ROUND(COALESCE(score, 0), 9) AS ticket_sentiment FROM tickets LEFT JOIN felt ON "CustomerID" = k""")
def ticket_sentiment(spark, sf_dir):
    return rounded(text.text_sentiment(made_tickets(spark, sf_dir)).select("CustomerID", "ticket_sentiment"), 9)


@query("sentiment_summary", _TICKET_SENTIMENT + """
SELECT COUNT(*) AS texts, ROUND(COUNT(*) FILTER (WHERE s < -0.1) * 100.0 / COUNT(*), 6) AS negative_pct,
  ROUND(COUNT(*) FILTER (WHERE s BETWEEN -0.1 AND 0.1) * 100.0 / COUNT(*), 6) AS neutral_pct,
  ROUND(COUNT(*) FILTER (WHERE s > 0.1) * 100.0 / COUNT(*), 6) AS positive_pct, ROUND(AVG(s), 6) AS mean_polarity,
  ROUND(AVG(s) FILTER (WHERE "Churn" = 'Yes'), 6) AS churned_mean, ROUND(AVG(s) FILTER (WHERE "Churn" = 'No'), 6) AS retained_mean
FROM (SELECT "Churn", COALESCE(score, 0) AS s FROM tickets LEFT JOIN felt ON "CustomerID" = k)""")
def sentiment_summary(spark, sf_dir):
    return rounded(text.sentiment_summary(enriched(spark, sf_dir)))


# The documents are invented prose, so their lexicon is made of words that are
# frequent in them, beside some words of the real one.
_DOC_POLARITY = {
    "la": 0.4, "de": -0.3, "the": 0.2, "of": -0.1, "que": 0.5, "der": -0.4, "en": 0.3, "le": -0.2, "und": 0.9,
    "la'": 1.0, "worthless": -0.8, "great": 0.8, "terrible": -1.0, "ment": -0.6, "et": 0.7,
}
_DOC_STRONG = {"that": 1.3, "is": 1.5, "ci": 0.6, "die": 1.2, "un": 0.5}
_DOC_NEGATORS = ["and", "to", "a", "les", "er"]


@query("text_sentiment", "WITH " + _sentiment_sql(
    "documents", "doc_id", "text", _DOC_POLARITY, _DOC_STRONG, _DOC_NEGATORS) + """
SELECT doc_id, ROUND(COALESCE(score, 0), 9) AS polarity FROM documents LEFT JOIN felt ON doc_id = k""")
def text_sentiment(spark, sf_dir):
    scored = text.text_sentiment(
        read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "polarity",
        polarity=_DOC_POLARITY, intensifiers=_DOC_STRONG, negators=_DOC_NEGATORS,
    )
    return rounded(scored.select("doc_id", "polarity"), 9)


@query("conversation_sentiment", "WITH " + _sentiment_sql(
    "(SELECT conv_id * 100000 + turn AS turn_key, text FROM conversations WHERE role = 'user')", "turn_key", "text",
    _DOC_POLARITY, _DOC_STRONG, _DOC_NEGATORS) + """
SELECT conv_id, COUNT(*) AS texts, ROUND(AVG(COALESCE(score, 0)), 9) AS polarity
FROM (SELECT conv_id, conv_id * 100000 + turn AS turn_key FROM conversations WHERE role = 'user') c
LEFT JOIN felt ON turn_key = k GROUP BY conv_id""")
def conversation_sentiment(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").where("role = 'user'")
    scored = text.text_sentiment(
        turns, "text", "polarity", polarity=_DOC_POLARITY, intensifiers=_DOC_STRONG, negators=_DOC_NEGATORS
    )
    return rounded(scored.groupBy("conv_id").agg(F.count(F.lit(1)).alias("texts"), F.avg("polarity").alias("polarity")), 9)


# A lexicon of all words and every fifth pair of words of the documents, with weights that both engines compute.
_ENTRY_WEIGHT = "CAST((LENGTH(entry) * 7 + ASCII(entry)) % 21 - 10 AS DOUBLE) / 10"
_PAIRED = "LENGTH(w) >= 3 AND (LENGTH(w) * 3 + LENGTH(p)) % 5 = 0"


def _doc_entries(batches):
    """The words of three characters and more and the pairs of _PAIRED, each once a block of texts."""
    for _, sizes, words in in_blocks(batches):
        different, codes = words.dictionary, words.indices.to_numpy().astype(np.int64)
        length, ends = pc.utf8_length(different).to_numpy().astype(np.int64), np.zeros(len(codes), bool)
        ends[np.cumsum(sizes[sizes > 0]) - 1] = True
        p, w = codes[:-1], codes[1:]
        pairs = np.unique((p * len(different) + w)[~ends[:-1] & (length[w] >= 3) & ((length[w] * 3 + length[p]) % 5 == 0)])
        first, second = (different.take(pa.array(c)) for c in np.divmod(pairs, len(different)))
        for entries in (different.filter(pa.array(length >= 3)), pc.binary_join_element_wise(first, second, " ")):
            yield pa.RecordBatch.from_arrays([entries.cast(pa.string())], ["entry"])


@query("text_sentiment_table", f"""
WITH words AS (SELECT doc_id AS k, REGEXP_EXTRACT_ALL(LOWER(text), '[\\p{{L}}'']+') AS ws FROM documents),
tok AS (SELECT k, GENERATE_SUBSCRIPTS(ws, 1) AS i, UNNEST(ws) AS w FROM words),
ctx AS (SELECT k, i, w, LAG(w, 1, '') OVER (PARTITION BY k ORDER BY i) AS p, LAG(w, 2, '') OVER (PARTITION BY k ORDER BY i) AS q,
  LAG(w, 3, '') OVER (PARTITION BY k ORDER BY i) AS r FROM tok),
lex AS (SELECT entry, n, {_ENTRY_WEIGHT} AS v FROM (
  SELECT DISTINCT w AS entry, 1 AS n FROM tok WHERE LENGTH(w) >= 3 UNION ALL SELECT DISTINCT p || ' ' || w, 2 FROM ctx WHERE p <> '' AND {_PAIRED})),
one AS (SELECT k, i, v, p AS a, q AS b FROM ctx JOIN lex ON n = 1 AND entry = w),
two AS (SELECT k, i, v, q AS a, r AS b FROM ctx JOIN lex ON n = 2 AND p <> '' AND entry = p || ' ' || w),
kept AS (SELECT * FROM two UNION ALL SELECT o.* FROM one o WHERE NOT EXISTS (SELECT 1 FROM two t WHERE t.k = o.k AND t.i IN (o.i, o.i + 1))),
strong(w, s) AS (VALUES {", ".join(f"({_literal(w)}, {float(v)!r}::DOUBLE)" for w, v in _DOC_STRONG.items())}),
hits AS (SELECT k, GREATEST(-1.0::DOUBLE, LEAST(1.0::DOUBLE, v * (COALESCE(s, 1.0::DOUBLE) * CASE WHEN a IN ({", ".join(map(_literal, _DOC_NEGATORS))})
    OR (s IS NOT NULL AND b IN ({", ".join(map(_literal, _DOC_NEGATORS))})) THEN -0.5::DOUBLE ELSE 1.0::DOUBLE END))) AS score
  FROM kept LEFT JOIN strong ON a = strong.w)
SELECT doc_id, ROUND(COALESCE(m, 0), 9) AS polarity FROM documents LEFT JOIN (SELECT k, AVG(score) AS m FROM hits GROUP BY k) ON doc_id = k""")
def text_sentiment_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select(F.lit(0).cast("long").alias("_row"), text.words_of(F.col("text")).alias("words"))
    entries = words.mapInArrow(_doc_entries, "entry string").distinct()
    scored = text.text_sentiment_by_table(
        docs, entries.withColumn("weight", F.expr(_ENTRY_WEIGHT)), "text", "polarity", intensifiers=_DOC_STRONG, negators=_DOC_NEGATORS,
    )
    return rounded(scored.select("doc_id", "polarity"), 9)
