"""Generated customers, one per key of any table of keys.

Every draw is a hash of (key, column, seed): the same customer comes out
whatever the partitioning, and a retried task repeats its rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.functions import roles
from ebbline.functions.scalar import clip, uniform

# The categories of each column with their weights.
YES_NO = ["Yes", "No"]
CATEGORY_WEIGHTS: dict[str, tuple[list, list[float]]] = {
    "Gender": (["Male", "Female"], [0.50, 0.50]),
    "SeniorCitizen": ([0, 1], [0.84, 0.16]),
    "Partner": (YES_NO, [0.48, 0.52]),
    "Dependents": (YES_NO, [0.30, 0.70]),
    "Contract": (["Month-to-month", "One year", "Two year"], [0.55, 0.24, 0.21]),
    "PaymentMethod": (
        ["Electronic check", "Mailed check", "Bank transfer (automatic)", "Credit card (automatic)"],
        [0.34, 0.23, 0.22, 0.21],
    ),
    "PaperlessBilling": (YES_NO, [0.60, 0.40]),
    "PhoneService": (YES_NO, [0.90, 0.10]),
    "MultipleLines": (["Yes", "No", "No phone service"], [0.42, 0.48, 0.10]),
    "InternetService": (["DSL", "Fiber optic", "No"], [0.35, 0.44, 0.21]),
    "OnlineSecurity": (["Yes", "No", "No internet service"], [0.29, 0.50, 0.21]),
    "OnlineBackup": (["Yes", "No", "No internet service"], [0.30, 0.49, 0.21]),
    "DeviceProtection": (["Yes", "No", "No internet service"], [0.30, 0.49, 0.21]),
    "TechSupport": (["Yes", "No", "No internet service"], [0.30, 0.49, 0.21]),
    "StreamingTV": (["Yes", "No", "No internet service"], [0.32, 0.47, 0.21]),
    "StreamingMovies": (["Yes", "No", "No internet service"], [0.32, 0.47, 0.21]),
    "CompanySize": (roles.COMPANY_SIZES, [0.20, 0.30, 0.28, 0.15, 0.07]),
    "Industry": (
        ["Technology", "Finance", "Healthcare", "Education", "Retail", "Manufacturing", "Media", "Real Estate",
         "Consulting", "Other"],
        [0.1] * 10,
    ),
}
# Parameters of the numeric columns.
TENURE_MONTHS = 73
CHARGES_RANGE = (18.25, 118.75)
TICKET_RATE, TICKET_MAX = 1.2, 9
LOGIN_SCALE, LOGIN_MAX = 8.0, 60
FEATURE_TRIALS, FEATURE_SHARE = 12, 0.55
# Churn probability at tenure 0 and its monthly decrease, per contract.
CHURN_BY_CONTRACT = {"Month-to-month": (0.45, 0.003), "One year": (0.15, 0.002), "Two year": (0.05, 0.001)}
CHURN_PER_TICKET, CHURN_INACTIVE, CHURN_LOW_USAGE = 0.035, 0.15, 0.10
CHURN_LIMITS = (0.02, 0.95)


def cumulative(weights: Sequence[float]) -> list[float]:
    return [round(sum(weights[: i + 1]), 12) for i in range(len(weights))]


def poisson_steps(rate: float, top: int) -> list[float]:
    """Distribution function of the values 0 .. top - 1."""
    return cumulative([math.exp(-rate) * rate**k / math.factorial(k) for k in range(top)])


def binomial_steps(trials: int, share: float) -> list[float]:
    return cumulative([math.comb(trials, k) * share**k * (1 - share) ** (trials - k) for k in range(trials)])


def pick(u: Column, values: Sequence, steps: Sequence[float]) -> Column:
    """The value whose step of the distribution function holds ``u``; the last value beyond all steps."""
    chosen = None
    for value, step in zip(values, steps):
        chosen = (F if chosen is None else chosen).when(u < step, F.lit(value))
    return chosen.otherwise(F.lit(values[-1]))


def draw_customers(
    keys: DataFrame, key: str, seed: int = roles.SEED, draw: Callable[[Column, str, int], Column] = uniform
) -> DataFrame:
    """One customer per row of ``keys`` (an integer key column), all 26 columns."""
    k = F.col(key)

    def u(salt: str) -> Column:
        return draw(k, salt, seed)

    columns = {name: pick(u(name), values, cumulative(w)[:-1]) for name, (values, w) in CATEGORY_WEIGHTS.items()}
    low, high = CHARGES_RANGE
    columns |= {
        "CustomerID": F.format_string("%04d-XXXXX", k),
        "Tenure": F.floor(u("Tenure") * TENURE_MONTHS).cast("int"),
        "MonthlyCharges": F.round(low + u("MonthlyCharges") * (high - low), 2),
        "SupportTickets": pick(
            u("SupportTickets"), list(range(TICKET_MAX + 1)), poisson_steps(TICKET_RATE, TICKET_MAX)
        ),
        "LastLoginDays": F.floor(
            F.least(F.lit(float(LOGIN_MAX)), -LOGIN_SCALE * F.log(1 - u("LastLoginDays")))
        ).cast("int"),
        "FeatureUsageCount": pick(
            u("FeatureUsageCount"), list(range(FEATURE_TRIALS + 1)), binomial_steps(FEATURE_TRIALS, FEATURE_SHARE)
        ),
        "_churn_u": u("Churn"),
    }
    columns["MultipleLines"] = F.when(columns["PhoneService"] == "Yes", columns["MultipleLines"]).otherwise(
        F.lit("No phone service")
    )
    drawn = keys.select(*[value.alias(name) for name, value in columns.items()])

    base = None
    for contract, (start, slope) in CHURN_BY_CONTRACT.items():
        base = (F if base is None else base).when(F.col("Contract") == contract, start - F.col("Tenure") * slope)
    probability = clip(
        base
        + F.col("SupportTickets") * CHURN_PER_TICKET
        + F.when(F.col("LastLoginDays") > 20, CHURN_INACTIVE).otherwise(0.0)
        + F.when(F.col("FeatureUsageCount") < 3, CHURN_LOW_USAGE).otherwise(0.0),
        *CHURN_LIMITS,
    )
    return drawn.withColumns({
        "TotalCharges": F.round(F.col("MonthlyCharges") * F.col("Tenure"), 2),
        "Churn": F.when(F.col("_churn_u") < probability, "Yes").otherwise("No"),
    }).select(*[name for name, _ in roles.CUSTOMER_COLUMNS])


def gen_customers(spark: SparkSession, n: int = 7043, seed: int = roles.SEED) -> DataFrame:
    """``n`` generated customers with ids 0 .. n - 1."""
    return draw_customers(spark.range(n), "id", seed)


# ── ticket texts ────────────────────────────────────────────────────────────

# Ticket templates and what fills them.
NEGATIVE_TEMPLATES = [
    "I am very frustrated with the service. {detail}",
    "This is unacceptable. {detail} I want to cancel my subscription.",
    "I've been experiencing {detail} for weeks. Very disappointing.",
    "Your customer support is terrible. {detail} No one is helping me.",
    "I regret signing up. {detail} The platform keeps crashing.",
    "The pricing is too high for what we get. {detail}",
    "We are considering switching to a competitor because {detail}",
    "The {feature} feature is broken. {detail} Fix it or I'm leaving.",
    "I have submitted multiple tickets about {detail} with no resolution.",
    "Extremely poor experience. {detail} I want a refund.",
]
NEUTRAL_TEMPLATES = [
    "I have a question about {detail}. Can someone help?",
    "We need assistance with {detail}. Please advise.",
    "The {feature} feature could be improved. {detail}",
    "I noticed {detail}. Is this expected behavior?",
    "Could you clarify the billing for {detail}?",
    "We would like to upgrade our plan. {detail}",
    "Please help me configure {feature}. {detail}",
    "I need to add more users to our account. {detail}",
]
POSITIVE_TEMPLATES = [
    "Great product! {detail} We love using it.",
    "The new {feature} update is fantastic. {detail}",
    "Our team is very satisfied with the service. {detail}",
    "Thank you for the quick response on {detail}. Much appreciated.",
    "We've been using this for {detail} and it's been excellent.",
    "The integration with {feature} works perfectly. {detail}",
    "Customer support was very helpful with {detail}. Thank you!",
    "I would recommend this to other teams. {detail}",
]
DETAILS = [
    "the dashboard keeps showing wrong data",
    "billing charged us twice this month",
    "our API integration is failing",
    "the reports are not loading properly",
    "we can't add new team members",
    "the data export feature is missing",
    "login issues affecting the whole team",
    "performance has been very slow lately",
    "the mobile app keeps crashing",
    "email notifications are not working",
    "we need SSO integration for security",
    "the analytics don't match our internal numbers",
]
FEATURES = [
    "reporting", "analytics", "dashboard", "billing", "API", "user management", "notifications", "data export",
    "mobile", "security", "integration", "automation", "search",
]
# Shares of negative and of negative or neutral texts in the four customer cases.
CHURNED_MIX, AT_RISK_MIX, QUIET_MIX, OTHER_MIX = (0.70, 0.95), (0.40, 0.85), (0.10, 0.50), (0.25, 0.75)


def _one_of(u: Column, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.floor(u * len(values)).cast("int"))


def gen_ticket_text(
    df: DataFrame,
    key: str = roles.ID_COL,
    seed: int = roles.SEED,
    draw: Callable[[Column, str, int], Column] = uniform,
    output: str = "ticket_text",
) -> DataFrame:
    """Add a ticket text.  The mood hangs on the label, so this is for test data only."""
    k = F.col(key)
    tickets, gap = F.coalesce(F.col("SupportTickets"), F.lit(0)), F.coalesce(F.col("LastLoginDays"), F.lit(0))

    def mix(i: int) -> Column:
        return (
            F.when(F.col(roles.TARGET_COL) == "Yes", CHURNED_MIX[i])
            .when((tickets >= 3) | (gap > 20), AT_RISK_MIX[i])
            .when(tickets <= 1, QUIET_MIX[i])
            .otherwise(OTHER_MIX[i])
        )

    mood, which = draw(k, "mood", seed), draw(k, "template", seed)
    template = (
        F.when(mood < mix(0), _one_of(which, NEGATIVE_TEMPLATES))
        .when(mood < mix(1), _one_of(which, NEUTRAL_TEMPLATES))
        .otherwise(_one_of(which, POSITIVE_TEMPLATES))
    )
    filled = F.replace(template, F.lit("{detail}"), _one_of(draw(k, "detail", seed), DETAILS))
    return df.withColumn(
        output, F.replace(filled, F.lit("{feature}"), _one_of(draw(k, "feature", seed), FEATURES))
    )
