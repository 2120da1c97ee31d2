"""Names, projections and types."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions import roles
from ebbline.functions.scalar import distinct_estimate, yes_flag

_CJK = re.compile("[一-鿿]")
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def normalize_name(name: str) -> str:
    """Trim, map known spellings, and run together title-cased parts of other CJK names."""
    trimmed = name.strip()
    known = roles.COLUMN_ALIASES.get(trimmed, trimmed)
    if not _CJK.search(known):
        return known
    return "".join(part.title() for part in known.replace(" ", "").split("_"))


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_name(name) for name in df.columns])


def drop_id(df: DataFrame) -> DataFrame:
    """Drop customerid / customer_id columns, whatever their case."""
    return df.drop(*[c for c in df.columns if c.lower() in ("customerid", "customer_id")])


def rename_snake(df: DataFrame) -> DataFrame:
    """Customer columns to snake case; others keep their names."""
    return df.withColumnsRenamed(roles.SNAKE_NAMES)


def rename_camel(df: DataFrame) -> DataFrame:
    """The inverse of ``rename_snake``."""
    return df.withColumnsRenamed(roles.CAMEL_NAMES)


def select_available(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*roles.present(wanted, df.columns))


def plain_number(text: Column) -> Column:
    """Text as double; anything but a plain number becomes null."""
    return F.when(text.rlike(_NUMBER), F.trim(text)).try_cast("double")


def to_number(df: DataFrame, name: str) -> Column:
    """A column as double; text that is no plain number, and NaN, become null."""
    value = F.col(name)
    text = isinstance(df.schema[name].dataType, T.StringType)
    value = plain_number(value) if text else value.try_cast("double")
    return F.when(~F.isnan(value), value)


def cast_types(
    df: DataFrame, num_cols: list[str] | None = None, cat_cols: list[str] | None = None
) -> DataFrame:
    """Numbers to double, whole-number columns truncated to int with null as 0, categories to string."""
    num_cols = num_cols or roles.present(roles.CLEAN_NUMERIC, df.columns)
    cat_cols = cat_cols or roles.present(roles.CLEAN_CATEGORICAL, df.columns)
    cast: dict[str, Column] = {}
    for name in roles.present(num_cols, df.columns):
        number = to_number(df, name)
        cast[name] = F.coalesce(number.try_cast("int"), F.lit(0)) if name in roles.CLEAN_INTEGER else number
    for name in roles.present(cat_cols, df.columns):
        cast[name] = F.col(name).cast("string")
    return df.withColumns(cast)


def encode_binary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Yes to 1 and anything else to 0; SeniorCitizen is 0/1 already."""
    cols = roles.present(cols or roles.MODEL_BINARY, df.columns)
    return df.withColumns({
        name: F.col(name).cast("int") if name == "SeniorCitizen" else yes_flag(F.col(name)) for name in cols
    })


def encode_target(df: DataFrame, target: str = roles.TARGET_COL, output: str = "label") -> DataFrame:
    return df.withColumn(output, yes_flag(F.col(target)))


def preview(df: DataFrame, n: int = 5, order_by: str = roles.ID_COL) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(order_by).limit(n)


# ── narrower types ──────────────────────────────────────────────────────────

_INTEGER_RANGES = [("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)]
# Fixed value: a double may become float while no value moves by more than this.
_FLOAT_TOLERANCE = 5e-4


def _proposals(df: DataFrame, max_ratio: float) -> list[tuple[str, str, str, bool]]:
    """(column, type, proposed type, dictionary candidate), from one aggregate."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(df.schema):
        value = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            aggs.append(distinct_estimate(value).alias(f"d{i}"))
        elif isinstance(field.dataType, T.DoubleType):
            moved = F.abs(value - value.cast("float").cast("double"))
            aggs.append(F.max(moved).alias(f"m{i}"))
        elif isinstance(field.dataType, T.IntegralType):
            aggs += [F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}")]
    stats = df.agg(*aggs).first()
    out = []
    for i, field in enumerate(df.schema):
        now = field.dataType.simpleString()
        proposed, dictionary = now, False
        if isinstance(field.dataType, T.StringType):
            dictionary = bool(stats["rows"]) and stats[f"d{i}"] / stats["rows"] < max_ratio
        elif isinstance(field.dataType, T.DoubleType):
            if stats[f"m{i}"] is not None and stats[f"m{i}"] <= _FLOAT_TOLERANCE:
                proposed = "float"
        elif isinstance(field.dataType, T.IntegralType) and stats[f"lo{i}"] is not None:
            low, high = stats[f"lo{i}"], stats[f"hi{i}"]
            proposed = next(kind for kind, bits in _INTEGER_RANGES if -(1 << bits) <= low and high < 1 << bits)
        out.append((field.name, now, proposed, dictionary))
    return out


def narrow_report(df: DataFrame, max_ratio: float = 0.5) -> DataFrame:
    """Proposed types per column; repetitive text is marked for dictionary encoding."""
    return df.sparkSession.createDataFrame(
        _proposals(df, max_ratio), "column string, type string, proposed string, dictionary boolean"
    )


def narrow_types(df: DataFrame, max_ratio: float = 0.5) -> DataFrame:
    """Cast to the proposed types.  Parquet dictionary-encodes the repetitive text by itself."""
    plan = _proposals(df, max_ratio)
    return df.withColumns({name: F.col(name).cast(to) for name, now, to, _ in plan if now != to})


# ── record rules ────────────────────────────────────────────────────────────


def _rules(columns: list[str]) -> dict[str, Column]:
    value = {name: F.col(name) for name in columns}
    # The ranges a scoring request must keep.
    ranges = {
        "senior_citizen": lambda c: c.between(0, 1),
        "tenure": lambda c: c.between(0, 100),
        "monthly_charges": lambda c: c > 0,
        "total_charges": lambda c: c >= 0,
        "support_tickets": lambda c: c >= 0,
        "last_login_days": lambda c: c >= 0,
        "feature_usage_count": lambda c: c >= 0,
        "ticket_sentiment": lambda c: c.between(-1, 1),
    }
    return {
        name: F.coalesce(ranges[name](value[name]), F.lit(False)) if name in ranges else value[name].isNotNull()
        for name in columns
    }


REQUEST_COLUMNS = [c for c in roles.SNAKE_NAMES.values() if c not in ("customer_id", "churn")]


def validate_records(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Add ``violations``: the names of required fields that are missing or out of range.

    A required column the table does not have at all is a violation in every row.
    """
    required = REQUEST_COLUMNS if required is None else required
    have = _rules(roles.present(required, df.columns))
    marks = [F.when(~have[name], F.lit(name)) if name in have else F.lit(name) for name in required]
    return df.withColumn("violations", F.array_compact(F.array(*marks)))


def split_valid(df: DataFrame, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations)."""
    checked = validate_records(df, required)
    broken = F.size("violations") > 0
    return checked.where(~broken).drop("violations"), checked.where(broken)
