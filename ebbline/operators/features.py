"""Feature vectors: z-scores and one-hot columns as a Spark ML pipeline.

The fitted state is an ordinary ``PipelineModel``, so it is saved, loaded and
applied to streams like any other.  The customer id and all other columns stay
beside the ``features`` column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions import roles
from ebbline.functions.scalar import hash_order
from ebbline.operators.quantiles import exact_quantiles, exact_ranks

MISSING_TEXT = "nan"
_Z, _BIN, _TEXT, _INDEX, _HOT = "_z_", "_b_", "_t_", "_i_", "_h_"
_WORK_PREFIXES = (_Z, _BIN, _TEXT, _INDEX, _HOT)


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population standard deviation) per column; a constant column gets scale 1."""
    aggs = [f(c).alias(f"{p}{i}") for i, c in enumerate(columns) for f, p in ((F.avg, "m"), (F.stddev_pop, "s"))]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def standardize(df: DataFrame, columns: Sequence[str], fitted: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Add ``<column>_z`` by mean and population standard deviation."""
    fitted = fitted or moments(df, columns)
    return df.withColumns({f"{c}_z": (F.col(c) - fitted[c][0]) / fitted[c][1] for c in columns})


def fit_features(
    df: DataFrame,
    numeric: Sequence[str] | None = None,
    categorical: Sequence[str] | None = None,
    *,
    include_binary: bool = False,
) -> PipelineModel:
    """Fit z-scores and one-hot columns on ``df``; of the listed columns those that exist.

    All categories are kept, in alphabetical order, as part of the fitted state,
    and vectors are sparse; a value not seen here becomes all zeros.  The Yes/No columns are left out unless asked for.
    """
    numeric = roles.present(list(numeric if numeric is not None else roles.MODEL_NUMERIC), df.columns)
    categorical = roles.present(
        list(categorical if categorical is not None else roles.MODEL_CATEGORICAL), df.columns
    )
    binary = roles.present(roles.MODEL_BINARY, df.columns) if include_binary else []

    selected = ["*"]
    middles = exact_quantiles(df, numeric, [0.5]) if numeric else {}
    for name, (mean, scale) in (moments(df, numeric) if numeric else {}).items():
        value = f"coalesce(nanvl(CAST(`{name}` AS DOUBLE), NULL), CAST('{middles[name][0]!r}' AS DOUBLE))"
        selected.append(f"({value} - CAST('{mean!r}' AS DOUBLE)) / CAST('{scale!r}' AS DOUBLE) AS `{_Z}{name}`")
    for name in binary:
        test = f"CAST(`{name}` AS DOUBLE)" if name == "SeniorCitizen" else f"IF(`{name}` = 'Yes', 1D, 0D)"
        selected.append(f"coalesce({test}, 0D) AS `{_BIN}{name}`")
    for name in categorical:
        selected.append(f"coalesce(CAST(`{name}` AS STRING), '{MISSING_TEXT}') AS `{_TEXT}{name}`")
    stages = [SQLTransformer(statement=f"SELECT {', '.join(selected)} FROM __THIS__")]
    if categorical:
        stages += [
            StringIndexer(
                inputCols=[_TEXT + c for c in categorical], outputCols=[_INDEX + c for c in categorical],
                handleInvalid="keep", stringOrderType="alphabetAsc",
            ),
            # The dropped last slot is the one for unseen values.
            OneHotEncoder(
                inputCols=[_INDEX + c for c in categorical], outputCols=[_HOT + c for c in categorical], dropLast=True
            ),
        ]
    stages.append(VectorAssembler(
        inputCols=[_Z + c for c in numeric] + [_BIN + c for c in binary] + [_HOT + c for c in categorical],
        outputCol="features", handleInvalid="error",
    ))
    return Pipeline(stages=stages).fit(df)


def feature_names(fitted: PipelineModel) -> list[str]:
    """Names in vector order: the numeric columns, then ``column_value`` per category."""
    categories = {}
    for stage in fitted.stages:
        if isinstance(stage, StringIndexerModel):
            categories = dict(zip(stage.getInputCols(), stage.labelsArray))
    names = []
    for column in fitted.stages[-1].getInputCols():
        if column.startswith(_HOT):
            base = column.removeprefix(_HOT)
            names += [f"{base}_{value}" for value in categories[_TEXT + base]]
        else:
            names.append(column[len(_Z):])
    return names


def add_features(df: DataFrame, fitted: PipelineModel) -> DataFrame:
    """Add the ``features`` vector and nothing else."""
    out = fitted.transform(df)
    return out.drop(*[c for c in out.columns if c.startswith(_WORK_PREFIXES)])


def feature_columns(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The feature vector as one column per feature, for reading and checking."""
    values = vector_to_array("features")
    return df.select(*keep, values.alias("_v")).select(
        *keep, *[F.get("_v", F.lit(i)).alias(name) for i, name in enumerate(names)]
    )


def onehot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``column_value`` 0/1 columns for all categories found."""
    fitted = fit_features(df, numeric=[], categorical=columns)
    return feature_columns(add_features(df, fitted), feature_names(fitted), keep)


# ── split and weights ───────────────────────────────────────────────────────


def stratified_split(
    df: DataFrame,
    key: str = roles.ID_COL,
    label: str = "label",
    test_share: float = roles.TEST_SHARE,
    seed: int = roles.SEED,
    *,
    exact: bool = True,
    order: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the same share of each label, by a hash of the key.

    Exact: per label the rows up to the wanted rank of the hash are the test
    part; the rank is a literal, so both parts are plain filters and no label
    is gathered in one task.  Otherwise a fixed share of the hash range, which
    needs no pass over the data at all.  Rows without a label take no part.
    """
    order = hash_order(F.col(key), seed) if order is None else order
    if not exact:
        in_test = F.pmod(order, F.lit(10_000)) < int(test_share * 10_000)
        labelled = df.where(F.col(label).isNotNull())
        return labelled.where(~in_test), labelled.where(in_test)
    counts = {r[label]: r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    names = {f"c{i}": value for i, value in enumerate(sorted(counts))}
    parts = {name: F.when(F.col(label) == value, order) for name, value in names.items()}
    sizes = {name: int(test_share * counts[value] + 0.5) for name, value in names.items()}
    cuts = exact_ranks(df, parts, {n: [k - 1] for n, k in sizes.items() if k}, integral=True)
    in_test = F.lit(False)
    for name, value in names.items():
        if sizes[name]:
            in_test = in_test | ((F.col(label) == value) & (order <= cuts[name][sizes[name] - 1]))
    labelled = df.where(F.col(label).isNotNull())
    return labelled.where(~in_test), labelled.where(in_test)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, balanced_weight, scale_pos_weight): n / (2 · n_label), and negatives per positive."""
    neg, pos = F.col("neg"), F.col("pos")
    counts = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos"))

    def line(value: int, n: Column) -> Column:
        return F.struct(
            F.lit(value).alias("label"), n.alias("n"), ((neg + pos) / (2 * F.nullif(n, F.lit(0)))).alias("balanced_weight"),
            (neg / F.nullif(pos, F.lit(0))).alias("scale_pos_weight"),
        )

    return counts.select(F.inline(F.array(line(0, neg), line(1, pos)))).where("n > 0")
