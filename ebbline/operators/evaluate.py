"""Evaluation of scored rows against 0/1 labels, optionally per group (such as the model)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.session import staged


def _matrix(df: DataFrame, by: Sequence[str], label: str, prediction: str) -> DataFrame:
    actual, said = F.col(label) == 1, F.col(prediction) == 1
    return df.groupBy(*by).agg(
        F.count_if(actual & said).alias("tp"), F.count_if(~actual & said).alias("fp"),
        F.count_if(actual & ~said).alias("fn"), F.count_if(~actual & ~said).alias("tn"),
    )


def _sums(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same matrix from counts of positives and negatives per score and prediction."""
    said = F.col("said") == 1

    def total(column: str, chosen: Column) -> Column:
        return F.coalesce(F.sum(F.when(chosen, F.col(column))), F.lit(0))

    return counts.groupBy(*by).agg(
        total("pos", said).alias("tp"), total("neg", said).alias("fp"),
        total("pos", ~said).alias("fn"), total("neg", ~said).alias("tn"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def confusion_matrix(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """(label, prediction, n), all four cells."""
    cells = F.array(*[
        F.struct(F.lit(actual).alias("label"), F.lit(said).alias("prediction"), F.col(cell).alias("n"))
        for actual, said, cell in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    ])
    return _matrix(df, by, label, prediction).select(*by, F.inline(cells))


def metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", probability: str = "probability",
    by: Sequence[str] = (),
) -> DataFrame:
    """Accuracy, precision, recall, F1 of the positive class and the ROC area; 0 where nothing is divided by.

    The rows are read once: they are merged per score and prediction, and both parts come from that.
    """
    counts = _score_counts(df, label, probability, by, F.coalesce(F.col(prediction), F.lit(0)).alias("said"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rates = _sums(counts, by).select(
        *by,
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
    area = _area(_running(counts, by), by)
    if by:
        return rates.join(area, list(by))
    return rates.withColumn("roc_auc", F.lit(area.first()["roc_auc"]).cast("double"))


def class_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """(row, precision, recall, f1, support) per class, macro and weighted average; accuracy as its own row."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    per_class = {
        "Retained (0)": (tn, fn, fp, F.col("tn") + F.col("fp")),
        "Churned (1)": (tp, fp, fn, F.col("tp") + F.col("fn")),
    }
    scores = {
        name: (_ratio(hit, hit + wrong), _ratio(hit, hit + missed), _ratio(2 * hit, 2 * hit + wrong + missed), support)
        for name, (hit, wrong, missed, support) in per_class.items()
    }
    first, second = scores.values()
    rows = tp + fp + fn + tn

    def line(name: str, precision, recall, f1, support) -> Column:
        return F.struct(
            F.lit(name).alias("row"), precision.cast("double").alias("precision"),
            recall.cast("double").alias("recall"), f1.cast("double").alias("f1"), support.alias("support"),
        )

    lines = [line(name, *values) for name, values in scores.items()]
    accuracy = _ratio(tp + tn, rows)
    lines.append(line("accuracy", accuracy, accuracy, accuracy, rows))
    lines.append(line("macro avg", *[(a + b) / 2 for a, b in zip(first[:3], second[:3])], rows))
    lines.append(line(
        "weighted avg", *[_ratio(a * first[3] + b * second[3], rows) for a, b in zip(first[:3], second[:3])], rows
    ))
    return _matrix(df, by, label, prediction).select(*by, F.inline(F.array(*lines)))


# ── ROC ─────────────────────────────────────────────────────────────────────


def _score_counts(df: DataFrame, label: str, probability: str, by: Sequence[str], *more: Column) -> DataFrame:
    """Positives and negatives per distinct score (and further keys), written once."""
    return staged(
        df.where(F.col(label).isNotNull())
        .groupBy(*by, F.col(probability).alias("threshold"), *more)
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")),
        "score-counts",
    )


def _running(score_counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per distinct score: its positives and negatives, their sums over this and all higher scores, and the totals.

    The distinct scores of all groups are sorted over all partitions, so that a group of any
    size is in as many pieces as it needs.  Sums within a piece run in parallel and
    start from the totals of the higher pieces, one row for each group and piece.
    """
    merged = score_counts.where("threshold is not null").groupBy(*by, "threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    order = [*by, F.desc("threshold")]
    pieces = staged(merged.repartitionByRange(*order).withColumn("piece", F.spark_partition_id()), "score-pieces")
    totals = pieces.groupBy(*by, "piece").agg(F.sum("pos").alias("piece_pos"), F.sum("neg").alias("piece_neg"))
    higher = Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by)
    offsets = totals.select(
        *[F.col(c).alias(f"_{c}") for c in by], F.col("piece").alias("_piece"),
        F.coalesce(F.sum("piece_pos").over(higher), F.lit(0)).alias("start_pos"),
        F.coalesce(F.sum("piece_neg").over(higher), F.lit(0)).alias("start_neg"),
        F.sum("piece_pos").over(everything).alias("total_pos"),
        F.sum("piece_neg").over(everything).alias("total_neg"),
    )
    inside = Window.partitionBy(*by, "piece").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("piece") == F.col("_piece")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return (
        pieces.withColumns({"own_pos": F.sum("pos").over(inside), "own_neg": F.sum("neg").over(inside)})
        .join(offsets, same)
        .withColumns({"tp": F.col("start_pos") + F.col("own_pos"), "fp": F.col("start_neg") + F.col("own_neg")})
        .select(*by, "threshold", "pos", "neg", "tp", "fp", "total_pos", "total_neg")
    )


def _area(points: DataFrame, by: Sequence[str]) -> DataFrame:
    lower = F.col("total_neg") - F.col("fp")
    return points.groupBy(*by).agg(
        F.sum(F.col("pos") * (lower + F.col("neg") / 2)).alias("ordered"),
        F.max("total_pos").cast("double").alias("p"), F.max("total_neg").cast("double").alias("n"),
    ).select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("ordered") / F.col("p") / F.col("n")).alias("roc_auc"))


def roc_curve(
    df: DataFrame, label: str = "label", probability: str = "probability", by: Sequence[str] = ()
) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score; the curve starts at (0, 0) above the highest."""
    return _running(_score_counts(df, label, probability, by), by).select(
        *by, "threshold",
        (F.col("fp") / F.nullif("total_neg", F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif("total_pos", F.lit(0))).alias("tpr"),
    )


def roc_auc(
    df: DataFrame, label: str = "label", probability: str = "probability", by: Sequence[str] = ()
) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half; null with one class only."""
    return _area(_running(_score_counts(df, label, probability, by), by), by)
