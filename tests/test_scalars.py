from pyspark.sql import functions as F

from ebbline.functions import roles
from ebbline.functions.scalar import bin_label, clip, portable_uniform, request_id, risk_tier, share_yes, uniform, yes_flag


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def values(df):
    return [row[0] for row in df.collect()]


def test_tenure_bins_closed_left_and_right(spark):
    df = column(spark, [0, 6, 72, 73, None], "int")
    left = bin_label(F.col("v"), roles.TENURE_EDGES, roles.TENURE_LABELS)
    right = bin_label(F.col("v"), roles.TENURE_EDGES, roles.TENURE_LABELS, right=True)
    assert values(df.select(left)) == ["0-6m", "6-12m", "60-72m", None, None]
    assert values(df.select(right)) == [None, "0-6m", "60-72m", "60-72m", None]


def test_login_labels_do_not_match_their_edges(spark):
    df = column(spark, [0, 3, 60, 61], "int")
    label = bin_label(F.col("v"), roles.LOGIN_EDGES, roles.LOGIN_LABELS)
    assert values(df.select(label)) == ["0-3 days\n(Active)", "4-7 days\n(Recent)", "30+ days\n(At Risk)", None]


def test_risk_tier_edges(spark):
    df = column(spark, [0.0, 0.2499, 0.25, 0.5, 0.75, None])
    assert values(df.select(risk_tier(F.col("v")))) == ["Low", "Low", "Medium", "High", "Critical", None]


def test_clip_keeps_null(spark):
    df = column(spark, [-1.0, 0.5, 9.0, None])
    assert values(df.select(clip(F.col("v"), 0.0, 1.0))) == [0.0, 0.5, 1.0, None]


def test_null_label_counts_as_not_churned(spark):
    df = column(spark, ["Yes", "No", None, "yes"], "string")
    assert values(df.select(yes_flag(F.col("v")))) == [1, 0, 0, 0]
    assert values(df.agg(share_yes(F.col("v")))) == [0.25]


def test_request_id_repeats_and_differs(spark):
    df = spark.range(1000)
    first = values(df.select(request_id(F.col("id"))))
    assert first == values(df.repartition(7).sort("id").select(request_id(F.col("id"))))
    assert len(set(first)) > 995 and all(len(v) == 12 and v.startswith("api-") for v in first)


def test_uniform_draws(spark):
    for draw in (uniform, portable_uniform):
        df = spark.range(20_000).select(draw(F.col("id"), "a").alias("a"), draw(F.col("id"), "b").alias("b"))
        row = df.agg(F.min("a"), F.max("a"), F.avg("a"), F.corr("a", "b")).first()
        assert 0 <= row[0] < 0.001 and 0.999 < row[1] < 1
        assert abs(row[2] - 0.5) < 0.01 and abs(row[3]) < 0.03
