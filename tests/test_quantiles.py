import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.operators.quantiles import approx_quantiles, exact_quantiles, exact_ranks

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def samples():
    rng = np.random.default_rng(7)
    spread = rng.lognormal(3, 2, 4000)
    hot = np.where(rng.random(4000) < 0.34, 5.0, rng.normal(5, 1, 4000))
    return {
        "spread": spread, "hot": hot, "whole": rng.integers(0, 9, 4000).astype(float),
        "two": np.where(rng.random(4000) < 0.5, 1e-9, 1e9), "same": np.full(4000, 3.5),
    }


@pytest.mark.parametrize("accuracy", [10_000, 50, 25])
def test_exact_whatever_the_bracket_sizes(spark, accuracy):
    data = samples()
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in data.values()])), list(data))
    found = exact_quantiles(df, list(data), PROBS, accuracy=accuracy)
    for name, values in data.items():
        # Interpolation may round the last bit differently.
        np.testing.assert_allclose(found[name], np.quantile(values, PROBS), rtol=1e-12, atol=0)


def test_missing_values_are_left_out(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (None, None), (4.0, None)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.25, 0.5]) == {"a": [1.75, 2.5], "b": [None, None]}


def test_empty_input(spark):
    assert exact_quantiles(spark.createDataFrame([], "a int"), ["a"], [0.5]) == {"a": [None]}


def test_ranks_of_large_integers_stay_exact(spark):
    df = spark.range(500).select((F.lit(1 << 62) + F.col("id") * 3).alias("v"))
    for accuracy in (10_000, 20):
        found = exact_ranks(df, ["v"], {"v": [0, 250, 499]}, integral=True, accuracy=accuracy)
        assert found["v"] == {0: 1 << 62, 250: (1 << 62) + 750, 499: (1 << 62) + 1497}


def test_negative_values_and_a_useless_sketch(spark):
    data = list(range(-300, 300))
    df = spark.createDataFrame([(v,) for v in data], "v bigint")
    found = exact_ranks(df, ["v"], {"v": [0, 1, 299, 599]}, integral=True, accuracy=2)
    assert found["v"] == {0: -300, 1: -299, 299: -1, 599: 299}


def test_approx_is_close(spark):
    found = approx_quantiles(spark.range(10_000), ["id"], [0.25, 0.5])["id"]
    assert abs(found[0] - 2500) <= 2 and abs(found[1] - 5000) <= 2
