"""Exact quantiles against numpy, over skewed, tied, weighted and small groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("few", [1, 50, 100_000])
def test_quantiles_equal_numpy(spark, few):
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.normal(0, 1, 1500), "tied": rng.integers(0, 5, 700).astype(float), "one": np.array([7.25]), "two": np.array([-1.0, 1.0]), "same": np.full(300, 2.5),
        "far": np.r_[rng.normal(0, 1e-9, 400), 1e12, -1e12], "powers": 2.0 ** rng.integers(-300, 300, 500), "zeros": np.array([0.0, -0.0, 0.0, 5.0]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("normal", None), ("tied", float("nan")), ("none", None)]
    probs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs, few=few).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g]["n"] == len(vs)
        assert np.allclose(got[g]["q"], np.quantile(vs, probs), rtol=1e-12, atol=0), g


def test_weights_and_probabilities_by_group(spark):
    rng = np.random.default_rng(4)
    v, n = rng.normal(0, 9, 600), rng.integers(1, 40, 600)
    df = spark.createDataFrame([("a", float(x), int(k)) for x, k in zip(v, n)] + [("b", 1.0, 3), ("b", 2.0, 1)], "g string, v double, k int")
    prob = F.when(F.col("g") == "a", F.array(F.lit(0.3), F.lit(0.9))).otherwise(F.array(F.lit(0.5)))
    for few in (1, 10**6):
        got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", prob, "k", few).collect()}
        assert got["a"]["n"] == n.sum() and np.allclose(got["a"]["q"], np.quantile(np.repeat(v, n), [0.3, 0.9]))
        assert got["b"]["n"] == 4 and got["b"]["q"] == [1.0]


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", [0.5]).count() == 0
