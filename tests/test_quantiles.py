"""Selection by ranges against sorted values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import profile
from quadrille.operators import quantiles as Q


@pytest.mark.parametrize("few", [1, 7, 2000])
def test_order_statistics(spark, few):
    rng = np.random.default_rng(few)
    groups = {
        "normal": rng.normal(size=900), "same": np.full(500, 2.5), "two": np.repeat([-1.0, 1.0], 300), "wide": np.concatenate((rng.normal(size=50) * 1e200, rng.normal(size=50) * 1e-200, np.zeros(9))),
        "ties": rng.integers(0, 5, 700).astype(float), "one": np.array([3.0]), "close": 1 + rng.integers(0, 40, 300) * 2.0**-52,
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("normal", None), ("normal", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "gene string, x double").repartition(4)
    asked = [(g, f"r{r}", r) for g, vs in groups.items() for r in sorted({0, len(vs) // 3, len(vs) - 1, len(vs), -1})] + [("none", "r0", 0), ("other", "r0", 0)]
    got = {(r[0], r[1]): r[2] for r in Q.order_statistics(df, ["gene"], "x", spark.createDataFrame(asked, "gene string, name string, rank int"), few).collect()}
    assert got == {(g, name): float(np.sort(groups[g])[r]) for g, name, r in asked if g in groups and 0 <= r < len(groups[g])}


@pytest.mark.parametrize("few", [2, 2000])
def test_percentiles(spark, few):
    rng = np.random.default_rng(few)
    groups = {f"g{i}": rng.gamma(0.3, 5, n) for i, n in enumerate((1, 2, 10, 333, 1000))}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "gene string, mean double")
    got = {r["gene"]: (r["low"], r["mid"], r["high"]) for r in Q.percentiles(df, ["gene"], "mean", {"low": 0.0, "mid": 0.37, "high": 0.99}, few).collect()}
    for g, vs in groups.items():
        assert got[g] == pytest.approx(tuple(np.quantile(vs, [0, 0.37, 0.99])), rel=1e-12)
    assert [r["gene"] for r in profile.percentile_range(df).where("low > high").collect()] == []
    assert Q.percentiles(df.where("false"), ["gene"], "mean", {"low": 0.5}).count() == 0


def test_nearest_rank(spark):
    got = [r[0] for r in spark.range(1, 8).select(Q.nearest_rank(F.col("id"), 80)).collect()]
    assert got == [-(-80 * n // 100) - 1 for n in range(1, 8)]
