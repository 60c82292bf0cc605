"""Exact order statistics against numpy, with hot values and heavy tails."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators.evaluate import auc_ovr, auc_ovr_macro, roc_curve_macro
from riskspark.operators.ordered import exact_quantiles, running_totals


def skewed_values(n=3000, seed=3):
    """A third of the rows share one value; the rest has a heavy tail on both sides."""
    rng = np.random.default_rng(seed)
    x = np.exp(rng.normal(0, 6, n)) * rng.choice([-1, 1], n)
    x[: n // 3] = 1.5
    return x


def test_quantiles_of_skewed_values(spark):
    x = skewed_values()
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    row = exact_quantiles(df, ["x"], (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)).first()
    for p, name in ((0.0, "p0"), (0.1, "p10"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.999, "p99_9"), (1.0, "p100")):
        assert row[name] == pytest.approx(np.quantile(x, p), rel=1e-12)
    assert row["n_values"] == len(x)


def test_quantiles_per_group_and_column(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), float(a), None if a > 1 else float(a * g)) for g, a in zip(rng.integers(0, 4, 500), rng.normal(size=500))]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    got = {(r["g"], r["feature"]): r["p50"] for r in exact_quantiles(df, ["a", "b"], (0.5,), by=["g"]).collect()}
    for g in range(4):
        a = [r[1] for r in rows if r[0] == g]
        b = [r[2] for r in rows if r[0] == g and r[2] is not None]
        assert got[g, "a"] == pytest.approx(np.median(a))
        assert got[g, "b"] == pytest.approx(np.median(b))


def test_even_median_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,), (float("nan"),)], "x double")
    assert exact_quantiles(df, ["x"], (0.5,)).first()["p50"] == 2.5


def test_running_totals(spark):
    x = np.unique(skewed_values(800))
    w = np.arange(1, len(x) + 1)
    df = spark.createDataFrame([("k", float(a), int(b)) for a, b in zip(x, w)], "k string, v double, w bigint")
    got = {r["v"]: (r["before_w"], r["total_w"]) for r in running_totals(df, ["k"], "v", ["w"]).collect()}
    before = np.concatenate([[0], np.cumsum(w)[:-1]])
    assert got == {float(a): (int(b), int(w.sum())) for a, b in zip(x, before)}


def scored_rows(n=400, seed=1, decimals=2):
    """Scores with many ties between and within classes."""
    rng = np.random.default_rng(seed)
    label = rng.choice(3, n, p=[0.2, 0.6, 0.2])
    p = rng.dirichlet([1, 1, 1], n)
    p[np.arange(n), label] += 0.3
    p = np.round(p / p.sum(axis=1, keepdims=True), decimals)
    return label, p


def scored_frame(spark, label, p):
    rows = [("m", int(k), int(v.argmax()), *map(float, v)) for k, v in zip(label, p)]
    return spark.createDataFrame(rows, "model string, label int, pred int, p0 double, p1 double, p2 double")


def test_auc_counts_every_pair_with_half_credit_for_ties(spark):
    label, p = scored_rows()
    got = {r["class"]: r["auc"] for r in auc_ovr(scored_frame(spark, label, p), ["model"]).collect()}
    for k in range(3):
        pos, neg = p[label == k, k], p[label != k, k]
        wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
        assert got[k] == pytest.approx(wins / (len(pos) * len(neg)))


def test_auc_is_null_when_a_class_is_missing(spark):
    label, p = scored_rows()
    df = scored_frame(spark, label, p).filter("label <> 2")
    assert auc_ovr_macro(df, ["model"]).first()["roc_auc"] is None


@pytest.mark.parametrize("decimals", [1, 6])
def test_roc_curve_equals_interpolation_of_the_steps(spark, decimals):
    label, p = scored_rows(decimals=decimals)
    grid = np.linspace(0, 1, 200)
    mean = np.zeros(200)
    for k in range(3):
        cuts = np.unique(p[:, k])[::-1]
        pos, neg = label == k, label != k
        tpr = np.array([0, *[(p[pos, k] >= c).mean() for c in cuts]])
        fpr = np.array([0, *[(p[neg, k] >= c).mean() for c in cuts]])
        mean += np.interp(grid, fpr, tpr) / 3
    rows = roc_curve_macro(scored_frame(spark, label, p), ["model"]).orderBy("grid").collect()
    assert [r["grid"] for r in rows] == list(range(200))
    assert np.allclose([r["tpr"] for r in rows], mean, atol=2e-6)
    assert rows[0]["auc"] == pytest.approx(np.trapezoid(mean, grid), abs=2e-6)


def test_quantile_plan_never_ranks_a_whole_feature(spark):
    """Each window over values is partitioned by bucket, not only by feature."""
    df = spark.range(100).select(F.col("id").cast("double").alias("x"))
    plan = exact_quantiles(df, ["x"], (0.5,))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "value" in line]
    assert windows and all("_bucket" in w for w in windows)
