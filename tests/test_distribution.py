"""Distribution data against direct computation."""

import numpy as np
import pytest

from riskspark.operators import distribution


def points(spark, n=300, seed=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(50, 15, n), 1)
    y = np.round(0.02 * (x - 40) ** 2 + rng.normal(0, 3, n), 2)
    k = rng.integers(0, 3, n)
    rows = [(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x, y, k))]
    return spark.createDataFrame(rows, "id int, x double, y double, label int"), x, y, k


def test_histogram(spark):
    df, x, _, k = points(spark)
    got = {(r["label"], r["bin"]): r["n"] for r in distribution.histogram_by_class(df, "x", "label", 10).collect()}
    slot = np.minimum(np.floor((x - x.min()) / ((x.max() - x.min()) / 10)), 9)
    for c in range(3):
        for b in range(10):
            assert got.get((c, b), 0) == int(((slot == b) & (k == c)).sum())


def test_box_and_outliers(spark):
    df, x, _, k = points(spark)
    stats = {r["label"]: r for r in distribution.box_stats_by_class(df, ["x"], "label").collect()}
    out = {(r["label"], r["id"]) for r in distribution.outliers_by_class(df, ["x"], "label", "id").collect()}
    want = set()
    for c in range(3):
        v = x[k == c]
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert stats[c]["p50"] == pytest.approx(q2, abs=1e-4)
        assert stats[c]["whisker_hi"] == v[v <= hi].max()
        want |= {(c, i) for i in np.flatnonzero((k == c) & ((x < lo) | (x > hi)))}
    assert out == want


def test_box_counts_repeats_and_leaves_out_gaps(spark):
    rows = [(0, v) for v in (1.0, 2.0, 2.0, 2.0, 3.0, 40.0, None, float("nan"))] + [(1, 5.0), (1, 5.0)]
    df = spark.createDataFrame(rows, "label int, x double").repartition(3)
    got = {r["label"]: r for r in distribution.box_stats_by_class(df, ["x"], "label").collect()}
    one, two = got[0], got[1]
    assert (one["n"], one["min"], one["p25"], one["p50"], one["p75"], one["max"]) == (6, 1.0, 2.0, 2.0, 2.75, 40.0)
    assert (one["mean"], one["whisker_lo"], one["whisker_hi"]) == (8.3333, 1.0, 3.0)
    assert (two["n"], two["min"], two["p50"], two["max"], two["whisker_lo"], two["whisker_hi"]) == (2, 5.0, 5.0, 5.0, 5.0, 5.0)


@pytest.mark.parametrize("rule", ["scott", "silverman"])
def test_density(spark, rule):
    df, x, _, k = points(spark)
    rows = distribution.density_by_class(df, ["x"], "label", points=20, bandwidth=rule).collect()
    for c in range(3):
        v = x[k == c]
        spread = v.std(ddof=1)
        if rule == "silverman":
            q1, q3 = np.quantile(v, [0.25, 0.75])
            spread = 1.059 * min(spread, (q3 - q1) / 1.349)
        h = spread * len(v) ** -0.2
        grid = np.linspace(v.min(), v.max(), 20)
        want = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
        got = [r["density"] for r in sorted((r for r in rows if r["label"] == c), key=lambda r: r["grid"])]
        assert np.allclose(got, want, atol=2e-6)


def lowess_at(x0, x, y, frac=2 / 3):
    k = int(frac * len(x) + 1e-10)
    d = np.abs(x - x0)
    h = np.sort(d)[k - 1]
    w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
    A = np.stack([np.ones_like(x), x - x0], axis=1)
    return np.linalg.lstsq(A * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][0]


def test_lowess_equals_a_direct_local_fit(spark):
    """Ten distinct x per unit and 1,000 cells: every cell holds one x, so the cells lose nothing."""
    df, x, y, _ = points(spark)
    rows = distribution.lowess_trend(df, "x", "y", points=15, passes=0).orderBy("grid").collect()
    grid = np.linspace(x.min(), x.max(), 15)
    assert np.allclose([r["y"] for r in rows], [lowess_at(g, x, y) for g in grid], atol=2e-4)


def robust_lowess_at(targets, x, y, passes, frac=2 / 3):
    """Fits at every point, bisquare weights of its residuals, and so on; at last the fits at the targets."""

    def fit(x0, weight):
        k = int(frac * len(x) + 1e-10)
        d = np.abs(x - x0)
        h = np.sort(d)[k - 1]
        w = np.sqrt(np.where(d < h, (1 - (d / h) ** 3) ** 3, 0) * weight)
        return np.linalg.lstsq(np.stack([w, w * (x - x0)], axis=1), y * w, rcond=None)[0][0]

    weight = np.ones(len(x))
    for _ in range(passes):
        r = np.abs(y - np.array([fit(v, weight) for v in x]))
        weight = np.maximum(0, 1 - (r / (6 * np.median(r))) ** 2) ** 2
    return [fit(v, weight) for v in targets]


@pytest.mark.parametrize("passes", [1, 3])
def test_robust_trend_equals_a_direct_fit_and_ignores_outliers(spark, passes):
    """500 rows, a tenth of them far off; every cell holds one x. Groups, one of them null, are fitted apart."""
    rng = np.random.default_rng(12)
    x = rng.permutation(500) / 10
    clean_y = np.sin(x / 8) * 10
    y = clean_y + rng.normal(0, 0.3, 500)
    far = rng.random(500) < 0.1
    y[far] += rng.choice([-60, 90], far.sum())
    label = np.where(np.arange(500) % 2, "a", None)
    rows = [(float(a), float(b), k) for a, b, k in zip(x, y, label)]
    df = spark.createDataFrame(rows, "x double, y double, label string").repartition(3)
    grid = np.linspace(x.min(), x.max(), 9)
    got = distribution.lowess_trend(df, "x", "y", frac=0.3, points=9, passes=passes).orderBy("grid").collect()
    assert np.allclose([r["y"] for r in got], robust_lowess_at(grid, x, y, passes, 0.3), atol=2e-4)
    if passes == 3:
        plain = distribution.lowess_trend(df, "x", "y", frac=0.3, points=9, passes=0).orderBy("grid").collect()
        error = [np.abs([r["y"] for r in rows] - np.sin(grid / 8) * 10).max() for rows in (got, plain)]
        assert error[0] < 1.5 and error[1] > 2 * error[0]
        for k in ("a", None):
            mine = label == k if k else np.array([v is None for v in label])
            part = sorted((r for r in distribution.lowess_trend(df, "x", "y", "label", 0.3, 5000, 4).collect() if r["label"] == k), key=lambda r: r["grid"])
            ends = np.linspace(x[mine].min(), x[mine].max(), 4)
            assert np.allclose([r["y"] for r in part], robust_lowess_at(ends, x[mine], y[mine], 3, 0.3), atol=2e-4)


def test_trend_of_a_line_has_no_residuals(spark):
    """A median residual of zero leaves only points on the line; rounding may leave none at all elsewhere."""
    df = spark.range(100).selectExpr("cast(id as double) as x", "if(id = 50, 7D, 0D) as y")
    rows = distribution.lowess_trend(df, "x", "y", frac=0.05, points=5).collect()
    assert len(rows) == 5 and all(r["y"] is None or abs(r["y"]) < 8 for r in rows)


def test_lowess_by_group_and_constant_x(spark):
    df, x, y, k = points(spark)
    rows = distribution.lowess_trend(df, "x", "y", by="label", points=5).collect()
    assert len(rows) == 15
    one = df.selectExpr("1D as x", "y")
    flat = distribution.lowess_trend(one, "x", "y", points=3).collect()
    assert all(r["y"] == pytest.approx(y.mean(), abs=1e-3) for r in flat)


def test_sample_is_exact_and_repeatable(spark):
    df, *_ = points(spark)
    one = {r["id"] for r in distribution.sample_rows(df.repartition(7), 50, "id", 1).collect()}
    two = {r["id"] for r in distribution.sample_rows(df.repartition(2), 50, "id", 1).collect()}
    assert one == two and len(one) == 50
    assert distribution.sample_rows(df, 1000, "id", 1).count() == 300
