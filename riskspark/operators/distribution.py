"""Data behind distribution charts: histograms, box statistics, densities, samples, smooth trends."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean, hash_order_key, q
from ..sources.staging import stage
from .ordered import exact_quantiles, long_values, value_counts


def histogram_by_class(df: DataFrame, value: str, label: str, bins: int = 30) -> DataFrame:
    """Rows per (class, equal-width bin) between the overall minimum and maximum."""
    x = clean(value)
    span = df.selectExpr(f"struct(min({x}) as lo, max({x}) as hi) as s").scalar()
    width = f"((_s.hi - _s.lo) / {bins})"
    slot = f"coalesce(floor((_x - _s.lo) / nullif({width}, 0D)), 0)"
    return (
        df.selectExpr(f"{q(label)} as label", f"{x} as _x")
        .filter("_x is not null")
        .withColumn("_s", span)
        .selectExpr("label", f"cast(least({slot}, {bins - 1}) as int) as bin")
        .groupBy("label", "bin")
        .agg(F.expr("count(1) as n"))
    )


def _fences(df: DataFrame, values: Sequence[str], label: str) -> DataFrame:
    """Quartiles and 1.5 IQR fences per (class, feature): one row for each, so safe to broadcast."""
    quartiles = exact_quantiles(df, values, (0.25, 0.5, 0.75), by=[label])
    return quartiles.selectExpr("*", "p25 - 1.5D * (p75 - p25) as fence_lo", "p75 + 1.5D * (p75 - p25) as fence_hi")


def _long(df: DataFrame, values: Sequence[str], label: str, *keep: str) -> DataFrame:
    return long_values(df, values, [*keep, label])


def box_stats_by_class(df: DataFrame, values: Sequence[str], label: str) -> DataFrame:
    """Quartiles, mean, extremes and whiskers (outermost points within the fences) per class.

    Works on distinct values with counts, the same aggregate that the quartiles come from, so the table is
    read once.
    """
    counted = value_counts(df, values, [label])
    points = counted.join(F.broadcast(_fences(df, values, label)), [label, "feature"])
    inside = "case when value between fence_lo and fence_hi then value end"
    stats = points.groupBy(label, "feature").agg(*[F.expr(e) for e in (
        "sum(n) as n", "min(value) as min", "max(p25) as p25", "max(p50) as p50", "max(p75) as p75",
        "max(value) as max", "sum(n * value) / sum(n) as mean", f"min({inside}) as whisker_lo",
        f"max({inside}) as whisker_hi",
    )])
    numbers = ("min", "p25", "p50", "p75", "max", "mean", "whisker_lo", "whisker_hi")
    return stats.selectExpr(f"{q(label)} as label", "feature", "n", *[f"round({c}, 4) as {c}" for c in numbers])


def outliers_by_class(df: DataFrame, values: Sequence[str], label: str, id_col: str) -> DataFrame:
    """Points outside their class's fences."""
    fences = _fences(df, values, label).select(label, "feature", "fence_lo", "fence_hi")
    points = _long(df, values, label, id_col).join(F.broadcast(fences), [label, "feature"])
    return points.filter("value < fence_lo or value > fence_hi").selectExpr(
        q(id_col), f"{q(label)} as label", "feature", "value"
    )


BINS_PER_BANDWIDTH = 64
"""A density is off by at most 0.0703 / 64^4 = 4.2e-9 times the height of the kernel, and by far less where it is smooth."""


DENSITY_DIGITS = 6


def density_by_class(
    df: DataFrame, values: Sequence[str], label: str, points: int = 100, bandwidth: str = "scott"
) -> DataFrame:
    """Gaussian kernel density on an even grid from minimum to maximum, per class and feature.

    Every value spreads its weight over the four nearest bins so that cubics are kept (Lagrange weights); bins are a
    fraction of the bandwidth wide. Bins are summed map-side, so their number follows from range and bandwidth, not from
    the rows. Each grid point then adds up the bins within nine bandwidths, where the kernel has fallen below 1e-17.
    ``silverman`` uses 1.059 * min(std, iqr / 1.349) instead of std.
    """
    moments = _long(df, values, label).groupBy(label, "feature").agg(*[F.expr(e) for e in (
        "count(1) as _n", "stddev_samp(value) as _std", "min(value) as _lo", "max(value) as _hi",
    )])
    if bandwidth == "silverman":
        quartiles = exact_quantiles(df, values, (0.25, 0.75), by=[label])
        moments = moments.join(F.broadcast(quartiles.drop("n_values")), [label, "feature"])
        spread = "1.059D * least(_std, (p75 - p25) / 1.349D)"
    elif bandwidth == "scott":
        spread = "_std"
    else:
        raise ValueError(f"unknown bandwidth rule: {bandwidth}")
    moments = moments.selectExpr(
        q(label), "feature", "_n", "_lo", "_hi", f"nullif({spread} * pow(_n, -0.2D), 0D) as _h"
    )
    # moments: one row per class and feature.
    place = f"(value - _lo) / _h * {BINS_PER_BANDWIDTH}"
    shares = (
        "struct(_b - 1 as _b, -_t * (_t - 1D) * (_t - 2D) / 6D as _w), struct(_b, (_t + 1D) * (_t - 1D) * (_t - 2D) / 2D as _w), "
        "struct(_b + 1 as _b, -(_t + 1D) * _t * (_t - 2D) / 2D as _w), struct(_b + 2 as _b, (_t + 1D) * _t * (_t - 1D) / 6D as _w)"
    )
    bins = (
        _long(df, values, label).join(F.broadcast(moments.filter("_h is not null")), [label, "feature"])
        .selectExpr(q(label), "feature", f"floor({place}) as _b", f"{place} - floor({place}) as _t")
        .selectExpr(q(label), "feature", f"inline(array({shares}))")
        .groupBy(label, "feature", "_b").agg(F.expr("sum(_w) as _w"))
    )
    # A bin meets only the grid points within nine bandwidths, so a wide range with a narrow bandwidth costs one or none.
    step = f"((_hi - _lo) / {max(points - 1, 1)} / _h)"
    near = bins.join(F.broadcast(moments), [label, "feature"]).selectExpr(
        q(label), "feature", f"_b / {BINS_PER_BANDWIDTH}D as _u", "_w", f"{step} as _step"
    ).selectExpr("*", "greatest(ceil((_u - 9D) / _step), 0) as _from", f"least(floor((_u + 9D) / _step), {points - 1}) as _to")
    sums = (
        near.filter("_from <= _to").selectExpr("*", "explode(sequence(_from, _to)) as grid")
        .groupBy(label, "feature", "grid").agg(F.expr("sum(_w * exp(-0.5D * pow(grid * _step - _u, 2D))) as _sum"))
    )
    grid = moments.selectExpr("*", f"explode(sequence(0L, {points - 1}L)) as grid")
    at = grid.join(F.broadcast(sums), [label, "feature", "grid"], "left")  # both sides: a row per class, feature and grid point
    density = f"if(_h is null, null, coalesce(_sum, 0D)) / (_n * _h * {math.sqrt(2 * math.pi)!r}D)"
    return at.selectExpr(
        f"{q(label)} as label", "feature", "cast(grid as int) as grid", f"round(_lo + (_hi - _lo) * grid / {max(points - 1, 1)}, 6) as x",
        f"round({density}, {DENSITY_DIGITS}) as density",
    )


def sample_rows(df: DataFrame, k: int, id_col: str, seed: int) -> DataFrame:
    """At most ``k`` rows without replacement: the first in seeded hash order (a distributed top-k)."""
    return (
        df.withColumn("_key", F.expr(hash_order_key(id_col, seed)))
        .orderBy("_key", id_col)
        .limit(k)
        .drop("_key")
    )


def scatter_points(
    df: DataFrame, x: str, y: str, label: str, id_col: str, k: int, seed: int
) -> DataFrame:
    return sample_rows(df.select(id_col, x, y, label), k, id_col, seed).selectExpr(
        q(id_col), f"{q(x)} as x", f"{q(y)} as y", f"{q(label)} as label"
    )


def _local_lines(cells: DataFrame, frac: float, targets: str) -> DataFrame:
    """Tricube-weighted lines through the cells of each group: ``_g, target, x, value, slope`` at every target.

    ``cells`` is ``_g, _cell, n, x, w, wy``. ``targets`` is SQL for an array of ``struct(target, x)`` over ``_cells, _lo, _hi``. The
    bandwidth at a target is the distance within which a ``frac`` share of the points lies.
    """
    packed = cells.groupBy("_g").agg(*[F.expr(e) for e in (
        "collect_list(struct(x, n, w, wy, _cell)) as _cells", "sum(n) as _n", "min(x) as _lo", "max(x) as _hi",
    )])  # at most `cells` structs per group
    at = packed.selectExpr("*", f"inline({targets})").selectExpr(
        "_g", "target", "x", f"floor({frac!r}D * _n + 1e-10D) as _need",
        "array_sort(transform(_cells, c -> struct(abs(c.x - x) as d, c.n as n, c.x - x as u, c.w as w, c.wy as wy))) as _near",
    )
    reach = (
        "aggregate(_near, struct(0D as seen, 0D as h), (a, c) -> struct(a.seen + c.n as seen, "
        "if(a.seen < _need, c.d, a.h) as h), a -> a.h)"
    )
    tricube = "if(_h > 0, if(c.d < _h, pow(1D - pow(c.d / _h, 3D), 3D), 0D), if(c.d = 0, 1D, 0D))"
    weighted = at.selectExpr("*", f"{reach} as _h").selectExpr(
        "_g", "target", "x", f"transform(_near, c -> struct({tricube} as t, c.w as w, c.u as u, c.wy as wy)) as _near"
    )
    # Sums of the centred x keep the normal equations well conditioned.
    fit = (
        "aggregate(_near, struct(0D as w, 0D as wx, 0D as wy, 0D as wxx, 0D as wxy), (a, c) -> struct("
        "a.w + c.t * c.w as w, a.wx + c.t * c.w * c.u as wx, a.wy + c.t * c.wy as wy, "
        "a.wxx + c.t * c.w * c.u * c.u as wxx, a.wxy + c.t * c.wy * c.u as wxy))"
    )
    det = "(_f.w * _f.wxx - _f.wx * _f.wx)"
    whole = f"nullif(if(abs({det}) > 1e-12D * _f.w * _f.w, {det}, 0D), 0D)"
    return weighted.selectExpr("_g", "target", "x", f"{fit} as _f").selectExpr(
        "_g", "target", "x",
        f"coalesce((_f.wxx * _f.wy - _f.wx * _f.wxy) / {whole}, _f.wy / nullif(_f.w, 0D)) as value",
        f"coalesce((_f.w * _f.wxy - _f.wx * _f.wy) / {whole}, 0D) as slope",
    )


def _robust_weights(rows: DataFrame, cells: DataFrame, frac: float) -> DataFrame:
    """``rows`` with the bisquare weight ``_w`` of each point's distance from the trend through ``cells``.

    The scale of a group is six times the exact median of its absolute distances. Points of a group in one cell keep the weight 1:
    they have a mean and no trend to lie away from.
    """
    every_cell = "transform(_cells, c -> struct(c._cell as target, c.x as x))"
    lines = stage(_local_lines(cells, frac, every_cell).withColumnRenamed("target", "_cell"), "trend_lines")
    away = rows.drop("_w").join(F.broadcast(lines), ["_g", "_cell"]).selectExpr(  # a row per group and cell
        "_g", "_cell", "_x", "_y", "abs(_y - (value + slope * (_x - x))) as _r"
    )
    sizes = cells.groupBy("_g").agg(F.expr("count(1) as _k"))  # a row per group
    halves = exact_quantiles(away, ["_r"], (0.5,), by=["_g"]).join(F.broadcast(sizes), "_g")
    medians = stage(halves.selectExpr("_g", "if(_k = 1, null, p50) as _median"), "trend_medians")
    u = "_r / (6D * _median)"
    bisquare = f"case when _median is null then 1D when _median = 0 then if(_r = 0, 1D, 0D) when _r < 6D * _median then pow(1D - pow({u}, 2D), 2D) else 0D end"
    return away.join(F.broadcast(medians), "_g").selectExpr("_g", "_cell", "_x", "_y", f"{bisquare} as _w")  # a row per group


def lowess_trend(
    df: DataFrame,
    x: str,
    y: str,
    by: str | None = None,
    frac: float = 2 / 3,
    cells: int = 1000,
    points: int = 100,
    passes: int = 3,
) -> DataFrame:
    """Locally weighted linear trend of ``y`` on ``x`` over an even grid, per value of ``by`` (few, null being one).

    Points are summed into at most ``cells`` equal-width cells of x, each standing at its own mean x (exact
    when a cell holds one distinct x). At a grid point the bandwidth is the distance within which a ``frac``
    share of the points lies; cells get tricube weights and a closed-form line is fitted. After the cell
    aggregate the work no longer depends on the number of rows.

    Each of the robustness ``passes`` measures every point's distance from the trend at its cell, weighs points by the
    bisquare of that distance over six exact medians, and sums the cells again. Bandwidths keep counting all points.
    """
    group = f"to_json(struct({q(by)}))" if by else "''"
    rows = df.selectExpr(*([f"{q(by)} as _by"] if by else []), f"{group} as _g", f"{clean(x)} as _x", f"{clean(y)} as _y")
    rows = rows.filter("_x is not null and _y is not null")
    span = rows.selectExpr("struct(min(_x) as lo, max(_x) as hi) as s").scalar()
    place = f"(_x - _s.lo) / nullif(_s.hi - _s.lo, 0D) * {cells}"
    rows = rows.withColumn("_s", span).withColumn("_cell", F.expr(f"least(coalesce(floor({place}), 0), {cells - 1})")).drop("_s")
    rows = stage(rows, "trend_rows") if passes else rows

    def summed(weighted: DataFrame) -> DataFrame:
        return weighted.groupBy("_g", "_cell").agg(*[F.expr(e) for e in (
            "cast(count(1) as double) as n", "avg(_x) as x", "sum(_w) as w", "sum(_w * _y) as wy",
        )])

    points_of = rows.withColumn("_w", F.lit(1.0))
    now = summed(points_of)
    for _ in range(passes):
        now = stage(now, "trend_cells")
        now = summed(_robust_weights(points_of, now, frac))
    grid = f"transform(sequence(0, {points - 1}), i -> struct(i as target, _lo + (_hi - _lo) * i / {points - 1} as x))"
    found = _local_lines(now, frac, grid).selectExpr("_g", "target as grid", "round(x, 6) as x", "round(value, 4) as y")
    if not by:
        return found.drop("_g")
    names = rows.groupBy("_g").agg(F.first("_by").alias(by))
    return found.join(F.broadcast(names), "_g").select(by, "grid", "x", "y")  # a row per group
