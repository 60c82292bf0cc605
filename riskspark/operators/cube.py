"""Stored cubes of sufficient statistics: cohort figures without going back to the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions import clean, q
from ..functions.expressions import literal
from .cohort import LEVELS, _class_counts

COUNTS = ("n", *[f"n_{k}" for k in LEVELS])


def cohort_cells(df: DataFrame, cfg: RiskConfig, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per combination of ``dims`` and age, null being a value: rows, rows per class, and count and sum of each measure.

    Statistics only add up, so the cells of new rows can be put to stored ones. The rows are read once and
    combined in each task; a busy cell costs a row per task.
    """
    sums = [e for i, c in enumerate(measures) for e in (f"count({clean(c)}) as c{i}", f"sum({clean(c)}) as s{i}")]
    return df.groupBy(*dims, cfg.age_col).agg(*[F.expr(e) for e in (
        "count(1) as n", *[f"count_if({q(cfg.label_col)} = {k}) as n_{name}" for k, name in enumerate(LEVELS)], *sums,
    )])


def cohort_cube(cells: DataFrame, cfg: RiskConfig, dims: Sequence[str]) -> DataFrame:
    """The cells summed over every subset of ``dims``; age stays apart, for ranges. Works on cells alone.

    ``level`` has a bit per dimension, the first being the highest: 1 where the row covers all its values.
    Several cells of the same combination, as after appending, are summed up.
    """
    sums = [c for c in cells.columns if c not in (*dims, cfg.age_col)]
    sets = [[*[d for d, kept in zip(dims, some) if kept], cfg.age_col] for some in product((True, False), repeat=len(dims))]
    cube = cells.groupingSets(sets, *dims, cfg.age_col).agg(
        (F.grouping_id(*dims, cfg.age_col) / 2).cast("int").alias("level"), *[F.sum(c).alias(c) for c in sums]
    )
    return cube.select(*dims, cfg.age_col, "level", *sums)


def _chosen(cube: DataFrame, dims: Sequence[str], equals: Mapping[str, object]) -> str:
    """Condition of the cube's rows for one equality per named dimension (SQL text)."""
    unknown = set(equals) - set(dims)
    if unknown:
        raise ValueError(f"not in the cube: {sorted(unknown)}")
    level = sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if equals.get(d) is None)
    return " and ".join([f"level = {level}", *[f"{q(d)} = {literal(v)}" for d, v in equals.items() if v is not None]])


def kpis_from_cube(
    cube: DataFrame,
    cfg: RiskConfig,
    dims: Sequence[str],
    measures: Sequence[str],
    equals: Mapping[str, object] | None = None,
    age: tuple[float, float] | None = None,
    means: Mapping[str, str] | None = None,
) -> DataFrame:
    """What ``cohort_kpis`` gives for this cohort, from the stored cube; one row."""
    means = {"avg_total": cfg.score_col, **(cfg.summary_means if means is None else means)}
    inside = _chosen(cube, dims, equals or {})
    if age is not None:
        inside += f" and {q(cfg.age_col)} between {age[0]} and {age[1]}"
    whole = _chosen(cube, dims, {})
    total = lambda c: f"coalesce(sum(case when {inside} then {c} end), 0)"
    place = {c: i for i, c in enumerate(measures)}
    summed = cube.filter(f"({inside}) or ({whole})").selectExpr(
        *[f"{total(c)} as {c}" for c in COUNTS], f"coalesce(sum(case when {whole} then n end), 0) as n_total",
        *[f"sum(case when {inside} then {c}{place[m]} end) as {c}_{i}" for i, m in enumerate(means.values()) for c in "cs"],
    )
    return summed.selectExpr(
        "n", "n_total", *_shares(), *[f"round(s_{i} / nullif(c_{i}, 0), 1) as {q(a)}" for i, a in enumerate(means)]
    )


def _shares() -> list[str]:
    """Count and percent per class, by the rule of the direct query, from counts instead of rows."""
    rule = _class_counts("_", LEVELS, "n")
    out = []
    for k, name in enumerate(LEVELS):
        out += [part.replace(f"count_if(_ = {k})", f"n_{name}") for part in rule[2 * k : 2 * k + 2]]
    return out


def contrasts_from_cube(
    cube: DataFrame, cfg: RiskConfig, dims: Sequence[str], measures: Sequence[str], contrasts: Mapping[str, tuple[str, object]], by: str
) -> DataFrame:
    """What ``cohort_contrast`` gives for conditions ``dimension = value``, from the stored cube.

    The outside of a condition is what its dimension has with other values, null being on neither side.
    """
    score = list(measures).index(cfg.score_col)
    bit = {d: 1 << (len(dims) - 1 - i) for i, d in enumerate(dims)}
    every = sum(bit.values())
    parts = []
    for name, (dim, value) in contrasts.items():
        for cohort, level in ((f"cast({q(by)} as string)", every & ~bit[dim] & ~bit[by]), ("cast(null as string)", every & ~bit[dim] & ~bit[by])):
            rows = cube.filter(f"level = {level} and {q(dim)} is not null and {q(by)} is not null")
            side = f"{q(dim)} = {literal(value)}"
            sums = [
                F.expr(f"coalesce(sum(case when {test} then {c} end), 0) as _{c}_{at}")
                for at, test in (("in", side), ("out", f"not ({side})")) for c in ("n", "n_high", f"c{score}", f"s{score}")
            ]
            grouped = rows.withColumn("_cohort", F.expr(cohort)).groupBy("_cohort").agg(*sums)
            rate = {at: f"_n_high_{at} / nullif(_n_{at}, 0)" for at in ("in", "out")}
            mean = {at: f"_s{score}_{at} / nullif(_c{score}_{at}, 0)" for at in ("in", "out")}
            parts.append(grouped.selectExpr(
                f"{literal(name)} as contrast", "_cohort as cohort", "_n_in as n_in", "_n_out as n_out",
                f"round({rate['in']}, 6) as high_rate_in", f"round({rate['out']}, 6) as high_rate_out",
                f"round(({rate['in']}) / nullif({rate['out']}, 0D), 4) as relative_risk", f"round({mean['in']} - {mean['out']}, 4) as score_gap",
            ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
