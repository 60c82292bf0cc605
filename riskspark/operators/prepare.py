"""From raw table to model-ready table: label, codes, imputation, feature selection, scaling."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions import clean, clean_number, ordinal_code, q, risk_band, stack, text
from .ordered import exact_quantiles

log = logging.getLogger(__name__)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN -> null in every floating-point column."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: clean_number(c) for c in floats}) if floats else df


def add_label(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Class label, plus a flag for rows that are class 0 only because their score is missing."""
    return df.withColumns({
        cfg.label_col: risk_band(cfg.score_col, cfg),
        "is_unscored": F.expr(f"{clean(cfg.score_col)} is null"),
    })


def encode_categories(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    return df.withColumns({
        cfg.encoded_names[c]: ordinal_code(c, codes) for c, codes in cfg.categories.items()
    })


def available_features(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    kept = [c for c in wanted if c in df.columns]
    if len(kept) < len(wanted):
        log.warning("features not in the table: %s", sorted(set(wanted) - set(kept)))
    return kept


def medians(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """``(feature, p50)``. The approximate mode is one mergeable sketch per column."""
    if not approximate:
        return exact_quantiles(df, columns, (0.5,)).select("feature", "p50")
    sketches = df.selectExpr(*[
        f"percentile_approx({clean(c)}, 0.5, 10000) as _q{i}" for i, c in enumerate(columns)
    ])
    return sketches.selectExpr(stack([(text(c), f"_q{i}") for i, c in enumerate(columns)], ("feature", "p50")))


def _lookup(table: DataFrame, value: str) -> Column:
    """A small ``(feature, value)`` table as one map, computed once per query as a scalar subquery."""
    return table.selectExpr(f"map_from_entries(collect_list(struct(feature, {value})))").scalar()


def median_impute(
    df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None, approximate: bool = False
) -> DataFrame:
    """Replace missing features by the column median of ``fit_on`` (the whole table by default).

    A column without any value stays null; training then fails on it.
    """
    cols = list(columns)
    centre = _lookup(medians(fit_on if fit_on is not None else df, cols, approximate), "p50")
    filled = {c: F.expr(f"coalesce({clean(c)}, try_element_at(_medians, {text(c)}))") for c in cols}
    return df.withColumn("_medians", centre).withColumns(filled).drop("_medians")


def prepare(
    raw: DataFrame, cfg: RiskConfig, fit_on: str | None = None, approximate: bool = False
) -> DataFrame:
    """Label, encode and impute. ``fit_on`` is an optional row condition (SQL) for fitting the medians."""
    require_columns(raw, [cfg.score_col, *cfg.categories])
    coded = encode_categories(add_label(clean_numbers(raw), cfg), cfg)
    numeric = available_features(coded, cfg.numeric_features)
    train = coded.filter(fit_on) if fit_on is not None else None
    return median_impute(coded, numeric, train, approximate)


def select_features(df: DataFrame, cfg: RiskConfig, wanted: Sequence[str] | None = None) -> DataFrame:
    """Key, label and the available features in configured order, all as doubles."""
    kept = available_features(df, wanted or cfg.features)
    label = [cfg.label_col] if cfg.label_col in df.columns else []
    return df.selectExpr(
        q(cfg.id_col), *[q(c) for c in label], *[f"cast({q(c)} as double) as {q(c)}" for c in kept]
    )


def standard_scale(df: DataFrame, columns: Sequence[str], train: str) -> DataFrame:
    """``<c>_z``: centred and divided by the population deviation of the ``train`` rows (1 when it is zero).

    ``train`` is a row condition in SQL.
    """
    stats = df.selectExpr("struct(" + ", ".join(
        f"avg(case when {train} then {clean(c)} end) as m{i}, stddev_pop(case when {train} then {clean(c)} end) as s{i}"
        for i, c in enumerate(columns)
    ) + ") as stats").scalar()
    scaled = [
        f"({clean(c)} - _stats.m{i}) / coalesce(nullif(_stats.s{i}, 0D), 1D) as {q(c + '_z')}"
        for i, c in enumerate(columns)
    ]
    return df.withColumn("_stats", stats).selectExpr(*[q(c) for c in df.columns], *scaled)
