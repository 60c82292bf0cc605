"""Scoring a table with a model, and the projections made from class probabilities.

A *scorer* is any function that takes a DataFrame with the feature columns and adds ``p0, p1, p2, pred``;
``FittedModel.score`` is one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import N_CLASSES, RiskConfig
from ..functions import class_label, clean, confidence, q, round_percent, stack, text
from ..functions.expressions import case_map, literal, percent_sql

Scorer = Callable[[DataFrame], DataFrame]
PROBS = tuple(f"p{k}" for k in range(N_CLASSES))


def add_percentages(scored: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Label text, one-decimal percents and confidence; rounded here so later filters see rounded values."""
    return scored.withColumns({
        "risk_label": class_label("pred", cfg),
        "pct_high": round_percent("p0"),
        "pct_medium": round_percent("p1"),
        "pct_low": round_percent("p2"),
        "confidence": confidence(*PROBS),
    })


def score_table(prepared: DataFrame, scorer: Scorer, cfg: RiskConfig) -> DataFrame:
    """Score every row, training rows included; ``is_train`` tells them apart when a split is known."""
    out = add_percentages(scorer(prepared), cfg)
    return out.withColumn("is_train", F.expr("split = 'train'")) if "split" in prepared.columns else out


def complete_record(df: DataFrame, cfg: RiskConfig, features: Sequence[str]) -> DataFrame:
    """Look up category codes, then count every absent or missing feature as 0.0 (not the median)."""
    source = {enc: c for c, enc in cfg.encoded_names.items()}
    values = {}
    for f in features:
        if f in df.columns:
            values[f] = F.expr(f"coalesce({clean(f)}, 0D)")
        elif source.get(f) in df.columns:
            values[f] = F.expr(f"cast({case_map(source[f], cfg.categories[source[f]], 0)} as double)")
        else:
            values[f] = F.lit(0.0)
    return df.withColumns(values)


def score_partial(
    df: DataFrame, scorer: Scorer, cfg: RiskConfig, features: Sequence[str] | None = None
) -> DataFrame:
    """Score records that may lack features. Stateless, so it works on batch and streaming frames."""
    return add_percentages(scorer(complete_record(df, cfg, features or cfg.features)), cfg)


def class_probabilities(scored: DataFrame, cfg: RiskConfig, id_col: str | None = None) -> DataFrame:
    """One row per (entity, class)."""
    rows = [
        (str(k), text(cfg.labels[k]), p, percent_sql(p), f"pred = {k}") for k, p in enumerate(PROBS)
    ]
    return scored.selectExpr(
        q(id_col or cfg.id_col), stack(rows, ("class", "risk_label", "probability", "percent", "is_predicted"))
    )


def profile_presets(
    spark: SparkSession, cfg: RiskConfig, presets: Mapping[str, Mapping[str, object]] | None = None
) -> DataFrame:
    """Named input records of the configuration, one row each."""
    presets = cfg.presets if presets is None else presets
    columns = sorted({c for record in presets.values() for c in record})
    rows = [(text(name), *[literal(record.get(c)) for c in columns]) for name, record in presets.items()]
    return spark.range(1).selectExpr(stack(rows, ("preset", *columns)))
