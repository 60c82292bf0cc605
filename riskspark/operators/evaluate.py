"""Evaluation over any scored table with ``label, pred, p0, p1, p2`` and optional grouping keys.

``keys`` are few by construction (model names, fold numbers).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import N_CLASSES, RiskConfig
from ..functions import q, stack
from .ordered import running_totals

CLASSES = range(N_CLASSES)


def _cells(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with the nine cell counts ``_c<label><pred>``."""
    return scored.groupBy(*keys).agg(*[
        F.expr(f"count_if(label = {i} and pred = {j}) as _c{i}{j}") for i in CLASSES for j in CLASSES
    ])


def confusion_matrix(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All nine ``(label, pred, n)`` cells per key, empty ones included."""
    rows = [(str(i), str(j), f"_c{i}{j}") for i in CLASSES for j in CLASSES]
    return _cells(scored, keys).selectExpr(*[q(k) for k in keys], stack(rows, ("label", "pred", "n")))


def confusion_normalised(confusion: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of each predicted class within its real class."""
    names = [q(k) for k in keys]
    row = f"sum(n) over (partition by {', '.join([*names, 'label'])})"  # nine rows per key
    return confusion.selectExpr(*names, "label", "pred", "n", f"round(n / ({row} + 1e-9D), 6) as share")


def macro_metrics(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro precision, recall and F1 over the classes seen in truth or prediction."""
    hit = [f"_c{k}{k}" for k in CLASSES]
    real = ["(" + " + ".join(f"_c{k}{j}" for j in CLASSES) + ")" for k in CLASSES]
    said = ["(" + " + ".join(f"_c{i}{k}" for i in CLASSES) + ")" for k in CLASSES]
    total = "(" + " + ".join(real) + ")"
    seen = "(" + " + ".join(f"if({real[k]} + {said[k]} > 0, 1, 0)" for k in CLASSES) + ")"

    def mean_over_seen(parts: list[tuple[str, str]]) -> str:
        ratios = " + ".join(f"coalesce({a} / nullif({b}, 0), 0D)" for a, b in parts)
        return f"round(({ratios}) / nullif({seen}, 0), 4)"

    return _cells(scored, keys).selectExpr(
        *[q(k) for k in keys],
        f"{total} as n",
        f"round(({' + '.join(hit)}) / nullif({total}, 0), 4) as accuracy",
        f"{mean_over_seen(list(zip(hit, said)))} as precision",
        f"{mean_over_seen(list(zip(hit, real)))} as recall",
        f"{mean_over_seen([(f'2 * {hit[k]}', f'{real[k]} + {said[k]}') for k in CLASSES])} as f1",
    )


def _ranked_scores(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct scores per (key, class) with positives and negatives at and below each score."""
    per_class = stack([(str(k), f"p{k}", f"label = {k}") for k in CLASSES], ("class", "score", "_hit"))
    counts = (
        scored.selectExpr(*[q(k) for k in keys], per_class)
        .groupBy(*keys, "class", "score")
        .agg(F.expr("count_if(_hit) as pos"), F.expr("count_if(not _hit) as neg"))
    )
    return running_totals(counts, [*keys, "class"], "score", ["pos", "neg"])


def auc_ovr(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest AUC per class from rank sums, ties counted half; null when a side is empty."""
    return _ranked_scores(scored, keys).groupBy(*keys, "class").agg(
        F.expr("sum(pos * (before_neg + neg / 2D)) as _wins"),
        F.expr("max(cast(total_pos as double) * total_neg) as _pairs"),
    ).selectExpr(*[q(k) for k in keys], "class", "_wins / nullif(_pairs, 0D) as auc")


def auc_ovr_macro(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the per-class AUCs; null when any class is absent from the truth."""
    return auc_ovr(scored, keys).groupBy(*keys).agg(
        F.expr(f"round(if(count(auc) = {N_CLASSES}, avg(auc), null), 4) as roc_auc")
    )


def roc_curve_macro(scored: DataFrame, keys: Sequence[str] = (), points: int = 200) -> DataFrame:
    """Mean of the per-class ROC curves on an even grid of false-positive rates, with its trapezoid AUC.

    Walking down from the highest score, each distinct score with negatives is one curve segment, from
    the counts above it to the counts including it. A segment emits exactly the grid points it covers, found
    with integer arithmetic; no range join is needed. At a repeated rate the last point counts.
    """
    steps, names = points - 1, [q(k) for k in keys]
    segments = _ranked_scores(scored, keys).filter("neg > 0 and total_pos > 0").selectExpr(
        *names, "class", "pos", "neg", "total_pos as _P", "total_neg as _N",
        "total_pos - before_pos - pos as _tp", "total_neg - before_neg - neg as _fp",
    ).selectExpr(
        "*",
        f"cast((_fp * {steps} + _N - 1) div _N as int) as _first",
        f"cast(((_fp + neg) * {steps} - 1) div _N as int) as _last",
    )
    inner = segments.filter("_first <= _last").selectExpr("*", "explode(sequence(_first, _last)) as grid").selectExpr(
        *names, "class", "grid", f"(_tp + pos * ((grid * _N / {steps}D - _fp) / neg)) / _P as tpr"
    )
    # The curve ends at (1, 1); the lowest score of each class supplies that grid point.
    end = segments.filter("_fp + neg = _N").selectExpr(*names, "class", f"{steps} as grid", "1D as tpr")
    curve = inner.unionByName(end).groupBy(*keys, "grid").agg(
        F.expr(f"sum(tpr) / {N_CLASSES} as tpr"), F.expr("count(1) as _classes")
    ).filter(f"_classes = {N_CLASSES}")
    whole = f"partition by {', '.join(names)}" if names else ""  # `points` rows per key
    return curve.selectExpr(
        *names,
        "grid",
        f"round(grid / {steps}D, 6) as fpr",
        "round(tpr, 6) as tpr",
        f"round(sum(if(grid in (0, {steps}), tpr / 2, tpr)) over ({whole}) / {steps}, 6) as auc",
    )


# --- metric tables (one row per model and metric) -------------------------------------------------

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")


def model_metrics(scored: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Macro metrics and AUC side by side, one row per key."""
    auc = auc_ovr_macro(scored, keys)
    metrics = macro_metrics(scored, keys)
    return metrics.join(F.broadcast(auc), list(keys), "left")  # one row per model


def fold_scores(scored: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Macro F1 per (key, fold) from out-of-fold predictions."""
    return macro_metrics(scored, [*keys, "fold"]).select(*keys, "fold", F.col("f1").alias("f1_macro"))


def cv_summary(folds: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and population deviation of the fold scores."""
    return folds.groupBy(*keys).agg(
        F.expr("round(avg(f1_macro), 4) as cv_mean"), F.expr("round(stddev_pop(f1_macro), 4) as cv_std")
    )


def model_comparison(metrics: DataFrame, cv: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Metrics with cross-validation columns, its text form, and a star on the main model."""
    return metrics.join(F.broadcast(cv), "model", "left").select(  # one row per model
        "model",
        *METRICS,
        "cv_mean",
        "cv_std",
        F.format_string("%.4f ± %.4f", "cv_mean", "cv_std").alias("cv_text"),
        F.when(F.col("model") == cfg.main_model, "★").otherwise("").alias("main"),
    )


def metric_long(comparison: DataFrame, columns: Sequence[str] = (*METRICS, "cv_mean")) -> DataFrame:
    return comparison.unpivot("model", list(columns), "metric", "value")


def leakage_delta(long_metrics: DataFrame, full: str, reduced: str, n_features: int) -> DataFrame:
    """Reduced minus full model per metric; null when either side has no value."""
    sides = long_metrics.filter(F.col("model").isin(full, reduced)).groupBy("metric").agg(
        F.max(F.when(F.col("model") == full, F.col("value"))).alias("full_value"),
        F.max(F.when(F.col("model") == reduced, F.col("value"))).alias("reduced_value"),
    )
    delta = "round(reduced_value - full_value, 4)"
    return sides.selectExpr(
        "metric", "full_value", "reduced_value", f"{delta} as delta", f"abs({delta}) as gap",
        f"{n_features} as n_features",
    )


def success_gate(metrics: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Whether each model's macro F1 reaches the target."""
    target = f"{cfg.f1_target!r}D"
    return metrics.selectExpr("model", "f1", f"{target} as target", f"coalesce(f1 >= {target}, false) as reached")
