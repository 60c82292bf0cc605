"""Filters, summaries, correlations, group counts and rankings over a prepared or scored table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import N_CLASSES, RiskConfig
from ..functions import clean, display_name, pearson, q, stack, text
from ..functions.expressions import half_up_sql, literal


def _class_counts(label: str, names: Sequence[str], total: str) -> list[str]:
    """Count and percent per class; percents are null on an empty table."""
    out = []
    for k, name in enumerate(names):
        n = f"count_if({label} = {k})"
        share = half_up_sql(f"100D * {n} / nullif({total}, 0)", 1)
        out += [f"{n} as n_{name}", f"{share} as pct_{name}"]
    return out


LEVELS = ("high", "medium", "low")


# --- filters ---------------------------------------------------------------------------------------

def cohort_filter(
    df: DataFrame,
    cfg: RiskConfig,
    equals: Mapping[str, str] | None = None,
    age: tuple[float, float] | None = None,
) -> DataFrame:
    """Category equality (skip a category by leaving it out) and an inclusive age range."""
    out = df
    for c, v in (equals or {}).items():
        if v is not None:
            out = out.filter(F.col(c) == v)
    if age is not None:
        out = out.filter(F.col(cfg.age_col).between(*age))
    return out


def alert_filter(
    scored: DataFrame,
    cfg: RiskConfig,
    labels: Sequence[str] = (),
    segment: str | None = None,
    min_confidence: float = 60.0,
) -> DataFrame:
    """Keep the chosen risk labels (none chosen = all), one segment, and confident predictions."""
    out = scored.filter(F.col("risk_label").isin(list(labels))) if labels else scored
    if segment is not None:
        out = out.filter(F.col(cfg.segment_col) == segment)
    return out.filter(F.col("confidence") >= min_confidence)


def high_stress_filter(df: DataFrame, stress_col: str, threshold: float = 7.0) -> DataFrame:
    return df.filter(f"{clean(stress_col)} > {float(threshold)!r}D")


# --- summaries -------------------------------------------------------------------------------------

def eda_summary(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Size, class balance, score mean and deviation, and the configured feature means; one row."""
    score = clean(cfg.score_col)
    return df.selectExpr(
        "count(1) as n_total",
        *_class_counts(q(cfg.label_col), LEVELS, "count(1)"),
        f"round(avg({score}), 2) as avg_total",
        f"round(stddev_samp({score}), 2) as std_total",
        *[f"round(avg({clean(c)}), 2) as {q(a)}" for a, c in cfg.summary_means.items()],
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value for several category columns in one pass; missing values are not counted."""
    pairs = stack([(text(c), q(c)) for c in columns], ("column_name", "value"))
    return (
        df.selectExpr(pairs)
        .filter("value is not null")
        .groupBy("column_name", "value")
        .agg(F.expr("count(1) as n"))
        .orderBy("column_name", F.desc("n"), "value")
    )


def cohort_kpis(
    df: DataFrame,
    cfg: RiskConfig,
    equals: Mapping[str, str] | None = None,
    age: tuple[float, float] | None = None,
    means: Mapping[str, str] | None = None,
) -> DataFrame:
    """Size of the cohort against the whole table, class balance and means, in one scan.

    The cohort is a condition inside the aggregates rather than a filter, so the whole-table count comes
    from the same pass. An empty cohort has zero counts and null ratios.
    """
    tests = [f"{q(c)} = {literal(v)}" for c, v in (equals or {}).items() if v is not None]
    if age is not None:
        tests.append(f"{q(cfg.age_col)} between {age[0]} and {age[1]}")
    inside = " and ".join(tests) or "true"
    n = f"count_if({inside})"
    means = {"avg_total": cfg.score_col, **(cfg.summary_means if means is None else means)}
    return df.selectExpr(
        f"{n} as n",
        "count(1) as n_total",
        *_class_counts(f"(case when {inside} then {q(cfg.label_col)} end)", LEVELS, n),
        *[f"round(avg(case when {inside} then {clean(c)} end), 1) as {q(a)}" for a, c in means.items()],
    )


def alert_kpis(view: DataFrame) -> DataFrame:
    """Size of an alert view and count and percent per predicted class."""
    return view.selectExpr("count(1) as n", *_class_counts("pred", LEVELS, "count(1)"))


def group_risk_count(
    df: DataFrame, group: str, risk: str, order: Sequence[str] | None = None
) -> DataFrame:
    """Rows per (group, class); missing groups are dropped. ``order`` fixes the order of the groups."""
    counts = (
        df.filter(f"{q(group)} is not null and {q(risk)} is not null")
        .groupBy(group, risk)
        .agg(F.expr("count(1) as n"))
    )
    if order is None:
        return counts.orderBy(group, risk)
    position = f"nullif(array_position(array({', '.join(literal(v) for v in order)}), {q(group)}), 0)"
    return counts.orderBy(F.expr(position).asc_nulls_last(), group, risk)


def risk_share(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Count and share per class, classes without rows included."""
    counts = df.selectExpr(
        "count(1) as _all", *[f"count_if({q(cfg.label_col)} = {k}) as _n{k}" for k in range(N_CLASSES)]
    )
    return counts.selectExpr(stack(
        [
            (str(k), text(cfg.labels[k]), f"_n{k}", f"round(_n{k} / nullif(_all, 0), 6)")
            for k in range(N_CLASSES)
        ],
        ("label", "risk_label", "n", "share"),
    ))


def cohort_contrast(
    df: DataFrame, cfg: RiskConfig, contrasts: Mapping[str, str], by: str
) -> DataFrame:
    """For each named condition (SQL text): high-risk rate and mean score inside and outside it.

    One pass gives the whole table (``cohort`` null) and every value of ``by``. ``relative_risk`` is the ratio
    of the two rates, ``score_gap`` the difference of the two means. Rows where the condition is unknown
    belong to neither side.
    """
    score = clean(cfg.score_col)
    high = f"cast({q(cfg.label_col)} = 0 as double)"
    aggs = []
    for i, cond in enumerate(contrasts.values()):
        for side, test in (("in", f"({cond})"), ("out", f"not ({cond})")):
            aggs += [
                f"count_if({test}) as _n_{side}{i}",
                f"avg(case when {test} then {high} end) as _r_{side}{i}",
                f"avg(case when {test} then {score} end) as _m_{side}{i}",
            ]
    grouped = (
        df.filter(f"{q(by)} is not null").groupingSets([[], [by]], by).agg(*[F.expr(a) for a in aggs])
    )
    return grouped.selectExpr(stack(
        [
            (
                text(name), q(by), f"_n_in{i}", f"_n_out{i}", f"round(_r_in{i}, 6)", f"round(_r_out{i}, 6)",
                f"round(_r_in{i} / nullif(_r_out{i}, 0D), 4)", f"round(_m_in{i} - _m_out{i}, 4)",
            )
            for i, name in enumerate(contrasts)
        ],
        ("contrast", "cohort", "n_in", "n_out", "high_rate_in", "high_rate_out", "relative_risk", "score_gap"),
    ))


# --- correlations ----------------------------------------------------------------------------------

def target_correlation(df: DataFrame, cfg: RiskConfig, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson of each column with the score over rows complete in all of them; 0.0 when constant."""
    cols = [c for c in (columns or cfg.correlation_cols) if c in df.columns]
    complete = df.selectExpr(*[f"{clean(c)} as {q(c)}" for c in [*cols, cfg.score_col]]).dropna()
    wide = complete.selectExpr(*[
        f"coalesce(round({pearson(c, cfg.score_col)}, 3), 0D) as _r{i}" for i, c in enumerate(cols)
    ])
    return wide.selectExpr(stack([(text(c), f"_r{i}") for i, c in enumerate(cols)], ("feature", "r")))


def correlation_rank(correlations: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Strongest first, with readable names."""
    return correlations.select(
        "feature", display_name("feature", cfg).alias("display"), "r", F.abs("r").alias("strength")
    ).orderBy(F.desc("strength"), "feature")


def correlation_matrix(df: DataFrame, columns: Sequence[str], decimals: int = 2) -> DataFrame:
    """Pairwise Pearson as ``(x, y, r)``, each pair over its own complete rows; null when constant.

    Each row is unpivoted to its column pairs (upper triangle) and combined map-side, so a task shuffles one
    row per pair. One wide aggregate over all pairs would hold hundreds of buffer fields, too many to compile.
    """
    cols = [c for c in columns if c in df.columns]
    width = len(cols)
    pairs = stack(
        [
            (str(i * width + j), f"if({q(cols[j])} is null, null, {q(cols[i])})", f"if({q(cols[i])} is null, null, {q(cols[j])})")
            for i in range(width) for j in range(i, width)
        ],
        ("pair", "a", "b"),
    )
    r = f"round({pearson('a', 'b')}, {decimals}) as r"
    found = (
        df.selectExpr(*[f"{clean(c)} as {q(c)}" for c in cols])
        .selectExpr(pairs)
        .groupBy("pair")
        .agg(F.expr(r))
        .selectExpr("map_from_entries(collect_list(struct(pair, r))) as _r")  # one entry per pair
    )
    return found.selectExpr(stack(
        [
            (text(cols[a]), text(cols[b]), f"try_element_at(_r, {min(a, b) * width + max(a, b)})")
            for a in range(width) for b in range(width)
        ],
        ("x", "y", "r"),
    ))


# --- rankings --------------------------------------------------------------------------------------

def _alert_order(cfg: RiskConfig) -> list[Column]:
    return [
        F.asc_nulls_last("pred"), F.desc_nulls_last("pct_high"), F.asc_nulls_last(cfg.id_col)
    ]


def alert_ranking(scored: DataFrame, cfg: RiskConfig, top: int | None = 100) -> DataFrame:
    """Riskiest class first, then by high-risk percent, ties by key. ``top=None`` keeps every row."""
    ranked = scored.orderBy(*_alert_order(cfg))
    return ranked if top is None else ranked.limit(top)


def top_high_risk(view: DataFrame, cfg: RiskConfig, n: int = 20) -> DataFrame:
    """First rows of class 0 in an alert view, same order as the view."""
    return view.filter(F.col("pred") == 0).orderBy(*_alert_order(cfg)).limit(n)


def alert_projection(view: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Display columns; optional ones that the table lacks are skipped."""
    return view.select(*[c for c in cfg.alert_cols if c in view.columns])


def importance_topk(importance: DataFrame, k: int = 15) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def best_metric_flag(metrics: DataFrame, metric_columns: Sequence[str] | None = None) -> DataFrame:
    """Mark each metric's maximum over models (ties all marked) in a long ``(model, metric, value)`` table."""
    rows = metrics.filter(F.col("metric").isin(list(metric_columns))) if metric_columns else metrics
    best = "max(value) over (partition by metric)"  # one row per model and metric
    return rows.selectExpr("model", "metric", "value", f"coalesce(value = {best}, false) as is_best")
