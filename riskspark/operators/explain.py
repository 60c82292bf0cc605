"""Feature contributions per prediction, and what-if rescoring, over whole tables."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Override, RiskConfig
from ..functions import clean, q, stack, text
from ..functions.expressions import percent_sql
from .score import PROBS, Scorer


# --- contributions ---------------------------------------------------------------------------------

def linear_contributions(df: DataFrame, weights: Mapping[str, float], id_col: str) -> DataFrame:
    """Exact contributions of an additive score: weight * (value - column mean). One row per entity."""
    means = df.selectExpr(
        f"struct({', '.join(f'avg({clean(c)}) as {q(c)}' for c in weights)}) as m"
    ).scalar()
    return df.withColumn("_m", means).selectExpr(
        q(id_col),
        *[f"{clean(c)} as {q(c)}" for c in weights],
        *[f"{float(w)!r}D * ({clean(c)} - _m.{q(c)}) as {q('contribution_' + c)}" for c, w in weights.items()],
    )


def _permutations(d: int, pairs: int, seed: int) -> list[list[int]]:
    """Random feature orders, each with its reverse, as positions 1..d of every feature."""
    rng = random.Random(seed)
    out = []
    for _ in range(pairs):
        position = list(range(1, d + 1))
        rng.shuffle(position)
        out += [position, [d + 1 - p for p in position]]
    return out


def sampled_contributions(
    df: DataFrame,
    scorer: Scorer,
    features: Sequence[str],
    background: Mapping[str, float],
    id_col: str,
    pairs: int = 8,
    seed: int = 42,
) -> DataFrame:
    """Shapley values of the predicted class's probability, by sampled feature orders.

    For each order, features switch one by one from the background value to the row's own value; a
    feature's contribution is the change in probability when it switches. Each row expands in place to its
    orders x (features + 1) mixed records, one scoring pass serves all, and the partial aggregate folds
    them back before anything is shuffled, so the shuffle carries one row per entity. Contributions sum to
    f(row) - f(background) whatever the number of orders.
    """
    d = len(features)
    orders = _permutations(d, pairs, seed)
    own = scorer(df.selectExpr(q(id_col), *[f"cast({q(c)} as double) as {q(c)}" for c in features]))
    own = own.selectExpr(q(id_col), *[f"{q(c)} as _own_{i}" for i, c in enumerate(features)], "pred as _pred")
    positions = ", ".join(f"array({', '.join(map(str, o))})" for o in orders)
    mixed = (
        own.selectExpr("*", f"explode(array({positions})) as _pos")
        .selectExpr("*", f"explode(sequence(0, {d})) as _step")
        .selectExpr("*", *[
            f"if(get(_pos, {i}) <= _step, _own_{i}, {float(background[c])!r}D) as {q(c)}"
            for i, c in enumerate(features)
        ])
    )
    scored = scorer(mixed).withColumn("_v", F.expr(f"get(array({', '.join(PROBS)}), _pred)"))

    def change(i: int) -> str:
        sign = f"case when get(_pos, {i}) = _step then 1D when get(_pos, {i}) = _step + 1 then -1D else 0D end"
        return f"sum({sign} * _v) / {len(orders)}"

    return scored.groupBy(id_col).agg(
        F.expr("any_value(_pred) as pred"),
        *[F.expr(f"any_value(_own_{i}) as {q(c)}") for i, c in enumerate(features)],
        *[F.expr(f"{change(i)} as {q('contribution_' + c)}") for i, c in enumerate(features)],
    )


def attribution(
    contributions: DataFrame, features: Sequence[str], id_col: str, top: int | None = None, decimals: int = 6
) -> DataFrame:
    """Long ``(id, rank, feature, value, contribution, direction)``, largest magnitude first.

    Sorting and cutting to ``top`` happen inside each row's array, so nothing is shuffled. The direction
    says whether the feature raises or lowers the explained class.
    """
    items = ", ".join(
        f"struct(-abs(round({q('contribution_' + c)}, {decimals})) as order, {text(c)} as feature, "
        f"cast({q(c)} as double) as value, round({q('contribution_' + c)}, {decimals}) as contribution)"
        for c in features
    )
    ordered = f"array_sort(filter(array({items}), s -> s.contribution is not null))"
    if top is not None:
        ordered = f"slice({ordered}, 1, {top})"
    return contributions.selectExpr(q(id_col), f"posexplode({ordered}) as (_i, _s)").selectExpr(
        q(id_col), "_i + 1 as rank", "_s.feature", "_s.value", "_s.contribution",
        f"{attribution_direction('_s.contribution')} as direction",
    )


def attribution_direction(contribution: str) -> str:
    """Whether a contribution raises or lowers the explained class (SQL text)."""
    return f"if({contribution} > 0, 'raises', 'lowers')"


# --- what-if ---------------------------------------------------------------------------------------

def _changed(o: Override) -> str:
    """New value of a feature; a missing value stays missing (SQL text)."""
    new = f"cast({q(o.feature)} as double) + {float(o.delta)!r}D"
    if o.lo is not None:
        new = f"greatest({float(o.lo)!r}D, {new})"
    if o.hi is not None:
        new = f"least({float(o.hi)!r}D, {new})"
    return f"if({q(o.feature)} is not null, {new}, null)"


def what_if(
    df: DataFrame,
    scorer: Scorer,
    scenarios: Mapping[str, Sequence[Override]],
    cfg: RiskConfig,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Score each row as it is and under each scenario, and compare.

    Both scores are computed on the same row: the scenario values replace the features between two
    scoring passes, so there is no join back.
    """
    features = [c for c in (features or cfg.features) if c in df.columns]
    kept = scorer(df).selectExpr(
        q(cfg.id_col), *[q(f) for f in features], "pred as pred_before", *[f"{p} as {p}_before" for p in PROBS]
    )
    rows = [
        (
            text(name),
            *[
                next((_changed(o) for o in overrides if o.feature == f), f"cast({q(f)} as double)")
                for f in features
            ],
        )
        for name, overrides in scenarios.items()
    ]
    changed = kept.selectExpr(
        q(cfg.id_col), "pred_before", *[f"{p}_before" for p in PROBS], stack(rows, ("scenario", *features))
    )
    verdict = "case when pred > pred_before then 'better' when pred < pred_before then 'worse' else 'no change' end"
    return scorer(changed).selectExpr(
        q(cfg.id_col), "scenario", "pred_before", "pred as pred_after", f"{verdict} as change",
        *[f"{p}_before" for p in PROBS], *[f"{p} as {p}_after" for p in PROBS],
    )


def what_if_compare(compared: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Before and after percent per class, one row per (entity, scenario, class)."""
    rows = [
        (text(cfg.labels[k]), percent_sql(f"{p}_before"), percent_sql(f"{p}_after")) for k, p in enumerate(PROBS)
    ]
    return compared.selectExpr(
        q(cfg.id_col), "scenario", stack(rows, ("risk_label", "pct_before", "pct_after"))
    )
