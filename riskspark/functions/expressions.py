"""Column expressions. All are JVM built-ins, so they stay inside whole-stage codegen.

They are written as SQL text: one parsed expression costs one call to the JVM however long it is, while
the same tree built from Python column operators costs one call per node.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig


def q(name: str) -> str:
    """Quoted column name, dots separating struct fields left alone in already quoted names."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """String literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value) if isinstance(value, int) else text(str(value))


def clean(name: str) -> str:
    """NaN becomes null, so comparisons and aggregates treat both as missing (SQL text)."""
    return f"nanvl(cast({q(name)} as double), cast(null as double))"


def clean_number(name: str) -> Column:
    return F.expr(clean(name))


def stack(rows: Sequence[Sequence[str]], names: Sequence[str]) -> str:
    """``stack`` call turning one input row into ``rows`` output rows; entries are SQL text."""
    cells = ", ".join(c for row in rows for c in row)
    return f"stack({len(rows)}, {cells}) as ({', '.join(q(n) for n in names)})"


def half_up_sql(expression: str, decimals: int) -> str:
    scale = f"{float(10**decimals)!r}D"
    return f"(floor(({expression}) * {scale} + 0.5D) / {scale})"


def half_up(expression: str, decimals: int) -> Column:
    """Half-up rounding in plain double arithmetic.

    ``round`` goes through BigDecimal for every row; this is one multiply, floor and divide, and any
    IEEE engine gives the same bits.
    """
    return F.expr(half_up_sql(expression, decimals))


def risk_band(score: str, cfg: RiskConfig) -> Column:
    """2 above the high cut, 1 from the low cut up, else 0. A missing score is class 0."""
    s = clean(score)
    return F.expr(f"case when {s} > {cfg.high_cut!r}D then 2 when {s} >= {cfg.low_cut!r}D then 1 else 0 end")


def case_map(name: str, mapping: Mapping, default: object) -> str:
    """Fixed lookup table as a CASE expression (SQL text)."""
    whens = " ".join(f"when {literal(k)} then {literal(v)}" for k, v in mapping.items())
    return f"case {q(name)} {whens} else {default} end"


def ordinal_code(name: str, mapping: Mapping[str, int]) -> Column:
    """Fixed integer per category; unknown and missing categories are code 0."""
    return F.expr(case_map(name, mapping, 0))


def class_label(pred: str, cfg: RiskConfig) -> Column:
    return F.expr(case_map(pred, dict(enumerate(cfg.labels)), "null"))


def display_name(name: str, cfg: RiskConfig) -> Column:
    """Readable feature name, or the id itself when none is configured."""
    return F.expr(case_map(name, cfg.display, q(name))) if cfg.display else F.col(q(name))


def weighted_total(weights: Mapping[str, float]) -> str:
    """Weighted sum of columns (SQL text)."""
    return " + ".join(f"{float(w)!r}D * {q(c)}" for c, w in weights.items())


def entity_name(columns: Sequence[str], cfg: RiskConfig, position: str | None = None) -> Column:
    """First and last name, else ``ID-<id>``, else the row's position in the shown list."""
    if cfg.first_name in columns and cfg.last_name in columns:
        return F.expr(f"concat({q(cfg.first_name)}, ' ', {q(cfg.last_name)})")
    if cfg.id_col in columns:
        return F.expr(f"concat('ID-', cast({q(cfg.id_col)} as string))")
    if position is None:
        raise ValueError("no name or id column: a position is needed to name the rows")
    return F.expr(f"concat('Est. ', cast({q(position)} as string))")


def percent_sql(p: str) -> str:
    return half_up_sql(f"{p} * 100D", 1)


def round_percent(p: str) -> Column:
    """Probability column -> percent with one decimal."""
    return F.expr(percent_sql(q(p)))


def confidence(*probs: str) -> Column:
    return F.expr(percent_sql(f"greatest({', '.join(q(p) for p in probs)})"))


def argmax_class(*names: str) -> str:
    """Index of the first largest value (SQL text)."""
    best = f"greatest({', '.join(q(n) for n in names)})"
    whens = " ".join(f"when {q(n)} = {best} then {k}" for k, n in enumerate(names[:-1]))
    return f"case {whens} else {len(names) - 1} end"


def pearson(x: str, y: str) -> str:
    """Correlation aggregate over the pairs with both values (SQL text); null when a side is constant."""
    x, y = q(x), q(y)
    if x == y:
        return f"covar_pop({x}, {x}) / nullif(var_pop({x}), 0D)"
    spread = (
        f"stddev_pop(case when {y} is not null then {x} end) * stddev_pop(case when {x} is not null then {y} end)"
    )
    return f"covar_pop({x}, {y}) / nullif({spread}, 0D)"


def hash_order_key(id_col: str, seed: int) -> str:
    """Seeded pseudo-random sort key (SQL text): independent of partitioning and of the engine."""
    return f"md5(concat('{seed}:', cast({q(id_col)} as string)))"


def compute_once(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add columns behind a one-row generator.

    Filters and projections above are not merged through a generator, so an expensive expression (a model
    prediction) is evaluated once per row instead of again in every predicate that mentions it.
    """
    fields = ", ".join(f"{text(name)}, {expression}" for name, expression in columns.items())
    kept = [q(c) for c in df.columns if c not in columns]
    return df.selectExpr(*kept, f"inline(array(named_struct({fields})))")
