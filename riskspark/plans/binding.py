"""The risk operators bound to the order tables: one entity per order that has lines.

Component scores are blanked on a fixed share of the keys, so that missing values occur in known places;
every order stays in the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Override, RiskConfig
from ..functions import argmax_class, compute_once, q, risk_band, stack, text, weighted_total
from ..functions.expressions import half_up_sql
from ..operators.score import add_percentages

PRIORITIES = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}
SEGMENTS = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "HOUSEHOLD": 3, "MACHINERY": 4}
STATUSES = {"F": 0, "O": 1, "P": 2}
REGIONS = {"AFRICA": 0, "AMERICA": 1, "ASIA": 2, "EUROPE": 3, "MIDDLE EAST": 4}

ENTITY = RiskConfig(
    id_col="entity_id",
    score_col="score",
    high_cut=55.0,
    low_cut=40.0,
    age_col="n_lines",
    segment_col="seg",
    categories={"prio": PRIORITIES, "seg": SEGMENTS, "status": STATUSES, "region": REGIONS},
    encoded_names={"prio": "prio_enc", "seg": "seg_enc", "status": "status_enc", "region": "region_enc"},
    features=("s1", "s2", "s3", "s4", "s5", "s6", "n_lines", "prio_enc", "seg_enc", "status_enc", "region_enc"),
    behavioural=("s5", "n_lines", "prio_enc", "seg_enc", "status_enc", "region_enc"),
    labels=("High risk", "Medium risk", "Low risk"),
    display={
        "s1": "Quantity", "s2": "Discount", "s3": "Tax", "s4": "Line price", "s5": "Returns",
        "s6": "Order value", "score": "Total score",
    },
    weights={"s1": 0.15, "s6": 0.25, "s2": 0.15, "s3": 0.10, "s5": 0.05, "s4": 0.30},
    summary_means={"avg_s1": "s1", "avg_s2": "s2", "avg_s3": "s3", "avg_s5": "s5"},
    correlation_cols=("s1", "s2", "s3", "s4", "s5", "s6"),
    matrix_cols=("score", "s1", "s2", "s3", "s4", "s5", "s6"),
    describe_cols=("score", "s1", "s2", "s3", "s4", "s5", "s6", "n_lines"),
    count_cols=("seg", "status", "region", "prio"),
    filter_cols=("seg", "status", "region", "prio"),
    alert_cols=("entity_id", "first_name", "last_name", "seg", "n_lines", "status", "s1", "score", "risk_label", "pct_high", "confidence"),
    overrides=(
        Override("s1", 5.0, None, 100.0),
        Override("s3", -20.0, 1.0, None),
        Override("s6", 10.0, None, 100.0),
        Override("s4", 10.0, None, 100.0),
    ),
    presets={
        "typical": {"s1": 50.0, "s2": 50.0, "s3": 50.0, "s4": 50.0, "s5": 30.0, "s6": 50.0},
        "at risk": {"s1": 25.0, "s2": 20.0, "s3": 35.0, "s4": 20.0, "s5": 10.0, "s6": 12.0},
    },
    dictionary=(
        ("s1", "numeric", "Mean quantity per line", "component", "yes (leakage)"),
        ("s2", "numeric", "Mean discount", "component", "yes (leakage)"),
        ("s3", "numeric", "Mean tax", "component", "yes (leakage)"),
        ("s4", "numeric", "Mean line price", "component", "yes (leakage)"),
        ("s5", "numeric", "Share of returned lines", "component", "yes (leakage)"),
        ("s6", "numeric", "Order value", "component", "yes (leakage)"),
        ("n_lines", "numeric", "Lines per order", "behaviour", "yes"),
        ("prio", "category", "Order priority", "context", "yes (enc.)"),
        ("seg", "category", "Market segment", "context", "yes (enc.)"),
        ("status", "category", "Order status", "context", "yes (enc.)"),
        ("region", "category", "Customer region", "context", "yes (enc.)"),
        ("score", "numeric", "Weighted total", "target", "no (the base)"),
    ),
    column_types={
        "entity_id": "bigint", "s1": "double", "s2": "double", "s3": "double", "s4": "double",
        "s5": "double", "s6": "double", "score": "double", "prio": "string", "status": "string",
        "n_lines": "bigint",
    },
    main_model="Full score",
)


# Declared schemas of the columns in use: no footer is opened to plan a query.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str, alias: str) -> str:
    """Sum of whole hundredths, so that it does not depend on row order."""
    return f"sum(cast(floor({c} * 100D + 0.5D) as bigint)) as {alias}"


def entity_table(spark: SparkSession, sf_dir: str, context: bool = True) -> DataFrame:
    """One row per order with lines. ``context=False`` leaves out segment and region and their joins.

    Lines are aggregated per order before the join, which then finds them already partitioned by order key.
    Dimension sides carry no broadcast hint: the planner broadcasts them only below its size threshold, and
    a customer holding a large share of the orders is split by adaptive skew handling.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.expr(e) for e in (
        "count(1) as n",
        "sum(l_quantity) as qty",
        _cents("l_discount", "disc"),
        _cents("l_tax", "tax"),
        _cents("l_extendedprice", "price"),
        "count_if(l_returnflag = 'R') as ret",
    )])
    orders = table(spark, sf_dir, "orders")
    parts = orders.join(lines, F.expr("o_orderkey = l_orderkey")).selectExpr(
        "o_orderkey as entity_id",
        "o_custkey",
        "qty / n * 2D as a1",
        "disc / n * 10D as a2",
        "tax / n * 12.5D as a3",
        "price / 100D / n / 1050D as a4",
        "100D * ret / n as a5",
        "o_totalprice / 5000D as a6",
        "if(o_orderkey % 19 <> 0, o_orderpriority, null) as prio",
        "o_orderstatus as status",
        "n as n_lines",
    )
    total = weighted_total({f"a{c[1]}": w for c, w in ENTITY.weights.items()})
    entities = parts.selectExpr(
        "entity_id",
        f"if(entity_id % 13 <> 0, {half_up_sql('a1', 2)}, null) as s1",
        f"if(entity_id % 17 <> 0, {half_up_sql('a2', 2)}, null) as s2",
        *[f"{half_up_sql(f'a{i}', 2)} as s{i}" for i in range(3, 7)],
        f"if(entity_id % 97 <> 0, {half_up_sql(total, 2)}, null) as score",
        "prio",
        "status",
        "n_lines",
        *(["o_custkey"] if context else []),
    )
    if not context:
        return entities
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"), "left"
    )
    return (
        entities.join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"), "left")
        .join(places, F.expr("c_nationkey = n_nationkey"), "left")
        .selectExpr(
            "entity_id", "s1", "s2", "s3", "s4", "s5", "s6", "score", "prio", "c_mktsegment as seg", "status",
            "r_name as region", "n_lines",
        )
    )


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("label", risk_band("score", ENTITY))


# --- fixed scorers: closed-form stand-ins for a model, so that results can be checked in SQL ---------

CENTRES = (30.0, 47.0, 64.0)
SCORERS: Mapping[str, Sequence[tuple[float, str]]] = {
    "Full score": ((0.30, "s4"), (0.25, "s6"), (0.15, "s1"), (0.10, "s3"), (0.05, "s5")),
    "Early score": ((0.50, "s3"), (0.20, "s5"), (0.15, "s2")),
    "Price score": ((0.50, "s4"), (0.40, "s6")),
}
OFFSETS = {"Full score": 7.5, "Early score": 7.5, "Price score": 5.0}
FILL = 50.0  # stands in for a missing component


def linear_score(name: str) -> str:
    terms = [f"{w!r}D * coalesce(cast({c} as double), {FILL!r}D)" for w, c in SCORERS[name]]
    return " + ".join([*terms, f"{OFFSETS[name]!r}D"])


def fixed_scorer(name: str = "Full score"):
    """Scorer whose class weights fall with the distance of a linear score from three centres."""

    def score(df: DataFrame) -> DataFrame:
        kept = [q(c) for c in df.columns if c not in ("p0", "p1", "p2", "pred")]
        near = df.selectExpr(*kept, f"{linear_score(name)} as _z").selectExpr(
            *kept, *[f"1D / (1D + abs(_z - {c!r}D)) as _w{k}" for k, c in enumerate(CENTRES)]
        )
        shares = {f"p{k}": half_up_sql(f"_w{k} / (_w0 + _w1 + _w2)", 4) for k in range(3)}
        out = compute_once(near, {**shares, "pred": argmax_class("_w0", "_w1", "_w2")})
        return out.drop("_w0", "_w1", "_w2")

    return score


def scored_fixture(spark: SparkSession, sf_dir: str, context: bool = True, name: str = "Full score") -> DataFrame:
    return add_percentages(fixed_scorer(name)(labelled(entity_table(spark, sf_dir, context))), ENTITY)


def all_scorers(df: DataFrame, *keep: str) -> DataFrame:
    """``(model, keep..., label, pred, p0, p1, p2)`` for every fixed scorer, in one pass over the table."""
    out = df
    for i, name in enumerate(SCORERS):
        kept = [q(c) for c in out.columns]
        out = fixed_scorer(name)(out).selectExpr(*kept, *[f"{c} as {c}_{i}" for c in ("pred", "p0", "p1", "p2")])
    rows = [
        (text(name), f"pred_{i}", f"p0_{i}", f"p1_{i}", f"p2_{i}") for i, name in enumerate(SCORERS)
    ]
    return out.selectExpr(*keep, "label", stack(rows, ("model", "pred", "p0", "p1", "p2")))


# --- the same tables in SQL, used as the head of the checking queries ---------------------------------

def r(expr: str, decimals: int) -> str:
    """Half-up rounding in double arithmetic."""
    scale = f"{10**decimals}e0"
    return f"(floor(({expr}) * {scale} + 0.5e0) / {scale})"


ENTITY_SQL = f"""
lines as (
  select l_orderkey, count(*) as n, sum(l_quantity) as qty,
         sum(cast(floor(l_discount * 100e0 + 0.5e0) as bigint)) as disc,
         sum(cast(floor(l_tax * 100e0 + 0.5e0) as bigint)) as tax,
         sum(cast(floor(l_extendedprice * 100e0 + 0.5e0) as bigint)) as price,
         count(*) filter (where l_returnflag = 'R') as ret
  from lineitem group by l_orderkey
), parts as (
  select o_orderkey as entity_id, qty / n * 2e0 as a1,
         cast(disc as double) / n * 10e0 as a2, cast(tax as double) / n * 12.5e0 as a3,
         cast(price as double) / 100e0 / n / 1050e0 as a4, 100e0 * ret / n as a5, o_totalprice / 5000e0 as a6,
         case when o_orderkey % 19 <> 0 then o_orderpriority end as prio,
         c_mktsegment as seg, o_orderstatus as status, r_name as region, n as n_lines
  from orders join lines on o_orderkey = l_orderkey
  left join customer on o_custkey = c_custkey
  left join nation on c_nationkey = n_nationkey
  left join region on n_regionkey = r_regionkey
), entity as (
  select entity_id,
         case when entity_id % 13 <> 0 then {r('a1', 2)} end as s1,
         case when entity_id % 17 <> 0 then {r('a2', 2)} end as s2,
         {r('a3', 2)} as s3, {r('a4', 2)} as s4, {r('a5', 2)} as s5, {r('a6', 2)} as s6,
         case when entity_id % 97 <> 0 then
           {r('0.15e0 * a1 + 0.25e0 * a6 + 0.15e0 * a2 + 0.10e0 * a3 + 0.05e0 * a5 + 0.30e0 * a4', 2)}
         end as score,
         prio, seg, status, region, n_lines
  from parts
), labelled as (
  select *, case when score > 55e0 then 2 when score >= 40e0 then 1 else 0 end as label from entity
)"""


def z_sql(name: str, fill: str = "50e0") -> str:
    terms = " + ".join(f"{w!r}e0 * coalesce({c}, {fill})" for w, c in SCORERS[name])
    return f"{terms} + {OFFSETS[name]!r}e0"


def scorer_sql(source: str, out: str, name: str = "Full score", keep: str = "*", fill: str = "50e0") -> str:
    """CTEs that add ``p0, p1, p2, pred`` to ``source`` under the name ``out``."""
    weights = ", ".join(f"1e0 / (1e0 + abs(z - {c!r}e0)) as w{k}" for k, c in enumerate(CENTRES))
    probs = ", ".join(f"{r(f'w{k} / (w0 + w1 + w2)', 4)} as p{k}" for k in range(3))
    best = "greatest(w0, w1, w2)"
    return f"""
{out}_z as (select {keep}, {z_sql(name, fill)} as z from {source}),
{out}_w as (select *, {weights} from {out}_z),
{out} as (
  select * exclude (z, w0, w1, w2), {probs},
         case when w0 = {best} then 0 when w1 = {best} then 1 else 2 end as pred
  from {out}_w
)"""


LABELS_SQL = "case pred when 0 then 'High risk' when 1 then 'Medium risk' else 'Low risk' end"


def pct_sql(p: str) -> str:
    return r(f"{p} * 100e0", 1)


SCORED_SQL = f"""{ENTITY_SQL}, {scorer_sql('labelled', 'base')}, scored as (
  select *, {LABELS_SQL} as risk_label, {pct_sql('p0')} as pct_high, {pct_sql('p1')} as pct_medium,
         {pct_sql('p2')} as pct_low, {pct_sql('greatest(p0, p1, p2)')} as confidence
  from base
)"""

_ONE = [scorer_sql("labelled", f"m{i}", name) for i, name in enumerate(SCORERS)]
_UNION = " union all ".join(
    f"select '{name}' as model, entity_id, label, pred, p0, p1, p2 from m{i}" for i, name in enumerate(SCORERS)
)
ALL_SCORERS_SQL = f"{ENTITY_SQL}, {', '.join(_ONE)}, allm as ({_UNION})"
