"""Queries on the entity table: profiling, preparation, cohorts, distributions, splits."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import class_label, display_name, half_up, stack, text, weighted_total
from ..operators import cohort, cube, distribution, prepare, profile, sketches, splits
from ..sources.staging import stage, work_path
from ..sources.tables import csv_ingest
from .binding import ENTITY, ENTITY_SQL, entity_table, labelled, r, table
from .registry import query

COMPONENTS = ("s1", "s2", "s3", "s4", "s5", "s6")
ENTITY_COLUMNS = ("entity_id", *COMPONENTS, "score", "prio", "seg", "status", "region", "n_lines")
WITH = f"with {ENTITY_SQL}"


def sql_union(parts) -> str:
    return " union all ".join(parts)


# --- sources ---------------------------------------------------------------------------------------

CSV_COLUMNS = ("entity_id", "s1", "s2", "score", "prio", "status", "n_lines")


@query("csv_ingest", f"{WITH} select {', '.join(CSV_COLUMNS)} from entity")
def _csv_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Write the table as CSV with three different missing-value tokens and read it back."""
    path = work_path(spark, "csv")
    rows = entity_table(spark, d, context=False).selectExpr(
        "entity_id",
        "coalesce(cast(s1 as string), 'NA') as s1",
        "coalesce(cast(s2 as string), 'nan') as s2",
        "cast(score as string) as score",
        "coalesce(prio, 'None') as prio",
        "status",
        "n_lines",
    )
    rows.write.option("header", True).csv(path)
    return csv_ingest(spark, path, ENTITY.column_types)


@query("preview", f"{WITH} select * exclude (label) from labelled order by entity_id limit 10")
def _preview(spark, d):
    return profile.preview(entity_table(spark, d), "entity_id")


# --- profiling -------------------------------------------------------------------------------------

_NULLS = " + ".join(f"count(*) filter (where {c} is null)" for c in ENTITY_COLUMNS)


@query("table_profile", f"{WITH} select count(*) as n_rows, cast({len(ENTITY_COLUMNS)} as bigint) as n_columns, {_NULLS} as n_nulls from entity")
def _table_profile(spark, d):
    return profile.table_profile(entity_table(spark, d))


_AUDITED = (*COMPONENTS, "score", "prio")


def _audit_sql(c: str, step: str) -> str:
    """Imputed components have no missing cells left; the other columns are unchanged."""
    n = "cast(0 as bigint)" if step == "after" and c in COMPONENTS else f"count(*) filter (where {c} is null)"
    return f"select '{c}' as column_name, '{step}' as step, {n} as n_null, round({n} / count(*), 6) as null_rate from entity"


@query("null_audit", f"{WITH} " + sql_union(_audit_sql(c, step) for c in _AUDITED for step in ("before", "after")))
def _null_audit(spark, d):
    """Missing cells per column before and after preparation."""
    raw = entity_table(spark, d, context=False).select(*_AUDITED)
    filled = prepare.median_impute(raw, COMPONENTS)
    return profile.null_audit(raw).withColumn("step", F.lit("before")).unionByName(
        profile.null_audit(filled).withColumn("step", F.lit("after"))
    )


@query("duplicate_count", """
select cast(count(*) - (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) as bigint)
  as n_duplicates from lineitem""")
def _duplicate_count(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return profile.duplicate_count(lines)


@query("filter_domains", f"{WITH} " + sql_union([
    *[f"select '{c}' as column_name, {c} as value, count(*) as n from entity where {c} is not null group by {c}" for c in ENTITY.filter_cols],
    "select 'n_lines.min', cast(min(n_lines) as varchar), count(*) from entity",
    "select 'n_lines.max', cast(max(n_lines) as varchar), count(*) from entity",
]))
def _filter_domains(spark, d):
    return profile.filter_domains(entity_table(spark, d), ENTITY)


@query("describe_table", f"{WITH} " + sql_union(
    f"select '{ENTITY.display.get(c, c)}' as column_name, count({c}) as n, round(avg({c}), 4) as mean, "
    f"round(stddev_samp({c}), 4) as std, cast(min({c}) as double) as min, "
    f"round(quantile_cont({c}, 0.25), 4) as p25, round(quantile_cont({c}, 0.5), 4) as p50, "
    f"round(quantile_cont({c}, 0.75), 4) as p75, cast(max({c}) as double) as max from entity"
    for c in ENTITY.describe_cols
))
def _describe(spark, d):
    return profile.describe_table(entity_table(spark, d, context=False), ENTITY.describe_cols, ENTITY, decimals=4)


_STORED = {c: "double" for c in (*COMPONENTS, "score")} | {"n_lines": "bigint"}


@query("data_dictionary", f"{WITH} " + sql_union(
    f"select '{v}' as variable, '{k}' as kind, '{t}' as description, '{c}' as category, '{u}' as model_use, "
    f"{str('leakage' in u).lower()} as is_leakage, '{_STORED.get(v, 'string')}' as stored_type, "
    f"count(*) filter (where {v} is null) as n_null, count(*) as n_rows from entity"
    for v, k, t, c, u in ENTITY.dictionary
))
def _data_dictionary(spark, d):
    return profile.data_dictionary(entity_table(spark, d), ENTITY)


# --- projections -----------------------------------------------------------------------------------

@query("risk_band", f"{WITH} select entity_id, score, label, score is null as is_unscored from labelled")
def _risk_band(spark, d):
    return prepare.add_label(entity_table(spark, d, context=False), ENTITY).select(
        "entity_id", "score", "label", "is_unscored"
    )


def _code_sql(c: str) -> str:
    cases = " ".join(f"when '{v}' then {k}" for v, k in ENTITY.categories[c].items())
    return f"case {c} {cases} else 0 end as {c}_enc"


@query("ordinal_encode", f"{WITH} select entity_id, prio, {', '.join(_code_sql(c) for c in ENTITY.categories)} from entity")
def _ordinal_encode(spark, d):
    return prepare.encode_categories(entity_table(spark, d), ENTITY).select(
        "entity_id", "prio", *[ENTITY.encoded_names[c] for c in ENTITY.categories]
    )


@query("median_impute", f"{WITH} select entity_id, " + ", ".join(
    f"round(coalesce({c}, (select quantile_cont({c}, 0.5) from entity)), 4) as {c}" for c in COMPONENTS) + " from entity")
def _median_impute(spark, d):
    filled = prepare.median_impute(entity_table(spark, d, context=False), COMPONENTS)
    return filled.selectExpr("entity_id", *[f"round({c}, 4) as {c}" for c in COMPONENTS])


@query("select_features", f"""{WITH}, coded as (select *, {', '.join(_code_sql(c) for c in ENTITY.categories)} from labelled)
select entity_id, label, {', '.join(f'cast({c} as double) as {c}' for c in ENTITY.behavioural)} from coded""")
def _select_features(spark, d):
    """The behavioural feature list; names the table lacks are skipped."""
    coded = prepare.encode_categories(labelled(entity_table(spark, d)), ENTITY)
    return prepare.select_features(coded, ENTITY, [*ENTITY.behavioural, "not_in_table"])


@query("class_label", f"""{WITH} select entity_id, case label when 0 then 'High risk' when 1 then 'Medium risk'
else 'Low risk' end as risk_label from labelled""")
def _class_label(spark, d):
    return labelled(entity_table(spark, d, context=False)).select(
        "entity_id", class_label("label", ENTITY).alias("risk_label")
    )


@query("display_name", f"{WITH} " + sql_union(
    f"select '{c}' as feature, '{ENTITY.display.get(c, c)}' as display, count({c}) as n_values from entity"
    for c in ENTITY.describe_cols
))
def _display_name(spark, d):
    counts = entity_table(spark, d, context=False).selectExpr(*[f"count({c}) as {c}" for c in ENTITY.describe_cols])
    long = counts.unpivot([], list(ENTITY.describe_cols), "feature", "n_values")
    return long.select("feature", display_name("feature", ENTITY).alias("display"), "n_values")


_TOTAL_SQL = " + ".join(f"{w!r}e0 * {c}" for c, w in ENTITY.weights.items())


@query("weighted_total", f"{WITH} select entity_id, {r(_TOTAL_SQL, 4)} as total from entity")
def _weighted_total(spark, d):
    return entity_table(spark, d, context=False).select(
        "entity_id", half_up(weighted_total(ENTITY.weights), 4).alias("total")
    )


@query("standard_scale", f"""{WITH}, stats as (select {', '.join(f'avg({c}) as m_{c}, stddev_pop({c}) as d_{c}' for c in COMPONENTS)}
from entity where status <> 'P')
select entity_id, {', '.join(f'round(({c} - m_{c}) / coalesce(nullif(d_{c}, 0), 1), 6) as {c}_z' for c in COMPONENTS)}
from entity, stats""")
def _standard_scale(spark, d):
    """Fitted on the closed and open orders, applied to all."""
    scaled = prepare.standard_scale(entity_table(spark, d, context=False), COMPONENTS, "status <> 'P'")
    return scaled.selectExpr("entity_id", *[f"round({c}_z, 6) as {c}_z" for c in COMPONENTS])


# --- filters ---------------------------------------------------------------------------------------

@query("cohort_filter", f"""{WITH} select entity_id, seg, status, region, n_lines from entity
where seg = 'BUILDING' and status = 'F' and n_lines between 2 and 6""")
def _cohort_filter(spark, d):
    rows = cohort.cohort_filter(
        entity_table(spark, d), ENTITY, {"seg": "BUILDING", "status": "F", "region": None}, age=(2, 6)
    )
    return rows.select("entity_id", "seg", "status", "region", "n_lines")


@query("high_stress_filter", f"{WITH} select entity_id, s3, score, label from labelled where s3 > 70e0")
def _high_stress(spark, d):
    rows = labelled(entity_table(spark, d, context=False))
    return cohort.high_stress_filter(rows, "s3", 70.0).select("entity_id", "s3", "score", "label")


# --- aggregations ----------------------------------------------------------------------------------

def _class_sql(total: str, label: str = "label") -> str:
    out = []
    for k, name in enumerate(cohort.LEVELS):
        n = f"count(*) filter (where {label} = {k})"
        share = r(f"100e0 * {n} / nullif({total}, 0)", 1)
        out.append(f"{n} as n_{name}, {share} as pct_{name}")
    return ", ".join(out)


@query("eda_summary", f"""{WITH} select count(*) as n_total, {_class_sql('count(*)')}, round(avg(score), 2) as avg_total,
round(stddev_samp(score), 2) as std_total, {', '.join(f'round(avg({c}), 2) as {a}' for a, c in ENTITY.summary_means.items())}
from labelled""")
def _eda_summary(spark, d):
    return cohort.eda_summary(labelled(entity_table(spark, d, context=False)), ENTITY)


@query("value_counts", f"{WITH} " + sql_union(
    f"select '{c}' as column_name, {c} as value, count(*) as n from entity where {c} is not null group by {c}" for c in ENTITY.count_cols
))
def _value_counts(spark, d):
    return cohort.value_counts(entity_table(spark, d), ENTITY.count_cols)


_LISTWISE = " and ".join(f"{c} is not null" for c in (*COMPONENTS, "score"))
TARGET_CORRELATION_SQL = sql_union(
    f"select '{c}' as feature, coalesce(round(covar_pop({c}, score) / nullif(stddev_pop({c}) * stddev_pop(score), 0), 3), 0) as r "
    f"from entity where {_LISTWISE}" for c in COMPONENTS
)


@query("target_correlation", f"{WITH} {TARGET_CORRELATION_SQL}")
def _target_correlation(spark, d):
    return cohort.target_correlation(entity_table(spark, d, context=False), ENTITY)


@query("correlation_rank", f"""{WITH}, corr as ({TARGET_CORRELATION_SQL}) select feature,
case feature {' '.join(f"when '{c}' then '{ENTITY.display[c]}'" for c in COMPONENTS)} end as display,
r, abs(r) as strength from corr order by strength desc, feature""")
def _correlation_rank(spark, d):
    entities = entity_table(spark, d, context=False)
    return cohort.correlation_rank(cohort.target_correlation(entities, ENTITY), ENTITY)


@query("correlation_matrix", f"{WITH} " + sql_union(
    f"select '{a}' as x, '{b}' as y, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 2) as r "
    f"from entity where {a} is not null and {b} is not null"
    for a in ENTITY.matrix_cols for b in ENTITY.matrix_cols
))
def _correlation_matrix(spark, d):
    return cohort.correlation_matrix(entity_table(spark, d, context=False), ENTITY.matrix_cols)


@query("cohort_kpis", f"""{WITH}, c as (select *, seg = 'BUILDING' and n_lines between 2 and 6 as inside from labelled)
select count(*) filter (where inside) as n, count(*) as n_total,
{_class_sql('count(*) filter (where inside)', 'case when inside then label end')},
round(avg(case when inside then score end), 1) as avg_total,
{', '.join(f'round(avg(case when inside then {c} end), 1) as {a}' for a, c in ENTITY.summary_means.items())} from c""")
def _cohort_kpis(spark, d):
    return cohort.cohort_kpis(labelled(entity_table(spark, d)), ENTITY, {"seg": "BUILDING"}, age=(2, 6))


@query("group_risk_count", f"{WITH} " + sql_union(
    f"select '{g}' as dimension, {g} as value, label, count(*) as n from labelled where {g} is not null group by {g}, label"
    for g in ("seg", "region", "prio")
))
def _group_risk_count(spark, d):
    """Three groupings in one pass."""
    long = labelled(entity_table(spark, d)).selectExpr("label", stack(
        [(text(g), g) for g in ("seg", "region", "prio")], ("dimension", "value")
    ))
    return long.filter("value is not null").groupBy("dimension", "value", "label").agg(F.expr("count(1) as n"))


@query("risk_share", f"""{WITH}, cells as (select * from (values (0, 'High risk'), (1, 'Medium risk'), (2, 'Low risk')) t(label, risk_label))
select c.label, c.risk_label, count(l.entity_id) as n,
round(count(l.entity_id) / nullif((select count(*) from labelled), 0), 6) as share
from cells c left join labelled l on l.label = c.label group by c.label, c.risk_label""")
def _risk_share(spark, d):
    return cohort.risk_share(labelled(entity_table(spark, d, context=False)), ENTITY)


CONTRASTS = {"region AFRICA": "region = 'AFRICA'", "status F": "status = 'F'", "s3 above 70": "s3 > 70e0"}


def _contrast_sql(name: str, cond: str, total: bool) -> str:
    high = "case when label = 0 then 1e0 else 0e0 end"
    rate_in, rate_out = f"avg({high}) filter (where {cond})", f"avg({high}) filter (where not ({cond}))"
    return (
        f"select '{name}' as contrast, {'cast(null as varchar)' if total else 'seg'} as cohort, "
        f"count(*) filter (where {cond}) as n_in, count(*) filter (where not ({cond})) as n_out, "
        f"round({rate_in}, 6) as high_rate_in, round({rate_out}, 6) as high_rate_out, "
        f"round({rate_in} / nullif({rate_out}, 0), 4) as relative_risk, "
        f"round(avg(score) filter (where {cond}) - avg(score) filter (where not ({cond})), 4) as score_gap "
        f"from labelled where seg is not null {'' if total else 'group by seg'}"
    )


@query("cohort_contrast", f"{WITH} " + sql_union(
    _contrast_sql(n, c, total) for n, c in CONTRASTS.items() for total in (True, False)
))
def _cohort_contrast(spark, d):
    return cohort.cohort_contrast(labelled(entity_table(spark, d)), ENTITY, CONTRASTS, "seg")


CUBE_DIMS = ("seg", "status", "region")
CUBE_MEASURES = ("score", *ENTITY.summary_means.values())


def _cube(spark, d):
    """Cells per region of the table, put together, then summed over every subset of the dimensions; stored."""
    rows = labelled(entity_table(spark, d))
    known = cube.cohort_cells(rows.filter("region in ('AFRICA', 'ASIA')"), ENTITY, CUBE_DIMS, CUBE_MEASURES)
    added = cube.cohort_cells(rows.filter("coalesce(region, '') not in ('AFRICA', 'ASIA')"), ENTITY, CUBE_DIMS, CUBE_MEASURES)
    return stage(cube.cohort_cube(known.unionByName(added), ENTITY, CUBE_DIMS), "cube")


@query("cohort_cube", f"""{WITH} select seg, status, region, n_lines, cast(grouping(seg, status, region) as integer) as level, count(*) as n,
{', '.join(f'count(*) filter (where label = {k}) as n_{name}' for k, name in enumerate(cohort.LEVELS))},
{', '.join(f'count({c}) as c{i}, round(sum({c}), 3) as s{i}' for i, c in enumerate(CUBE_MEASURES))}
from labelled group by grouping sets (
{', '.join('(' + ', '.join([*some, 'n_lines']) + ')' for k in range(4) for some in combinations(CUBE_DIMS, k))})""")
def _cohort_cube(spark, d):
    sums = [f"s{i}" for i in range(len(CUBE_MEASURES))]
    return _cube(spark, d).withColumns({c: F.round(c, 3) for c in sums})


@query("cohort_cube_kpis", " union all ".join(f"""select * from ({WITH}, c as (select *, {cond} as inside from labelled)
select '{name}' as cohort, count(*) filter (where inside) as n, count(*) as n_total,
{_class_sql('count(*) filter (where inside)', 'case when inside then label end')},
round(avg(case when inside then score end), 1) as avg_total,
{', '.join(f'round(avg(case when inside then {c} end), 1) as {a}' for a, c in ENTITY.summary_means.items())} from c)"""
    for name, cond in (("all", "true"), ("buildings", "seg = 'BUILDING' and n_lines between 2 and 6"), ("none", "status = 'X'"),
                       ("finished in Asia", "status = 'F' and region = 'ASIA'"))))
def _cohort_cube_kpis(spark, d):
    """Four cohorts answered from the stored cube."""
    stored = _cube(spark, d)
    asked = {"all": ({}, None), "buildings": ({"seg": "BUILDING"}, (2, 6)), "none": ({"status": "X"}, None), "finished in Asia": ({"status": "F", "region": "ASIA"}, None)}
    out = None
    for name, (equals, age) in asked.items():
        one = cube.kpis_from_cube(stored, ENTITY, CUBE_DIMS, CUBE_MEASURES, equals, age).selectExpr(f"{text(name)} as cohort", "*")
        out = one if out is None else out.unionByName(one)
    return out


CUBE_CONTRASTS = {"region AFRICA": ("region", "AFRICA"), "status F": ("status", "F")}


@query("cohort_cube_contrast", f"{WITH} " + sql_union(
    _contrast_sql(n, CONTRASTS[n], total) for n in CUBE_CONTRASTS for total in (True, False)
))
def _cohort_cube_contrast(spark, d):
    return cube.contrasts_from_cube(_cube(spark, d), ENTITY, CUBE_DIMS, CUBE_MEASURES, CUBE_CONTRASTS, "seg")


_GROWTH = sketches._growth(sketches.ERROR)


def _sketch_sql(c: str) -> str:
    picks = ", ".join(
        f"round(min(case when upto > floor({p}e0 * (total - 1)) then middle end), 6) as {sketches.quantile_name(p)}" for p in (0.25, 0.5, 0.75)
    )
    return f"""select '{c}' as feature, max(total) as n, {picks} from (
  select middle, sum(n) over (order by sgn, sgn * bucket) as upto, sum(n) over () as total from (
    select sgn, bucket, count(*) as n, case when sgn = 0 then 0 else sgn * 2e0 * exp(bucket * {_GROWTH!r}e0) / (1e0 + exp({_GROWTH!r}e0)) end as middle from (
      select sign(v) as sgn, case when v = 0 then 0 else ceil(ln(abs(v)) / {_GROWTH!r}e0) end as bucket from (
        select {c} as v from entity where {c} is not null)) group by sgn, bucket))"""


@query("sketch_quantiles", f"{WITH} select feature, cast(n as bigint) as n, p25, p50, p75 from (" + sql_union(_sketch_sql(c) for c in ENTITY.describe_cols) + ")")
def _sketch_quantiles(spark, d):
    """Quartiles from the stored cells of three partitions of the table."""
    rows = entity_table(spark, d, context=False)
    cells = stage(sketches.quantile_cells(rows, ENTITY.describe_cols, "status"), "cells")
    found = sketches.merged_quantiles(cells, (0.25, 0.5, 0.75))
    return found.select("feature", "n", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")])


@query("sketch_distinct")
def _sketch_distinct(spark, d):
    """Distinct values and duplicate rows from the stored sketches of three partitions of the table."""
    rows = entity_table(spark, d, context=False)
    return sketches.merged_distinct(stage(sketches.distinct_cells(rows, ["entity_id", *ENTITY.describe_cols], "status"), "cells"))


# --- distributions ---------------------------------------------------------------------------------

@query("histogram_by_class", f"""{WITH}, span as (select min(score) as lo, max(score) as hi from labelled)
select label, cast(least(floor((score - lo) / ((hi - lo) / 30)), 29) as integer) as bin, count(*) as n
from labelled, span where score is not null group by 1, 2""")
def _histogram(spark, d):
    return distribution.histogram_by_class(labelled(entity_table(spark, d, context=False)), "score", "label")


BOXED = ("s1", "s3")


def _long_sql(cols, extra: str = "") -> str:
    return sql_union(f"select {extra} label, '{c}' as feature, {c} as value from labelled where {c} is not null" for c in cols)


FENCES_SQL = """fences as (
  select label, feature, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as q2, quantile_cont(value, 0.75) as q3
  from long group by label, feature)"""
_OUT = "value < q1 - 1.5e0 * (q3 - q1) or value > q3 + 1.5e0 * (q3 - q1)"


@query("box_stats_by_class", f"""{WITH}, long as ({_long_sql(BOXED)}), {FENCES_SQL}
select label, feature, count(*) as n, min(value) as min, round(max(q1), 4) as p25, round(max(q2), 4) as p50, round(max(q3), 4) as p75,
max(value) as max, round(avg(value), 4) as mean,
min(value) filter (where not ({_OUT})) as whisker_lo, max(value) filter (where not ({_OUT})) as whisker_hi
from long join fences using (label, feature) group by label, feature""")
def _box_stats(spark, d):
    return distribution.box_stats_by_class(labelled(entity_table(spark, d, context=False)), BOXED, "label")


_OUTLYING = ("s1", "s4")


@query("outliers_by_class", f"""{WITH}, long as ({_long_sql(_OUTLYING, 'entity_id,')}), {FENCES_SQL}
select entity_id, label, feature, value from long join fences using (label, feature) where {_OUT}""")
def _outliers(spark, d):
    rows = labelled(entity_table(spark, d, context=False))
    return distribution.outliers_by_class(rows, _OUTLYING, "label", "entity_id")


@query("density_by_class", f"""{WITH}, long as ({_long_sql(BOXED)}),
m as (select label, feature, count(*) as n, min(value) as lo, max(value) as hi,
      stddev_samp(value) * pow(count(*), -0.2e0) as h from long group by label, feature),
c as (select label, feature, value, count(*) as k from long group by label, feature, value),
g as (select label, feature, n, h, i as grid, lo + (hi - lo) * i / 99 as x from m, range(0, 100) t(i))
select g.label, g.feature, cast(grid as integer) as grid, round(x, 6) as x,
round(sum(k * exp(-0.5e0 * ((x - value) / h) * ((x - value) / h)) / (n * h * {math.sqrt(2 * math.pi)!r}e0)), 6) as density
from g join c on g.label = c.label and g.feature = c.feature group by g.label, g.feature, grid, x""")
def _density(spark, d):
    return distribution.density_by_class(labelled(entity_table(spark, d, context=False)), BOXED, "label")


def _sample_sql(k: int, seed: int) -> str:
    return f"order by md5(concat('{seed}:', cast(entity_id as varchar))), entity_id limit {k}"


@query("sample_rows", f"{WITH} select entity_id, score, label from labelled {_sample_sql(800, 1)}")
def _sample_rows(spark, d):
    rows = labelled(entity_table(spark, d, context=False)).select("entity_id", "score", "label")
    return distribution.sample_rows(rows, 800, "entity_id", 1)


@query("scatter_points", f"{WITH} select entity_id, s3 as x, score as y, label from labelled {_sample_sql(600, 2)}")
def _scatter(spark, d):
    rows = labelled(entity_table(spark, d, context=False))
    return distribution.scatter_points(rows, "s3", "score", "label", "entity_id", 600, 2)


def _trend_sql(passes: int) -> str:
    """The trend with its robustness passes written out one after the other."""

    def lines(cells: str, targets: str, out: str) -> str:
        return f"""
{out}_d as (select target, gx, need, n, w, wy, x - gx as u, abs(x - gx) as d from {targets}, {cells}, tot),
{out}_c as (select *, sum(n) over (partition by target order by d, n, u rows unbounded preceding) - n as seen from {out}_d),
{out}_b as (select target, max(d) filter (where seen < need) as h from {out}_c group by target),
{out}_w as (select target, gx, u, w, wy, case when d / h < 1 then pow(1 - pow(d / h, 3), 3) else 0 end as t from {out}_d join {out}_b using (target)),
{out}_f as (select target, gx, sum(t * w) as w, sum(t * w * u) as wx, sum(t * wy) as wy, sum(t * w * u * u) as wxx, sum(t * wy * u) as wxy from {out}_w group by target, gx),
{out} as (select target, gx, (wxx * wy - wx * wxy) / (w * wxx - wx * wx) as v, (w * wxy - wx * wy) / (w * wxx - wx * wx) as s from {out}_f)"""

    steps = ["""pts as (select s3 as px, score as py from entity where s3 is not null and score is not null),
span as (select min(px) as lo, max(px) as hi from pts),
placed as (select px, py, least(floor((px - lo) / (hi - lo) * 1000), 999) as cell from pts, span),
cells0 as (select cell, count(*)::double as n, avg(px) as x, count(*)::double as w, sum(py) as wy from placed group by cell),
tot as (select floor((2e0 / 3e0) * sum(n) + 1e-10) as need, min(x) as lo, max(x) as hi from cells0)"""]
    for i in range(passes):
        steps.append(f"""at{i} as (select cell as target, x as gx from cells{i}), {lines(f'cells{i}', f'at{i}', f'line{i}')},
away{i} as (select cell, px, py, abs(py - (v + s * (px - gx))) as r from placed join line{i} on cell = target),
half{i} as (select median(r) as m from away{i}),
cells{i + 1} as (select cell, count(*)::double as n, avg(px) as x, sum(b) as w, sum(b * py) as wy from (
  select cell, px, py, case when r < 6 * m then pow(1 - pow(r / (6 * m), 2), 2) else 0 end as b from away{i}, half{i}) group by cell)""")
    steps.append(f"grid as (select i as target, lo + (hi - lo) * i / 99 as gx from tot, range(0, 100) t(i)), {lines(f'cells{passes}', 'grid', 'trend')}")
    return f"{WITH}, {', '.join(steps)} select cast(target as integer) as grid, round(gx, 6) as x, round(v, 4) as y from trend"


@query("lowess_trend", _trend_sql(3))
def _lowess(spark, d):
    return distribution.lowess_trend(entity_table(spark, d, context=False), "s3", "score")


@query("lowess_without_passes", _trend_sql(0))
def _lowess_plain(spark, d):
    return distribution.lowess_trend(entity_table(spark, d, context=False), "s3", "score", passes=0)


# --- splits ----------------------------------------------------------------------------------------

RANKED_SQL = """ranked as (
  select entity_id, label, row_number() over (partition by label order by md5(concat('42:', cast(entity_id as varchar))), entity_id) as rk
  from labelled), sizes as (select label, count(*) as n from labelled group by label)"""

SPLIT_SQL = f"""{RANKED_SQL}, quota as (
  select label, (test * n) // total as base, (test * n) % total as rest, test from (
    select label, n, cast(sum(n) over () as bigint) as total, cast(ceil(0.2e0 * sum(n) over ()) as bigint) as test from sizes)),
quotas as (select label, base + case when row_number() over (order by rest desc, label) <= test - sum(base) over () then 1 else 0 end as q from quota),
split as (select entity_id, label, case when rk <= q then 'test' else 'train' end as split from ranked join quotas using (label))"""

FOLDS_SQL = f"""{RANKED_SQL}, starts as (
  select label, n, coalesce(sum(n) over (order by label rows between unbounded preceding and 1 preceding), 0) as start from sizes),
dealt as (select label, start + i as pos from starts, lateral (select unnest(range(0, n)) as i)),
per_fold as (select label, pos % 5 as fold, count(*) as q from dealt group by label, pos % 5),
upto as (select label, fold, sum(q) over (partition by label order by fold) as last, sum(q) over (partition by label order by fold) - q as before from per_fold),
folds as (select entity_id, ranked.label as label, cast(fold as integer) as fold from ranked join upto on ranked.label = upto.label and rk > before and rk <= last)"""


@query("stratified_split", f"{WITH}, {SPLIT_SQL} select * from split")
def _split(spark, d):
    rows = labelled(entity_table(spark, d, context=False)).select("entity_id", "label")
    return splits.stratified_split(rows, ENTITY).select("entity_id", "label", "split")


@query("stratified_folds", f"{WITH}, {FOLDS_SQL} select * from folds")
def _folds(spark, d):
    rows = labelled(entity_table(spark, d, context=False)).select("entity_id", "label")
    return splits.stratified_folds(rows, ENTITY).select("entity_id", "label", "fold")


@query("balanced_weights", f"""{WITH}, sizes as (select label, count(*) as n from labelled group by label)
select entity_id, label, round((select sum(n) from sizes) / ((select count(*) from sizes) * n), 6) as weight
from labelled join sizes using (label)""")
def _weights(spark, d):
    rows = labelled(entity_table(spark, d, context=False))
    return splits.balanced_weights(rows, ENTITY).select("entity_id", "label", F.round("weight", 6).alias("weight"))
