"""Queries on scored tables: alerts, evaluation, explanation, what-if, and trained models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import argmax_class, confidence, entity_name, round_percent, stack, text
from ..operators import boosting, cohort, distribution, evaluate, explain, kernel_explain, score, splits, train, tree_explain
from ..operators.prepare import available_features
from ..sources import model_store
from ..sources.staging import stage, work_path
from ..sources.tables import csv_export, csv_ingest
from ..streaming.scoring import score_stream
from .binding import (
    ALL_SCORERS_SQL,
    ENTITY,
    ENTITY_SQL,
    LABELS_SQL,
    SCHEMAS,
    SCORED_SQL,
    SCORERS,
    all_scorers,
    entity_table,
    fixed_scorer,
    labelled,
    pct_sql,
    r,
    scored_fixture,
    scorer_sql,
)
from .registry import query
from .table_queries import FOLDS_SQL, _class_sql, sql_union

WITH = f"with {SCORED_SQL}"
MODELS_WITH = f"with {ALL_SCORERS_SQL}"
MAIN = "Full score"

# --- alerts ----------------------------------------------------------------------------------------

ORDER_SQL = "order by pred, pct_high desc, entity_id"
ALERT_SQL = f"""{WITH}, filtered as (select * from scored where risk_label in ('High risk', 'Medium risk') and confidence >= 60),
view as (select * from filtered {ORDER_SQL} limit 100)"""
ALERT_COLS_SQL = "entity_id, seg, n_lines, status, s1, score, risk_label, pct_high, confidence"


def _filtered(spark, d):
    return cohort.alert_filter(scored_fixture(spark, d), ENTITY, ("High risk", "Medium risk"), None, 60.0)


def _view(spark, d):
    return cohort.alert_ranking(_filtered(spark, d), ENTITY, 100)


@query("round_percent", f"{WITH} select entity_id, pct_high, pct_medium, pct_low from scored")
def _round_percent(spark, d):
    rows = fixed_scorer()(entity_table(spark, d, context=False))
    return rows.select(
        "entity_id",
        *[round_percent(p).alias(a) for p, a in (("p0", "pct_high"), ("p1", "pct_medium"), ("p2", "pct_low"))],
    )


@query("confidence", f"{WITH} select entity_id, confidence from scored")
def _confidence(spark, d):
    rows = fixed_scorer()(entity_table(spark, d, context=False))
    return rows.select("entity_id", confidence("p0", "p1", "p2").alias("confidence"))


@query("alert_filter", f"""{WITH} select entity_id, seg, pred, risk_label, confidence from scored
where risk_label in ('High risk', 'Medium risk') and seg = 'MACHINERY' and confidence >= 60""")
def _alert_filter(spark, d):
    rows = cohort.alert_filter(scored_fixture(spark, d), ENTITY, ("High risk", "Medium risk"), "MACHINERY", 60.0)
    return rows.select("entity_id", "seg", "pred", "risk_label", "confidence")


@query("alert_ranking", f"{ALERT_SQL} select entity_id, pred, pct_high, confidence from view {ORDER_SQL}")
def _alert_ranking(spark, d):
    return _view(spark, d).select("entity_id", "pred", "pct_high", "confidence")


@query("alert_projection", f"{ALERT_SQL} select {ALERT_COLS_SQL} from view")
def _alert_projection(spark, d):
    return cohort.alert_projection(_view(spark, d), ENTITY)


@query("csv_export", f"{ALERT_SQL} select {ALERT_COLS_SQL} from view")
def _csv_export(spark, d):
    """Export the alert view, then read the file back."""
    shown = cohort.alert_projection(_view(spark, d), ENTITY)
    path = csv_export(shown, work_path(spark, "export"), ENTITY, MAIN, single_file=True)
    types = {f.name: f.dataType.simpleString() for f in shown.schema}
    return csv_ingest(spark, path, types)


@query("alert_kpis", f"{ALERT_SQL} select count(*) as n, {_class_sql('count(*)', 'pred')} from view")
def _alert_kpis(spark, d):
    return cohort.alert_kpis(_view(spark, d))


@query("alert_group_count", f"{ALERT_SQL} select seg, risk_label, count(*) as n from view where seg is not null group by seg, risk_label")
def _alert_group_count(spark, d):
    return cohort.group_risk_count(_view(spark, d), "seg", "risk_label")


@query("top_high_risk", f"{ALERT_SQL} select entity_id, pct_high from view where pred = 0 {ORDER_SQL} limit 20")
def _top_high_risk(spark, d):
    return cohort.top_high_risk(_view(spark, d), ENTITY).select("entity_id", "pct_high")


@query("entity_name", f"{ALERT_SQL} select entity_id, 'ID-' || cast(entity_id as varchar) as name from view where pred = 0 {ORDER_SQL} limit 20")
def _entity_name(spark, d):
    top = cohort.top_high_risk(_view(spark, d), ENTITY)
    return top.select("entity_id", entity_name(top.columns, ENTITY).alias("name"))


@query("alert_scatter", f"""{ALERT_SQL} select entity_id, score as x, confidence as y, risk_label as label from view
order by md5(concat('7:', cast(entity_id as varchar))), entity_id limit 500""")
def _alert_scatter(spark, d):
    return distribution.scatter_points(_view(spark, d), "score", "confidence", "risk_label", "entity_id", 500, 7)


# --- evaluation ------------------------------------------------------------------------------------

def _all(spark, d):
    return all_scorers(labelled(entity_table(spark, d, context=False)))


CELLS_SQL = """grid as (select model, l.i as label, p.i as pred from (select distinct model from allm), range(0, 3) l(i), range(0, 3) p(i)),
conf as (select g.model, cast(g.label as integer) as label, cast(g.pred as integer) as pred, count(a.entity_id) as n from grid g
  left join allm a on a.model = g.model and a.label = g.label and a.pred = g.pred group by g.model, g.label, g.pred)"""

METRICS_SQL = """byclass as (
  select k.model, k.i as k, (select sum(n) from conf c where c.model = k.model and c.label = k.i and c.pred = k.i) as tp,
         (select sum(n) from conf c where c.model = k.model and c.label = k.i) as real,
         (select sum(n) from conf c where c.model = k.model and c.pred = k.i) as said
  from (select distinct model, i from conf, range(0, 3) t(i)) k),
macro as (
  select model, cast(sum(real) as bigint) as n, round(sum(tp) / sum(real), 4) as accuracy,
         round(avg(coalesce(tp / nullif(said, 0), 0)) filter (where real + said > 0), 4) as precision,
         round(avg(coalesce(tp / nullif(real, 0), 0)) filter (where real + said > 0), 4) as recall,
         round(avg(coalesce(2 * tp / nullif(real + said, 0), 0)) filter (where real + said > 0), 4) as f1
  from byclass group by model)"""

AUC_SQL = """per as (
  select model, 0 as class, p0 as s, label = 0 as pos from allm union all
  select model, 1, p1, label = 1 from allm union all select model, 2, p2, label = 2 from allm),
cnt as (select model, class, s, count(*) filter (where pos) as pos, count(*) filter (where not pos) as neg from per group by model, class, s),
run as (select *, sum(neg) over (partition by model, class order by s) - neg as below,
        sum(pos) over (partition by model, class) as P, sum(neg) over (partition by model, class) as N from cnt),
aucs as (select model, class, sum(pos * (below + neg / 2e0)) / nullif(max(P * N)::double, 0) as auc from run group by model, class),
auc as (select model, round(avg(auc), 4) as roc_auc from aucs group by model)"""


@query("confusion_matrix", f"{MODELS_WITH}, {CELLS_SQL} select * from conf")
def _confusion(spark, d):
    return evaluate.confusion_matrix(_all(spark, d), ["model"])


@query("confusion_normalised", f"""{MODELS_WITH}, {CELLS_SQL}
select model, label, pred, n, round(n / (sum(n) over (partition by model, label) + 1e-9), 6) as share from conf""")
def _confusion_normalised(spark, d):
    return evaluate.confusion_normalised(evaluate.confusion_matrix(_all(spark, d), ["model"]), ["model"])


@query("macro_metrics", f"{MODELS_WITH}, {CELLS_SQL}, {METRICS_SQL} select * from macro")
def _macro_metrics(spark, d):
    return evaluate.macro_metrics(_all(spark, d), ["model"])


@query("auc_ovr_macro", f"{MODELS_WITH}, {AUC_SQL} select * from auc")
def _auc(spark, d):
    return evaluate.auc_ovr_macro(_all(spark, d), ["model"])


ROC_SQL = """points as (
  select model, class, max(P) as P, max(N) as N, 0::bigint as fp, 0::bigint as tp from run group by model, class
  union all
  select model, class, P, N, sum(neg) over w as fp, sum(pos) over w as tp from run
  window w as (partition by model, class order by s desc)),
per_fp as (select model, class, max(P) as P, max(N) as N, fp, min(tp) as tp_first, max(tp) as tp_last from points group by model, class, fp),
seg as (select *, lead(fp) over w as fp_next, lead(tp_first) over w as tp_next from per_fp window w as (partition by model, class order by fp)),
curve as (
  select model, class, i as grid,
         case when fp = N then 1e0 else (tp_last + (tp_next - tp_last) * ((i * N / 199e0 - fp) / (fp_next - fp))) / P end as tpr
  from seg join range(0, 200) t(i) on i * N >= fp * 199 and (fp_next is null or i * N < fp_next * 199)),
mean as (select model, grid, sum(tpr) / 3 as tpr from curve group by model, grid),
area as (select model, sum(case when grid in (0, 199) then tpr / 2 else tpr end) / 199 as auc from mean group by model)"""


@query("roc_curve_macro", f"""{MODELS_WITH}, {AUC_SQL}, {ROC_SQL}
select model, cast(grid as integer) as grid, round(grid / 199e0, 6) as fpr, round(tpr, 6) as tpr, round(auc, 6) as auc from mean join area using (model)""")
def _roc(spark, d):
    return evaluate.roc_curve_macro(_all(spark, d), ["model"])


def _with_folds(spark, d):
    rows = labelled(entity_table(spark, d, context=False))
    return all_scorers(splits.stratified_folds(rows, ENTITY), "fold")


FOLD_F1_SQL = """foldcells as (select model, fold, a.label, pred, count(*) as n from allm a join folds using (entity_id) group by model, fold, a.label, pred),
foldclass as (
  select k.model, k.fold, k.i, (select coalesce(sum(n), 0) from foldcells c where c.model = k.model and c.fold = k.fold and c.label = k.i and c.pred = k.i) as tp,
         (select coalesce(sum(n), 0) from foldcells c where c.model = k.model and c.fold = k.fold and c.label = k.i) as real,
         (select coalesce(sum(n), 0) from foldcells c where c.model = k.model and c.fold = k.fold and c.pred = k.i) as said
  from (select distinct model, fold, i from foldcells, range(0, 3) t(i)) k),
fold_f1 as (select model, fold, round(avg(coalesce(2 * tp / nullif(real + said, 0), 0)) filter (where real + said > 0), 4) as f1_macro
  from foldclass group by model, fold),
cv as (select model, round(avg(f1_macro), 4) as cv_mean, round(stddev_pop(f1_macro), 4) as cv_std from fold_f1 group by model)"""


@query("fold_scores", f"{MODELS_WITH}, {FOLDS_SQL}, {FOLD_F1_SQL} select * from fold_f1")
def _fold_scores(spark, d):
    return evaluate.fold_scores(_with_folds(spark, d))


@query("cv_summary", f"{MODELS_WITH}, {FOLDS_SQL}, {FOLD_F1_SQL} select * from cv")
def _cv_summary(spark, d):
    return evaluate.cv_summary(evaluate.fold_scores(_with_folds(spark, d)))


COMPARISON_SQL = f"""{MODELS_WITH}, {CELLS_SQL}, {METRICS_SQL}, {AUC_SQL}, {FOLDS_SQL}, {FOLD_F1_SQL},
comparison as (select model, accuracy, precision, recall, f1, roc_auc, cv_mean, cv_std,
  format('{{:.4f}} ± {{:.4f}}', cv_mean, cv_std) as cv_text, case when model = '{MAIN}' then '★' else '' end as main
  from macro left join auc using (model) left join cv using (model)),
metric_long as (unpivot (select model, accuracy, precision, recall, f1, roc_auc, cv_mean from comparison)
  on accuracy, precision, recall, f1, roc_auc, cv_mean into name metric value value)"""


def _comparison(spark, d):
    """Test metrics and fold scores of every scorer, from one pass each over the scored table."""
    cv = evaluate.cv_summary(evaluate.fold_scores(_with_folds(spark, d)))
    return evaluate.model_comparison(evaluate.model_metrics(_all(spark, d)), cv, ENTITY)


@query("model_comparison", f"{COMPARISON_SQL} select * from comparison")
def _model_comparison(spark, d):
    return _comparison(spark, d)


@query("metric_long", f"{COMPARISON_SQL} select * from metric_long")
def _metric_long(spark, d):
    return evaluate.metric_long(_comparison(spark, d))


@query("best_metric_flag", f"""{COMPARISON_SQL} select model, metric, value,
value = max(value) over (partition by metric) as is_best from metric_long""")
def _best_metric_flag(spark, d):
    return cohort.best_metric_flag(evaluate.metric_long(_comparison(spark, d)))


@query("leakage_delta", f"""{MODELS_WITH}, {CELLS_SQL}, {METRICS_SQL}, {AUC_SQL},
ml as (unpivot (select model, accuracy, f1, roc_auc from macro join auc using (model)) on accuracy, f1, roc_auc into name metric value value)
select a.metric, a.value as full_value, b.value as reduced_value, round(b.value - a.value, 4) as delta,
abs(round(b.value - a.value, 4)) as gap, 3 as n_features
from ml a join ml b on a.metric = b.metric and a.model = '{MAIN}' and b.model = 'Early score'""")
def _leakage_delta(spark, d):
    metrics = evaluate.model_metrics(_all(spark, d))
    long = evaluate.metric_long(metrics, ("accuracy", "f1", "roc_auc"))
    return evaluate.leakage_delta(long, MAIN, "Early score", len(SCORERS["Early score"]))


@query("success_gate", f"{MODELS_WITH}, {CELLS_SQL}, {METRICS_SQL} select model, f1, 0.75e0 as target, f1 >= 0.75e0 as reached from macro")
def _success_gate(spark, d):
    return evaluate.success_gate(evaluate.macro_metrics(_all(spark, d), ["model"]), ENTITY)


# --- scoring ---------------------------------------------------------------------------------------

SCORED_COLS = ("entity_id", "label", "pred", "p0", "p1", "p2", "risk_label", "pct_high", "pct_medium", "pct_low", "confidence")


@query("scored_fixture", f"{WITH} select {', '.join(SCORED_COLS)} from scored")
def _scored(spark, d):
    return scored_fixture(spark, d, context=False).select(*SCORED_COLS)


_PARTIAL_SQL = f"""{WITH}, filled as (select entity_id, coalesce(s1, 0) as s1, 0e0 as s3, coalesce(s4, 0) as s4, 0e0 as s5, coalesce(s6, 0) as s6 from entity),
{scorer_sql('filled', 'partial', keep='entity_id')}"""


@query("score_partial", f"""{_PARTIAL_SQL} select entity_id, pred, p0, p1, p2, {LABELS_SQL} as risk_label, {pct_sql('p0')} as pct_high,
{pct_sql('greatest(p0, p1, p2)')} as confidence from partial""")
def _score_partial(spark, d):
    """Records with only three of the components: the absent ones count as zero."""
    records = entity_table(spark, d, context=False).select("entity_id", "s1", "s4", "s6")
    rows = score.score_partial(records, fixed_scorer(), ENTITY, ("s1", "s3", "s4", "s5", "s6"))
    return rows.select("entity_id", "pred", "p0", "p1", "p2", "risk_label", "pct_high", "confidence")


@query("score_stream", f"""{WITH}, arriving as (select o_orderkey as entity_id, 0e0 as s1, 0e0 as s3, 0e0 as s4, 0e0 as s5, o_totalprice / 5000e0 as s6 from orders),
{scorer_sql('arriving', 'streamed', keep='entity_id')} select entity_id, pred, p0, p1, p2, {LABELS_SQL} as risk_label from streamed""")
def _score_stream(spark, d):
    """Orders arriving as a stream, with the order value as the only known feature."""
    arriving = spark.readStream.schema(SCHEMAS["orders"]).parquet(f"{d}/orders.parque[t]").selectExpr(
        "o_orderkey as entity_id", "o_totalprice / 5000D as s6"
    )
    sink, marks = work_path(spark, "scored"), work_path(spark, "offsets")
    run = score_stream(
        arriving, fixed_scorer(), ENTITY, sink, marks, ("s1", "s3", "s4", "s5", "s6"),
        keep=("entity_id", "pred", "p0", "p1", "p2", "risk_label"),
    )
    run.awaitTermination()
    return spark.read.parquet(sink)


@query("class_probabilities", f"""{WITH} """ + sql_union(
    f"select entity_id, {k} as class, '{ENTITY.labels[k]}' as risk_label, p{k} as probability, {pct_sql(f'p{k}')} as percent, pred = {k} as is_predicted from scored"
    for k in range(3)
))
def _class_probabilities(spark, d):
    return score.class_probabilities(fixed_scorer()(entity_table(spark, d, context=False)), ENTITY)


_PRESET_SQL = sql_union(
    f"select '{n}' as preset, " + ", ".join(f"{v!r}e0 as {c}" for c, v in p.items()) for n, p in ENTITY.presets.items()
)


@query("profile_presets", f"""{WITH}, presets as ({_PRESET_SQL}), {scorer_sql('presets', 'sp')}
select preset, pred, p0, p1, p2, {pct_sql('greatest(p0, p1, p2)')} as confidence,
(select count(*) from scored where scored.p0 > sp.p0) as n_riskier, (select count(*) from scored) as n_entities from sp""")
def _profile_presets(spark, d):
    """Score the named profiles and count how many entities of the table are riskier than each."""
    presets = score.profile_presets(spark, ENTITY)
    scored = score.score_partial(presets, fixed_scorer(), ENTITY, ("s1", "s2", "s3", "s4", "s5", "s6"))
    mine = scored.select("preset", "pred", "p0", "p1", "p2", "confidence")
    limits = mine.selectExpr("map_from_entries(collect_list(struct(preset, p0)))").scalar()  # one entry per preset
    population = fixed_scorer()(entity_table(spark, d, context=False)).select("p0").withColumn("_limits", limits)
    counted = population.selectExpr(
        "count(1) as n_entities",
        *[f"count_if(p0 > _limits[{text(n)}]) as _n{i}" for i, n in enumerate(ENTITY.presets)],
    ).selectExpr("n_entities", stack(
        [(text(n), f"_n{i}") for i, n in enumerate(ENTITY.presets)], ("preset", "n_riskier")
    ))
    return mine.join(F.broadcast(counted), "preset")  # one row per preset


# --- explanation and what-if -----------------------------------------------------------------------

WEIGHTS = {c: w for w, c in SCORERS[MAIN]}


def _linear(spark, d):
    return explain.linear_contributions(entity_table(spark, d, context=False), WEIGHTS, "entity_id")


LINEAR_SQL = f"with {ENTITY_SQL}, contributions as (" + sql_union(
    f"select entity_id, '{c}' as feature, {c} as value, round({w!r}e0 * ({c} - (select avg({c}) from entity)), 6) as contribution from entity where {c} is not null"
    for c, w in WEIGHTS.items()
) + """), ordered as (select *, cast(row_number() over (partition by entity_id order by abs(contribution) desc, feature) as integer) as rank,
case when contribution > 0 then 'raises' else 'lowers' end as direction from contributions)"""


@query("attribution_linear", f"{LINEAR_SQL} select entity_id, rank, feature, value, contribution, direction from ordered")
def _attribution_linear(spark, d):
    return explain.attribution(_linear(spark, d), list(WEIGHTS), "entity_id")


@query("attribution_topk", f"{LINEAR_SQL} select entity_id, rank, feature, contribution from ordered where rank <= 3")
def _attribution_topk(spark, d):
    rows = explain.attribution(_linear(spark, d), list(WEIGHTS), "entity_id", top=3)
    return rows.select("entity_id", "rank", "feature", "contribution")


@query("attribution_direction", f"{LINEAR_SQL} select feature, direction, count(*) as n from ordered group by feature, direction")
def _attribution_direction(spark, d):
    rows = explain.attribution(_linear(spark, d), list(WEIGHTS), "entity_id")
    return rows.groupBy("feature", "direction").agg(F.expr("count(1) as n"))


# A fixed softmax model and fixed trees stand in for fitted ones, so that every subset of features can be written out in SQL.
EXPLAINED = ("s3", "s4", "s5", "s6")
SOFTMAX = kernel_explain.SoftmaxModel(
    EXPLAINED, np.array([[-0.5, -1.25, 0.25, -0.75], [0.25, 0.5, -0.75, 0.5], [0.5, 1.0, 0.25, 1.5]]), np.array([0.5, 0.25, -0.5]),
    np.array([30.0, 35.0, 25.0, 30.0]), np.array([15.0, 10.0, 20.0, 25.0]),
)
# Nodes as (left, right, feature, threshold, weight, class outputs).
FIXED_TREES = (
    {
        0: (1, 2, 1, 36.0, 100.0, None), 1: (3, 4, 3, 20.0, 60.0, None), 2: (5, 6, 0, 45.0, 40.0, None),
        3: (-1, -1, -1, 0.0, 25.0, (0.5, 0.1, 0.0)), 4: (7, 8, 1, 30.0, 35.0, None), 5: (-1, -1, -1, 0.0, 30.0, (0.1, 0.3, 0.2)),
        6: (-1, -1, -1, 0.0, 10.0, (0.0, 0.1, 0.5)), 7: (-1, -1, -1, 0.0, 15.0, (0.3, 0.2, 0.1)), 8: (-1, -1, -1, 0.0, 20.0, (0.2, 0.4, 0.0)),
    },
    {
        0: (1, 2, 2, 20.0, 80.0, None), 1: (3, 4, 3, 30.0, 50.0, None), 2: (-1, -1, -1, 0.0, 30.0, (0.05, 0.2, 0.15)),
        3: (-1, -1, -1, 0.0, 20.0, (0.3, 0.1, 0.0)), 4: (-1, -1, -1, 0.0, 30.0, (0.0, 0.05, 0.35)),
    },
)


def _tree_expr(nodes: dict, k: int, at: int = 0, known: str | None = None) -> str:
    """Output k of a tree (SQL text); with ``known``, a bit mask, unknown features are split by weight."""
    left, right, feature, threshold, weight, value = nodes[at]
    if left < 0:
        return f"{value[k]!r}e0"
    low, high = (_tree_expr(nodes, k, c, known) for c in (left, right))
    way = f"case when {EXPLAINED[feature]} <= {threshold!r}e0 then {low} else {high} end"
    if known is None:
        return way
    shares = [nodes[c][4] / weight for c in (left, right)]
    return f"case when ({known} >> {feature}) & 1 = 1 then {way} else {shares[0]!r}e0 * {low} + {shares[1]!r}e0 * {high} end"


def _output(k: int, known: str | None = None) -> str:
    return "(" + " + ".join(_tree_expr(t, k, known=known) for t in FIXED_TREES) + ")"


def _subsets_sql(head: str, value: str) -> str:
    """Contributions as the average change over all subsets ``c`` of the four features; ``value`` may use rows and ``c``."""
    cells = "case pred " + " ".join(f"when {k} then {value.format(k=k)}" for k in range(3))
    per_feature = sql_union(
        f"select a.entity_id as entity_id, '{f}' as feature, any_value(a.{f}) as value, "
        f"round(sum((b.v - a.v) * case bit_count(a.c) when 0 then 0.25e0 when 3 then 0.25e0 else 1e0 / 12 end), 6) as contribution "
        f"from worth a join worth b on a.entity_id = b.entity_id and b.c = a.c + {1 << j} where (a.c >> {j}) & 1 = 0 group by a.entity_id"
        for j, f in enumerate(EXPLAINED)
    )
    return f"""with {ENTITY_SQL}, {head}, worth as (select *, {cells} end as v from explained, range(0, 16) t(c)), shares as ({per_feature})
select entity_id, feature, value, contribution, cast(row_number() over (partition by entity_id order by abs(contribution) desc, feature) as integer) as rank,
case when contribution > 0 then 'raises' else 'lowers' end as direction from shares"""


def _logit(k: int, c: str | None) -> str:
    m = SOFTMAX
    known = [f" * (({c} >> {j}) & 1)" if c else "" for j in range(4)]
    return "(" + " + ".join([repr(float(m.intercept[k])) + "e0"] + [
        f"({float(m.coef[k, j])!r}e0) * ({f} - {float(m.centre[j])!r}e0) / {float(m.spread[j])!r}e0{known[j]}" for j, f in enumerate(EXPLAINED)
    ]) + ")"


_LOGITS = [_logit(k, None) for k in range(3)]
_SOFTMAX_SQL = _subsets_sql(
    f"""scored_z as (select entity_id, s3, s4, s5, s6, {', '.join(f'{z} as z{k}' for k, z in enumerate(_LOGITS))} from entity),
explained as (select * exclude (z0, z1, z2), case when z0 >= z1 and z0 >= z2 then 0 when z1 >= z2 then 1 else 2 end as pred from scored_z)""",
    "exp(LOGIT{k}) / (exp(LOGIT0) + exp(LOGIT1) + exp(LOGIT2))",
).replace("LOGIT0", _logit(0, "c")).replace("LOGIT1", _logit(1, "c")).replace("LOGIT2", _logit(2, "c"))


@query("attribution_kernel", _SOFTMAX_SQL)
def _attribution_kernel(spark, d):
    """Kernel contributions of a fixed softmax model to the probability of each entity's predicted class."""
    wide = kernel_explain.kernel_contributions(entity_table(spark, d, context=False), SOFTMAX, "entity_id")
    return explain.attribution(wide, EXPLAINED, "entity_id")


_TREES_SQL = _subsets_sql(
    f"""scored_z as (select entity_id, s3, s4, s5, s6, {', '.join(f'{_output(k)} as z{k}' for k in range(3))} from entity),
explained as (select * exclude (z0, z1, z2), case when z0 >= z1 and z0 >= z2 then 0 when z1 >= z2 then 1 else 2 end as pred from scored_z)""",
    "OUTPUT{k}",
).replace("OUTPUT0", _output(0, "c")).replace("OUTPUT1", _output(1, "c")).replace("OUTPUT2", _output(2, "c"))


@query("attribution_trees", _TREES_SQL)
def _attribution_trees(spark, d):
    """Exact contributions of two fixed trees to the output of each entity's predicted class."""
    entities = entity_table(spark, d, context=False).selectExpr("entity_id", *EXPLAINED, *[f"{_output(k)} as z{k}" for k in range(3)])
    scored = entities.selectExpr("*", f"{argmax_class('z0', 'z1', 'z2')} as pred")
    table = tree_explain.tree_table(FIXED_TREES, np.array, len(EXPLAINED), 3)
    return explain.attribution(tree_explain.explained(scored, table, EXPLAINED, "entity_id"), EXPLAINED, "entity_id")


SCENARIOS = {"intervention": ENTITY.overrides, "order value only": ENTITY.overrides[2:3]}
# SQL least and greatest skip a missing argument, so s1, the one component with gaps, is guarded.
_CHANGED = {
    "intervention": "case when s1 is not null then least(100e0, s1 + 5e0) end as s1, greatest(1e0, s3 - 20e0) as s3, least(100e0, s4 + 10e0) as s4, s5, least(100e0, s6 + 10e0) as s6",
    "order value only": "s1, s3, s4, s5, least(100e0, s6 + 10e0) as s6",
}
WHAT_IF_SQL = f"""{WITH}, changed as ({sql_union(f"select entity_id, '{n}' as scenario, {e} from entity" for n, e in _CHANGED.items())}),
{scorer_sql('changed', 'after', keep='entity_id, scenario, s1, s3, s4, s5, s6')},
compared as (select a.entity_id, a.scenario, b.pred as pred_before, a.pred as pred_after,
  case when a.pred > b.pred then 'better' when a.pred < b.pred then 'worse' else 'no change' end as change,
  b.p0 as p0_before, b.p1 as p1_before, b.p2 as p2_before, a.p0 as p0_after, a.p1 as p1_after, a.p2 as p2_after
  from after a join scored b using (entity_id))"""


def _what_if_rows(spark, d):
    entities = entity_table(spark, d, context=False)
    return explain.what_if(entities, fixed_scorer(), SCENARIOS, ENTITY, ("s1", "s3", "s4", "s5", "s6"))


@query("what_if", f"{WHAT_IF_SQL} select * from compared")
def _what_if(spark, d):
    return _what_if_rows(spark, d)


@query("what_if_compare", f"{WHAT_IF_SQL} " + sql_union(
    f"select entity_id, scenario, '{ENTITY.labels[k]}' as risk_label, {pct_sql(f'p{k}_before')} as pct_before, {pct_sql(f'p{k}_after')} as pct_after from compared"
    for k in range(3)
))
def _what_if_compare(spark, d):
    return explain.what_if_compare(_what_if_rows(spark, d), ENTITY)


# --- trained models (no SQL equivalent) --------------------------------------------------------------

# Small settings keep the registered runs short; the library defaults are the full ones, which ``train_boosted`` has.
SMALL = {
    train.LOGISTIC: {"maxIter": 50},
    train.TREE: {},
    train.FOREST: {"numTrees": 20, "maxDepth": 8},
    train.BOOSTED: {"maxIter": 10, "maxDepth": 4},
}


def _frame(spark, d):
    return train.training_frame(entity_table(spark, d), ENTITY)


def _fit(frame, name, features=None, settings=SMALL):
    chosen = available_features(frame, features or ENTITY.features)
    return train.fit_model(name, frame.filter("split = 'train'"), ENTITY, chosen, settings[name])


def _trained(name, settings):
    def run(spark: SparkSession, d: str) -> DataFrame:
        frame = _frame(spark, d)
        scored = stage(train.holdout_scores(_fit(frame, name, settings=settings), frame, ENTITY), "holdout")
        return evaluate.model_metrics(scored)

    return run


for _key, _name, _settings in (
    ("train_logistic", train.LOGISTIC, SMALL), ("train_tree", train.TREE, SMALL),
    ("train_forest", train.FOREST, SMALL), ("train_boosted", train.BOOSTED, train.DEFAULTS),
):
    query(_key)(_trained(_name, _settings))


@query("train_all")
def _train_all(spark, d):
    """The three single models with cross-validation, compared."""
    names = (train.LOGISTIC, train.TREE, train.FOREST)
    run = train.train_all(entity_table(spark, d), ENTITY.with_(main_model=train.FOREST), names, SMALL, folds=3, parallelism=3)
    return run.tables["comparison"]


@query("cross_validate")
def _cross_validate(spark, d):
    frame = _frame(spark, d)
    scored = train.cross_validate(train.TREE, frame, ENTITY, available_features(frame, ENTITY.features), parallelism=5)
    return evaluate.fold_scores(scored)


@query("train_behavioural")
def _train_behavioural(spark, d):
    """Full and behavioural forests on the same split, and how much the leaking features add."""
    frame = _frame(spark, d)
    full = _fit(frame, train.FOREST)
    reduced = train.train_behavioural(frame, ENTITY, SMALL[train.FOREST])
    scored = stage(train.holdout_scores(full, frame, ENTITY, "full").unionByName(
        train.holdout_scores(reduced, frame, ENTITY, "behavioural")
    ), "holdout")
    long = evaluate.metric_long(evaluate.model_metrics(scored), ("accuracy", "f1", "roc_auc"))
    return evaluate.leakage_delta(long, "full", "behavioural", len(reduced.features))


@query("feature_importance")
def _feature_importance(spark, d):
    frame = _frame(spark, d)
    return train.feature_importance(_fit(frame, train.FOREST), frame, ENTITY)


@query("importance_topk")
def _importance_topk(spark, d):
    frame = _frame(spark, d)
    return cohort.importance_topk(train.feature_importance(_fit(frame, train.TREE), frame, ENTITY), 5)


@query("attribution_fallback")
def _attribution_fallback(spark, d):
    """Global importance, shown where contributions are not available."""
    frame = _frame(spark, d)
    return cohort.importance_topk(train.feature_importance(_fit(frame, train.FOREST), frame, ENTITY), 10)


@query("score_table")
def _score_table(spark, d):
    frame = _frame(spark, d)
    scored = score.score_table(frame, _fit(frame, train.LOGISTIC).score, ENTITY)
    return scored.select(*SCORED_COLS, "is_train")


@query("model_store")
def _model_store(spark, d):
    """Save a fitted model, load it, and score the table with the loaded one."""
    frame = _frame(spark, d)
    path = work_path(spark, "models")
    model_store.save_models(spark, {train.TREE: _fit(frame, train.TREE)}, path)
    loaded = model_store.load_models(spark, path)[train.TREE]
    return score.score_table(frame, loaded.score, ENTITY).select("entity_id", "pred", "p0", "p1", "p2")


def _explained(spark, d, name, params, contributions):
    """Fit one model on all features, explain every entity's predicted class, and give the twelve largest contributions."""
    frame = _frame(spark, d)
    model = train.fit_model(name, frame.filter("split = 'train'"), ENTITY, available_features(frame, ENTITY.features), params)
    return explain.attribution(contributions(frame, model), model.features, "entity_id", top=12)


def _tree_parts(frame, model):
    return tree_explain.tree_contributions(frame, model, "entity_id")


@query("attribution")
def _attribution(spark, d):
    """Exact contributions of a decision tree at the library's settings for every entity."""
    return _explained(spark, d, train.TREE, None, _tree_parts)


@query("attribution_forest")
def _attribution_forest(spark, d):
    """Exact contributions of a forest of 20 trees of depth 8 for every entity."""
    return _explained(spark, d, train.FOREST, SMALL[train.FOREST], _tree_parts)


@query("attribution_logistic")
def _attribution_logistic(spark, d):
    """Kernel contributions over all coalitions for the logistic model at the library's settings, for every entity."""

    def parts(frame, model):
        return kernel_explain.kernel_contributions(frame, kernel_explain.softmax_model(model, spark), "entity_id")

    return _explained(spark, d, train.LOGISTIC, None, parts)


@query("attribution_sampled")
def _attribution_sampled(spark, d):
    """Contributions of a decision tree by two sampled feature orders and their reverses, which serves any scorer."""
    frame = _frame(spark, d)
    model = _fit(frame, train.TREE)
    background = {c: m for c, (m, _) in train.fit_scaler(frame.filter("split = 'train'"), model.features).items()}
    wide = explain.sampled_contributions(frame, model.score, model.features, background, "entity_id", pairs=2)
    return explain.attribution(wide, model.features, "entity_id", top=12)


@query("train_joint_boosted")
def _train_joint(spark, d):
    """Joint softmax boosting and one boosted model per class with the same settings, on the held-out rows."""
    frame = _frame(spark, d)
    features = available_features(frame, ENTITY.features)
    joint = boosting.fit_joint(frame.filter("split = 'train'"), ENTITY, features, SMALL[train.BOOSTED])
    apart = _fit(frame, train.BOOSTED)
    scored = train.holdout_scores(joint, frame, ENTITY).unionByName(train.holdout_scores(apart, frame, ENTITY))
    return evaluate.model_metrics(stage(scored, "holdout"))
