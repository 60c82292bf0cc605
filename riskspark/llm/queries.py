"""The operators of this package as named queries over the given tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from . import (
    ann_search, decontamination, html_extract, language_id, minhash_dedup, packing, pii, quality_classifier, quality_rules, sharding, toxicity,
    vector_codes, whitening,
)
from .tables import read

# Words and distinct shingles of a document in SQL; `documents.text` may be null.
_WORDS_SQL = r"""
words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
shingled as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from words)"""


# --- near duplicates ------------------------------------------------------------------------------

_NEAR_DUPLICATES_SQL = f"""
with recursive {_WORDS_SQL},
posts as (select doc_id, len(s) as n, unnest(s) as g from shingled),
shared as (select a.doc_id as a, b.doc_id as b, a.n as an, b.n as bn, count(*) as i
  from posts a join posts b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from shared where 100 * i >= 85 * (an + bn - i)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id as x, doc_id as y from documents union select r.x, e.b from reach r join edges e on r.y = e.a),
roots as (select x, min(y) as component_id from reach group by x)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept
from shingled join roots on doc_id = x"""


@query("op1_minhash_near_dedup", _NEAR_DUPLICATES_SQL)
def _near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, d, "documents"))


# --- language ---------------------------------------------------------------------------------------


def held_out(parts: int, part: int) -> Column:
    """Rows that are kept from training, by the checksum of the id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % parts == part


@query("op5_language_id")
def _language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    net = language_id.fit(docs.where(~held_out(4, 2)))
    return language_id.identify(docs, net).withColumn("held_out", held_out(4, 2))


# --- benchmark passages -----------------------------------------------------------------------------

_PLAIN_SQL = r"""list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '),
    lambda x: x <> '')"""

_CONTAMINATION_SQL = f"""
with d as (select doc_id, {_PLAIN_SQL} as w from documents),
b as (select item_id, {_PLAIN_SQL} as w from benchmark),
dp as (select doc_id, len(w) as n, w, unnest(range(0, greatest(len(w) - 4, 1))) as pos from d where len(w) > 0),
bp as (select item_id, len(w) as l, w, unnest(range(0, greatest(len(w) - 4, 1))) as off from b where len(w) > 0),
ds as (select doc_id, n, pos, array_to_string(w[pos + 1:pos + 5], ' ') as g from dp),
bs as (select item_id, l, off, array_to_string(w[off + 1:off + 5], ' ') as g from bp),
windows as (select distinct doc_id, l, greatest(0, least(pos - off, n - l)) as start
  from ds join (select distinct l, off, g from bs) using (g)),
wp as (select doc_id, l, start, x.w[start + 1:start + l] as w from windows join d x using (doc_id)),
wu as (select doc_id, l, start, w, unnest(range(0, greatest(len(w) - 4, 1))) as pos from wp),
wc as (select doc_id, l, start, array_to_string(w[pos + 1:pos + 5], ' ') as g, count(*) as c from wu group by all),
ic as (select item_id, l, g, count(*) as c from bs group by all),
wn as (select doc_id, l, start, sum(c) as n from wc group by all),
xn as (select item_id, sum(c) as n from ic group by all),
met as (select doc_id, start, item_id, sum(least(wc.c, ic.c)) as i, any_value(wn.n) + any_value(xn.n) as t
  from wc join ic using (l, g) join wn using (doc_id, l, start) join xn using (item_id) group by doc_id, l, start, item_id),
found as (select distinct doc_id, item_id from met where 100 * i >= 80 * (t - i))
select doc_id, count(item_id) > 0 as contaminated, count(item_id) as n_items,
  coalesce(string_agg(cast(item_id as varchar), ',' order by item_id), '') as item_ids
from documents left join found using (doc_id) group by doc_id"""


@query("op8_benchmark_decontamination", _CONTAMINATION_SQL)
def _contamination(spark: SparkSession, d: str) -> DataFrame:
    return decontamination.contamination(read(spark, d, "documents"), read(spark, d, "benchmark"))


# --- packing and shards -----------------------------------------------------------------------------


@query("op3_packing")
def _packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"))


@query("op10_sharding")
def _sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shards(read(spark, d, "documents"))


# --- personal data ----------------------------------------------------------------------------------


@query("op6_pii")
def _pii(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return pii.personal_data(docs, pii.fit(docs))


# --- learned scores ---------------------------------------------------------------------------------


@query("op2_toxicity")
def _toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    model = toxicity.fit(docs, labels.where(~held_out(3, 1)))
    return toxicity.scores(docs, model).withColumn("held_out", held_out(3, 1))


@query("op9_quality_classifier")
def _quality(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    model = quality_classifier.fit(docs, labels.where(~held_out(4, 2)))
    return quality_classifier.scores(docs, model).withColumn("held_out", held_out(4, 2))


# --- quality rules and pages ------------------------------------------------------------------------


@query("op4_quality_rules")
def _quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, d, "documents"))


@query("op7_html_extraction")
def _html(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract(read(spark, d, "pages"))


# --- embeddings -------------------------------------------------------------------------------------


@query("op11_ann_search")
def _ann_search(spark: SparkSession, d: str) -> DataFrame:
    return ann_search.search(read(spark, d, "embeddings"))


@query("op12_embedding_whitening")
def _whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(read(spark, d, "embeddings"))


def _codes_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """The rounds written out one after the other, each a full scan of every codebook."""
    steps = [f"""kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as x from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
numbered as (select row_number() over (order by vec_id nulls last, x) as r, * from kept),
cut as (select r, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] as v from numbered, (select unnest(range(0, {parts})) as p)),
book0 as (select p, r - 1 as e, v from cut where r <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""near{i} as (
  select r, p, v, arg_min(e, (d, e)) as e, min(d) as d from (
    select r, c.p as p, c.v as v, e, list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
    from cut c join book{i} b on c.p = b.p) group by r, p, v)""")
        if i < rounds:
            steps.append(f"""mean{i} as (
  select p, e, list(m order by j) as v from (
    select p, e, j, cast(floor(cast(sum(v[j]) as double) / count(*)) as bigint) as m from near{i}, (select unnest(range(1, (select max(len(v)) from cut) + 1)) as j) group by p, e, j) group by p, e),
book{i + 1} as (select p, e, coalesce(m.v, b.v) as v from book{i} b left join mean{i} m using (p, e))""")
    return "with " + ",\n".join(steps) + f""",
flat as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds}),
done as (select r, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from near{rounds} group by r)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from done join numbered using (r), flat"""


@query("op13_vector_codes", _codes_sql())
def _vector_codes(spark: SparkSession, d: str) -> DataFrame:
    return vector_codes.compress(read(spark, d, "embeddings"))
