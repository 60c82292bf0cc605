"""Documents that hold passages of a benchmark, by fingerprints of item-sized windows.

Everything is a DataFrame or SQL expression. A window has as many words as an item. Its similarity to the item is that
of their weighted five-word shingles, the weight being how often a shingle occurs: shared weight over joint weight.
A window that shares no shingle with any item has similarity 0, so windows are laid only where a document has a
shingle of an item, at the start which that shingle implies.

1. A window and an item are each a SimHash of 64 bits over their weighted shingles.
2. The bits form ``radius + 1`` blocks. Two fingerprints within the radius agree in one block at least, so a join on
   (item length, block, value) finds every pair within the radius; the exact distance then drops the others.
3. The exact similarity of the weighted shingles verifies what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .tables import col, small


@dataclass(frozen=True)
class DecontaminationConfig:
    """A similarity of ``percent`` lies within ``radius`` bits of 64 but for about one window in a thousand at the very
    threshold, and far fewer above it."""

    words: int = 5
    percent: int = 80
    radius: int = 19


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; an empty array for null and for texts without any."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _shingles(array: str, size: int) -> str:
    """SQL for the hashes of all shingles of an array of words; a shorter array is one shingle, an empty one none."""
    parts = ", ".join(f"get({array}, i + {j})" for j in range(size))
    return f"if(size({array}) = 0, cast(array() as array<bigint>), transform(sequence(0, greatest(size({array}) - {size}, 0)), i -> xxhash64({parts})))"


def _simhash(hashes: str) -> str:
    """SQL for the SimHash of an array of 64-bit features: a bit is set where it is set in most of the weight."""
    votes = f"aggregate({hashes}, 0, (n, x) -> n + if((shiftright(x, j) & 1L) = 1L, 1, -1))"
    return f"aggregate(sequence(0, 63), 0L, (fp, j) -> fp | if({votes} > 0, shiftleft(1L, j), 0L))"


def _blocks(fp: str, radius: int) -> str:
    """SQL for (block, value) of the ``radius + 1`` blocks of the 64 bits, as equal in width as can be."""
    edges = [64 * b // (radius + 1) for b in range(radius + 2)]
    parts = (f"named_struct('block', {b}, 'value', shiftrightunsigned({fp}, {lo}) & {(1 << (hi - lo)) - 1}L)" for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)))
    return f"array({', '.join(parts)})"


def _shared(a: str, b: str) -> str:
    """SQL for the weight that two arrays of shingles share: the smaller of the two counts of each."""
    return f"aggregate(array_distinct({a}), 0, (n, x) -> n + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cfg: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """(th, tl, item_id, start, n_words, similarity): windows of texts, known by hash and length, that match an item."""
    items = benchmark.select(col(benchmark, item_col).alias("item_id"), words(col(benchmark, item_text_col)).alias("w"))
    items = items.withColumn("g", F.expr(_shingles("w", cfg.words))).where("size(w) > 0")
    items = stage(items.selectExpr("item_id", "size(w) as len", "g", f"{_simhash('g')} as fp"), "items")
    anchors = stage(items.selectExpr("len", "posexplode(g) as (at, h)").distinct(), "anchors")

    texts = docs.select(col(docs, text_col).alias("text")).selectExpr("text", "xxhash64(text) as th", "length(text) as tl").where("text is not null")
    worded = texts.withColumn("w", words(F.col("text"))).drop("text")
    placed = worded.selectExpr("th", "tl", "size(w) as n", f"posexplode({_shingles('w', cfg.words)}) as (pos, h)")
    starts = placed.join(small(anchors), "h").selectExpr("th", "tl", "len", "greatest(0, least(pos - at, n - len)) as start").distinct()
    starts = stage(starts, "windows")
    hit = stage(starts.select("th", "tl").distinct(), "hit")
    found = texts.join(small(hit), ["th", "tl"], "left_semi").dropDuplicates(["th", "tl"])
    windows = found.withColumn("w", words(F.col("text"))).select("th", "tl", "w").join(starts, ["th", "tl"])
    windows = windows.selectExpr("th", "tl", "start", "len", "slice(w, start + 1, len) as w")
    windows = windows.selectExpr("th", "tl", "start", "len", f"{_shingles('w', cfg.words)} as g")
    windows = stage(windows.withColumn("fp", F.expr(_simhash("g"))), "fingerprints")

    keyed = items.selectExpr("item_id", "len", "fp as item_fp", f"inline({_blocks('fp', cfg.radius)})")
    probes = windows.selectExpr("th", "tl", "start", "len", "fp", f"inline({_blocks('fp', cfg.radius)})")
    near = probes.join(small(stage(keyed, "blocks")), ["len", "block", "value"]).where(f"bit_count(fp ^ item_fp) <= {cfg.radius}")
    near = near.select("th", "tl", "start", "len", "item_id").distinct()
    both = near.join(windows.drop("fp"), ["th", "tl", "start", "len"]).join(small(items.selectExpr("item_id", "len", "g as item_g")), ["item_id", "len"])
    both = both.withColumn("shared", F.expr(_shared("g", "item_g"))).withColumn("joint", F.expr("size(g) + size(item_g) - shared"))
    both = both.where(f"100 * shared >= {cfg.percent} * joint")
    return both.selectExpr("th", "tl", "item_id", "start", "len as n_words", "shared / joint as similarity")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """``doc_id``, ``contaminated``, ``n_items``, ``item_ids`` (comma-joined, ascending) of every row of ``docs``.

    Null and wordless texts are clean, and so are all rows if the benchmark has no words. Equal texts are compared once
    and share the result. Items with equal texts all count. An item of fewer words than a shingle matches texts of
    just its words alone, never a passage of a longer text. Other columns are ignored. An empty table gives no rows.
    """
    found = matches(docs, benchmark, text_col, cfg=cfg)
    found = stage(found.groupBy("th", "tl").agg(F.array_sort(F.collect_set("item_id")).alias("items")), "contaminated")
    text = col(docs, text_col)
    rows = docs.select(col(docs, id_col).alias("doc_id"), F.xxhash64(text).alias("th"), F.length(text).alias("tl"))
    rows = rows.join(small(found), ["th", "tl"], "left")
    return rows.selectExpr("doc_id", "items is not null as contaminated", "cast(coalesce(size(items), 0) as bigint) as n_items", "coalesce(array_join(cast(items as array<string>), ','), '') as item_ids")
