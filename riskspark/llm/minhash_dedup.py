"""Near-duplicate documents from bottom-k sketches.

Every document is the set of its distinct word shingles. One hash function orders all shingles; a document's
sketch is its ``sketch_size`` smallest hashes, so the sketch of a union is the smallest part of two merged sketches.

1. Documents with equal sets fall into one class by a fingerprint of the set; one id stands for the class.
2. Inverted lists of retained values find the documents that can have a partner. Two linked sketches share at
   least ``floor`` values, so it is enough to list the ``size - floor + 1`` values of a sketch that the fewest
   documents retain: a passage that many documents share is listed only where it fills most of one.
3. Documents that meet in such a list are sketched again with every value retained, and listed under the
   values that a link cannot avoid: the rarest ``n - percent of n + 1``. The place of a value in that order bounds
   the overlap of two members of a list from above, which drops most members of the lists of common values.
4. Lists are compared in rounds. A round takes a few heads of each list, those nearest to the common core
   first, and pairs them with its other members. Members that one component joins already need no pairing with
   each other, so a group of n near copies costs about n pairs. Heads per list grow by a factor each round
   until no list spans two components. No list is capped. Components are joined up anew only after a round that
   found a link, from its links and the components before it.
5. A pair survives if the union sketch estimates a similarity above the floor, and is a link if the full sets
   have it exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.staging import stage
from .tables import col, components, small
from .text import distinct, lists, mix, shingles, slices, split_words


@dataclass(frozen=True)
class NearDupConfig:
    """A pair is a link when ``100 * |A and B| >= percent * |A or B|``.

    ``floor_percent`` of a full sketch is the least overlap of two linked sketches and the least estimate that
    passes; it lies five standard deviations of a ``sketch_size`` sample below ``percent``, so a link fails it with
    a probability below 1e-6. Sets no larger than the sketch are compared whole.
    """

    words: int = 5
    percent: int = 85
    sketch_size: int = 64
    floor_percent: int = 62
    heads_factor: int = 16


SKETCH_SCHEMA = "doc_id long, n_shingles long, f1 long, f2 long, sketch array<long>"


def _sketches(cfg: NearDupConfig, full: bool):
    """Per row: set size, two sums that identify the set, and its smallest hashes (all of them if ``full``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in slices(texts):
                words = split_words(data, offsets, lower=True)
                row, h = distinct(*shingles(words, cfg.words))
                n = np.bincount(row, minlength=hi - lo)
                first = np.concatenate([[0], np.cumsum(n)])
                u = h.view(np.uint64)
                sums = []
                for salt in (0x51, 0xA7):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(u + np.uint64(salt)))])
                    sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                kept = slice(None) if full else np.arange(len(h)) - first[row] < cfg.sketch_size
                size = n if full else np.minimum(n, cfg.sketch_size)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), lists(h[kept], size, pa.int64())],
                    names=["doc_id", "n_shingles", "f1", "f2", "sketch"],
                )

    return run


def estimate(a: str, b: str, k: int) -> str:
    """SQL for the share of the smallest ``k`` values of the union that both sketches hold."""
    union = f"slice(array_sort(array_union({a}, {b})), 1, {k})"
    return f"size(array_intersect({union}, array_intersect({a}, {b}))) / size({union})"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest linked id), ``kept``.

    Null, empty and blank texts have no shingles and are linked with nothing. Repeated rows of an id are one node
    whose links are those of any of its texts. A row without an id stands alone: null component, kept.
    Other columns are ignored. An empty table gives no rows. Shingles are compared by 64-bit hashes.
    """
    k = cfg.sketch_size
    texts = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text"))
    rows = stage(texts.mapInArrow(_sketches(cfg, False), SKETCH_SCHEMA), "sketches")
    narrow = rows.select("doc_id", "n_shingles", "f1", "f2").where("doc_id is not null and n_shingles > 0")
    key = ["n_shingles", "f1", "f2"]
    classes = stage(narrow.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")), "classes")
    copies = narrow.join(classes.where("rep < most"), key).where("doc_id <> rep").selectExpr("doc_id as a", "rep as b").distinct()

    # One sketch per class, from the row of its representative.
    sketches = rows.join(classes.withColumnRenamed("rep", "doc_id").drop("most"), ["doc_id", *key], "left_semi")
    listed = stage(_listed(sketches.dropDuplicates(["doc_id", *key]), cfg), "listed")
    full = texts.join(small(listed), F.col("doc_id") == F.col("doc"), "left_semi").mapInArrow(_sketches(cfg, True), SKETCH_SCHEMA)
    full = full.withColumnRenamed("sketch", "hashes").dropDuplicates(["doc_id", *key])
    sets = stage(full.selectExpr("doc_id", "n_shingles", f"slice(hashes, 1, {k}) as sketch", "hashes"), "sets")

    # Lists are read several times, so each state of them is written: they are ranked once, and plans stay small for the driver.
    roots, heads, lists_ = None, 1, stage(_lists(sets, cfg), "lists")
    while True:
        lists_ = _open_lists(lists_, cfg)
        if lists_.isEmpty():
            break
        chosen = _heads(lists_, heads)
        pairs = stage(_pairs(lists_, chosen, cfg), "pairs")
        links = None if pairs.isEmpty() else stage(_linked(pairs, sets, cfg), "links")
        lists_ = lists_.join(chosen.selectExpr("v", "head as doc"), ["v", "doc"], "left_anti").drop("lead")
        if links is not None and not links.isEmpty():
            # Links of this round join components of the last one, so those stand for the links of all rounds before.
            roots = components(links if roots is None else links.unionByName(roots.selectExpr("node as a", "root as b")), "roots")
            lists_ = lists_.drop("comp").join(roots, F.col("doc") == F.col("node"), "left")
            lists_ = lists_.select("v", "doc", "n", "nth", F.coalesce("root", "doc").alias("comp"))
        lists_ = stage(lists_, "lists")
        heads *= cfg.heads_factor

    roots = components(copies if roots is None else copies.unionByName(roots.selectExpr("node as a", "root as b")), "members")
    out = rows.select("doc_id", "n_shingles").join(roots, F.col("doc_id") == F.col("node"), "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("root", "doc_id").alias("component_id"),
        F.expr("doc_id is null or doc_id = coalesce(root, doc_id)").alias("kept"),
    )


def _rarest(posts: DataFrame, places: str) -> DataFrame:
    """Of (doc, n, v): the first ``places`` values of each document in the order of rarity, with their place.

    A value of one document takes its place in the order and makes no list, so it is only counted.
    """
    shared = posts.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    by_doc = Window.partitionBy("doc", "n")
    posts = posts.join(shared, "v").withColumn("own", F.count("*").over(by_doc))
    posts = posts.withColumn("nth", F.row_number().over(by_doc.orderBy("df", "v")))
    return posts.withColumn("nth", F.expr("size - own + nth")).where(f"nth <= {places}").select("v", "doc", "n", "nth")


def _listed(sketches: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """Distinct ids that share one of their rarest retained values with another document."""
    posts = sketches.selectExpr("doc_id as doc", "n_shingles as n", "size(sketch) as size", "explode(sketch) as v")
    # A set smaller than the sketch may meet a truncated one: five points below the wanted overlap cover that.
    floor = f"case when n > {cfg.sketch_size} then {cfg.floor_percent} else {cfg.percent - 5} end"
    index = stage(_rarest(posts, f"size - ceil(size * ({floor}) / 100) + 1").select("v", "doc"), "index")
    met = index.groupBy("v").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("v")
    return index.join(met, "v").select("doc").distinct()


def _lists(sets: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(v, doc, n, nth, comp) over full sets: a link of two documents shares one of these values."""
    posts = sets.selectExpr("doc_id as doc", "n_shingles as n", "size(hashes) as size", "explode(hashes) as v")
    return _rarest(posts, f"size - ceil(size * {cfg.percent} / 100) + 1").distinct().withColumn("comp", F.col("doc"))


def _open_lists(lists_: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """Lists that span two components, without the members that no other member can be linked with.

    If the first value that two sets share has the places i and j, they share at most ``1 + min(n - i, m - j)``
    values, and a link shares ``percent / (100 + percent) * (n + m)``. So the smaller set has the value early
    (``lead``), and a place bounds the size of a partner from above (``most``).
    """
    p = cfg.percent
    rows = lists_.withColumn("most", F.expr(f"floor((1 + n - nth) * {100 + p} / {p}) - n")).withColumn("lead", F.expr("most >= n"))
    spans = rows.groupBy("v").agg(
        F.min("comp").alias("lo"),
        F.max("comp").alias("hi"),
        F.min(F.expr("if(lead, n, null)")).alias("lead_from"),
        F.max(F.expr("if(lead, n, null)")).alias("lead_to"),
    )
    rows = rows.join(spans.where("lo < hi and lead_from is not null"), "v")
    rows = rows.where(f"lead or (most >= lead_from and 100 * lead_to >= {p} * n)")
    spans = rows.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("v")
    return stage(rows.select("v", "doc", "n", "nth", "comp", "lead").join(spans, "v"), "open")


def _heads(lists_: DataFrame, count: int) -> DataFrame:
    """(v, head, head_n, head_nth, head_comp): the ``count`` leading members of each list with the earliest place."""
    as_head = "named_struct('head_nth', nth, 'head', doc, 'head_n', n, 'head_comp', comp)"
    leading = lists_.where("lead")
    if count == 1:
        return leading.groupBy("v").agg(F.min(F.expr(as_head)).alias("h")).select("v", "h.*")
    first = ("nth", "doc")
    salted = Window.partitionBy("v", F.pmod(F.xxhash64("doc"), F.lit(64))).orderBy(*first)
    top = leading.withColumn("rank", F.row_number().over(salted)).where(f"rank <= {count}")
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy(*first))).where(f"rank <= {count}")
    return top.select("v", F.expr(as_head).alias("h")).select("v", "h.*")


def _pairs(lists_: DataFrame, chosen: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """Distinct (a, b), a < b, of a head and a member of its list in another component that can be linked."""
    p = cfg.percent
    met = lists_.join(chosen, "v").where(
        f"doc <> head and comp <> head_comp and 100 * least(n, head_n) >= {p} * greatest(n, head_n)"
        f" and {100 + p} * (1 + least(n - nth, head_n - head_nth)) >= {p} * (n + head_n)"
    )
    return met.selectExpr("least(head, doc) as a", "greatest(head, doc) as b").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """Pairs whose union sketch passes, confirmed on the full sets."""

    def with_sides(p: DataFrame, what: str) -> DataFrame:
        for side in ("a", "b"):
            p = p.join(sets.selectExpr(f"doc_id as {side}", f"{what} as {side}_{what}", f"n_shingles as {side}_n"), side)
        return p

    near = with_sides(pairs, "sketch").where(f"100 * {estimate('a_sketch', 'b_sketch', cfg.sketch_size)} >= {cfg.floor_percent}")
    near = near.select("a", "b").distinct()
    both = with_sides(near, "hashes").withColumn("shared", F.expr("size(array_intersect(a_hashes, b_hashes))"))
    return both.where(f"100 * shared >= {cfg.percent} * (a_n + b_n - shared)").select("a", "b").distinct()
