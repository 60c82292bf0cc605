"""Approximate nearest neighbours by inner product: an adaptive dimension scan within probed lists.

Distinct vectors are dealt to the lists of centroids learned on a sample. In a list, vectors are turned by one random
rotation and read in blocks of columns. After each block a hypothesis test on the partial distance (which
estimates the full one, as the rotation makes dimensions alike) abandons candidates that cannot beat the query's
current bound. An inner product above t means |q-x|^2 below |q|^2 + |x|^2 - 2t, so one test on distances serves vectors of any length.

The nearest lists of a query are scanned first and give its bound; the others follow with it. How many lists are
probed is measured: on a sample of queries, the true neighbours' places in the order of lists, over all vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .vectors import checked, list_column, matrix

KEY = ["k1", "k2"]
_HITS = "k1 bigint, k2 bigint, vec_id bigint, score double"


@dataclass(frozen=True)
class AnnConfig:
    """Bounds: ``sample`` vectors fit the centroids and ``probe_sample`` queries set the number of probes, so that a
    share ``coverage`` of their true neighbours lies in probed lists. ``significance`` is the width of the test in
    standard units. A task scans at most about ``rows_per_block`` vectors for ``queries_per_block`` queries."""

    neighbours: int = 20
    every: int = 20
    sample: int = 32_768
    probe_sample: int = 200
    most_lists: int = 4096
    coverage: float = 0.96
    first_share: float = 0.125
    significance: float = 2.1
    block_dims: int = 16
    rows_per_block: int = 2048
    queries_per_block: int = 2048
    seed: int = 3


# --- numpy inside tasks ---------------------------------------------------------------------------


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up in the order of dimensions, so equal vectors get equal bits."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j].astype(np.float64) * b[:, j]
    return total


def rotation(d: int, seed: int) -> np.ndarray:
    turned, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return turned * np.sign(np.diag(r))


def centroids(sample: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Plain k-means on the sample, in blocks of rows; empty lists keep their centroid."""
    c = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(sample, c)
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        c[used] = np.add.reduceat(sample[order], first) / np.diff(np.append(first, len(near)))[:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(axis=1)
    parts = [(x[at : at + 2048] @ c.T - half).argmax(axis=1) for at in range(0, len(x), 2048)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def lists_by_distance(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Lists of each query, nearest centroid first."""
    return np.argsort(0.5 * (c * c).sum(axis=1) - q @ c.T, axis=1, kind="stable")


def adaptive_scan(q: np.ndarray, x: np.ndarray, bound: np.ndarray, cfg: AnnConfig) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) of rotated rows that no test abandoned, for the products above each query's ``bound``.

    All queries of a slice go through a block of columns together; once few pairs remain, only these are read on.
    """
    d = q.shape[1]
    cuts = list(range(0, d, cfg.block_dims)) + [d]
    columns = [(np.ascontiguousarray(q[:, a:b]), np.ascontiguousarray(x[:, a:b])) for a, b in zip(cuts, cuts[1:])]
    limit = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)
    slack = 1e-9 * limit
    with np.errstate(invalid="ignore"):
        limit = limit - 2 * bound[:, None]
    alive, partial = None, None  # None: all pairs
    for (qb, xb), seen in zip(columns, cuts[1:]):
        if alive is None or len(alive[0]) * 4 > limit.size:
            grid = (qb * qb).sum(axis=1)[:, None] + (xb * xb).sum(axis=1) - 2 * (qb @ xb.T)
            step = grid if alive is None else grid[alive]
        else:
            gap = qb[alive[0]] - xb[alive[1]]
            step = np.einsum("ij,ij->i", gap, gap)
        partial = step if partial is None else partial + step
        reach = 1.0 if seen == d else (1 + cfg.significance / math.sqrt(seen)) ** 2 * seen / d
        most, spare = (limit, slack) if alive is None else (limit[alive], slack[alive])
        keep = partial <= reach * most + spare
        if alive is None:
            alive, partial = np.nonzero(keep), partial[keep]
        else:
            alive, partial = (alive[0][keep], alive[1][keep]), partial[keep]
    return alive


def scan_block(q: np.ndarray, bound: np.ndarray, x: np.ndarray, ids: pa.ListArray, turn: np.ndarray, cfg: AnnConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the best ``neighbours`` + 1 ids of each query in this block, by score and smaller id.

    Vectors come in slices; after each the bounds rise to the score of the last place so far.
    """
    k = cfg.neighbours + 1
    qr, xr = q @ turn, x @ turn
    at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    bound = bound.copy()
    for lo in range(0, len(x), 512):
        found = [best]
        for qlo in range(0, len(q), 512):
            i, j = adaptive_scan(qr[qlo : qlo + 512], xr[lo : lo + 512], bound[qlo : qlo + 512], cfg)
            for some in range(0, len(i), 16_384):
                a, b = i[some : some + 16_384] + qlo, j[some : some + 16_384] + lo
                score = exact_products(q[a], x[b])
                good = score >= bound[a]
                a, b, score = a[good], b[good], score[good]
                n = at[b + 1] - at[b]
                member = np.repeat(at[b] - np.cumsum(n) + n, n) + np.arange(n.sum())
                found.append(top(np.repeat(a, n), flat[member], np.repeat(score, n), k))
        best = top(*(np.concatenate(c) for c in zip(*found)), k)
        last = np.flatnonzero(np.bincount(best[0], minlength=len(q)) == k)
        bound[last] = np.maximum(bound[last], best[2][np.searchsorted(best[0], last, "right") - 1])
    return best


def top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each query by falling score and rising id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    new = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(new, np.diff(np.append(new, len(query))))
    return query[place < k], ids[place < k], score[place < k]


# --- tables -----------------------------------------------------------------------------------------


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``k1, k2, ids, vec``: each vector once, with its ``k`` smallest ids; no result can name a later one.

    Two 64-bit hashes stand for a vector. Ranks are cut in each task before rows of a vector meet.
    """
    once = rows.select(*KEY, "vec_id", "vec").distinct()
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("vec_id"))
    return once.withColumn("nth", nth).where(F.col("nth") <= k).groupBy(*KEY).agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vec").alias("vec")
    )


def _first_by_hash(rows: DataFrame, n: int, most: int, *columns: str) -> pa.Table:
    """At most ``most`` of the ``n`` rows in the order of their hashes; about twice as many are ranked."""
    steps = 1_000_000
    some = rows.where(F.pmod("k1", F.lit(steps)) < min(steps, 2 * most * steps // max(n, 1) + 1))
    return some.orderBy(F.pmod("k1", F.lit(steps)), *KEY).limit(most).select(*columns).toArrow()


def with_list(rows: DataFrame, c: np.ndarray, d: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = nearest(matrix(batch.column("vec"), d), c).astype(np.int32)
            yield batch.append_column("list", pa.array(place))

    return rows.mapInArrow(run, _schema(rows) + ", list int")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def probes_needed(listed: DataFrame, queries: pa.Table, c: np.ndarray, d: int, cfg: AnnConfig) -> int:
    """The number of lists that holds the share ``coverage`` of the true neighbours of the sampled queries."""
    q, own, k = matrix(queries.column("vec"), d), queries.column("k1").to_numpy(), cfg.neighbours
    place = np.empty((len(q), len(c)), np.int64)
    np.put_along_axis(place, lists_by_distance(q, c), np.arange(len(c))[None].repeat(len(q), 0), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                score = q @ matrix(part.column("vec"), d).T
                score[own[:, None] == part.column("k1").to_numpy()] = -np.inf
                some = np.argpartition(-score, min(k, score.shape[1]) - 1, axis=1)[:, :k]
                rank = np.take_along_axis(place[:, part.column("list").to_numpy()], some, 1)
                which = np.repeat(np.arange(len(q)), some.shape[1])
                new = (which, rank.ravel(), np.take_along_axis(score, some, 1).ravel())
                best = top(*(np.concatenate(x) for x in zip(best, new)), k)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["query", "place", "score"])

    near = listed.select("k1", "vec", "list").mapInArrow(run, "query bigint, place bigint, score double").where("score > double('-infinity')")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "place"))
    counts = near.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("place").count().collect()  # a row per list
    at = np.bincount([r["place"] for r in counts], [r["count"] for r in counts], minlength=len(c))
    return int(np.searchsorted(np.cumsum(at), cfg.coverage * at.sum() - 1e-9)) + 1


def with_probes(queries: DataFrame, c: np.ndarray, sizes: np.ndarray, probes: int, first: int, d: int, cfg: AnnConfig) -> DataFrame:
    """``queries`` with ``lists``, nearest first, and ``n_first``, the number of these scanned first.

    The first lists hold over ``neighbours`` vectors together, more lists being taken where needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                order = lists_by_distance(matrix(batch.column("vec"), d), c)
                enough = 1 + (np.cumsum(sizes[order], axis=1) <= cfg.neighbours).sum(axis=1)
                start = np.minimum(np.maximum(first, enough), len(c)).astype(np.int32)
                n = np.maximum(start, probes)
                taken = order[np.arange(len(c))[None] < n[:, None]].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(taken))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(start)], [*batch.schema.names, "lists", "n_first"])

    return queries.mapInArrow(run, _schema(queries) + ", lists array<int>, n_first int")


def scan(listed: DataFrame, asked: DataFrame, sizes: np.ndarray, d: int, cfg: AnnConfig) -> DataFrame:
    """Best ids of each query in its lists. ``asked`` is ``k1, k2, vec, bound, list``, a row per probed list.

    Large lists are cut in chunks of vectors and their queries in parts, by hash; each pair of chunk and part is a group.
    """
    turn = rotation(d, cfg.seed)
    many = asked.groupBy("list").count().collect()  # a row per list
    plan = [(r["list"], int(-(-sizes[r["list"]] // cfg.rows_per_block)), -(-r["count"] // cfg.queries_per_block)) for r in many if sizes[r["list"]]]
    plan = asked.sparkSession.createDataFrame(plan, "list int, chunks int, parts int")
    by_list = F.broadcast(plan)  # a row per list, at most most_lists
    spread = lambda n: F.pmod(F.xxhash64(*KEY), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = listed.join(by_list, "list").withColumn("chunk", spread("chunks")).withColumn("part", every("parts")).drop("chunks", "parts")
    asked = asked.join(by_list, "list").withColumn("part", spread("parts")).withColumn("chunk", every("chunks")).drop("chunks", "parts")

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids = vectors.column("ids").combine_chunks()
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        bound = queries.column("bound").to_numpy()
        who, vec_id, score = scan_block(matrix(queries.column("vec"), d), bound, matrix(vectors.column("vec"), d), ids, turn, cfg)
        return pa.table([queries.column("k1").to_numpy()[who], queries.column("k2").to_numpy()[who], vec_id, score], schema=schema)

    group = ["list", "chunk", "part"]
    left = rows.select(*group, "ids", "vec").groupBy(*group)
    right = asked.select(*group, *KEY, "vec", "bound").groupBy(*group)
    return left.cogroup(right).applyInArrow(run, _HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("nth", nth).where(F.col("nth") <= k)


def search(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cfg: AnnConfig = AnnConfig()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found of every query, a row whose id is divisible by ``every``.

    Nearest first by inner product in double precision, ties to the smaller id; a query's own id is no candidate.
    No part take rows without an id and vectors that are null, empty, zero, of another than the most
    frequent length, or hold a null or non-finite component. Rows repeated with the same id and vector count once; an id
    with several vectors is a row for each. Every query gets ``neighbours`` rows or, if there are
    fewer, all candidates. Empty tables and tables without a query give no rows.
    """
    k = cfg.neighbours
    rows, d = checked(df, {"vec_id": id_col}, vec_col, zero=False)
    rows = rows.where("vec_id is not null").withColumns({
        "vec_id": F.col("vec_id").cast("bigint"), "k1": F.xxhash64("vec"), "k2": F.xxhash64("vec", F.lit(cfg.seed))
    })
    vectors = stage(distinct_vectors(rows, k + 1), "ann_vectors")
    n = vectors.count()
    asking = rows.where(F.col("vec_id") % cfg.every == 0)
    queries = stage(asking.groupBy(*KEY).agg(F.first("vec").alias("vec")), "ann_queries")
    n_queries = queries.count()
    if not n_queries:
        return rows.where("false").selectExpr("vec_id as query_id", "1 as rank", "vec_id", "0D as score")
    sample = matrix(_first_by_hash(vectors, n, cfg.sample, "vec").column("vec"), d)
    n_lists = max(1, min(cfg.most_lists, math.isqrt(n) // 2, len(sample) // 2))
    c = centroids(sample, n_lists, np.random.default_rng(cfg.seed))
    listed = stage(with_list(vectors, c, d), "ann_lists")
    held = listed.groupBy("list").agg(F.sum(F.size("ids")).alias("ids"), F.count("*").alias("n")).collect()  # a row per list
    sizes, members = np.zeros(n_lists, np.int64), np.zeros(n_lists, np.int64)
    for r in held:
        sizes[r["list"]], members[r["list"]] = r["n"], r["ids"]
    probes = probes_needed(listed, _first_by_hash(queries, n_queries, cfg.probe_sample, "k1", "vec"), c, d, cfg)
    first = max(1, round(cfg.first_share * probes))
    asked = stage(with_probes(queries, c, members, probes, first, d, cfg), "ann_probes")
    near = asked.selectExpr(*KEY, "vec", "double('-infinity') as bound", "explode(slice(lists, 1, n_first)) as list")
    early = stage(_ranked(scan(listed, near, sizes, d, cfg), k + 1), "ann_first")
    bounds = early.where(F.col("nth") == k + 1).select(*KEY, F.col("score").alias("bound"))
    rest = asked.where("size(lists) > n_first").join(bounds, KEY, "left").selectExpr(
        *KEY, "vec", "coalesce(bound, double('-infinity')) as bound", "explode(slice(lists, n_first + 1, size(lists))) as list"
    )
    late = scan(listed, rest, sizes, d, cfg)
    hits = _ranked(early.drop("nth").unionByName(late), k + 1).groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found")
    )
    own = asking.select(F.col("vec_id").alias("query_id"), *KEY).distinct()
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.join(hits, KEY).select("query_id", F.posexplode(others).alias("place", "x")).selectExpr(
        "query_id", "place + 1 as rank", "x.vec_id as vec_id", "x.score as score"
    )
