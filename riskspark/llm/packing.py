"""Token-budget batches inside optimal length buckets.

A histogram of all document lengths goes to the driver; its size is bounded by its bins, not by the data. Dynamic
programming over the bins chooses the bucket limits with the least padding. Inside a bucket, documents follow a hash
order and fill batches of as many rows as the token budget holds at the bucket's length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .positions import positions
from .tables import col


@dataclass(frozen=True)
class PackingConfig:
    """Lengths up to ``exact`` have a bin each, longer ones a bin for each 1/``fineness`` of growth: at most about
    2,500 bins. A document longer than the budget has a batch of its own; nothing is cut."""

    buckets: int = 16
    token_budget: int = 16_384
    exact: int = 512
    fineness: int = 128


def word_count(text: Column) -> Column:
    """Tokens of the default vocabulary-free tokenizer: runs of non-space characters; none for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def limits(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket limits that minimise padding: the sum over documents of the limit of their bucket less their length.

    ``lengths`` ascend and hold the largest length of each bin; every limit is one of them, the last is the largest.
    """
    n = len(lengths)
    if n == 0:
        return []
    upto = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    cost = lengths * upto[1:]  # one bucket for the first bins
    cuts = []
    for _ in range(min(buckets, n) - 1):
        # One more bucket: bins i+1..j at the limit of bin j, behind the best use of the buckets before for bins 0..i.
        best, at = cost.copy(), np.full(n, -1)
        for j in range(1, n):
            choice = cost[:j] + lengths[j] * (upto[j + 1] - upto[1 : j + 1])
            i = int(choice.argmin())
            if choice[i] < best[j]:
                best[j], at[j] = choice[i], i
        cost = best
        cuts.append(at)
    chosen, j = [int(lengths[-1])], n - 1
    for at in reversed(cuts):
        if at[j] >= 0:
            j = int(at[j])
            chosen.append(int(lengths[j]))
    return sorted(chosen)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: PackingConfig = PackingConfig(), tokens: Column | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``bucket``, ``bucket_len``, ``batch``, ``slot``, ``n_padding`` of every row.

    ``tokens`` counts the tokens of a row; by default its words. Null and empty texts have no token and lie in the first
    bucket. Repeated rows and rows without an id are packed like others. Other columns are ignored. An empty table
    gives no rows.
    """
    n_tokens = (word_count(col(docs, text_col)) if tokens is None else tokens).cast("long")
    rows = docs.select(col(docs, id_col).alias("doc_id"), n_tokens.alias("n_tokens"))
    rows = stage(rows.withColumn("h", F.xxhash64("doc_id", F.lit(20))), "lengths")
    a_bin = F.expr(f"if(n_tokens <= {cfg.exact}, n_tokens, {cfg.exact} + cast(floor(ln(n_tokens / {cfg.exact}) * {cfg.fineness}) as bigint) + 1)")
    bins = rows.groupBy(a_bin.alias("bin")).agg(F.count("*").alias("n"), F.max("n_tokens").alias("most")).orderBy("bin").collect()
    chosen = limits(np.array([b.most for b in bins], np.float64), np.array([b.n for b in bins]), cfg.buckets) or [0]
    known = f"array({', '.join(f'{c}L' for c in chosen)})"
    rows = rows.withColumn("bucket", F.expr(f"size(filter({known}, c -> c < n_tokens))"))
    rows = rows.withColumn("bucket_len", F.expr(f"element_at({known}, bucket + 1)")).withColumn("one", F.lit(1))
    placed = stage(positions(rows, ["bucket", "h", "doc_id", "n_tokens"], "one", "bucketed").drop("before", "one", "h"), "packed")
    starts = {r.bucket: r for r in placed.groupBy("bucket").agg(F.min("pos").alias("first"), F.count("*").alias("n")).collect()}
    batch0, cases = 0, []
    for b in sorted(starts):
        room = max(1, cfg.token_budget // max(1, chosen[b]))
        cases.append(f"when {b} then named_struct('first', {starts[b].first}L, 'room', {room}L, 'batch0', {batch0}L)")
        batch0 += -(-starts[b].n // room)
    of_bucket = f"case bucket {' '.join(cases)} end" if cases else "named_struct('first', 0L, 'room', 1L, 'batch0', 0L)"
    return placed.withColumn("b", F.expr(of_bucket)).selectExpr(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_len",
        "b.batch0 + (pos - b.first) div b.room as batch",
        "cast((pos - b.first) % b.room as int) as slot",
        "bucket_len - n_tokens as n_padding",
    )
