"""Contiguous shards of equal bytes from global prefix sums.

Documents are ordered by a hash of their text and then by id, so equal texts lie side by side. The bytes before a
document come from totals of partitions. Shards are cut at equal targets of that sum; a cut that would split a
group of equal texts moves to the nearer end of the group if the group is small against a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .positions import positions
from .tables import col

GROUP_SHARE = 0.01
"""A group of equal texts is kept in one shard if it holds at most this share of a shard's bytes."""


def shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` of every row.

    Size is the UTF-8 bytes of the text plus 1, so null and empty texts weigh 1 and count as equal texts. The law is
    ``bytes``: a shard differs from an equal part by one document, or by ``GROUP_SHARE`` where a group stays whole.
    Repeated rows and rows without an id are placed like others. Other columns are ignored. An empty table gives no rows.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = F.coalesce(col(docs, text_col), F.lit(""))
    rows = docs.select(
        col(docs, id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    placed = stage(positions(rows, ["h", "text_crc32", "size", "doc_id"], "size", "ranges"), "placed")
    total = placed.agg(F.sum("size")).first()[0] or 0
    cuts = _whole_groups(placed, [-(-total * j // n_shards) for j in range(1, n_shards)], total / n_shards * GROUP_SHARE)
    inner = f"array({', '.join(f'{c}L' for c in cuts)})" if cuts else "cast(array() as array<bigint>)"
    dealt = stage(placed.withColumn("shard", F.expr(f"size(filter({inner}, c -> c <= before))")), "dealt")
    first = dealt.groupBy("shard").agg(F.min("pos").alias("first"))  # a row for each shard
    return dealt.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("pos") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _whole_groups(placed: DataFrame, cuts: list[int], most: float) -> list[int]:
    """Cuts moved to an end of the group of equal texts that holds them, if that group has at most ``most`` bytes."""
    if not cuts:
        return cuts
    inside = " or ".join(f"(before < {c} and {c} < before + size)" for c in cuts)
    met = " or ".join(f"(before <= {c} and {c} <= before + size)" for c in cuts)
    key = ["h", "text_crc32", "size"]
    groups = placed.where(f"{inside} or {met}").select(*key).distinct()  # two for each cut at most, but for empty sizes
    spans = placed.join(F.broadcast(groups), key).groupBy(*key).agg(F.min("before").alias("lo"), F.expr("max(before + size)").alias("hi"))
    ends = [(r.lo, r.hi) for r in spans.where(F.col("hi") - F.col("lo") <= most).collect()]
    moved = []
    for c in cuts:
        lo, hi = next(((lo, hi) for lo, hi in ends if lo < c < hi), (c, c))
        moved.append(lo if c - lo <= hi - c else hi)
    return moved
