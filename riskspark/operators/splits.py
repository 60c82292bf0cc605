"""Stratified train/test split, stratified folds and class weights, with exact quotas.

Membership follows a seeded hash order of the key, so it does not depend on partitioning. Each class is cut
into chunks at given ranks; the rows at the cuts are found once (``rank_cuts``), and every other row only
compares its own hash with a handful of cut values. Assigning a split is therefore map-only, after one narrow
pass for counts and one for the cut rows.

``source`` may name a cheaper frame with the same keys and labels to find the cuts on; giving the split and
the folds the same source lets them share the counting pass. ``materialise`` may store the table of cuts (one
row per class), so that later passes over the result do not find them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions import hash_order_key, q
from .ordered import keyed_rows, prefix_counts, rank_cuts


def _keyed(df: DataFrame, cfg: RiskConfig, seed: int) -> DataFrame:
    return keyed_rows(df, cfg.label_col, hash_order_key(cfg.id_col, seed), cfg.id_col)


def _class_sizes(keyed: DataFrame, cfg: RiskConfig) -> DataFrame:
    return prefix_counts(keyed, cfg.label_col).groupBy(cfg.label_col).agg(F.expr("sum(_n) as n"))


Materialise = Callable[[DataFrame], DataFrame]


def _assign_chunks(
    df: DataFrame,
    keyed: DataFrame,
    cfg: RiskConfig,
    ranks: DataFrame,
    seed: int,
    name: str,
    materialise: Materialise | None,
) -> DataFrame:
    """Chunk 0 holds ranks 1..rank(0), chunk 1 the next ones, and so on; the last chunk is open."""
    label, key_id = cfg.label_col, cfg.id_col
    cuts = rank_cuts(keyed, label, key_id, ranks.filter("rank > 0"))
    # One row per class, one array entry per chunk: bounded by the class and fold counts.
    per_class = cuts.groupBy(label).agg(F.expr("collect_list(cut) as _cuts"))
    empty = ranks.groupBy(label).agg(F.expr("count_if(rank <= 0) as _empty"))
    table = empty.join(F.broadcast(per_class), label, "left")
    if materialise is not None:
        table = materialise(table)
    passed = f"size(filter(_cuts, c -> c < struct({hash_order_key(key_id, seed)}, {q(key_id)})))"
    return df.join(F.broadcast(table), label).selectExpr(
        *[q(c) for c in df.columns], f"cast(_empty as int) + coalesce({passed}, 0) as {q(name)}"
    )


def stratified_split(
    df: DataFrame,
    cfg: RiskConfig,
    test_fraction: float = 0.2,
    seed: int = 42,
    source: DataFrame | None = None,
    materialise: Materialise | None = None,
) -> DataFrame:
    """Add ``split``. The test set has ceil(fraction * n) rows, shared out by largest remainder."""
    label = q(cfg.label_col)
    keyed = _keyed(df if source is None else source, cfg, seed)
    # Windows over the class table: one row per class.
    shares = _class_sizes(keyed, cfg).selectExpr(
        label, "n", "sum(n) over () as _total", f"cast(ceil({test_fraction!r}D * sum(n) over ()) as bigint) as _test"
    ).selectExpr(label, "_test", "(_test * n) div _total as _base", "(_test * n) % _total as _rest")
    ranks = shares.selectExpr(
        label,
        "0 as chunk",
        f"_base + if(row_number() over (order by _rest desc, {label}) <= _test - sum(_base) over (), 1, 0) as rank",
    )
    chunked = _assign_chunks(df, keyed, cfg, ranks, seed, "_chunk", materialise)
    return chunked.selectExpr(*[q(c) for c in df.columns], "if(_chunk = 0, 'test', 'train') as split")


def stratified_folds(
    df: DataFrame,
    cfg: RiskConfig,
    k: int = 5,
    seed: int = 42,
    source: DataFrame | None = None,
    materialise: Materialise | None = None,
) -> DataFrame:
    """Add ``fold`` in 0..k-1.

    Fold sizes per class are those of dealing the class-sorted rows out in turn, so sizes differ by at most
    one both per class and overall.
    """
    label = q(cfg.label_col)
    keyed = _keyed(df if source is None else source, cfg, seed)
    placed = _class_sizes(keyed, cfg).selectExpr(
        label, "n",
        f"coalesce(sum(n) over (order by {label} rows between unbounded preceding and 1 preceding), 0) as _start",
    ).selectExpr("*", f"explode(sequence(0, {k - 1})) as chunk")
    # Positions start..start+n-1 with position % k = chunk.
    quota = f"((_start + n - chunk + {k - 1}) div {k}) - ((_start - chunk + {k - 1}) div {k})"
    ranks = placed.selectExpr(
        label, "chunk", f"sum({quota}) over (partition by {label} order by chunk) as rank"
    ).filter(f"chunk < {k - 1}")
    return _assign_chunks(df, keyed, cfg, ranks, seed, "fold", materialise)


def balanced_weights(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Add ``weight`` = rows / (classes * rows of the class)."""
    sizes = df.groupBy(cfg.label_col).agg(F.expr("count(1) as n"))
    weights = sizes.selectExpr(q(cfg.label_col), "sum(n) over () / (count(1) over () * n) as weight")
    return df.join(F.broadcast(weights), cfg.label_col)  # one row per class
