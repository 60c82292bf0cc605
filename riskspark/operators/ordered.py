"""Exact order statistics without sorting everything in one task.

The shared idea: collapse rows to distinct values with counts (a map-side combined aggregate, so one hot
value costs one row per map task), cut the value range into order-preserving buckets, prefix-sum the
small table of bucket totals, and only then run a window inside each bucket. No window ever covers a
whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean, q, stack, text

EDGES = 64  # a power of two
CELLS_PER_EDGE = 32


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., feature, value)`` with missing values left out."""
    pairs = stack([(text(c), clean(c)) for c in columns], ("feature", "value"))
    return df.selectExpr(*[q(c) for c in keep], pairs).filter("value is not null")


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., feature, value, n)``: how often each non-null value of each column occurs."""
    return long_values(df, columns, by).groupBy(*by, "feature", "value").agg(F.expr("count(1) as n"))


def _with_bucket(df: DataFrame, value: str) -> DataFrame:
    """Add ``_bucket``, non-decreasing in ``value``: the slot between approximate quantiles, split evenly inside.

    The slot (number of edges not above the value) is found by halving; each step is one small projection,
    which keeps the search compiled instead of running a lambda over all edges for each row.
    """
    v, last = q(value), CELLS_PER_EDGE - 1
    out, step = df.selectExpr("*", "0 as _slot"), EDGES
    while step:
        kept = [q(c) for c in out.columns if c != "_slot"]
        out = out.selectExpr(*kept, f"_slot + if(get(_edges, _slot + {step - 1}) <= {v}, {step}, 0) as _slot")
        step //= 2
    bounded = out.selectExpr("*", "get(_edges, _slot - 1) as _lo", "get(_edges, _slot) as _hi")
    inside = f"floor(({v} - _lo) / nullif(_hi - _lo, 0D) * {CELLS_PER_EDGE})"
    cell = f"least(greatest(coalesce({inside}, 0), 0), {last})"
    return bounded.selectExpr("*", f"cast(_slot as bigint) * {CELLS_PER_EDGE} + {cell} as _bucket").drop(
        "_edges", "_slot", "_lo", "_hi"
    )


def running_totals(
    df: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str], only: str | None = None
) -> DataFrame:
    """Add ``before_<m>`` (total over strictly smaller values of the same keys) and ``total_<m>``.

    ``df`` holds one row per (keys, value). Keys must be few by configuration (features, classes, models):
    the edge and bucket tables are broadcast and hold at most ``(EDGES + 2) * CELLS_PER_EDGE`` rows per key
    combination, whatever the number of values.

    ``only`` is an optional condition on whole buckets, over ``_off_<m>`` (total before the bucket),
    ``_size_<m>`` and ``total_<m>``; values of other buckets are dropped before anything is sorted.
    """
    names = [q(k) for k in keys]
    # Keeping the measures alive lets this branch reuse the exchange that produced df.
    alive = df.filter(f"{' + '.join(q(m) for m in measures)} >= 0")
    fractions = ", ".join(repr(i / EDGES) for i in range(EDGES + 1))
    edges = alive.groupBy(*keys).agg(
        F.expr(f"percentile_approx({q(value)}, array({fractions}), {20 * EDGES}) as _edges")
    )
    bucketed = _with_bucket(df.join(F.broadcast(edges), list(keys)), value)
    totals = bucketed.groupBy(*keys, "_bucket").agg(*[F.expr(f"sum({q(m)}) as {q('_' + m)}") for m in measures])
    whole = f"partition by {', '.join(names)}"
    earlier = "rows between unbounded preceding and 1 preceding"
    offsets = totals.selectExpr(
        *names,
        "_bucket",
        *[f"coalesce(sum({q('_' + m)}) over ({whole} order by _bucket {earlier}), 0) as {q('_off_' + m)}" for m in measures],
        *[f"sum({q('_' + m)}) over ({whole}) as {q('total_' + m)}" for m in measures],
        *[f"{q('_' + m)} as {q('_size_' + m)}" for m in measures],
    )
    if only is not None:
        offsets = offsets.filter(only)
    within = f"partition by {', '.join(names)}, _bucket order by {q(value)} {earlier}"
    return bucketed.join(F.broadcast(offsets), [*keys, "_bucket"]).selectExpr(
        *[q(c) for c in df.columns],
        *[f"{q('_off_' + m)} + coalesce(sum({q(m)}) over ({within}), 0) as {q('before_' + m)}" for m in measures],
        *[q("total_" + m) for m in measures],
    )


def quantile_name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated quantiles, one row per ``(by..., feature)`` with columns ``p25, p50, ...``.

    Exact for any number of distinct values. ``percentile`` would build one value -> count map per group
    in a single task instead.
    """
    keys = [*by, "feature"]
    ranks = [f"{fn}({float(p)!r}D * (total_n - 1))" for p in probs for fn in ("floor", "ceil")]
    holds_rank = " or ".join(f"(_off_n <= {r} and {r} < _off_n + _size_n)" for r in ranks)
    ranked = running_totals(value_counts(df, columns, by), keys, "value", ["n"], holds_rank)

    def at(rank: str) -> str:
        return f"max(case when before_n <= {rank} and {rank} < before_n + n then value end)"

    aggs, out = ["max(total_n) as n_values"], []
    for p in probs:
        name = quantile_name(p)
        position = f"{float(p)!r}D * (total_n - 1)"
        aggs += [f"{at(f'floor({position})')} as _lo_{name}", f"{at(f'ceil({position})')} as _hi_{name}"]
        position = f"{float(p)!r}D * (n_values - 1)"
        out.append(f"_lo_{name} + (_hi_{name} - _lo_{name}) * ({position} - floor({position})) as {name}")
    picked = ranked.groupBy(*keys).agg(*[F.expr(a) for a in aggs])
    return picked.selectExpr(*[q(k) for k in keys], "n_values", *out)


def keyed_rows(df: DataFrame, by: str, key_sql: str, tie: str, prefix_digits: int = 4) -> DataFrame:
    """``(by, key, tie, _prefix)`` for a hex sort key."""
    g, t = q(by), q(tie)
    return df.selectExpr(g, f"{key_sql} as _key", t).selectExpr(
        g, "_key", t, f"substring(_key, 1, {prefix_digits}) as _prefix"
    )


def prefix_counts(keyed: DataFrame, by: str) -> DataFrame:
    """Rows per group and key prefix: at most 16^digits rows per group."""
    return keyed.groupBy(by, "_prefix").agg(F.expr("count(1) as _n"))


def rank_cuts(keyed: DataFrame, by: str, tie: str, ranks: DataFrame) -> DataFrame:
    """Rows sitting at given 1-based ranks of the key inside each group.

    ``ranks`` is ``(by, chunk, rank)`` and small. Counting per key prefix finds the prefix that holds each
    wanted rank; only rows of those prefixes are ranked. The result is ``(by, chunk, cut)`` where ``cut``
    is a comparable struct of key and tie-breaker.
    """
    g, t = q(by), q(tie)
    offsets = prefix_counts(keyed, by).selectExpr(
        g, "_prefix", "_n",
        f"coalesce(sum(_n) over (partition by {g} order by _prefix rows between unbounded preceding and 1 preceding), 0) as _before",
    )
    # ranks: groups x chunks rows, fixed by the caller's class and fold counts.
    hits = offsets.join(F.broadcast(ranks), by).filter("_before < rank and rank <= _before + _n")
    wanted = hits.groupBy(by, "_prefix", "_before").agg(
        F.expr("collect_list(struct(rank, chunk)) as _wanted")
    )
    return (
        keyed.join(F.broadcast(wanted), [by, "_prefix"])
        .selectExpr(
            g, "_key", t, "_wanted",
            f"row_number() over (partition by {g}, _prefix order by _key, {t}) + _before as _rank",
        )
        .selectExpr(g, "_key", t, "_rank", "explode(_wanted) as _w")
        .filter("_rank = _w.rank")
        .selectExpr(g, "_w.chunk as chunk", f"struct(_key, {t}) as cut")
    )
