"""As-of join: each event with the latest score of its entity at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import q


def asof_join(
    events: DataFrame,
    scores: DataFrame,
    key: str,
    ts: str,
    columns: Sequence[str],
    tie: str,
    buckets: int = 64,
    inner: bool = False,
) -> DataFrame:
    """``events`` with ``columns`` of the latest score of the same ``key`` whose ``ts`` is not later, and its ``score_ts``.

    Scores at the same time go by ``tie``, the largest last. Events without a match, key or time have nulls, or are left out
    if ``inner``. Both sides are put in one table and sorted by time inside buckets of equal width, ``buckets`` over
    the whole span, so an entity with most of the rows is split over as many tasks. The last score of each
    bucket, a row per entity and bucket, is carried into later buckets. No range is joined, nothing is broadcast by hint.
    """
    names = [q(c) for c in events.columns]
    timed = f"{q(key)} is not null and {q(ts)} is not null"
    score = f"struct({q(ts)} as score_ts, {q(tie)} as _tie, {', '.join(f'{q(c)} as _c{i}' for i, c in enumerate(columns))})"
    left = events.filter(timed).selectExpr(f"struct({', '.join(names)}) as _row", f"{q(key)} as _key", f"{q(ts)} as _ts", "1 as _side")
    right = scores.filter(timed).selectExpr(
        f"{score} as _score", f"{q(key)} as _key", f"{q(ts)} as _ts", "0 as _side"
    )
    rows = left.unionByName(right, allowMissingColumns=True)
    span = rows.selectExpr("struct(min(_ts) as lo, max(_ts) as hi) as s").scalar()
    micros = "(unix_micros({}) - unix_micros(_s.lo))"
    place = f"floor({micros.format('_ts')} * {buckets} / ({micros.format('_s.hi')} + 1))"
    rows = rows.withColumn("_s", span).withColumn("_bucket", F.expr(place)).drop("_s")

    last = rows.filter("_side = 0").groupBy("_key", "_bucket").agg(F.max("_score").alias("_last"))
    here = rows.filter("_side = 1").select("_key", "_bucket").distinct().withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType))
    carried = last.unionByName(here).groupBy("_key", "_bucket").agg(F.max("_last").alias("_last")).selectExpr(
        "_key as _carried_key", "_bucket as _carried_bucket",
        "last(_last, true) over (partition by _key order by _bucket rows between unbounded preceding and 1 preceding) as _carried",
    )
    upto = "last(_score, true) over (partition by _key, _bucket order by _ts, _side, _score rows between unbounded preceding and current row)"
    seen = rows.selectExpr("*", f"{upto} as _seen").filter("_side = 1")
    found = seen.join(carried, F.expr("_key = _carried_key and _bucket = _carried_bucket"), "left")
    found = found.selectExpr("_row.*", "coalesce(_seen, _carried) as _found")
    out = found.selectExpr(*names, "_found.score_ts", *[f"_found._c{i} as {q(c)}" for i, c in enumerate(columns)])
    return out.filter("score_ts is not null") if inner else out.unionByName(events.filter(f"not ({timed})"), allowMissingColumns=True)
