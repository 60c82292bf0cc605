"""Profiles that merge: per-partition sketches of quantiles and distinct counts, updated without a rescan.

Quantiles come from counts per logarithmic bucket: a value x falls in bucket ceil(log_g |x|) of its sign, so every
value of a bucket is within a relative error of the bucket's middle, whatever the data. Counts add up, so
merging in any order gives the same profile. Distinct counts keep the least hash per register, so merging is a minimum; the
estimate of HyperLogLog (in the form of Ertl, 2017, which needs no correction by size) is taken from whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import q
from .ordered import long_values, quantile_name

ERROR = 0.001
"""Relative error of a quantile, by default."""

LEAST = 1e-9
"""Values nearer to zero share the bucket of zero."""

LOG2_REGISTERS = 14
"""Registers per partition and column. Distinct counts have a relative standard error of about 0.8 %."""


def _growth(error: float) -> float:
    return math.log((1 + error) / (1 - error))


def quantile_cells(df: DataFrame, columns: Sequence[str], part: str, error: float = ERROR) -> DataFrame:
    """``(part, feature, sign, bucket, n)``: values per logarithmic bucket of each partition and column. Missing values are left out.

    Buckets number about ``ln(largest / smallest) / (2 error)`` per column and sign; a bucket costs a row per task.
    """
    side = f"case when value > {LEAST!r}D then 1 when value < -{LEAST!r}D then -1 else 0 end"
    place = f"if(abs(value) > {LEAST!r}D, cast(ceil(ln(abs(value)) / {_growth(error)!r}D) as int), 0)"
    rows = long_values(df, columns, [part]).selectExpr(f"{q(part)} as part", "feature", f"{side} as sign", f"{place} as bucket")
    return rows.groupBy("part", "feature", "sign", "bucket").agg(F.count(F.lit(1)).alias("n"))


def distinct_cells(df: DataFrame, columns: Sequence[str], part: str) -> DataFrame:
    """``(part, feature, register, rows, least)``: rows per register of each column and the least rest of their hashes.

    The register null holds the missing values, the feature null the distinct whole rows. At most 2^14 + 1 rows per
    partition and column, combined in each task first.
    """
    whole = f"xxhash64({', '.join(q(c) for c in df.columns)})"
    values = ", ".join(f"struct('{i}' as i, cast({q(c)} as string) as v)" for i, c in enumerate(columns))
    rows = df.selectExpr(f"{q(part)} as part", f"inline(array_append(array({values}), struct('row' as i, cast({whole} as string) as v)))")
    hashed = rows.selectExpr("part", "i", "if(v is null, null, xxhash64(v)) as h").selectExpr(
        "part", "i", f"cast(h & {2**LOG2_REGISTERS - 1} as int) as register", f"shiftrightunsigned(h, {LOG2_REGISTERS}) as rest"
    )
    found = hashed.groupBy("part", "i", "register").agg(F.count(F.lit(1)).alias("rows"), F.min("rest").alias("least"))
    names = "case i " + " ".join(f"when '{i}' then {q_text(c)}" for i, c in enumerate(columns)) + " end"
    return found.selectExpr("part", f"{names} as feature", "register", "rows", "least")


def q_text(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def merged_quantiles(cells: DataFrame, probs: Sequence[float], error: float = ERROR) -> DataFrame:
    """``(feature, n, p25, ...)`` of all partitions' cells: at rank floor(p (n - 1)) the middle of the bucket that holds it.

    Within a relative ``error`` of the value at that rank, or nearer than 1e-9 to zero. Works on cells alone.
    """
    total = cells.groupBy("feature", "sign", "bucket").agg(F.sum("n").alias("n"))
    middle = f"sign * 2D * exp(bucket * {_growth(error)!r}D) / (1D + exp({_growth(error)!r}D))"
    ordered = total.selectExpr(
        "feature", f"if(sign = 0, 0D, {middle}) as middle", "n",
        "sum(n) over (partition by feature order by sign, sign * bucket) as upto", "sum(n) over (partition by feature) as total",
    )
    picks = [F.expr(f"min(case when upto > floor({float(p)!r}D * (total - 1)) then middle end) as {quantile_name(p)}") for p in probs]
    return ordered.groupBy("feature").agg(F.expr("max(total) as n"), *picks)


def merged_distinct(cells: DataFrame) -> DataFrame:
    """``(feature, rows, n_distinct)`` over all partitions, and for the feature null the estimated duplicate rows as well."""
    bits, m = 64 - LOG2_REGISTERS, 2**LOG2_REGISTERS
    registers = cells.groupBy("feature", "register").agg(F.sum("rows").alias("rows"), F.min("least").alias("least"))
    # A register whose least rest has k bits counts 2^(k - bits - 1), here as the whole number 2^k.
    length = "if(least = 0, 0, length(bin(least)))"
    found = registers.groupBy("feature").agg(
        F.sum("rows").alias("rows"), F.count("register").alias("used"),
        F.coalesce(F.expr(f"sum(cast(shiftleft(1L, {length}) as decimal(20, 0)))"), F.lit(0)).alias("seen"),
    )
    empty = f"({m} - used) / {m}D"
    sigma = f"aggregate(sequence(1, 30), {empty}, (a, k) -> a + pow({empty}, pow(2D, k)) * pow(2D, k - 1))"
    estimate = f"{m * m / (2 * math.log(2))!r}D / ({m}D * {sigma} + cast(seen as double) / {float(2 ** (bits + 1))!r}D)"
    distinct = found.selectExpr("feature", "rows", f"if(used = 0, 0L, cast(round({estimate}) as bigint)) as n_distinct")
    return distinct.selectExpr("feature", "rows", "n_distinct", "if(feature is null, greatest(rows - n_distinct, 0), null) as n_duplicates")
