"""Checked embedding vectors, and their way between Arrow columns and numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .tables import col


def checked(df: DataFrame, columns: dict[str, str], vec_col: str, zero: bool = True, limit: float | None = None) -> tuple[DataFrame, int]:
    """``columns`` of ``df`` under new names with ``vec``, for rows with a usable vector, and its length.

    A vector is usable if it is not null or empty, holds only finite numbers (below ``limit`` in size if given), is
    not all zero unless ``zero`` allows that, and has the most frequent length; equally frequent lengths: the longest.
    Elements stay single precision if they are, and are read as doubles otherwise.
    """
    single = isinstance(df.schema[vec_col].dataType, ArrayType) and isinstance(df.schema[vec_col].dataType.elementType, FloatType)
    vec = col(df, vec_col) if single else col(df, vec_col).cast("array<double>")
    rows = df.select(*[col(df, c).alias(name) for name, c in columns.items()], vec.alias("vec"))
    least = "double('infinity')" if limit is None else f"{float(limit)!r}D"
    rows = rows.where(f"vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < {least})")
    if not zero:
        rows = rows.where("exists(vec, x -> x <> 0)")
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    d = first.d if first else 0
    return rows.where(F.size("vec") == d), d


def matrix(column: pa.Array | pa.ChunkedArray, d: int, kind: type = np.float64) -> np.ndarray:
    """Rows of a list column of ``d`` numbers each."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]
    return (np.concatenate(flat) if flat else np.zeros(0)).astype(kind, copy=False).reshape(len(column), d)


def list_column(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(rows).ravel()))
