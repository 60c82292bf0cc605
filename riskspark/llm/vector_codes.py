"""Vector code compression: product codes learned by Lloyd rounds that look at moved entries only.

Every row carries, for each of its parts, the entry assigned last and the exact squared distance to it. After a
round only some entries of a codebook have moved. A part whose own entry stayed fixed compares its stored distance
with the moved entries alone; a part whose entry moved scans the codebook anew. Ties go to the lower index either way.
All arithmetic is on whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .tables import free_name, small
from .vectors import checked, list_column, matrix

LIMIT = 2.0**17
"""Rows with a component of this size or more are dropped like those with an infinite one."""


@dataclass(frozen=True)
class CodeConfig:
    """The codebooks hold ``parts`` x ``entries`` x (dimensions / ``parts``) numbers, the only thing that passes the driver."""

    scale: int = 1024
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    chunk: int = 4096


def whole_numbers(vec: np.ndarray, cfg: CodeConfig) -> np.ndarray:
    """floor(scale * component); zeros fill up the last part where the parts do not divide the dimensions."""
    x = np.floor(cfg.scale * vec).astype(np.int64)
    return np.pad(x, ((0, 0), (0, -x.shape[1] % cfg.parts)))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every entry: in floating point where all sums stay below 2^53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * x.shape[1] < 2**53 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)


def assign_all(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lowest of equals, and its distance."""
    d = distances(x, entries)
    code = d.argmin(axis=1)
    return code, d[np.arange(len(x)), code]


def assign_moved(x: np.ndarray, code: np.ndarray, error: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, from the last assignment and distance, when only the entries marked in ``moved`` differ from then."""
    code, error = code.copy(), error.copy()
    again = moved[code]
    if again.any():
        code[again], error[again] = assign_all(x[again], entries)
    active = np.flatnonzero(moved)
    rest = np.flatnonzero(~again)
    if len(active) and len(rest):
        best, d = assign_all(x[rest], entries[active])
        other = active[best]
        better = (d < error[rest]) | ((d == error[rest]) & (other < code[rest]))
        code[rest[better]], error[rest[better]] = other[better], d[better]
    return code, error


def _first_entries(rows: DataFrame, d: int, cfg: CodeConfig) -> np.ndarray:
    """Parts of the rows with the smallest ids, (part, entry, place); at most ``entries`` rows go to the driver."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(cfg.entries).select("vec").toArrow()
    x = whole_numbers(matrix(first.column("vec"), d), cfg)
    return x.reshape(len(x), cfg.parts, x.shape[1] // cfg.parts).transpose(1, 0, 2)


def _assigned(state: DataFrame, d: int, books: np.ndarray, moved: np.ndarray | None, cfg: CodeConfig) -> DataFrame:
    """``state`` with ``code`` and ``error`` for these codebooks; ``moved`` is None in the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, cfg.chunk):
                batch = whole.slice(at, cfg.chunk)
                x = whole_numbers(matrix(batch.column("vec"), d), cfg).reshape(batch.num_rows, cfg.parts, -1)
                code = np.empty((batch.num_rows, cfg.parts), np.int32)
                error = np.empty((batch.num_rows, cfg.parts), np.int64)
                if moved is not None:
                    old_code, old_error = matrix(batch.column("code"), cfg.parts, np.int32), matrix(batch.column("error"), cfg.parts, np.int64)
                for p in range(cfg.parts):
                    if moved is None:
                        code[:, p], error[:, p] = assign_all(x[:, p], books[p])
                    else:
                        code[:, p], error[:, p] = assign_moved(x[:, p], old_code[:, p], old_error[:, p], books[p], moved[p])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), list_column(code), list_column(error)], [*kept, "code", "error"])

    kept = [c for c in state.columns if c not in ("code", "error")]
    schema = ", ".join(f"`{c}` {state.schema[c].dataType.simpleString()}" for c in kept)
    return state.mapInArrow(run, f"{schema}, code array<int>, error array<bigint>")


def _updated(state: DataFrame, d: int, books: np.ndarray, cfg: CodeConfig) -> np.ndarray:
    """Entries replaced by the floored means of their parts. Each task sums up its rows; one row per used entry is collected."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = whole_numbers(matrix(batch.column("vec"), d), cfg).reshape(batch.num_rows, parts, width)
            cell = matrix(batch.column("code"), parts, np.int64) + np.arange(parts) * entries
            counts += np.bincount(cell.ravel(), minlength=parts * entries)
            order = np.argsort(cell.ravel(), kind="stable")
            used, first = np.unique(cell.ravel()[order], return_index=True)
            if len(used):
                sums[used] += np.add.reduceat(x.reshape(-1, width)[order], first)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), list_column(sums[used])], ["cell", "n", "sums"])

    partial = state.select("vec", "code").mapInArrow(run, "cell int, n bigint, sums array<bigint>")
    by_place = partial.selectExpr("cell", "n", "posexplode(sums) as (place, part)")
    found = by_place.groupBy("cell", "place").agg(F.sum("part").alias("s"), F.sum("n").alias("n"))
    mean = found.selectExpr("cell", "place", "s div n - if(s < 0 and s % n <> 0, 1L, 0L) as v").toArrow()
    new = books.copy().reshape(parts * entries, width)
    new[mean.column("cell").to_numpy(), mean.column("place").to_numpy()] = mean.column("v").to_numpy()
    return new.reshape(books.shape)


def learn(rows: DataFrame, d: int, cfg: CodeConfig = CodeConfig()) -> tuple[np.ndarray, DataFrame]:
    """Final codebooks (part, entry, place), and the rows with their final ``code`` and ``error`` per part."""
    books = _first_entries(rows, d, cfg)
    state, moved = rows, None
    for _ in range(cfg.rounds if books.size else 0):
        state = stage(_assigned(state, d, books, moved, cfg), "codes")
        new = _updated(state, d, books, cfg)
        moved = (new != books).any(axis=2)
        books = new
    return books, stage(_assigned(state, d, books, moved, cfg), "codes")


def checksum(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cfg: CodeConfig = CodeConfig()) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable row.

    Dropped are rows whose vector is null, empty, not of the most frequent length, or holds a null, non-finite or
    (from 2^17 on) over-large component. Codebooks start from the rows of the smallest ids, rows without an id
    last, equal ids by vector; fewer rows than entries give smaller codebooks. Repeated rows are coded alike.
    ``code`` has two hex digits per part, ``error`` is the sum of the parts' squared distances and ``label_error``
    its sum over rows of the same label, null being a label too. Zeros fill up the last part where the number of parts
    does not divide the length. An empty table gives no rows.
    """
    rows, d = checked(df, {"vec_id": id_col, "label": label_col}, vec_col, limit=LIMIT)
    books, state = learn(rows, d, cfg)
    digits = F.lower(F.concat_ws("", F.transform("code", lambda c: F.lpad(F.hex(c.cast("long")), 2, "0"))))
    total = F.aggregate("error", F.lit(0).cast("long"), lambda a, e: a + e)
    coded = state.select("vec_id", "label", digits.alias("code"), total.alias("error"))
    name = free_name(coded, "of_label")
    sums = stage(coded.groupBy(F.col("label").alias(name)).agg(F.sum("error").alias("label_error")), "label_errors")
    return coded.join(small(sums), F.col("label").eqNullSafe(F.col(name))).select(
        "vec_id", "code", "error", "label_error", F.lit(checksum(books)).alias("codebooks_sha256")
    )
