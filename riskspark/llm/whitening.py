"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The centred fit rows X (each distinct integer vector once) stay in a written table. A step multiplies X by a vector
in every task, u = X v - b u', and at once sums X'u, the length of u and its products with all earlier u, so each
step is one pass whose result is a few numbers per dimension. An earlier u is never stored: it is X w with a known w of
one number per dimension. Both sides are orthogonalised against all their predecessors. The singular values and
vectors of the small bidiagonal matrix give eigenvalues and components of the covariance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .vectors import checked, list_column, matrix

SCALE, SHIFT = 64, 1_000_000
LIMIT = 2.0**40
"""Rows with an entry of this size or more are dropped like those with an infinite one."""


@dataclass(frozen=True)
class WhiteningConfig:
    """At most ``components`` directions. Up to ``whole_dims`` dimensions the bidiagonalisation is carried to its end; beyond,
    it stops when the wanted triplets have residuals below ``tolerance`` of the largest singular value."""

    components: int = 16
    whole_dims: int = 256
    tolerance: float = 1e-13
    seed: int = 11


@dataclass(frozen=True)
class Whitener:
    """Exact count ``n`` and sums per dimension of the fit list, its unit ``components`` (a column each) by falling
    ``eigenvalues``, the ``trace`` of the covariance, and the measured ``identity_error``."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part of the means and what remains, as numerators over n."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return whole, np.array([s - int(w) * self.n for s, w in zip(self.sums, whole, strict=True)], np.int64)


def integers(vec: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vec).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x minus the mean: the whole part is taken off in integers, so nothing is rounded before the small fraction."""
    return (x - whole) - rest / n


def totals(fit: DataFrame, of_batch, width: int, kind: str = "double") -> np.ndarray:
    """Sums over the whole table of the ``width`` numbers that ``of_batch`` makes of the matrix of a batch. Each task sends one
    row per number, which are added up by place."""
    d_type = {"double": np.float64, "bigint": np.int64}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, d_type)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(matrix(batch.column(0), len(batch.column(0)[0]), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["place", "part"])

    rows = fit.mapInArrow(run, f"place int, part {kind}").groupBy("place").agg(F.sum("part").alias("part")).collect()
    out = np.zeros(width, d_type)
    for r in rows:  # a row for each of the width places
        out[r.place] = r.part
    return out


class Bidiagonalisation:
    """Golub-Kahan-Lanczos steps on a matrix known by ``product(w, others)``: the rows X times w give u; returned are
    X'u, u.u and the products of u with X times each of ``others``."""

    def __init__(self, d: int, product, cfg: WhiteningConfig):
        self.d, self.product, self.cfg = d, product, cfg
        self.rng = np.random.default_rng(cfg.seed)
        self.right, self.w, self.gram = [], [], []  # v, w with u = X w, and X'u
        self.alpha, self.beta = [], []

    def _orthogonal(self, v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for other in self.right:
                v = v - (other @ v) * other
        return v

    def _fresh(self) -> np.ndarray:
        """A random direction at right angles to all before; used at the start and when the space is exhausted early."""
        v = self._orthogonal(self.rng.standard_normal(self.d))
        v /= np.linalg.norm(v)
        v = self._orthogonal(v)
        return v / np.linalg.norm(v)

    def _left(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """w, X'u and |u| after u = X w was made orthogonal to all u before; once more if little of it remained."""
        others = [x for x in self.w if x.any()]
        grams = [g for x, g in zip(self.w, self.gram, strict=True) if x.any()]
        for _ in range(3):
            g, square, inner = self.product(w, others)
            left = square - float(inner @ inner)
            for h, x, y in zip(inner, others, grams, strict=True):
                w, g = w - h * x, g - h * y
            if left > 0.5 * square or square <= 0:
                break
        return w, g, float(np.sqrt(max(left, 0.0)))

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Singular values, falling, and right singular vectors as columns."""
        v, before, largest = self._fresh(), 0.0, 0.0
        for _ in range(self.d):
            w, g, alpha = self._left(v - before * self.w[-1] if self.w and before else v)
            largest = max(largest, alpha)
            gone = alpha <= 1e-13 * largest or alpha == 0
            self.right.append(v)
            self.alpha.append(0.0 if gone else alpha)
            self.w.append(np.zeros(self.d) if gone else w / alpha)
            self.gram.append(np.zeros(self.d) if gone else g / alpha)
            if len(self.right) == self.d:
                break
            after = self._orthogonal(self.gram[-1] - self.alpha[-1] * v)
            before = float(np.linalg.norm(after))
            largest = max(largest, before)
            if before <= 1e-13 * largest:
                before, v = 0.0, self._fresh()
            else:
                v = after / before
                if self.d > self.cfg.whole_dims and self._converged(before):
                    break
            self.beta.append(before)
        _, sigma, turned = np.linalg.svd(self._small())
        return sigma, np.column_stack(self.right) @ turned.T

    def _small(self) -> np.ndarray:
        m = len(self.alpha)
        return np.diag(self.alpha) + np.diag(self.beta[: m - 1], 1)

    def _converged(self, beta: float) -> bool:
        left, sigma, _ = np.linalg.svd(self._small())
        k = self.cfg.components
        return len(sigma) > k and bool((beta * np.abs(left[-1, :k]) <= self.cfg.tolerance * sigma[0]).all())


def fit_whitener(vectors: DataFrame, d: int, cfg: WhiteningConfig = WhiteningConfig()) -> Whitener | None:
    """Fit on the distinct integer vectors of the checked ``vec``. None without rows or without any variance."""
    if not d:
        return None
    x = vectors.select(F.transform("vec", lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(SHIFT)).alias("x"))
    fit = stage(x.distinct(), "whitening_fit")
    first = totals(fit, lambda x: np.append(x.sum(axis=0), len(x)), d + 1, "bigint")
    n, sums = int(first[d]), tuple(int(s) for s in first[:d])
    if not n:
        return None
    known = Whitener(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0)
    whole, rest = known.centre()
    trace = float(totals(fit, lambda x: np.array([(centred(x, n, whole, rest) ** 2).sum()]), 1)[0]) / n

    def product(w: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, float, np.ndarray]:
        many = np.column_stack([w, *others])

        def of_batch(x: np.ndarray) -> np.ndarray:
            rows = centred(x, n, whole, rest)
            u = rows @ many
            return np.concatenate([u[:, 0] @ rows, u[:, 0] @ u])

        found = totals(fit, of_batch, d + many.shape[1])
        return found[:d], float(found[d]), found[d + 1 :]

    if not trace > 0:
        return None
    sigma, right = Bidiagonalisation(d, product, cfg).run()
    kept = np.flatnonzero(sigma[: cfg.components] > 1e-7 * sigma[0])
    components, values = right[:, kept], sigma[kept] ** 2 / n
    k = len(kept)

    def moments(x: np.ndarray) -> np.ndarray:
        z = centred(x, n, whole, rest) @ components / np.sqrt(values)
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    found = totals(fit, moments, k + k * k) / n
    error = found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)
    return Whitener(n, sums, values, components, trace, float(np.abs(error).max()))


def _squares(x: np.ndarray, model: Whitener) -> pa.Array:
    """Sum over dimensions of (n x - S)^2 in whole numbers; null where that exceeds a long."""
    whole, rest = model.centre()
    away = x - whole
    most = model.n * (int(np.abs(away).max(initial=0)) + 1)
    if most * most * away.shape[1] < 2**63:
        return pa.array(((model.n * away - rest) ** 2).sum(axis=1))
    exact = ((model.n * away.astype(object) - rest.astype(object)) ** 2).sum(axis=1)
    return pa.array([int(v) if v < 2**63 else None for v in exact], pa.int64())


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cfg: WhiteningConfig = WhiteningConfig()) -> DataFrame:
    """One row per usable row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Dropped are rows whose vector is null, empty, not of the most frequent length, or holds a null, non-finite or
    (beyond the limit of 2^40) over-large entry. Entries become x = floor(64 c) + 1000000. The model is fitted on each
    distinct x vector once; repeated rows and rows without an id are whitened like all others. There are as many
    components as directions with variance, at most 16 (default), so none and no rows for an empty table or
    a single distinct vector. A deviation beyond a long is null. The sign of a component is that of its largest entry.
    Beyond ``whole_dims`` dimensions, of components with exactly equal eigenvalues some may be left out.
    """
    rows, d = checked(df, {"vec_id": id_col}, vec_col, limit=LIMIT)
    model = fit_whitener(rows, d, cfg)
    out = "vec_id, component, n, deviation, whitened, explained, identity_error"
    if model is None:
        none = rows.where("false").selectExpr("vec_id", "0 as component", "0L as n", "0L as deviation", "0D as whitened", "0D as explained", "0D as identity_error")
        return none.selectExpr(*out.split(", "))
    whole, rest = model.centre()
    sign = np.sign(model.components[np.abs(model.components).argmax(axis=0), np.arange(model.components.shape[1])])
    turn = model.components * sign / np.sqrt(model.eigenvalues)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(matrix(batch.column("vec"), d))
            z = centred(x, model.n, whole, rest) @ turn
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _squares(x, model), list_column(z)], ["vec_id", "deviation", "z"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    done = rows.mapInArrow(project, f"vec_id {kind}, deviation bigint, z array<double>")
    shares = ", ".join(f"{float(e / model.trace)!r}D" for e in model.eigenvalues)
    return done.selectExpr("vec_id", "deviation", "posexplode(z) as (place, whitened)").selectExpr(
        "vec_id", "place + 1 as component", f"{model.n}L as n", "deviation", "whitened",
        f"get(array({shares}), place) as explained", f"{model.identity_error!r}D as identity_error",
    )
