"""Contributions of a linear softmax model by kernel-weighted least squares over coalitions of features.

A coalition keeps a row's own values for some features and the background's for the others. All rows share the
coalitions, so the weighted least squares is solved once: contributions are a fixed matrix times the model's outputs
on the coalitions of a row.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..config import N_CLASSES
from ..functions import q
from .train import LOGISTIC, FittedModel


@dataclass(frozen=True)
class SoftmaxModel:
    """Class weights ``coef`` (class, feature) on ``(value - centre) / spread``, and intercepts."""

    features: tuple[str, ...]
    coef: np.ndarray
    intercept: np.ndarray
    centre: np.ndarray
    spread: np.ndarray


def softmax_model(model: FittedModel, spark: SparkSession) -> SoftmaxModel:
    """The weights of a fitted logistic model. Its scaling is linear, so it is read off at the values 0 and 1; this also
    serves a model that was loaded from the store."""
    if model.name != LOGISTIC:
        raise ValueError(f"{model.name} is not linear")
    fitted = model.pipeline.stages[-1]
    if fitted.numClasses != N_CLASSES:
        raise ValueError("a class is missing from the training rows")
    probe = spark.range(2).selectExpr("id", *[f"cast(id as double) as {q('_x_' + c)}" for c in model.features])
    at = [[r[f"_z_{c}"] for c in model.features] for r in model.pipeline.stages[0].transform(probe).orderBy("id").collect()]
    spread = 1.0 / np.subtract(at[1], at[0])
    return SoftmaxModel(
        model.features, fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray(), -np.array(at[0]) * spread, spread
    )


def coalitions(n: int, most: int | None = None, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Proper subsets of ``n`` features as rows of 0 and 1, and their weights.

    All of them if there are at most ``most`` (2 n + 2048 by default). Otherwise sizes from the outside in are used whole
    while as many draws as subsets would fall on them, and the rest of ``most`` is drawn from the other sizes, by their
    total weight and each subset with its complement; these share the weight of their sizes by how often they were drawn.
    """
    most = most or 2 * n + 2048
    if n < 2:
        return np.zeros((0, n)), np.zeros(0)
    by_size = (n - 1) / (np.arange(1, n) * np.arange(n - 1, 0, -1))  # total weight of the sizes 1 to n - 1
    if n < 63 and 2**n - 2 <= most:
        z = (np.arange(1, 2**n - 1)[:, None] >> np.arange(n) & 1).astype(float)
        size = z.sum(axis=1).astype(int)
        return z, np.array([by_size[s - 1] / math.comb(n, s) for s in size])
    found, weights = [], []
    inner = 1  # sizes from here to n - inner are drawn from
    while 2 * inner < n:
        share = 2 * by_size[inner - 1] / by_size[inner - 1 : n - inner].sum()
        if 2 * math.comb(n, inner) > share * (most - len(found)):
            break
        for members in itertools.combinations(range(n), inner):
            z = np.zeros(n)
            z[list(members)] = 1
            found += [z, 1 - z]
        weights += [by_size[inner - 1] / math.comb(n, inner)] * (2 * math.comb(n, inner))
        inner += 1
    rest = by_size[inner - 1 : n - inner]
    rng = np.random.default_rng(seed)
    drawn = rng.choice(np.arange(inner, n - inner + 1), (most - len(found)) // 2, p=rest / rest.sum())
    order = rng.random((len(drawn), n)).argsort(axis=1).argsort(axis=1)
    z = (order < drawn[:, None]).astype(float)
    z, counts = np.unique(np.concatenate([z, 1 - z]), axis=0, return_counts=True)
    return np.concatenate([np.array(found).reshape(-1, n), z]), np.concatenate([weights, rest.sum() * counts / counts.sum()])


def solution(z: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(G, h): contributions are G y + h * total for outputs ``y`` of the coalitions above the background's, where
    ``total`` is that of the whole row, to which the contributions sum exactly."""
    n = z.shape[1]
    if n == 1:
        return np.zeros((1, 0)), np.ones(1)
    inverse = np.linalg.pinv((z * weight[:, None]).T @ z)
    ones = inverse.sum(axis=1)
    scale = ones.sum()
    return (inverse - np.outer(ones, ones) / scale) @ (z * weight[:, None]).T, ones / scale


def _outputs(model: SoftmaxModel, scaled: np.ndarray) -> np.ndarray:
    logits = scaled @ model.coef.T + model.intercept
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def contributions(x: np.ndarray, pred: np.ndarray, model: SoftmaxModel, background: np.ndarray, z: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(row, feature) contributions to the probability of ``pred``. ``x`` and ``background`` are scaled."""
    base = background @ model.coef.T + model.intercept
    terms = (x - background)[:, None, :] * model.coef  # (row, class, feature)
    logits = terms @ z.T + base[:, None]  # (row, class, coalition)
    logits -= logits.max(axis=1, keepdims=True)
    e = np.exp(logits)
    rows = np.arange(len(x))
    start = _outputs(model, background)[pred]
    y = e[rows, pred] / e.sum(axis=1) - start[:, None]
    return y @ g.T + (_outputs(model, x)[rows, pred] - start)[:, None] * h


def kernel_contributions(
    df: DataFrame,
    model: SoftmaxModel,
    id_col: str,
    background: Sequence[float] | None = None,
    most: int | None = None,
    seed: int = 42,
    cells: int = 1 << 20,
) -> DataFrame:
    """Contributions of every feature to the probability of each row's predicted class.

    One row per row of ``df``: id, ``pred``, features, ``expected`` (the probability of that class on the background) and
    ``contribution_<feature>``, which sum to the probability minus ``expected``. The background is in scaled
    units, all zero by default. Exact while all coalitions are used (up to 11 features by default). A missing feature counts
    as the background. Nothing is shuffled, and a task holds about ``cells`` outputs at a time.
    """
    names = [f"contribution_{c}" for c in model.features]
    ground = np.zeros(len(model.features)) if background is None else np.asarray(background, float)
    z, weight = coalitions(len(model.features), most, seed)
    g, h = solution(z, weight)
    rows = max(1, cells // ((len(z) + 1) * len(model.coef)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]])
                x = (x - model.centre) / model.spread
                x = np.where(np.isnan(x), ground, x)
                pred = _outputs(model, x).argmax(axis=1)
                found = contributions(x, pred, model, ground, z, g, h)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(pred.astype(np.int32)), *batch.columns[1:], pa.array(_outputs(model, ground)[pred]),
                     *map(pa.array, np.ascontiguousarray(found.T))],
                    [id_col, "pred", *model.features, "expected", *names],
                )

    inputs = df.selectExpr(q(id_col), *[f"cast({q(c)} as double) as {q(c)}" for c in model.features])
    id_type = inputs.schema[id_col].dataType.simpleString()
    doubles = [f"{q(c)} double" for c in (*model.features, "expected", *names)]
    return inputs.mapInArrow(run, ", ".join([f"{q(id_col)} {id_type}", "pred int", *doubles]))
