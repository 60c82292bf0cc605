"""Training, cross-validation and feature importance on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import N_CLASSES, RiskConfig
from ..functions import argmax_class, clean, compute_once, q, stack, text
from ..sources.staging import stage
from . import evaluate
from .prepare import add_label, available_features, clean_numbers, prepare
from .score import PROBS
from .splits import stratified_folds, stratified_split

LOGISTIC, TREE, FOREST, BOOSTED = "Logistic Regression", "Decision Tree", "Random Forest", "Boosted Trees"
MODELS = (LOGISTIC, TREE, FOREST, BOOSTED)

# Model settings. maxBins, maxMemoryInMB and checkpointInterval can be overridden per call.
DEFAULTS: Mapping[str, Mapping[str, object]] = {
    LOGISTIC: {"C": 1.0, "maxIter": 1000},
    TREE: {"maxDepth": 8, "maxBins": 128, "impurity": "gini"},
    FOREST: {"numTrees": 200, "maxDepth": 12, "maxBins": 128, "featureSubsetStrategy": "sqrt"},
    BOOSTED: {"maxIter": 200, "maxDepth": 6, "stepSize": 0.1, "maxBins": 128},
}

TOGETHER_ROWS = 10_000_000
"""Boosted trees of all classes, or of one round, grow side by side up to this many rows. More rows keep the cores busy with one
tree, and every growing tree holds its own binned copy of them."""


@dataclass(frozen=True)
class FittedModel:
    """A fitted pipeline with the features it reads."""

    name: str
    features: tuple[str, ...]
    pipeline: PipelineModel

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``p0, p1, p2, pred``; every other column of ``df`` passes through."""
        kept = [q(c) for c in df.columns if c not in (*PROBS, "pred", *self.features)]
        plain = [q(c) for c in self.features]
        out = self.pipeline.transform(
            df.selectExpr(*kept, *plain, *[f"cast({c} as double) as {q('_x_' + f)}" for f, c in zip(self.features, plain)])
        )
        if self.name == BOOSTED:
            # One positive-class probability per one-vs-rest model, normalised to sum to one.
            raw = [
                F.get(vector_to_array(f"_prob{k}"), F.lit(1)) if f"_prob{k}" in out.columns else F.lit(0.0)
                for k in range(N_CLASSES)
            ]
            out = compute_once(out.withColumn("_raw", F.array(*raw)), {"_arr": "_raw"})
            total = " + ".join(f"_arr[{k}]" for k in range(N_CLASSES))
            shares = {p: f"_arr[{k}] / ({total})" for k, p in enumerate(PROBS)}
        else:
            out = compute_once(out.withColumn("_raw", vector_to_array("probability")), {"_arr": "_raw"})
            shares = {p: f"coalesce(get(_arr, {k}), 0D)" for k, p in enumerate(PROBS)}
        scored = out.selectExpr(*kept, *plain, *[f"{e} as {p}" for p, e in shares.items()])
        return scored.selectExpr("*", f"{argmax_class(*PROBS)} as pred")

    @property
    def importances(self) -> list[tuple[str, float]]:
        """Normalised impurity importance; for the boosted model the mean over its binary models."""
        found = [s.featureImportances.toArray() for s in self.pipeline.stages if hasattr(s, "featureImportances")]
        if not found:
            raise ValueError(f"{self.name} has no impurity importance")
        mean = sum(found) / len(found)
        total = mean.sum() or 1.0
        return [(c, float(v / total)) for c, v in zip(self.features, mean)]


def fit_scaler(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature: one aggregate, one row to the driver."""
    row = train.selectExpr(*[
        f"{fn}({clean(c)}) as {a}{i}" for i, c in enumerate(features) for a, fn in (("m", "avg"), ("s", "stddev_pop"))
    ]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(features)}


def class_counts(df: DataFrame, label: str) -> dict[int, int]:
    """Rows per class; one row per class to the driver."""
    return {int(r[label]): r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def _weight(label: str, counts: Mapping[int, int]) -> str:
    """Rows / (classes * rows of the class), from known counts (SQL text)."""
    n, k = sum(counts.values()), len(counts)
    whens = " ".join(f"when {c} then {n / (k * m)!r}D" for c, m in counts.items())
    return f"case {q(label)} {whens} else 0D end"


def fit_model(
    name: str,
    train: DataFrame,
    cfg: RiskConfig,
    features: Sequence[str],
    params: Mapping[str, object] | None = None,
    scaler: Mapping[str, tuple[float, float]] | None = None,
    counts: Mapping[int, int] | None = None,
    seed: int = 42,
) -> FittedModel:
    """Fit one model. Class weights are balanced on the rows being fitted, except for the boosted model."""
    settings = {**DEFAULTS[name], **(params or {})}
    counts = counts or class_counts(train, cfg.label_col)
    rows = train.selectExpr(
        *[f"cast({q(c)} as double) as {q('_x_' + c)}" for c in features],
        f"cast({q(cfg.label_col)} as double) as _label",
        f"{_weight(cfg.label_col, counts)} as _weight",
    )
    head: list = []
    inputs = [f"_x_{c}" for c in features]  # double copies, so a scored table keeps its own column types
    if name == LOGISTIC:
        scaler = scaler or fit_scaler(train, features)
        terms = ", ".join(
            f"({q('_x_' + c)} - ({m!r}D)) / {s!r}D AS {q('_z_' + c)}" for c, (m, s) in scaler.items()
        )
        head.append(SQLTransformer(statement=f"SELECT *, {terms} FROM __THIS__"))
        inputs = [f"_z_{c}" for c in features]
    head.append(VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="error"))
    data = rows
    for stage_ in head:
        data = stage_.transform(data)
    common = {"featuresCol": "_features", "labelCol": "_label"}

    if name == LOGISTIC:
        strength = settings.pop("C")
        # The penalty is 1/(C * total weight) because Spark averages the loss over the weights.
        estimator = LogisticRegression(
            **common, weightCol="_weight", family="multinomial", elasticNetParam=0.0,
            standardization=False, regParam=1.0 / (strength * sum(counts.values())), **settings,
        )
        tail = [estimator.fit(data)]
    elif name in (TREE, FOREST):
        kind = DecisionTreeClassifier if name == TREE else RandomForestClassifier
        tail = [kind(**common, weightCol="_weight", seed=seed, **settings).fit(data)]
    elif name == BOOSTED:

        def against_rest(k: int):
            binary = data.withColumn("_label", (F.col("_label") == k).cast("double"))
            gbt = GBTClassifier(**common, seed=seed, **settings)
            gbt.setProbabilityCol(f"_prob{k}").setRawPredictionCol(f"_raw{k}").setPredictionCol(f"_pred{k}")
            return gbt.fit(binary)

        together = len(counts) if sum(counts.values()) <= TOGETHER_ROWS else 1
        tail = _in_parallel(train.sparkSession, [lambda k=k: against_rest(k) for k in sorted(counts)], together)
    else:
        raise ValueError(f"unknown model: {name}")
    return FittedModel(name, tuple(features), PipelineModel(stages=[*head, *tail]))


def _in_parallel(spark: SparkSession, tasks: Sequence[Callable], parallelism: int) -> list:
    """Submit independent fits from a few driver threads, so their jobs share the cluster."""
    if parallelism <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    wrap = inheritable_thread_target(spark)
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return pool.map(lambda t: wrap(t)(), tasks)


def training_frame(
    raw: DataFrame, cfg: RiskConfig, k: int = 5, seed: int = 42, impute_on_train: bool = False
) -> DataFrame:
    """Prepared table with ``split`` and ``fold``.

    The raw rows are written once, since medians, cuts and the table itself read them; so are the two tables of cuts (one row
    per class) and the prepared rows with split and fold, which every fit reads. Medians come from all rows, test rows included;
    ``impute_on_train`` fits them on the train rows only.
    """

    def keep(cuts: DataFrame) -> DataFrame:
        return stage(cuts, "cuts")

    raw = stage(raw, "raw")
    coded = add_label(clean_numbers(raw), cfg)
    keys = coded.select(cfg.id_col, cfg.label_col)
    if impute_on_train:
        marked = stratified_split(coded, cfg, seed=seed, source=keys, materialise=keep)
        split = prepare(marked, cfg, fit_on="split = 'train'")
    else:
        split = stratified_split(prepare(raw, cfg), cfg, seed=seed, source=keys, materialise=keep)
    return stage(stratified_folds(split, cfg, k, seed, keys, keep), "training")


def holdout_scores(model: FittedModel, frame: DataFrame, cfg: RiskConfig, name: str | None = None) -> DataFrame:
    """``(model, label, pred, p0, p1, p2)`` of the test rows."""
    return model.score(frame.filter("split = 'test'")).select(
        F.lit(name or model.name).alias("model"), F.col(cfg.label_col).alias("label"), "pred", *PROBS
    )


def cross_validate(
    name: str,
    frame: DataFrame,
    cfg: RiskConfig,
    features: Sequence[str],
    params: Mapping[str, object] | None = None,
    scaler: Mapping[str, tuple[float, float]] | None = None,
    parallelism: int = 2,
    label: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """Out-of-fold predictions ``(model, fold, label, pred, p0, p1, p2)`` over every row of the frame.

    The logistic model reuses one scaler for all folds, fitted on the train split.
    """
    grouped = frame.groupBy("fold", cfg.label_col).agg(F.count(F.lit(1)).alias("n")).collect()
    folds = sorted({r["fold"] for r in grouped})
    if name == LOGISTIC and scaler is None:
        scaler = fit_scaler(frame.filter("split = 'train'"), features)

    def run(i: int) -> DataFrame:
        counts: dict[int, int] = {}
        for r in grouped:
            if r["fold"] != i:
                counts[int(r[cfg.label_col])] = counts.get(int(r[cfg.label_col]), 0) + r["n"]
        model = fit_model(
            name, frame.filter(F.col("fold") != i), cfg, features, params, scaler, counts, seed
        )
        return model.score(frame.filter(F.col("fold") == i)).select(
            F.lit(label or name).alias("model"), "fold", F.col(cfg.label_col).alias("label"), "pred", *PROBS
        )

    parts = _in_parallel(frame.sparkSession, [lambda i=i: run(i) for i in folds], parallelism)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_importance(model: FittedModel, frame: DataFrame, cfg: RiskConfig, name: str | None = None) -> DataFrame:
    """``(model, feature, importance)``; one row per feature, so it is built from a literal array."""
    rows = [(text(c), f"{round(v, 4)!r}D") for c, v in model.importances]
    return frame.sparkSession.range(1).selectExpr(
        f"{text(name or model.name)} as model", stack(rows, ("feature", "importance"))
    )


@dataclass
class TrainingRun:
    """Everything one training call produces. Tables are DataFrames; models are fitted pipelines."""

    frame: DataFrame
    models: dict[str, FittedModel]
    test: DataFrame
    out_of_fold: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)


def train_all(
    raw: DataFrame,
    cfg: RiskConfig,
    names: Sequence[str] = MODELS,
    params: Mapping[str, Mapping[str, object]] | None = None,
    features: Sequence[str] | None = None,
    folds: int = 5,
    cross_validation: bool = True,
    parallelism: int = 2,
    seed: int = 42,
) -> TrainingRun:
    """Prepare, split, fit each model, evaluate on the test rows, cross-validate, and collect the tables."""
    params = params or {}
    frame = training_frame(raw, cfg, folds, seed)
    chosen = available_features(frame, features or cfg.features)
    train = frame.filter("split = 'train'")
    scaler = fit_scaler(train, chosen) if LOGISTIC in names else None
    counts = class_counts(train, cfg.label_col)
    fitted = _in_parallel(
        frame.sparkSession,
        [lambda n=n: fit_model(n, train, cfg, chosen, params.get(n), scaler, counts, seed) for n in names],
        parallelism,
    )
    models = dict(zip(names, fitted))
    scored = [holdout_scores(m, frame, cfg) for m in fitted]
    test = scored[0]
    for s in scored[1:]:
        test = test.unionByName(s)
    test = stage(test, "test_scores")
    run = TrainingRun(frame, models, test)
    metrics = evaluate.model_metrics(test)
    run.tables = {
        "model_metrics": metrics,
        "confusion": evaluate.confusion_matrix(test, ["model"]),
        "test_scores": test,
    }
    if FOREST in models:
        run.tables["importance"] = feature_importance(models[FOREST], frame, cfg)
    if cross_validation:
        parts = [
            cross_validate(n, frame, cfg, chosen, params.get(n), scaler, parallelism, seed=seed) for n in names
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        run.out_of_fold = stage(out, "out_of_fold")
        scores = evaluate.fold_scores(run.out_of_fold)
        cv = evaluate.cv_summary(scores)
        run.tables |= {
            "fold_scores": scores,
            "cv_summary": cv,
            "comparison": evaluate.model_comparison(metrics, cv, cfg),
        }
    return run


def train_behavioural(
    frame: DataFrame,
    cfg: RiskConfig,
    params: Mapping[str, object] | None = None,
    features: Sequence[str] | None = None,
    seed: int = 42,
) -> FittedModel:
    """Forest on the behavioural features only, on the same split."""
    chosen = available_features(frame, features or cfg.behavioural)
    return fit_model(FOREST, frame.filter("split = 'train'"), cfg, chosen, params, seed=seed)
