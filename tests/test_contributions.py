"""Exact contributions beside the average over all subsets of features."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskspark.operators import explain, kernel_explain, tree_explain, train
from riskspark.plans.binding import ENTITY, entity_table
from riskspark.sources.staging import stage

SF_DIR = "/root/testdata/sf0.001"
FEATURES = ["s1", "s2", "s3", "s4", "s5", "s6"]


@pytest.fixture(scope="module")
def frame(spark):
    return train.training_frame(entity_table(spark, SF_DIR), ENTITY)


def shapley(n, value):
    """Contributions of n players to ``value(set)``, by the definition."""
    out = np.zeros(n)
    for i in range(n):
        for size in range(n):
            share = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for others in itertools.combinations([j for j in range(n) if j != i], size):
                out[i] += share * (value({*others, i}) - value(set(others)))
    return out


# --- trees ----------------------------------------------------------------------------------------


def expectation(nodes, value_of, x, known, at=0):
    """Mean output over the training weight of the features that are not known."""
    left, right, feature, threshold, weight, node = nodes[at]
    if left < 0:
        return value_of(node)
    if feature in known:
        return expectation(nodes, value_of, x, known, left if x[feature] <= threshold else right)
    parts = [(nodes[c][4] / weight, expectation(nodes, value_of, x, known, c)) for c in (left, right) if nodes[c][4] > 0]
    return sum(w * v for w, v in parts)


def random_tree(rng, n_features, depth, at=0, ids=None, nodes=None):
    """Splits may use a feature again, so that bounds and shares of a path have to be merged."""
    ids, nodes = ids or itertools.count(1), {} if nodes is None else nodes
    if depth == 0 or rng.random() < 0.15:
        nodes[at] = (-1, -1, -1, 0.0, float(rng.integers(1, 50)), rng.random(3))
        return nodes
    left, right = next(ids), next(ids)
    random_tree(rng, n_features, depth - 1, left, ids, nodes)
    random_tree(rng, n_features, depth - 1, right, ids, nodes)
    nodes[at] = (left, right, int(rng.integers(n_features)), float(rng.integers(-3, 4)), nodes[left][4] + nodes[right][4], None)
    return nodes


@pytest.mark.parametrize("bits", [11, 1])
def test_random_trees_equal_all_subsets(bits, monkeypatch):
    monkeypatch.setattr(tree_explain, "PATTERN_BITS", bits)
    monkeypatch.setattr(tree_explain, "CELLS", 500)
    rng = np.random.default_rng(8)
    trees = [random_tree(rng, 7, 6) for _ in range(4)]
    table = tree_explain.tree_table(trees, lambda v: v, 7, 3)
    x = rng.integers(-4, 5, (12, 7)).astype(float)  # often exactly a threshold
    pred = rng.integers(0, 3, 12)
    got = tree_explain.contributions(x, pred, table)
    for row, k, found in zip(x, pred, got):
        value = lambda known: sum(expectation(t, lambda v: v, row, known)[k] for t in trees)
        assert np.allclose(found, shapley(7, value), atol=1e-9, rtol=0)
        assert table.expected[k] == pytest.approx(value(set()))


def test_a_single_leaf_contributes_nothing():
    table = tree_explain.tree_table([{0: (-1, -1, -1, 0.0, 5.0, np.array([0.2, 0.3, 0.5]))}], lambda v: v, 2, 3)
    assert (tree_explain.contributions(np.zeros((3, 2)), np.zeros(3, int), table) == 0).all()
    assert table.expected.tolist() == [0.2, 0.3, 0.5]


@pytest.mark.parametrize("name,params", [(train.TREE, {"maxDepth": 5}), (train.FOREST, {"numTrees": 4, "maxDepth": 4})])
def test_fitted_trees_equal_all_subsets_and_sum_up(spark, frame, name, params):
    model = train.fit_model(name, frame.filter("split = 'train'"), ENTITY, FEATURES, params)
    frame = stage(frame, "explained")  # the frame's own plan has joins
    rows = tree_explain.tree_contributions(frame, model, "entity_id")
    assert "Exchange" not in rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).replace("ReusedExchange", "")
    got = {r.entity_id: r for r in rows.collect()}
    scored = model.score(frame).select("entity_id", "p0", "p1", "p2", "pred").collect()
    assert len(got) == len(scored)
    for r in scored:
        total = sum(got[r.entity_id][f"contribution_{c}"] for c in FEATURES)
        assert got[r.entity_id].pred == r.pred
        assert total == pytest.approx(r[f"p{r.pred}"] - got[r.entity_id].expected, abs=1e-9)
    trees = tree_explain.stored_nodes(model.pipeline.stages[-1], spark)
    share = lambda node: np.array(node.impurityStats) / sum(node.impurityStats) / len(trees)
    for r in scored[:4]:
        own = got[r.entity_id]
        x = [own[c] for c in FEATURES]
        value = lambda known: sum(expectation(t, share, x, known)[r.pred] for t in trees.values())
        assert np.allclose([own[f"contribution_{c}"] for c in FEATURES], shapley(len(FEATURES), value), atol=1e-9, rtol=0)


def test_only_trees_and_forests_have_tree_contributions(spark, frame):
    model = train.fit_model(train.LOGISTIC, frame.filter("split = 'train'"), ENTITY, FEATURES, {"maxIter": 5})
    with pytest.raises(ValueError, match="no tree"):
        tree_explain.classifier_table(model, spark)


# --- kernel -----------------------------------------------------------------------------------------


def random_softmax(n, seed=3):
    rng = np.random.default_rng(seed)
    names = tuple(f"f{i}" for i in range(n))
    return kernel_explain.SoftmaxModel(names, 1.5 * rng.standard_normal((3, n)), rng.standard_normal(3), rng.standard_normal(n), rng.random(n) + 0.5), rng


def softmax_value(model, scaled, ground, k):
    def value(known):
        mixed = np.array([scaled[j] if j in known else ground[j] for j in range(len(scaled))])
        logits = model.coef @ mixed + model.intercept
        return float(np.exp(logits[k]) / np.exp(logits).sum())

    return value


@pytest.mark.parametrize("n", [1, 2, 8])
def test_kernel_contributions_equal_all_subsets(spark, n):
    model, rng = random_softmax(n)
    x, ground = rng.standard_normal((6, n)) * 2, rng.standard_normal(n)
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in model.features)).repartition(2)
    got = kernel_explain.kernel_contributions(df, model, "id", ground, cells=600).orderBy("id").collect()
    for r, v in zip(got, x):
        value = softmax_value(model, (v - model.centre) / model.spread, ground, r.pred)
        found = [r[f"contribution_{c}"] for c in model.features]
        assert np.allclose(found, shapley(n, value), atol=1e-9, rtol=0)
        assert sum(found) == pytest.approx(value(set(range(n))) - r.expected, abs=1e-9)


def test_a_missing_feature_has_no_contribution(spark):
    model, _ = random_softmax(3)
    df = spark.createDataFrame([(1, 1.0, None, float("nan"))], "id long, f0 double, f1 double, f2 double")
    r = kernel_explain.kernel_contributions(df, model, "id").first()
    assert r.contribution_f1 == pytest.approx(0, abs=1e-12) and r.contribution_f2 == pytest.approx(0, abs=1e-12)


def test_error_of_sampled_coalitions_falls_with_their_number():
    """Largest errors of a contribution on 12 features, of outputs between 0 and 1: below 0.06 with 200 drawn
    coalitions and below 0.015 with 2,000 (all: 4,094). Sums stay exact."""
    model, rng = random_softmax(12)
    x = rng.standard_normal((5, 12))
    pred = kernel_explain._outputs(model, x).argmax(axis=1)
    found = {}
    for most in (200, 2000, 5000):
        z, w = kernel_explain.coalitions(12, most)
        assert len(z) <= most and (len(z) == 4094) == (most == 5000)
        found[most] = kernel_explain.contributions(x, pred, model, np.zeros(12), z, *kernel_explain.solution(z, w))
        change = kernel_explain._outputs(model, x)[range(5), pred] - kernel_explain._outputs(model, np.zeros(12))[pred]
        assert np.allclose(found[most].sum(axis=1), change)
    assert np.abs(found[200] - found[5000]).max() < 0.06
    assert np.abs(found[2000] - found[5000]).max() < 0.015


def test_kernel_contributions_of_a_fitted_model_sum_up(spark, frame):
    model = train.fit_model(train.LOGISTIC, frame.filter("split = 'train'"), ENTITY, FEATURES, {"maxIter": 30})
    rows = kernel_explain.kernel_contributions(frame, kernel_explain.softmax_model(model, spark), "entity_id")
    joined = rows.join(model.score(frame).selectExpr("entity_id", "pred as scored", "array(p0, p1, p2)[pred] as p"), "entity_id")
    total = sum(F.col(f"contribution_{c}") for c in FEATURES)
    bad = joined.where((F.col("pred") != F.col("scored")) | (F.abs(total - F.col("p") + F.col("expected")) > 1e-8))
    assert joined.count() == frame.count() and bad.isEmpty()
    long = explain.attribution(rows, FEATURES, "entity_id", top=3)
    assert long.count() == 3 * frame.count()


def test_looked_up_contributions_equal_those_by_row():
    """Rows on thresholds, missing and infinite values, and more rows than one block; the lowest value goes the way of any low one."""
    rng = np.random.default_rng(4)

    def grown(depth):
        nodes = {}

        def add(left_levels, weight):
            at = len(nodes)
            nodes[at] = (-1, -1, -1, 0.0, weight, rng.random(3))
            if left_levels:
                part = rng.uniform(0.2, 0.8)
                feature, threshold = int(rng.integers(5)), float(rng.integers(-2, 3))
                nodes[at] = (add(left_levels - 1, weight * part), add(left_levels - 1, weight * (1 - part)), feature, threshold, weight, None)
            return at

        add(depth, 100.0)
        return nodes

    table = tree_explain.tree_table([grown(5), grown(3)], np.array, 5, 3)
    x = rng.integers(-6, 7, (tree_explain.BLOCK + 50, 5)) / 2
    x[::7, 1], x[1::7, 2] = np.nan, -np.inf
    pred = rng.integers(0, 3, len(x))
    got = tree_explain.contributions(x, pred, table)
    plain = np.zeros_like(got)
    for group in table.groups:
        if group.share.shape[1]:
            tree_explain._by_row(plain, np.where(np.isnan(x), np.inf, np.maximum(x, -99)), pred, group)
    assert np.allclose(got, plain, atol=1e-12)
    assert [b.num_rows for b in tree_explain._gathered(iter([pa.record_batch({"a": [1]})] * 7), 3)] == [3, 3, 1]
