"""Trained models, scoring, contributions, what-if, store and stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark import STUDENT, Override
from riskspark.operators import boosting, cohort, evaluate, explain, score, train
from riskspark.plans import model_queries  # noqa: F401  (registers the queries)
from riskspark.plans.binding import ENTITY, entity_table, fixed_scorer, labelled, table
from riskspark.plans.registry import QUERIES
from riskspark.sources import model_store
from riskspark.sources.staging import work_path
from riskspark.sources.tables import csv_export, csv_ingest
from riskspark.streaming.scoring import score_stream

SF_DIR = "/root/testdata/sf0.001"
FEATURES = ["s1", "s2", "s3", "s4", "s5", "s6"]
SMALL = {train.LOGISTIC: {"maxIter": 30}, train.FOREST: {"numTrees": 5, "maxDepth": 4}, train.BOOSTED: {"maxIter": 3, "maxDepth": 3}}


@pytest.fixture(scope="module")
def frame(spark):
    return train.training_frame(entity_table(spark, SF_DIR), ENTITY)


@pytest.fixture(scope="module")
def models(frame):
    rows = frame.filter("split = 'train'")
    return {n: train.fit_model(n, rows, ENTITY, FEATURES, SMALL.get(n)) for n in train.MODELS}


@pytest.mark.parametrize("name", train.MODELS)
def test_probabilities_sum_to_one_and_prediction_is_the_largest(frame, models, name):
    rows = models[name].score(frame).select("p0", "p1", "p2", "pred").collect()
    p = np.array([r[:3] for r in rows], dtype=float)
    assert np.allclose(p.sum(axis=1), 1.0)
    assert (p.argmax(axis=1) == [r["pred"] for r in rows]).all()


@pytest.mark.parametrize("name", train.MODELS)
def test_models_beat_the_majority_class(frame, models, name):
    scored = train.holdout_scores(models[name], frame, ENTITY)
    f1 = evaluate.macro_metrics(scored).first()["f1"]
    baseline = evaluate.macro_metrics(scored.withColumn("pred", F.lit(1))).first()["f1"]
    assert f1 > baseline + 0.1


def test_same_seed_gives_the_same_model(frame, models):
    again = train.fit_model(train.FOREST, frame.filter("split = 'train'"), ENTITY, FEATURES, SMALL[train.FOREST])
    assert again.importances == models[train.FOREST].importances


@pytest.mark.parametrize("name", [train.TREE, train.FOREST, train.BOOSTED])
def test_importances_sum_to_one(models, name):
    assert sum(v for _, v in models[name].importances) == pytest.approx(1.0)


def test_training_fails_on_a_column_without_values(frame):
    with pytest.raises(Exception, match="(?i)null"):
        train.fit_model(train.TREE, frame.withColumn("s1", F.lit(None).cast("double")), ENTITY, FEATURES)


def test_train_all_tables(spark):
    run = train.train_all(
        entity_table(spark, SF_DIR), ENTITY.with_(main_model=train.TREE), (train.LOGISTIC, train.TREE), SMALL, folds=3
    )
    assert run.out_of_fold.count() == 2 * run.frame.count()  # once per model
    rows = {r["model"]: r for r in run.tables["comparison"].collect()}
    assert set(rows) == {train.LOGISTIC, train.TREE} and rows[train.TREE]["main"] == "★"
    assert rows[train.LOGISTIC]["cv_text"] == f"{rows[train.LOGISTIC]['cv_mean']:.4f} ± {rows[train.LOGISTIC]['cv_std']:.4f}"
    assert run.tables["fold_scores"].count() == 6 and run.tables["confusion"].count() == 18
    path = work_path(spark, "run")
    model_store.save_run(run, path)
    assert model_store.load_table(spark, path, "comparison").count() == 2


def test_split_and_fold_are_stored_with_the_rows(spark, frame):
    """Every fit reads the frame several times, so it is a plain table."""
    for rows in (frame, train.training_frame(entity_table(spark, SF_DIR), ENTITY, impute_on_train=True)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "md5" not in plan and {"split", "fold", "label", "s1"} <= set(rows.columns)


def test_impute_on_train_rows_only(spark):
    out = train.training_frame(entity_table(spark, SF_DIR), ENTITY, impute_on_train=True)
    raw = entity_table(spark, SF_DIR).select("entity_id", F.col("s1").alias("raw"))
    rows = out.join(raw, "entity_id").select("s1", "raw", "split").collect()
    median = np.median([r["raw"] for r in rows if r["raw"] is not None and r["split"] == "train"])
    assert {r["s1"] for r in rows if r["raw"] is None} == {median}


@pytest.mark.parametrize("name", [train.LOGISTIC, train.BOOSTED])
def test_saved_model_scores_the_same(spark, frame, models, name):
    path = work_path(spark, "store")
    model_store.save_models(spark, {name: models[name]}, path)
    loaded = model_store.load_models(spark, path)[name]
    cols = ("entity_id", "p0", "p1", "p2", "pred")
    want = {r[0]: r[1:] for r in models[name].score(frame).select(*cols).collect()}
    assert {r[0]: r[1:] for r in loaded.score(frame).select(*cols).collect()} == want


def test_score_table_marks_training_rows(frame, models):
    out = score.score_table(frame, models[train.TREE].score, ENTITY)
    assert out.filter("is_train <> (split = 'train')").count() == 0
    assert out.filter("confidence <> greatest(pct_high, pct_medium, pct_low)").count() == 0


def test_missing_features_of_a_record_count_as_zero(spark):
    df = spark.createDataFrame([(1, 10.0, None, "3-MEDIUM")], "entity_id int, s1 double, s2 double, prio string")
    row = score.complete_record(df, ENTITY, ["s1", "s2", "s3", "prio_enc", "seg_enc"]).first()
    assert (row["s1"], row["s2"], row["s3"], row["prio_enc"], row["seg_enc"]) == (10.0, 0.0, 0.0, 2.0, 0.0)


def test_student_presets(spark):
    rows = {r["preset"]: r for r in score.complete_record(
        score.profile_presets(spark, STUDENT), STUDENT, STUDENT.features).collect()}
    assert rows["riesgo"]["Dept_enc"] == 3.0 and rows["tipico"]["FamilyInc_enc"] == 1.0
    assert rows["riesgo"]["Stress_Level (1-10)"] == 9.0


def test_sampled_contributions_sum_to_the_difference_from_the_background(spark, frame, models):
    model = models[train.FOREST]
    background = {c: 50.0 for c in FEATURES}
    rows = frame.select("entity_id", *FEATURES)
    out = explain.sampled_contributions(rows, model.score, FEATURES, background, "entity_id", pairs=2).collect()
    base = model.score(spark.createDataFrame([tuple(background.values())], ", ".join(f"{c} double" for c in FEATURES))).first()
    own = {r["entity_id"]: r for r in model.score(rows).collect()}
    assert len(out) == frame.count()
    for r in out:
        k = r["pred"]
        assert sum(r[f"contribution_{c}"] for c in FEATURES) == pytest.approx(own[r["entity_id"]][f"p{k}"] - base[f"p{k}"])


def test_sampled_contributions_equal_the_closed_form_of_a_linear_scorer(spark):
    weights = {"s3": 0.004, "s4": 0.003, "s6": 0.002}
    total = " + ".join(f"{w}D * {c}" for c, w in weights.items())

    def scorer(df):
        return df.selectExpr("*", f"{total} as p0", "0D as p1", "0D as p2", "0 as pred")

    df = entity_table(spark, SF_DIR, context=False).select("entity_id", *weights)
    means = df.agg(*[F.avg(c).alias(c) for c in weights]).first().asDict()
    got = explain.sampled_contributions(df, scorer, list(weights), means, "entity_id", pairs=1)
    want = {r["entity_id"]: r for r in explain.linear_contributions(df, weights, "entity_id").collect()}
    for r in got.collect():
        for c in weights:
            assert r[f"contribution_{c}"] == pytest.approx(want[r["entity_id"]][f"contribution_{c}"], abs=1e-12)


def test_attribution_order_and_direction(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 0.1, -0.5, None)], "id int, a double, b double, c double, contribution_a double, contribution_b double, contribution_c double")
    rows = explain.attribution(df, ["a", "b", "c"], "id", top=2).collect()
    assert [(r["rank"], r["feature"], r["direction"]) for r in rows] == [(1, "b", "lowers"), (2, "a", "raises")]


def test_what_if_stays_within_limits(spark):
    df = spark.createDataFrame([(1, 38.0, 2, 95.0, 50.0), (2, 10.0, 9, None, 99.0)], "Student_ID int, `Study_Hours_per_Week` double, `Stress_Level (1-10)` int, `Attendance (%)` double, Projects_Score double")
    seen = {}

    def scorer(rows):
        seen["last"] = rows
        return rows.selectExpr("*", "0.2D as p0", "0.3D as p1", "0.5D as p2", "if(`Stress_Level (1-10)` < 2, 2, 1) as pred")

    out = {r["Student_ID"]: r["change"] for r in explain.what_if(df, scorer, {"default": STUDENT.overrides}, STUDENT).collect()}
    assert out == {1: "better", 2: "no change"}
    after = {r["Student_ID"]: r for r in seen["last"].collect()}
    first = after[1]
    assert (first["Study_Hours_per_Week"], first["Stress_Level (1-10)"], first["Attendance (%)"], first["Projects_Score"]) == (40.0, 1.0, 100.0, 60.0)
    assert after[2]["Attendance (%)"] is None and after[2]["Projects_Score"] == 100.0


def test_what_if_in_the_other_direction(spark):
    df = entity_table(spark, SF_DIR, context=False)
    out = explain.what_if(df, fixed_scorer(), {"drop": [Override("s6", -40.0, 0.0, None)]}, ENTITY, ("s1", "s3", "s4", "s5", "s6"))
    assert out.filter("change = 'better'").count() == 0 and out.filter("change = 'worse'").count() > 0


def test_alert_ties_go_by_key_and_rounding_comes_first(spark):
    df = spark.createDataFrame(
        [(3, 0, 0.6004, 0.2, 0.1996), (1, 0, 0.6003, 0.2, 0.1997), (2, 1, 0.1, 0.5996, 0.3004), (4, 0, 0.5994, 0.3, 0.1006)],
        "entity_id int, pred int, p0 double, p1 double, p2 double",
    )
    scored = score.add_percentages(df, ENTITY)
    kept = cohort.alert_filter(scored, ENTITY, (), None, 60.0)
    assert [r["entity_id"] for r in cohort.alert_ranking(kept, ENTITY, None).collect()] == [1, 3, 2]
    assert [r["entity_id"] for r in cohort.top_high_risk(kept, ENTITY, 1).collect()] == [1]


def test_macro_metrics_by_hand(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (1, 1), (1, 2)]
    df = spark.createDataFrame(pairs, "label int, pred int")
    row = evaluate.macro_metrics(df).first()
    assert row["accuracy"] == 0.6
    assert row["precision"] == round((1 + 2 / 3 + 0) / 3, 4)
    assert row["recall"] == round((0.5 + 2 / 3 + 0) / 3, 4)
    assert row["f1"] == round((2 / 3 + 2 / 3 + 0) / 3, 4)
    cells = {(r["label"], r["pred"]): r["n"] for r in evaluate.confusion_matrix(df).collect()}
    assert len(cells) == 9 and cells[2, 2] == 0 and cells[1, 1] == 2
    # a class in neither truth nor prediction does not count
    two = evaluate.macro_metrics(df.filter("pred < 2")).first()
    assert two["recall"] == round((0.5 + 1) / 2, 4)


def test_best_flag_marks_ties_and_ignores_missing_values(spark):
    df = spark.createDataFrame([("a", "f1", 0.9), ("b", "f1", 0.9), ("c", "f1", None), ("a", "auc", 0.5)], "model string, metric string, value double")
    got = {(r["model"], r["metric"]): r["is_best"] for r in cohort.best_metric_flag(df).collect()}
    assert got == {("a", "f1"): True, ("b", "f1"): True, ("c", "f1"): False, ("a", "auc"): True}


def test_leakage_delta_without_auc(spark):
    df = spark.createDataFrame([("full", "f1", 0.9), ("part", "f1", 0.6), ("full", "roc_auc", None), ("part", "roc_auc", 0.7)], "model string, metric string, value double")
    got = {r["metric"]: (r["delta"], r["gap"]) for r in evaluate.leakage_delta(df, "full", "part", 12).collect()}
    assert got == {"f1": (-0.3, 0.3), "roc_auc": (None, None)}


def test_stream_over_several_files_equals_batch(spark):
    source = work_path(spark, "arriving")
    rows = table(spark, SF_DIR, "orders").selectExpr("o_orderkey as entity_id", "o_totalprice / 5000D as s6")
    rows.repartition(3).write.parquet(source)
    sink, marks = work_path(spark, "sink"), work_path(spark, "marks")
    features = ("s1", "s3", "s4", "s5", "s6")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    assert score_stream(arriving, fixed_scorer(), ENTITY, sink, marks, features).awaitTermination(120)
    batch = score.score_partial(rows, fixed_scorer(), ENTITY, features)
    got = spark.read.parquet(sink).select(*batch.columns)
    assert got.count() == batch.count()
    assert got.exceptAll(batch).count() == 0


def test_csv_tokens_types_and_export(spark):
    path = work_path(spark, "csv")
    lines = ["id,score,name,age", "1,NA,None,20", "2, 7.5 ,nan,21", "3,,\"a, b\",22.0", "4,oops,x,"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    df = csv_ingest(spark, path, {"id": "bigint", "score": "double", "age": "int"})
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, None, None, 20), (2, 7.5, None, 21), (3, None, "a, b", 22), (4, None, "x", None),
    ]
    kinds = dict(csv_ingest(spark, path).dtypes)
    assert kinds == {"id": "bigint", "score": "string", "name": "string", "age": "double"}
    out = csv_export(df, work_path(spark, "out"), STUDENT, "Random Forest", single_file=True)
    assert out.endswith("/alertas_academicas_random_forest.csv")
    assert csv_ingest(spark, out, dict(df.dtypes)).exceptAll(df).count() == 0


def test_corrupt_csv_rows_are_kept_visible(spark):
    path = work_path(spark, "csv")
    spark.createDataFrame([("a,b\n1,2\n3,4,5",)], "value string").coalesce(1).write.text(path)
    df = csv_ingest(spark, path, {"a": "int", "b": "int"}, keep_corrupt=True)
    assert {r["a"]: r["_corrupt_record"] for r in df.collect()} == {1: None, 3: "3,4,5"}


def test_fixed_scorer_is_evaluated_once(spark):
    """A filter on a derived percent must not copy the scoring expression below it."""
    df = score.add_percentages(fixed_scorer()(labelled(entity_table(spark, SF_DIR, context=False))), ENTITY)
    plan = df.filter("confidence >= 60")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1
    assert "Filter" in plan.split("Generate inline", 1)[0]


@pytest.mark.parametrize("together", [train.TOGETHER_ROWS, 0])
def test_the_boosted_query_has_the_full_settings(spark, monkeypatch, together):
    """Every class gets the rounds and the depth of the library. Only the test cuts them short, after noting them."""
    noted, fit = [], train.GBTClassifier.fit

    def short(self, data):
        noted.append([self.getOrDefault(p) for p in ("maxIter", "maxDepth", "stepSize", "maxBins")])
        return fit(self.setMaxIter(1).setMaxDepth(2), data)

    monkeypatch.setattr(train.GBTClassifier, "fit", short)
    monkeypatch.setattr(train, "TOGETHER_ROWS", together)
    rows = QUERIES["train_boosted"](spark, SF_DIR).collect()
    assert len(rows) == 1 and noted == [[200, 6, 0.1, 128]] * 3


# --- joint boosting -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def joint(frame):
    return boosting.fit_joint(frame.filter("split = 'train'"), ENTITY, FEATURES, {"maxIter": 6, "maxDepth": 4, "stepSize": 0.3})


def test_joint_boosting_lowers_the_log_loss_every_round(frame, joint):
    assert len(joint.losses) == 7 and all(b < a for a, b in zip(joint.losses, joint.losses[1:]))
    rows = joint.score(frame.filter("split = 'train'")).select("label", "p0", "p1", "p2", "pred").collect()
    p = np.array([r[1:4] for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == [r["pred"] for r in rows]).all()
    loss = -np.log(p[np.arange(len(p)), [r["label"] for r in rows]]).mean()
    assert loss == pytest.approx(joint.losses[-1], rel=1e-9)


def test_leaf_values_are_newton_steps(frame, joint):
    """The first round by hand: residuals and curvatures at the class shares, per leaf."""
    rows = frame.filter("split = 'train'").select(*FEATURES, "label").collect()
    x, y = np.array([[float(v) for v in r[:-1]] for r in rows]), np.array([r["label"] for r in rows])
    share = np.exp(joint.start)
    assert share == pytest.approx(np.bincount(y, minlength=3) / len(y))
    for k, tree in enumerate(joint.rounds[0]):
        at = tree.leaves(x)
        for leaf in np.unique(at):
            n = (at == leaf).sum()
            want = 0.3 * ((y[at == leaf] == k) - share[k]).sum() / (n * share[k] * (1 - share[k]) + 1.0)
            assert tree.value[leaf] == pytest.approx(want) and tree.weight[leaf] == n


def test_joint_boosting_beside_one_model_per_class(frame, joint):
    """With equal rounds, depth and step the joint model's held-out log loss is no worse than that of one-vs-rest."""
    apart = train.fit_model(train.BOOSTED, frame.filter("split = 'train'"), ENTITY, FEATURES, {"maxIter": 6, "maxDepth": 4, "stepSize": 0.3})
    loss = {}
    for model in (joint, apart):
        held = train.holdout_scores(model, frame, ENTITY)
        loss[model.name] = held.selectExpr("avg(-ln(greatest(array(p0, p1, p2)[label], 1e-12)))").first()[0]
    assert loss[boosting.JOINT] <= loss[train.BOOSTED]


def test_margin_contributions_sum_up(frame, joint):
    rows = boosting.margin_contributions(frame.limit(200), joint, "entity_id").collect()
    x = np.array([[r[c] for c in FEATURES] for r in rows])
    margin = joint.margins(x)[np.arange(len(rows)), [r["pred"] for r in rows]]
    total = [r["expected"] + sum(r[f"contribution_{c}"] for c in FEATURES) for r in rows]
    assert np.allclose(total, margin, atol=1e-9)


def test_joint_boosting_makes_the_vectors_of_a_round_once(spark, monkeypatch):
    """Every tree reads kept vectors, and the result does not depend on how many trees grow side by side."""
    rows = spark.range(90).selectExpr("cast(id % 7 as double) as a", "cast(id % 11 as double) as b", "cast(id % 3 as int) as label")
    fit, plans = boosting.DecisionTreeRegressor.fit, []

    def seen(self, data, *rest):
        plans.append(data._jdf.queryExecution().toString())
        return fit(self, data, *rest)

    monkeypatch.setattr(boosting.DecisionTreeRegressor, "fit", seen)
    found = []
    for most in (boosting.TOGETHER_ROWS, 10):
        monkeypatch.setattr(boosting, "TOGETHER_ROWS", most)
        found.append(boosting.fit_joint(rows, ENTITY, ["a", "b"], {"maxIter": 2, "maxDepth": 2}))
    assert len(plans) == 12 and all("InMemoryRelation" in p for p in plans)
    assert found[0].losses == pytest.approx(found[1].losses) and found[0].losses[-1] < found[0].losses[0]


def test_joint_boosting_sends_no_row_to_python(spark, monkeypatch):
    """Leaves come from Spark's models; the numbers that they give are the leaves which the arrays of a tree find."""
    rows = spark.range(200).selectExpr("cast(id % 7 as double) as a", "cast(id * id % 11 as double) as b", "cast(id % 3 + id % 2 as int) % 3 as label")

    def refused(*_):
        raise AssertionError("rows go to Python")

    monkeypatch.setattr(type(rows), "mapInArrow", refused)
    model = boosting.fit_joint(rows, ENTITY, ["a", "b"], {"maxIter": 3, "maxDepth": 3})
    found = rows.collect()
    margins, label = model.margins(np.array([[r["a"], r["b"]] for r in found])), np.array([r["label"] for r in found])
    loss = np.log(np.exp(margins).sum(axis=1)) - margins[np.arange(len(label)), label]
    assert loss.mean() == pytest.approx(model.losses[-1], rel=1e-9) and model.losses[-1] < model.losses[0]
