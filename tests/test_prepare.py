"""Edge rows for labels, codes, imputation, correlations, rounding and filters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark import STUDENT
from riskspark.functions import class_label, display_name, entity_name, half_up, pearson, weighted_total
from riskspark.operators import cohort, prepare, profile, splits

CFG = STUDENT
NAN = float("nan")


def student(spark, rows):
    """Rows given as dicts; every other column gets a plain value."""
    base = {
        "Student_ID": "x", "First_Name": "A", "Last_Name": "B", "Total_Score": 70.0, "Attendance (%)": 80.0,
        "Midterm_Score": 60.0, "Final_Score": 60.0, "Assignments_Avg": 60.0, "Quizzes_Avg": 60.0,
        "Participation_Score": 60.0, "Projects_Score": 60.0, "Study_Hours_per_Week": 10.0,
        "Stress_Level (1-10)": 5, "Sleep_Hours_per_Night": 7.0, "Age": 20, "Gender": "Male", "Department": "CS",
        "Extracurricular_Activities": "No", "Internet_Access_at_Home": "Yes",
        "Parent_Education_Level": "PhD", "Family_Income_Level": "Low",
    }
    schema = ", ".join(f"`{c}` {t}" for c, t in CFG.column_types.items())
    filled = [{**base, "Student_ID": str(i), **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c] for c in CFG.column_types) for r in filled], schema)


def test_score_boundaries_and_missing_scores(spark):
    scores = [59.9, 60.0, 80.0, 80.1, None, NAN]
    out = prepare.prepare(student(spark, [{"Total_Score": s} for s in scores]), CFG).orderBy("Student_ID").collect()
    assert [r[CFG.label_col] for r in out] == [0, 1, 1, 2, 0, 0]
    assert [r["is_unscored"] for r in out] == [False] * 4 + [True] * 2


def test_unknown_and_missing_categories_are_code_zero(spark):
    rows = [{"Department": v} for v in ("Business", "Alchemy", None, "Mathematics")]
    out = prepare.prepare(student(spark, rows), CFG).orderBy("Student_ID").collect()
    assert [r["Dept_enc"] for r in out] == [3, 0, 0, 2]


def test_median_imputation_uses_the_mean_of_the_middle_values(spark):
    rows = [{"Attendance (%)": v} for v in (1.0, 2.0, 3.0, 10.0, None, NAN)]
    out = prepare.prepare(student(spark, rows), CFG).orderBy("Student_ID").collect()
    assert [r["Attendance (%)"] for r in out] == [1.0, 2.0, 3.0, 10.0, 2.5, 2.5]


def test_medians_can_be_fitted_on_some_rows(spark):
    rows = [{"Attendance (%)": v, "Age": a} for v, a in ((1.0, 20), (3.0, 20), (50.0, 30), (None, 30))]
    out = prepare.prepare(student(spark, rows), CFG, fit_on="Age = 20").orderBy("Student_ID").collect()
    assert out[3]["Attendance (%)"] == 2.0


def test_column_without_values_stays_null(spark):
    rows = [{"Quizzes_Avg": None}, {"Quizzes_Avg": None}]
    assert {r["Quizzes_Avg"] for r in prepare.prepare(student(spark, rows), CFG).collect()} == {None}


def test_approximate_medians(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    assert prepare.medians(df, ["x"], approximate=True).first()["p50"] == 50.0


def test_required_columns_are_checked_and_optional_ones_dropped(spark):
    df = student(spark, [{}])
    with pytest.raises(ValueError, match="Total_Score"):
        prepare.prepare(df.drop("Total_Score"), CFG)
    out = prepare.select_features(prepare.prepare(df.drop("Quizzes_Avg"), CFG), CFG)
    assert "Quizzes_Avg" not in out.columns and len(out.columns) == 2 + 16


def test_constant_column_correlations(spark):
    rows = [{"Total_Score": s, "Study_Hours_per_Week": 4.0, "Attendance (%)": a} for s, a in ((50.0, 1.0), (70.0, 2.0), (90.0, 4.0))]
    df = student(spark, rows)
    target = {r["feature"]: r["r"] for r in cohort.target_correlation(df, CFG).collect()}
    assert target["Study_Hours_per_Week"] == 0.0 and target["Attendance (%)"] == 0.982
    matrix = {(r["x"], r["y"]): r["r"] for r in cohort.correlation_matrix(df, ["Total_Score", "Study_Hours_per_Week"]).collect()}
    assert matrix["Total_Score", "Total_Score"] == 1.0
    assert matrix["Total_Score", "Study_Hours_per_Week"] is None
    assert matrix["Study_Hours_per_Week", "Study_Hours_per_Week"] is None


def test_listwise_and_pairwise_nulls_differ(spark):
    df = student(spark, [
        {"Total_Score": 1.0, "Attendance (%)": 1.0, "Midterm_Score": 5.0},
        {"Total_Score": 2.0, "Attendance (%)": 3.0, "Midterm_Score": None},
        {"Total_Score": 3.0, "Attendance (%)": 2.0, "Midterm_Score": 1.0},
        {"Total_Score": 4.0, "Attendance (%)": 9.0, "Midterm_Score": None},
        {"Total_Score": 5.0, "Attendance (%)": 4.0, "Midterm_Score": 7.0},
    ])
    listwise = {r["feature"]: r["r"] for r in cohort.target_correlation(df, CFG, ["Attendance (%)", "Midterm_Score"]).collect()}
    pairwise = {(r["x"], r["y"]): r["r"] for r in cohort.correlation_matrix(df, ["Total_Score", "Attendance (%)", "Midterm_Score"]).collect()}
    assert listwise["Attendance (%)"] == round(np.corrcoef([1, 3, 5], [1, 2, 4])[0, 1], 3)
    assert pairwise["Total_Score", "Attendance (%)"] == round(np.corrcoef([1, 2, 3, 4, 5], [1, 3, 2, 9, 4])[0, 1], 2)


def test_single_row_deviations(spark):
    df = student(spark, [{}])
    assert cohort.eda_summary(prepare.add_label(df, CFG), CFG).first()["std_total"] is None
    scaled = prepare.standard_scale(df, ["Age"], "true").first()
    assert scaled["Age_z"] == 0.0


def test_rounding_is_half_up(spark):
    assert spark.range(1).select(half_up("62.25D", 1).alias("x")).first()["x"] == 62.3


def test_group_counts_drop_missing_groups_and_keep_order(spark):
    rows = [{"Family_Income_Level": v} for v in ("High", "Low", None, "Medium", "Low")]
    df = prepare.add_label(student(spark, rows), CFG)
    out = cohort.group_risk_count(df, "Family_Income_Level", CFG.label_col, order=["Low", "Medium", "High"]).collect()
    assert [(r[0], r["n"]) for r in out] == [("Low", 2), ("Medium", 1), ("High", 1)]
    counts = cohort.value_counts(df, ["Family_Income_Level"]).collect()
    assert [(r["value"], r["n"]) for r in counts] == [("Low", 2), ("High", 1), ("Medium", 1)]


def test_empty_cohort_has_zero_counts_and_null_ratios(spark):
    df = prepare.add_label(student(spark, [{}]), CFG)
    row = cohort.cohort_kpis(df, CFG, {"Department": "Nowhere"}).first()
    assert (row["n"], row["n_total"], row["n_high"], row["pct_high"], row["avg_total"]) == (0, 1, 0, None, None)
    assert cohort.alert_kpis(df.withColumn("pred", F.lit(0)).filter("false")).first()["pct_high"] is None


def test_cohort_filter_skips_unset_conditions(spark):
    df = student(spark, [{"Age": a, "Gender": g} for a, g in ((18, "Male"), (20, "Female"), (25, "Male"))])
    ids = [r["Student_ID"] for r in cohort.cohort_filter(df, CFG, {"Gender": "Male", "Department": None}, age=(18, 24)).collect()]
    assert ids == ["0"]


def test_high_stress_contrast(spark):
    df = prepare.add_label(student(spark, [
        {"Stress_Level (1-10)": 9, "Total_Score": 50.0}, {"Stress_Level (1-10)": 8, "Total_Score": 70.0},
        {"Stress_Level (1-10)": 2, "Total_Score": 55.0}, {"Stress_Level (1-10)": 3, "Total_Score": 90.0},
        {"Stress_Level (1-10)": 4, "Total_Score": 85.0}, {"Stress_Level (1-10)": 5, "Total_Score": 90.0},
    ]), CFG)
    assert cohort.high_stress_filter(df, "Stress_Level (1-10)").count() == 2
    rows = cohort.cohort_contrast(df, CFG, {"stress": "`Stress_Level (1-10)` > 7"}, "Department").collect()
    whole = next(r for r in rows if r["cohort"] is None)
    assert (whole["n_in"], whole["n_out"], whole["relative_risk"], whole["score_gap"]) == (2, 4, 2.0, -20.0)


def test_profile_counts(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, NAN, "b"), (1, None, "a"), (2, NAN, "b")], "k int, x double, s string")
    assert profile.duplicate_count(df).first()["n_duplicates"] == 3
    row = profile.table_profile(df).first()
    assert (row["n_rows"], row["n_columns"], row["n_nulls"]) == (5, 3, 5)
    audit = {r["column_name"]: r["null_rate"] for r in profile.null_audit(df).collect()}
    assert audit == {"k": 0.0, "x": 1.0, "s": 0.0}


def test_student_dictionary_names_leaking_columns(spark):
    rows = {r["variable"]: r for r in profile.data_dictionary(student(spark, [{}]).drop("Age"), CFG).collect()}
    assert len(rows) == 18 and rows["Final_Score"]["is_leakage"] and not rows["Gender"]["is_leakage"]
    assert rows["Age"]["stored_type"] is None and rows["Gender"]["stored_type"] == "string"


def test_describe_uses_display_names(spark):
    df = student(spark, [{"Attendance (%)": v} for v in (1.0, 2.0, 4.0, None)])
    row = profile.describe_table(df, ["Attendance (%)"], CFG).first()
    assert (row["column_name"], row["n"], row["mean"], row["p50"], row["max"]) == ("Asistencia (%)", 3, 2.33, 2.0, 4.0)


def test_scalar_functions(spark):
    df = student(spark, [{"Midterm_Score": 10.0, "Final_Score": 20.0, "Projects_Score": 100.0}])
    assert df.selectExpr(f"{weighted_total(CFG.weights)} as t").first()["t"] == pytest.approx(1.5 + 5 + 9 + 6 + 3 + 30)
    named = df.select(entity_name(df.columns, CFG).alias("n"), display_name("Department", CFG).alias("d"))
    assert tuple(named.first()) == ("A B", "CS")
    assert df.drop("First_Name").select(entity_name(["Student_ID"], CFG).alias("n")).first()["n"] == "ID-0"
    assert spark.range(1).select(class_label("id", CFG).alias("c")).first()["c"] == "Riesgo Alto"
    assert spark.range(1).withColumn("i", F.lit(3)).select(entity_name([], CFG, "i").alias("n")).first()["n"] == "Est. 3"


def test_strict_behavioural_list_leaves_out_weighted_scores():
    assert "Participation_Score" in CFG.behavioural and "Participation_Score" not in CFG.strict_behavioural
    assert len(CFG.strict_behavioural) == 11


def labels_frame(spark, sizes):
    rows = [(i, k) for k, n in sizes.items() for i in range(10_000 * k, 10_000 * k + n)]
    return spark.createDataFrame(rows, f"Student_ID int, {CFG.label_col} int")


@pytest.mark.parametrize("sizes", [{0: 7, 1: 1000, 2: 93}, {0: 1, 1: 2, 2: 3}, {0: 500, 1: 500, 2: 1}])
def test_split_and_folds_keep_exact_quotas(spark, sizes):
    df = labels_frame(spark, sizes)
    n = sum(sizes.values())
    split = splits.stratified_split(df, CFG).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split}["test"] == math.ceil(0.2 * n)
    per_class = splits.stratified_split(df, CFG).filter("split = 'test'").groupBy(CFG.label_col).count().collect()
    for r in per_class:
        assert abs(r["count"] - math.ceil(0.2 * n) * sizes[r[0]] / n) < 1
    counts = {(r[0], r[1]): r[2] for r in splits.stratified_folds(df, CFG).groupBy(CFG.label_col, "fold").count().collect()}
    order = [k for k in sorted(sizes) for _ in range(sizes[k])]
    for k in sizes:
        for f in range(5):
            assert counts.get((k, f), 0) == sum(1 for c in order[f::5] if c == k)


def test_split_does_not_depend_on_partitioning(spark):
    df = labels_frame(spark, {0: 40, 1: 200, 2: 60})
    one = splits.stratified_split(df.repartition(1), CFG).filter("split = 'test'").select("Student_ID").collect()
    many = splits.stratified_split(df.repartition(9), CFG).filter("split = 'test'").select("Student_ID").collect()
    assert {r[0] for r in one} == {r[0] for r in many}


def test_pearson_text_is_one_for_a_line(spark):
    df = spark.range(10).selectExpr("cast(id as double) as x", "2D * id + 1 as y")
    assert df.selectExpr(f"{pearson('x', 'y')} as r").first()["r"] == pytest.approx(1.0)
