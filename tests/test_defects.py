"""One test per reference defect we do not reproduce."""

import math

from pyspark.sql import functions as F

from conftest import SF_MID
from cohort.operators import fairness as FA
from cohort.operators import features as FE
from cohort.operators import hypothesis as H
from cohort.operators import monitor as M
from cohort.operators import survival as SV
from cohort.operators.clean import present
from cohort.plans import modeling as MP
from cohort.plans.audit import prepared_records
from cohort.sources.contract import STUDENT_CONTRACT, Contract, validate
from cohort.sources.tables import _clamp_gpa, records


def test_d1_no_nulls_is_enforced_when_asked(spark):
    r = records(spark, SF_MID)
    strict = Contract(columns=STUDENT_CONTRACT.columns, no_nulls=True, enforce_no_nulls=True)
    bad = {(x.column_name, x.rule): x.n_bad for x in validate(r, strict).collect()}
    assert bad[("InternetAccess", "not_null")] > 0 and bad[("ParentalEducation", "not_null")] > 0
    parity = {(x.column_name, x.rule) for x in validate(r, STUDENT_CONTRACT).collect()}
    assert not any(rule == "not_null" for _, rule in parity)


def test_vif_of_collinear_columns_is_infinite(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i * i % 7), 0.0) for i in range(1, 30)], "x double, y double, z double, o double")
    got = {f: (v, high) for f, v, high in H.vif(df, ["x", "y", "z", "o"])}
    assert got["x"] == got["y"] == (math.inf, True)
    assert 1 <= got["z"][0] < 10 and math.isnan(got["o"][0])


def test_mann_whitney_of_a_constant_target(spark):
    df = spark.createDataFrame([("flat", "High" if i % 2 else "Low", 3.0) for i in range(8)]
                               + [("real", "High" if i > 3 else "Low", float(i)) for i in range(8)], "hypothesis string, grp string, y double")
    out = {r["hypothesis"]: r for r in H.mann_whitney(df).collect()}
    assert out["flat"]["p_value"] is None and 0 < out["real"]["p_value"] < 0.05


def test_event_without_exposure_has_no_duration(spark):
    df = spark.createDataFrame([(1, 4, None), (2, 4, 30.0), (3, 4, 0.0), (4, 0, None)], "k int, GradeClass int, Absences double")
    assert {r["k"]: r["Duration"] for r in SV.event_duration(df).collect()} == {1: None, 2: 1.0, 3: 40.0, 4: 40.0}


def test_null_score_stays_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-1.0,)], "x double").select(_clamp_gpa(F.col("x")).alias("x"))
    assert [r["x"] for r in df.collect()] == [None, 4.0, 0.0]


def test_d2_imputer_runs_before_any_fill(spark):
    r = records(spark, SF_MID).select("row_id", "ParentalEducation")
    m = FE.MeanImputer(inputCols=["ParentalEducation"]).fit(r)
    mean_observed = r.agg(F.avg("ParentalEducation")).first()[0]
    assert abs(m.getStats()["ParentalEducation"] - mean_observed) < 1e-12 and mean_observed > 0


def test_d3_binary_groups_compare_max_and_min(spark):
    from cohort.operators.hypothesis import mann_whitney_batch
    r = prepared_records(spark, SF_MID)
    res = mann_whitney_batch(r, [("t", "Tutoring", "GPA")]).first()
    n = r.where(F.col("Tutoring").isNotNull()).count()
    assert res.n_high > 0 and res.n_low > 0 and res.n_high + res.n_low == n


def test_d4_targets_are_never_scaled(spark):
    d = records(spark, SF_MID)
    from cohort.functions.expressions import interaction_features
    from cohort.operators.split import stratified_split
    d = interaction_features(d.na.fill(0, ["InternetAccess"]))
    tr, te = stratified_split(d, "row_id", "GradeClass", 0.2, 42)
    _, out = FE.column_group_transform(tr, te, ["StudyTimeWeekly", "Absences"], ["ParentalEducation"],
                                       ["Gender"], "GradeClass", "row_id")
    got = {x[0] for x in out.select("GradeClass").distinct().collect()}
    assert got <= {0, 1, 2, 3, 4}


def test_d5_source_tag_is_not_a_feature():
    assert "DatasetType" not in MP.FEATURES


def test_d6_equalized_odds_is_max_of_tpr_and_fpr_gaps(spark):
    t = spark.createDataFrame([("a", "0", 0.5, 0.9, 0.1), ("a", "1", 0.5, 0.8, 0.4)],
                              "attribute string, group_value string, selection_rate double, "
                              "true_positive_rate double, false_positive_rate double")
    r = FA.disparities(t).first()
    assert abs(r.tpr_diff - 0.1) < 1e-12 and abs(r.fpr_diff - 0.3) < 1e-12 and abs(r.equalized_odds_diff - 0.3) < 1e-12


def test_d7_scorer_column_is_a_parameter(spark):
    df = spark.createDataFrame([(1, 4, 0), (0, 0, 4)], "g int, actual int, predicted int")
    a = FA.selection_gap(df, "g", 1, 0, "actual").first().gap
    p = FA.selection_gap(df, "g", 1, 0, "predicted").first().gap
    assert a == -1.0 and p == 1.0


def test_d8_tuning_folds_come_from_training_rows_only(spark):
    train, test = MP._train_test(spark, SF_MID)
    from cohort.operators.split import stratified_folds
    f = stratified_folds(train, "row_id", "GradeClass", 3, 42)
    assert f.join(test.select("row_id"), "row_id").count() == 0


def test_d9_dependence_table_has_rows(spark):
    df = MP.q_dep(spark, SF_MID)
    assert df.count() > 0 and {"qbin", "mean_phi"} <= set(df.columns)


def test_d10_psi_open_outer_bins_count_outside_values(spark):
    ref = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    cur = spark.createDataFrame([(float(i),) for i in range(50, 150)], "x double")
    drop = M.psi(ref, cur, ["x"], outer="drop").first().psi
    opened = M.psi(ref, cur, ["x"], outer="open").first().psi
    assert drop != opened and opened > 0


def test_d11_missing_optional_columns_are_skipped(spark):
    d = records(spark, SF_MID)
    assert present(d, ["GPA", "ParentalSupport", "Absences"]) == ["GPA", "Absences"]
