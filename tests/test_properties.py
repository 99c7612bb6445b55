"""Property and closed-form checks for operators without a SQL twin, plus the reference defects."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from cohort.functions import expressions as X
from cohort.operators import evaluate as EV
from cohort.operators import features as FE
from cohort.operators import hypothesis as H
from cohort.operators import monitor as M
from cohort.operators import policy as P
from cohort.operators import split as S
from cohort.sources.contract import STUDENT_CONTRACT, Contract, ContractViolation, assert_valid, validate
from cohort.sources.tables import records


@pytest.fixture(scope="module")
def rec(spark):
    return records(spark, SF_MID).cache()


def test_right_closed_bins_edges(spark):
    df = spark.createDataFrame([(2.0,), (2.5,), (3.0,), (3.5,), (-2.0,), (5.0,), (None,)], "x double")
    got = [r[0] for r in df.select(X.grade_class("x")).collect()]
    assert got == [4, 3, 2, 1, 4, 4, 4]


def test_clip_keeps_null_and_bround(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.5,), (9.0,)], "x double")
    assert [r[0] for r in df.select(X.clip("x", 0.0, 4.0)).collect()] == [None, 0.0, 2.5, 4.0]
    assert [r[0] for r in df.select(X.round_class("x")).collect()] == [None, -1, 2, 9]


def test_map_values_unmapped_is_null(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "s string")
    assert [r[0] for r in df.select(X.map_values("s", {"a": 1})).collect()] == [1, None, None]


def test_contract_missing_column_reported_alone(spark, rec):
    v = validate(rec.drop("GPA"), STUDENT_CONTRACT).collect()
    assert [(r.column_name, r.rule) for r in v] == [("GPA", "missing")]


def test_contract_null_is_not_in_and_no_nulls_opt_in(spark):
    c = Contract.from_dict({"columns": {"x": {"type": "int", "checks": {"isin": [0, 1]}}}})
    df = spark.createDataFrame([(0,), (None,)], "x int")
    got = {(r.rule): r.n_bad for r in validate(df, c).collect()}
    assert got["isin"] == 1
    strict = Contract(columns=c.columns, no_nulls=True, enforce_no_nulls=True)
    assert {r.rule: r.n_bad for r in validate(df, strict).collect()}["not_null"] == 1
    with pytest.raises(ContractViolation):
        assert_valid(df, c)


def test_contract_float_with_whole_values_is_int(spark):
    c = Contract.from_dict({"columns": {"x": {"type": "int"}}})
    ok = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    bad = spark.createDataFrame([(1.5,)], "x double")
    assert assert_valid(ok, c).schema["x"].dataType.simpleString() == "int"
    assert {r.rule: r.n_bad for r in validate(bad, c).collect()}["type"] == 1


def test_imputers_fill_all_and_keep_known(spark, rec):
    cols = ["ParentalEducation", "InternetAccess"]
    for est in (FE.MeanImputer(inputCols=cols), FE.ModeImputer(inputCols=cols)):
        out = est.fit(rec).transform(rec)
        assert out.where(F.col("ParentalEducation").isNull() | F.col("InternetAccess").isNull()).count() == 0
        j = rec.select("row_id", F.col("ParentalEducation").alias("o")).join(out.select("row_id", "ParentalEducation"),
                                                                           "row_id")
        assert j.where(F.col("o").isNotNull() & (F.col("o") != F.col("ParentalEducation"))).count() == 0


def test_mode_tie_goes_to_smallest(spark):
    df = spark.createDataFrame([(2.0,), (1.0,), (2.0,), (1.0,), (None,)], "x double")
    assert FE.ModeImputer(inputCols=["x"]).fit(df).getStats()["x"] == 1.0


def test_chained_imputer_recovers_linear_relation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=2000)
    y = 2 * x + 1 + rng.normal(scale=0.01, size=2000)
    ys = [None if i % 5 == 0 else float(v) for i, v in enumerate(y)]
    df = spark.createDataFrame(list(zip(range(2000), x.tolist(), ys)), "id long, x double, y double")
    out = FE.ChainedImputer(inputCols=["x", "y"]).fit(df).transform(df).toPandas()
    miss = out["id"] % 5 == 0
    assert np.abs(out.loc[miss, "y"] - (2 * out.loc[miss, "x"] + 1)).max() < 0.05


def test_robust_scaled_median_zero(spark, rec):
    out = FE.RobustScaler(inputCols=["StudyTimeWeekly"]).fit(rec).transform(rec)
    assert abs(out.agg(F.percentile("StudyTimeWeekly", 0.5)).first()[0]) < 1e-9


def test_yeo_johnson_lambda_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.exponential(2.0, size=3000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = FE.YeoJohnson(inputCols=["x"]).fit(df).getStats()["x"][0]

    def llf(lmb):
        t = np.log1p(x) if abs(lmb) < 1e-12 else ((x + 1) ** lmb - 1) / lmb
        return -len(x) / 2 * np.log(t.var()) + (lmb - 1) * np.sum(np.log1p(x))
    a, b = -2.0, 2.0          # golden-section search for the exact maximiser
    g = (5 ** 0.5 - 1) / 2
    for _ in range(200):
        c, d = b - g * (b - a), a + g * (b - a)
        if llf(c) > llf(d):
            b = d
        else:
            a = c
    assert abs(lam - (a + b) / 2) < 1e-6


def test_ordered_target_encoding_matches_window(spark, rec):
    p = rec.na.fill(0.0, ["ParentalEducation"])
    prior = float(p.agg(F.avg("GradeClass")).first()[0])
    enc, stats = FE.ordered_target_encode(p, "ParentalEducation", "GradeClass", "row_id", out="te")
    ref = FE.ordered_target_window_reference(p, "ParentalEducation", "GradeClass", "row_id", prior, "te_ref")
    j = enc.select("row_id", "te").join(ref.select("row_id", "te_ref"), "row_id")
    assert j.where(F.abs(F.col("te") - F.col("te_ref")) > 1e-12).count() == 0
    new = FE.apply_target_encoding(spark.createDataFrame([(99.0,)], "ParentalEducation double"), stats,
                                   "ParentalEducation", "te").first()["te"]
    assert abs(new - prior) < 1e-12


def test_splits_disjoint_complete_stratified(spark, rec):
    train, test = S.stratified_split(rec, "row_id", "GradeClass", 0.2, 42)
    a = {r[0] for r in train.select("row_id").collect()}
    b = {r[0] for r in test.select("row_id").collect()}
    assert not (a & b) and len(a | b) == rec.count()
    per = {r[0]: r[1] for r in rec.groupBy("GradeClass").count().collect()}
    got = {r[0]: r[1] for r in test.groupBy("GradeClass").count().collect()}
    for k, n in per.items():
        assert abs(got.get(k, 0) - n * 0.2) <= 1


def test_folds_partition_rows(spark, rec):
    f = S.stratified_folds(rec, "row_id", "GradeClass", 3, 42)
    assert f.count() == rec.count()
    sizes = [r[1] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 5


def test_kappa_identity_and_independence(spark, rec):
    q = EV.quadratic_kappa(rec, "GradeClass", "GradeClass").first()[0]
    assert abs(q - 1.0) < 1e-12


def test_kappa_matches_formula_on_reference_confusion(spark):
    # per-class support of the stored report; a perfect scorer must give 1 and a constant one 0
    rows = [(c, c) for c, n in zip(range(5), [31, 68, 1287, 214, 279]) for _ in range(n)]
    df = spark.createDataFrame(rows, "y int, p int")
    assert abs(EV.quadratic_kappa(df, "y", "p").first()[0] - 1.0) < 1e-12
    const = df.withColumn("p", F.lit(2))
    assert abs(EV.quadratic_kappa(const, "y", "p").first()[0]) < 1e-12


def stability_index(reference, current, bins=10, floor=1e-4):
    """By definition: share of each side's rows per half-open bin (the last one closed), counted one by one."""
    import math
    from statistics import quantiles
    known = sorted(x for x in reference if x is not None and x == x)
    values = sorted(set(known))
    if len(values) > bins:
        edges = sorted({known[0], *quantiles(known, n=bins, method="inclusive"), known[-1]})
    else:
        edges = [*values, values[-1] + 1e-10]

    def share(rows, i):
        last = i == len(edges) - 2
        inside = sum(1 for x in rows if x is not None and x == x and edges[i] <= x and (x <= edges[i + 1] if last else x < edges[i + 1]))
        return inside / len(rows) or floor
    total = 0.0
    for i in range(len(edges) - 1):
        before, after = share(reference, i), share(current, i)
        total += (after - before) * math.log(after / before)
    return total



def test_psi_identity_and_brute_force(spark, rec):
    cols = ["StudyTimeWeekly", "Absences", "GPA", "ParentalEducation"]
    same = M.psi(rec, rec, cols).collect()
    assert all(abs(r.psi) < 1e-12 for r in same)
    ref = rec.where("row_id < 3000000000")
    cur = rec.where("row_id >= 3000000000")
    got = {r.column_name: r.psi for r in M.psi(ref, cur, cols, outer="drop").collect()}
    pr, pc = ref.toPandas(), cur.toPandas()
    for c in cols:
        assert abs(got[c] - stability_index(pr[c].tolist(), pc[c].tolist())) < 1e-9


def test_psi_alarms_on_injected_drift(spark, rec):
    ref = rec.where("row_id < 3000000000")
    cur = ref.withColumn("StudyTimeWeekly", F.col("StudyTimeWeekly") * 0.7)
    st = {r.column_name: r.status for r in M.drift_status(M.psi(ref, cur, ["StudyTimeWeekly", "GPA"])).collect()}
    assert st["StudyTimeWeekly"] == "Drift Detected (Critical)" and st["GPA"] == "Stable"


def test_drift_status_on_stored_values(spark):
    # stored PSI values of the reference report -> its stored statuses
    t = spark.createDataFrame([("StudyTimeWeekly", 0.8565), ("Absences", 0.0395), ("GPA", 0.2195),
                               ("ParentalEducation", 0.1379)], "column_name string, psi double")
    st = {r.column_name: r.status for r in M.drift_status(t).collect()}
    assert st == {"StudyTimeWeekly": "Drift Detected (Critical)", "Absences": "Stable",
                  "GPA": "Drift Detected (Critical)", "ParentalEducation": "Warning"}


def test_disparities_from_stored_group_rates(spark):
    from cohort.operators.fairness import disparities
    t = spark.createDataFrame([("Gender", "0", 0.7687, 0.9401, 0.0), ("Gender", "1", 0.7037, 0.9350, 0.0),
                               ("InternetAccess", "0", 0.4010, 0.8208, 0.0),
                               ("InternetAccess", "1", 0.8952, 0.9625, 0.0)],
                              "attribute string, group_value string, selection_rate double, "
                              "true_positive_rate double, false_positive_rate double")
    d = {r.attribute: r for r in disparities(t).collect()}
    assert abs(d["Gender"].demographic_parity_diff - 0.0650) < 1e-9
    assert abs(d["InternetAccess"].demographic_parity_diff - 0.4942) < 1e-9
    assert abs(d["InternetAccess"].tpr_diff - 0.1417) < 1e-3


def test_ips_uplift_and_roi_arithmetic(spark):
    log = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("b", 1, 0.5), ("b", 1, 0.5)],
                                "action string, reward int, propensity double")
    r = P.ips_value(log, "b").first()
    assert abs(r.logged_value - 0.75) < 1e-12 and abs(r.ips_value - 1.0) < 1e-12
    assert abs(r.uplift_pct - 100 * (1.0 - 0.75) / 0.75) < 1e-9
    # stored report: 0.3320 -> 0.5760 is 73.5 %
    assert round((0.5760 - 0.3320) / 0.3320 * 100, 1) == 73.5
    kpi = spark.createDataFrame([(2000,)], "at_risk long")
    roi = P.intervention_roi(kpi, cost_per=500.0, success_rate=0.40, value_per=20000.0, recall=0.85).first()
    assert abs(roi.net - 12.6e6) < 1e-6 and abs(roi.cost - 1.0e6) < 1e-6


def test_mann_whitney_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 10, 500).astype(float)
    y = np.round(rng.normal(size=500) + 0.1 * g, 1)
    df = spark.createDataFrame(list(zip(g.tolist(), y.tolist())), "g double, y double")
    r = H.mann_whitney_batch(df, [("h", "g", "y")]).first()
    med = np.median(g)
    hi, lo = y[g > med], y[g <= med]
    ranks = pd.Series(np.concatenate([hi, lo])).rank().to_numpy()
    u1 = ranks[:len(hi)].sum() - len(hi) * (len(hi) + 1) / 2
    assert abs(r.u - u1) < 1e-9
    assert abs(r.u + (len(hi) * len(lo) - r.u) - len(hi) * len(lo)) < 1e-9
    n1, n2 = len(hi), len(lo)
    _, t = np.unique(np.concatenate([hi, lo]), return_counts=True)
    s = math.sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - (t ** 3 - t).sum() / ((n1 + n2) * (n1 + n2 - 1))))
    z = (max(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / s
    assert abs(r.z - z) < 1e-9 and abs(r.p_value - math.erfc(z / math.sqrt(2))) < 1e-6


def test_binary_group_uses_max_vs_min(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 3.0), (1, 4.0)], "g int, y double")
    r = H.mann_whitney_batch(df, [("h", "g", "y")]).first()
    assert r.n_high == 2 and r.n_low == 2 and r.u == 4.0


def test_vif_uncentred(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(1000, 3))
    X[:, 2] = X[:, 0] + 0.1 * rng.normal(size=1000)
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], "a double, b double, c double")
    got = {f: v for f, v, _ in H.vif(df, ["a", "b", "c"])}
    G = X.T @ X
    inv = np.linalg.inv(G)
    for i, c in enumerate("abc"):
        assert abs(got[c] - G[i, i] * inv[i, i]) < 1e-6


def test_pc_recovers_collider(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=5000)
    b = rng.normal(size=5000)
    c = a + b + 0.5 * rng.normal(size=5000)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c)], "a double, b double, c double")
    e = {(r.src, r.dst, r.kind) for r in H.causal_edges(df, ["a", "b", "c"]).collect()}
    assert e == {("a", "c", "directed"), ("b", "c", "directed")}


def test_bayesian_ridge_from_gram_matches_data_matrix_version():
    rng = np.random.default_rng(7)
    X = rng.normal(size=(300, 3))
    y = X @ np.array([1.0, -2.0, 0.5]) + 3 + rng.normal(scale=0.5, size=300)
    A = np.hstack([np.ones((300, 1)), X])
    got = FE.bayesian_ridge_from_gram(A.T @ A, A.T @ y, float(y @ y))
    # same evidence updates on the centred data matrix via its SVD
    Xc, yc = X - X.mean(0), y - y.mean()
    U, S, Vt = np.linalg.svd(Xc, full_matrices=False)
    eig = S ** 2
    alpha, lam = 1 / (yc.var() + np.finfo(float).eps), 1.0
    old = None
    for _ in range(300):
        coef = Vt.T @ ((Vt @ (Xc.T @ yc)) / (eig + lam / alpha))
        rmse = np.sum((yc - Xc @ coef) ** 2)
        gamma = np.sum(alpha * eig / (lam + alpha * eig))
        lam = (gamma + 2e-6) / (np.sum(coef ** 2) + 2e-6)
        alpha = (300 - gamma + 2e-6) / (rmse + 2e-6)
        if old is not None and np.sum(np.abs(old - coef)) < 1e-3:
            break
        old = coef
    coef = Vt.T @ ((Vt @ (Xc.T @ yc)) / (eig + lam / alpha))
    want = [y.mean() - X.mean(0) @ coef] + list(coef)
    assert np.allclose(got, want, atol=1e-8)


def test_label_codes_sorted_and_unseen_raises(spark):
    from cohort.operators.clean import apply_label_codes, label_dimension
    train = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "s string")
    dim = label_dimension(train, "s", "code")
    assert sorted((r.s, r.code) for r in dim.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    ok = apply_label_codes(spark.createDataFrame([("c",), (None,)], "s string"), dim, "s", "code")
    assert sorted((r.s or "", r.code if r.code is not None else -1) for r in ok.collect()) == [("", -1), ("c", 2)]
    with pytest.raises(ValueError):
        apply_label_codes(spark.createDataFrame([("z",)], "s string"), dim, "s", "code")


def test_read_first_only_skips_missing_paths(spark, tmp_path):
    from cohort.sources.io import read_first
    df = read_first(spark, [str(tmp_path / "nope"), f"{SF_MID}/region.parquet"])
    assert df.count() == 5
    bad = tmp_path / "not_parquet"
    bad.mkdir()
    (bad / "part-0.parquet").write_text("this is not parquet")
    with pytest.raises(Exception) as e:
        read_first(spark, [str(bad), f"{SF_MID}/region.parquet"]).count()
    assert "nope" not in str(e.value)
    with pytest.raises(FileNotFoundError):
        read_first(spark, [str(tmp_path / "a"), str(tmp_path / "b")])


def test_minmax_keeps_null_and_survives_flat_columns(spark):
    t = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None), (None, 5.0, None)], "a double, b double, c double")
    out = FE.MinMaxScaler(inputCols=["a", "b", "c"]).fit(t).transform(t).collect()
    assert [r["a"] for r in out] == [0.0, 1.0, None]
    assert [r["b"] for r in out] == [0.0, 0.0, 0.0] and [r["c"] for r in out] == [None, None, None]
