"""Registered queries without a twin run from end to end, and give results that can be checked."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort.operators import aggregate as A
from cohort.operators import explain as XP
from cohort.plans import modeling as P
from cohort.plans import registry
from conftest import SF_SMALL

registry.load_all()


def test_what_if_profiles_go_through_the_features(spark):
    rows = registry.QUERIES["what_if_scenarios"](spark, SF_SMALL).collect()
    assert len({tuple(r[c] for c in P.FEATURES) for r in rows}) == len(rows) >= 8
    for r in rows:
        assert r["TechSynergy"] == pytest.approx(r["InternetAccess"] * r["StudyTimeWeekly"])
        assert r["SupportIndex"] == pytest.approx(r["ParentalEducation"] + r["Tutoring"] + r["InternetAccess"])
        assert r["AbsenceRisk"] == pytest.approx(r["Absences"] * (1 - r["InternetAccess"]))
        assert 0 <= r["risk"] <= 1 and r["pred_class"] in range(5) and r["advice"]


def test_scenario_grid_is_every_combination_once(spark):
    df = spark.createDataFrame([(float(i), 3.0, None) for i in range(11)], "a double, b double, c double")
    grid = XP.scenario_grid(df, ["a", "b", "flag"], {"g": 1.0}, points=3, values={"flag": [0.0, 1.0]})
    assert sorted(map(tuple, grid.collect())) == [(a, 3.0, f, 1.0) for a in (0.0, 5.0, 10.0) for f in (0.0, 1.0)]
    assert XP.scenario_grid(df, ["a", "c"]).count() == 0        # a column without values has no profile


def test_linear_coefficients_equal_least_squares(spark):
    cols = ["StudyTimeWeekly", "Absences", "Tutoring"]
    got = {r["term"]: r["coef"] for r in registry.QUERIES["linear_regression_gpa"](spark, SF_SMALL).collect()}
    d = P.prepared_records(spark, SF_SMALL).select(*cols, "GPA").toPandas().astype(float)
    X = np.column_stack([d[cols].to_numpy(), np.ones(len(d))])
    want = np.linalg.lstsq(X, d["GPA"].to_numpy(), rcond=None)[0]
    assert [got[t] for t in [*cols, "intercept"]] == pytest.approx(want, abs=1e-4)


def test_searches_run_from_end_to_end(spark, monkeypatch):
    """The query bodies at one trial each; the sizes have a test of their own."""
    grid, random = P.MD.grid_search, P.MD.random_search

    def small_grid(est, values, *args):
        return grid(est, {p: v[:1] if p.name != "numTrees" else [2, 3] for p, v in values.items()}, *args)

    def small_random(est, space, trials, *args):
        return random(est.copy({est.maxIter: 2}), {p: s for p, s in space.items() if p.name not in ("maxIter", "maxDepth")}, 1, *args)
    monkeypatch.setattr(P.MD, "grid_search", small_grid)
    monkeypatch.setattr(P.MD, "random_search", small_random)
    assert registry.QUERIES["grid_search_trials"](spark, SF_SMALL).count() == 2
    row = registry.QUERIES["random_search_trials"](spark, SF_SMALL).collect()
    assert len(row) == 1 and "stepSize" in row[0]["params"] and -1 <= row[0]["cv_qwk"] <= 1


def test_bootstrap_interval_equals_its_definition(spark):
    rows = [(i, "ab"[i % 2], float(i * i % 17)) for i in range(60)] + [(99, "b", None), (100, None, 2.0)]
    df = spark.createDataFrame(rows, "id int, g string, y double").repartition(3)
    got = {r["g"]: r for r in A.bootstrap_interval(df, ["g"], "y", "id", n_boot=50, seed=7).collect()}

    def weight(i, b):
        digits = hashlib.md5(f"{i}-{b // 4}-7".encode()).hexdigest()
        return sum(int(digits[b % 4 * 8:b % 4 * 8 + 8], 16) / 16 ** 8 >= c for c in A.POISSON_CDF)
    for g in ("a", "b", None):
        own = [(i, y) for i, h, y in rows if h == g and y is not None]
        means = []
        for b in range(50):
            w = [weight(i, b) for i, _ in own]
            if sum(w):
                means.append(sum(k * y for k, (_, y) in zip(w, own)) / sum(w))
        assert got[g]["n"] == len(own) and got[g]["mean"] == pytest.approx(np.mean([y for _, y in own]))
        assert (got[g]["ci_lo"], got[g]["ci_hi"]) == pytest.approx((np.quantile(means, 0.025), np.quantile(means, 0.975)))
    assert A.bootstrap_interval(df.where(F.lit(False)), ["g"], "y", "id", n_boot=5).count() == 0


def test_contract_survives_a_rules_table(spark, tmp_path):
    from cohort.sources import contract as CO
    c = CO.Contract({"a": CO.Rule("int", 0, 9), "b": CO.Rule("string", isin=("x,y", "z")), "c": CO.Rule("float", max=1.5)}, no_nulls=True, enforce_no_nulls=True)
    c.to_frame(spark).write.parquet(f"file://{tmp_path}/rules")
    assert CO.Contract.from_frame(spark.read.parquet(f"file://{tmp_path}/rules")) == c
    assert CO.Contract.from_frame(CO.STUDENT_CONTRACT.to_frame(spark)) == CO.STUDENT_CONTRACT
    with pytest.raises(ValueError):
        CO.Contract.from_frame(spark.createDataFrame([("a", "regex", "1")], "column_name string, rule string, arg string"))


def test_pca_projects_to_the_chosen_components(spark):
    from cohort.operators import hypothesis as H
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2)) @ np.array([[1.0, 0.5, 0.0], [0.0, 0.3, 1.0]]) + rng.normal(scale=0.05, size=(300, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    found = H.pca(df, ["a", "b", "c"], 0.9)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    eig, vec = np.linalg.eigh(np.cov(z.T))
    ratios = eig[::-1] / eig.sum()
    assert [r["ratio"] for r in found.table.collect()] == pytest.approx(list(ratios))
    assert found.k == int(np.searchsorted(np.cumsum(ratios), 0.9) + 1) == 2
    got = found.project(df).orderBy("id").toPandas()
    assert list(got.columns) == ["id", "a", "b", "c", "pc_1", "pc_2"]
    assert np.allclose(np.abs(got[["pc_1", "pc_2"]].to_numpy()), np.abs(z @ vec[:, ::-1][:, :2]), atol=1e-8)


def test_separated_pairs_name_their_sepset(spark):
    from cohort.operators import hypothesis as H
    rng = np.random.default_rng(2)
    a = rng.normal(size=2_000)
    b = a + 0.5 * rng.normal(size=2_000)
    c = b + 0.5 * rng.normal(size=2_000)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), c.tolist())), "a double, b double, c double")
    rows = {(r["src"], r["dst"]): r for r in H.causal_edges(df, ["a", "b", "c"], 0.01, separations=True).collect()}
    assert rows[("a", "c")]["kind"] == "separated" and rows[("a", "c")]["sepset"] == ["b"]
    assert all(r["sepset"] is None for r in rows.values() if r["kind"] != "separated")


def test_median_split_puts_missing_groups_low(spark):
    from cohort.operators import hypothesis as H
    df = spark.createDataFrame([(float(i), float(i)) for i in range(9)] + [(None, 50.0), (None, None)], "g double, y double")
    got = H.median_split_groups(df, [("t", "g", "y")]).groupBy("grp").count().collect()
    assert {r["grp"]: r["count"] for r in got} == {"High": 4, "Low": 6}
