"""Streaming adapter, model-side operators and brute-force checks of the iterative ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from cohort.operators import causal as CA
from cohort.operators import explain as XP
from cohort.operators import models as MD
from cohort.operators import persona as PE
from cohort.operators import policy as P
from cohort.operators import survival as SV
from cohort.operators import split as S
from cohort.plans.audit import prepared_records
from cohort.session import checkpoint_dir
from cohort.sources.contract import STUDENT_CONTRACT
from cohort.sources.tables import records, table


def test_monitor_stream_over_arriving_files(spark, tmp_path):
    from cohort.streaming.monitor import read_drift, start_monitor
    r = records(spark, SF_MID)
    src = str(tmp_path / "in")
    r.where("row_id >= 3000000000").repartition(2).write.parquet(src)
    ref = r.where("row_id < 3000000000")
    q = start_monitor(spark, src, r.schema, ref, ["StudyTimeWeekly", "GPA"], str(tmp_path / "out"),
                      str(tmp_path / "ck"), contract=STUDENT_CONTRACT, trigger_once=True)
    q.awaitTermination(300)
    d = read_drift(spark, str(tmp_path / "out"))
    assert d.count() == 2 and set(d.columns) >= {"column_name", "psi", "status", "batch_id"}


def test_cox_matches_numpy(spark):
    rows = [(5.0, 1, 0.5, 1.0), (8.0, 1, 1.5, 0.0), (8.0, 1, 0.2, 1.0), (12.0, 0, 2.0, 0.0), (3.0, 1, 0.1, 1.0),
            (8.0, 0, 1.1, 1.0), (15.0, 1, 2.5, 0.0)]
    df = spark.createDataFrame(rows, "Duration double, Event int, a double, b double")
    fit = SV.cox_fit(df, ["a", "b"], penalizer=0.1)
    ref = SV.cox_numpy([r[0] for r in rows], [r[1] for r in rows], [[r[2], r[3]] for r in rows], penalizer=0.1)
    assert np.allclose(fit["coef"], ref, atol=1e-6)


def test_cox_hot_tie_time(spark):
    # one duration holds a third of the rows: Efron terms come in blocks, result still exact
    rng = np.random.default_rng(0)
    n = 900
    x = rng.normal(size=n)
    t = np.where(np.arange(n) < 300, 10.0, rng.integers(1, 30, n).astype(float))
    e = (rng.random(n) < 0.7).astype(int)
    df = spark.createDataFrame(list(zip(t.tolist(), e.tolist(), x.tolist())), "Duration double, Event int, x double")
    fit = SV.cox_fit(df, ["x"], penalizer=0.1)
    ref = SV.cox_numpy(t, e, x[:, None], penalizer=0.1)
    assert abs(fit["coef"][0] - ref[0]) < 1e-6


def test_matching_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    n = 400
    arm = rng.integers(0, 2, n)
    score = np.round(rng.random(n), 2)
    y = rng.normal(size=n)
    df = spark.createDataFrame(list(zip(range(n), arm.tolist(), score.tolist(), y.tolist())),
                               "id long, t int, s double, y double")
    got = {r.id: r.matched_outcome for r in CA.nearest_match(df, "id", "t", "s", "y", chunks=8).collect()}
    pdf = pd.DataFrame({"id": range(n), "t": arm, "s": score, "y": y})
    reps = pdf.sort_values("id").groupby(["t", "s"], as_index=False).first()
    for row in pdf.itertuples():
        other = reps[reps.t == 1 - row.t]
        dist = (other.s - row.s).abs()
        best = other[dist == dist.min()].sort_values("s").iloc[0]   # tie -> lower score
        assert abs(got[row.id] - best.y) < 1e-12


def test_permutation_keeps_treatment_counts(spark):
    r = prepared_records(spark, SF_MID)
    p = CA.permuted_treatment(r, "row_id", "InternetAccess", 3, seed=1)
    c = {tuple(x[:2]): x[2] for x in p.groupBy("replicate", "placebo").count().collect()}
    base = {x[0]: x[1] for x in r.groupBy("InternetAccess").count().collect()}
    for rep in (1, 2, 3):
        assert c[(rep, 1)] == base[1] and c[(rep, 0)] == base[0]


def test_running_action_values_match_pandas(spark):
    ev = table(spark, SF_MID, "events").select("event_id", F.col("event_type").alias("action"),
                                               (F.col("value") > 50).cast("int").alias("reward"))
    got = P.running_action_values(ev, "event_id", chunks=8).toPandas().sort_values("event_id")
    pdf = ev.toPandas().sort_values("event_id")
    pdf["cum"] = pdf.groupby("action")["reward"].cumsum()
    pdf["n"] = pdf.groupby("action").cumcount() + 1
    assert np.allclose(got["running_value"].to_numpy(), (pdf["cum"] / pdf["n"]).to_numpy())


def test_sample_with_replacement_size_and_membership(spark):
    r = records(spark, SF_MID)
    s = S.sample_with_replacement(r, "row_id", 5000, seed=3)
    assert s.count() == 5000
    assert s.join(r.select("row_id"), "row_id", "left_anti").count() == 0


def test_oversample_doubles_minority_within_range(spark):
    r = records(spark, SF_MID).na.fill(0)
    out = PE.oversample_minority(r, "row_id", "GradeClass", 4, ["StudyTimeWeekly", "Absences", "GPA"])
    before = r.where("GradeClass = 4").count()
    assert out.where("GradeClass = 4").count() == 2 * before
    syn = out.where("row_id < 0")
    lo, hi = r.where("GradeClass = 4").agg(F.min("GPA"), F.max("GPA")).first()
    a, b = syn.agg(F.min("GPA"), F.max("GPA")).first()
    assert lo <= a and b <= hi


def test_grid_clusters_find_blobs_and_noise(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(0, 0.05, (400, 2))
    b = rng.normal(3, 0.05, (400, 2))
    noise = rng.uniform(-5, 8, (40, 2))
    pts = np.vstack([a, b, noise])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    out = PE.grid_density_clusters(df, "x", "y", eps=0.1, min_samples=10, min_cluster_size=50).toPandas()
    labs_a = set(out[out.id < 400].cluster)
    labs_b = set(out[(out.id >= 400) & (out.id < 800)].cluster)
    assert len(labs_a - {-1}) == 1 and len(labs_b - {-1}) == 1 and labs_a != labs_b
    assert (out[out.id >= 800].cluster == -1).mean() > 0.8


def test_shapley_sums_to_prediction_gap(spark):
    d = prepared_records(spark, SF_MID).withColumn("label", F.col("GradeClass").cast("double"))
    feats = ["StudyTimeWeekly", "Absences", "InternetAccess"]
    m = MD.forest_classifier("label", trees=10, depth=5).fit(MD.assemble(d, feats))
    sample = d.where("row_id % 97 = 0")
    bg = XP.background_sample(d, "row_id", 20)
    phi, base = XP.shapley_values(m, sample, "row_id", feats, 4, bg, samples=3, return_base=True)
    tot = {r[0]: r[1] for r in phi.groupBy("row_id").agg(F.sum("phi")).collect()}
    b = {r[0]: r[1] for r in base.collect()}
    fx = {r.row_id: r._f for r in XP._prob(m, sample, feats, 4, "_f").collect()}
    assert len(tot) == sample.count()
    for rid, s in tot.items():   # telescoping: sum of contributions = f(x) - mean f(background)
        assert abs(s - (fx[rid] - b[rid])) < 1e-9


def test_counterfactuals_change_only_allowed(spark):
    d = prepared_records(spark, SF_MID).withColumn("label", F.col("GradeClass").cast("double"))
    feats = ["StudyTimeWeekly", "Absences", "ParentalEducation", "InternetAccess"]
    m = MD.forest_classifier("label", trees=10, depth=5).fit(MD.assemble(d, feats))
    q = d.where("GradeClass = 4")
    cf = XP.counterfactuals(m, q, "row_id", feats, ["StudyTimeWeekly", "Absences"], 2, k=3)
    j = cf.join(q.select("row_id", F.col("ParentalEducation").alias("pe0"), F.col("InternetAccess").alias("ia0")),
                "row_id")
    assert j.where((F.col("pe0") != F.col("ParentalEducation")) | (F.col("ia0") != F.col("InternetAccess"))).count() == 0
    assert cf.groupBy("row_id").count().agg(F.max("count")).first()[0] <= 3
    ch = XP.changed_cells(cf, "row_id", ["StudyTimeWeekly", "Absences"])
    assert ch.where(F.col("from_value") == F.col("to_value")).count() == 0


def test_counterfactuals_keep_rows_out_of_reach(spark):
    d = prepared_records(spark, SF_SMALL).withColumn("label", F.col("GradeClass").cast("double"))
    feats = ["StudyTimeWeekly", "Absences", "ParentalEducation"]
    m = MD.forest_classifier("label", trees=5, depth=3).fit(MD.assemble(d, feats))
    q = d.where("GradeClass = 4").limit(20)
    cf = XP.counterfactuals(m, q, "row_id", feats, ["StudyTimeWeekly", "Absences"], 99, refine=6)
    assert cf.count() == q.count() > 0
    assert cf.where("cf_rank is null and StudyTimeWeekly is null and Absences is null and _o_Absences is not null").count() == q.count()


def test_searches_and_selection_have_the_reference_sizes(spark, monkeypatch):
    from cohort.plans import modeling as P
    seen = {}

    class Stop(Exception):
        pass

    def stop(name):
        def f(*args, **kw):
            seen[name] = args, kw
            raise Stop
        return f
    monkeypatch.setattr(P.MD, "grid_search", stop("grid"))
    monkeypatch.setattr(P.MD, "random_search", stop("random"))
    monkeypatch.setattr(P, "boruta_frame", stop("boruta"))
    monkeypatch.setattr(P.MD, "stacking_fit_predict", stop("stack"))
    for q in (P.q_grid, P.q_random, P.q_boruta, P.q_stack):
        with pytest.raises(Stop):
            q(spark, SF_SMALL)
    points = 1
    for values in seen["grid"][0][1].values():
        points *= len(values)
    assert points == 81 and seen["random"][0][2] == 50 and not seen["boruta"][1]
    bases = seen["stack"][0][5]
    assert (bases["rf"].getNumTrees(), bases["gbt"].max_iter, bases["mlp"].getMaxIter(), bases["mlp"].getLayers()[1:3]) == (200, 500, 500, [64, 32])


def test_ordinal_boost_probabilities_are_distributions(spark):
    d = MD.assemble(prepared_records(spark, SF_MID), ["StudyTimeWeekly", "Absences", "GPA"]).withColumn(
        "label", F.col("GradeClass").cast("double"))
    m = MD.OrdinalBoost(5, "label", max_iter=5, depth=3).fit(d)
    from pyspark.ml.functions import vector_to_array
    p = m.transform(d).select(vector_to_array("probability").alias("p")).toPandas()
    s = p["p"].apply(lambda v: (sum(v), min(v)))
    assert all(abs(a - 1) < 1e-9 and b >= -1e-12 for a, b in s)


def test_checkpoint_dir_is_reused(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)
