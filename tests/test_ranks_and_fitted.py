"""Rank selection, fitted transformers, ordinal boosting, stacking, searches and shadow selection."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import functions as F

from cohort.operators import aggregate as A
from cohort.operators import features as FE
from cohort.operators import models as MD
from cohort.operators import ranks as R
from cohort.operators import selection as SL
from cohort.operators.column_groups import ColumnGroupModel, ColumnGroupTransformer
from cohort.operators.forest import forest_trees, prefix_counts
from cohort.operators.evaluate import kappa_of_counts, quadratic_kappa
from cohort.operators.ordinal import OrdinalBoost, OrdinalBoostModel
from cohort.operators.stacking import Stacking, StackingModel
from cohort.operators.split import stratified_folds
from cohort.session import materialize
from cohort.sources.tables import records
from conftest import SF_SMALL

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


# -- rank selection ---------------------------------------------------------------------------------

def quantiles_of(values):
    v = [x for x in values if x is not None and not math.isnan(x)]
    return [float(np.quantile(v, p)) for p in PROBS] if v else [None] * len(PROBS)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.just(math.nan), st.integers(-3, 3).map(float),
                                                                      st.floats(-1e6, 1e6))), max_size=60))
def test_group_quantiles_equal_numpy(spark, rows):
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got = {r["g"]: r for r in R.group_quantiles(df, ["x"], PROBS, ["g"]).collect()}
    assert set(got) == {g for g, _ in rows}
    for g, r in got.items():
        want = [x for h, x in rows if h == g and x is not None and not math.isnan(x)]
        assert r["n"] == len(want)
        assert r["q"] == pytest.approx(quantiles_of(want), rel=1e-12, abs=1e-9) if want else r["q"] == [None] * len(PROBS)
    whole = R.quantile_values(df, ["x"], PROBS)["x"]
    want = quantiles_of([x for _, x in rows])
    assert whole == want if None in want else whole == pytest.approx(want, rel=1e-12, abs=1e-9)


def test_ranks_with_hot_values_many_groups_and_a_missed_bracket(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i % 7, 5.0 if rng.random() < 0.6 else rng.gauss(0, 100)) for i in range(6_000)] + [(None, 1.0), (None, None)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(5)
    want = {g: quantiles_of([x for h, x in rows if h == g]) for g in {g for g, _ in rows}}
    plain = {r["g"]: r["q"] for r in R.group_quantiles(df, ["x"], PROBS, ["g"]).collect()}
    monkeypatch.setattr(R, "MAX_GROUPS", 3)
    many = {r["g"]: r["q"] for r in R.group_quantiles(df, ["x"], PROBS, ["g"]).collect()}
    monkeypatch.setattr(R, "MAX_GROUPS", 100)
    monkeypatch.setattr(R, "ACCURACY", 40)          # a coarse sketch: brackets of many values
    coarse = {r["g"]: r["q"] for r in R.group_quantiles(df, ["x"], PROBS, ["g"]).collect()}
    monkeypatch.setattr(R, "MARGIN", 0)             # brackets of one value miss and are widened
    widened = {r["g"]: r["q"] for r in R.group_quantiles(df, ["x"], PROBS, ["g"]).collect()}
    for got in (plain, many, coarse, widened):
        assert {g: pytest.approx(q, rel=1e-12) for g, q in want.items()} == got


def test_no_percentile_over_raw_rows(spark):
    """Neither the fits nor the tables use the aggregate that keeps all distinct values."""
    import inspect

    from cohort.operators import explain, hypothesis, monitor
    for module in (A, FE, R, explain, hypothesis, monitor):
        code = inspect.getsource(module)
        assert "F.percentile(" not in code and "F.mode(" not in code and "F.median(" not in code
    df = spark.range(50_000).select((F.col("id") % 1_000).cast("double").alias("x"), (F.col("id") % 3).alias("g"))
    counts = R._few_groups(df, ["g"], ["x"], [0.5], R._sketch(df, ["g"], ["x"], [0.5], R.MARGIN))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "partial_count" in plan


def test_mode_ties_nan_and_empty_columns(spark):
    df = spark.createDataFrame([("b", math.nan, None), ("a", math.nan, None), ("a", 2.0, None), ("b", 1.0, None), (None, None, None)],
                               "s string, x double, e int")
    assert R.mode_values(df, ["s", "x", "e"]) == {"s": "a", "x": 1.0, "e": None}
    out = FE.ModeImputer(inputCols=["s", "x", "e"]).fit(df).transform(df).collect()
    assert sorted(r["x"] for r in out) == [1.0, 1.0, 1.0, 1.0, 2.0] and [r["e"] for r in out] == [None] * 5


def test_tables_of_an_empty_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, x double")
    assert A.kde(df, "x").count() == 0
    assert [r["value"] for r in A.quantiles(df, ["x"], [0.5]).collect()] == [None]
    assert A.qcut_edges(df, "x") == []


# -- column groups ------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        a = rng.gauss(5, 2)
        rows.append((i, None if rng.random() < 0.1 else a, None if rng.random() < 0.1 else 2 * a + rng.gauss(0, 1),
                     rng.choice([0.0, 1.0, 2.0, None]), "hot" if rng.random() < 0.6 else rng.choice(["x", "y", None]), float(rng.random() < 0.4), "extra"))
    return spark.createDataFrame(rows, "id int, a double, b double, o double, n string, y double, extra string")


def test_column_groups_fit_save_load_and_score(spark, mixed, tmp_path):
    est = ColumnGroupTransformer(["a", "b"], ["o"], ["n"], "y", "id")
    train, new = mixed.where("id < 300"), mixed.where("id >= 300").unionByName(spark.createDataFrame([(900, 1.0, 2.0, 7.0, "unseen", None, "z")], mixed.schema))
    model, encoded = est.fit_transform(train)
    path = f"file://{tmp_path}/groups"
    model.write().save(path)
    loaded = ColumnGroupModel.load(path)
    assert sorted(loaded.transform(new).collect()) == sorted(model.transform(new).collect())
    assert sorted(loaded.transform_training(train).collect()) == sorted(encoded.collect())
    est.write().overwrite().save(f"file://{tmp_path}/est")
    assert ColumnGroupTransformer.load(f"file://{tmp_path}/est").groups() == est.groups()
    # the encodings themselves, from the definition
    rows = sorted(train.collect())
    fill = max(sorted({r["n"] for r in rows if r["n"]}), key=lambda v: sum(r["n"] == v for r in rows))
    prior = sum(r["y"] for r in rows) / len(rows)
    seen, want = {}, {}
    for r in rows:
        s, k = seen.get(r["n"] or fill, (0.0, 0))
        want[r["id"]] = (s + prior) / (k + 1)
        seen[r["n"] or fill] = (s + r["y"], k + 1)
    assert {r["id"]: r["n"] for r in encoded.collect()} == pytest.approx(want)
    scored = {r["id"]: r for r in model.transform(new).collect()}
    s, k = seen["hot"]
    hot = next(r["id"] for r in new.collect() if r["n"] == "hot")
    assert scored[hot]["n"] == pytest.approx((s + prior) / (k + 1))
    assert scored[900]["n"] == pytest.approx(prior) and scored[900]["o"] == -1.0 and scored[900]["y"] is None
    assert {r["o"] for r in encoded.collect()} == {0.0, 1.0, 2.0} and "extra" not in encoded.columns


def test_scoring_has_no_shuffle_of_the_rows(spark, mixed):
    model = ColumnGroupTransformer(["a"], ["o"], ["n"], "y", "id").fit(mixed)
    plan = model.transform(mixed)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


# -- chained imputation -------------------------------------------------------------------------------

def replay(rows, cols, rounds, tol):
    """Row-wise chained equations, straight from the definition."""
    x = np.array([[np.nan if v is None else v for v in r] for r in rows], float)
    miss = np.isnan(x)
    v = np.where(miss, np.nanmean(x, axis=0), x)
    order = sorted((i for i in range(len(cols)) if miss[:, i].any()), key=lambda i: (miss[:, i].sum(), i))
    done = 0
    for _ in range(rounds):
        old = v.copy()
        for i in order:
            others = [j for j in range(len(cols)) if j != i]
            X = np.column_stack([np.ones(len(v)), v[:, others]])[~miss[:, i]]
            y = x[~miss[:, i], i]
            b = FE.bayesian_ridge_from_gram(X.T @ X, X.T @ y, float(y @ y))
            v[miss[:, i], i] = (np.column_stack([np.ones(len(v)), v[:, others]]) @ np.array(b))[miss[:, i]]
        done += 1
        if np.abs(v - old).sum(axis=1).max() < tol * np.nanmax(np.abs(x)):
            break
    return v, done


@pytest.mark.parametrize("tol", [1e-3, 1e-6, 0.05])
def test_imputer_equals_the_row_wise_rounds(spark, tol):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 3
    rows = [tuple(None if rng.random() < 0.15 else float(v) for v in r) for r in x]
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{c} double" for c in cols)).repartition(4)
    model = FE.ChainedImputer(inputCols=cols, tol=tol).fit(df)
    want, rounds = replay(rows, cols, 10, tol)
    got = np.array([[r[c] for c in cols] for r in sorted(model.transform(df).collect())])
    assert len(model.getStats()["rounds"]) == rounds
    assert np.allclose(got, want, atol=1e-6)


def test_imputer_reads_the_rows_once_and_keeps_its_limits(spark, tmp_path):
    est = FE.ChainedImputer(inputCols=["a", "b"], max_iter=3, tol=0.5)
    est.write().overwrite().save(f"file://{tmp_path}/imputer")
    again = FE.ChainedImputer.load(f"file://{tmp_path}/imputer")
    assert (again.getOrDefault(again.maxIter), again.getOrDefault(again.tol)) == (3, 0.5)
    df = spark.createDataFrame([(None, None), (None, None)], "a double, b double")
    assert [tuple(r) for r in est.fit(df).transform(df).collect()] == [(0.0, 0.0)] * 2


# -- ordinal boosting, stacking, searches -------------------------------------------------------------

@pytest.fixture(scope="module")
def classed(spark):
    d = records(spark, SF_SMALL).na.fill(0.0, ["ParentalEducation"]).withColumn("label", F.col("GradeClass").cast("double"))
    d = MD.assemble(d, ["StudyTimeWeekly", "Absences", "ParentalEducation"]).select("row_id", "label", "features")
    return materialize(stratified_folds(d, "row_id", "label", 3, 42), "classed")


def test_ordinal_boost_saves_and_loads(spark, classed, tmp_path):
    est = OrdinalBoost(5, max_iter=3, depth=2, step=0.2)
    model = est.fit(classed)
    model.write().overwrite().save(f"file://{tmp_path}/m")
    loaded = OrdinalBoostModel.load(f"file://{tmp_path}/m")
    cols = ["row_id", "prediction", vector_to_array("probability").alias("p")]
    assert sorted(loaded.transform(classed).select(*cols).collect()) == sorted(model.transform(classed).select(*cols).collect())
    est.write().overwrite().save(f"file://{tmp_path}/e")
    again = OrdinalBoost.load(f"file://{tmp_path}/e")
    assert again.extractParamMap().values() and again.getOrDefault(again.stepSize) == 0.2 and again.max_iter == 3
    assert est.copy({est.stepSize: 0.7}).getOrDefault(est.stepSize) == 0.7 and est.getOrDefault(est.stepSize) == 0.2


def test_random_search_tunes_the_step_of_ordinal_boosting(spark, classed):
    est = OrdinalBoost(5, max_iter=3, depth=2)
    found = MD.random_search(est, {est.stepSize: ("logfloat", 1e-4, 0.3), est.maxDepth: ("int", 1, 3)}, 4, classed, "label", "fold")
    steps = [m[est.stepSize] for m in found.maps]
    assert len(set(steps)) == 4 and all(1e-4 <= s <= 0.3 for s in steps) and found.scores[found.best] == max(found.scores)
    assert isinstance(found.refit(classed), OrdinalBoostModel)
    assert MD.trials_table(spark, found).count() == 4


class Memory(Estimator):
    """Remembers the ids it was fitted on."""
    labelCol = Param(Params._dummy(), "labelCol", "", typeConverter=TypeConverters.toString)

    def _fit(self, df):
        return MemoryModel([r[0] for r in df.select("row_id").collect()])


class MemoryModel(Model):
    def __init__(self, ids):
        super().__init__()
        self.ids, self.out = ids, "probability"

    def setProbabilityCol(self, c):
        self.out = c
        return self

    def setPredictionCol(self, c):
        return self

    def _transform(self, df):
        known = F.col("row_id").isin(self.ids).cast("double")
        return df.withColumn(self.out, array_to_vector(F.array(known, 1 - known)))


def test_stacking_scores_no_row_with_a_model_that_saw_it(spark, classed):
    stack = Stacking({"memory": Memory(), "again": Memory()})
    model = stack.fit(classed)
    oof = stack.out_of_fold.select("row_id", vector_to_array("_meta").alias("m")).collect()
    assert len(oof) == classed.count() == len({r["row_id"] for r in oof})
    assert all(r["m"] == [0.0, 1.0, 0.0, 1.0] for r in oof)
    joined = model.bases[0].transform(classed).select(vector_to_array("probability").alias("p")).collect()
    assert all(r["p"][0] == 1.0 for r in joined)        # the final bases saw every row


def test_stacking_saves_loads_and_joins_nothing(spark, classed, tmp_path):
    bases = {"rf": MD.forest_classifier("label", trees=3, depth=3), "gbt": OrdinalBoost(5, max_iter=2, depth=2),
             "mlp": MD.mlp_classifier(3, 5, "label", hidden=(4,)).setMaxIter(5)}
    model = Stacking(bases).fit(classed)
    out = model.transform(classed)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    model.write().overwrite().save(f"file://{tmp_path}/s")
    loaded = StackingModel.load(f"file://{tmp_path}/s")
    cols = ["row_id", "prediction", vector_to_array("probability").alias("p")]
    assert sorted(loaded.transform(classed).select(*cols).collect()) == sorted(out.select(*cols).collect())


def classes_of(model, df):
    return [(int(r["label"]), int(r["prediction"])) for r in model.transform(df).select("label", "prediction").collect()]


def counted(pairs):
    return {(y, p): pairs.count((y, p)) for y, p in set(pairs)}


def test_a_cut_forest_is_the_forest_grown_with_those_limits(spark, classed):
    """One tree sees all rows and features, so a cut of the deep tree must be the shallow tree; many trees must vote as the model does."""
    train, held = classed.where("fold <> 0"), classed.where("fold = 0")
    cuts = [(0, 0.0), (1, 0.0), (3, 0.0), (3, 0.02), (12, 0.01), (12, 0.0)]
    rf = MD.forest_classifier("label", trees=1, depth=12)
    rows = prefix_counts(held, forest_trees(rf.fit(train)), cuts, [1], "label").collect()
    for c, (depth, gain) in enumerate(cuts):
        got = {(r["y"], r["p"]): r["n"] for r in rows if r["cut"] == c}
        assert got == counted(classes_of(rf.copy().setMaxDepth(depth).setMinInfoGain(gain).fit(train), held))
    many = rf.copy().setNumTrees(7).fit(train)
    rows = prefix_counts(held, forest_trees(many), [(12, 0.0)], [3, 7], "label").collect()
    assert {(r["y"], r["p"]): r["n"] for r in rows if r["size"] == 1} == counted(classes_of(many, held))


def test_grid_search_orders_trials_and_averages_folds(spark, classed):
    rf = MD.forest_classifier("label", depth=3)
    found = MD.grid_search(rf, {rf.numTrees: [2, 4], rf.maxDepth: [2, 3]}, classed, "label", "fold")
    assert [(m[rf.numTrees], m[rf.maxDepth]) for m in found.maps] == [(2, 2), (2, 3), (4, 2), (4, 3)]
    want = []
    for f in range(3):
        pred = rf.copy({rf.numTrees: 2, rf.maxDepth: 2}).fit(classed.where(F.col("fold") != f).repartition(1)).transform(classed.where(F.col("fold") == f))
        want.append(quadratic_kappa(pred.withColumn("p", F.col("prediction").cast("int")).withColumn("y", F.col("label").cast("int")), "y", "p").first()[0])
    assert abs(found.scores[0] - sum(want) / 3) < 0.2      # trees differ with the order of the rows
    assert found.refit(classed).getNumTrees == found.best_params[rf.numTrees]


# -- shadow selection ---------------------------------------------------------------------------------

def test_selection_stops_early_and_drops_noise(spark):
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(500)]
    df = spark.createDataFrame([(i, a, b, c, int(a + 0.2 * b > 0.6)) for i, a, b, c in rows], "id int, strong double, weak double, noise double, y int")
    got = {r[0]: r for r in SL.boruta(df, "id", "y", ["strong", "weak", "noise"], rounds=40, trees=10)}
    assert got["strong"][3] == "confirmed" and got["noise"][3] == "rejected"
    assert got["strong"][2] == SL_ROUNDS and got["noise"][2] < 40


SL_ROUNDS = 6       # 2**-6 is the first power below 0.05 / 3


def test_rotations_are_permutations_that_differ_by_round_and_column():
    n = 97
    seen = {(r, c): SL._offset(42, r, c, n) for r in range(20) for c in "abc"}
    assert all(1 <= o < n for o in seen.values()) and len(set(seen.values())) > 30
    assert SL._offset(1, 0, "a", 1) == 0
