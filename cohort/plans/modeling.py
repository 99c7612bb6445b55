"""Registered queries: models, survival, causal effects, personas, explanations, IO round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.expressions import interaction_features
from ..operators import causal as CA
from ..operators import explain as XP
from ..operators import hypothesis as HY
from ..operators import models as MD
from ..operators import persona as PE
from ..operators import survival as SV
from ..operators.column_groups import ColumnGroupTransformer
from ..operators.evaluate import classification_metrics, importance_table
from ..operators.selection import boruta_frame
from ..operators.split import split_flag, stratified_folds
from ..session import checkpoint_dir, full_partitions, materialize, rows_to_score
from ..sources import io as IO
from ..sources.tables import records, table, with_records
from .audit import prepared_records
from .registry import query, rounded
from .sqlfrag import PREPARED, r6

FEATURES = ["Gender", "ParentalEducation", "StudyTimeWeekly", "Absences", "Tutoring", "Extracurricular",
            "InternetAccess", "TechSynergy", "SelfDriven", "SupportIndex", "BalancedLife", "AbsenceRisk"]


def _scratch(spark, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:8]}"


def _train_test(spark, sf, ratio=0.2):
    d = MD.assemble(prepared_records(spark, sf), FEATURES)
    d = split_flag(d, "row_id", "GradeClass", ratio, 42).withColumn("label", F.col("GradeClass").cast("double"))
    # not persisted: MLlib caches its own training input, and long sessions that run many
    # queries should not pile up cached tables
    d = full_partitions(d, "split")
    return d.where(~F.col("is_test")), d.where(F.col("is_test"))


def _with_validation(train):
    """Training rows with ``is_val``, a stratified fifth that decides when boosting stops (never test rows)."""
    return stratified_folds(train, "row_id", "GradeClass", 5, 7, name="_part").withColumn("is_val", F.col("_part") == 0).drop("_part")


def _metrics(pred, label="GradeClass"):
    return classification_metrics(pred.withColumn("_p", F.col("prediction").cast("int")), label, "_p")


# ---------------------------------------------------------------- sources round trips (IO1-IO5, IO8, IO9)

@query("csv_roundtrip", with_records(select="SELECT * FROM records"))
def q_csv(spark, sf):
    path = _scratch(spark, "csv")
    r = records(spark, sf)
    IO.write_csv(r, path)
    return IO.read_csv(spark, path, schema=r.schema)


@query("parquet_roundtrip_pruned", with_records(select='SELECT row_id, "GPA" FROM records WHERE "GradeClass" = 4'))
def q_parquet(spark, sf):
    path = _scratch(spark, "pq")
    IO.write_parquet(records(spark, sf), path, partition_by=["DatasetType"])
    return IO.read_parquet(spark, path, ["row_id", "GPA", "GradeClass"]).where("GradeClass = 4").select("row_id", "GPA")


@query("read_first_fallback", "SELECT * FROM region")
def q_read_first(spark, sf):
    return IO.read_first(spark, [f"{sf}/no_such_table.parquet", f"{sf}/region.parquet"])


@query("metrics_json_roundtrip", with_records(select=f"""
SELECT 'r1' AS run_id, 'at_risk_share' AS metric, CAST("DatasetType" AS VARCHAR) AS grp,
       {r6('avg(CASE WHEN "GradeClass" >= 3 THEN 1.0 ELSE 0.0 END)')} AS value FROM records GROUP BY "DatasetType" """))
def q_metrics_json(spark, sf):
    r = records(spark, sf)
    m = r.groupBy("DatasetType").agg(F.avg((F.col("GradeClass") >= 3).cast("double")).alias("value")).select(
        F.lit("r1").alias("run_id"), F.lit("at_risk_share").alias("metric"), F.col("DatasetType").cast("string")
        .alias("grp"), "value")
    path = _scratch(spark, "metrics")
    IO.write_metrics(m, path)
    return rounded(IO.read_metrics(spark, path))


@query("pipeline_save_load_score")
def q_pipeline(spark, sf):
    from pyspark.ml.feature import VectorAssembler

    from ..operators.features import RobustScaler
    train, test = _train_test(spark, sf)
    train, test = train.drop("features"), test.drop("features")
    pipe = MD.pipeline_of(RobustScaler(inputCols=["StudyTimeWeekly", "Absences"]),
                          VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep"),
                          MD.forest_classifier("label", trees=100, depth=10))
    model = pipe.fit(train)
    path = _scratch(spark, "model")
    IO.save_model(model, path)
    loaded = IO.load_pipeline_model(path)
    log = _scratch(spark, "runlog")
    IO.log_run(spark, log, "pipeline", {"trees": 100, "depth": 10}, {"n_train": train.count()})
    return MD.score(loaded, test).select("row_id", "GradeClass", "pred_class")


# ---------------------------------------------------------------- models

@query("class_weights", with_records(select=f"""
SELECT "GradeClass", {r6('(SELECT count(*) FROM records) / ((SELECT count(DISTINCT "GradeClass") FROM records) * count(*))')} AS weight
FROM records GROUP BY 1"""))
def q_weights(spark, sf):
    return rounded(MD.balanced_weights(records(spark, sf), "GradeClass").groupBy("GradeClass").agg(
        F.first("weight").alias("weight")))


@query("linear_regression_gpa")
def q_linear(spark, sf):
    d = prepared_records(spark, sf)
    m = MD.linear_regression(d, ["StudyTimeWeekly", "Absences", "Tutoring"], "GPA")
    rows = [(c, float(v)) for c, v in zip(["StudyTimeWeekly", "Absences", "Tutoring"], m.coefficients)]
    rows.append(("intercept", float(m.intercept)))
    return rounded(spark.createDataFrame(rows, "term string, coef double"))


@query("linear_regression_one_feature", with_records(PREPARED, select=f"""
SELECT 'StudyTimeWeekly' AS term, {r6('regr_slope("GPA", "StudyTimeWeekly")')} AS coef FROM prepared
UNION ALL SELECT 'intercept', {r6('regr_intercept("GPA", "StudyTimeWeekly")')} FROM prepared"""))
def q_linear_one(spark, sf):
    m = MD.linear_regression(prepared_records(spark, sf), ["StudyTimeWeekly"], "GPA")
    rows = [("StudyTimeWeekly", float(m.coefficients[0])), ("intercept", float(m.intercept))]
    return rounded(spark.createDataFrame(rows, "term string, coef double"))


@query("forest_regression_importance")
def q_rf_reg(spark, sf):
    d = prepared_records(spark, sf)
    m = MD.forest_regression(d, FEATURES, "GPA", trees=100)
    return spark.createDataFrame(importance_table(FEATURES, m.featureImportances.toArray(), top=3),
                                 "feature string, importance double, rank int")


@query("logistic_multinomial_metrics")
def q_lr(spark, sf):
    train, test = _train_test(spark, sf)
    m = MD.logistic_multinomial("label", reg=1.0 / train.count()).fit(train)
    return rounded(_metrics(m.transform(test)))


@query("forest_classifier_metrics")
def q_rf(spark, sf):
    train, test = _train_test(spark, sf)
    m = MD.forest_classifier("label", trees=100, depth=10).fit(train)
    return rounded(_metrics(m.transform(test)))


@query("ordinal_boosting_metrics")
def q_ordinal(spark, sf):
    train, test = _train_test(spark, sf)
    m = MD.OrdinalBoost(5, "label", max_iter=1000, step=0.03, validation="is_val").fit(materialize(_with_validation(train), "boost"))
    # written, as the test for null predictions would score every row a second time below the exchange
    return rounded(_metrics(materialize(m.transform(rows_to_score(test.select("GradeClass", "features"))).select("GradeClass", "prediction"), "scored")))


@query("mlp_metrics")
def q_mlp(spark, sf):
    train, test = _train_test(spark, sf)
    m = MD.mlp_classifier(len(FEATURES), 5, "label").fit(train)
    return rounded(_metrics(m.transform(test)))


@query("stacking_metrics")
def q_stack(spark, sf):
    train, test = _train_test(spark, sf)
    train = _with_validation(stratified_folds(train, "row_id", "GradeClass", 3, 42))
    bases = {"rf": MD.forest_classifier("label", trees=200, depth=10),
             "gbt": MD.OrdinalBoost(5, "label", max_iter=500, depth=6, step=0.05, validation="is_val"),
             "mlp": MD.mlp_classifier(len(FEATURES), 5, "label", hidden=(64, 32)).setMaxIter(500)}
    pred, _ = MD.stacking_fit_predict(train, rows_to_score(test), "label", "fold", "row_id", bases, 5)
    return rounded(_metrics(materialize(pred.select("GradeClass", "prediction"), "scored")))


@query("grid_search_trials")
def q_grid(spark, sf):
    train, _ = _train_test(spark, sf)
    train = stratified_folds(train, "row_id", "GradeClass", 3, 42)
    rf = MD.forest_classifier("label")
    # 81 points; 30 is MLlib's greatest depth, least gain stands for the least rows to split, which MLlib lacks
    grid = {rf.numTrees: [100, 200, 300], rf.maxDepth: [30, 10, 20], rf.minInfoGain: [0.0, 0.001, 0.01], rf.minInstancesPerNode: [1, 2, 4]}
    cv = MD.grid_search(rf, grid, train, "label", "fold")
    return rounded(MD.trials_table(spark, cv))


@query("random_search_trials")
def q_random(spark, sf):
    """Fifty trials of the ordinal boosted model over eight parameters, three on log ranges; each fit stops early on a part of its own training rows."""
    train, _ = _train_test(spark, sf)
    train = stratified_folds(train, "row_id", "GradeClass", 3, 42)
    train = _with_validation(train)
    boost = MD.OrdinalBoost(5, "label", validation="is_val")
    space = {boost.maxIter: ("int", 500, 1500), boost.stepSize: ("logfloat", 1e-4, 0.3), boost.maxDepth: ("int", 4, 12),
             boost.minInstancesPerNode: ("int", 1, 50), boost.subsamplingRate: ("float", 0.5, 1.0), boost.minInfoGain: ("logfloat", 1e-8, 0.1),
             boost.validationTol: ("logfloat", 1e-3, 0.1), boost.featureSubsetStrategy: ("choice", ["all", "sqrt", "onethird"])}
    found = MD.random_search(boost, space, 50, train, "label", "fold")
    trials = MD.trials_table(spark, found)
    log = _scratch(spark, "trials")
    for t in trials.collect():   # one row per trial (50)
        IO.log_run(spark, log, f"trial-{t.trial}", {"params": t.params}, {"cv_qwk": t.cv_qwk})
    return rounded(trials)


@query("split_ratio_study")
def q_ratio(spark, sf):
    """The main model behind the fitted column groups, at four test ratios."""
    d = _with_validation(prepared_records(spark, sf).withColumn("label", F.col("GradeClass").cast("double")))
    nominal = ["Gender", "Tutoring", "Extracurricular", "InternetAccess"]
    numeric = [c for c in FEATURES if c not in nominal and c != "ParentalEducation"]
    groups = ColumnGroupTransformer(numeric, ["ParentalEducation"], nominal, "label", "row_id", keepCols=["row_id", "label", "is_val"])
    boost = lambda: MD.OrdinalBoost(5, "label", max_iter=1000, depth=6, step=0.03, validation="is_val")
    return rounded(MD.split_ratio_study(d, "row_id", "label", FEATURES, make_estimator=boost, groups=groups))


@query("batch_scoring")
def q_score(spark, sf):
    train, test = _train_test(spark, sf)
    m = MD.forest_classifier("label", trees=100, depth=10).fit(train)
    return MD.score(m, test).select("row_id", "pred_class", "probabilities")


@query("pca_two_columns", with_records(PREPARED, """r AS (SELECT abs(corr("StudyTimeWeekly", "GPA")) AS r FROM prepared)""", select=f"""
SELECT 1 AS component, {r6('(1 + r) / 2')} AS ratio, {r6('(1 + r) / 2')} AS cumulative, (1 + r) / 2 >= 0.9 AS first_at_share FROM r
UNION ALL SELECT 2, {r6('(1 - r) / 2')}, 1.0::DOUBLE, (1 + r) / 2 < 0.9 FROM r"""))
def q_pca_two(spark, sf):
    """Two standardised columns: the ratios follow from their correlation."""
    return rounded(HY.pca(prepared_records(spark, sf), ["StudyTimeWeekly", "GPA"], 0.9).table)


@query("pca_explained_variance")
def q_pca(spark, sf):
    found = HY.pca(prepared_records(spark, sf), FEATURES, 0.9)
    return rounded(found.table.withColumnRenamed("first_at_share", "first_at_90"))


# ---------------------------------------------------------------- survival

_SURV = """surv AS (
  SELECT row_id, "GradeClass", "InternetAccess", "StudyTimeWeekly", "Absences", "GPA",
         CAST("GradeClass" = 4 AS INT) AS "Event",
         CASE WHEN "GradeClass" = 4 THEN least(40.0, greatest(1.0,
              40.0 * (1.0 - coalesce(("Absences" - (SELECT min("Absences") FROM prepared))
                     / nullif((SELECT max("Absences") - min("Absences") FROM prepared), 0), 0.0))))
              ELSE 40.0 END AS "Duration"
  FROM prepared)"""


def _surv(spark, sf):
    return SV.event_duration(prepared_records(spark, sf))


@query("survival_event_duration", with_records(PREPARED, _SURV, select=f"""
SELECT row_id, "Event", {r6('"Duration"')} AS "Duration" FROM surv"""))
def q_event_duration(spark, sf):
    return rounded(_surv(spark, sf).select("row_id", "Event", "Duration"))


@query("exposure_band_curves", with_records(PREPARED, _SURV, select=f"""
SELECT "InternetAccess", {r6('hazard_rate')} AS hazard_rate, {r6('i * 1.0')} AS t, {r6('exp(-hazard_rate * i * 1.0)')} AS survival
FROM (SELECT "InternetAccess", count_if("Event" = 1) / sum("Duration") AS hazard_rate FROM surv GROUP BY 1),
     (SELECT range AS i FROM range(41))"""))
def q_exposure(spark, sf):
    return rounded(SV.exposure_curves(_surv(spark, sf), "InternetAccess").select(
        "InternetAccess", "hazard_rate", "t", "survival"))


_ORDERS_SURV = """last AS (
  SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS mean_total, min(o_orderdate) AS first_date,
         max(o_orderdate) AS last_date, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status
  FROM orders GROUP BY o_custkey)"""


def _orders_surv(spark, sf):
    o = table(spark, sf, "orders")
    g = o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("mean_total"),
        F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"),
        F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_status"))
    return g.select("o_custkey", "n_orders", "mean_total",
                    F.datediff("last_date", "first_date").cast("double").alias("Duration"),
                    (F.col("last_status") == "F").cast("int").alias("Event"))


@query("orders_survival_input", f"""WITH {_ORDERS_SURV}
SELECT o_custkey, n_orders, {r6('mean_total')} AS mean_total,
       CAST(datediff('day', first_date, last_date) AS DOUBLE) AS "Duration", CAST(last_status = 'F' AS INT) AS "Event"
FROM last""")
def q_orders_surv(spark, sf):
    return rounded(_orders_surv(spark, sf))


@query("cox_orders")
def q_cox(spark, sf):
    fit = SV.cox_fit(_orders_surv(spark, sf), ["n_orders", "mean_total"], penalizer=0.1)
    return rounded(SV.cox_table(spark, fit))


_HAZARD_FIT = {"covariates": ["n_orders", "mean_total"], "coef": [0.05, 0.000002], "mean": [10.0, 150000.0]}


@query("breslow_hazard_orders", f"""WITH {_ORDERS_SURV},
s AS (SELECT CAST(datediff('day', first_date, last_date) AS DOUBLE) AS t, CAST(last_status = 'F' AS INT) AS e,
             exp(0.05 * (n_orders - 10.0) + 0.000002 * (mean_total - 150000.0)) AS w FROM last),
per AS (SELECT t, sum(w) AS w, count_if(e = 1) AS d FROM s GROUP BY t),
risk AS (SELECT t, d / sum(w) OVER (ORDER BY t DESC) AS dh FROM per)
SELECT t, {r6('sum(dh) OVER (ORDER BY t)')} AS "H0" FROM risk""")
def q_breslow(spark, sf):
    """Cumulative baseline hazard at given coefficients."""
    return rounded(SV.baseline_hazard(_orders_surv(spark, sf), _HAZARD_FIT))


@query("cox_records_curves")
def q_cox_curves(spark, sf):
    from ..operators.clean import present
    d = _surv(spark, sf)
    # optional covariates: a listed column the table lacks (ParentalSupport) is skipped
    fit = SV.cox_fit(d, present(d, ["StudyTimeWeekly", "Absences", "ParentalSupport", "GPA"]), penalizer=0.1)
    return rounded(SV.survival_profiles(d, fit, "Absences", [0, 10, 20, 30]))


# ---------------------------------------------------------------- causal

_CONF = ["ParentalEducation", "Tutoring"]
_MATCH = """ps AS (SELECT row_id, "InternetAccess" AS arm, 1 - "InternetAccess" AS other, "GPA" AS y,
                   avg(CAST("InternetAccess" AS DOUBLE)) OVER (PARTITION BY "ParentalEducation", "Tutoring") AS score
            FROM prepared),
reps AS (SELECT arm, other, score, arg_min(y, row_id) AS ry FROM ps GROUP BY arm, other, score),
lo AS (SELECT r.arm, r.score, o.score AS ls, o.ry AS ly FROM reps r ASOF LEFT JOIN reps o ON r.other = o.arm AND r.score >= o.score),
hi AS (SELECT r.arm, r.score, o.score AS hs, o.ry AS hy FROM reps r ASOF LEFT JOIN reps o ON r.other = o.arm AND r.score <= o.score),
m AS (SELECT lo.arm, lo.score, CASE WHEN hs IS NULL OR (ls IS NOT NULL AND lo.score - ls <= hs - lo.score) THEN ly ELSE hy END AS my
      FROM lo JOIN hi ON lo.arm = hi.arm AND lo.score = hi.score),
d AS (SELECT ps.arm, CASE WHEN ps.arm = 1 THEN y - my ELSE my - y END AS diff FROM ps JOIN m ON ps.arm = m.arm AND ps.score = m.score)"""


def _causal_input(spark, sf):
    return prepared_records(spark, sf).select("row_id", "InternetAccess", "GPA", *_CONF)


@query("matched_effect_cells", with_records(PREPARED, _MATCH, select=f"""
SELECT {r6('avg(CASE WHEN arm = 1 THEN diff END)')} AS att, {r6('avg(CASE WHEN arm = 0 THEN diff END)')} AS atc,
       {r6('avg(diff)')} AS ate, count_if(arm = 1)::BIGINT AS n_treated, count_if(arm = 0)::BIGINT AS n_control FROM d"""))
def q_matched(spark, sf):
    d = CA.propensity_cells(_causal_input(spark, sf), "InternetAccess", _CONF, "score")
    return rounded(CA.matched_effect(d, "row_id", "InternetAccess", "score", "GPA"))


@query("matched_effect_logistic")
def q_matched_lr(spark, sf):
    d = CA.propensity_logistic(prepared_records(spark, sf), "InternetAccess", ["ParentalEducation", "Absences"])
    return rounded(CA.matched_effect(d, "row_id", "InternetAccess", "score", "GPA"))


@query("placebo_refuter")
def q_placebo(spark, sf):
    d = CA.propensity_cells(_causal_input(spark, sf), "InternetAccess", _CONF, "score")
    est = CA.matched_effect(d, "row_id", "InternetAccess", "score", "GPA").first()["ate"]
    return rounded(CA.placebo_refute(_causal_input(spark, sf), "row_id", "InternetAccess", _CONF, "GPA",
                                     est, replicates=100))


# ---------------------------------------------------------------- personas (M16-M19), selection

@query("oversample_failing_class", with_records(select="""
SELECT "GradeClass", count(*) * CASE WHEN "GradeClass" = 4 THEN 2 ELSE 1 END AS n FROM records GROUP BY 1"""))
def q_oversample(spark, sf):
    r = records(spark, sf).na.fill(0)
    out = PE.oversample_minority(r, "row_id", "GradeClass", 4, ["StudyTimeWeekly", "Absences", "GPA"],
                                 ["Gender", "Tutoring", "Extracurricular", "InternetAccess"])
    return out.groupBy("GradeClass").agg(F.count(F.lit(1)).alias("n"))


def _personas(spark, sf):
    cols = ["StudyTimeWeekly", "Absences", "ParentalEducation", "InternetAccess", "Tutoring", "Extracurricular"]
    e = PE.embed_2d(prepared_records(spark, sf), cols)
    return PE.grid_density_clusters(e, "embed_1", "embed_2", eps=0.1, min_samples=10, min_cluster_size=50)


@query("persona_clusters")
def q_personas(spark, sf):
    from ..operators.aggregate import profile
    return rounded(profile(_personas(spark, sf), "cluster", ["StudyTimeWeekly", "Absences", "ParentalEducation",
                                                             "InternetAccess", "GradeClass"]))


@query("persona_silhouette")
def q_silhouette(spark, sf):
    p = _personas(spark, sf)
    return rounded(spark.createDataFrame([(PE.silhouette(p, ["embed_1", "embed_2"]),)], "silhouette double"))


@query("shadow_feature_selection")
def q_boruta(spark, sf):
    d = prepared_records(spark, sf)
    return boruta_frame(d, "row_id", "GradeClass", ["StudyTimeWeekly", "Absences", "ParentalEducation",
                                                     "InternetAccess", "Tutoring", "Gender"])


# ---------------------------------------------------------------- explanations

_XF = ["StudyTimeWeekly", "Absences", "ParentalEducation", "InternetAccess", "Tutoring"]


def _xmodel(spark, sf):
    d = prepared_records(spark, sf).withColumn("label", F.col("GradeClass").cast("double"))
    d = MD.assemble(d, _XF)
    return MD.forest_classifier("label", trees=100, depth=5).fit(full_partitions(d, "explained")), prepared_records(spark, sf)


@query("shapley_values")
def q_shap(spark, sf):
    model, d = _xmodel(spark, sf)
    bg = XP.background_sample(d, "row_id", 100)
    phi = XP.shapley_values(model, d, "row_id", _XF, 4, bg, samples=120)   # as many orderings as five features have
    return rounded(XP.mean_abs_ranking(phi))


@query("shapley_dependence")
def q_dep(spark, sf):
    model, d = _xmodel(spark, sf)
    bg = XP.background_sample(d, "row_id", 100)
    phi = XP.shapley_values(model, d, "row_id", _XF, 4, bg, samples=120)   # as many orderings as five features have
    return rounded(XP.dependence_table(phi, d, "row_id", "Absences"))


@query("counterfactual_changes")
def q_cf(spark, sf):
    model, d = _xmodel(spark, sf)
    at_risk = d.where(F.col("GradeClass") == 4)
    cf = XP.counterfactuals(model, at_risk, "row_id", _XF, ["StudyTimeWeekly", "Absences", "ParentalEducation"], 2, k=3)
    return rounded(XP.changed_cells(cf, "row_id", ["StudyTimeWeekly", "Absences", "ParentalEducation"]))


@query("what_if_scenarios")
def q_whatif(spark, sf):
    """Profiles of raw columns -> engineered features -> class, risk and advice, by the model on all features."""
    d = prepared_records(spark, sf).withColumn("label", F.col("GradeClass").cast("double"))
    model = MD.forest_classifier("label", trees=100, depth=5).fit(full_partitions(MD.assemble(d, FEATURES), "what-if"))
    flags = {c: [0.0, 1.0] for c in ("InternetAccess", "Tutoring", "Extracurricular")}
    grid = XP.scenario_grid(d, ["StudyTimeWeekly", "Absences", "ParentalEducation", *flags], {"Gender": 0.0}, points=5, values=flags)
    scored = XP.scenario_scores(model, interaction_features(grid), FEATURES)
    return rounded(scored.select(*FEATURES, "pred_class", "risk", "advice"))
