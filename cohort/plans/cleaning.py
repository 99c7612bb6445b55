"""Registered queries: sources, contracts, harmonising, projections, fairness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fairness as fair
from ..sources.contract import STUDENT_CONTRACT, contract_sql, validate
from ..sources.tables import records, with_records
from .audit import SENSITIVE, prepared_records, rounded_grade_scorer
from .registry import query, rounded
from .sqlfrag import PREPARED, grade_bins, r6

RECORD_TYPES = {"Gender": "int", "ParentalEducation": "double", "StudyTimeWeekly": "double",
                "Absences": "int", "Tutoring": "int", "Extracurricular": "int",
                "InternetAccess": "int", "GPA": "double", "GradeClass": "int"}


@query("records_harmonised", with_records(select="SELECT * FROM records"))
def q_records(spark, sf):
    return records(spark, sf)


@query("contract_violations", with_records(select=contract_sql(STUDENT_CONTRACT, "records", RECORD_TYPES)))
def q_contract(spark, sf):
    return validate(records(spark, sf), STUDENT_CONTRACT)


_SCORED = f"""
scored AS (
  SELECT "GradeClass" AS y, {grade_bins('round_even("GPA" * 2, 0) / 2')} AS p, "Gender", "InternetAccess"
  FROM featured),
pairs AS (
  SELECT 'Gender' AS attribute, CAST("Gender" AS VARCHAR) AS group_value, y, p FROM scored
  UNION ALL
  SELECT 'InternetAccess', CAST("InternetAccess" AS VARCHAR), y, p FROM scored),
rates AS (
  SELECT attribute, group_value, count(*) AS n,
         avg(CASE WHEN p <= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS selection_rate,
         coalesce(sum(CASE WHEN y <= 2 AND p <= 2 THEN 1 ELSE 0 END)::DOUBLE
                  / nullif(sum(CASE WHEN y <= 2 THEN 1 ELSE 0 END), 0), 0.0) AS true_positive_rate,
         coalesce(sum(CASE WHEN y > 2 AND p <= 2 THEN 1 ELSE 0 END)::DOUBLE
                  / nullif(sum(CASE WHEN y > 2 THEN 1 ELSE 0 END), 0), 0.0) AS false_positive_rate
  FROM pairs GROUP BY attribute, group_value)
"""


@query("fairness_group_rates", with_records(PREPARED, _SCORED, select=f"""
SELECT attribute, group_value, n, {r6('selection_rate')} AS selection_rate,
       {r6('true_positive_rate')} AS true_positive_rate, {r6('false_positive_rate')} AS false_positive_rate
FROM rates"""))
def q_fairness(spark, sf):
    scored = rounded_grade_scorer(prepared_records(spark, sf))
    return rounded(fair.group_rates(scored, "GradeClass", "pred_class", SENSITIVE))


@query("fairness_disparities", with_records(PREPARED, _SCORED, select=f"""
SELECT attribute, {r6('max(selection_rate) - min(selection_rate)')} AS demographic_parity_diff,
       {r6('max(true_positive_rate) - min(true_positive_rate)')} AS tpr_diff,
       {r6('max(false_positive_rate) - min(false_positive_rate)')} AS fpr_diff,
       {r6('greatest(max(true_positive_rate) - min(true_positive_rate), max(false_positive_rate) - min(false_positive_rate))')} AS equalized_odds_diff
FROM rates GROUP BY attribute"""))
def q_disparities(spark, sf):
    scored = rounded_grade_scorer(prepared_records(spark, sf))
    return rounded(fair.disparities(fair.group_rates(scored, "GradeClass", "pred_class", SENSITIVE)))


@query("fairness_selection_gap", with_records(PREPARED, select=f"""
SELECT {r6('avg(CASE WHEN "InternetAccess" = 1 THEN CASE WHEN "GradeClass" <= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END)')} AS rate_a,
       {r6('avg(CASE WHEN "InternetAccess" = 0 THEN CASE WHEN "GradeClass" <= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END)')} AS rate_b,
       {r6('avg(CASE WHEN "InternetAccess" = 1 THEN CASE WHEN "GradeClass" <= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) - avg(CASE WHEN "InternetAccess" = 0 THEN CASE WHEN "GradeClass" <= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END)')} AS gap
FROM prepared"""))
def q_gap(spark, sf):
    return rounded(fair.selection_gap(prepared_records(spark, sf), "InternetAccess", 1, 0, "GradeClass"))


_DOCS = """
scored AS (
  SELECT l.quality AS y, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS p, d.lang
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""


@query("fairness_documents", f"""WITH {_DOCS.strip()}
SELECT 'lang' AS attribute, lang AS group_value, count(*) AS n,
       {r6('avg(p::DOUBLE)')} AS selection_rate,
       {r6('coalesce(sum(y * p)::DOUBLE / nullif(sum(y), 0), 0.0)')} AS true_positive_rate,
       {r6('coalesce(sum((1 - y) * p)::DOUBLE / nullif(count(*) - sum(y), 0), 0.0)')} AS false_positive_rate
FROM scored GROUP BY lang""")
def q_fair_docs(spark, sf):
    from ..sources.tables import table
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    j = lab.join(docs, "doc_id").select(
        F.col("quality").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("p"), "lang")
    pos = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return rounded(fair.group_rates(j, "y", "p", ["lang"], positive=pos))


# ---------------------------------------------------------------- projections P3-P16

from ..functions import expressions as X  # noqa: E402
from ..operators import clean as C  # noqa: E402
from ..sources.tables import table  # noqa: E402


@query("flags_threshold_truthy", f"""
SELECT doc_id, CAST(coalesce(lower(CAST(quality AS VARCHAR)) IN ('yes', '1', 'true'), false) AS INT) AS quality_flag,
       CAST(coalesce(toxic > 0, false) AS INT) AS toxic_flag
FROM labels""")
def q_flags(spark, sf):
    lab = table(spark, sf, "labels")
    return lab.select("doc_id", X.truthy_flag("quality").alias("quality_flag"),
                      X.threshold_flag("toxic", 0).alias("toxic_flag"))


@query("clip_keeps_null", with_records(select="""
SELECT row_id, CASE WHEN "ParentalEducation" IS NULL THEN NULL WHEN "ParentalEducation" > 2.5 THEN 2.5
                    WHEN "ParentalEducation" < 0.5 THEN 0.5 ELSE "ParentalEducation" END AS pe_clipped,
       CASE WHEN "StudyTimeWeekly" > 40.0 THEN 40.0 WHEN "StudyTimeWeekly" < 1.0 THEN 1.0 ELSE "StudyTimeWeekly" END AS study_clipped
FROM records"""))
def q_clip(spark, sf):
    r = records(spark, sf)
    return r.select("row_id", X.clip("ParentalEducation", 0.5, 2.5).alias("pe_clipped"),
                    X.clip("StudyTimeWeekly", 1.0, 40.0).alias("study_clipped"))


@query("right_closed_bins_orders", f"""
SELECT o_orderkey, {grade_bins('o_totalprice / 100000.0')} AS price_class FROM orders""")
def q_bins(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", X.grade_class(F.col("o_totalprice") / 100000.0).alias("price_class"))


@query("fill_nulls_constant", with_records(select="""
SELECT row_id, coalesce("ParentalEducation", 0.0) AS "ParentalEducation", coalesce("InternetAccess", 0) AS "InternetAccess"
FROM records"""))
def q_fill(spark, sf):
    r = records(spark, sf).select("row_id", "ParentalEducation", "InternetAccess")
    return C.fill_constant(r, 0)


@query("interaction_features", with_records(PREPARED, select=f"""
SELECT row_id, {r6('"TechSynergy"')} AS "TechSynergy", {r6('"SelfDriven"')} AS "SelfDriven",
       {r6('"SupportIndex"')} AS "SupportIndex", {r6('"BalancedLife"')} AS "BalancedLife",
       {r6('"AbsenceRisk"')} AS "AbsenceRisk"
FROM featured"""))
def q_features(spark, sf):
    return rounded(prepared_records(spark, sf).select("row_id", "TechSynergy", "SelfDriven", "SupportIndex",
                                                      "BalancedLife", "AbsenceRisk"))


@query("round_class_half_even", with_records(select="""
SELECT row_id, CAST(round_even("GPA", 0) AS INT) AS gpa_class, CAST(round_even("StudyTimeWeekly" / 2, 0) AS INT) AS half_study
FROM records"""))
def q_round(spark, sf):
    r = records(spark, sf)
    return r.select("row_id", X.round_class("GPA").alias("gpa_class"),
                    X.round_class(F.col("StudyTimeWeekly") / 2).alias("half_study"))


@query("grade_letters", with_records(select="""
SELECT coalesce(CASE "GradeClass" WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'F' END, 'Unknown') AS letter,
       count(*) AS n
FROM records GROUP BY 1"""))
def q_letters(spark, sf):
    r = records(spark, sf)
    return r.groupBy(X.grade_letter("GradeClass").alias("letter")).agg(F.count(F.lit(1)).alias("n"))


@query("align_model_columns", with_records(select="""
SELECT "GPA", 0 AS "Missing_A", "Absences", 0 AS "Missing_B" FROM records"""))
def q_align(spark, sf):
    return C.align_to_columns(records(spark, sf), ["GPA", "Missing_A", "Absences", "Missing_B"], 0)


@query("label_encode_brand", """
SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INT) AS p_brand_code FROM part""")
def q_label(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    return C.label_encode(p, "p_brand", "p_brand_code").select("p_partkey", "p_brand", "p_brand_code")


@query("recommendation_rules", with_records(select="""
SELECT row_id, CASE WHEN "GradeClass" / 4.0 > 0.5 THEN concat_ws('; ', 'High Risk of Failure.',
         CASE WHEN "Absences" > 10 THEN 'Critical: Reduce absences immediately. Aim for < 5.' END,
         CASE WHEN "StudyTimeWeekly" < 5 THEN 'Action: Increase study time to at least 8-10 hours/week.' END,
         CASE WHEN "InternetAccess" = 0 THEN 'Support: Provide access to school computer lab or hotspot.' END)
       ELSE concat_ws('; ', 'Student is on track.',
         CASE WHEN "GradeClass" > 0 THEN 'To improve further, focus on consistent study habits.' END) END AS advice
FROM records"""))
def q_advice(spark, sf):
    r = records(spark, sf)
    adv = X.recommendations(F.col("GradeClass") / 4.0, "Absences", "StudyTimeWeekly", "InternetAccess", "GradeClass")
    return r.select("row_id", F.array_join(adv, "; ").alias("advice"))


# ---------------------------------------------------------------- relational R1, R7-R13

@query("risk_filter", with_records(select="""
SELECT row_id, "GradeClass", "Gender", "InternetAccess" FROM records
WHERE "GradeClass" >= 3 AND "Gender" IN (0, 1) AND "InternetAccess" IN (1)"""))
def q_risk(spark, sf):
    return C.risk_filter(records(spark, sf), "GradeClass", 3, {"Gender": [0, 1], "InternetAccess": [1]},
                         ["row_id", "GradeClass", "Gender", "InternetAccess"])


@query("top_gpa", with_records(select="""
SELECT row_id, "GPA" FROM records ORDER BY "GPA" DESC, row_id ASC LIMIT 10"""))
def q_top(spark, sf):
    return C.top_n(records(spark, sf).select("row_id", "GPA"), 10, F.desc("GPA"), F.asc("row_id"))


@query("shape_rows_columns", with_records(select="""
SELECT count(*) AS n_rows, 11 AS n_columns FROM records"""))
def q_shape(spark, sf):
    r = records(spark, sf)
    return r.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(r.columns)))


@query("distinct_counts", with_records(select="""
SELECT count(DISTINCT "GradeClass") AS "n_distinct_GradeClass", count(DISTINCT "InternetAccess") AS "n_distinct_InternetAccess",
       count(DISTINCT "ParentalEducation") AS "n_distinct_ParentalEducation" FROM records"""))
def q_distinct(spark, sf):
    return C.distinct_count(records(spark, sf), ["GradeClass", "InternetAccess", "ParentalEducation"])


@query("distinct_values_union", """
SELECT DISTINCT v FROM (SELECT n_regionkey AS v FROM nation UNION ALL SELECT r_regionkey FROM region)""")
def q_distinct_union(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("v"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("v"))
    return C.union_aligned([n, r]).distinct()


@query("nation_region_join", """
SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def q_dim_join(spark, sf):
    from ..operators.windows import join_small
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return join_small(n, r, on="n_regionkey").select("n_nationkey", "n_name", "r_name")


@query("numeric_projection", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def q_numeric(spark, sf):
    o = C.drop_columns(table(spark, sf, "orders"), ["o_orderdate", "not_a_column"])
    return C.select_numeric(o)
