"""Registered queries: splits and samples, feature steps, aggregations and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import features as FE
from ..operators import split as S
from ..operators.column_groups import ColumnGroupTransformer
from ..sources.tables import records, table, with_records
from .audit import prepared_records
from .registry import query, rounded
from .sqlfrag import PREPARED, r6

MD5 = "md5(concat(CAST(row_id AS VARCHAR), '-42'))"

# ---------------------------------------------------------------- R2-R6 splits and samples


@query("stratified_split_test", with_records(select=f"""
SELECT row_id, "GradeClass" FROM (SELECT row_id, "GradeClass",
  row_number() OVER (PARTITION BY "GradeClass" ORDER BY {MD5}) AS rn,
  count(*) OVER (PARTITION BY "GradeClass") AS n FROM records) WHERE rn <= round(n * 0.2)"""))
def q_strat(spark, sf):
    _, test = S.stratified_split(records(spark, sf), "row_id", "GradeClass", 0.2, 42)
    return test.select("row_id", "GradeClass")


@query("random_split_test", with_records(select=f"""
SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {MD5}) AS rn, count(*) OVER () AS n FROM records)
WHERE rn <= round(n * 0.2)"""))
def q_rand(spark, sf):
    _, test = S.random_split(records(spark, sf), "row_id", 0.2, 42)
    return test.select("row_id")


@query("stratified_folds", with_records(select=f"""
SELECT row_id, CAST((row_number() OVER (PARTITION BY "GradeClass" ORDER BY {MD5}) - 1) % 3 AS INT) AS fold FROM records"""))
def q_folds(spark, sf):
    return S.stratified_folds(records(spark, sf), "row_id", "GradeClass", 3, 42).select("row_id", "fold")


@query("sample_with_replacement", with_records(select="""
SELECT d.draw, r.row_id FROM
  (SELECT range AS draw, ('0x' || substr(md5(concat(CAST(range AS VARCHAR), '-draw-7')), 1, 15))::BIGINT
          % (SELECT count(*) FROM records) + 1 AS pos FROM range(1000)) d
JOIN (SELECT row_id, row_number() OVER (ORDER BY md5(concat(CAST(row_id AS VARCHAR), '-7'))) AS pos FROM records) r
ON d.pos = r.pos"""))
def q_sample(spark, sf):
    return S.sample_with_replacement(records(spark, sf), "row_id", 1000, seed=7).select("draw", "row_id")


@query("event_halves", """
SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) <= (SELECT count(*) FROM events) // 2
                      THEN 'reference' ELSE 'current' END AS part FROM events""")
def q_halves(spark, sf):
    return S.halves(table(spark, sf, "events").select("event_id"), "event_id")


# ---------------------------------------------------------------- F1-F10 feature steps

@query("mean_impute", with_records(select=f"""
SELECT row_id, {r6('coalesce("ParentalEducation", avg("ParentalEducation") OVER ())')} AS "ParentalEducation",
       {r6('coalesce(CAST("InternetAccess" AS DOUBLE), avg("InternetAccess") OVER ())')} AS "InternetAccess"
FROM records"""))
def q_mean_impute(spark, sf):
    r = records(spark, sf).select("row_id", "ParentalEducation", "InternetAccess")
    m = FE.MeanImputer(inputCols=["ParentalEducation", "InternetAccess"]).fit(r)
    return rounded(m.transform(r))


@query("mode_impute", with_records("""
md AS (SELECT "ParentalEducation" AS v, count(*) AS c FROM records WHERE "ParentalEducation" IS NOT NULL
       GROUP BY 1 ORDER BY c DESC, v ASC LIMIT 1)""", select="""
SELECT row_id, coalesce("ParentalEducation", (SELECT v FROM md)) AS "ParentalEducation" FROM records"""))
def q_mode_impute(spark, sf):
    r = records(spark, sf).select("row_id", "ParentalEducation")
    return FE.ModeImputer(inputCols=["ParentalEducation"]).fit(r).transform(r)


@query("robust_scale", with_records("""
q AS (SELECT quantile_cont("StudyTimeWeekly", [0.25, 0.5, 0.75]) AS s, quantile_cont("Absences", [0.25, 0.5, 0.75]) AS a
      FROM records)""", select=f"""
SELECT row_id,
  {r6('("StudyTimeWeekly" - s[2]) / CASE WHEN s[3] - s[1] = 0 THEN 1 ELSE s[3] - s[1] END')} AS "StudyTimeWeekly",
  {r6('("Absences" - a[2]) / CASE WHEN a[3] - a[1] = 0 THEN 1 ELSE a[3] - a[1] END')} AS "Absences"
FROM records, q"""))
def q_robust(spark, sf):
    r = records(spark, sf).select("row_id", "StudyTimeWeekly", "Absences")
    return rounded(FE.RobustScaler(inputCols=["StudyTimeWeekly", "Absences"]).fit(r).transform(r))


@query("standard_scale", with_records(select=f"""
SELECT row_id, {r6('("GPA" - avg("GPA") OVER ()) / stddev_pop("GPA") OVER ()')} AS "GPA",
       {r6('("Absences" - avg("Absences") OVER ()) / stddev_pop("Absences") OVER ()')} AS "Absences"
FROM records"""))
def q_standard(spark, sf):
    r = records(spark, sf).select("row_id", "GPA", "Absences")
    return rounded(FE.StandardScaler(inputCols=["GPA", "Absences"]).fit(r).transform(r))


@query("minmax_normalise", with_records(select=f"""
SELECT row_id, {r6('("GPA" - min("GPA") OVER ()) / (max("GPA") OVER () - min("GPA") OVER ())')} AS "GPA" FROM records"""))
def q_minmax(spark, sf):
    r = records(spark, sf).select("row_id", "GPA")
    return rounded(FE.MinMaxScaler(inputCols=["GPA"]).fit(r).transform(r))


@query("iqr_cap", with_records("""
q AS (SELECT quantile_cont("Absences", 0.25) AS q1, quantile_cont("Absences", 0.75) AS q3 FROM records)""", select=f"""
SELECT row_id, {r6('CASE WHEN "Absences" > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) WHEN "Absences" < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1) ELSE "Absences" END')} AS "Absences"
FROM records, q"""))
def q_iqr(spark, sf):
    r = records(spark, sf).select("row_id", F.col("Absences").cast("double").alias("Absences"))
    return rounded(FE.IQRCapper(inputCols=["Absences"]).fit(r).transform(r))


@query("ordered_target_encoding", with_records(PREPARED, select=f"""
SELECT row_id, {r6('''(coalesce(sum("GradeClass") OVER (PARTITION BY "ParentalEducation" ORDER BY row_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + avg("GradeClass") OVER ())
       / (count(*) OVER (PARTITION BY "ParentalEducation" ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1)''')} AS pe_te
FROM prepared"""))
def q_target_enc(spark, sf):
    p = prepared_records(spark, sf).select("row_id", "ParentalEducation", "GradeClass")
    enc, _ = FE.ordered_target_encode(p, "ParentalEducation", "GradeClass", "row_id", out="pe_te")
    return rounded(enc.select("row_id", "pe_te"))


@query("yeo_johnson_power")
def q_yj(spark, sf):
    """Lambda by maximum likelihood (grid refined); checked against scipy-free brute force in tests."""
    r = records(spark, sf).select("row_id", "StudyTimeWeekly", F.col("Absences").cast("double").alias("Absences"))
    m = FE.YeoJohnson(inputCols=["StudyTimeWeekly", "Absences"]).fit(r)
    return rounded(m.transform(r))


@query("chained_equation_impute")
def q_mice(spark, sf):
    r = records(spark, sf).select("row_id", "ParentalEducation", F.col("InternetAccess").cast("double"),
                                  "StudyTimeWeekly", F.col("Absences").cast("double"), "GPA")
    m = FE.ChainedImputer(inputCols=["ParentalEducation", "InternetAccess", "StudyTimeWeekly", "Absences", "GPA"]).fit(r)
    return rounded(m.transform(r))


# ---------------------------------------------------------------- A1-A12 aggregations

@query("persona_profile", with_records(select=f"""
SELECT "DatasetType", count(*) AS n, {r6('avg("GPA")')} AS "mean_GPA", {r6('avg("StudyTimeWeekly")')} AS "mean_StudyTimeWeekly",
       {r6('avg("Absences")')} AS "mean_Absences" FROM records GROUP BY 1"""))
def q_profile(spark, sf):
    return rounded(A.profile(records(spark, sf), "DatasetType", ["GPA", "StudyTimeWeekly", "Absences"]))


@query("grade_value_counts", with_records(select="""
SELECT "GradeClass", count(*) AS n, CASE "GradeClass" WHEN 0 THEN 'A (0)' WHEN 1 THEN 'B (1)' WHEN 2 THEN 'C (2)'
       WHEN 3 THEN 'D (3)' WHEN 4 THEN 'F (4)' END AS label FROM records GROUP BY 1"""))
def q_counts(spark, sf):
    labels = {0: "A (0)", 1: "B (1)", 2: "C (2)", 3: "D (3)", 4: "F (4)"}
    return A.value_counts(records(spark, sf), "GradeClass", labels)


@query("kpi_row", with_records(select=f"""
SELECT count(*) AS n, {r6('avg("GPA")')} AS "mean_GPA", count_if("GradeClass" >= 3)::BIGINT AS at_risk,
       {r6('count_if("GradeClass" >= 3) * 100.0 / count(*)')} AS at_risk_pct FROM records"""))
def q_kpi(spark, sf):
    return rounded(A.kpi_row(records(spark, sf)))


@query("lineitem_quantiles", f"""
SELECT column_name, p, {r6('value')} AS value FROM (
  SELECT 'l_extendedprice' AS column_name, unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS p,
         unnest(quantile_cont(l_extendedprice, [0.1, 0.25, 0.5, 0.75, 0.9])) AS value FROM lineitem
  UNION ALL
  SELECT 'l_quantity', unnest([0.1, 0.25, 0.5, 0.75, 0.9]), unnest(quantile_cont(l_quantity, [0.1, 0.25, 0.5, 0.75, 0.9]))
  FROM lineitem)""")
def q_quant(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(A.quantiles(li, ["l_extendedprice", "l_quantity"], [0.1, 0.25, 0.5, 0.75, 0.9]))


_CORR_COLS = ["GPA", "StudyTimeWeekly", "Absences", "ParentalEducation", "InternetAccess"]


def _corr_sql():
    import itertools
    parts = []
    for a, b in itertools.combinations_with_replacement(_CORR_COLS, 2):
        parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r6(f'corr(\"{a}\", \"{b}\")')} AS r FROM records")
        if a != b:
            parts.append(f"SELECT '{b}', '{a}', {r6(f'corr(\"{a}\", \"{b}\")')} FROM records")
    return "\nUNION ALL\n".join(parts)


@query("correlation_matrix", with_records(select=_corr_sql()))
def q_corr(spark, sf):
    return rounded(A.corr_matrix(records(spark, sf), _CORR_COLS))


@query("correlation_with_target", with_records(select="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {r6(f'corr(\"{c}\", \"GradeClass\")')} AS r FROM records" for c in _CORR_COLS)))
def q_corr_t(spark, sf):
    return rounded(A.corr_with_target(records(spark, sf), _CORR_COLS, "GradeClass"))


@query("histogram_extendedprice", f"""
WITH mm AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT CAST(least(floor((l_extendedprice - lo) * 20.0 / (hi - lo)) + 1, 20) AS INT) AS bin FROM lineitem, mm
      WHERE l_extendedprice IS NOT NULL)
SELECT bin, {r6('lo + (bin - 1) * ((hi - lo) / 20)')} AS lo, {r6('lo + bin * ((hi - lo) / 20)')} AS hi, n
FROM (SELECT bin, count(*) AS n FROM b GROUP BY bin), mm""")
def q_hist(spark, sf):
    return rounded(A.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20))


@query("kde_gpa", with_records("""
st AS (SELECT count("GPA") AS n, stddev_samp("GPA") * pow(count("GPA"), -0.2) AS h, min("GPA") AS lo, max("GPA") AS hi FROM records)""",
 """vals AS (SELECT "GPA" AS v, count(*) AS c FROM records WHERE "GPA" IS NOT NULL GROUP BY 1)""", select=f"""
SELECT g, {r6('lo - 3 * h + g * ((hi + 3 * h - (lo - 3 * h)) / 49)')} AS x,
       {r6('sum(c * exp(-0.5 * pow((lo - 3 * h + g * ((hi + 3 * h - (lo - 3 * h)) / 49) - v) / h, 2))) * (1.0 / (n * h * sqrt(2 * pi())))')} AS density
FROM vals, st, (SELECT range AS g FROM range(50)) grid GROUP BY g, lo, hi, h, n"""))
def q_kde(spark, sf):
    return rounded(A.kde(records(spark, sf), "GPA", grid=50))


@query("box_stats_extendedprice", f"""
WITH q AS (SELECT l_returnflag, count(l_extendedprice) AS n, quantile_cont(l_extendedprice, 0.25) AS q1,
                  quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3
           FROM lineitem GROUP BY 1)
SELECT q.l_returnflag, n, {r6('q1')} AS q1, {r6('median')} AS median, {r6('q3')} AS q3,
       {r6('min(CASE WHEN l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN l_extendedprice END)')} AS whisker_lo,
       {r6('max(CASE WHEN l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN l_extendedprice END)')} AS whisker_hi,
       count_if(NOT (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)))::BIGINT AS n_outliers
FROM lineitem l JOIN q ON l.l_returnflag = q.l_returnflag GROUP BY q.l_returnflag, n, q1, median, q3""")
def q_box(spark, sf):
    return rounded(A.box_stats(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"))


_PAIR = ["GPA", "StudyTimeWeekly", "Absences"]


def _pair_sql():
    import itertools
    mm = ", ".join(f'min("{c}") AS "lo_{c}", max("{c}") AS "hi_{c}"' for c in _PAIR)

    def b(c):
        return f'CAST(least(floor(("{c}" - "lo_{c}") * 10.0 / ("hi_{c}" - "lo_{c}")) + 1, 10) AS INT)'
    parts = [f"SELECT '{a}' AS col_a, '{c}' AS col_b, {b(a)} AS bin_a, {b(c)} AS bin_b FROM records, mm"
             for a, c in itertools.combinations(_PAIR, 2)]
    return (f"mm AS (SELECT {mm} FROM records)",
            f"SELECT col_a, col_b, bin_a, bin_b, count(*) AS n FROM ({' UNION ALL '.join(parts)}) "
            "WHERE bin_a IS NOT NULL AND bin_b IS NOT NULL GROUP BY ALL")


@query("pair_plot_bins", with_records(_pair_sql()[0], select=_pair_sql()[1]))
def q_pairs(spark, sf):
    return A.pair_bins(records(spark, sf), _PAIR, 10)


@query("quantile_bins_study", with_records("""
e AS (SELECT list_sort(list_distinct(quantile_cont("StudyTimeWeekly", [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM records)""",
 """b AS (SELECT CASE WHEN "StudyTimeWeekly" >= e[1] AND "StudyTimeWeekly" <= e[len(e)]
                 THEN CAST(len(list_filter(e[2:len(e) - 1], lambda x: "StudyTimeWeekly" > x)) AS INT) END AS qbin, e FROM records, e)""",
 select=f"""SELECT qbin, {r6('e[qbin + 1]')} AS lo, {r6('e[qbin + 2]')} AS hi, count(*) AS n FROM b WHERE qbin IS NOT NULL
GROUP BY qbin, e"""))
def q_qcut(spark, sf):
    return rounded(A.qcut_table(records(spark, sf), "StudyTimeWeekly", 5))


@query("interaction_study_internet", with_records(PREPARED, """
e AS (SELECT list_sort(list_distinct(quantile_cont("StudyTimeWeekly", [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM prepared)""",
 """b AS (SELECT CASE WHEN "StudyTimeWeekly" >= e[1] AND "StudyTimeWeekly" <= e[len(e)]
                 THEN CAST(len(list_filter(e[2:len(e) - 1], lambda x: "StudyTimeWeekly" > x)) AS INT) END AS qbin,
                 "InternetAccess", "GPA" FROM prepared, e)""",
 select=f"""SELECT qbin, "InternetAccess", count(*) AS n, {r6('avg("GPA")')} AS mean,
  {r6('avg("GPA") - 1.96 * coalesce(stddev_samp("GPA"), 0) / sqrt(count(*))')} AS ci_lo,
  {r6('avg("GPA") + 1.96 * coalesce(stddev_samp("GPA"), 0) / sqrt(count(*))')} AS ci_hi
FROM b WHERE qbin IS NOT NULL GROUP BY 1, 2"""))
def q_interact(spark, sf):
    return rounded(A.interaction_table(prepared_records(spark, sf), "StudyTimeWeekly", "GPA", "InternetAccess"))


@query("interaction_bootstrap_internet", with_records(PREPARED, """
e AS (SELECT list_sort(list_distinct(quantile_cont("StudyTimeWeekly", [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM prepared)""",
 """b AS (SELECT row_id, CASE WHEN "StudyTimeWeekly" >= e[1] AND "StudyTimeWeekly" <= e[len(e)]
                 THEN CAST(len(list_filter(e[2:len(e) - 1], lambda x: "StudyTimeWeekly" > x)) AS INT) END AS qbin,
                 "InternetAccess", "GPA" FROM prepared, e)""",
 f"""u AS (SELECT qbin, "InternetAccess", "GPA", i, ('0x' || substr(md5(concat(row_id::VARCHAR, '-', (i // 4)::VARCHAR, '-42')), (i % 4) * 8 + 1, 8))::BIGINT / {float(16 ** 8)} AS u
      FROM b, (SELECT range::INT AS i FROM range(1000)) WHERE qbin IS NOT NULL AND "GPA" IS NOT NULL)""",
 f"""m AS (SELECT qbin, "InternetAccess", i, count(*) AS n, avg("GPA") AS mean, sum("GPA" * w) / nullif(sum(w), 0) AS v
      FROM (SELECT *, {' + '.join(f'(u >= {c})::INT' for c in A.POISSON_CDF)} AS w FROM u) GROUP BY 1, 2, 3)""",
 select=f"""SELECT qbin, "InternetAccess", max(n) AS n, {r6('max(mean)')} AS mean, {r6('quantile_cont(v, 0.025)')} AS ci_lo, {r6('quantile_cont(v, 0.975)')} AS ci_hi
FROM m GROUP BY 1, 2"""))
def q_interact_boot(spark, sf):
    return rounded(A.interaction_table(prepared_records(spark, sf), "StudyTimeWeekly", "GPA", "InternetAccess", n_boot=1000, id_col="row_id"))


@query("test_rows_with_raw", with_records(PREPARED, select=f"""
SELECT t.row_id, t."GradeClass", t."InternetAccess", r."InternetAccess" AS "InternetAccess_raw"
FROM (SELECT row_id, "GradeClass", "InternetAccess" FROM (SELECT row_id, "GradeClass", "InternetAccess",
        row_number() OVER (PARTITION BY "GradeClass" ORDER BY {MD5}) AS rn,
        count(*) OVER (PARTITION BY "GradeClass") AS n FROM prepared) WHERE rn <= round(n * 0.2)) t
LEFT JOIN records r ON t.row_id = r.row_id"""))
def q_test_raw(spark, sf):
    _, test = S.stratified_split(prepared_records(spark, sf), "row_id", "GradeClass", 0.2, 42)
    raw = records(spark, sf).select("row_id", F.col("InternetAccess").alias("InternetAccess_raw"))
    return test.select("row_id", "GradeClass", "InternetAccess").join(raw, "row_id", "left")


def _yj_sql(c):
    x = f'CAST("{c}" AS DOUBLE)'
    return f"CASE WHEN {x} >= 0 THEN (pow({x} + 1, 0.5) - 1) / 0.5 ELSE -(pow(-{x} + 1, 1.5) - 1) / 1.5 END"


@query("yeo_johnson_fixed_lambda", with_records(
    "t AS (SELECT row_id, " + ", ".join(f'{_yj_sql(c)} AS "{c}"' for c in ["StudyTimeWeekly", "Absences"]) + " FROM records)",
    select="SELECT row_id, " + ", ".join(
        r6(f'("{c}" - avg("{c}") OVER ()) / stddev_pop("{c}") OVER ()') + f' AS "{c}"'
        for c in ["StudyTimeWeekly", "Absences"]) + " FROM t"))
def q_yj_fixed(spark, sf):
    r = records(spark, sf).select("row_id", "StudyTimeWeekly", F.col("Absences").cast("double"))
    return rounded(FE.yeo_johnson_fixed(r, ["StudyTimeWeekly", "Absences"], 0.5))


@query("column_group_transform")
def q_column_groups(spark, sf):
    d = records(spark, sf)
    from ..functions.expressions import interaction_features
    d = interaction_features(d.na.fill(0, ["InternetAccess"]))
    train, test = S.stratified_split(d, "row_id", "GradeClass", 0.2, 42)
    numeric = ["StudyTimeWeekly", "Absences", "TechSynergy", "SelfDriven", "SupportIndex", "BalancedLife",
               "AbsenceRisk"]
    groups = ColumnGroupTransformer(numeric, ["ParentalEducation"], ["Gender", "Tutoring", "Extracurricular", "InternetAccess"], "GradeClass", "row_id")
    return rounded(groups.fit(train).transform(test))


@query("changed_cells_capping", f"""
WITH q AS (SELECT quantile_cont(value, 0.25) AS a1, quantile_cont(value, 0.75) AS a3 FROM events),
c AS (SELECT event_id, value AS o, CASE WHEN value > a3 + 1.5 * (a3 - a1) THEN a3 + 1.5 * (a3 - a1)
             WHEN value < a1 - 1.5 * (a3 - a1) THEN a1 - 1.5 * (a3 - a1) ELSE value END AS n FROM events, q)
SELECT event_id, 'value' AS feature, {r6('o')} AS from_value, {r6('n')} AS to_value FROM c WHERE o IS DISTINCT FROM n""")
def q_changed_capping(spark, sf):
    """Show only the cells a proposal changes (here: what the IQR cap changes in event values)."""
    from ..operators.explain import changed_cells
    ev = table(spark, sf, "events").select("event_id", F.col("value").cast("double").alias("value"))
    orig = ev.select("event_id", F.col("value").alias("_o_value"))
    capped = FE.IQRCapper(inputCols=["value"]).fit(ev).transform(ev)
    return rounded(changed_cells(capped.join(orig, "event_id"), "event_id", ["value"], rank_col=None))
