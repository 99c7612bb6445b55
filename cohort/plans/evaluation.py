"""Registered queries: evaluation, policy value, drift, hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import hypothesis as H
from ..operators import monitor as M
from ..operators import policy as P
from ..operators.aggregate import kpi_row
from ..sources.tables import records, table, with_records
from .audit import prepared_records, rounded_grade_scorer
from .registry import query, rounded
from .sqlfrag import PREPARED, grade_bins, r6

# ---------------------------------------------------------------- E1-E7 evaluation

_SCORED = f"""scored AS (SELECT "GradeClass" AS y, {grade_bins('round_even("GPA" * 2, 0) / 2')} AS p, "GPA",
                  round_even("GPA" * 2, 0) / 2 AS gpa_hat FROM records)"""
_LI_SCORED = """scored AS (SELECT CAST(4 - floor((l_quantity - 1) / 10) AS INT) AS y, CAST(round(l_discount * 40) AS INT) AS p
                FROM lineitem)"""
_CONF = """conf AS (SELECT y, p, count(*) AS n FROM scored WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2)"""
_LAB = """lab AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT y AS label FROM conf UNION SELECT p FROM conf))"""
_KAPPA = f"""SELECT {r6('1 - sum(n * (a.idx - b.idx) * (a.idx - b.idx))::DOUBLE / (sum(n * a.idx * a.idx) + sum(n * b.idx * b.idx) - 2.0 * sum(n * a.idx) * sum(n * b.idx) / sum(n))')} AS qwk
FROM conf c JOIN lab a ON c.y = a.label JOIN lab b ON c.p = b.label"""
_PC = """pc AS (
  SELECT l.label, coalesce(tp.n, 0) AS tp, coalesce(s.n, 0) AS support, coalesce(pr.n, 0) AS predicted
  FROM (SELECT y AS label FROM conf UNION SELECT p FROM conf) l
  LEFT JOIN (SELECT y AS label, n FROM conf WHERE y = p) tp ON tp.label = l.label
  LEFT JOIN (SELECT y AS label, sum(n) AS n FROM conf GROUP BY 1) s ON s.label = l.label
  LEFT JOIN (SELECT p AS label, sum(n) AS n FROM conf GROUP BY 1) pr ON pr.label = l.label),
pc2 AS (SELECT label, coalesce(tp::DOUBLE / nullif(predicted, 0), 0.0) AS precision,
               coalesce(tp::DOUBLE / nullif(support, 0), 0.0) AS recall, support::BIGINT AS support FROM pc),
pc3 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM pc2),
rep AS (
  SELECT CAST(label AS VARCHAR) AS label, precision, recall, f1, support FROM pc3
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM pc3
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support)::BIGINT FROM pc3)"""


def _scored_records(spark, sf):
    return rounded_grade_scorer(records(spark, sf)).withColumn("gpa_hat", F.bround(F.col("GPA") * 2, 0) / 2)


def _scored_lineitem(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.lit(4) - F.floor((F.col("l_quantity") - 1) / 10)).cast("int").alias("y"),
                     F.round(F.col("l_discount") * 40).cast("int").alias("p"))


@query("confusion_matrix", with_records(_SCORED, _CONF, select="""
SELECT a.label AS actual, b.label AS predicted, coalesce(conf.n, 0)::BIGINT AS n
FROM (SELECT y AS label FROM conf UNION SELECT p FROM conf) a
CROSS JOIN (SELECT y AS label FROM conf UNION SELECT p FROM conf) b
LEFT JOIN conf ON conf.y = a.label AND conf.p = b.label"""))
def q_confusion(spark, sf):
    return E.confusion_matrix(_scored_records(spark, sf), "GradeClass", "pred_class")


@query("qwk_records", with_records(_SCORED, _CONF, _LAB, select=_KAPPA))
def q_qwk(spark, sf):
    return rounded(E.quadratic_kappa(_scored_records(spark, sf), "GradeClass", "pred_class"))


@query("qwk_lineitem", f"WITH {_LI_SCORED}, {_CONF}, {_LAB}\n{_KAPPA}")
def q_qwk_li(spark, sf):
    return rounded(E.quadratic_kappa(_scored_lineitem(spark, sf), "y", "p"))


@query("classification_report", with_records(_SCORED, _CONF, _PC, select=f"""
SELECT label, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, support FROM rep"""))
def q_report(spark, sf):
    return rounded(E.classification_report(_scored_records(spark, sf), "GradeClass", "pred_class"))


_METRICS_SQL = f"""metrics AS (
  SELECT 'qwk' AS metric, (SELECT qwk FROM ({_KAPPA})) AS value
  UNION ALL SELECT 'accuracy', sum(CASE WHEN y = p THEN n ELSE 0 END)::DOUBLE / sum(n) FROM conf
  UNION ALL SELECT 'precision_weighted', precision FROM rep WHERE label = 'weighted avg'
  UNION ALL SELECT 'recall_weighted', recall FROM rep WHERE label = 'weighted avg'
  UNION ALL SELECT 'f1_weighted', f1 FROM rep WHERE label = 'weighted avg'
  UNION ALL SELECT 'f1_macro', f1 FROM rep WHERE label = 'macro avg')"""


@query("classification_metrics", with_records(_SCORED, _CONF, _LAB, _PC, _METRICS_SQL,
                                              select=f"SELECT metric, {r6('value')} AS value FROM metrics"))
def q_metrics(spark, sf):
    return rounded(E.classification_metrics(_scored_records(spark, sf), "GradeClass", "pred_class"))


@query("regression_metrics", with_records(_SCORED, select=f"""
SELECT {r6('sqrt(avg(("GPA" - gpa_hat) * ("GPA" - gpa_hat)))')} AS rmse,
       {r6('1 - sum(("GPA" - gpa_hat) * ("GPA" - gpa_hat)) / (sum("GPA" * "GPA") - sum("GPA") * sum("GPA") / count(*))')} AS r2
FROM scored"""))
def q_regression(spark, sf):
    return rounded(E.regression_metrics(_scored_records(spark, sf), "GPA", "gpa_hat"))


_BASE_SCORED = """scored AS (SELECT "GradeClass" AS y, 2 AS p FROM records)"""


@query("model_comparison", with_records(
    _SCORED, _CONF, _LAB, _PC, _METRICS_SQL.replace("metrics AS", "m_a AS"),
    "scored_b AS (SELECT \"GradeClass\" AS y, 2 AS p FROM records)",
    "conf_b AS (SELECT y, p, count(*) AS n FROM scored_b GROUP BY 1, 2)",
    "lab_b AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT y AS label FROM conf_b UNION SELECT p FROM conf_b))",
    _PC.replace("conf", "conf_b").replace("pc AS", "pcb AS").replace("FROM pc)", "FROM pcb)")
       .replace("pc2", "pcb2").replace("pc3", "pcb3").replace("rep AS", "rep_b AS"),
    _METRICS_SQL.replace("metrics AS", "m_b AS").replace("FROM conf", "FROM conf_b").replace("FROM rep", "FROM rep_b")
       .replace("JOIN lab ", "JOIN lab_b "),
    select=f"""
SELECT coalesce(a.metric, b.metric) AS metric, {r6('a.value')} AS value_a, {r6('b.value')} AS value_b,
       {r6('b.value - a.value')} AS delta,
       CASE WHEN a.value = b.value THEN 'tie' WHEN b.value > a.value THEN 'majority' ELSE 'rounded' END AS winner
FROM m_a a FULL JOIN m_b b ON a.metric = b.metric"""))
def q_compare(spark, sf):
    s = _scored_records(spark, sf)
    a = E.classification_metrics(s, "GradeClass", "pred_class")
    b = E.classification_metrics(s.withColumn("majority", F.lit(2)), "GradeClass", "majority")
    return rounded(E.compare_metrics(a, b, "rounded", "majority"))


# ---------------------------------------------------------------- X8, X9, X13 decision logs

_LOG = """log AS (SELECT event_id, event_type AS action, CAST(value > 50 AS INT) AS reward,
                  count(*) OVER (PARTITION BY event_type) / count(*) OVER () AS propensity FROM events)"""


def _log(spark, sf):
    ev = table(spark, sf, "events")
    log = ev.select("event_id", F.col("event_type").alias("action"), (F.col("value") > 50).cast("int").alias("reward"))
    return P.empirical_propensity(log, "action")


@query("action_values", f"""WITH {_LOG}
SELECT action, count(*) AS n, {r6('avg(reward)')} AS value,
       row_number() OVER (ORDER BY avg(reward) DESC, action ASC) = 1 AS is_greedy
FROM log GROUP BY action""")
def q_action_values(spark, sf):
    return rounded(P.action_values(_log(spark, sf)))


@query("running_action_values", f"""WITH {_LOG}
SELECT event_id, action, reward, {r6('propensity')} AS propensity,
       count(*) OVER w AS pulls, {r6('sum(reward) OVER w / count(*) OVER w')} AS running_value
FROM log WINDOW w AS (PARTITION BY action ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_running_values(spark, sf):
    return rounded(P.running_action_values(_log(spark, sf), "event_id"))


@query("ips_policy_value", f"""WITH {_LOG},
g AS (SELECT action FROM log GROUP BY action ORDER BY avg(reward) DESC, action ASC LIMIT 1)
SELECT {r6('avg(reward)')} AS logged_value,
       {r6('avg(CASE WHEN action = (SELECT action FROM g) THEN reward / propensity ELSE 0.0 END)')} AS ips_value,
       {r6('(avg(CASE WHEN action = (SELECT action FROM g) THEN reward / propensity ELSE 0.0 END) - avg(reward)) * 100.0 / avg(reward)')} AS uplift_pct
FROM log""")
def q_ips(spark, sf):
    log = _log(spark, sf)
    return rounded(P.ips_value(log, P.greedy_action(log)))


@query("intervention_roi", with_records(select=f"""
SELECT count_if("GradeClass" >= 3)::BIGINT AS targeted, {r6('count_if("GradeClass" >= 3) * 500.0')} AS cost,
       {r6('count_if("GradeClass" >= 3) * 0.85 * 0.4')} AS retained,
       {r6('count_if("GradeClass" >= 3) * 0.85 * 0.4 * 20000.0')} AS value_saved,
       {r6('count_if("GradeClass" >= 3) * 0.85 * 0.4 * 20000.0 - count_if("GradeClass" >= 3) * 500.0')} AS net,
       {r6('coalesce((count_if("GradeClass" >= 3) * 0.85 * 0.4 * 20000.0) / nullif(count_if("GradeClass" >= 3) * 500.0, 0), 0.0)')} AS roi_ratio
FROM records"""))
def q_roi(spark, sf):
    return rounded(P.intervention_roi(kpi_row(records(spark, sf)), recall=0.85))


# ---------------------------------------------------------------- X10, X11 drift

_DRIFT_COLS = ["StudyTimeWeekly", "Absences", "GPA", "ParentalEducation"]


def _psi_sql(ref: str, cur: str, cols, outer: str = "drop") -> tuple[list[str], str]:
    probs = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"
    ctes, sels = [], []
    for i, c in enumerate(cols):
        x = f'CAST("{c}" AS DOUBLE)'
        ctes.append(f"""e{i} AS (SELECT CASE WHEN count(DISTINCT "{c}") > 10
            THEN list_sort(list_distinct(quantile_cont({x}, {probs})))
            ELSE list_sort(list_distinct(list_append(list({x}) FILTER (WHERE "{c}" IS NOT NULL), max({x}) + 1e-10))) END AS e
          FROM {ref})""")

        def b(tbl):
            if outer == "open":      # 10 inner edges or fewer split the whole line
                return f"""SELECT CASE WHEN {x} IS NOT NULL THEN len(list_filter(e[2:len(e) - 1], lambda v: {x} >= v)) END AS bin
                   FROM {tbl}, e{i}"""
            return f"""SELECT CASE WHEN {x} >= e[1] AND {x} <= e[len(e)] THEN
                   CASE WHEN {x} = e[len(e)] THEN len(e) - 2 ELSE len(list_filter(e[2:len(e) - 1], lambda v: {x} >= v)) END END AS bin
                   FROM {tbl}, e{i}"""
        ctes.append(f"""s{i} AS (
          SELECT g.bin, coalesce(ce.n, 0) / (SELECT count(*) FROM {ref}) AS pe, coalesce(ca.n, 0) / (SELECT count(*) FROM {cur}) AS pa
          FROM (SELECT unnest(range(len(e) - 1)) AS bin FROM e{i}) g
          LEFT JOIN (SELECT bin, count(*) AS n FROM ({b(ref)}) WHERE bin IS NOT NULL GROUP BY bin) ce ON ce.bin = g.bin
          LEFT JOIN (SELECT bin, count(*) AS n FROM ({b(cur)}) WHERE bin IS NOT NULL GROUP BY bin) ca ON ca.bin = g.bin)""")
        f = "CASE WHEN {0} = 0 THEN 0.0001 ELSE {0} END"
        sels.append(f"""SELECT '{c}' AS column_name, sum(({f.format('pa')} - {f.format('pe')}) * ln({f.format('pa')} / {f.format('pe')})) AS psi FROM s{i}""")
    return ctes, "\nUNION ALL\n".join(sels)


_RECORD_PAIR = ["ref AS (SELECT * FROM records WHERE row_id < 3000000000)",
                "cur AS (SELECT * FROM records WHERE row_id >= 3000000000)"]
_psi_ctes, _psi_sel = _psi_sql("ref", "cur", _DRIFT_COLS)


def _record_psi(spark, sf, outer="drop"):
    r = records(spark, sf)
    return M.psi(r.where(F.col("row_id") < 3000000000), r.where(F.col("row_id") >= 3000000000), _DRIFT_COLS, outer=outer)


@query("psi_sources", with_records(*_RECORD_PAIR, *_psi_ctes, select=f"SELECT column_name, {r6('psi')} AS psi FROM ({_psi_sel})"))
def q_psi(spark, sf):
    return rounded(_record_psi(spark, sf))


_psi_open_ctes, _psi_open_sel = _psi_sql("ref", "cur", _DRIFT_COLS, "open")


@query("psi_sources_open", with_records(*_RECORD_PAIR, *_psi_open_ctes, select=f"SELECT column_name, {r6('psi')} AS psi FROM ({_psi_open_sel})"))
def q_psi_open(spark, sf):
    return rounded(_record_psi(spark, sf, "open"))


@query("drift_status", with_records(*_RECORD_PAIR, *_psi_ctes, select=f"""
SELECT column_name, {r6('psi')} AS psi, CASE WHEN psi > 0.2 THEN 'Drift Detected (Critical)' WHEN psi > 0.1 THEN 'Warning'
       ELSE 'Stable' END AS status FROM ({_psi_sel})"""))
def q_drift(spark, sf):
    return rounded(M.drift_status(_record_psi(spark, sf)))


_EV_HALVES = ["""evx AS (SELECT event_id, value, CAST(floor(value / 25) AS INT) AS value_band, hour(ts) AS hour,
                row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS n FROM events)""",
              "ref AS (SELECT * FROM evx WHERE rn <= n // 2)", "cur AS (SELECT * FROM evx WHERE rn > n // 2)"]
_ev_ctes, _ev_sel = _psi_sql("ref", "cur", ["value", "value_band", "hour"])


@query("psi_event_halves", f"WITH {', '.join(_EV_HALVES + _ev_ctes)}\nSELECT column_name, {r6('psi')} AS psi FROM ({_ev_sel})")
def q_psi_events(spark, sf):
    from ..operators.split import halves
    ev = table(spark, sf, "events").select("event_id", "value", F.floor(F.col("value") / 25).cast("int")
                                           .alias("value_band"), F.hour("ts").alias("hour"))
    h = halves(ev, "event_id")
    return rounded(M.psi(h.where(F.col("part") == "reference"), h.where(F.col("part") == "current"),
                         ["value", "value_band", "hour"], outer="drop"))


# ---------------------------------------------------------------- H1, H2, H4, H9 hypothesis tests

HYPOTHESES = [("TechSynergy_Effect", "TechSynergy", "GPA"), ("BalancedLife_Effect", "BalancedLife", "GPA"),
              ("AbsenceRisk_Effect", "AbsenceRisk", "GradeClass"), ("Tutoring_Effect", "Tutoring", "GPA")]


def _mw_sql():
    parts = []
    for name, g, y in HYPOTHESES:
        parts.append(f"""SELECT '{name}' AS hypothesis,
          CASE WHEN (SELECT count(DISTINCT "{g}") FROM featured) > 2 THEN
               CASE WHEN "{g}" > (SELECT quantile_cont(CAST("{g}" AS DOUBLE), 0.5) FROM featured) THEN 'High' WHEN "{g}" IS NOT NULL THEN 'Low' END
          ELSE CASE WHEN "{g}" = (SELECT max("{g}") FROM featured) THEN 'High' WHEN "{g}" = (SELECT min("{g}") FROM featured) THEN 'Low' END END AS grp,
          CAST("{y}" AS DOUBLE) AS y FROM featured""")
    stacked = "hyp AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE grp IS NOT NULL AND y IS NOT NULL)"
    rest = ["""vals AS (SELECT hypothesis, y, count_if(grp = 'High') AS c1, count(*) AS t FROM hyp GROUP BY 1, 2)""",
            """rk AS (SELECT *, sum(t) OVER (PARTITION BY hypothesis ORDER BY y ROWS UNBOUNDED PRECEDING) AS cum FROM vals)""",
            """g AS (SELECT hypothesis, sum(c1 * (cum - t + (t + 1) / 2.0)) AS r1, sum(c1)::DOUBLE AS n1, sum(t)::DOUBLE AS n,
                        sum(pow(t, 3) - t) AS ties FROM rk GROUP BY 1)""",
            """u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1 FROM g)""",
            """zz AS (SELECT *, (greatest(u1, n1 * (n - n1) - u1) - n1 * (n - n1) / 2 - 0.5)
                     / sqrt(n1 * (n - n1) / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM u)"""]
    sel = f"""SELECT hypothesis, n1::BIGINT AS n_high, (n - n1)::BIGINT AS n_low, {r6('u1')} AS u, {r6('z')} AS z,
       {r6(f'least(1.0, greatest(0.0, {H.erfc_sql("(z / sqrt(2.0))")}))')} AS p_value FROM zz"""
    return [stacked] + rest, sel


_mw_ctes, _mw_sel = _mw_sql()


@query("mann_whitney_batch", with_records(PREPARED, *_mw_ctes, select=_mw_sel))
def q_mw(spark, sf):
    return rounded(H.mann_whitney_batch(prepared_records(spark, sf), HYPOTHESES))


@query("vif_two_columns", with_records(select=f"""
SELECT f AS feature, {r6('1.0 / (1.0 - sxy * sxy / (sxx * syy))')} AS vif, 1.0 / (1.0 - sxy * sxy / (sxx * syy)) > 10 AS high
FROM (SELECT sum("GPA" * "StudyTimeWeekly") AS sxy, sum("GPA" * "GPA") AS sxx, sum("StudyTimeWeekly" * "StudyTimeWeekly") AS syy
      FROM records WHERE "GPA" IS NOT NULL AND "StudyTimeWeekly" IS NOT NULL), (SELECT unnest(['GPA', 'StudyTimeWeekly']) AS f)"""))
def q_vif2(spark, sf):
    return rounded(H.vif_frame(records(spark, sf), ["GPA", "StudyTimeWeekly"]))


@query("vif_features")
def q_vif(spark, sf):
    cols = ["StudyTimeWeekly", "Absences", "ParentalEducation", "TechSynergy", "SelfDriven", "SupportIndex",
            "BalancedLife", "AbsenceRisk"]
    return rounded(H.vif_frame(prepared_records(spark, sf), cols))


@query("causal_edges_pc")
def q_pc(spark, sf):
    cols = ["StudyTimeWeekly", "Absences", "ParentalEducation", "Tutoring", "InternetAccess", "GPA"]
    return rounded(H.causal_edges(prepared_records(spark, sf), cols))


@query("binary_treatment_counts", with_records(select="""
SELECT CAST(coalesce(lower(CAST("InternetAccess" AS VARCHAR)) IN ('yes', '1', 'true'), false) AS INT) AS treatment,
       count(*) AS n FROM records GROUP BY 1"""))
def q_treatment(spark, sf):
    t = H.binary_treatment(records(spark, sf), "InternetAccess", truthy=True)
    return t.groupBy("treatment").agg(F.count(F.lit(1)).alias("n"))


@query("drift_overall", with_records(*_RECORD_PAIR, *_psi_ctes, select=f"""
SELECT bool_or(psi > 0.2) AS drift_detected, {r6('max(psi)')} AS max_psi FROM ({_psi_sel})"""))
def q_drift_overall(spark, sf):
    return rounded(M.drift_overall(_record_psi(spark, sf)))
