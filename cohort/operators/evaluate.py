"""Classification and regression evaluation from sufficient statistics.

Every metric is computed from the confusion table ``groupBy(y, p).count()``, a table of at
most k^2 rows (k = number of labels), so the only pass over the data is one grouped
aggregate with map-side combine. Labels are the sorted union of observed true and
predicted labels; quadratic weights use label *positions* in that list.
"""

from __future__ import annotations

from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """(y, p, n) for observed pairs only; rows with a null label or prediction are dropped."""
    return (df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
            .groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n")))


def _labels(conf: DataFrame) -> DataFrame:
    """Sorted union of labels with their position (window over <= k rows)."""
    lab = conf.select(F.col("y").alias("label")).union(conf.select(F.col("p").alias("label"))).distinct()
    return lab.withColumn("idx", F.row_number().over(Window.orderBy("label")) - 1)


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """Dense k x k table (actual, predicted, n) with missing cells as 0.

    The label grid is built from the label list (k values) with two explodes of a
    k-element array, not a join of the data with itself.
    """
    conf = confusion_counts(df, y, p)
    labs = _labels(conf).agg(F.sort_array(F.collect_list("label")).alias("l"))   # k labels
    grid = labs.select(F.explode("l").alias("actual"), "l").select("actual", F.explode("l").alias("predicted"))
    c = conf.select(F.col("y").alias("actual"), F.col("p").alias("predicted"), "n")
    return grid.join(c, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def quadratic_kappa(df: DataFrame, y: str, p: str) -> DataFrame:
    """Quadratic weighted kappa 1 - sum(w O) / sum(w E) with w = (i - j)^2 over label positions.

    With positions i, j: sum(w O) = sum((i - j)^2), sum(w E) = sum i^2 + sum j^2 - 2 sum i sum j / N.
    """
    return _kappa(confusion_counts(df, y, p))


def _kappa(conf: DataFrame) -> DataFrame:
    lab = _labels(conf)
    j = (conf.join(lab.select(F.col("label").alias("y"), F.col("idx").alias("i")), "y")
         .join(lab.select(F.col("label").alias("p"), F.col("idx").alias("j")), "p"))
    n = F.sum("n")
    si = F.sum(F.col("n") * F.col("i"))
    sj = F.sum(F.col("n") * F.col("j"))
    num = F.sum(F.col("n") * (F.col("i") - F.col("j")) * (F.col("i") - F.col("j")))
    den = (F.sum(F.col("n") * F.col("i") * F.col("i")) + F.sum(F.col("n") * F.col("j") * F.col("j"))
           - 2.0 * si * sj / n)
    return j.agg((F.lit(1.0) - F.coalesce(F.try_divide(num.cast("double"), den), F.lit(0.0))).alias("qwk"))


def kappa_of_counts(counts) -> float:
    """Quadratic kappa of (label, prediction, n) triples of one confusion table; weights use label positions."""
    counts = [(y, p, n) for y, p, n in counts if y is not None and p is not None]
    at = {v: i for i, v in enumerate(sorted({x for y, p, _ in counts for x in (y, p)}))}
    total = sum(n for *_, n in counts)
    rows, cols = [0] * len(at), [0] * len(at)
    off = 0
    for y, p, n in counts:
        rows[at[y]] += n
        cols[at[p]] += n
        off += n * (at[y] - at[p]) ** 2
    chance = sum(r * c * (i - j) ** 2 for i, r in enumerate(rows) for j, c in enumerate(cols))
    return 1.0 - off * total / chance if chance else 1.0


def per_class(df: DataFrame, y: str, p: str) -> DataFrame:
    """(label, precision, recall, f1, support); 0/0 -> 0."""
    return _per_class(confusion_counts(df, y, p))


def _per_class(conf: DataFrame) -> DataFrame:
    lab = _labels(conf).select("label")
    tp = conf.where(F.col("y") == F.col("p")).select(F.col("y").alias("label"), F.col("n").alias("tp"))
    sup = conf.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"))
    pred = conf.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    t = lab.join(tp, "label", "left").join(sup, "label", "left").join(pred, "label", "left").na.fill(0)
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    t = t.select("label", prec.alias("precision"), rec.alias("recall"), F.col("support").cast("bigint").alias("support"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
                    F.lit(0.0))
    return t.withColumn("f1", f1)


def classification_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per-class rows plus 'macro avg' and 'weighted avg' rows; ``label`` is text."""
    return _report(confusion_counts(df, y, p))


def _report(conf: DataFrame) -> DataFrame:
    pc = _per_class(conf)
    rows = pc.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    tot = F.sum("support")
    macro = pc.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.cast("bigint").alias("support"))
    w = lambda c: F.sum(F.col(c) * F.col("support")) / tot
    weighted = pc.agg(F.lit("weighted avg").alias("label"), w("precision").alias("precision"),
                      w("recall").alias("recall"), w("f1").alias("f1"), tot.cast("bigint").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


#: cells of a confusion table that the metrics accept; more distinct labels are an error
MAX_CELLS = 1_000_000


def classification_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Long table (metric, value): qwk, accuracy, weighted precision/recall/F1, macro F1 (0/0 is 0).

    The scored rows are read once, by one grouped count; all six numbers follow from its at most k x k cells.
    Without a row the ratios are null and kappa is 1.
    """
    cells = [(r["y"], r["p"], r["n"]) for r in confusion_counts(df, y, p).limit(MAX_CELLS + 1).collect()]
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} pairs of labels")
    total = sum(n for *_, n in cells)
    support, predicted, hit = {}, {}, {}
    for a, b, n in cells:
        support[a] = support.get(a, 0) + n
        predicted[b] = predicted.get(b, 0) + n
        if a == b:
            hit[a] = n
    ratio = lambda top, bottom: top / bottom if bottom else 0.0
    per = []
    for c in sorted(support.keys() | predicted.keys()):
        pre, rec = ratio(hit.get(c, 0), predicted.get(c, 0)), ratio(hit.get(c, 0), support.get(c, 0))
        per.append((pre, rec, ratio(2 * pre * rec, pre + rec), support.get(c, 0)))
    weighted = lambda k: sum(x[k] * x[3] for x in per) / total if total else None
    rows = [("qwk", float(kappa_of_counts(cells))), ("accuracy", sum(hit.values()) / total if total else None),
            ("precision_weighted", weighted(0)), ("recall_weighted", weighted(1)), ("f1_weighted", weighted(2)),
            ("f1_macro", sum(x[2] for x in per) / len(per) if per else None)]
    return df.sparkSession.createDataFrame(rows, "metric string, value double")


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """RMSE and R^2 in one aggregate (R^2 = 1 - SSE / SST, SST around the mean of y)."""
    e = F.col(y) - F.col(yhat)
    n = F.count(F.lit(1))
    sse = F.sum(e * e)
    sst = F.sum(F.col(y) * F.col(y)) - F.sum(F.col(y)) * F.sum(F.col(y)) / n
    d = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    return d.agg(F.sqrt(sse / n).alias("rmse"), (F.lit(1.0) - F.try_divide(sse, sst)).alias("r2"))


def importance_table(names, importances, top: int | None = None):
    """(feature, importance, rank) rows from a fitted model's importances (driver-side, p rows)."""
    rows = sorted(zip(names, [float(v) for v in importances]), key=lambda t: (-t[1], t[0]))
    rows = [(f, v, i + 1) for i, (f, v) in enumerate(rows)]
    return rows[:top] if top else rows


def compare_metrics(a: DataFrame, b: DataFrame, name_a: str = "a", name_b: str = "b",
                    lower_is_better=("rmse",)) -> DataFrame:
    """Join two (metric, value) tables: value_a, value_b, delta = b - a, winner."""
    j = a.select("metric", F.col("value").alias("value_a")).join(
        b.select("metric", F.col("value").alias("value_b")), "metric", "full")
    lower = F.col("metric").isin(list(lower_is_better))
    b_wins = F.when(lower, F.col("value_b") < F.col("value_a")).otherwise(F.col("value_b") > F.col("value_a"))
    return j.select("metric", "value_a", "value_b", (F.col("value_b") - F.col("value_a")).alias("delta"),
                    F.when(F.col("value_a") == F.col("value_b"), F.lit("tie"))
                    .when(b_wins, F.lit(name_b)).otherwise(F.lit(name_a)).alias("winner"))


class QWKEvaluator(Evaluator):
    """MLlib evaluator for quadratic weighted kappa (larger is better)."""

    labelCol = Param(Params._dummy(), "labelCol", "label column", typeConverter=TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", typeConverter=TypeConverters.toString)

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._set(labelCol=labelCol, predictionCol=predictionCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        y = self.getOrDefault(self.labelCol)
        p = self.getOrDefault(self.predictionCol)
        d = dataset.select(F.col(y).cast("int").alias("y"), F.col(p).cast("int").alias("p"))
        return float(quadratic_kappa(d, "y", "p").first()[0])

    def isLargerBetter(self) -> bool:
        return True
