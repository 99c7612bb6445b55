"""Group fairness audit: per-group selection rate, TPR, FPR and counts, then disparities.

Plan shape: one scan, rows turned into (attribute, value) pairs by ``inline`` of a
fixed-size array (one entry per sensitive column), then one grouped aggregate with
map-side partial aggregation. Output is tiny (attributes x groups) regardless of size,
and a hot group only makes one partial-aggregate row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positive_le(col, t=2) -> Column:
    """Positive outcome = class <= t (class 0 best); null is not positive."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c <= F.lit(t), F.lit(False))


def group_rates(df: DataFrame, y_true: str, y_pred: str, sensitive: Sequence[str],
                positive=positive_le) -> DataFrame:
    """(attribute, group_value, n, selection_rate, true_positive_rate, false_positive_rate)."""
    yt = positive(y_true).cast("int")
    yp = positive(y_pred).cast("int")
    pairs = F.array(*[F.struct(F.lit(s).alias("attribute"), F.col(s).cast("string").alias("group_value"))
                      for s in sensitive])
    base = df.select(yt.alias("yt"), yp.alias("yp"), F.inline(pairs))
    tp = F.sum(F.col("yt") * F.col("yp"))
    fp = F.sum((F.lit(1) - F.col("yt")) * F.col("yp"))
    pos = F.sum("yt")
    neg = F.count(F.lit(1)) - F.sum("yt")
    return base.groupBy("attribute", "group_value").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("yp").cast("double")).alias("selection_rate"),
        F.coalesce(F.try_divide(tp.cast("double"), pos), F.lit(0.0)).alias("true_positive_rate"),
        F.coalesce(F.try_divide(fp.cast("double"), neg), F.lit(0.0)).alias("false_positive_rate"),
    )


def disparities(rates: DataFrame) -> DataFrame:
    """Max - min between groups per attribute.

    ``tpr_diff`` is what the reference calls its equalized-odds number; the true
    equalized-odds difference is max(tpr_diff, fpr_diff).
    """
    g = rates.groupBy("attribute").agg(
        (F.max("selection_rate") - F.min("selection_rate")).alias("demographic_parity_diff"),
        (F.max("true_positive_rate") - F.min("true_positive_rate")).alias("tpr_diff"),
        (F.max("false_positive_rate") - F.min("false_positive_rate")).alias("fpr_diff"),
    )
    return g.withColumn("equalized_odds_diff", F.greatest("tpr_diff", "fpr_diff"))


def selection_gap(df: DataFrame, group: str, a, b, y_pred: str, positive=positive_le) -> DataFrame:
    """Two-group gap: rate(group == a) - rate(group == b), one aggregate."""
    yp = positive(y_pred).cast("double")
    ra = F.avg(F.when(F.col(group) == F.lit(a), yp))
    rb = F.avg(F.when(F.col(group) == F.lit(b), yp))
    return df.agg(ra.alias("rate_a"), rb.alias("rate_b"), (ra - rb).alias("gap"))
