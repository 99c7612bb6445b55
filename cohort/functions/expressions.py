"""Column expressions (all JVM-side, codegen friendly; no Python UDFs).

Each function takes and returns a ``Column`` so it can be used inside ``select``,
``withColumns``, ``where`` or ``agg`` and is planned by Catalyst.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def map_values(col, mapping: Mapping, default=None) -> Column:
    """Dictionary recode; an unmapped value (or null) becomes ``default`` (null by default).

    ``element_at`` on a literal map returns null for a missing key even with ANSI on.
    """
    if not mapping:
        return F.lit(default)
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    out = F.element_at(m, _c(col))
    # null keys are not allowed in element_at lookups -> guard explicitly
    out = F.when(_c(col).isNull(), F.lit(None)).otherwise(out)
    return out if default is None else F.coalesce(out, F.lit(default))


def threshold_flag(col, t) -> Column:
    """``1`` when ``col > t`` else ``0``; null compares as false and gives 0."""
    return F.coalesce(_c(col) > F.lit(t), F.lit(False)).cast("int")


# Texts read as "true" by the truthy flag.
TRUTHY = ("yes", "1", "true")


def truthy_flag(col) -> Column:
    """``1`` when lower(text) is one of yes/1/true, else 0 (null -> 0)."""
    return F.coalesce(F.lower(_c(col).cast("string")).isin(*TRUTHY), F.lit(False)).cast("int")


def clip(col, lo=None, hi=None) -> Column:
    """Clamp into [lo, hi]; null stays null (``least``/``greatest`` would skip the null)."""
    x = _c(col)
    out = x
    if lo is not None:
        out = F.when(x < F.lit(lo), F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(x > F.lit(hi), F.lit(hi)).otherwise(out)
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


def right_closed_bins(col, edges: Sequence[float], labels: Sequence, default=None) -> Column:
    """Fixed-edge binning with right-closed intervals (lo, hi] mapped to ``labels``.

    Values outside (edges[0], edges[-1]] and nulls get ``default``.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    x = _c(col)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(default))


def grade_class(gpa) -> Column:
    from ..sources.tables import GRADE_DEFAULT, GRADE_EDGES, GRADE_LABELS
    return right_closed_bins(gpa, GRADE_EDGES, GRADE_LABELS, GRADE_DEFAULT)


# Class code -> letter.
GRADE_LETTERS = {0: "A", 1: "B", 2: "C", 3: "D", 4: "F"}


def grade_letter(code) -> Column:
    """0..4 -> A,B,C,D,F; anything else -> 'Unknown'."""
    return map_values(_c(code), GRADE_LETTERS, "Unknown")


def round_class(col) -> Column:
    """Round half to even (pandas/numpy rule) and cast to int."""
    return F.bround(_c(col), 0).cast("int")


def interaction_features(df: DataFrame, *, internet="InternetAccess", study="StudyTimeWeekly",
                         parent="ParentalEducation", tutoring="Tutoring",
                         extra="Extracurricular", absences="Absences") -> DataFrame:
    """Add the five engineered interaction columns in one projection."""
    i, s, p = F.col(internet), F.col(study), F.col(parent)
    return df.withColumns({
        "TechSynergy": (i * s).cast("double"),
        "SelfDriven": F.try_divide(s, p + F.lit(1)).cast("double"),
        "SupportIndex": (p + F.col(tutoring) + i).cast("double"),
        "BalancedLife": (F.col(extra) * s).cast("double"),
        "AbsenceRisk": (F.col(absences) * (F.lit(1) - i)).cast("double"),
    })


# Advice texts of the recommendation rules.
ADVICE_HIGH_RISK = "High Risk of Failure."
ADVICE_ABSENCES = "Critical: Reduce absences immediately. Aim for < 5."
ADVICE_STUDY = "Action: Increase study time to at least 8-10 hours/week."
ADVICE_INTERNET = "Support: Provide access to school computer lab or hotspot."
ADVICE_ON_TRACK = "Student is on track."
ADVICE_IMPROVE = "To improve further, focus on consistent study habits."


def recommendations(risk, absences, study, internet, pred_class) -> Column:
    """Advice list from the rule table: risk > 0.5 -> absences > 10, study < 5, no internet;
    otherwise on track, plus a study-habit note for classes above 0."""
    risk, absences, study, internet, pred_class = map(_c, (risk, absences, study, internet, pred_class))
    high = risk > F.lit(0.5)
    return F.when(high, F.array_compact(F.array(
        F.lit(ADVICE_HIGH_RISK),
        F.when(absences > 10, F.lit(ADVICE_ABSENCES)),
        F.when(study < 5, F.lit(ADVICE_STUDY)),
        F.when(internet == 0, F.lit(ADVICE_INTERNET)),
    ))).otherwise(F.array_compact(F.array(
        F.lit(ADVICE_ON_TRACK),
        F.when(pred_class > 0, F.lit(ADVICE_IMPROVE)),
    )))


def nan_to_null(col) -> Column:
    x = _c(col)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)
