"""Small DuckDB text helpers shared by the oracle twins."""

from __future__ import annotations


def r6(expr: str) -> str:
    """Six-digit rounding written as round(x * 1e6) / 1e6 on both sides: rounding the scaled
    double to an integer is done the same way by both engines, while round(x, 6) is not."""
    return f"(round(CAST({expr} AS DOUBLE) * 1000000.0) / 1000000.0)"


def grade_bins(expr: str) -> str:
    """Right-closed GPA bins -> class, outside/null -> 4 (DuckDB CASE)."""
    x = f"({expr})"
    return (f"CASE WHEN {x} > -1 AND {x} <= 2.0 THEN 4 WHEN {x} > 2.0 AND {x} <= 2.5 THEN 3 "
            f"WHEN {x} > 2.5 AND {x} <= 3.0 THEN 2 WHEN {x} > 3.0 AND {x} <= 3.5 THEN 1 "
            f"WHEN {x} > 3.5 AND {x} <= 4.5 THEN 0 ELSE 4 END")


PREPARED = """
prepared AS (
  SELECT row_id, "Gender", coalesce("ParentalEducation", 0.0) AS "ParentalEducation", "StudyTimeWeekly",
         "Absences", "Tutoring", "Extracurricular", coalesce("InternetAccess", 0) AS "InternetAccess",
         "GPA", "GradeClass", "DatasetType"
  FROM records),
featured AS (
  SELECT *, CAST("InternetAccess" * "StudyTimeWeekly" AS DOUBLE) AS "TechSynergy",
         CAST("StudyTimeWeekly" / ("ParentalEducation" + 1) AS DOUBLE) AS "SelfDriven",
         CAST("ParentalEducation" + "Tutoring" + "InternetAccess" AS DOUBLE) AS "SupportIndex",
         CAST("Extracurricular" * "StudyTimeWeekly" AS DOUBLE) AS "BalancedLife",
         CAST("Absences" * (1 - "InternetAccess") AS DOUBLE) AS "AbsenceRisk"
  FROM prepared)
"""
