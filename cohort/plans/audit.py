"""Flagship plan: contract-checked outcome table -> fill -> interaction features ->
group fairness of a scorer by Gender and InternetAccess."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import grade_class, interaction_features
from ..operators.fairness import group_rates
from ..sources.contract import STUDENT_CONTRACT, cast_to_contract
from ..sources.tables import records

SENSITIVE = ["Gender", "InternetAccess"]


def rounded_grade_scorer(df: DataFrame, gpa: str = "GPA", out: str = "pred_class") -> DataFrame:
    """Deterministic baseline scorer: class of the GPA rounded (half to even) to the nearest half point."""
    return df.withColumn(out, grade_class(F.bround(F.col(gpa) * 2, 0) / 2))


def prepared_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records -> contract types -> null InternetAccess/ParentalEducation filled with 0 -> features."""
    df = cast_to_contract(records(spark, sf_dir), STUDENT_CONTRACT)
    df = df.na.fill(0, subset=["InternetAccess"]).na.fill(0.0, subset=["ParentalEducation"])
    return interaction_features(df)


def fairness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rounded_grade_scorer(prepared_records(spark, sf_dir))
    return group_rates(scored, "GradeClass", "pred_class", SENSITIVE)
