"""Driver tables and the ``records`` view derived from them.

``records`` is the canonical outcome table (Gender, ParentalEducation, StudyTimeWeekly,
Absences, Tutoring, Extracurricular, InternetAccess, GPA, GradeClass, DatasetType) built
from three differently shaped sources (customers with their orders, suppliers, parts),
so harmonising, nulls and every class occur. Everything is a DataFrame expression, so
scans prune columns and the orders aggregate is a partial (map-side) aggregate followed
by one shuffle on the customer key.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import clip, right_closed_bins

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# GPA edges and the class each right-closed bin maps to (0 best, 4 fail).
GRADE_EDGES = [-1.0, 2.0, 2.5, 3.0, 3.5, 4.5]
GRADE_LABELS = [4, 3, 2, 1, 0]
GRADE_DEFAULT = 4

CANONICAL = ["Gender", "ParentalEducation", "StudyTimeWeekly", "Absences", "Tutoring",
             "Extracurricular", "InternetAccess", "GPA", "DatasetType"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _clamp_gpa(x: Column) -> Column:
    return clip(x, 0.0, 4.0)


def _flag(cond: Column) -> Column:
    return cond.cast("int")


def source_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source 1: customers joined to their order summary (left join keeps customers without orders)."""
    orders = table(spark, sf_dir, "orders")
    o = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("p"),
        F.max(F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 350000), 1)
              .otherwise(0)).alias("u"))
    c = table(spark, sf_dir, "customer")
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    p = F.coalesce(F.col("p"), F.lit(0))
    dec15 = F.lit(Decimal("0.15"))
    return j.select(
        F.col("c_custkey").alias("k"),
        (F.col("c_nationkey") % 2).cast("int").alias("Gender"),
        F.col("c_mktsegment").alias("segment"),
        n.cast("double").alias("StudyTimeWeekly"),
        p.cast("int").alias("Absences"),
        F.coalesce(F.col("u"), F.lit(0)).cast("int").alias("Tutoring"),
        _flag(F.col("c_custkey") % 3 == 0).alias("Extracurricular"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit(None).cast("int"))
         .otherwise(_flag(F.col("c_custkey") % 4 > 0)).alias("InternetAccess"),
        _clamp_gpa(F.col("c_acctbal") / 4000 + dec15 * n - dec15 * p).alias("GPA"),
        F.lit(1).alias("DatasetType"),
    )


def source_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("k"),
        (F.col("s_nationkey") % 2).cast("int").alias("Gender"),
        (F.col("s_suppkey") % 5).cast("double").alias("ParentalEducation"),
        ((F.col("s_suppkey") % 20) + F.lit(0.5)).cast("double").alias("StudyTimeWeekly"),
        (F.col("s_suppkey") % 30).cast("int").alias("Absences"),
        _flag(F.col("s_suppkey") % 3 == 0).alias("Tutoring"),
        _flag(F.col("s_suppkey") % 2 == 0).alias("Extracurricular"),
        F.lit(None).cast("int").alias("InternetAccess"),
        _clamp_gpa(F.col("s_acctbal") / 2500).alias("GPA"),
        F.lit(2).alias("DatasetType"),
    )


def source_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    score = (F.lit(45) + F.col("p_size") / F.lit(2.0) + k % 23 - (k % 40) / F.lit(4.0)) / 25
    return p.select(
        k.alias("k"),
        (k % 2).cast("int").alias("Gender"),
        (k % 4).cast("double").alias("ParentalEducation"),
        F.col("p_size").cast("double").alias("StudyTimeWeekly"),
        (k % 40).cast("int").alias("Absences"),
        _flag(k % 4 > 0).alias("Tutoring"),
        _flag(k % 5 > 1).alias("Extracurricular"),
        _flag(k % 7 > 0).alias("InternetAccess"),
        _clamp_gpa(score).alias("GPA"),
        F.lit(3).alias("DatasetType"),
    )


# Market segment -> parental-education level used by source 1.
SEGMENT_LEVEL = {"AUTOMOBILE": 0.0, "BUILDING": 1.0, "FURNITURE": 2.0, "HOUSEHOLD": 3.0}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical outcome table with a unique ``row_id`` (source * 1e9 + key)."""
    from ..functions.expressions import map_values

    s1 = source_customers(spark, sf_dir)
    s1 = s1.withColumn("ParentalEducation", map_values(F.col("segment"), SEGMENT_LEVEL)).drop("segment")
    s1 = s1.select("k", *CANONICAL)
    u = (s1.unionByName(source_suppliers(spark, sf_dir).select("k", *CANONICAL))
         .unionByName(source_parts(spark, sf_dir).select("k", *CANONICAL)))
    return u.select(
        (F.col("DatasetType").cast("bigint") * 1000000000 + F.col("k")).alias("row_id"),
        *CANONICAL,
        right_closed_bins(F.col("GPA"), GRADE_EDGES, GRADE_LABELS, GRADE_DEFAULT).alias("GradeClass"),
    )


# DuckDB text of the same view, used by every oracle query over ``records``.
RECORDS_SQL = """
records AS (
WITH o AS (
  SELECT o_custkey, count(*) AS n,
         sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS p,
         max(CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 350000 THEN 1 ELSE 0 END) AS u
  FROM orders GROUP BY o_custkey),
src1 AS (
  SELECT c_custkey AS k, CAST(c_nationkey % 2 AS INT) AS "Gender",
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0.0 WHEN 'BUILDING' THEN 1.0 WHEN 'FURNITURE' THEN 2.0 WHEN 'HOUSEHOLD' THEN 3.0 END AS "ParentalEducation",
         CAST(coalesce(n, 0) AS DOUBLE) AS "StudyTimeWeekly", CAST(coalesce(p, 0) AS INT) AS "Absences",
         CAST(coalesce(u, 0) AS INT) AS "Tutoring", CAST(c_custkey % 3 = 0 AS INT) AS "Extracurricular",
         CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_custkey % 4 > 0 AS INT) END AS "InternetAccess",
         least(4.0, greatest(0.0, c_acctbal / 4000 + 0.15 * coalesce(n, 0) - 0.15 * coalesce(p, 0))) AS "GPA",
         1 AS "DatasetType"
  FROM customer LEFT JOIN o ON o_custkey = c_custkey),
src2 AS (
  SELECT s_suppkey AS k, CAST(s_nationkey % 2 AS INT) AS "Gender", CAST(s_suppkey % 5 AS DOUBLE) AS "ParentalEducation",
         s_suppkey % 20 + 0.5 AS "StudyTimeWeekly", CAST(s_suppkey % 30 AS INT) AS "Absences",
         CAST(s_suppkey % 3 = 0 AS INT) AS "Tutoring", CAST(s_suppkey % 2 = 0 AS INT) AS "Extracurricular",
         CAST(NULL AS INT) AS "InternetAccess", least(4.0, greatest(0.0, s_acctbal / 2500)) AS "GPA", 2 AS "DatasetType"
  FROM supplier),
src3 AS (
  SELECT p_partkey AS k, CAST(p_partkey % 2 AS INT) AS "Gender", CAST(p_partkey % 4 AS DOUBLE) AS "ParentalEducation",
         CAST(p_size AS DOUBLE) AS "StudyTimeWeekly", CAST(p_partkey % 40 AS INT) AS "Absences",
         CAST(p_partkey % 4 > 0 AS INT) AS "Tutoring", CAST(p_partkey % 5 > 1 AS INT) AS "Extracurricular",
         CAST(p_partkey % 7 > 0 AS INT) AS "InternetAccess",
         least(4.0, greatest(0.0, (45 + p_size / 2.0 + p_partkey % 23 - (p_partkey % 40) / 4.0) / 25)) AS "GPA", 3 AS "DatasetType"
  FROM part),
u AS (SELECT * FROM src1 UNION ALL SELECT * FROM src2 UNION ALL SELECT * FROM src3)
SELECT CAST("DatasetType" AS BIGINT) * 1000000000 + k AS row_id, u.* EXCLUDE (k),
       CASE WHEN "GPA" > -1 AND "GPA" <= 2.0 THEN 4 WHEN "GPA" <= 2.5 THEN 3 WHEN "GPA" <= 3.0 THEN 2
            WHEN "GPA" <= 3.5 THEN 1 WHEN "GPA" <= 4.5 THEN 0 ELSE 4 END AS "GradeClass"
FROM u)
"""


def with_records(*ctes: str, select: str) -> str:
    """Compose DuckDB text ``WITH records AS (..), <ctes> <select>``."""
    parts = [RECORDS_SQL.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + select
