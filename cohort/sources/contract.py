"""Data contracts: column -> type/min/max/isin rules, checked in one distributed pass.

A contract is small (one entry per column) and lives on the driver; the data never does.
``validate`` builds a single aggregate with one ``count_if`` per rule, so the whole check
is one scan with map-side partial aggregation, whatever the table size.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIOLATION_SCHEMA = "column_name string, rule string, n_bad bigint"


@dataclass(frozen=True)
class Rule:
    type: str = "float"               # "int" | "float" | "string"
    min: float | None = None
    max: float | None = None
    isin: tuple | None = None


@dataclass(frozen=True)
class Contract:
    columns: dict = field(default_factory=dict)   # name -> Rule
    no_nulls: bool = False                        # declared in the reference but never enforced there
    enforce_no_nulls: bool = False                # ours: opt in

    @staticmethod
    def from_dict(d: dict) -> "Contract":
        """Accepts the YAML-shaped dict: {checks: {no_nulls}, columns: {c: {type, checks: {min,max,isin}}}}."""
        cols = {}
        for name, spec in d.get("columns", {}).items():
            checks = spec.get("checks", {}) or {}
            isin = checks.get("isin")
            cols[name] = Rule(type=spec.get("type", "float"), min=checks.get("min"),
                              max=checks.get("max"), isin=tuple(isin) if isin is not None else None)
        no_nulls = bool((d.get("checks") or {}).get("no_nulls", False))
        return Contract(columns=cols, no_nulls=no_nulls)

    @staticmethod
    def from_frame(df: DataFrame) -> "Contract":
        """Inverse of ``to_frame``: a contract from a rules table (a few rows a column), read from any source.

        ``arg`` is JSON, but for the type's name; rows without a column hold for the table. An unknown rule is an error."""
        cols: dict[str, dict] = {}
        table: dict[str, bool] = {}
        for r in df.select("column_name", "rule", "arg").collect():
            name, rule, arg = r
            if name is None and rule in ("no_nulls", "enforce_no_nulls"):
                table[rule] = bool(json.loads(arg))
            elif name is not None and rule in ("type", "min", "max", "isin"):
                cols.setdefault(name, {})[rule] = arg if rule == "type" else json.loads(arg)
            else:
                raise ValueError(f"unknown rule {rule} of column {name}")
        rules = {name: Rule(**(spec | {"isin": tuple(spec["isin"])} if "isin" in spec else spec)) for name, spec in cols.items()}
        return Contract(columns=rules, **table)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """Rules as a small table (column_name, rule, arg); ``arg`` is JSON, but for the type's name."""
        rows = [(None, name, json.dumps(value)) for name, value in (("no_nulls", self.no_nulls), ("enforce_no_nulls", self.enforce_no_nulls))]
        for name, r in self.columns.items():
            rows.append((name, "type", r.type))
            if r.min is not None:
                rows.append((name, "min", json.dumps(r.min)))
            if r.max is not None:
                rows.append((name, "max", json.dumps(r.max)))
            if r.isin is not None:
                rows.append((name, "isin", json.dumps(list(r.isin))))
        return spark.createDataFrame(rows, "column_name string, rule string, arg string")


# The reference's student contract (schema file), in its own order.
STUDENT_CONTRACT = Contract.from_dict({
    "checks": {"no_nulls": True},
    "columns": {
        "Absences": {"type": "int", "checks": {"min": 0}},
        "Extracurricular": {"type": "int", "checks": {"isin": [0, 1]}},
        "GPA": {"type": "float", "checks": {"min": 0.0, "max": 4.0}},
        "Gender": {"type": "int", "checks": {"isin": [0, 1]}},
        "GradeClass": {"type": "int", "checks": {"min": 0, "max": 4}},
        "InternetAccess": {"type": "int", "checks": {"isin": [0, 1]}},
        "ParentalEducation": {"type": "float", "checks": {"min": 0, "max": 4}},
        "StudyTimeWeekly": {"type": "float", "checks": {"min": 0}},
        "Tutoring": {"type": "int", "checks": {"isin": [0, 1]}},
    },
})


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _type_bad(df: DataFrame, name: str, kind: str):
    dt = df.schema[name].dataType
    x = F.col(name)
    if kind == "int":
        if isinstance(dt, _INTEGRAL):
            return F.lit(0).cast("bigint")
        if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
            # float column holding only whole values is accepted and cast
            return F.count_if(x.isNotNull() & (x != F.floor(x)))
        return F.count_if(x.isNotNull() & x.cast("string").try_cast("bigint").isNull())
    if kind == "float":
        if isinstance(dt, T.NumericType):
            return F.lit(0).cast("bigint")
        return F.count_if(x.isNotNull() & x.cast("string").try_cast("double").isNull())
    return F.lit(0).cast("bigint")


def _typed(df: DataFrame, name: str, kind: str):
    x = F.col(name)
    if kind == "int":
        return x.cast("string").try_cast("double") if isinstance(df.schema[name].dataType, T.StringType) else x
    if kind == "float":
        return x.try_cast("double") if not isinstance(df.schema[name].dataType, T.NumericType) else x
    return x


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """Per-rule violation counts ``(column_name, rule, n_bad)``.

    Missing columns are reported first and alone (rule ``missing``), as no other check
    can run. ``isin`` treats null as not-in. ``not_null`` rows appear only when the
    contract enforces ``no_nulls``.
    """
    spark = df.sparkSession
    missing = [c for c in contract.columns if c not in df.columns]
    if missing:
        return spark.createDataFrame([(c, "missing", 1) for c in missing], VIOLATION_SCHEMA)
    checks = []   # (column, rule, aggregate expression)
    for name, r in contract.columns.items():
        checks.append((name, "type", _type_bad(df, name, r.type)))
        x = _typed(df, name, r.type)
        if r.min is not None:
            checks.append((name, "min", F.count_if(x < F.lit(r.min))))
        if r.max is not None:
            checks.append((name, "max", F.count_if(x > F.lit(r.max))))
        if r.isin is not None:
            checks.append((name, "isin", F.count_if(~F.coalesce(x.isin(*r.isin), F.lit(False)))))
        if contract.enforce_no_nulls:
            checks.append((name, "not_null", F.count_if(F.col(name).isNull())))
    agg = df.agg(*[e.cast("bigint").alias(f"r{i}") for i, (_, _, e) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(rule).alias("rule"),
                              F.col(f"r{i}").alias("n_bad"))
                     for i, (c, rule, _) in enumerate(checks)])
    return agg.select(F.inline(rows))


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    return validate(df, contract).where(F.col("n_bad") > 0)


class ContractViolation(ValueError):
    pass


def assert_valid(df: DataFrame, contract: Contract) -> DataFrame:
    """Fail fast: raise with every broken rule listed; otherwise return the typed frame."""
    bad = violations(df, contract).collect()   # at most a few rows per column
    if bad:
        msg = "; ".join(f"{r.column_name}:{r.rule} ({r.n_bad} rows)" for r in bad)
        raise ContractViolation(f"contract failed: {msg}")
    return cast_to_contract(df, contract)


def cast_to_contract(df: DataFrame, contract: Contract) -> DataFrame:
    casts = {}
    for name, r in contract.columns.items():
        if r.type == "int":
            casts[name] = F.col(name).cast("int")
        elif r.type == "float":
            casts[name] = F.col(name).cast("double")
    return df.withColumns(casts)


def contract_sql(contract: Contract, table: str, types: dict) -> str:
    """DuckDB text of ``validate`` for a table whose column types are given (oracle side)."""
    parts = []
    for name, r in contract.columns.items():
        q = f'"{name}"'
        t = types[name]
        if r.type == "int" and t == "double":
            tb = f"count_if({q} IS NOT NULL AND {q} <> floor({q}))"
        else:
            tb = "count_if(false)"
        parts.append(f"SELECT '{name}' AS column_name, 'type' AS rule, CAST({tb} AS BIGINT) AS n_bad FROM {table}")
        if r.min is not None:
            parts.append(f"SELECT '{name}', 'min', CAST(count_if({q} < {float(r.min)!r}::DOUBLE) AS BIGINT) FROM {table}")
        if r.max is not None:
            parts.append(f"SELECT '{name}', 'max', CAST(count_if({q} > {float(r.max)!r}::DOUBLE) AS BIGINT) FROM {table}")
        if r.isin is not None:
            vals = ", ".join(map(str, r.isin))
            parts.append(f"SELECT '{name}', 'isin', CAST(count_if(NOT coalesce({q} IN ({vals}), false)) AS BIGINT) FROM {table}")
        if contract.enforce_no_nulls:
            parts.append(f"SELECT '{name}', 'not_null', CAST(count_if({q} IS NULL) AS BIGINT) FROM {table}")
    return "\nUNION ALL\n".join(parts)
