"""Exact quantiles by rank selection.

``percentile`` keeps every distinct value of a column in one aggregation buffer. Here a quantile is
the value at a rank, found in two passes over the rows:

1. a sketch per group (Greenwald-Khanna, merged map-side) gives a narrow bracket of values around
   each wanted rank, a few ``1 / ACCURACY`` of the rows wide;
2. one grouped count with map-side combine: rows between the brackets collapse to one count per
   interval, rows inside a bracket to one count per distinct value. Only those values are sorted,
   each bracket by itself, and the running counts name the value at the rank.

The result is exact: the counts say whether the rank lies in its bracket, and a bracket that misses it
is widened and counted again (a bracket over all values cannot miss). The rule between two ranks
is numpy's linear one.

Groups are the rows of ``by``. Their brackets are broadcast up to ``MAX_GROUPS`` groups, a bound that is
counted; with more groups the rows collapse to (group, value) counts, ranked by ``chunked_running``, so that a
hot group is spread over value ranges either way.

Nulls and NaN are no values. A group without a value has null quantiles and a count of 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import chunked_running, range_chunk, range_edges

ACCURACY = 20_000       #: the sketch's rank error is 1 / ACCURACY of the rows
MARGIN = 2              #: half a bracket's width, in rank errors
MAX_GROUPS = 10_000     #: brackets of so many groups are broadcast


def _value(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _merge(pairs: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(pairs):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _stack(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``by .., _c, _v``: one row per value, columns numbered."""
    rows = F.array(*[F.struct(F.lit(i).alias("_c"), _value(c).alias("_v")) for i, c in enumerate(cols)])
    return df.select(*by, F.inline(rows)).where(F.col("_v").isNotNull())


def _interval(v: Column, edges: Column | list[tuple[float, float]]) -> Column:
    """Number of bracket ends at or before the value: odd inside a bracket, even between two."""
    if isinstance(edges, list):
        return sum(((v >= lo).cast("int") + (v > hi).cast("int") for lo, hi in edges), F.lit(0))
    return F.aggregate(edges, F.lit(0), lambda a, e: a + (v >= e["lo"]).cast("int") + (v > e["hi"]).cast("int"))


def _sketch(df: DataFrame, by: list[str], cols: Sequence[str], probs: Sequence[float], margin: float) -> list:
    """Per group a row with each column's count and bracket ends; one more than ``MAX_GROUPS`` rows at most."""
    ends = sorted({min(1.0, max(0.0, p + s * margin / ACCURACY)) for p in probs for s in (-1, 1)})
    aggs = [e for i, c in enumerate(cols) for e in (F.count(_value(c)).alias(f"_n{i}"), F.percentile_approx(_value(c), ends, ACCURACY).alias(f"_e{i}"))]
    rows = df.groupBy(*by).agg(*aggs).limit(MAX_GROUPS + 1).collect()
    at = {e: k for k, e in enumerate(ends)}
    out = []
    for r in rows:
        spans = []
        for i in range(len(cols)):
            q = r[f"_e{i}"]
            spans.append([] if q is None else _merge([tuple(q[at[min(1.0, max(0.0, p + s * margin / ACCURACY))]] for s in (-1, 1)) for p in probs]))
        out.append((tuple(r[b] for b in by), [r[f"_n{i}"] for i in range(len(cols))], spans))
    return out


def _ranks(p: float, n: Column) -> tuple[Column, Column, Column]:
    """The two ranks (from 0) around a quantile and the weight of the upper one."""
    at = F.lit(float(p)) * (n - 1)
    return F.floor(at), F.ceil(at), at - F.floor(at)


def _at_ranks(sorted_counts: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``by .., _c, _q, _ok`` from rows ``_v, _before, _upto, _n`` (running counts up to each value)."""
    aggs = []
    for k, p in enumerate(probs):
        lo, hi, _ = _ranks(p, F.col("_n"))
        for name, r in (("l", lo), ("h", hi)):
            inside = (F.col("_before") <= r) & (r < F.col("_upto"))
            aggs.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{name}{k}"))
    got = sorted_counts.groupBy(*by, "_c").agg(F.max("_n").alias("_n"), *aggs)
    values, ok = [], F.lit(True)
    for k, p in enumerate(probs):
        low, high = F.col(f"_l{k}"), F.col(f"_h{k}")
        w = _ranks(p, F.col("_n"))[2]
        values.append(F.when(low == high, low).otherwise(low * (1 - w) + high * w))
        ok = ok & low.isNotNull() & high.isNotNull()
    return got.select(*by, "_c", "_n", F.array(*values).alias("_q"), ok.alias("_ok"))


def _few_groups(df: DataFrame, by: list[str], cols: Sequence[str], probs: Sequence[float], sketch: list, wide: bool = False) -> DataFrame:
    spark = df.sparkSession
    rows = _stack(df, by, cols)
    if not by:
        spans = sketch[0][2]
        place = F.lit(None).cast("int")
        for i, s in reversed(list(enumerate(spans))):
            place = F.when(F.col("_c") == i, _interval(F.col("_v"), s)).otherwise(place)
        rows = rows.withColumn("_i", place)
    else:
        schema = T.StructType([df.schema[b] for b in by] + [T.StructField("_s", T.ArrayType(T.ArrayType(T.StructType(
            [T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))))])
        spans = spark.createDataFrame([(*g, s) for g, _, s in sketch], T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))
        spans = spans.select(*[F.col(b).alias(f"_g{k}") for k, b in enumerate(by)], "_s")
        same = F.lit(True)
        for k, b in enumerate(by):
            same = same & F.col(b).eqNullSafe(F.col(f"_g{k}"))
        rows = rows.join(F.broadcast(spans), same).withColumn("_i", _interval(F.col("_v"), F.get("_s", F.col("_c"))))
    inside = F.col("_i") % 2 == 1
    counts = rows.groupBy(*by, "_c", "_i", F.when(inside, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    totals = counts.groupBy(*by, "_c", "_i").agg(F.sum("_k").alias("_t"))
    group = Window.partitionBy(*by, "_c")
    totals = totals.select(*[F.col(b).alias(f"_g{k}") for k, b in enumerate(by)], F.col("_c").alias("_gc"), F.col("_i").alias("_gi"),
                           F.coalesce(F.sum("_t").over(group.orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
                           F.sum("_t").over(group).alias("_n"))
    same = (F.col("_c") == F.col("_gc")) & (F.col("_i") == F.col("_gi"))
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_g{k}"))
    upto = F.sum("_k").over(Window.partitionBy(*by, "_c", "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_upto", upto).join(totals, same).where(F.col("_v").isNotNull())
    ranked = ranked.select(*by, "_c", "_v", "_n", (F.col("_base") + F.col("_upto") - F.col("_k")).alias("_before"), (F.col("_base") + F.col("_upto")).alias("_upto"))
    return _at_ranks(ranked, by, probs)


def _many_groups(df: DataFrame, by: list[str], cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    counts = _stack(df, by, cols).groupBy(*by, "_c", "_v").agg(F.count(F.lit(1)).alias("_k"))
    edges = range_edges(counts, "_v")
    # null keys are values of their own: running sums join on the keys, which nulls would leave
    keys = [f"_g{k}" for k in range(len(by))]
    counts = counts.select(*by, *[F.coalesce(F.concat(F.lit("="), F.col(b).cast("string")), F.lit("")).alias(k) for b, k in zip(by, keys)], "_c", "_v", "_k")
    ranked = chunked_running(counts, [*keys, "_c"], [F.col("_v")], range_chunk("_v", edges), {"_upto": F.col("_k")}, totals=True)
    ranked = ranked.select(*by, "_c", "_v", F.col("_upto_total").alias("_n"), (F.col("_upto") - F.col("_k")).alias("_before"), "_upto")
    return _at_ranks(ranked, by, probs)


def group_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by .., column_name, n, q``: exact quantiles (an array in the order of ``probs``) of each column in each group."""
    by, cols, probs = list(by), list(cols), list(probs)
    names = F.array(*[F.lit(c) for c in cols])
    groups = df.select(*by).distinct() if by else None
    margin = MARGIN
    while True:
        sketch = _sketch(df, by, cols, probs, margin)
        if len(sketch) > MAX_GROUPS:
            found = _many_groups(df, by, cols, probs)
            break
        if not sketch:
            return df.sparkSession.createDataFrame([], T.StructType([*[df.schema[b] for b in by], *_RESULT.fields]))
        rows = _few_groups(df, by, cols, probs, sketch).collect()       # a row per group (at most MAX_GROUPS) and column
        if all(r["_ok"] for r in rows):
            got = {(tuple(r[b] for b in by), r["_c"]): r["_q"] for r in rows}
            out = [(*g, c, ns[i], got.get((g, i), [None] * len(probs))) for g, ns, _ in sketch for i, c in enumerate(cols)]
            schema = T.StructType([T.StructField(b, df.schema[b].dataType, True) for b in by] + _RESULT.fields)
            # at most MAX_GROUPS rows a column: a join with the rows must not deal these by group, as a task then sorts a whole one
            return F.broadcast(df.sparkSession.createDataFrame(out, schema))
        margin = max(1, margin) * 16
    every = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 1))).alias("_c"))
    same = F.col("_c") == F.col("_c2")
    found = found.select(*[F.col(b).alias(f"_h{k}") for k, b in enumerate(by)], F.col("_c").alias("_c2"), "_n", "_q")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_h{k}"))
    nothing = F.array(*[F.lit(None).cast("double")] * len(probs))
    return every.join(found, same, "left").select(*by, F.get(names, F.col("_c")).alias("column_name"), F.coalesce("_n", F.lit(0)).cast("bigint").alias("n"),
                                                  F.coalesce("_q", nothing).alias("q"))


_RESULT = T.StructType([T.StructField("column_name", T.StringType()), T.StructField("n", T.LongType()), T.StructField("q", T.ArrayType(T.DoubleType()))])


def quantile_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns, on the driver: a list per column, of null if it has no value."""
    return {r["column_name"]: list(r["q"]) for r in group_quantiles(df, cols, probs).collect()}


def mode_values(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent value of each column, the smallest of equal ones; null and NaN do not count.

    Counts are grouped by value with map-side combine, columns of one type in one job.
    """
    by_type: dict[str, list[str]] = {}
    for c in cols:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    out = dict.fromkeys(cols)
    for kind, names in by_type.items():
        missing = (lambda c: F.isnan(c)) if kind in ("double", "float") else (lambda c: F.lit(False))
        rows = F.array(*[F.struct(F.lit(i).alias("_c"), F.when(~missing(F.col(c)), F.col(c)).alias("_v")) for i, c in enumerate(names)])
        counts = df.select(F.inline(rows)).where(F.col("_v").isNotNull()).groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_k"))
        for r in counts.groupBy("_c").agg(F.min(F.struct((-F.col("_k")).alias("k"), F.col("_v").alias("v"))).alias("m")).collect():
            out[names[r["_c"]]] = r["m"]["v"]
    return out
