"""Aggregations and distribution tables (the data behind profiles, KPI rows, histograms,
density curves, box plots, pair plots, quantile bins and interaction plots).

All are grouped aggregates with map-side partial aggregation; outputs are small tables
whose size depends on bins/groups, never on rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import spread
from .ranks import group_quantiles, quantile_values
from .windows import join_small


def profile(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Group means (persona summary) plus group size."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in cols])


def value_counts(df: DataFrame, col: str, labels: Mapping | None = None) -> DataFrame:
    """Counts per value (sort by ``col`` when showing); optional text label per value."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if labels:
        from ..functions.expressions import map_values
        out = out.withColumn("label", map_values(F.col(col), labels))
    return out


def kpi_row(df: DataFrame, cls: str = "GradeClass", value: str = "GPA", risk_threshold: int = 3) -> DataFrame:
    """n, mean value, at-risk count (class >= threshold) and at-risk percent, one aggregate."""
    n = F.count(F.lit(1))
    risk = F.count_if(F.col(cls) >= F.lit(risk_threshold))
    return df.agg(n.alias("n"), F.avg(value).alias(f"mean_{value}"), risk.alias("at_risk"),
                  (F.coalesce(F.try_divide(risk * F.lit(100.0), n), F.lit(0.0))).alias("at_risk_pct"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles (numpy/pandas rule), long form (column, p, value)."""
    p = F.array(*[F.lit(float(x)) for x in probs])
    zipped = F.arrays_zip(p.alias("p"), F.col("q").alias("value"))
    return group_quantiles(df, cols, probs, by).select(*by, "column_name", F.inline(zipped).alias("p", "value"))


def _corr(a: str, b: str) -> Column:
    """``corr`` from its parts, as the built-in fails on a constant column under ANSI rules."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlations of all pairs (pairwise-complete rows), one aggregate, long form; a
    constant column has none (null)."""
    pairs = list(itertools.combinations_with_replacement(cols, 2))
    g = df.agg(*[_corr(a, b).alias(f"c{i}")
                 for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"c{i}").alias("r")))
        if a != b:
            rows.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"c{i}").alias("r")))
    return g.select(F.inline(F.array(*rows)))


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Correlation of each column with ``target`` (target itself excluded); sort desc to show."""
    cols = [c for c in cols if c != target]
    g = df.agg(*[_corr(c, target).alias(f"c{i}")
                 for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("r")) for i, c in enumerate(cols)])
    return g.select(F.inline(rows))


def _min_max(df: DataFrame, col: str):
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return (0.0, 0.0) if r["lo"] is None else (float(r["lo"]), float(r["hi"]))     # no value: no bin is filled


def equal_width_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """1-based equal-width bin; the top edge belongs to the last bin; constant column -> 1."""
    if hi == lo:
        return F.when(x.isNotNull(), F.lit(1))
    b = F.floor((x - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo)).cast("int") + 1
    return F.least(b, F.lit(bins))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """(bin, lo, hi, n) for ``bins`` equal-width bins between min and max, nulls dropped."""
    lo, hi = _min_max(df, col)
    w = (hi - lo) / bins if hi > lo else 1.0
    b = equal_width_bin(F.col(col), lo, hi, bins)
    out = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(w)).alias("lo"),
                      (F.lit(lo) + F.col("bin") * F.lit(w)).alias("hi"), "n")


def kde(df: DataFrame, col: str, grid: int = 200, cut: float = 3.0, bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density on an even grid (Scott bandwidth = sd * n^-1/5). A column without values
    gives no row.

    Rows collapse to (distinct value, count) first; each distinct value then emits one
    contribution per grid point via ``explode(sequence)`` and the grid sums are a grouped
    aggregate (partial aggregation keeps the shuffle at grid x partitions rows).
    """
    st = df.agg(F.count(col).alias("n"), F.stddev_samp(col).alias("sd"), F.min(col).alias("lo"),
                F.max(col).alias("hi")).first()
    n, sd, lo, hi = st["n"], st["sd"] or 0.0, st["lo"], st["hi"]
    if not n:
        return df.sparkSession.createDataFrame([], "g int, x double, density double")
    lo, hi = float(lo), float(hi)
    h = bandwidth if bandwidth is not None else (sd * n ** (-0.2) if sd > 0 else 1.0)
    g0, g1 = lo - cut * h, hi + cut * h
    step = (g1 - g0) / (grid - 1)
    v = F.col(col).cast("double")
    vals = df.where(F.col(col).isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    pts = vals.select("v", "c", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g"))
    x = F.lit(g0) + F.col("g") * F.lit(step)
    z = (x - F.col("v")) / F.lit(h)
    contrib = F.col("c") * F.exp(-0.5 * z * z)
    norm = 1.0 / (n * h * (2 * 3.141592653589793) ** 0.5)
    return pts.groupBy("g").agg((F.sum(contrib) * F.lit(norm)).alias("density")).select(
        "g", (F.lit(g0) + F.col("g") * F.lit(step)).alias("x"), "density")


def box_stats(df: DataFrame, group: str, col: str) -> DataFrame:
    """Per group: quartiles, 1.5 IQR whiskers (most extreme data inside the fences) and outlier count.

    Quartiles come from rank selection; the fences, one row per group, join back to the rows. They are broadcast up to
    ``ranks.MAX_GROUPS`` groups, so that the rows stay where they were read."""
    q = group_quantiles(df.select(group, F.col(col).alias("_x")), ["_x"], [0.25, 0.5, 0.75], [group])
    q = q.select(group, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    q = q.withColumn("_lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn(
        "_hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    fences = q.select(F.col(group).alias("_g"), "_lo", "_hi")
    j = df.select(group, col).where(F.col(col).isNotNull()).join(fences, F.col(group).eqNullSafe(F.col("_g")))
    inside = (F.col(col) >= F.col("_lo")) & (F.col(col) <= F.col("_hi"))
    w = j.groupBy(F.col(group).alias("_g")).agg(F.min(F.when(inside, F.col(col))).alias("whisker_lo"),
                                                F.max(F.when(inside, F.col(col))).alias("whisker_hi"),
                                                F.count_if(~inside).alias("n_outliers"))
    return q.drop("_lo", "_hi").join(w, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def pair_bins(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """2-D equal-width binned counts for every column pair (pair-plot data), long form."""
    r = df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    rng = {c: (float(r[f"lo_{c}"] or 0.0), float(r[f"hi_{c}"] or 0.0)) for c in cols}
    pairs = list(itertools.combinations(cols, 2))
    structs = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                        equal_width_bin(F.col(a), *rng[a], bins).alias("bin_a"),
                        equal_width_bin(F.col(b), *rng[b], bins).alias("bin_b"))
               for a, b in pairs]
    d = df.select(F.inline(F.array(*structs))).where(F.col("bin_a").isNotNull() & F.col("bin_b").isNotNull())
    return d.groupBy("col_a", "col_b", "bin_a", "bin_b").agg(F.count(F.lit(1)).alias("n"))


def qcut_edges(df: DataFrame, col: str, q: int = 5) -> list[float]:
    """Exact quantile edges at 0, 1/q, .., 1 with duplicates dropped."""
    probs = [i / q for i in range(q + 1)]
    return sorted({x for x in quantile_values(df, [col], probs)[col] if x is not None})


def qcut_bin(x: Column, edges: Sequence[float]) -> Column:
    """Right-closed quantile bin 0..k-1 with the lowest edge included; outside -> null."""
    k = len(edges) - 1
    if k < 0:      # a column without values
        return F.lit(None).cast("int")
    if k < 1:
        return F.when(x == F.lit(edges[0]), F.lit(0))
    b = sum((x > F.lit(e)).cast("int") for e in edges[1:-1]) if k > 1 else F.lit(0)
    return F.when((x >= F.lit(edges[0])) & (x <= F.lit(edges[-1])), b)


def qcut(df: DataFrame, col: str, q: int = 5, out: str = "qbin") -> tuple[DataFrame, list[float]]:
    edges = qcut_edges(df, col, q)
    return df.withColumn(out, qcut_bin(F.col(col), edges)), edges


def qcut_table(df: DataFrame, col: str, q: int = 5) -> DataFrame:
    """(qbin, lo, hi, n)."""
    d, edges = qcut(df, col, q)
    at = F.array(*[F.lit(e) for e in edges]).cast("array<double>")
    lo, hi = F.get(at, F.col("qbin")), F.get(at, F.least(F.col("qbin") + 1, F.lit(len(edges) - 1)))
    return d.where(F.col("qbin").isNotNull()).groupBy("qbin").agg(F.count(F.lit(1)).alias("n")).select(
        "qbin", lo.alias("lo"), hi.alias("hi"), "n")


def interaction_table(df: DataFrame, x: str, y: str, hue: str, q: int = 5, z: float = 1.96, n_boot: int = 0, id_col: str | None = None,
                      seed=42) -> DataFrame:
    """Quantile bin of x by hue -> n, mean y, normal 95% interval (sample sd / sqrt n); with ``n_boot`` and the rows'
    ``id_col`` a bootstrap interval instead."""
    d, _ = qcut(df, x, q)
    if n_boot:
        return bootstrap_interval(d.where(F.col("qbin").isNotNull()), ["qbin", hue], y, id_col, n_boot, seed=seed)
    g = d.where(F.col("qbin").isNotNull()).groupBy("qbin", hue).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("_sd"))
    half = F.lit(z) * F.coalesce(F.col("_sd"), F.lit(0.0)) / F.sqrt(F.col("n"))
    return g.select("qbin", hue, "n", "mean", (F.col("mean") - half).alias("ci_lo"),
                    (F.col("mean") + half).alias("ci_hi"))


#: P(X <= k) for X ~ Poisson(1), k = 0..7
POISSON_CDF = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


#: the same as least 32-bit numbers: P(X > k) is the share of numbers from the k-th on
POISSON_STEPS = tuple(math.ceil(c * 2 ** 32) for c in POISSON_CDF)

BOOT_GROUPS = 1000      #: groups whose sums a task holds before it hands them on


def poisson_weights(ids: Sequence[str | None], n_boot: int, seed) -> np.ndarray:
    """How often each replicate draws each row (rows x replicates): Poisson(1) from eight hex digits of an md5 of
    ``id-(replicate div 4)-seed``, which four replicates share."""
    tails = [f"{q}-{seed}".encode() for q in range(-(-n_boot // 4))]
    heads = [b"" if i is None else f"{i}-".encode() for i in ids]
    digests = b"".join([md5(head + tail).digest() for head in heads for tail in tails])
    u = np.frombuffer(digests, ">u4").astype(np.uint32).reshape(len(heads), -1)[:, :n_boot]
    w = np.zeros(u.shape, np.uint8)
    for step in POISSON_STEPS:
        w += u >= np.uint32(step)
    return w


def _boot_sums(by: Sequence[str], n_boot: int, seed, schema: pa.Schema):
    """Batches of ``by .., _id, _y`` to sums per (group, replicate): a task hands on a row per group and replicate, not per row and replicate."""
    def hand_on(groups: dict):
        for key, (w, s, n, t) in groups.items():
            fixed = [pa.array([v] * n_boot, f.type) for v, f in zip(key, schema)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(range(n_boot), pa.int32()), pa.array(w), pa.array(s), pa.array([n] * n_boot, pa.int64()),
                                              pa.array([t] * n_boot, pa.float64())], schema=schema)

    def work(batches):
        groups: dict[tuple, list] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                keys = list(zip(*[part.column(c).to_pylist() for c in by])) if by else [()] * part.num_rows
                w, y = poisson_weights(part.column("_id").to_pylist(), n_boot, seed).astype(np.float64), part.column("_y").to_numpy()
                at: dict[tuple, list[int]] = {}
                for i, key in enumerate(keys):
                    at.setdefault(key, []).append(i)
                for key, rows in at.items():
                    g = groups.setdefault(key, [np.zeros(n_boot, np.int64), np.zeros(n_boot), 0, 0.0])
                    g[0] += w[rows].sum(axis=0).astype(np.int64)
                    g[1] += y[rows] @ w[rows]
                    g[2] += len(rows)
                    g[3] += y[rows].sum()
                if len(groups) > BOOT_GROUPS:
                    yield from hand_on(groups)
                    groups = {}
        yield from hand_on(groups)
    return work


def bootstrap_interval(df: DataFrame, by: Sequence[str], y: str, id_col: str, n_boot: int = 1000, level: float = 0.95, seed=42) -> DataFrame:
    """``by .., n, mean, ci_lo, ci_hi``: percentile bootstrap interval of the group mean (linear between ranks).

    Every row weighs a hashed Poisson(1) number in each replicate, so a replicate needs no draw from the
    rows: a task turns a block of rows into a matrix of weights and adds it to its sums per (group, replicate), so that
    only those sums are shuffled, whatever the group's size. Only the
    ``n_boot`` means of a group come together. Replicates without a row of the group do not count; rows without ``y`` do not either.
    """
    rows = df.where(F.col(y).isNotNull()).select(*by, F.col(id_col).cast("string").alias("_id"), F.col(y).cast("double").alias("_y"))
    out = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema if f.name not in ("_id", "_y")]
                       + [T.StructField("_b", T.IntegerType()), T.StructField("_w", T.LongType()), T.StructField("_s", T.DoubleType()),
                          T.StructField("n", T.LongType()), T.StructField("_t", T.DoubleType())])
    sums = spread(rows).mapInArrow(_boot_sums(list(by), n_boot, seed, to_arrow_schema(out)), out)
    sums = sums.groupBy(*by, "_b").agg(*[F.sum(c).alias(c) for c in ("_w", "_s", "n", "_t")])
    got = sums.groupBy(*by).agg(F.max("n").alias("n"), F.max(F.when(F.col("_b") == 0, F.col("_t"))).alias("_t"),
                                F.array_sort(F.collect_list(F.try_divide("_s", "_w"))).alias("_m"))     # n_boot numbers at most

    def at(p: float) -> Column:
        where = F.lit(p) * (F.size("_m") - 1)
        low, high = F.get("_m", F.floor(where).cast("int")), F.get("_m", F.ceil(where).cast("int"))
        return low + (high - low) * (where - F.floor(where))
    return got.select(*by, "n", (F.col("_t") / F.col("n")).alias("mean"), at((1 - level) / 2).alias("ci_lo"), at((1 + level) / 2).alias("ci_hi"))
