"""Hypothesis tests and multivariate statistics from sufficient statistics.

* Mann-Whitney U (median split): ranks come from the *distinct-value* table with per-group
  counts, ranked by chunked running sums, so neither a global window over rows nor a
  collect of the values is needed. Tie term and U are sums over that table.
* VIF and the PC skeleton work on a p x p Gram/correlation matrix computed in one pass.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import quantile_values
from .windows import chunked_running, range_chunk, range_edges

# Chebyshev fit of erfc (fractional error < 1.2e-7), coefficients in order.
ERFC_COEF = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
             0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def erfc_expr(x: Column) -> Column:
    """erfc(x) as a JVM expression (Spark has no erf)."""
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    poly = F.lit(ERFC_COEF[-1])
    for c in reversed(ERFC_COEF[:-1]):
        poly = F.lit(c) + t * poly
    ans = t * F.exp(-z * z + poly)
    return F.when(x >= 0, ans).otherwise(F.lit(2.0) - ans)


def erfc_sql(x: str) -> str:
    """Same polynomial as DuckDB text (for the oracle)."""
    z = f"abs({x})"
    t = f"(1.0 / (1.0 + 0.5 * {z}))"
    poly = f"{ERFC_COEF[-1]!r}"
    for c in reversed(ERFC_COEF[:-1]):
        poly = f"({c!r} + {t} * {poly})"
    ans = f"({t} * exp(-{z} * {z} + {poly}))"
    return f"(CASE WHEN {x} >= 0 THEN {ans} ELSE 2.0 - {ans} END)"


def median_split_groups(df: DataFrame, hypotheses: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Stack (hypothesis, group 'High'/'Low', y) for each (name, group_col, target).

    More than two distinct values: > median -> High, else (also without a value) Low. Two or fewer: the larger
    value is High and the smaller Low (the reference compares groups that do not exist).
    """
    gcols = sorted({g for _, g, _ in hypotheses})
    median = {g: q[0] for g, q in quantile_values(df, gcols, [0.5]).items()}
    st = df.agg(*[F.count_distinct(g).alias(f"d_{g}") for g in gcols],
                *[F.max(g).alias(f"x_{g}") for g in gcols], *[F.min(g).alias(f"n_{g}") for g in gcols]).first()
    structs = []
    for name, g, y in hypotheses:
        x = F.col(g)
        if st[f"d_{g}"] > 2:
            grp = F.when(x > F.lit(median[g]), F.lit("High")).otherwise(F.lit("Low"))
        else:
            grp = F.when(x == F.lit(st[f"x_{g}"]), F.lit("High")).when(x == F.lit(st[f"n_{g}"]), F.lit("Low"))
            if st[f"x_{g}"] == st[f"n_{g}"]:
                grp = F.lit(None).cast("string")
        structs.append(F.struct(F.lit(name).alias("hypothesis"), grp.alias("grp"),
                                F.col(y).cast("double").alias("y")))
    return df.select(F.inline(F.array(*structs))).where(F.col("grp").isNotNull() & F.col("y").isNotNull())


def mann_whitney(stacked: DataFrame, chunks: int | None = None) -> DataFrame:
    """Two-sided Mann-Whitney U per hypothesis on (hypothesis, grp, y) rows, High vs Low.

    Output: hypothesis, n_high, n_low, u (statistic of High), z (tie and continuity
    corrected, for max(U1, U2)), p_value = erfc(z / sqrt 2). A constant target has no z and no p_value.
    """
    vals = stacked.groupBy("hypothesis", "y").agg(
        F.count_if(F.col("grp") == "High").alias("c1"), F.count(F.lit(1)).alias("t"))
    edges = range_edges(vals, "y", chunks)
    ranked = chunked_running(vals, ["hypothesis"], [F.col("y")], range_chunk("y", edges), {"cum": F.col("t")})
    mid = F.col("cum") - F.col("t") + (F.col("t") + F.lit(1)) / F.lit(2.0)
    g = ranked.groupBy("hypothesis").agg(
        F.sum(F.col("c1") * mid).alias("r1"), F.sum("c1").alias("n1"), F.sum("t").alias("n"),
        F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    n2 = n - n1
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    u = F.greatest(u1, n1 * n2 - u1)
    s = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(u - n1 * n2 / 2 - F.lit(0.5), s)       # null where every value is tied or a group is empty
    p = F.when(z.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), erfc_expr(z / F.lit(math.sqrt(2.0))))))
    return g.select("hypothesis", F.col("n1").cast("bigint").alias("n_high"), (F.col("n") - F.col("n1")).cast("bigint")
                    .alias("n_low"), u1.alias("u"), z.alias("z"), p.alias("p_value"))


def mann_whitney_batch(df: DataFrame, hypotheses: Sequence[tuple[str, str, str]]) -> DataFrame:
    return mann_whitney(median_split_groups(df, hypotheses))


def gram(df: DataFrame, cols: Sequence[str], center: bool = False):
    """X'X (or the covariance when ``center``) as numpy, from one aggregate of p(p+1)/2 sums."""
    import numpy as np
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    pairs = list(itertools.combinations_with_replacement(range(len(cols)), 2))
    aggs = [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"g{i}_{j}") for i, j in pairs]
    aggs += [F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)] + [F.count(F.lit(1)).alias("n")]
    r = d.agg(*aggs).first()
    p = len(cols)
    G = np.zeros((p, p))
    for i, j in pairs:
        G[i, j] = G[j, i] = r[f"g{i}_{j}"] or 0.0
    if center:
        s = np.array([r[f"s{i}"] or 0.0 for i in range(p)])
        n = r["n"]
        G = (G - np.outer(s, s) / n) / max(n - 1, 1)
    return G, r["n"]


def vif(df: DataFrame, cols: Sequence[str], threshold: float = 10.0) -> list[tuple]:
    """Uncentred VIF_i = (X'X)_ii * ((X'X)^-1)_ii (no constant added); rows (feature, vif, high).

    Columns that take part in an exact linear dependence are infinite; a column of zeros has no value (NaN).
    """
    import numpy as np
    G, _ = gram(df, cols)
    length = np.sqrt(np.diag(G))
    live = length > 0
    values, vectors = np.linalg.eigh((G / np.outer(np.where(live, length, 1), np.where(live, length, 1)))[np.ix_(live, live)])
    lost = values < 1e-12 * len(cols)
    out = np.full(len(cols), np.nan)
    out[live] = np.where((vectors[:, lost] ** 2).sum(axis=1) > 1e-9, np.inf, (vectors[:, ~lost] ** 2 / values[~lost]).sum(axis=1))
    return [(c, float(v), bool(v > threshold)) for c, v in zip(cols, out)]


def vif_frame(df: DataFrame, cols: Sequence[str], threshold: float = 10.0) -> DataFrame:
    return df.sparkSession.createDataFrame(vif(df, cols, threshold), "feature string, vif double, high boolean")


def _partial_corr(C, i, j, S):
    import numpy as np
    idx = [i, j] + list(S)
    sub = C[np.ix_(idx, idx)]
    P = np.linalg.pinv(sub)
    d = math.sqrt(abs(P[0, 0] * P[1, 1]))
    return -P[0, 1] / d if d > 0 else 0.0


def pc_skeleton(corr, n: int, names: Sequence[str], alpha: float = 0.05, max_order: int | None = None):
    """PC algorithm on a correlation matrix with Fisher-z tests, in the order-independent form:
    the neighbours tested at a level are those at its start.

    Returns (edges, sepsets, p-values): edges as set of frozensets, sepset per removed pair, the
    largest p-value tested per pair.
    """
    p = len(names)
    adj = {i: set(range(p)) - {i} for i in range(p)}
    sepset = {}
    order = 0
    pvals = {}
    while True:
        if max_order is not None and order > max_order:
            break
        any_tested = False
        start = {i: frozenset(a) for i, a in adj.items()}
        for i in range(p):
            for j in sorted(start[i]):
                if j not in adj[i]:
                    continue
                others = sorted(start[i] - {j})
                if len(others) < order:
                    continue
                for S in itertools.combinations(others, order):
                    any_tested = True
                    r = max(-0.9999999, min(0.9999999, _partial_corr(corr, i, j, S)))
                    dof = n - len(S) - 3
                    if dof <= 0:
                        continue
                    zstat = math.sqrt(dof) * 0.5 * math.log((1 + r) / (1 - r))
                    pv = math.erfc(abs(zstat) / math.sqrt(2))
                    pair = frozenset((i, j))
                    pvals[pair] = max(pv, pvals.get(pair, 0.0))
                    if pv > alpha:
                        adj[i].discard(j)
                        adj[j].discard(i)
                        sepset[pair] = set(S)
                        break
        order += 1
        if not any_tested:
            break
    edges = {frozenset((i, j)) for i in range(p) for j in adj[i]}
    return edges, sepset, pvals


def pc_orient(edges, sepset, p: int):
    """Orient v-structures then apply Meek rules 1-3; returns set of directed (i, j) and undirected pairs.

    A v-structure that would turn round an arrow of an earlier one is left out.
    """
    directed = set()
    undirected = {tuple(sorted(e)) for e in edges}
    adj = {i: set() for i in range(p)}
    for e in edges:
        a, b = tuple(e)
        adj[a].add(b)
        adj[b].add(a)
    for k in range(p):
        for i, j in itertools.combinations(sorted(adj[k]), 2):
            if j in adj[i]:
                continue
            if k not in sepset.get(frozenset((i, j)), set()) and not {(k, i), (k, j)} & directed:
                for a in (i, j):
                    directed.add((a, k))
                    undirected.discard(tuple(sorted((a, k))))

    def is_dir(a, b):
        return (a, b) in directed

    changed = True
    while changed:
        changed = False
        for a, b in list(undirected):
            for x, y in ((a, b), (b, a)):
                # Z -> x - y, z not adjacent y  => x -> y
                r1 = any(is_dir(z, x) and y not in adj[z] and z != y for z in range(p))
                # R2: x -> z -> y and x - y => x -> y
                r2 = any(is_dir(x, z) and is_dir(z, y) for z in range(p))
                # X - z1 -> y, x - z2 -> y, z1, z2 not adjacent, x - y => x -> y
                cands = [z for z in adj[x] if tuple(sorted((x, z))) in undirected and is_dir(z, y)]
                r3 = any(z2 not in adj[z1] for z1, z2 in itertools.combinations(cands, 2))
                if r1 or r2 or r3:
                    directed.add((x, y))
                    undirected.discard((a, b))
                    changed = True
                    break
    return directed, undirected


def causal_edges(df: DataFrame, cols: Sequence[str], alpha: float = 0.05, separations: bool = False) -> DataFrame:
    """Edge table (src, dst, kind 'directed'|'undirected', p_value) of the PC graph.

    With ``separations`` also a column ``sepset``, and a row of kind 'separated' for each pair without an edge, with the
    columns given which it is independent. The only distributed work is the covariance pass; the search runs on the p x p matrix.
    """
    import numpy as np
    cov, n = gram(df, cols, center=True)
    d = np.sqrt(np.diag(cov))
    d[d == 0] = 1.0
    corr = cov / np.outer(d, d)
    edges, sep, pv = pc_skeleton(corr, n, cols, alpha)
    directed, undirected = pc_orient(edges, sep, len(cols))
    rows = [(cols[a], cols[b], "directed", float(pv.get(frozenset((a, b)), 0.0))) for a, b in sorted(directed)]
    rows += [(cols[a], cols[b], "undirected", float(pv.get(frozenset((a, b)), 0.0))) for a, b in sorted(undirected)]
    schema = "src string, dst string, kind string, p_value double"
    if not separations:
        return df.sparkSession.createDataFrame(rows, schema)
    rows = [(*r, None) for r in rows]
    for pair, given in sorted(sep.items(), key=lambda x: sorted(x[0])):
        a, b = sorted(pair)
        rows.append((cols[a], cols[b], "separated", float(pv[pair]), [cols[k] for k in sorted(given)]))
    return df.sparkSession.createDataFrame(rows, schema + ", sepset array<string>")


class PCAResult:
    """Principal components of standardised columns: ``table`` (component, ratio, cumulative, first_at_share), the number ``k`` of
    components that reach the share, and ``project``, which scores rows on the first ``k`` (up to the components' signs)."""

    def __init__(self, model, table: list[tuple], k: int, spark):
        self.model, self.rows, self.k, self.spark = model, table, k, spark

    @property
    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "component int, ratio double, cumulative double, first_at_share boolean")

    def project(self, df: DataFrame, prefix: str = "pc_") -> DataFrame:
        scores = vector_to_array("_pc")
        out = self.model.transform(df).withColumns({f"{prefix}{i + 1}": scores[i] for i in range(self.k)})
        return out.drop("_v", "_s", "_pc")


def pca(df: DataFrame, cols: Sequence[str], share: float = 0.9) -> PCAResult:
    """PCA by MLlib (one Gram pass); ``k`` is the least number of components whose ratios sum to ``share``."""
    steps = [VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="skip"),
             StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True), PCA(k=len(cols), inputCol="_s", outputCol="_pc")]
    model = Pipeline(stages=steps).fit(df)
    rows, total, k = [], 0.0, 0
    for i, v in enumerate(model.stages[-1].explainedVariance):
        first = total < share <= total + float(v) or (not k and i == len(cols) - 1)
        total += float(v)
        rows.append((i + 1, float(v), total, first))
        k = k or (i + 1 if first else 0)
    return PCAResult(model, rows, k, df.sparkSession)


def binary_treatment(df: DataFrame, col: str, threshold=None, truthy: bool = False, name: str = "treatment"):
    """Make a 0/1 treatment column (threshold flag or truthy text) and refuse a constant one."""
    from ..functions.expressions import threshold_flag, truthy_flag
    t = truthy_flag(col) if truthy else threshold_flag(col, threshold if threshold is not None else 0)
    out = df.withColumn(name, t)
    k = out.agg(F.count_distinct(name)).first()[0]
    if k < 2:
        raise ValueError(f"treatment {name} is constant; no effect can be estimated")
    return out
