"""Propensity scores, nearest-score matching (an as-of join) and the placebo refuter.

Matching plan: each arm collapses to its distinct scores (representative row = smallest
row id at that score). The union of both arms' distinct scores is split into score-range
chunks; inside a chunk, ``last``/``first`` with ``ignorenulls`` find the nearest lower and
upper score of the other arm; a per-chunk min/max table (chunks x arms rows) carries the
nearest candidates across chunk borders. No window spans the whole table and no pairs
are formed. Tie in distance -> the lower score.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .windows import chunked_running, join_small, md5_order, range_chunk, range_edges


def propensity_logistic(df: DataFrame, treatment: str, confounders: Sequence[str], name: str = "score") -> DataFrame:
    """P(treatment = 1 | confounders) by unpenalised logistic regression (MLlib)."""
    va = VectorAssembler(inputCols=list(confounders), outputCol="_x", handleInvalid="keep")
    d = va.transform(df).withColumn("_t", F.col(treatment).cast("double"))
    lr = LogisticRegression(featuresCol="_x", labelCol="_t", regParam=0.0, maxIter=100, probabilityCol="_p",
                            predictionCol="_pred", rawPredictionCol="_raw")
    m = lr.fit(d)
    return m.transform(d).withColumn(name, vector_to_array("_p")[1]).drop("_x", "_t", "_p", "_pred", "_raw")


def propensity_cells(df: DataFrame, treatment: str, confounders: Sequence[str], name: str = "score",
                     by: Sequence[str] = ()) -> DataFrame:
    """Nonparametric propensity for discrete confounders: treated share of the confounder cell."""
    keys = list(by) + list(confounders)
    cells = df.groupBy(*keys).agg(F.avg(F.col(treatment).cast("double")).alias(name))
    return df.join(cells, keys)   # one row per cell; Catalyst broadcasts when small (AQE)


def _match_scores(reps: DataFrame, arm: str, score: str, by: Sequence[str], chunks: int | None) -> DataFrame:
    """On a table with one row per (by, arm, score) and its representative outcome ``_y``,
    add ``matched_outcome``/``matched_score``: the nearest score of the other arm."""
    by = list(by)
    edges = range_edges(reps, score, chunks)
    d = reps.withColumn("_c", range_chunk(score, edges))
    cand = {a: F.when(F.col(arm) == a, F.struct(F.col(score).alias("s"), F.col("_y").alias("y"))) for a in (0, 1)}
    w = Window.partitionBy(*by, "_c").orderBy(score, arm)
    pre = w.rowsBetween(Window.unboundedPreceding, -1)
    post = w.rowsBetween(1, Window.unboundedFollowing)
    d = d.select("*", *[F.last(cand[a], ignorenulls=True).over(pre).alias(f"_lo{a}") for a in (0, 1)],
                 *[F.first(cand[a], ignorenulls=True).over(post).alias(f"_hi{a}") for a in (0, 1)])
    # chunk summaries: largest and smallest score of each arm per chunk (chunks x 2 rows)
    summ = d.groupBy(*by, "_c").agg(
        *[F.max(cand[a]).alias(f"_mx{a}") for a in (0, 1)], *[F.min(cand[a]).alias(f"_mn{a}") for a in (0, 1)])
    ws = Window.partitionBy(*by).orderBy("_c")
    summ = summ.select(*by, "_c",
                       *[F.last(f"_mx{a}", ignorenulls=True).over(ws.rowsBetween(Window.unboundedPreceding, -1))
                         .alias(f"_clo{a}") for a in (0, 1)],
                       *[F.first(f"_mn{a}", ignorenulls=True).over(ws.rowsBetween(1, Window.unboundedFollowing))
                         .alias(f"_chi{a}") for a in (0, 1)])
    d = join_small(d, summ, on=[*by, "_c"], known_rows=None if by else len(edges) + 1)
    other = 1 - F.col(arm)
    lo = F.when(other == 0, F.coalesce("_lo0", "_clo0")).otherwise(F.coalesce("_lo1", "_clo1"))
    hi = F.when(other == 0, F.coalesce("_hi0", "_chi0")).otherwise(F.coalesce("_hi1", "_chi1"))
    keep = [c for c in reps.columns]
    d = d.select(*keep, lo.alias("_lo"), hi.alias("_hi"))
    dlo = F.col(score) - F.col("_lo.s")
    dhi = F.col("_hi.s") - F.col(score)
    pick_lo = F.col("_hi").isNull() | (F.col("_lo").isNotNull() & (dlo <= dhi))
    best = F.when(pick_lo, F.col("_lo")).otherwise(F.col("_hi"))
    return d.select(*keep, best["y"].alias("matched_outcome"), best["s"].alias("matched_score"))


def nearest_match(df: DataFrame, id_col: str, arm: str, score: str, outcome: str,
                  by: Sequence[str] = (), chunks: int | None = None) -> DataFrame:
    """For every row, the outcome of the nearest-score row of the other arm (1-NN with replacement).

    Adds ``matched_outcome`` and ``matched_score``. ``by`` runs independent matchings.
    """
    by = list(by)
    reps = df.groupBy(*by, arm, score).agg(F.min_by(F.col(outcome).cast("double"), F.col(id_col)).alias("_y"))
    m = _match_scores(reps, arm, score, by, chunks).drop("_y")
    return df.join(m, [*by, arm, score], "left")


def matched_effect(df: DataFrame, id_col: str, treatment: str, score: str, outcome: str,
                   by: Sequence[str] = (), chunks: int | None = None) -> DataFrame:
    """ATT, ATC and ATE by nearest-score matching in both directions.

    Everything after one grouped pass runs on the (arm, score) table: a group of n rows
    with outcome sum S matched to outcome m contributes S - n m (treated) or n m - S
    (control), so the rows are never joined back.
    """
    by = list(by)
    y = F.col(outcome).cast("double")
    reps = df.groupBy(*by, treatment, score).agg(
        F.min_by(y, F.col(id_col)).alias("_y"), F.count(y).alias("_n"), F.sum(y).alias("_sy"))
    return _effect(reps, treatment, score, by, chunks)


def _effect(reps: DataFrame, treatment: str, score: str, by: Sequence[str], chunks: int | None = None) -> DataFrame:
    """The effects from the (by, arm, score) table: representative outcome ``_y``, count ``_n`` and sum ``_sy`` of the outcomes."""
    m = _match_scores(reps, treatment, score, by, chunks).where(F.col("matched_outcome").isNotNull())
    t = F.col(treatment) == 1
    contrib = F.when(t, F.col("_sy") - F.col("_n") * F.col("matched_outcome")).otherwise(
        F.col("_n") * F.col("matched_outcome") - F.col("_sy"))
    n_t = F.sum(F.when(t, F.col("_n")))
    n_c = F.sum(F.when(~t, F.col("_n")))
    return m.groupBy(*by).agg(
        (F.sum(F.when(t, contrib)) / n_t).alias("att"), (F.sum(F.when(~t, contrib)) / n_c).alias("atc"),
        (F.sum(contrib) / F.sum("_n")).alias("ate"), F.coalesce(n_t, F.lit(0)).cast("bigint").alias("n_treated"),
        F.coalesce(n_c, F.lit(0)).cast("bigint").alias("n_control"))


def permuted_treatment(df: DataFrame, id_col: str, treatment: str, replicates: int, seed=0,
                       name: str = "placebo") -> DataFrame:
    """Rows x replicates with the treatment column shuffled per replicate.

    The row at md5-rank k of replicate r receives the treatment of the row at id-rank k,
    so each replicate is an exact permutation of the observed treatment vector. Ranks are
    chunked running counts (no single-task window).
    """
    from .windows import md5_chunk
    rep = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    key = md5_order(F.concat_ws("|", F.col(id_col).cast("string"), F.col("replicate").cast("string")), seed)
    a = rep.withColumn("_k", key)
    a = chunked_running(a, ["replicate"], [F.col("_k")], md5_chunk(F.col("_k")), {"_rank": F.lit(1)}).drop("_k")
    edges = range_edges(df, id_col)
    b = chunked_running(df.select(id_col, treatment), [], [F.col(id_col)], range_chunk(id_col, edges),
                        {"_rank": F.lit(1)}, n_chunks=len(edges) + 1).select("_rank", F.col(treatment).alias(name))
    return a.join(b, "_rank").drop("_rank")


#: ranks per row of the written order, and rows of a replicate that a task ranks together
ORDER_BLOCK, RANKED_TOGETHER = 4096, 50_000


def _placebo_group(rows: pa.Table, order: pa.Table) -> pa.Table:
    """One range of one replicate's shuffled order: the treatments at its ranks, summed per (cell, treatment)."""
    number = lambda t, c: t.column(c).to_numpy()
    out = {"replicate": [], "_cell": [], "_t": [], "_rows": [], "_n": [], "_sy": [], "_at": [], "_y": []}
    if rows.num_rows:
        start, blocks = order.column("_start")[0].as_py(), number(order, "_block")
        by_block = order.take(pa.array(np.argsort(blocks))).column("_ts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        first = start - blocks.min() * ORDER_BLOCK
        place = np.empty(rows.num_rows, np.int64)
        place[np.lexsort((number(rows, "_at"), number(rows, "_k")))] = np.arange(first, first + rows.num_rows)
        kept = rows.column("_cell").is_valid().to_numpy()
        t, cell, at, y, named = by_block[place][kept], rows.column("_cell").drop_null().to_numpy(), number(rows, "_at")[kept], number(rows, "_y")[kept], number(rows, "_named")[kept]
        valid = rows.column("_y").is_valid().to_numpy()[kept]
        cells, a = np.unique(cell, return_inverse=True)
        arms, b = np.unique(t, return_inverse=True)
        group, g = np.unique(a * len(arms) + b, return_inverse=True)
        lead = np.lexsort((at, ~named, g))         # per group the row of the smallest id first
        lead = lead[np.searchsorted(g[lead], np.arange(len(group)))]
        out = {"replicate": [rows.column("replicate")[0].as_py()] * len(group), "_cell": cells[group // max(1, len(arms))],
               "_t": pa.array(arms[group % max(1, len(arms))], from_pandas=True), "_rows": np.bincount(g, minlength=len(group)),
               "_n": np.bincount(g[valid], minlength=len(group)), "_sy": np.bincount(g[valid], y[valid], len(group)),
               "_at": pa.array(at[lead], mask=~named[lead]), "_y": pa.array(y[lead], mask=~valid[lead])}
    return pa.table({c: pa.array(v, pa.float64() if c in ("_t", "_sy", "_y") else pa.int32() if c == "replicate" else pa.int64()) for c, v in out.items()})


def placebo_cells(df: DataFrame, id_col: str, treatment: str, confounders: Sequence[str], outcome: str, replicates: int, seed=0) -> DataFrame:
    """``replicate, _cell, _t, _rows, _n, _sy, _at, _y``: the rows of ``permuted_treatment`` summed per (replicate, confounder
    cell, placebo treatment) and range of the replicate's order; ``_y`` is the outcome of the smallest id (``_at``: its rank).

    The rows are ranked by id once; the treatments in that order are written in blocks. A replicate's rows are shuffled by ranges of
    their md5 and each range is ranked by itself: it needs the few blocks of the order that its ranks fall in, so the
    rows are never joined on their rank and only the sums leave the task. Rows with equal md5 follow their id's rank.
    """
    edges = range_edges(df, id_col)
    cells = materialize(df.select(*confounders).dropna("any", subset=list(confounders)).distinct().withColumn("_cell", F.monotonically_increasing_id()), "placebo-cells")
    ranked = chunked_running(df.select(F.col(id_col).alias("_id"), F.col(treatment).cast("double").alias("_t"), F.col(outcome).cast("double").alias("_y"),
                                       *[F.col(c) for c in confounders]),
                             [], [F.col("_id")], range_chunk("_id", edges), {"_at": F.lit(1)}, n_chunks=len(edges) + 1)
    rows = materialize(ranked.join(cells, list(confounders), "left").select("_id", "_t", "_y", "_at", "_cell"), "placebo-rows")
    n = rows.count()
    order = rows.groupBy(F.floor((F.col("_at") - 1) / ORDER_BLOCK).alias("_block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_t"))), lambda r: r["_t"]).alias("_ts"))
    order = materialize(order, "placebo-order")

    text = md5_order(F.concat_ws("|", F.col("_id").cast("string"), F.col("replicate").cast("string")), seed)
    ranges = max(1, -(-n // RANKED_TOGETHER))
    keyed = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    keyed = keyed.select("replicate", F.conv(F.substring(text, 1, 15), 16, 10).cast("bigint").alias("_k"), "_cell", "_y", "_at", F.col("_id").isNotNull().alias("_named"))
    keyed = keyed.withColumn("_range", F.shiftright(F.shiftright("_k", 30) * F.lit(ranges), 30).cast("int"))
    sizes = keyed.groupBy("replicate", "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("replicate").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sizes.select("*", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")), "placebo-ranges")
    needed = starts.select("replicate", "_range", "_start", F.explode(F.sequence(
        F.floor(F.col("_start") / ORDER_BLOCK), F.floor((F.col("_start") + F.col("_size") - 1) / ORDER_BLOCK))).alias("_block")).join(order, "_block")
    tasks = max(-(-n * replicates // 1_000_000), min(-(-n * replicates // RANKED_TOGETHER), 2 * df.sparkSession.sparkContext.defaultParallelism), 1)
    return keyed.repartition(tasks, "replicate", "_range").groupBy("replicate", "_range").cogroup(needed.groupBy("replicate", "_range")).applyInArrow(
        _placebo_group, "replicate int, _cell long, _t double, _rows long, _n long, _sy double, _at long, _y double")


def placebo_refute(df: DataFrame, id_col: str, treatment: str, confounders: Sequence[str], outcome: str,
                   estimate: float, replicates: int = 20, seed=0) -> DataFrame:
    """Re-estimate the effect with a permuted treatment per replicate (cell propensity + matching).

    Returns one row: estimate, mean placebo effect, sd, ``p_value`` of zero under the placebo
    distribution (large: the placebo effect is no effect, as it should be) and ``p_estimate`` of
    the estimate under it (small: the estimate is not chance); both two-sided normal, null where
    all replicates agree.
    """
    d = placebo_cells(df, id_col, treatment, confounders, outcome, replicates, seed)
    d = d.groupBy("replicate", "_cell", "_t").agg(F.sum("_rows").alias("_rows"), F.sum("_n").alias("_n"), F.sum("_sy").alias("_sy"),
                                                  F.min_by("_y", "_at").alias("_y"), F.min("_at").alias("_at"))
    cell = Window.partitionBy("replicate", "_cell")     # a row per treatment value
    d = d.withColumn("_ps", F.sum(F.col("_t") * F.col("_rows")).over(cell) / F.sum(F.when(F.col("_t").isNotNull(), F.col("_rows"))).over(cell))
    reps = d.groupBy("replicate", F.col("_t").cast(df.schema[treatment].dataType).alias("placebo"), "_ps").agg(
        F.min_by("_y", "_at").alias("_y"), F.sum("_n").alias("_n"), F.sum("_sy").alias("_sy"))
    eff = _effect(materialize(reps, "placebo"), "placebo", "_ps", ["replicate"])
    st = eff.agg(F.avg("ate").alias("placebo_mean"), F.stddev_samp("ate").alias("placebo_sd"),
                 F.count(F.lit(1)).alias("replicates"))
    from .hypothesis import erfc_expr

    def p(value):
        z = F.try_divide(F.abs(F.lit(float(value)) - F.col("placebo_mean")), F.col("placebo_sd"))
        return F.when(z.isNotNull(), erfc_expr(z / F.lit(math.sqrt(2.0))))
    return st.select(F.lit(estimate).alias("estimate"), "placebo_mean", "placebo_sd", "replicates",
                     p(0.0).alias("p_value"), p(estimate).alias("p_estimate"))
