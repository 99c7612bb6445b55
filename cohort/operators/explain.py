"""Explanations and recourse on any fitted MLlib classifier with a probability column.

* Shapley values by permutation sampling: each (row, sample) draws a feature order and a
  background row (md5-seeded); the p + 1 points along that order are generated with
  ``explode`` (no join of rows with rows), scored in one ``transform``, and consecutive
  differences, taken by a signed grouped sum (no window), are the contributions. Per row they sum to f(x) - mean f(background)
  exactly (telescoping). The background is a fixed-size md5 sample, counted, broadcast.
  For a forest the points are looked up in its table of cells (``forest.py``) and a row's chains stay in its task: a
  row goes in, its p contributions come out.
* Counterfactuals: for every query row, candidate changes of the allowed columns come
  from a grid of observed quantiles (a few values per column, exploded per row), are
  scored in one ``transform``, filtered to the desired class and ranked per row by
  scaled L1 distance and number of changed columns; the best k are kept. A forest's candidates are looked up the same
  way, and only a row's best k leave the task.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import spread
from .forest import Cells, score_cells
from .ranks import quantile_values
from .windows import chunked_row_number, join_small, md5_order


def _prob(model, df: DataFrame, features: Sequence[str], target_class: int, out: str) -> DataFrame:
    d = VectorAssembler(inputCols=list(features), outputCol="_fv", handleInvalid="keep").transform(df)
    m = model.copy()
    m.setFeaturesCol("_fv").setProbabilityCol("_prob").setPredictionCol("_pred")
    if hasattr(m, "setRawPredictionCol"):
        m.setRawPredictionCol("_raw")
    s = m.transform(d)
    return s.withColumn(out, vector_to_array("_prob")[target_class]).drop("_fv", "_prob", "_pred", "_raw")


def background_sample(df: DataFrame, id_col: str, size: int = 100, seed: int = 0) -> DataFrame:
    """The ``size`` rows with the smallest md5(id-seed), numbered 0..size-1 (bounded size)."""
    r = chunked_row_number(df, [], md5_order(F.col(id_col), f"bg-{seed}"), name="_bg")
    return r.where(F.col("_bg") <= size).withColumn("_bg", F.col("_bg") - 1)


def shapley_values(model, df: DataFrame, id_col: str, features: Sequence[str], target_class: int,
                   background: DataFrame, samples: int = 16, seed: int = 0, return_base: bool = False):
    """(row id, feature, phi): mean over ``samples`` permutations of the marginal contribution.

    With ``return_base`` also (row id, base) where base = mean f(background draw), so that
    sum(phi) = f(x) - base per row.
    """
    p = len(features)
    nbg = background.count()
    cells = score_cells(model, p, target_class) if 0 < nbg <= MAX_BACKGROUND else None
    if cells:
        return _shapley_cells(cells, df, id_col, features, background, samples, seed, return_base)
    bg = background.select("_bg", F.struct(*[F.col(c).cast("double").alias(c) for c in features]).alias("_z"))
    base = df.select(id_col, F.struct(*[F.col(c).cast("double").alias(c) for c in features]).alias("_x"))
    d = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("_m"))
    key = F.concat_ws("|", F.col(id_col).cast("string"), F.col("_m").cast("string"))
    d = d.withColumn("_bg", (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"-b{seed}"))), 1, 12), 16, 10)
                             .cast("long") % F.lit(nbg)).cast("int"))
    # feature order: sort features by md5(key, feature)
    order = F.array_sort(F.array(*[F.struct(F.md5(F.concat(key, F.lit(f"-{c}-{seed}"))).alias("h"),
                                            F.lit(i).alias("i")) for i, c in enumerate(features)]))
    d = d.withColumn("_ord", F.transform(order, lambda s: s["i"]))
    d = join_small(d, bg, "_bg")
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(p))).alias("_step"))
    # feature j comes from x when its position in the order is < step
    pos = {i: F.array_position(F.col("_ord"), F.lit(i)) - 1 for i in range(p)}
    vals = {c: F.when(pos[i] < F.col("_step"), F.col(f"_x.{c}")).otherwise(F.col(f"_z.{c}"))
            for i, c in enumerate(features)}
    d = d.select(id_col, "_m", "_step", "_ord", *[v.alias(c) for c, v in vals.items()])
    s = _prob(model, d, features, target_class, "_f")
    # contribution of the feature added at step k is f_k - f_(k-1): every evaluation adds
    # +f_k to the feature entering at k and -f_k to the feature entering at k + 1, so a
    # grouped sum gives the differences without a window (partial aggregation combines
    # each row's chain inside the task that generated it)
    step = F.col("_step")
    parts = F.array(
        F.when(step >= 1, F.struct(F.element_at("_ord", F.greatest(step, F.lit(1))).alias("_feat"),
                                   F.col("_f").alias("_v"))),
        F.when(step < p, F.struct(F.element_at("_ord", F.least(step + 1, F.lit(p))).alias("_feat"),
                                  (-F.col("_f")).alias("_v"))))
    terms = s.select(id_col, F.inline(F.filter(parts, lambda x: x.isNotNull())))
    base = s.where(step == 0).groupBy(id_col).agg(F.avg("_f").alias("base"))
    names = F.array(*[F.lit(c) for c in features])
    phi = terms.groupBy(id_col, "_feat").agg((F.sum("_v") / F.lit(float(samples))).alias("phi")).select(
        id_col, F.element_at(names, F.col("_feat") + 1).alias("feature"), "phi")
    return (phi, base) if return_base else phi


MAX_BACKGROUND = 100_000     #: background rows that are held by every task


def _digests(keys: Sequence[bytes], tails: Sequence[bytes]) -> np.ndarray:
    """md5 of every key and tail as two numbers: keys x tails x 2."""
    return np.frombuffer(b"".join([md5(k + t).digest() for k in keys for t in tails]), ">u8").astype(np.uint64).reshape(len(keys), len(tails), 2)


def _row_contributions(cells: Cells, ids: Sequence[str | None], x: np.ndarray, z: np.ndarray, samples: int, seed, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per row the contributions (rows x features) and the mean score of its background draws; ``x``, ``z`` are offsets of cells."""
    keys = [(f"{m}" if i is None else f"{i}|{m}").encode() for i in ids for m in range(samples)]
    h = _digests(keys, [f"-b{seed}".encode(), *[f"-{c}-{seed}".encode() for c in names]])
    drawn = ((h[:, 0, 0] >> np.uint64(16)) % np.uint64(len(z))).astype(np.int64)       # the first 12 hex digits
    order = np.lexsort((h[:, 1:, 1], h[:, 1:, 0]), axis=-1)
    move = np.repeat(x, samples, axis=0) - z[drawn]
    at = z[drawn].sum(axis=1)
    phi = np.zeros((len(keys), len(names)))
    every = np.arange(len(keys))
    base = last = cells.probability[at]
    for step in range(len(names)):
        f = order[:, step]
        at = at + move[every, f]
        score = cells.probability[at]
        phi[every, f] = score - last
        last = score
    return phi.reshape(len(ids), samples, -1).sum(axis=1), base.reshape(len(ids), samples).mean(axis=1)


def _shapley_cells(cells: Cells, df: DataFrame, id_col: str, features: Sequence[str], background: DataFrame, samples: int, seed, return_base: bool):
    drawn = background.orderBy("_bg").select(*[F.col(c).cast("double").alias(c) for c in features]).toPandas()   # MAX_BACKGROUND rows at most
    z = np.stack([cells.of(j, drawn[c].to_numpy(float)) for j, c in enumerate(features)], axis=1)
    rows = df.select(F.col(id_col).alias("_id"), F.col(id_col).cast("string").alias("_text"), *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(features)])
    out = T.StructType([rows.schema["_id"], T.StructField("_base", T.DoubleType()), *[T.StructField(f"_p{j}", T.DoubleType()) for j in range(len(features))]])
    schema, names = to_arrow_schema(out), list(features)
    shared = df.sparkSession.sparkContext.broadcast((cells, z))

    def work(batches):
        cells, z = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                x = np.stack([cells.of(j, part.column(f"_x{j}").to_numpy(zero_copy_only=False).astype(float)) for j in range(len(names))], axis=1)
                phi, base = _row_contributions(cells, part.column("_text").to_pylist(), x, z, samples, seed, names)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(base), *[pa.array(c) for c in phi.T]], schema=schema)
    got = spread(rows).mapInArrow(work, out).groupBy(F.col("_id").alias(id_col)).agg(
        F.avg("_base").alias("base"), *[(F.sum(f"_p{j}") / F.lit(float(samples))).alias(c) for j, c in enumerate(names)])
    phi = got.select(id_col, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("phi")) for c in names])))
    return (phi, got.select(id_col, "base")) if return_base else phi


def mean_abs_ranking(phi: DataFrame) -> DataFrame:
    """Global importance: mean |phi| per feature (p rows; rank when shown)."""
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))


def dependence_table(phi: DataFrame, df: DataFrame, id_col: str, feature: str, q: int = 5) -> DataFrame:
    """Feature value (quantile bin) vs attribution: (qbin, lo, hi, n, mean_phi)."""
    from ..session import materialize
    from .aggregate import qcut
    # the quantiles and the bins read these rows again: the attributions are not computed a second time
    j = materialize(phi.where(F.col("feature") == feature).join(df.select(id_col, feature), id_col), "dependence")
    b, edges = qcut(j, feature, q)
    lo = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("qbin") + 1)
    hi = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("qbin") + 2)
    return b.groupBy("qbin").agg(F.count(F.lit(1)).alias("n"), F.avg("phi").alias("mean_phi")).select(
        "qbin", lo.alias("lo"), hi.alias("hi"), "n", "mean_phi")


def counterfactuals(model, df: DataFrame, id_col: str, features: Sequence[str], allowed: Sequence[str],
                    desired_class: int, k: int = 3, grid: int = 5, refine: int = 9) -> DataFrame:
    """Up to k nearest changes of ``allowed`` columns that make the model predict ``desired_class``.

    Rows that no change on ``grid`` quantiles a column reaches are tried on ``refine`` quantiles; rows that
    are still out of reach have one row whose ``allowed`` values, distance and cf_rank are null.
    Output: id, cf_rank, the full feature values of the counterfactual, distance, n_changed.
    """
    from ..session import materialize
    cells = score_cells(model, len(features), desired_class)
    found = materialize(_proposals(model, df, df, id_col, features, allowed, desired_class, k, grid, cells), "recourse")
    rest = df.join(found.select(id_col).distinct(), id_col, "left_anti")
    if refine > grid and rest.limit(1).count():
        more = materialize(_proposals(model, rest, df, id_col, features, allowed, desired_class, k, refine, cells), "recourse-fine")
        found = found.unionByName(more)
        rest = rest.join(more.select(id_col).distinct(), id_col, "left_anti")
    value = {c: F.col(c).cast("double") for c in features}
    none = rest.select(id_col, *[F.lit(None).cast("double").alias(c) if c in allowed else value[c].alias(c) for c in features],
                       *[value[c].alias(f"_o_{c}") for c in allowed])
    return found.unionByName(none, allowMissingColumns=True)


def _proposals(model, df: DataFrame, population: DataFrame, id_col: str, features: Sequence[str], allowed: Sequence[str],
               desired_class: int, k: int, grid: int, cells: Cells | None = None) -> DataFrame:
    """Reached rows only, with values at ``grid`` quantiles of each column of the population."""
    probs = [i / (grid - 1) for i in range(grid)]
    st = population.agg(*[F.stddev_pop(c).alias(f"s_{c}") for c in allowed]).first()
    cand_vals = {c: sorted({v for v in q if v is not None}) for c, q in quantile_values(population, allowed, probs).items()}
    combos = list(itertools.product(*[cand_vals[c] for c in allowed]))     # grid ** len(allowed), bounded
    if cells and combos:
        best = _nearest_cells(cells, df, id_col, features, allowed, desired_class, k, combos, [(st[f"s_{c}"] or 1.0) or 1.0 for c in allowed])
        w = Window.partitionBy(id_col).orderBy("distance", "n_changed", *allowed)   # k rows per row of an id
        return best.withColumn("cf_rank", F.row_number().over(w)).where(F.col("cf_rank") <= k)
    arr = F.array(*[F.struct(*[F.lit(v).alias(f"_n_{c}") for v, c in zip(combo, allowed)]) for combo in combos])
    d = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in features])
    orig = {c: F.col(c) for c in allowed}
    d = d.select("*", *[orig[c].alias(f"_o_{c}") for c in allowed], F.inline(arr))
    d = d.select(id_col, *[F.col(f"_n_{c}").alias(c) if c in allowed else F.col(c) for c in features],
                 *[F.col(f"_o_{c}") for c in allowed])
    s = _prob(model, d, features, desired_class, "_pd")
    m = model.copy()
    sc = VectorAssembler(inputCols=list(features), outputCol="_fv", handleInvalid="keep").transform(s)
    m.setFeaturesCol("_fv").setPredictionCol("_cls").setProbabilityCol("_pp")
    if hasattr(m, "setRawPredictionCol"):
        m.setRawPredictionCol("_raw")
    sc = m.transform(sc).where(F.col("_cls") == float(desired_class)).drop("_fv", "_pp", "_raw", "_cls")
    dist = sum(F.abs(F.col(c) - F.col(f"_o_{c}")) / F.lit((st[f"s_{c}"] or 1.0) or 1.0) for c in allowed)
    nchg = sum((F.col(c) != F.col(f"_o_{c}")).cast("int") for c in allowed)
    sc = sc.withColumn("distance", dist).withColumn("n_changed", nchg).where(F.col("n_changed") > 0)
    w = Window.partitionBy(id_col).orderBy("distance", "n_changed", *allowed)   # <= len(combos) rows each
    return sc.withColumn("cf_rank", F.row_number().over(w)).where(F.col("cf_rank") <= k).drop("_pd")


def _nearest_cells(cells: Cells, df: DataFrame, id_col: str, features: Sequence[str], allowed: Sequence[str], desired_class: int, k: int,
                   combos: Sequence[tuple], scales: Sequence[float]) -> DataFrame:
    """Per row its best k of ``combos`` that reach the class: id, features, originals, distance, n_changed."""
    features, allowed = list(features), list(allowed)
    rows = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in features], *[F.col(c).cast("double").alias(f"_o_{c}") for c in allowed])
    out = T.StructType([*rows.schema.fields, T.StructField("distance", T.DoubleType()), T.StructField("n_changed", T.IntegerType())])
    schema, new = to_arrow_schema(out), np.array(combos, float)
    move = sum(cells.of(features.index(c), new[:, a]) for a, c in enumerate(allowed))
    by_value = np.lexsort(new.T[::-1])           # ties of a row go to the smaller values
    new, move = new[by_value], move[by_value]
    shared = df.sparkSession.sparkContext.broadcast(cells)

    def work(batches):
        cells = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                old = {c: part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features}
                fixed = sum((cells.of(j, old[c]) for j, c in enumerate(features) if c not in allowed), np.zeros(part.num_rows, np.int64))
                distance, changed = 0, 0
                for a, c in enumerate(allowed):
                    gap = new[None, :, a] - old[c][:, None]
                    distance, changed = distance + np.abs(gap) / scales[a], changed + (gap != 0).astype(np.int32)
                known = np.all([part.column(c).is_valid().to_numpy(zero_copy_only=False) for c in allowed], axis=0)
                fits = (cells.prediction[fixed[:, None] + move] == desired_class) & (changed > 0) & known[:, None]
                row, combo = np.nonzero(fits)
                at = np.lexsort((combo, changed[row, combo], distance[row, combo], row))
                row, combo = row[at], combo[at]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, combo = row[place < k], combo[place < k]
                kept = part.take(pa.array(row))
                columns = [pa.array(new[combo, allowed.index(f.name)]) if f.name in allowed else kept.column(f.name) for f in schema if f.name in part.schema.names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(distance[row, combo]), pa.array(changed[row, combo], pa.int32())], schema=schema)
    return spread(rows).mapInArrow(work, out)


def changed_cells(cf: DataFrame, id_col: str, allowed: Sequence[str], rank_col: str | None = "cf_rank") -> DataFrame:
    """Only the cells a proposal changes: (id, [rank], feature, from_value, to_value).

    ``cf`` holds the proposed values in the column names and the originals in ``_o_<name>``.
    """
    s = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_o_{c}").cast("double").alias("from_value"),
                           F.col(c).cast("double").alias("to_value")) for c in allowed])
    keys = [id_col] + ([rank_col] if rank_col else [])
    return cf.select(*keys, F.inline(s)).where(~F.col("from_value").eqNullSafe(F.col("to_value")))


def scenario_scores(model, scenarios: DataFrame, features: Sequence[str], risk_classes=(3, 4)) -> DataFrame:
    """Score what-if profiles: predicted class, P(class in risk_classes), advice list."""
    from ..functions.expressions import recommendations
    d = VectorAssembler(inputCols=list(features), outputCol="_fv", handleInvalid="keep").transform(scenarios)
    m = model.copy()
    m.setFeaturesCol("_fv").setPredictionCol("_cls").setProbabilityCol("_pp")
    if hasattr(m, "setRawPredictionCol"):
        m.setRawPredictionCol("_raw")
    s = m.transform(d)
    probs = vector_to_array("_pp")
    risk = sum(F.coalesce(probs.getItem(c), F.lit(0.0)) for c in risk_classes)
    s = s.withColumn("risk", risk).withColumn("pred_class", F.col("_cls").cast("int"))
    s = s.withColumn("advice", F.array_join(recommendations("risk", "Absences", "StudyTimeWeekly", "InternetAccess",
                                                            "pred_class"), "; "))
    return s.drop("_fv", "_cls", "_pp", "_raw")


def scenario_grid(df: DataFrame, cols: Sequence[str], fixed: dict | None = None, points: int = 3,
                  values: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """What-if profiles: every combination of the values of ``cols``, with ``fixed`` columns beside them.

    A column's values are those in ``values``, else its observed quantiles (``points`` of them, equal ones once).
    The combinations are generated by one ``explode`` a column, so only the value lists are on the driver.
    """
    values = dict(values or {})
    probs = [i / (points - 1) for i in range(points)] if points > 1 else [0.5]
    rest = [c for c in cols if c not in values]
    if rest:
        values |= {c: sorted({x for x in q if x is not None}) for c, q in quantile_values(df, rest, probs).items()}
    out = df.sparkSession.range(1).select(*[F.lit(float(v)).alias(c) for c, v in (fixed or {}).items()])
    for c in cols:
        out = out.select("*", F.explode(F.array(*[F.lit(float(v)) for v in values[c]]).cast("array<double>")).alias(c))
    return out.select(*cols, *(fixed or {}))


__all__ = ["shapley_values", "mean_abs_ranking", "dependence_table", "counterfactuals", "changed_cells",
           "scenario_scores", "scenario_grid", "background_sample", "array_to_vector"]
