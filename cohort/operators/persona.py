"""Behaviour maps and personas: minority-class oversampling, 2-D embedding, grid-density
clusters with noise, silhouette.

* Oversampling (replaces the GAN): each minority row is paired with its neighbour along a
  seeded random projection of the standardised features (the next row in that order,
  ranked inside projection-range chunks) and a synthetic row is interpolated between them;
  nominal columns are copied from the base row. No pairs beyond one per row are formed.
* Clusters (replaces HDBSCAN): points fall into eps-cells of the embedding; a cell is dense
  when its 3x3 neighbourhood holds >= min_samples points; dense cells connected through
  neighbours form clusters (min-label propagation over the *cell* table until stable);
  points in non-dense cells next to a dense cell join it, the rest and clusters smaller
  than min_cluster_size are noise (-1).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Sequence

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import chunked_running, join_small, range_chunk, range_edges


def _unit(seed, name) -> float:
    return int(hashlib.md5(f"{seed}-{name}".encode()).hexdigest()[:12], 16) / float(16 ** 12) * 2 - 1


def oversample_minority(df: DataFrame, id_col: str, label: str, minority, numeric: Sequence[str],
                        nominal: Sequence[str] = (), seed: int = 42, chunks: int | None = None) -> DataFrame:
    """Return the input plus one synthetic row per minority row (so that class is doubled).

    Synthetic ids are negative (-(id) - 1) so they never collide with real ids.
    """
    mino = df.where(F.col(label) == F.lit(minority))
    st = mino.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(numeric)],
                  *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(numeric)]).first()
    proj = sum(F.lit(_unit(seed, c)) * (F.col(c) - F.lit(st[f"m{i}"] or 0.0)) / F.lit((st[f"s{i}"] or 1.0) or 1.0)
               for i, c in enumerate(numeric))
    m = mino.withColumn("_proj", proj)
    edges = range_edges(m, "_proj", chunks)
    m = m.withColumn("_c", range_chunk("_proj", edges))
    w = Window.partitionBy("_c").orderBy("_proj", id_col)
    nb = F.coalesce(F.lead(F.struct(*[F.col(c).alias(c) for c in numeric]), 1).over(w),
                    F.lag(F.struct(*[F.col(c).alias(c) for c in numeric]), 1).over(w))
    m = m.withColumn("_nb", nb)
    u = F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-gap-{seed}"))), 1, 12), 16, 10) \
        .cast("double") / F.lit(float(16 ** 12))
    synth_cols = {c: F.coalesce(F.col(c) + u * (F.col(f"_nb.{c}") - F.col(c)), F.col(c)).cast(df.schema[c].dataType)
                  for c in numeric}
    synth = m.withColumns(synth_cols).withColumn(id_col, -F.col(id_col) - 1).drop("_proj", "_c", "_nb")
    return df.unionByName(synth.select(*df.columns))


def embed_2d(df: DataFrame, cols: Sequence[str], names=("embed_1", "embed_2")) -> DataFrame:
    """Standardise and project on the first two principal components (replaces UMAP).

    Rows with a null or NaN in ``cols`` stay, with a null embedding.
    """
    full = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols])
    full = F.coalesce(full, F.lit(False))
    rest = df.where(~full).select("*", *[F.lit(None).cast("double").alias(n) for n in names])
    va = VectorAssembler(inputCols=list(cols), outputCol="_v")
    d = va.transform(df.where(full))
    sc = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(d)
    d = sc.transform(d)
    pca = PCA(k=2, inputCol="_s", outputCol="_pc").fit(d)
    arr = vector_to_array("_pc")
    return pca.transform(d).withColumn(names[0], arr[0]).withColumn(names[1], arr[1]).drop("_v", "_s", "_pc").unionByName(rest)


_NEIGHBOURS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]


def grid_density_clusters(df: DataFrame, x: str, y: str, eps: float, min_samples: int = 10,
                          min_cluster_size: int = 50, name: str = "cluster") -> DataFrame:
    """Cluster label per row (-1 = noise, also rows without a place); see the module note."""
    from ..session import materialize
    d = df.withColumn("_cx", F.floor(F.col(x) / eps).cast("long")).withColumn("_cy", F.floor(F.col(y) / eps).cast("long"))
    cells = d.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"))
    offs = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in _NEIGHBOURS])
    spread = cells.select("_cx", "_cy", "_n", F.inline(offs)).select(
        (F.col("_cx") + F.col("dx")).alias("_cx"), (F.col("_cy") + F.col("dy")).alias("_cy"), "_n")
    dens = spread.groupBy("_cx", "_cy").agg(F.sum("_n").alias("_hood"))
    cells = cells.join(dens, ["_cx", "_cy"]).withColumn("_core", F.col("_hood") >= min_samples)
    cid = F.col("_cx") * F.lit(2 ** 31) + F.col("_cy")
    core = cells.where("_core").select("_cx", "_cy", cid.alias("_id"), cid.alias("_lab"))
    core = materialize(core, "cells")
    while True:     # labels only fall, so this ends
        # 1) take the smallest label among the 3x3 neighbours
        nb = core.select("_lab", F.inline(offs), "_cx", "_cy").select(
            (F.col("_cx") + F.col("dx")).alias("_cx"), (F.col("_cy") + F.col("dy")).alias("_cy"), "_lab")
        best = nb.groupBy("_cx", "_cy").agg(F.min("_lab").alias("_m"))
        new = core.join(best, ["_cx", "_cy"], "left").select(
            "_cx", "_cy", "_id", F.least("_lab", F.coalesce("_m", "_lab")).alias("_lab"))
        # 2) pointer jump: adopt the label of the cell named by the label (halves path lengths)
        hop = new.select(F.col("_id").alias("_lab"), F.col("_lab").alias("_lab2"))
        new = new.join(hop, "_lab", "left").select(
            "_cx", "_cy", "_id", F.least("_lab", F.coalesce("_lab2", "_lab")).alias("_lab"))
        new = materialize(new, "cells")
        changed = new.join(core.select("_id", F.col("_lab").alias("_old")), "_id").where(
            F.col("_lab") != F.col("_old")).limit(1).count()
        core = new
        if changed == 0:
            break
    core = core.drop("_id")
    # border cells take the smallest label of an adjacent core cell
    nb = core.select("_cx", "_cy", "_lab", F.inline(offs)).select(
        (F.col("_cx") + F.col("dx")).alias("_cx"), (F.col("_cy") + F.col("dy")).alias("_cy"), "_lab")
    border = nb.groupBy("_cx", "_cy").agg(F.min("_lab").alias("_blab"))
    lab = cells.select("_cx", "_cy", "_n").join(core, ["_cx", "_cy"], "left").join(border, ["_cx", "_cy"], "left") \
        .select("_cx", "_cy", "_n", F.coalesce("_lab", "_blab").alias("_lab"))
    sizes = lab.where(F.col("_lab").isNotNull()).groupBy("_lab").agg(F.sum("_n").alias("_size"))
    lab = lab.join(sizes, "_lab", "left").withColumn(
        "_lab", F.when(F.col("_size") >= min_cluster_size, F.col("_lab")))
    ids = lab.where(F.col("_lab").isNotNull()).select("_lab").distinct()
    ids = ids.withColumn("_id", (F.dense_rank().over(Window.orderBy("_lab")) - 1).cast("int"))   # one row per cluster
    lab = lab.join(ids, "_lab", "left").select("_cx", "_cy", F.coalesce("_id", F.lit(-1)).alias(name))
    return join_small(d, lab, ["_cx", "_cy"], "left").drop("_cx", "_cy").withColumn(name, F.coalesce(name, F.lit(-1)))


def silhouette(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> float | None:
    """Silhouette (squared Euclidean, MLlib) over non-noise rows; None with fewer than two clusters."""
    if df.where(F.col(cluster) >= 0).select(cluster).distinct().limit(2).count() < 2:
        return None
    d = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(df.where(F.col(cluster) >= 0))
    ev = ClusteringEvaluator(featuresCol="_v", predictionCol=cluster, metricName="silhouette",
                             distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(d.withColumn(cluster, F.col(cluster).cast("double"))))


__all__ = ["oversample_minority", "embed_2d", "grid_density_clusters", "silhouette", "chunked_running"]
