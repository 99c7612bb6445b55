"""Sequential shadow-feature selection (Boruta-style) with MLlib random forests.

Each round adds a shadow copy of every feature that is still in play, permuted on its own, fits a forest with
balanced class weights, and counts a *hit* for every real feature whose importance beats the best
shadow. After each round a one-sided binomial test in either direction (p = 0.5, Bonferroni over the
features) settles features: a rejected one leaves the forest, a confirmed one stays in it, and the rounds
end when none is undecided, or after ``rounds``, when the rest is tentative.

Permutations come from one table, ranked once by a seeded md5 of the row id: in that random order, the shadow of the
row at rank k is the value at rank k + offset (mod n), with an offset drawn per round and feature. The ranked rows are
written once in blocks of ``BLOCK`` consecutive ranks. A shadow so takes runs of values of two or three blocks, and a round
costs one exchange of blocks and runs, no row of its own per shadow value; its rows are kept until its forest is grown.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .models import balanced_weights
from .windows import chunked_running, md5_chunk, md5_chunks, md5_order

BLOCK = 4096    #: consecutive ranks that move together


def _binom_sf(k: int, n: int) -> float:
    """P(X >= k) for X ~ Binomial(n, 1/2)."""
    return sum(math.comb(n, i) for i in range(k, n + 1)) / 2 ** n


def ranked_rows(df: DataFrame, id_col: str, seed) -> DataFrame:
    """The rows with ``_rank``, their dense rank (from 0) in the order of a seeded md5 of the id."""
    d = df.withColumn("_k", md5_order(F.col(id_col), f"shadow-{seed}"))
    d = chunked_running(d, [], [F.col("_k")], md5_chunk(F.col("_k")), {"_rank": F.lit(1)}, n_chunks=md5_chunks())
    return d.withColumn("_rank", (F.col("_rank") - 1).cast("bigint")).drop("_k")


def _offset(seed, round_: int, feature: str, n: int) -> int:
    """Between 1 and n - 1 (0 for a single row)."""
    return 1 + int(hashlib.md5(f"{seed}-{round_}-{feature}".encode()).hexdigest()[:15], 16) % (n - 1) if n > 1 else 0


def _blocks(ranked: DataFrame) -> DataFrame:
    """``_block`` and an array of each column: the rows of ``BLOCK`` consecutive ranks, in their order."""
    rows = ranked.groupBy(F.floor(F.col("_rank") / BLOCK).alias("_block")).agg(F.array_sort(F.collect_list(F.struct(
        "_rank", *[c for c in ranked.columns if c != "_rank"]))).alias("_rows"))
    return rows.select("_block", *[F.col("_rows")[c].alias(c) for c in ranked.columns])


def _pieces(features: Sequence[str], offsets: Sequence[int], n: int, block: int):
    """Blocks to rows (_block, _c, _at, _v): the runs of each feature's values that one block's shadows take, from place ``_at`` on."""
    def work(batches):
        for batch in batches:
            to, number, at, runs = [], [], [], []
            for row, b in enumerate(batch.column("_block").to_pylist()):
                for i, c in enumerate(features):
                    values, done = batch.column(c)[row].values, 0
                    while done < len(values):
                        rank = (b * block + done - offsets[i]) % n
                        size = min(len(values) - done, block - rank % block, n - rank)
                        to.append(rank // block)
                        number.append(i)
                        at.append(rank % block)
                        runs.append(values.slice(done, size))
                        done += size
            if runs:
                ends = np.cumsum([0, *map(len, runs)])
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(number, pa.int32()), pa.array(at, pa.int32()), pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.concat_arrays(runs))], ["_block", "_c", "_at", "_v"])
    return work


def _with_pieces(columns: Sequence[str], features: Sequence[str]):
    """A block's rows and the runs sent to it, as rows with a ``shadow_`` column per feature."""
    def work(block: pa.Table, sent: pa.Table) -> pa.Table:
        own = [block.column(c).combine_chunks().flatten() for c in columns]
        size, shadows = len(own[0]), []
        runs: list[list] = [[] for _ in features]
        for i, at, v in zip(sent.column("_c").to_pylist(), sent.column("_at").to_pylist(), (v for c in sent.column("_v").chunks for v in c)):
            runs[i].append((at, v.values))
        for found in runs:
            parts, end = [], 0
            for at, values in sorted(found, key=lambda x: x[0]):
                parts += [pa.nulls(at - end, pa.float64()), values]
                end = at + len(values)
            shadows.append(pa.concat_arrays([*parts, pa.nulls(max(0, size - end), pa.float64())]).slice(0, size))
        return pa.table([*own, *shadows], [*columns, *[f"shadow_{c}" for c in features]])
    return work


def _shadows(blocks: DataFrame, features: Sequence[str], n: int, seed, round_: int) -> DataFrame:
    """The ranked rows of the blocks with a ``shadow_`` column per feature: each a permutation of the feature's values."""
    columns = [c for c in blocks.columns if c != "_block"]
    offsets = [_offset(seed, round_, c, n) for c in features]
    sent = blocks.select("_block", *[F.col(c).cast("array<double>").alias(c) for c in features]).mapInArrow(
        _pieces(features, offsets, n, BLOCK), "_block long, _c int, _at int, _v array<double>")
    schema = T.StructType([T.StructField(c, blocks.schema[c].dataType.elementType) for c in columns] + [T.StructField(f"shadow_{c}", T.DoubleType()) for c in features])
    return blocks.groupBy("_block").cogroup(sent.groupBy("_block")).applyInArrow(_with_pieces(columns, features), schema)


def shadow_rows(df: DataFrame, id_col: str, features: Sequence[str], seed) -> DataFrame:
    """The rows with a ``shadow_`` column per feature, each permuted on its own."""
    return _shadows(_blocks(ranked_rows(df, id_col, seed)), features, df.count(), seed, 0).drop("_rank")


def decide(hits: int, rounds: int, alpha: float) -> str:
    """Binomial test of the hits at level ``alpha``."""
    if _binom_sf(hits, rounds) < alpha:
        return "confirmed"
    return "rejected" if _binom_sf(rounds - hits, rounds) < alpha else "tentative"


def boruta(df: DataFrame, id_col: str, label: str, features: Sequence[str], rounds: int = 100, trees: int = 100,
           alpha: float = 0.05, seed: int = 42) -> list[tuple]:
    """Rows (feature, hits, rounds, decision); ``rounds`` of a row are those the feature took part in until it was
    settled. Too few rounds to decide at ``alpha`` are refused."""
    feats = list(features)
    level = alpha / len(feats)
    if 0.5 ** rounds >= level:
        raise ValueError(f"{rounds} rounds can neither confirm nor reject {len(feats)} features at {alpha}")
    d = balanced_weights(df.select(id_col, label, *feats), label, "_weight").withColumn(label, F.col(label).cast("double"))
    d = materialize(_blocks(ranked_rows(d, id_col, seed).drop(id_col)), "shadow")
    n = d.agg(F.coalesce(F.sum(F.size("_rank")), F.lit(0))).first()[0]
    hits, state = dict.fromkeys(feats, 0), {}
    for r in range(rounds):
        active = [c for c in feats if state.get(c, ("",))[0] != "rejected"]
        cols = active + [f"shadow_{c}" for c in active]
        v = VectorAssembler(inputCols=cols, outputCol="_fv", handleInvalid="keep").transform(_shadows(d, active, n, seed, r))
        rf = RandomForestClassifier(featuresCol="_fv", labelCol=label, weightCol="_weight", numTrees=trees, seed=seed + r)
        v = v.select("_fv", label, "_weight").persist(StorageLevel.MEMORY_AND_DISK)      # a fit passes over its rows more than once
        try:
            imp = rf.fit(v).featureImportances.toArray()
        finally:
            v.unpersist()
        best = max(imp[len(active):])
        for i, c in enumerate(active):
            if c not in state:
                hits[c] += int(imp[i] > best)
                if (said := decide(hits[c], r + 1, level)) != "tentative":
                    state[c] = (said, r + 1)
        if len(state) == len(feats):
            break
    return [(c, hits[c], *reversed(state.get(c, ("tentative", rounds)))) for c in feats]


def boruta_frame(df: DataFrame, id_col: str, label: str, features: Sequence[str], **kw) -> DataFrame:
    return df.sparkSession.createDataFrame(boruta(df, id_col, label, features, **kw),
                                           "feature string, hits int, rounds int, decision string")
