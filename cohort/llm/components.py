"""Connected components of a link table by alternating large-star and small-star steps.

Kiveris et al.'s MapReduce scheme: each step replaces links by links to the smallest
neighbour, until every node points to the smallest id of its component. Links of a hub are
reduced by an aggregate with map-side combine and joined back, never gathered. Each round is
written to the shared folder; the round before is deleted.

Before the rounds every task joins the links it reads by union-find and passes on a link to the
smallest id for each of its nodes, which keeps the components and costs no exchange. A task reads
about ``LINKS_PER_TASK`` links; if there are no more, that one pass is the result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


LINKS_PER_TASK = 50_000


def _contract(links: DataFrame, links_per_task: int) -> DataFrame:
    """Links ``u, v`` of the same components: in each task every node points to the smallest one the task's links join it to.

    A task that meets more than two nodes per link of its share passes on what it has and starts anew."""
    def stars(root: dict[int, int], find) -> pa.RecordBatch:
        lower = [(x, up) for x in list(root) if (up := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in lower], pa.int64()), pa.array([up for _, up in lower], pa.int64())], ["u", "v"])

    def work(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x
        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                p, q = find(u), find(v)
                if p != q:
                    root[max(p, q)] = min(p, q)
            if len(root) > 2 * links_per_task:
                yield stars(root, find)
                root.clear()
        yield stars(root, find)
    return links.mapInArrow(work, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))       # u > v in every link
    up = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return up.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch, max_rounds: int = 60, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """``node, component`` for every node that is not the smallest of its component. ``links`` has ``u, v``."""
    links = links.where("u <> v").select("u", "v")
    tasks = max(1, -(-links.count() // links_per_task))
    alone = tasks == 1
    edges = _contract(links.coalesce(tasks), links_per_task)
    edges = scratch.write(edges if alone else edges.distinct(), "links")

    def result() -> DataFrame:
        out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        out._scratch_path = edges._scratch_path
        return out
    if alone:
        return result()
    seen = None
    for _ in range(max_rounds):
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or state[0] == 0:
            return result()
        seen = state
        new = scratch.write(_small_star(_large_star(edges)), "links")
        scratch.drop(edges)
        edges = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
