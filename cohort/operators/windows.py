"""Skew-safe ordered windows.

A ``Window.partitionBy(key).orderBy(..)`` puts every row of one key into one task, and a
window without ``partitionBy`` puts the whole table into one task. Both break when one
key holds a third of the rows. The helpers here split each key into ordered *chunks*
(a range of the order column), run the window inside (key, chunk), and add the totals of
the earlier chunks of the same key, taken from a small (key, chunk) table. Each task then
sees at most about rows / chunks rows of a hot key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MD5_CHUNK_DIGITS, RANGE_CHUNKS

# Largest row bound for which an explicit broadcast hint is given.
BROADCAST_ROWS = 2_000_000


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               known_rows: int | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a side that is usually small.

    A broadcast hint is added only when the caller passes ``known_rows``, a bound that
    holds by construction (e.g. k classes, 9 offsets, <= chunks x groups rows with a
    known group count) and is below ``max_rows``. Otherwise the join is planned normally
    and AQE checks the real size at runtime: it turns the sort-merge join into a
    broadcast join only when the materialised side is under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``, and keeps the shuffle join beyond.
    No extra job is spent counting the small side.
    """
    if known_rows is not None and known_rows <= max_rows:
        small = F.broadcast(small)
    return big.join(small, on=on, how=how)


def md5_order(key: Column, seed) -> Column:
    """Deterministic pseudo-random order key: md5(key || '-' || seed) (same text in DuckDB)."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def md5_chunk(order_key: Column, digits: int | None = None) -> Column:
    """Chunk of an md5 order key: its first hex digits (16**digits ordered chunks)."""
    return F.substring(order_key, 1, digits or MD5_CHUNK_DIGITS)


def md5_chunks(digits: int | None = None) -> int:
    return 16 ** (digits or MD5_CHUNK_DIGITS)


def range_edges(df: DataFrame, col: str, n: int | None = None, rel_err: float = 0.001, extra: dict | None = None):
    """Approximate n-quantile edges of ``col`` (one sketch aggregate, n numbers to the driver).

    ``extra`` = {name: aggregate Column} is computed in the same pass; then the result is
    (edges, {name: value}).
    """
    n = n or RANGE_CHUNKS
    probs = [i / n for i in range(1, n)]
    accuracy = int(1 / min(rel_err, 0.25 / n)) + 1
    aggs = [F.percentile_approx(F.col(col), probs, accuracy).alias("_edges")]
    aggs += [e.alias(k) for k, e in (extra or {}).items()]
    row = df.agg(*aggs).first()
    edges = sorted(set(e for e in (row["_edges"] or []) if e is not None))
    if extra is None:
        return edges
    return edges, {k: row[k] for k in extra}


def _count_le(c: Column, edges: Sequence, lo: int, hi: int) -> Column:
    """Number of edges <= c, knowing edges[:lo] <= c < edges[hi:]: a balanced CASE tree,
    so a row costs log2(len(edges)) comparisons."""
    if hi - lo <= 4:
        return sum((c >= F.lit(e)).cast("int") for e in edges[lo:hi]) + F.lit(lo) if hi > lo else F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(c >= F.lit(edges[mid]), _count_le(c, edges, mid + 1, hi)).otherwise(_count_le(c, edges, lo, mid))


def range_chunk(col, edges: Sequence) -> Column:
    """Ordered chunk number = count of edges <= value (null -> 0)."""
    c = F.col(col) if isinstance(col, str) else col
    if not edges:
        return F.lit(0)
    return F.coalesce(_count_le(c, list(edges), 0, len(edges)), F.lit(0))


def chunked_running(df: DataFrame, by: Sequence[str], order: Sequence[Column], chunk: Column,
                    sums: Mapping[str, Column], exclusive: bool = False,
                    n_chunks: int | None = None, totals: bool = False) -> DataFrame:
    """Add running sums ``sums`` per ``by`` in ``order`` (inclusive, or exclusive of the row).

    ``chunk`` must be monotone in ``order`` inside each ``by`` group. Without ``by`` the
    offset table has at most ``n_chunks`` rows, a bound by construction, so it is broadcast.
    ``totals`` also adds ``<name>_total``, the sum over the whole ``by`` group, taken from the
    same small table (no extra pass over the rows).
    """
    by = list(by)
    d = df.withColumn("_chunk", chunk)
    tot = d.groupBy(*by, "_chunk").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    w_off = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*by)
    off = tot.select(*by, "_chunk", *[F.coalesce(F.sum(f"_t_{k}").over(w_off), F.lit(0)).alias(f"_o_{k}")
                                      for k in sums],
                     *([F.sum(f"_t_{k}").over(w_all).alias(f"{k}_total") for k in sums] if totals else []))
    upper = -1 if exclusive else Window.currentRow
    w_in = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, upper)
    d = d.withColumns({f"_r_{k}": F.coalesce(F.sum(v).over(w_in), F.lit(0)) for k, v in sums.items()})
    d = join_small(d, off, on=[*by, "_chunk"], how="inner", known_rows=None if by else n_chunks)
    return d.withColumns({k: F.col(f"_r_{k}") + F.col(f"_o_{k}") for k in sums}).drop(
        "_chunk", *[f"_r_{k}" for k in sums], *[f"_o_{k}" for k in sums])


def chunked_row_number(df: DataFrame, by: Sequence[str], order_key: Column, name: str = "rn",
                       digits: int | None = None) -> DataFrame:
    """row_number() over (partition by ``by`` order by ``order_key``) for an md5 text key,
    chunked by the key's leading hex digits."""
    d = df.withColumn("_ok", order_key)
    out = chunked_running(d, by, [F.col("_ok")], md5_chunk(F.col("_ok"), digits), {name: F.lit(1)},
                          n_chunks=md5_chunks(digits))
    return out.drop("_ok")


def group_sizes(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    """Join each row with its group's size via a grouped aggregate (no window over the group)."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    return join_small(df, sizes, on=list(by))
