"""Mixing sources to target weights (operator 2).

Targets: the corpus size is shared among the sources by weight, no source gets more than
``max_epochs`` times its own size, and what a source cannot take is shared again by weight
among the others until none is above. That fixed point is found in closed form: sources
are ordered by ``cap / weight``; a prefix of them is capped, the rest share what is left.

Selection (Efraimidis and Spirakis): each document draws ``-ln(u) / quality`` from a hash of
its id; within a source the smallest keys come first. ``floor(target / size)`` complete epochs
are taken of every document, then the documents in key order until the rest of the budget is
used; the last one is taken in part, so a source misses its target by less than one word.

Columns only. A source may hold a third of all rows, so its keys are not sorted in one task:
keys fall into ``bins`` ordered bins, bin sums (one row per source and bin) give the bin where
the budget ends, and only the rows of that bin are sorted.

Edge cases: null and empty texts have size 0 and are never taken; a null source is a source of
its own, last in order; a repeated row is one more document (rows equal in id and text are
ordered arbitrarily, which changes no result set); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_bounded, words

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BINS = 4096


def letter_share(text: Column) -> Column:
    """Quality weight of a document: 0.1 plus the share of its characters that are not ASCII
    digits, punctuation, spaces or controls."""
    full = F.coalesce(text, F.lit(""))
    letters = F.length(F.regexp_replace(full, r"[\x00-@\[-`{-\x7F]+", ""))
    return F.lit(0.1) + letters.cast("double") / F.greatest(F.lit(1), F.length(full))


def draw(id_col: Column, seed: int) -> Column:
    """Uniform number in (0, 1), the same in every run: 52 bits of an md5 of the id."""
    text = F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(f"-{seed}"))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / F.lit(float(2 ** 52))


def source_targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: ``_source, source_size, _weight, target`` (``_size`` summed per ``_source``)."""
    per = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    # the windows below run over one row per source
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(int(w)).cast("bigint") for w in weights]), F.pmod(rank, F.lit(len(weights))))
    per = per.select("*", weight.alias("_weight")).select("*", (F.col("source_size") * max_epochs).alias("_cap"))
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    upto, every = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    # if this source and all before it are capped, so much is left for so much weight
    per = per.select("*", (F.sum("source_size").over(every) - F.sum("_cap").over(upto)).alias("_left"),
                     (F.sum("_weight").over(every) - F.sum("_weight").over(upto)).alias("_open"))
    before = per.select("*", (F.col("_left") + F.col("_cap")).alias("_had"),
                        (F.col("_open") + F.col("_weight")).alias("_over"))
    capped = F.col("_cap") * F.col("_over") < F.col("_had") * F.col("_weight")
    before = before.select("*", capped.alias("_capped"))
    shared = F.min(F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_source").isNull(), "_source",
                                                     F.col("_had").alias("had"), F.col("_over").alias("over")))).over(every)
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(
        (F.col("_weight") * F.col("_s.had")).cast("double") / F.col("_s.over"))
    return before.select("*", shared.alias("_s")).select("_source", "source_size", "_weight", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        quality=letter_share, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 42,
        bins: int = BINS, carry: bool = False) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per row; with ``carry`` the input row too, in ``_row``."""
    keep = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    text = F.col(text_col)
    key = -F.log(draw(F.col(id_col), seed)) / quality(text)
    df = docs.select(*keep, F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                     F.size(words(text)).cast("bigint").alias("_size"), key.alias("_key"))
    # keys are positive; 1 - exp(-key) spreads them over (0, 1) in the same order
    df = df.select("*", F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * bins).cast("int").alias("_bin"))
    # texts are scanned once: everything below reads this table
    scratch = Scratch(docs.sparkSession, "mixing")
    df = scratch.write(df, "keyed")
    slim = df.select("_source", "_size", "_bin")
    binned = slim.groupBy("_source", "_bin").agg(F.sum("_size").alias("_size"))
    targets = source_targets(binned, weights, max_epochs)
    n_sources = df.select("_source").distinct().count()
    epochs = F.least(F.lit(max_epochs), F.floor(F.col("target") / F.greatest(F.lit(1), F.col("source_size"))).cast("int"))
    targets = targets.select("*", epochs.alias("_epochs")).select(
        "*", F.greatest(F.lit(0), F.round(F.col("target") - F.col("_epochs") * F.col("source_size"))
                        .cast("bigint")).alias("_rest")).withColumnRenamed("_source", "_src")
    # the bin in which the rest of the budget ends, and what the bins before it hold
    run = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    cum = binned.select("_source", "_bin", "_size", F.coalesce(F.sum("_size").over(run), F.lit(0)).alias("_before"))
    edge = (cum.join(targets, F.col("_source").eqNullSafe(F.col("_src")))
            .where("_before < _rest and _before + _size >= _rest")
            .select(F.col("_src").alias("_esrc"), F.col("_bin").alias("_edge"), F.col("_before").alias("_base")))
    plan = targets.join(edge, F.col("_src").eqNullSafe(F.col("_esrc")), "left").drop("_esrc")
    df = join_bounded(df, plan, F.col("_source").eqNullSafe(F.col("_src")), "inner", n_sources)
    # no edge: no rest to share, or the whole source is needed
    at = F.when(F.col("_edge").isNull(), F.lit(-1)).otherwise(F.col("_edge"))
    df = df.select(*["_row"] * carry, "_id", "_source", "_size", "_key", "_bin", "source_size", "target", "_epochs",
                   "_rest", "_base", at.alias("_at"))
    plain = df.where("_bin <> _at").select(
        *["_row"] * carry, "_id", "_size", "source_size", "target", "_epochs",
        F.when(F.col("_bin") < F.col("_at"), F.col("_size")).otherwise(F.lit(0)).alias("_part"))
    inside = Window.partitionBy("_source", "_bin").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    tail = df.where("_bin = _at").select("*", (F.col("_base") + F.coalesce(F.sum("_size").over(inside), F.lit(0))).alias("_ahead"))
    tail = tail.select(*["_row"] * carry, "_id", "_size", "source_size", "target", "_epochs",
                       F.least(F.col("_size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_ahead"))).alias("_part"))
    out = plain.unionByName(tail)
    return out.select(*["_row"] * carry, F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target",
                      (F.col("_epochs") * F.col("_size") + F.col("_part")).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The input rows the mix takes, with ``taken`` words each (over ``size``: repeated epochs)."""
    out = mix(docs, carry=True, **options).where("taken > 0")
    clash = {"size", "taken", "target", "source_size"} & set(docs.columns)
    rows = F.col("_row").dropFields(*clash) if clash else F.col("_row")
    return out.select(rows.alias("_row"), "size", "source_size", "target", "taken").select(
        "_row.*", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '-42'), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
           / (0.1 + length(regexp_replace(coalesce(text, ''), '[\x00-@\[-`{-\x7F]+', '', 'g'))::DOUBLE / greatest(1, length(coalesce(text, '')))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0) AS had,
             sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open_w
      FROM s WINDOW o AS (ORDER BY 3 * source_size / w::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, cap * open_w < had * w AS capped FROM c),
f AS (SELECT had AS h, open_w AS q FROM e WHERE NOT capped ORDER BY cap / w::DOUBLE, source ASC NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE CAST(w * h AS DOUBLE) / q END AS target
      FROM e LEFT JOIN f ON true),
r AS (SELECT *, least(3, CAST(floor(target / greatest(1, source_size)) AS BIGINT)) AS ep FROM t),
x AS (SELECT d.*, r.source_size, r.target, r.ep, greatest(0, CAST(round(r.target - r.ep * r.source_size) AS BIGINT)) AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(ep * size + least(size, greatest(0, rest - ahead)) AS BIGINT) AS taken FROM x
"""
