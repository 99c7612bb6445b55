"""Line dedup by winnowing (operator 7).

A run of consecutive lines (blank lines do not count) of at least ``min_words`` words that
also occurs at an earlier position, by document id and then by line, is deleted; the first
occurrence stays. Shorter runs, however frequent, stay.

Windows are the shortest stretches of lines with ``min_words`` words that start at a line, and
those that end at a line. The line with the smallest hash of a window is its fingerprint, so
two equal runs always select the same lines. A fingerprint is matched together with its
extension: the lines of the window left and right of it, each side as a hash. Every line of a
repeated run lies in such a window of the run (let x be the line: the window from x fits in
the run, or the one up to x does, or the one from the run's first line reaches past x), so the
union of matched windows is the union of all repeated runs, whatever their length.

Columns only. The first position of a fingerprint is an aggregate with map-side combine, so a
line that a third of all documents share costs one row per task; matches go back to positions
by a join with one row per fingerprint, whose hot keys AQE can split. No pairs are formed.

Edge cases: a null text has no line and yields an empty kept text; rows equal in id and text
are one document and get the same result; two texts under one id are ordered by their hash;
null ids come last; line ends other than ``\\n`` are part of the line; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, keep_where, words

MIN_WORDS = 5


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _th, pos, h1, h2, nw, start``: lines that hold a word, their 128-bit hash, words, and words before."""
    text = F.col(text_col)
    df = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    df = df.select("_id", "_th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
                   F.size(words(F.col("line"))).alias("nw")).where("nw > 0")
    df = df.repartition("_id", "_th").distinct()     # rows equal in id and text count once
    before = Window.partitionBy("_id", "_th").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return df.select("*", F.coalesce(F.sum("nw").over(before), F.lit(0)).alias("start"))


def fingerprints(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``_id, _th, a, b, p, k1, k2``: windows of lines a..b, the fingerprint's line p, and its hash with both extensions."""
    doc = Window.partitionBy("_id", "_th")
    ahead = doc.orderBy("start").rangeBetween(0, min_words - 1)
    behind = doc.orderBy("end").rangeBetween(-(min_words - 1), 0)

    def window(frame):
        return F.struct(F.sum("nw").over(frame).alias("n"), F.min("pos").over(frame).alias("a"), F.max("pos").over(frame).alias("b"),
                        F.min(F.struct("h1", "h2", "pos")).over(frame).alias("least"),
                        F.collect_list(F.struct("pos", "h1", "h2")).over(frame).alias("run"))

    df = lines.select("*", (F.col("start") + F.col("nw")).alias("end"))
    df = df.select("_id", "_th", window(ahead).alias("_f"), window(behind).alias("_b"))
    both = F.when((F.col("_f.a") == F.col("_b.a")) & (F.col("_f.b") == F.col("_b.b")), F.array("_f")).otherwise(F.array("_f", "_b"))
    df = df.select("_id", "_th", F.explode(both).alias("w")).where(F.col("w.n") >= min_words)
    left = F.filter("w.run", lambda x: x["pos"] < F.col("w.least.pos"))
    right = F.filter("w.run", lambda x: x["pos"] > F.col("w.least.pos"))
    h1 = lambda side: F.xxhash64(F.transform(side, lambda x: x["h1"]))
    h2 = lambda side: F.xxhash64(F.transform(side, lambda x: x["h2"]))
    # a window that is a line keeps the line's own hash
    alone = F.size("w.run") == 1
    k1 = F.when(alone, F.col("w.least.h1")).otherwise(F.xxhash64(F.col("w.least.h1"), h1(left), h1(right)))
    k2 = F.when(alone, F.col("w.least.h2")).otherwise(F.xxhash64(F.col("w.least.h2"), h2(left), h2(right)))
    return df.select("_id", "_th", F.col("w.a").alias("a"), F.col("w.b").alias("b"), F.col("w.least.pos").alias("p"),
                     k1.alias("k1"), k2.alias("k2"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _th, a, b``: windows of lines that occur at an earlier position too."""
    prints = fingerprints(line_rows(docs, id_col, text_col), min_words)
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_th").alias("t"), F.col("p").alias("p"))
    first = prints.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    return prints.join(first, ["k1", "k2"]).where(place != F.col("first")).select("_id", "_th", "a", "b")


def kept_pieces(runs: DataFrame) -> DataFrame:
    """Per document the pieces of lines between deleted runs, the end of the last run, and the number of deleted lines."""
    before = Window.partitionBy("_id", "_th").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    df = runs.distinct().select("*", F.coalesce(F.max("b").over(before), F.lit(-1)).alias("upto"))
    piece = F.when(F.col("a") > F.col("upto") + 1, F.struct((F.col("upto") + 1).alias("s"), (F.col("a") - F.col("upto") - 1).alias("n")))
    gone = F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("upto"), F.col("a") - 1))
    return df.groupBy("_id", "_th").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.max("b").alias("last"),
                                        F.sum(gone).alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row`` (the input row), ``n_lines``, ``n_removed`` and ``kept_text`` for every input row."""
    cuts = kept_pieces(repeated_runs(docs, min_words, id_col, text_col)).select(
        F.col("_id").alias("_cid"), F.col("_th").alias("_cth"), "pieces", "last", "gone")
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"),
                     F.xxhash64(F.col(text_col)).alias("_th"))
    df = df.join(cuts, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_th") == F.col("_cth")), "left")
    text = F.col("_row").getField(text_col)
    df = df.select("_row", "pieces", "last", F.coalesce("gone", F.lit(0)).cast("bigint").alias("n_removed"),
                   F.split(text, "\n").alias("_lines"))
    rest = F.slice("_lines", F.col("last") + 2, F.greatest(F.lit(0), F.size("_lines") - F.col("last") - 1))
    kept = F.concat(F.flatten(F.transform("pieces", lambda p: F.slice("_lines", p["s"] + 1, p["n"]))), rest)
    return df.select("_row", F.when(text.isNull(), 0).otherwise(F.size("_lines")).cast("bigint").alias("n_lines"), "n_removed",
                     F.when(F.col("last").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` per document."""
    out = dedup_lines(docs, min_words)
    return out.select(F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_removed",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The input's columns with repeated runs cut from the text; a document of which no word is left goes.

    ``chars_col``, where the table has it, is counted anew for changed texts.
    """
    out = keep_where(dedup_lines(docs, min_words, text_col=text_col).drop("n_lines"),
                     (F.col("n_removed") == 0) | (F.btrim("kept_text", F.lit(SPACES)) != ""))
    changed = F.col("n_removed") > 0
    cols = []
    for c in docs.columns:
        value = F.col("_row").getField(c)
        if c == text_col:
            value = F.when(changed, F.col("kept_text")).otherwise(value)
        elif c == chars_col:
            value = F.when(changed, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(value)
        cols.append(value.alias(c))
    return out.select(*cols)


SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw FROM l),
c AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id, text ORDER BY pos) AS fin,
             sum(nw) OVER (PARTITION BY doc_id, text ORDER BY pos) - nw AS beg FROM w WHERE nw > 0),
r AS (
  SELECT doc_id, text, min(pos) OVER f AS a, max(pos) OVER f AS b, sum(nw) OVER f AS n, list(line) OVER f AS run FROM c
  WINDOW f AS (PARTITION BY doc_id, text ORDER BY beg RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING)
  UNION
  SELECT doc_id, text, min(pos) OVER f, max(pos) OVER f, sum(nw) OVER f, list(line) OVER f FROM c
  WINDOW f AS (PARTITION BY doc_id, text ORDER BY fin RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)),
q AS (SELECT doc_id, text, a, b, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS LAST, a) AS k FROM r WHERE n >= 5),
x AS (SELECT l.doc_id, l.text, l.pos, any_value(l.line) AS line, coalesce(bool_or(q.a IS NOT NULL), false) AS gone
      FROM l LEFT JOIN (SELECT * FROM q WHERE k > 1) q
        ON l.doc_id IS NOT DISTINCT FROM q.doc_id AND l.text = q.text AND l.pos BETWEEN q.a AND q.b
      GROUP BY ALL),
y AS (SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM x GROUP BY ALL)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN y ON d.doc_id IS NOT DISTINCT FROM y.doc_id AND d.text = y.text
"""
