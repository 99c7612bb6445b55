"""Quality rules (operator 10): plain text statistics plus a hashed n-gram importance ratio.

The ratio compares two multinomials over hashed word and word-pair features: one of a
trusted target and one of the whole corpus (Xie et al., data selection by importance
resampling). Each document's log ratio is divided by its number of features, and every
document whose mean is below one fixed threshold is rejected; nothing is sampled.

Columns only, no Python in the tasks. The corpus is read twice: once for the bucket
counts, once for the scores. Bucket counts combine before the shuffle, so it carries one
row per bucket and task. The table of log ratios has ``buckets`` entries whatever the input.

Edge cases: a null text has no word and fails the base rules; null ids, repeated rows and
extra columns pass through; without trusted rows all ratios are 0 and only the base rules
decide; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_where, read, shingle_hashes, words

BUCKETS = 10_000          #: features are hashed into so many buckets
PRIOR = 1_000.0           #: weight, in features, of the corpus distribution in the target's
THRESHOLD = -0.40         #: least mean log ratio of a kept document (features 1.5 times as likely in the corpus as in the target)
TRUSTED_ROWS = 20_000     #: documented bound of the labelled rows the target is fitted on


def repeat_words(grams: str, n_words: str, df: DataFrame, out: str) -> DataFrame:
    """Add ``out``: how many words lie in a five-word run that occurs twice or more in the text."""
    keep = [F.col(f"`{c}`") for c in df.columns if c != grams]
    has = F.size(F.array_distinct(grams)) < F.size(grams)
    df = df.select(*keep, F.when(has, F.sort_array(F.transform(
        grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).alias("_sorted"))
    hit = F.filter("_sorted", lambda x, i: F.coalesce(x["h"] == F.get(F.col("_sorted"), i - 1)["h"], F.lit(False))
                   | F.coalesce(x["h"] == F.get(F.col("_sorted"), i + 1)["h"], F.lit(False)))
    df = df.select(*keep, F.sort_array(F.transform(hit, lambda x: x["p"])).alias("_at"))
    step = F.transform("_at", lambda p, i: F.least(F.lit(5), F.coalesce(p - F.get(F.col("_at"), i - 1), F.lit(5))))
    total = F.aggregate(step, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.select(*keep, F.coalesce(total, F.lit(0).cast("bigint")).alias(out))


def _features(text: Column) -> Column:
    """Words, with runs of ASCII punctuation as words of their own."""
    apart = F.regexp_replace(F.coalesce(text, F.lit("")), r"[!-/:-@\[-`{-~]+", " $0 ")
    return words(apart)


def _buckets(tokens: str, n: str, buckets: int) -> Column:
    """Bucket numbers of all tokens and all neighbouring pairs of tokens."""
    one = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))
    two = F.transform(F.sequence(F.lit(0), F.col(n) - 2), lambda i: F.pmod(
        F.xxhash64(F.get(F.col(tokens), i), F.get(F.col(tokens), i + 1)), F.lit(buckets)).cast("int"))
    return F.when(F.col(n) >= 2, F.concat(one, two)).otherwise(one)


def _tokenised(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    df = docs.select(*keep, _features(F.col(text_col)).alias("_tokens"))
    return df.select("*", F.size("_tokens").alias("_nt"))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               buckets: int = BUCKETS, prior: float = PRIOR, trusted_rows: int = TRUSTED_ROWS) -> list[float]:
    """Log of target over corpus probability per bucket.

    ``trusted`` has the ids of trusted documents; at most ``trusted_rows`` of them, the first
    by hash of the id, are used, which bounds the broadcast. The corpus side counts all documents.
    """
    ids = (trusted.select(F.col(id_col).alias("_tid")).where("_tid is not null").distinct()
           .orderBy(F.xxhash64("_tid"), "_tid").limit(trusted_rows).withColumn("_t", F.lit(True)))
    df = _tokenised(docs, text_col, F.col(id_col).alias("_id"))
    df = df.join(F.broadcast(ids), df["_id"] == ids["_tid"], "left")
    rows = (df.select(F.coalesce("_t", F.lit(False)).alias("_t"), F.explode(_buckets("_tokens", "_nt", buckets)).alias("_b"))
            .groupBy("_b").agg(F.count("*").alias("n"), F.count_if("_t").alias("t")).collect())
    raw, target = [0] * buckets, [0] * buckets
    for r in rows:
        raw[r["_b"]], target[r["_b"]] = r["n"], r["t"]
    n, t = sum(raw), sum(target)
    out = []
    for c, k in zip(raw, target):
        q = (c + 1.0) / (n + buckets)
        p = (k + prior * q) / (t + prior)
        out.append(round(math.log(p / q), 6))
    return out


def quality_columns(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """One row per input row: the base statistics, ``base_failed``, ``llr`` and ``kept``.

    With ``carry`` the input columns come first, in a struct ``_row`` (for filters).
    """
    buckets = len(ratios)
    table = F.split(F.lit(",".join(f"{x:g}" for x in ratios)), ",").cast("array<double>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    keep = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    df = docs.select(*keep, F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("_words"), lines.alias("_lines"),
                     F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
                     _features(F.col(text_col)).alias("_tokens"))
    names = ["_row"] * carry + ["doc_id", "n_symbols"]
    df = df.select(*names, "_words", "_tokens", F.size("_words").alias("_n"), F.size("_tokens").alias("_nt"),
                   F.length(F.concat_ws("", "_words")).cast("bigint").alias("word_chars"),
                   (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"))
    score = F.aggregate(_buckets("_tokens", "_nt", buckets), F.lit(0.0), lambda a, b: a + F.get(table, b))
    names += ["word_chars", "n_dup_lines"]
    df = df.select(*names, F.col("_n").cast("bigint").alias("n_words"),
                   shingle_hashes(F.col("_words"), F.col("_n")).alias("_grams"),
                   F.round(score / F.greatest(F.lit(1), 2 * F.col("_nt") - 1), 6).alias("llr"))
    df = repeat_words("_grams", "n_words", df, "n_repeat_words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = df.select(*["_row"] * carry, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                   failed.alias("base_failed"), "llr")
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def trusted_ids(spark, sf_dir: str) -> DataFrame:
    """Documents labelled as good."""
    return read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def quality_rules(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The contract's columns and ``llr`` for every document."""
    return quality_columns(docs, log_ratios(docs, trusted), **options)


def keep_good(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The input rows that the rules keep, with the input's columns."""
    out = quality_columns(docs, log_ratios(docs, trusted), carry=True, **options)
    return keep_where(out.select("_row", "kept"), F.col("kept")).select("_row.*")
