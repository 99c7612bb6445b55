"""Language-model scores with stupid backoff (operator 5).

A document's score is the mean over its words of ``log S``: with v the word before w and c the
counts over all documents, ``S = c(vw) / c(v)`` if the pair occurs ``MIN_COUNT`` times or more,
else ``ALPHA * c(w) / N``; a document's first word has ``c(w) / N``. c(v) counts v as a first
half of pairs.

The work is relational, on packed rows: every task turns its documents into n-gram rows, sorted
and grouped by hash part, one binary row per (batch of documents, part). A part holds the whole
count of each of its n-grams, joins it to the exploded n-grams there, and sends back one sum per
document. Word counts are made first, in parts by word hash. Pairs are dealt by their first word,
so that c(v) is in the same part, but for the ``TOP`` most frequent words, whose counts are in a
table of that fixed size, sent to all tasks: their pairs are dealt by both words, so no word makes
a hot part. Pairs that back off to a rare word meet its count in a third exchange. The number of
parts grows with the words, so a part's size does not.

Words are compared by 64-bit hashes (48 bits within a part); a mistake needs two words or pairs
of one part to share a hash, odds of about one in 10^8 a part.

Edge cases: null and empty texts have no word and score 0; null ids, repeated rows and extra
columns pass through (every row is a document); an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import Scratch
from .neardup import _groups

ALPHA = 0.4
MIN_COUNT = 2
TOP = 60_000
PART_WORDS = 2_000_000
BATCH_BYTES = 8 << 20
FIRST = np.uint64(65_535)         #: stands for the word before a document's first
RARE = np.uint64(1 << 47)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed byte planes: 8-byte words, high zero planes cost nothing."""
    n = len(arrays[0])
    planes = b"".join(np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(n, 8).T.tobytes() for a in arrays)
    return len(arrays).to_bytes(2, "little") + n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes) -> list[np.ndarray]:
    k, n = int.from_bytes(data[:2], "little"), int.from_bytes(data[2:10], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[10:], max_output_size=8 * n * k + 64), np.uint8).reshape(k, 8, n)
    return [np.ascontiguousarray(raw[i].T).view("<u8").reshape(n) for i in range(k)]


def _documents(batches):
    """(row ids, word hashes, first word of each document and the end) for groups of documents of about BATCH_BYTES."""
    ids, words, first, size = [], [], [0], 0
    for batch in batches:
        col = batch.column("id").to_pylist()
        for row, end, data, offsets in tn.slices(batch.column("text")):
            h, f = tn.word_hashes(data, offsets)
            ids += col[row:end]
            words.append(h)
            base = first[-1]
            first += (f[1:] + base).tolist()
            size += len(data)
            if size >= BATCH_BYTES:
                yield ids, np.concatenate(words), np.array(first)
                ids, words, first, size = [], [], [0], 0
    if ids:
        yield ids, np.concatenate(words) if words else np.zeros(0, np.uint64), np.array(first)


def _rows(parts: np.ndarray, n_parts: int, arrays: list[np.ndarray]):
    """(part, packed arrays) of each part that has entries; the input is sorted by part."""
    cuts = np.searchsorted(parts, np.arange(n_parts + 1))
    for p in range(n_parts):
        if cuts[p] < cuts[p + 1]:
            yield p, _pack(*(a[cuts[p]:cuts[p + 1]] for a in arrays))


def _sum_sorted(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts of the runs of equal keys, and the sums of the weights over each run."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return at, [np.add.reduceat(w, at) if len(at) else w[:0] for w in weights]


def word_counts(docs: DataFrame, n_parts: int, top: int) -> DataFrame:
    """Per part of the word hash: ``part, counts`` (hash, times, times at a document's end) and its ``head``, the most frequent."""
    def count(batches):
        for _, h, first in _documents(batches):
            last = np.zeros(len(h), np.uint64)
            last[first[1:][np.diff(first) > 0] - 1] = 1
            part = tn.mix(h) % np.uint64(n_parts)
            order = np.lexsort((h, part))
            at, (n, end) = _sum_sorted([h[order]], [np.ones(len(h), np.uint64), last[order]])
            h, part = h[order][at], part[order][at]
            out = list(_rows(part, n_parts, [h, n, end]))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["part", "data"])

    def merge(batches):
        for table, bounds in _groups(batches, "part"):
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                h, n, end = (np.concatenate(x) for x in zip(*(_unpack(b.as_py()) for b in table.column("data")[lo:hi])))
                order = np.argsort(h, kind="stable")
                at, (n, end) = _sum_sorted([h[order]], [n[order], end[order]])
                h = h[order][at]
                head = np.sort(np.lexsort((h, -n.astype(np.int64)))[:max(1, top // n_parts)])
                yield pa.RecordBatch.from_arrays([
                    pa.array([table.column("part")[lo].as_py()], pa.int32()), pa.array([_pack(h, n, end)], pa.binary()),
                    pa.array([_pack(h[head], n[head], end[head])], pa.binary())], ["part", "counts", "head"])
    rows = docs.mapInArrow(count, "part int, data binary").repartition(n_parts, "part").sortWithinPartitions("part")
    return rows.mapInArrow(merge, "part int, counts binary, head binary")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, min_count: int = MIN_COUNT,
           top: int = TOP, part_words: int = PART_WORDS) -> DataFrame:
    """``doc_id, n_words, n_backoff, score`` of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # about six bytes a word; the exact number follows with the counts
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(1, -(-size // (6 * part_words)))
    table = scratch.write(word_counts(docs, n_parts, top), "words")
    heads = [_unpack(r["head"]) for r in table.select("head").collect()]       # at most max(top, parts) words in all

    def total(batches):
        for batch in batches:
            n = sum(int(_unpack(b.as_py())[1].sum()) for b in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])
    n_all = table.select("counts").mapInArrow(total, "n long").agg(F.sum("n")).first()[0] or 0
    fh, fn, fe = (np.concatenate(x) for x in zip(*heads)) if heads else (np.zeros(0, np.uint64),) * 3
    order = np.argsort(fh)[:int(FIRST)]
    fh, fn, fe = fh[order], fn[order].astype(float), fe[order].astype(float)
    frequent = spark.sparkContext.broadcast((fh, fn, fn - fe))

    def codes(h):
        """Row number in the table of frequent words, or 47 bits of the hash."""
        fh = frequent.value[0]
        at = np.minimum(np.searchsorted(fh, h), max(0, len(fh) - 1))
        known = fh[at] == h if len(fh) else np.zeros(len(h), bool)
        return np.where(known, at.astype(np.uint64), h >> np.uint64(17) | RARE), known

    def pairs(batches):
        task = TaskContext.get().partitionId()
        for i, (ids, h, first) in enumerate(_documents(batches)):
            doc = np.repeat(np.arange(len(ids)), np.diff(first)).astype(np.uint64)
            w, _ = codes(h)
            starts = first[:-1][np.diff(first) > 0]
            v, before = np.empty_like(w), np.zeros(len(h), np.uint64)
            v[1:], before[1:] = w[:-1], h[:-1]
            v[starts] = FIRST
            # pairs of a rare word are dealt by it, others by both words
            part = np.where(v >= RARE, tn.mix(before), tn.mix(tn.mix(v) ^ w)) % np.uint64(n_parts)
            order = np.lexsort((doc, w, v, part))
            v, w, doc, part, h = v[order], w[order], doc[order], part[order], h[order]
            at, (tf,) = _sum_sorted([part, v, w, doc], [np.ones(len(v), np.uint64)])
            # a rare second word is dealt on by its hash later
            onward = np.where(w[at] >= RARE, tn.mix(h[at]) % np.uint64(n_parts), np.uint64(0))
            out = list(_rows(part[at], n_parts, [v[at], w[at], doc[at], tf, onward]))
            batch_id = task << 32 | i
            meta = _pack(np.array([np.iinfo(np.int64).min if x is None else x for x in ids], np.int64).view(np.uint64), np.diff(first).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([
                pa.array([p for p, _ in out] + [-1], pa.int32()), pa.array([batch_id] * (len(out) + 1), pa.int64()),
                pa.array([b for _, b in out] + [meta], pa.binary())], ["part", "batch", "data"])

    out_schema = "part int, batch long, data binary, kind int"

    def emit(rows):
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()),
                                           pa.array(cols[3], pa.int32())], ["part", "batch", "data", "kind"])

    def sums(batch_ids, owner, doc, value, count):
        """Packed (document, log sum, words that backed off) of each batch; value is a float per entry."""
        order = np.lexsort((doc, owner))
        at, (value, count) = _sum_sorted([owner[order], doc[order]], [value[order], count[order]])
        owner, doc = owner[order][at], doc[order][at]
        for p, data in _rows(owner.astype(np.int64), len(batch_ids), [doc, value.view(np.uint64), count.astype(np.uint64)]):
            yield -1, batch_ids[p], data, 1

    def match(batches):
        _, fn, fc = frequent.value
        for table, bounds in _groups(batches, "part"):
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                group = table.slice(lo, hi - lo)
                if group.column("part")[0].as_py() < 0:
                    yield emit([(-1, b, d, 0) for b, d in zip(group.column("batch").to_pylist(), group.column("data").to_pylist())])
                    continue
                batch_ids = group.column("batch").to_pylist()
                blobs = [_unpack(b.as_py()) for b in group.column("data")]
                owner = np.repeat(np.arange(len(blobs)), [len(b[0]) for b in blobs])
                v, w, doc, tf, onward = (np.concatenate(x) for x in zip(*blobs))
                order = np.lexsort((w, v))
                v, w, doc, tf, onward, owner = (x[order] for x in (v, w, doc, tf, onward, owner))
                at, (n,) = _sum_sorted([v, w], [tf])
                n = np.repeat(n, np.diff(np.r_[at, len(v)])).astype(float)
                at, (c,) = _sum_sorted([v], [tf])
                c = np.repeat(c, np.diff(np.r_[at, len(v)])).astype(float)
                known = v < np.uint64(len(fc))
                c[known] = fc[v[known].astype(np.int64)]
                seen = (n >= min_count) & (v != FIRST)
                weight = tf.astype(float)
                value = np.where(seen, np.log(n / np.maximum(c, 1)), np.where(v == FIRST, 0.0, math.log(alpha)) - math.log(max(n_all, 1))) * weight
                near = ~seen & (w < RARE)
                value[near] += np.log(fn[w[near].astype(np.int64)]) * weight[near]
                out = list(sums(batch_ids, owner, doc, value, np.where(seen | (v == FIRST), 0, tf)))
                far = np.flatnonzero(~seen & (w >= RARE))
                far = far[np.lexsort((w[far], onward[far]))]
                ids = np.array(batch_ids, np.int64).view(np.uint64)
                out += [(p, 0, data, 2) for p, data in _rows(onward[far], n_parts, [w[far], ids[owner[far]], doc[far], tf[far]])]
                yield emit(out)

    def back_off(batches):
        for table, bounds in _groups(batches, "part"):
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                group = table.slice(lo, hi - lo)
                if group.column("part")[0].as_py() < 0:
                    yield emit([(-1, b, d, k) for b, d, k in zip(*(group.column(c).to_pylist() for c in ("batch", "data", "kind")))])
                    continue
                kinds = group.column("kind").to_numpy()
                data = group.column("data")
                counts = [_unpack(data[int(i)].as_py()) for i in np.flatnonzero(kinds == 3)]
                far = [_unpack(data[int(i)].as_py()) for i in np.flatnonzero(kinds == 2)]
                if not far:
                    continue
                key, n = counts[0][0] >> np.uint64(17) | RARE, counts[0][1].astype(float)
                order = np.argsort(key, kind="stable")
                key, n = key[order], n[order]
                w, batch, doc, tf = (np.concatenate(x) for x in zip(*far))
                value = np.log(n[np.minimum(np.searchsorted(key, w), len(key) - 1)]) * tf
                ids, owner = np.unique(batch, return_inverse=True)
                yield emit(list(sums(ids.view(np.int64).tolist(), owner, doc, value, np.zeros(len(doc)))))

    def total_up(batches):
        names = ["doc_id", "n_words", "n_backoff", "score"]
        for table, bounds in _groups(batches, "batch"):
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                group = table.slice(lo, hi - lo)
                value, back = None, None
                rows = sorted(zip(group.column("kind").to_pylist(), group.column("data").to_pylist()), key=lambda x: x[0])
                ids, n = _unpack(rows[0][1])
                value, back = np.zeros(len(ids)), np.zeros(len(ids))
                # in a fixed order, so that reruns add up alike
                for data in sorted(d for _, d in rows[1:]):
                    doc, s, b = _unpack(data)
                    doc = doc.astype(np.int64)
                    value[doc] += s.view(np.float64)
                    back[doc] += b.astype(float)
                n, ids = n.astype(np.int64), ids.view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).min), pa.array(n), pa.array(back.astype(np.int64)),
                    pa.array(np.round(value / np.maximum(n, 1), 6))], names)

    spread = F.when(F.col("part") < 0, F.col("batch")).otherwise(F.col("part"))
    exploded = docs.mapInArrow(pairs, "part int, batch long, data binary")
    matched = exploded.repartition(n_parts, spread).sortWithinPartitions("part").mapInArrow(match, out_schema)
    counts = table.select("part", F.lit(0).cast("long").alias("batch"), F.col("counts").alias("data"), F.lit(3).alias("kind"))
    done = matched.union(counts).repartition(n_parts, spread).sortWithinPartitions("part").mapInArrow(back_off, out_schema)
    return done.repartition(n_parts, "batch").sortWithinPartitions("batch").mapInArrow(
        total_up, "doc_id long, n_words long, n_backoff long, score double")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d),
p AS (SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS v FROM t),
u AS (SELECT w, count(*) AS c FROM t GROUP BY w),
b AS (SELECT v, w, count(*) AS c FROM p WHERE i > 1 GROUP BY v, w),
x AS (SELECT v, count(*) AS c FROM p WHERE i > 1 GROUP BY v),
n AS (SELECT count(*) AS n FROM t),
s AS (SELECT p.r, p.i > 1 AND b.c < 2 AS off,
             CASE WHEN p.i = 1 THEN ln(u.c / n.n::DOUBLE) WHEN b.c >= 2 THEN ln(b.c / x.c::DOUBLE) ELSE ln(0.4) + ln(u.c) - ln(n.n::DOUBLE) END AS l
      FROM p JOIN u ON u.w = p.w CROSS JOIN n LEFT JOIN b ON b.v = p.v AND b.w = p.w AND p.i > 1 LEFT JOIN x ON x.v = p.v AND p.i > 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(k, 0) AS BIGINT) AS n_backoff, round(coalesce(m, 0), 6) AS score
FROM d LEFT JOIN (SELECT r, count(*) FILTER (WHERE off) AS k, avg(l) AS m FROM s GROUP BY r) USING (r)
"""
