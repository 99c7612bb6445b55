"""Spelling variant grouping (operator 12) by reduced-alphabet neighbourhoods.

Words are counted over all documents; two are near if one inserted, deleted or replaced code point
turns one into the other. Letters are hashed to a few symbols. The image of a near word lies within
one edit of a word's own image, so each word generates the full one-edit neighbourhood of its reduced
form (itself, all deletions, replacements and insertions of a symbol), which is joined to the reduced
vocabulary; what shares a reduced form is verified on the original strings, inside the join, so that
only near pairs leave it. A word's form is its most frequent near word if that is ``RATIO`` times as
frequent; forms are followed to the last one by pointer doubling, whose depth is the logarithm of
a chain that grows tenfold at each step.

Few of the strings a neighbourhood holds are reduced words of the table, so they are looked up in a
bitmap of the reduced vocabulary before they are exchanged. The bitmap has a fixed size
(``sieve.py``, 8 MB) whatever the table; what it lets through wrongly meets nothing in the
join. It never decides a pair.

Counting is one map over the documents with partial counts per task (vectorised over Arrow buffers;
memory is a slice of the text or the longest text, and the partial counts, sent on beyond
``FLUSH`` words), then an aggregate. Everything after works on distinct words; every word has at most
a fixed number of near words for its length, so no key is hot after the join, and a reduced form that
many words share is a skewed join key that adaptive execution splits. Intermediate tables are written
to the shared folder; any lost task is run again.

Edge cases: a null text has no word; a null id counts as an empty one; rows equal in all columns are
rows of their own (each occurrence counts); an empty table gives an empty result; extra columns are
not read; a text of any length is processed whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .sieve import BITS, bitmap, in_bitmap
from .textnum import _BASE, _INV, mix, powers, prefix_sums, slices, span_hashes

SYMBOLS = 8             #: letters are hashed to so many symbols
MIN_LENGTH = 7          #: code points of a word
MIN_COUNT = 2           #: occurrences of a word
RATIO = 10              #: how much more frequent a form is
TYPO_MOD = 31           #: the code point that the crc32 names goes if this divides the crc32
FLUSH = 400_000         #: distinct words a task holds before it sends partial counts on

# bytes of a run: ASCII letters, and the two-byte code points U+00C0 to U+00FF (lead byte C3, any second byte)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal letter runs, and per byte whether a code point starts there."""
    ok = _LETTER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    ok[lead] = True
    ok[lead + 1] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = ok[1:] != ok[:-1]
    edge[offsets] = True                    # a run ends where its text does
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    solid = ok[starts]
    return starts[solid], ends[solid], (data & 0xC0) != 0x80


def _crc32(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each span, continued from the unfinished ``state``; spans must be sorted by falling length."""
    done = np.uint32(0xFFFFFFFF)
    state = state.copy()
    big = int(np.searchsorted(-lengths, -64, "left"))           # spans longer than 64 bytes, one by one
    for k in range(big):
        state[k] = zlib.crc32(data[starts[k]:starts[k] + lengths[k]], int(state[k] ^ done)) ^ 0xFFFFFFFF
    starts, lengths, rest = starts[big:], lengths[big:], state[big:]
    for i in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -i, "left"))          # spans longer than i
        rest[:n] = _CRC[(rest[:n] ^ data[starts[:n] + i]) & np.uint32(0xFF)] ^ (rest[:n] >> np.uint32(8))
    return state ^ done


def _id_states(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) ^ 0xFFFFFFFF for i in ids], np.uint32)


def _words(data: np.ndarray, offsets: np.ndarray, states: np.ndarray, min_length: int, typo_mod: int):
    """Bytes, starts and ends of the words of a slice, after the deletions."""
    data = _FOLD[data]
    starts, ends, head = _runs(data, offsets)
    points = np.concatenate([[0], np.cumsum(head)])
    length = points[ends] - points[starts]
    long = length >= min_length
    starts, ends, length = starts[long], ends[long], length[long]
    order = np.argsort(starts - ends, kind="stable")
    starts, ends, length = starts[order], ends[order], length[order]
    doc = np.searchsorted(offsets, starts, "right") - 1
    crc = _crc32(data, starts, ends - starts, states[doc])
    hit = np.flatnonzero(crc % np.uint32(typo_mod) == 0)
    whole = np.ones(len(starts), bool)
    whole[hit] = False
    extra, at = [], len(data)
    new_starts, new_ends = [], []
    for k in hit.tolist():
        if length[k] > min_length:          # else the rest is too short to be a word
            text = data[starts[k]:ends[k]].tobytes().decode()
            cut = int(crc[k]) % int(length[k])
            rest = (text[:cut] + text[cut + 1:]).encode()
            extra.append(rest)
            new_starts.append(at)
            at += len(rest)
            new_ends.append(at)
    if extra:
        data = np.concatenate([data, np.frombuffer(b"".join(extra), np.uint8)])
    return (data, np.concatenate([starts[whole], np.array(new_starts, np.int64)]), np.concatenate([ends[whole], np.array(new_ends, np.int64)]))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, typo_mod: int = TYPO_MOD) -> DataFrame:
    """``word, n``: distinct words of at least ``min_length`` code points that occur ``min_count`` times over all documents."""
    def work(batches):
        seen: dict[int, list] = {}

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in seen.values()], pa.string()),
                                              pa.array([c for _, c in seen.values()], pa.int64())], ["word", "c"])
            seen.clear()
            return out
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, data, offsets in slices(batch.column(1)):
                data, starts, ends = _words(data, offsets, _id_states(ids[a:b]), min_length, typo_mod)
                keys, first, c = np.unique(span_hashes(prefix_sums(data), starts, ends), return_index=True, return_counts=True)
                for key, s, e, n in zip(keys.tolist(), starts[first].tolist(), ends[first].tolist(), c.tolist()):
                    entry = seen.get(key)
                    if entry is None:
                        seen[key] = [data[s:e].tobytes(), n]
                    else:
                        entry[1] += n
                if len(seen) > FLUSH:
                    yield rows()
        yield rows()
    counts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, "word string, c long")
    return counts.groupBy("word").agg(F.sum("c").alias("n")).where(F.col("n") >= min_count)


_rng = np.random.default_rng(20250311)
_VALUE = _rng.integers(0, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _length(n: int) -> np.uint64:
    """What the length of a string adds to its hash."""
    return np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))


def _symbols(word: str, symbols: int) -> np.ndarray:
    return (np.frombuffer(word.encode("utf-32-le"), np.uint32) * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(symbols)


def _sums(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of the polynomial hash of each row of symbols, their prefix sums and the powers."""
    n = sym.shape[1]
    fw = powers(n + 1)[0][:n + 1]
    terms = _VALUE[sym] * fw[:n]
    sums = np.zeros((len(sym), n + 1), np.uint64)
    np.cumsum(terms, axis=1, out=sums[:, 1:])
    return terms, sums, fw


def _image(sym: np.ndarray) -> np.ndarray:
    """64-bit key of each row of symbols (rows of equal length); equal strings have equal keys."""
    return mix(_sums(sym)[1][:, -1] + _length(sym.shape[1]))


def neighbourhood(sym: np.ndarray, symbols: int) -> np.ndarray:
    """Keys of all strings within one edit of each row; repeats within a row are not removed.

    Every key comes from prefix sums of the row's hash, so a row of n symbols costs n times the
    number of symbols, however long it is.
    """
    m, n = sym.shape
    terms, sums, fw = _sums(sym)
    whole, value = sums[:, -1:], _VALUE[:symbols]
    gone = sums[:, :-1] + (whole - sums[:, 1:]) * _INV
    changed = (whole - terms)[:, :, None] + fw[None, :n, None] * value
    more = (sums + (whole - sums) * _BASE)[:, :, None] + fw[None, :, None] * value
    parts = [(whole, n), (gone, n - 1), (changed.reshape(m, -1), n), (more.reshape(m, -1), n + 1)]
    return np.concatenate([mix(h + _length(k)) for h, k in parts], axis=1)


def _by_length(words: list[str], symbols: int):
    """(indexes, symbol matrix) for each length among the words."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, index in groups.items():
        step = max(1, 40_000 // n)
        for k in range(0, len(index), step):
            part = index[k:k + step]
            yield np.array(part), np.stack([_symbols(words[i], symbols) for i in part])


def reduced(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word, n, key``: the key of the word's reduced form."""
    def work(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            key = np.zeros(len(words), np.uint64)
            for index, sym in _by_length(words, symbols):
                key[index] = _image(sym)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key.view(np.int64))], ["word", "n", "key"])
    return vocabulary.select("word", "n").mapInArrow(work, "word string, n long, key long")


def near_pairs(vocabulary: DataFrame, scratch: Scratch, symbols: int = SYMBOLS, bits: int = BITS) -> DataFrame:
    """``word, n, near, near_n``: every ordered pair of words at exactly one edit."""
    keyed = scratch.write(reduced(vocabulary, symbols), "keys")
    sieve = vocabulary.sparkSession.sparkContext.broadcast(bitmap(keyed, F.col("key"), bits))

    def work(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            for index, sym in _by_length(words, symbols):
                keys = neighbourhood(sym, symbols)
                row, col = np.nonzero(in_bitmap(sieve.value, keys, bits))
                pairs = np.unique(np.stack([row.astype(np.uint64), keys[row, col]], axis=1), axis=0)
                at = index[pairs[:, 0].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)),
                                                  pa.array(pairs[:, 1].view(np.int64))], ["word", "n", "key"])
    hoods = keyed.select("word", "n").mapInArrow(work, "word string, n long, key long")
    other = keyed.select(F.col("key"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    one = (F.abs(F.length("word") - F.length("near")) <= 1) & (F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)
    return hoods.join(other, (hoods["key"] == other["key"]) & one).select("word", "n", "near", "near_n")


def roots(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` for a table ``word, form`` whose chains are finite; ``form`` may or may not be a word of it."""
    at = scratch.write(edges.select("word", F.col("form").alias("root")), "root")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = scratch.write(at.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "root")
        scratch.drop(at)
        at = new
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                      min_count: int = MIN_COUNT, ratio: int = RATIO, symbols: int = SYMBOLS, typo_mod: int = TYPO_MOD) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every distinct word."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.write(word_counts(docs, id_col, text_col, min_length, min_count, typo_mod), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w")))
    near = near_pairs(words, scratch, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_best"))
    formed = F.col("_best.n") * -1 >= F.col("n") * ratio
    table = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(formed, F.col("_best.w")).alias("form"), F.when(formed, -F.col("_best.n")).alias("form_n"))
    table = scratch.write(table, "forms")
    last = roots(table.where("form is not null").select("word", "form"), scratch)
    out = table.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
    out = scratch.write(out, "variants")
    scratch.drop_others(out)
    return out


#: Near pairs in the twin share a word with one code point removed at the same place, or are such a rest themselves.
SQL = r"""
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1],
       lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
kinds AS (SELECT doc_id, r, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM runs WHERE length(r) >= 7 GROUP BY doc_id, r),
crcs AS (SELECT r, c, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(x) // 2),
       lambda i: (strpos('0123456789ABCDEF', substr(x, (2 * i + 1)::INT, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, (2 * i + 2)::INT, 1)) - 1)),
       lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM kinds, tab),
found AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, c FROM crcs),
words AS (SELECT word, sum(c)::BIGINT AS n FROM found WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
rests AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM rests a JOIN rests b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM rests a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM rests a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS m FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n,
    CASE WHEN b.m >= 10 * w.n THEN (SELECT min(p.near) FROM pairs p WHERE p.word = w.word AND p.near_n = b.m) END AS form
    FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (WITH RECURSIVE c(word, last, depth) AS (SELECT word, word, 0 FROM forms
    UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN forms f ON c.last = f.word WHERE f.form IS NOT NULL) SELECT word, arg_max(last, depth) AS root FROM c GROUP BY word)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM forms f JOIN chain c ON f.word = c.word
"""
