"""Phrase collocation mining (operator 11): best-first branch-and-bound growth over prefix counts.

Phrases are two to four words inside a piece of text, counted per language. A phrase of ``a``
occurrences is scored by the worst of its cuts into a first part (``l`` occurrences) and the rest
(``r``): ``floor(2000000 * a / (l + r))``. A phrase that a longer candidate nearly always contains is
dropped; each language's best ``top`` of the others are the result.

Word and word-pair counts start the search. Growing a phrase ``p`` to the right keeps its first word,
and what is left never occurs more often than ``p`` nor less often than the grown phrase, so no phrase
that starts with ``p``, and not ``p`` itself, scores more than ``floor(2000000 * a / (f(first word) + a))``.
The frontier holds the phrases that are not expanded yet, best bound first. A round expands the best of
them in every language with one scan of the corpus: it counts the one-word extensions on both sides, which
decides whether the phrase survives and adds the extensions to the frontier. The ``top``-th best score among
survivors is the language's threshold; what is bounded below it is never expanded, and the search ends
when no open phrase reaches its threshold (ties do). Four words need the counts of the three-word
parts; one that is not known is counted in the next round, if the known cuts leave the phrase a chance.

A round's frontier is at most ``BATCH`` phrases over all languages, which bounds the broadcast; more
wait for a later round. Counts are combined per task before they are exchanged, so a phrase that a
third of all texts hold costs a row per task. Pairs of rare words are not exchanged: fixed-size bitmaps
(``sieve.py``) of the words, then of the pairs, that reach ``min_count`` filter the scan; what they let
through wrongly has no row in the tables it is joined to. Inside the scan a word is a 64-bit hash of language
and bytes (two of 10**8 distinct words collide with probability 3e-4); phrases are compared word by word.
Rankings are taken in two steps, first within (language, salt). All tables between
the rounds lie in the shared folder; any lost task is run again.

Edge cases: a null text has no word; a null language is ``und``; ids are not read, so null ids and
repeated rows (each counts) are harmless; an empty table gives an empty result; extra columns are not read;
texts of any length are counted whole. Products are formed as decimals, so counts may pass 2**43.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .sieve import bitmap, in_bitmap
from .textnum import mix, prefix_sums, slices, span_hashes, word_bounds

TOP = 2_000             #: phrases of a language
MIN_COUNT = 30          #: occurrences of a candidate
MAX_WORDS = 4
SHARE = 80              #: per cent of a phrase's occurrences inside one longer candidate that drop it
FIRST = 8               #: the first round expands this many times ``top`` phrases a language, each later one four times more
BATCH = 262_144         #: bound of the phrases of one round, over all languages
SALTS = 32
FLUSH = 1_500_000       #: occurrences a task gathers before it combines them
W = ["w1", "w2", "w3", "w4"]

_PIECE = np.zeros(256, bool)
_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[_PIECE] = 0x20
_M = np.uint64(0xD6E8FEB86659FD93)


def _grow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of the phrase without its last word."""
    return mix(g * _M + h)


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _tokens(batches):
    """Per slice of the texts: languages of its rows, folded bytes, word starts and ends, first word per row, word hashes, piece numbers."""
    known: dict[str, int] = {}
    for batch in batches:
        langs = [x if x is not None else "und" for x in batch.column(0).to_pylist()]
        for x in set(langs) - known.keys():
            known[x] = _lang_hash(x)
        keys = np.array([known[x] for x in langs], np.uint64)
        for a, b, data, offsets in slices(batch.column(1)):
            folded = _FOLD[data]
            starts, ends, first = word_bounds(folded, offsets)
            counts = np.diff(first)
            h = mix(span_hashes(prefix_sums(folded), starts, ends) * _M + np.repeat(keys[a:b], counts))
            piece = np.cumsum(_PIECE[data])[starts] + np.repeat(np.arange(b - a), counts)
            yield langs[a:b], folded, starts, ends, first, h, piece


def _source(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, word, h, f``: occurrences of each word, and of all words where ``word`` is null."""
    def work(batches):
        seen: dict[int, list] = {}
        total: dict[str, int] = {}

        def rows():
            langs = [x[0] for x in seen.values()] + list(total)
            out = pa.RecordBatch.from_arrays([
                pa.array(langs, pa.string()), pa.array([x[1].decode() for x in seen.values()] + [None] * len(total), pa.string()),
                pa.array(np.array(list(seen) + [0] * len(total), np.uint64).view(np.int64)),
                pa.array([x[2] for x in seen.values()] + list(total.values()), pa.int64())], ["lang", "word", "h", "c"])
            seen.clear()
            total.clear()
            return out
        for langs, data, starts, ends, first, h, _ in _tokens(batches):
            for lang, n in zip(langs, np.diff(first).tolist()):
                total[lang] = total.get(lang, 0) + n
            keys, at, c = np.unique(h, return_index=True, return_counts=True)
            row = np.searchsorted(first, at, "right") - 1
            for key, i, s, e, n in zip(keys.tolist(), row.tolist(), starts[at].tolist(), ends[at].tolist(), c.tolist()):
                entry = seen.get(key)
                if entry is None:
                    seen[key] = [langs[i], data[s:e].tobytes(), n]
                else:
                    entry[2] += n
            if len(seen) > 400_000:
                yield rows()
        yield rows()
    counts = _source(docs, lang_col, text_col).mapInArrow(work, "lang string, word string, h long, c long")
    return counts.groupBy("lang", "word").agg(F.min("h").alias("h"), F.sum("c").alias("f"))


class _Combined:
    """Occurrences of phrases, combined by their hash when many have come together."""

    def __init__(self, size: int):
        self.size, self.parts, self.n = size, [], 0

    def add(self, g: np.ndarray, words: list[np.ndarray]):
        if len(g):
            self.parts.append((g, words, np.ones(len(g), np.int64)))
            self.n += len(g)
        if self.n > FLUSH:
            self.combine()
            if self.n > FLUSH // 2:
                yield from self.rows()

    def combine(self) -> None:
        g = np.concatenate([p[0] for p in self.parts])
        order = np.argsort(g, kind="stable")
        g = g[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        words = [np.concatenate([p[1][k] for p in self.parts])[order[first]] for k in range(self.size)]
        c = np.add.reduceat(np.concatenate([p[2] for p in self.parts])[order], first)
        self.parts, self.n = [(g[first], words, c)], len(first)

    def rows(self):
        if self.parts:
            self.combine()
            _, words, c = self.parts[0]
            for i in range(0, len(c), 100_000):
                cols = [pa.array(w[i:i + 100_000].view(np.int64)) for w in words]
                cols += [pa.array(np.zeros(len(cols[0]), np.int64))] * (4 - self.size)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(c[i:i + 100_000])], [*W, "c"])
        self.parts, self.n = [], 0


class _Among:
    """Membership in a sorted set of hashes; a small table of their low bits answers most look-ups."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.low = np.zeros(1 << 22, bool)
        self.low[self.keys & np.uint64((1 << 22) - 1)] = True

    def __call__(self, g: np.ndarray) -> np.ndarray:
        out = self.low[g & np.uint64((1 << 22) - 1)]
        at = np.flatnonzero(out)
        if len(at):
            i = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
            out[at] = self.keys[i] == g[at]
        return out


def _pair_place(h: np.ndarray) -> np.ndarray:
    return h[:-1] ^ (h[1:] >> np.uint64(20))


def pair_counts(docs: DataFrame, words: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """``w1, w2, a``: pairs of neighbouring words that occur ``min_count`` times, by hash."""
    sieve = docs.sparkSession.sparkContext.broadcast(bitmap(words, F.col("h")))

    def work(batches):
        counts = _Combined(2)
        for *_, h, piece in _tokens(batches):
            known = in_bitmap(sieve.value, h)
            at = np.flatnonzero(known[:-1] & known[1:] & (piece[:-1] == piece[1:]))
            yield from counts.add(_grow(h[at], h[at + 1]), [h[at], h[at + 1]])
        yield from counts.rows()
    rows = _source(docs, lang_col, text_col).mapInArrow(work, "w1 long, w2 long, w3 long, w4 long, c long")
    return rows.groupBy("w1", "w2").agg(F.sum("c").alias("a")).where(F.col("a") >= min_count)


def extension_counts(docs: DataFrame, expand: dict[int, np.ndarray], ask: np.ndarray, word_sieve, pair_sieve, lang_col: str = "lang",
                     text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> DataFrame:
    """``w1 .. w4, c``: all phrases that extend one of ``expand`` (by number of words: hashes) by a word on either side, and those asked for."""
    sets = docs.sparkSession.sparkContext.broadcast((expand[2], expand[3], ask))

    def work(batches):
        grow2, grow3, asked = (_Among(x) for x in sets.value)
        three, four = _Combined(3), _Combined(4)
        for *_, h, piece in _tokens(batches):
            if len(h) < 3:
                continue
            known = in_bitmap(word_sieve.value, h)
            pair = known[:-1] & known[1:] & (piece[:-1] == piece[1:])
            pair &= in_bitmap(pair_sieve.value, _pair_place(h))
            at = np.flatnonzero(pair[:-1] & pair[1:])           # where three words stand
            g2 = _grow(h[:-1], h[1:])
            g3 = _grow(g2[at], h[at + 2])
            in2 = grow2(g2)
            if max_words > 2:
                take = in2[at] | in2[at + 1] | asked(g3)
                yield from three.add(g3[take], [h[at[take] + k] for k in range(3)])
            if max_words > 3 and len(grow3.keys):
                in3 = np.zeros(len(h), bool)
                in3[at] = grow3(g3)
                start = np.zeros(len(h) + 1, bool)
                start[at] = True
                place = np.flatnonzero(start[:-1] & start[1:])
                place = place[in3[place] | in3[np.minimum(place + 1, len(h) - 1)]]
                whole = np.zeros(len(h), np.uint64)
                whole[at] = g3
                yield from four.add(_grow(whole[place], h[place + 3]), [h[place + k] for k in range(4)])
        yield from three.rows()
        yield from four.rows()
    rows = _source(docs, lang_col, text_col).mapInArrow(work, "w1 long, w2 long, w3 long, w4 long, c long")
    return rows.groupBy(*W).agg(F.sum("c").alias("c")).where(F.col("c") >= min_count)


def _ratio(a: Column, total: Column) -> Column:
    """floor(2000000 * a / total), exact."""
    product = F.lit(2_000_000).cast("decimal(7,0)") * a.cast("decimal(19,0)")
    return F.call_function("div", product.cast("decimal(38,0)"), total.cast("decimal(38,0)"))


def _best_cut(cuts: list[tuple[Column, Column]], a: Column) -> Column:
    """``struct(score, cut, l, r)`` of the lowest-scoring cut, the first of equal ones."""
    each = [F.struct(_ratio(a, left + right).alias("score"), F.lit(k).alias("cut"), left.alias("l"), right.alias("r"))
            for k, (left, right) in enumerate(cuts, 1)]
    return F.array_min(F.array(*each))


def _phrase_rows(df: DataFrame, size: int, cuts: list[tuple[Column, Column]], first: Column) -> DataFrame:
    """``size, w1 .. w4, lang, a, score, l, r, bound``."""
    zero = F.lit(0).cast("bigint")
    words = [F.col(w) if k < size else zero.alias(w) for k, w in enumerate(W)]
    a = F.col("a")
    df = df.select(F.lit(size).alias("size"), *words, "lang", "a", _best_cut(cuts, a).alias("_cut"), _ratio(a, first + a).alias("bound"))
    return df.select("size", *W, "lang", "a", "_cut.score", "_cut.l", "_cut.r", "bound")


def _top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each language, with ``rank``; no task ranks more than a salt's rows or ``n`` of each salt."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*W), F.lit(SALTS)))
    part = Window.partitionBy("lang", "_salt").orderBy(*order)
    few = salted.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= n).drop("rank", "_salt")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= n)


def _word(words: DataFrame, k: int, *more: str) -> DataFrame:
    return words.select(F.col("h").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *more)


def _pairs(two: DataFrame, j: int, k: int) -> DataFrame:
    return two.select(F.col("w1").alias(f"w{j}"), F.col("w2").alias(f"w{k}"), F.col("a").alias(f"f{j}{k}"))


def _triples(three: DataFrame, j: int) -> DataFrame:
    return three.select(*[F.col(f"w{i + 1}").alias(f"w{j + i}") for i in range(3)], F.col("a").alias(f"t{j}"))


class Search:
    """The state of the search; every table is written to the shared folder."""

    def __init__(self, docs: DataFrame, lang_col: str, text_col: str, top: int, min_count: int, max_words: int, share: int, first: int, batch: int):
        self.docs, self.cols = docs, (lang_col, text_col)
        self.top, self.min_count, self.max_words, self.share, self.first, self.batch = top, min_count, max_words, share, first, batch
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "phrases")
        counts = self.scratch.write(word_counts(docs, *self.cols).where(F.col("word").isNull() | (F.col("f") >= min_count)), "words")
        self.words = counts.where("word is not null")
        self.langs = counts.where("word is null").select("lang", F.col("f").alias("n"))
        pairs = pair_counts(docs, self.words, *self.cols, min_count=min_count)
        pairs = pairs.join(_word(self.words, 1, "lang"), "w1").join(_word(self.words, 2), "w2")
        self.two = self.scratch.write(_phrase_rows(pairs, 2, [(F.col("f1"), F.col("f2"))], F.col("f1")), "two")
        context = self.spark.sparkContext
        self.word_sieve = context.broadcast(bitmap(self.words, F.col("h")))
        self.pair_sieve = context.broadcast(bitmap(self.two, F.col("w1").bitwiseXOR(F.shiftrightunsigned("w2", 20))))
        self.open = self.two                    # phrases that are not expanded
        self.three: list[DataFrame] = []        # every three-word phrase whose count is known
        self.pending: DataFrame | None = None   # four words, some three-word part of which is unknown
        self.found: DataFrame | None = None     # survivors that reach the threshold so far
        self.limits: DataFrame | None = None
        self.seen4: DataFrame | None = None     # four-word phrases that have been scored
        self.rounds = 0
        self.n_langs = self.langs.count()

    def thresholds(self) -> DataFrame:
        """``lang, t``: the ``top``-th best score among the survivors; languages with fewer have no row."""
        best = _top(self.found.select("lang", "score", *W), self.top, F.desc("score"))
        return best.groupBy("lang").agg(F.count("*").alias("_n"), F.min("score").alias("t")).where(F.col("_n") >= self.top).drop("_n")

    def above(self, df: DataFrame, bound: str) -> DataFrame:
        """Rows whose bound reaches the threshold of their language."""
        if self.limits is None:
            return df
        return df.join(self.limits, "lang", "left").where(F.col("t").isNull() | (F.col(bound) >= F.col("t"))).drop("t")

    def round(self) -> bool:
        """Expand the best open phrases; false if none can reach its threshold any more."""
        s = self.scratch
        if self.found is not None:
            self.limits = s.write(self.thresholds(), "limits")
        self.open = s.write(self.above(self.open, "bound"), "open")
        size = min(self.first * self.top * 4 ** self.rounds, max(1, self.batch // max(1, self.n_langs)))
        chosen = s.write(_top(self.open, size, F.desc("bound"), *W).drop("rank"), "chosen")
        keys = chosen.select("size", "w1", "w2", "w3").toArrow()
        ask = None
        if self.pending is not None:
            self.pending = s.write(self.above(self.pending, "bound"), "pending")
            parts = [F.when(F.col(f"t{j}").isNull(), F.struct(*[F.col(f"w{j + i}").alias(f"w{i + 1}") for i in range(3)])) for j in (1, 2)]
            ask = (_top(self.pending, size, F.desc("bound"), *W).select(F.explode(F.array_compact(F.array(*parts))).alias("x"))
                   .select("x.*").distinct().toArrow())
        if not keys.num_rows and not (ask is not None and ask.num_rows):
            return False
        self.rounds += 1

        def hashes(table, n):
            cols = [table.column(f"w{k}").to_numpy().astype(np.int64).view(np.uint64) for k in range(1, n + 1)]
            return reduce(_grow, cols[1:], cols[0])
        sizes = keys.column("size").to_numpy()
        expand = {n: hashes(keys.filter(pa.array(sizes == n)), n) for n in (2, 3)}
        new = extension_counts(self.docs, expand, hashes(ask, 3) if ask is not None else np.zeros(0, np.uint64), self.word_sieve,
                               self.pair_sieve, *self.cols, min_count=self.min_count, max_words=self.max_words)
        new = s.write(new, "counts")
        self.settle(chosen, new)
        self.learn(new)
        return True

    def settle(self, chosen: DataFrame, new: DataFrame) -> None:
        """Survivors among the expanded phrases: no extension has ``share`` per cent of their occurrences."""
        zero = F.lit(0).cast("bigint")
        w = [F.col(x) for x in W]
        parts = F.when(F.col("w4") == 0, F.array(F.struct(w[0].alias("w1"), w[1].alias("w2"), zero.alias("w3")), F.struct(w[1].alias("w1"), w[2].alias("w2"), zero.alias("w3")))
                       ).otherwise(F.array(F.struct(w[0].alias("w1"), w[1].alias("w2"), w[2].alias("w3")), F.struct(w[1].alias("w1"), w[2].alias("w2"), w[3].alias("w3"))))
        longer = new.select(F.explode(parts).alias("p"), "c").groupBy("p.w1", "p.w2", "p.w3").agg(F.max("c").alias("_longer"))
        wide = lambda k, c: F.lit(k).cast("decimal(3,0)") * c.cast("decimal(19,0)")
        kept = chosen.join(longer, ["w1", "w2", "w3"], "left").where(
            F.col("_longer").isNull() | (wide(100, F.col("_longer")) < wide(self.share, F.col("a")))).drop("_longer")
        self.keep(kept)
        self.open = self.open.join(chosen.select("w1", "w2", "w3"), ["w1", "w2", "w3"], "left_anti")

    def keep(self, survivors: DataFrame) -> None:
        survivors = survivors.select("size", *W, "lang", "a", "score", "l", "r")
        old = self.found
        self.found = self.scratch.write(survivors if old is None else self.above(old.unionByName(survivors), "score"), "found")

    def learn(self, new: DataFrame) -> None:
        """New three-word phrases join the frontier; four words are scored, or wait for counts."""
        s = self.scratch
        fresh = new.where("w4 = 0").select("w1", "w2", "w3", F.col("c").alias("a"))
        for known in self.three:
            fresh = fresh.join(known.select("w1", "w2", "w3"), ["w1", "w2", "w3"], "left_anti")
        fresh = (fresh.join(_word(self.words, 1, "lang"), "w1").join(_word(self.words, 3), "w3")
                 .join(_pairs(self.two, 1, 2), ["w1", "w2"]).join(_pairs(self.two, 2, 3), ["w2", "w3"]))
        fresh = s.write(_phrase_rows(fresh, 3, [(F.col("f1"), F.col("f23")), (F.col("f12"), F.col("f3"))], F.col("f1")), "three")
        self.three.append(fresh)
        self.open = self.open.unionByName(fresh)
        if self.max_words < 4:
            return
        four = new.where("w4 <> 0").withColumnRenamed("c", "a")
        four = (four.join(_word(self.words, 1, "lang"), "w1").join(_word(self.words, 4), "w4")
                .join(_pairs(self.two, 1, 2), ["w1", "w2"]).join(_pairs(self.two, 3, 4), ["w3", "w4"]))
        four = four.select(*W, "lang", "a", "f1", "f4", "f12", "f34")
        if self.pending is not None:
            old = self.pending.select(four.columns)
            four = old.unionByName(four.join(old.select(*W), W, "left_anti"))
        if self.seen4 is not None:
            four = four.join(self.seen4, W, "left_anti")
        three = reduce(DataFrame.unionByName, self.three)
        four = four.join(_triples(three, 1), ["w1", "w2", "w3"], "left").join(_triples(three, 2), ["w2", "w3", "w4"], "left")
        a = F.col("a")
        # an unknown part occurs at least as often as the whole, so the bound holds
        cuts = [(F.col("f1"), F.coalesce("t2", a)), (F.col("f12"), F.col("f34")), (F.coalesce("t1", a), F.col("f4"))]
        four = s.write(four.withColumn("_cut", _best_cut(cuts, a)).withColumn("bound", F.col("_cut.score")), "four")
        whole = F.col("t1").isNotNull() & F.col("t2").isNotNull()
        done = four.where(whole).select(F.lit(4).alias("size"), *W, "lang", "a", "_cut.score", "_cut.l", "_cut.r")
        self.keep(done)
        self.pending = four.where(~whole).drop("_cut")
        seen = done.select(*W)
        self.seen4 = seen if self.seen4 is None else self.seen4.unionByName(seen)

    def result(self) -> DataFrame:
        found, words = self.found, self.words
        for k in range(1, 5):
            found = found.join(words.select(F.col("h").alias(f"w{k}"), F.col("word").alias(f"s{k}")), f"w{k}", "left")
        found = found.withColumn("phrase", F.concat_ws(" ", "s1", "s2", "s3", "s4"))
        best = _top(found, self.top, F.desc("score"), F.desc("a"), "phrase").join(self.langs, "lang")
        return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
            share: int = SHARE, first: int = FIRST, batch: int = BATCH) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of two to ``max_words`` (at most four) words of each language."""
    if not 2 <= max_words <= MAX_WORDS:
        raise ValueError("max_words must be 2, 3 or 4")
    search = Search(docs, lang_col, text_col, top, min_count, max_words, share, first, batch)
    while search.round():
        pass
    if search.found is None:
        search.keep(search.two)
    out = search.scratch.write(search.result(), "phrases")
    search.scratch.drop_others(out)
    return out


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS p FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))) AS phrase
      FROM lists, (SELECT unnest(range(1, 5)) AS k) WHERE len(ws) >= k),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
cands AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, k, phrase, a, c, array_to_string(ws[1:c], ' ') AS lp, array_to_string(ws[c + 1:k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS c FROM cands)),
scored AS (SELECT x.lang, x.phrase, x.a, l.f AS l, r.f AS r, ((2000000::HUGEINT * x.a) // (l.f + r.f))::BIGINT AS score, x.c
      FROM cuts x JOIN counts l ON l.lang = x.lang AND l.phrase = x.lp JOIN counts r ON r.lang = x.lang AND r.phrase = x.rp),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cands)) GROUP BY ALL),
kept AS (SELECT w.* FROM worst w LEFT JOIN inside i ON w.lang = i.lang AND w.phrase = i.phrase WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * w.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN totals t ON k.lang = t.lang QUALIFY rank <= 2000
"""
