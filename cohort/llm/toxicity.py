"""Toxicity with noisy-channel deobfuscation (operator 4).

1. A character trigram model is counted over all documents, in two tables of a fixed number of
   hashed buckets.
2. Tokens that are not plain letters (of any length, all of look-alikes too), tokens with
   repeated letters, and runs of three or more characters spelled out with spaces or dots become
   lattices of the characters they may stand for: a look-alike for its letters, a separator for a
   space or nothing, a mask character for any letter or nothing, a run for one or two of its
   character. A Viterbi search under the character model picks the likeliest reading; leaving a
   character out costs ``DROP``. A masked token is also matched with the learned words that it
   fits letter by letter, as the model cannot know which of them was meant.
3. Words of the restored text and their first letters are weighed by a logistic regression fitted
   on labelled documents (the prior of a weight is the wider, the more evidence its term has, so
   weak evidence counts a little and adds up); a document's score is the probability the regression gives it. Terms of
   three or more labelled documents take part, with no other test; ``THRESHOLD`` is the only cut-off.

Labels are read only of rows whose crc32 of the id, as text, leaves a remainder other than 2
when divided by 4, and of these a sample of at most ``SAMPLE`` rows, the first by hash of the
id: the one bounded part. Labels, language, source and id are no input of a score.

All passes are maps over rows. What goes through the driver has a fixed bound: ``BUCKETS``
counts per table, ``TERMS`` terms (those with the most evidence), and for each sampled row the
numbers of its terms.

Edge cases: null and empty texts, and texts without a weighed term, score ``BASE``; a row with a null id is not held out and is
never learned from; repeated rows get equal scores; without labels every score is ``BASE``;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_bounded

SAMPLE = 40_000
TERMS = 20_000
BUCKETS = 1 << 16
THRESHOLD = 0.3
BASE = 0.01
MIN_DOCS = 3            #: labelled documents with a term
EVIDENCE = 10.0         #: log-likelihood ratio statistic of a term whose weight has a prior variance of one
LEAST_PRIOR = 0.05      #: inverse variance for the terms with the most evidence

#: Letters that a look-alike character may stand for.
LOOKALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
             "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "'": ""}
MASKS = frozenset("*#.-_")
LETTERS = tuple("abcdefghijklmnopqrstuvwxyz")
MASK_RUN = 6            #: letters that one run of masks may stand for, as the search grows with it
DROP = 2.5              #: cost of leaving out a mask or a space, a little under that of a letter at random
EDGES = " \t\n\x0b\x0c\r.,;:!?\"'`()[]{}<>#$%&*|-_=~^/\\"
_UNIT = r"[^\W_]|[@$!|+(]"
SPELLED = re.compile(rf"(?<![\w@$!|+(])(?:(?:{_UNIT})[ .*_-]{{1,2}}){{2,}}(?:{_UNIT})(?![\w@$|+(])")
SPELLED_END = re.compile(rf"[ .*_-](?:{_UNIT})[ .*_-]{{1,2}}(?:{_UNIT})(?![\w@$|+(])")     #: in every ``SPELLED`` run, and cheaper to look for
RUN = re.compile(r"([^\W\d_])\1\1")
_ANY = (("", DROP), *((x, 0.0) for x in LETTERS))       #: what a mask may stand for
_A, _B, _C = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917))


# -- character model ------------------------------------------------------------------------

def _slots(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams and of the bigram each begins with."""
    p = points.astype(np.uint32)
    two = p[:-2] * _A + p[1:-1] * _B
    tri = two + p[2:] * _C
    return (tri ^ tri >> np.uint32(15)) % np.uint32(BUCKETS), (two ^ two >> np.uint32(15)) % np.uint32(BUCKETS)


def count_characters(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of character trigrams and their leading bigrams over all texts, lower-cased."""
    def work(batches):
        three, two = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            size, part = 0, []
            for value in [*batch.column(0), None]:
                text = value.as_py() if value is not None else None
                if text:
                    part.append(text)
                    size += len(text)
                if part and (value is None or size > 1 << 19):
                    points = np.frombuffer("\n".join(part).lower().encode("utf-32-le", "replace"), "<u4")
                    if len(points) > 2:
                        a, b = _slots(points)
                        three += np.bincount(a, minlength=BUCKETS)
                        two += np.bincount(b, minlength=BUCKETS)
                    size, part = 0, []
        at = np.flatnonzero(three + two)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(three[at]), pa.array(two[at])], ["b", "t", "d"])
    rows = docs.select(text_col).mapInArrow(work, "b int, t long, d long").groupBy("b").agg(F.sum("t").alias("t"), F.sum("d").alias("d")).collect()
    three, two = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        three[r["b"]], two[r["b"]] = r["t"], r["d"]
    return three, two


class Decoder:
    """Viterbi search over the readings of a token under the character model."""

    def __init__(self, three: np.ndarray, two: np.ndarray):
        self.three, self.two = three.astype(np.float32), two.astype(np.float32)
        self.cost = lru_cache(1 << 17)(self._cost)
        self.letters = lru_cache(1 << 13)(self._letters)
        short = lru_cache(50_000)(self._best)
        self.best = lambda token: short(token) if len(token) <= 100 else self._best(token)

    def __reduce__(self):
        return Decoder, (self.three, self.two)

    def _cost(self, a: str, b: str, c: str) -> float:
        x = ord(a) * int(_A) + ord(b) * int(_B) & 0xFFFFFFFF
        y = x + ord(c) * int(_C) & 0xFFFFFFFF
        return math.log(self.two[(x ^ x >> 15) % BUCKETS] + 50.0) - math.log(self.three[(y ^ y >> 15) % BUCKETS] + 0.5)

    def _letters(self, pair: str) -> list[tuple[str, str, float]]:
        """Each letter after two characters: it, the last two characters then, its cost."""
        return [(c, pair[1] + c, self.cost(pair[0], pair[1], c)) for c in LETTERS]

    @staticmethod
    def lattice(token: str) -> list[tuple[tuple[str, float], ...]]:
        """Alternatives (a short string and its own cost) for every mask, and for every run of another character."""
        out, i = [], 0
        while i < len(token):
            j = i
            while j < len(token) and token[j] == token[i]:
                j += 1
            c, n = token[i], j - i
            if c == " ":
                out.append((("", DROP), (" ", 0.0)))
            elif c in MASKS:
                # masks beside the ends are emphasis or punctuation, unless little else is there to read
                inner = 0 < i and j < len(token) or sum(x not in MASKS for x in token) < 3
                out += [_ANY] * min(n, MASK_RUN) if inner else []
            else:
                letters = (c,) if c.isalpha() else tuple(LOOKALIKE.get(c, c)) or ("",)
                out.append(tuple((x, 0.0) for x in dict.fromkeys(x * k for x in letters for k in ((1,) if n == 1 else (1, 2)))))
            i = j
        return out

    def _best(self, token: str) -> str:
        lattice = self.lattice(token)
        if all(len(options) == 1 for options in lattice):       # nothing to choose
            return "".join(options[0][0] for options in lattice).strip()
        # readings are linked lists (piece, reading before), so that a step costs the same at any length
        cost_of = self.cost
        states = {"  ": (0.0, None)}          # last two characters -> (cost, reading)
        for options in [*lattice, ((" ", 0.0),)]:
            after: dict[str, tuple[float, tuple | None]] = {}
            for last, (cost, read) in states.items():
                for piece, own in options[:1] if options is _ANY else options:
                    total, pair = cost + own, last
                    for c in piece:
                        total += cost_of(pair[0], pair[1], c)
                        pair = pair[1] + c
                    known = after.get(pair)
                    if known is None or total < known[0]:
                        after[pair] = (total, (piece, read) if piece else read)
                for piece, pair, own in self.letters(last) if options is _ANY else ():
                    known, total = after.get(pair), cost + own
                    if known is None or total < known[0]:
                        after[pair] = (total, (piece, read))
            states = after
        read, pieces = min(states.items(), key=lambda x: (x[1][0], x[0]))[1][1], []
        while read:
            pieces.append(read[0])
            read = read[1]
        return "".join(reversed(pieces)).strip()


_ODD = frozenset(LOOKALIKE) | MASKS


def _odd(token: str) -> bool:
    """Has look-alike or mask characters, or a letter three times in a row."""
    return not _ODD.isdisjoint(token) and not MASKS.issuperset(token) or RUN.search(token) is not None


def masked_words(token: str, index: dict) -> list[str]:
    """Words of the index that a token with masks fits letter by letter, at least two of them shown."""
    options = [None if c in MASKS else c if c.isalpha() else LOOKALIKE.get(c, c) for c in token]
    shown = [i for i, o in enumerate(options) if o]
    if len(shown) < 2 or len(shown) == len(token):
        return []
    at = shown[0]
    near = {w for c in options[at] for w in index.get((len(token), at, c), ())}
    return sorted(w for w in near if all(w[i] in options[i] for i in shown))


def word_index(words) -> dict:
    """(length, position, letter) -> words."""
    index: dict = {}
    for w in words:
        for i, c in enumerate(w):
            index.setdefault((len(w), i, c), []).append(w)
    return index


def restored_words(text: str, decoder: Decoder | None, index: dict | None = None) -> set[str]:
    """Distinct lower-cased words without punctuation at their ends, with readings of obfuscated ones added."""
    text = text.lower()
    tokens = set(text.split())
    plain = {t for t in tokens if t.isalpha()}      # nothing to strip
    rest = tokens - plain
    found = plain | {t.strip(EDGES) for t in rest}
    if decoder is not None:
        # one search says whether any token repeats a letter; without one, tokens of letters alone are not odd
        repeats = RUN.search(" ".join(tokens)) is not None
        raw = {t.rstrip(".,;:") for t in rest}
        for token in raw | {t for t in plain if RUN.search(t)} if repeats else [t for t in raw if not t.isalpha()]:
            if _odd(token):
                found.update(decoder.best(token).split())
            if index and not MASKS.isdisjoint(token):
                found.update(masked_words(token, index))
        for m in SPELLED.finditer(text) if SPELLED_END.search(text) else ():
            found.update(decoder.best(m.group()).split())
            letters = "".join(c for c in m.group() if c not in MASKS and c != " ")
            # a word of one letter next to it may stick to it
            found.update(decoder.best(x) for x in (letters, letters[1:], letters[:-1]))
    found.discard("")
    return found


def terms_of(words: set[str]) -> set[str]:
    """Words, and as ``x~`` the first four and five letters of longer ones."""
    return words | {w[:4] + "~" for w in words if len(w) > 4} | {w[:5] + "~" for w in words if len(w) > 5}


def known_terms(words: set[str], terms: dict, four: set[str], five: set[str]) -> set[str]:
    """``terms_of(words)`` that are keys of ``terms``, whose first letters are ``four`` and ``five``."""
    found = words & terms.keys()
    found.update(f"{w}~" for w in four & {w[:4] for w in words if len(w) > 4})
    found.update(f"{w}~" for w in five & {w[:5] for w in words if len(w) > 5})
    return found


def first_letters(terms) -> tuple[set[str], set[str]]:
    """The first four and the first five letters among the terms."""
    return tuple({t[:-1] for t in terms if t.endswith("~") and len(t) == n + 1} for n in (4, 5))


# -- learning ---------------------------------------------------------------------------------

def fit_logistic(rows: list[np.ndarray], y: np.ndarray, n: int, prior: np.ndarray | float) -> np.ndarray:
    """Weights of ``n`` binary features with priors of these inverse variances, and last the intercept, by Newton steps with conjugate gradients."""
    col = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    penalty = np.r_[np.broadcast_to(prior, n), 1e-6]

    def times(w):
        return np.bincount(row, w[col], len(rows)) + w[n]

    def back(v):
        return np.r_[np.bincount(col, v[row], n), v.sum()]

    def loss(w):
        z = times(w)
        return np.logaddexp(0, z).sum() - z @ y + 0.5 * (penalty * w) @ w, z
    w = np.zeros(n + 1)
    w[n] = math.log(y.mean() / (1 - y.mean()))
    value, z = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z))
        grad, s = back(p - y) + penalty * w, p * (1 - p)
        scale = 1 / (back(s) + penalty)
        # preconditioned conjugate gradients for the step
        step, r = np.zeros(n + 1), -grad
        d, size = scale * r, (scale * r) @ r
        limit = 1e-4 * size
        for _ in range(60):
            if size <= limit:
                break
            h = back(s * times(d)) + penalty * d
            a = size / (d @ h)
            step, r = step + a * d, r - a * h
            new = (scale * r) @ r
            d, size = scale * r + new / size * d, new
        rate = 1.0
        while rate > 1e-6 and (new := loss(w + rate * step))[0] > value:
            rate /= 2
        if rate <= 1e-6 or value - new[0] < 1e-9 * max(1.0, abs(value)):
            break
        w, (value, z) = w + rate * step, new
    return w


def learn_terms(docs: DataFrame, labels: DataFrame, decoder: Decoder, id_col: str = "doc_id", text_col: str = "text",
                sample: int = SAMPLE, evidence: float = EVIDENCE) -> dict[str, float]:
    """Term -> weight in the log odds that a document is toxic; the intercept is the empty term's."""
    known = (labels.select(F.col(id_col).alias("_lid"), F.col("toxic").cast("int").alias("_y")).where("_lid is not null and _y is not null")
             .where(F.crc32(F.col("_lid").cast("string")) % 4 != 2).groupBy("_lid").agg(F.max("_y").alias("_y"))
             .orderBy(F.xxhash64("_lid"), "_lid").limit(sample))
    counts = known.groupBy("_y").count().collect()
    n = {r["_y"]: r["count"] for r in counts}
    if not n.get(1) or not n.get(0):
        return {}
    rows = join_bounded(docs, known, F.col(id_col) == F.col("_lid"), "inner", sum(n.values()), sample).select(
        F.col(id_col).cast("long").alias("id"), "_y", F.col(text_col).alias("text"))

    def count(batches):
        pos: Counter = Counter()
        neg: Counter = Counter()
        for batch in batches:
            for y, value in zip(batch.column("_y").to_pylist(), batch.column("text")):
                (pos if y else neg).update(terms_of(restored_words(value.as_py() or "", decoder)))
        terms = list(pos | neg)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([pos[t] for t in terms], pa.int64()),
                                          pa.array([neg[t] for t in terms], pa.int64())], ["term", "p", "q"])
    seen = rows.mapInArrow(count, "term string, p long, q long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    rate, both = n[1] / (n[1] + n[0]), F.col("p") + F.col("q")
    part = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / both / share)).otherwise(0.0)
    g = F.greatest(F.lit(1e-6), F.round(2 * (part("p", rate) + part("q", 1 - rate)), 6))
    seen = seen.where(both >= MIN_DOCS).select("term", g.alias("g")).orderBy(F.desc("g"), "term").limit(TERMS).collect()
    terms = [r["term"] for r in seen]
    prior = np.maximum(LEAST_PRIOR, (evidence / np.array([r["g"] for r in seen])) ** 2)
    number = {t: i for i, t in enumerate(terms)}
    four, five = first_letters(terms)

    def matrix(batches):
        for batch in batches:
            found = [np.sort(np.array([number[t] for t in known_terms(restored_words(v.as_py() or "", decoder), number, four, five)], "<i4")).tobytes()
                     for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("_y"), pa.array(found, pa.binary())], ["id", "y", "x"])
    # in a fixed order, so that reruns add up alike
    data = sorted((r["id"], bytes(r["x"]), r["y"]) for r in rows.mapInArrow(matrix, "id long, y int, x binary").collect())
    y = np.array([int(r[2] > 0) for r in data], float)
    if not len(y) or y.min() == y.max():
        return {}
    w = fit_logistic([np.frombuffer(r[1], "<i4") for r in data], y, len(terms), prior)
    return {"": float(w[-1]), **{t: float(x) for t, x in zip(terms, w)}}


# -- scoring ----------------------------------------------------------------------------------

def score(docs: DataFrame, terms: dict[str, float], decoder: Decoder, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_terms`` for every row."""
    base = terms.get("", 0.0)
    terms = {t: w for t, w in terms.items() if t}
    index = word_index(t for t, w in terms.items() if w > 0 and not t.endswith("~"))
    four, five = first_letters(terms)

    def work(batches):
        for batch in batches:
            scores, hits = [], []
            for value in batch.column(1):
                text = value.as_py()
                found = known_terms(restored_words(text, decoder, index), terms, four, five) if text else ()
                odds = base + math.fsum(terms[t] for t in found)
                scores.append(round(1 / (1 + math.exp(-max(-40.0, odds))), 6) if found else BASE)
                n = len(found)
                hits.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.int64())], ["doc_id", "score", "n_terms"])
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, score double, n_terms long")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_terms")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    decoder = Decoder(*count_characters(docs))
    return score(docs, learn_terms(docs, labels, decoder, **options), decoder)
