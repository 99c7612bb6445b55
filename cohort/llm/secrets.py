"""Secret scan (operator 3): fixed patterns, and values in credential contexts by guess cost.

Base findings are three patterns: assignments to a credential word, access-key ids and long
hexadecimal runs. The added findings look at values in wider credential contexts ("pwd is x",
"bearer x", "passphrase: x", "login/x") and ask how many guesses an attacker would need: a
dynamic program splits the value into dictionary words (with letter case and look-alike
characters), dates, repeats, keyboard walks and brute-force spans at the least total cost, in
the manner of Wheeler's published low-budget password strength estimate. A value of at least
``MIN_GUESSES`` (log10) guesses is reported; "password: your password here" is not.

The dictionary is counted over all documents: the ``RANKS`` most frequent words of three to
``MAX_SEGMENT`` letters that occur in at least ``MIN_DOCS`` documents, ranked by documents, after
the fixed words attackers try first. The bound is what the broadcast table may hold (about 20 MB);
a word beyond it is priced by brute force, as is one that too few documents use. Values in credential
contexts are not counted, so that a secret in many copies of a document does not become a word, nor
are tokens with a digit.

Offsets are code points, ends exclusive. The word count is an aggregate with partial counts per
task; the scan is a map over rows: memory of one text, its findings and the word table, and any
lost task is simply run again. The dynamic program is linear in
the value's length (segments are at most ``MAX_SEGMENT`` long, brute force grows by character).

Edge cases: a null text is empty and yields zero counts and the hash of the empty string; null
ids, repeated rows and extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")          # a run of 24 or more is the same as a longer run of a greedy match
KINDS = ("assign", "access", "hex", "guess")

CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth|bearer|login)"""
    r"""["']?(?:\x20+is)?(?:\x20*(?::=|=>|[:=])\x20*|\x20+is\x20+|(?<=bearer)\x20+)["']?([!-~]{6,})""", re.I | re.A)
TRIM = "\"'`.,;:!?)]}>"
EDGES = " \t\n\x0b\x0c\r.,;:!?\"'`()[]{}<>*|-=/"

MIN_GUESSES = 8.0
MAX_SEGMENT = 32
RANKS = 200_000         #: words in the broadcast table
MIN_DOCS = 5            #: documents that must use a word
YEAR = 2020             #: years near this one are guessed first
SEGMENT_COST = 0.3      #: log10 of what one more segment multiplies the guesses by

#: Words that attackers try first, in order of use.
WORDS = (
    "password pass word admin login welcome monkey dragon master hello freedom whatever qazwsx trustno letmein shadow "
    "sunshine princess football baseball superman batman iloveyou starwars computer internet secret token test guest "
    "user root default changeme change your here example sample demo key access private public temp love summer winter "
    "spring autumn monday friday january march april june july august october december the and for you").split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_WORD = re.compile(r"[^\W\d_]+")
LOOKALIKE = str.maketrans({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(a, b) for r in ROWS for a, b in zip(r, r[1:])} | {(b, a) for r in ROWS for a, b in zip(r, r[1:])}
_DATE = re.compile(r"(?:\d{4}([-/._]?)\d{1,2}\1\d{1,2}|\d{1,2}([-/._]?)\d{1,2}\2\d{4}|(?:19|20)\d\d)")


def _classes(s: str) -> float:
    """log10 of the alphabet a brute-force search over these characters needs."""
    n = 0
    for test, size in ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10)):
        n += size * any(test(c) for c in s)
    return math.log10(n + 33 * any(not c.isalnum() for c in s) or 1)


def word_ranks(docs: DataFrame, text_col: str = "text", ranks: int = RANKS, min_docs: int = MIN_DOCS) -> dict[str, int]:
    """Lower-cased word -> rank by the number of documents that use it, after the fixed words."""
    def work(batches):
        seen: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["w", "c"])
            seen.clear()
            return out
        for batch in batches:
            for value in batch.column(0):
                # a word is what stands between spaces, without punctuation at its ends: no piece of a random string
                text = CONTEXT.sub(lambda m: m.group()[:m.start(1) - m.start()], value.as_py() or "")
                found = {t.strip(EDGES) for t in set(text.lower().split())}
                seen.update(w for w in found if 3 <= len(w) <= MAX_SEGMENT and _WORD.fullmatch(w))
            if len(seen) > 1_000_000:
                yield rows()
        yield rows()
    counts = docs.select(text_col).mapInArrow(work, "w string, c long").groupBy("w").agg(F.sum("c").alias("c"))
    top = counts.where(F.col("c") >= min_docs).orderBy(F.desc("c"), "w").limit(ranks).collect()
    out = dict(RANK)
    for r in top:
        out.setdefault(r["w"], len(out) + 1)
    return out


def guess_cost(value: str, max_segment: int = MAX_SEGMENT, words: dict[str, int] = RANK) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the least number of guesses, and the segments (kind, start, end) that reach it."""
    n = len(value)
    low = value.lower()
    plain = low.translate(LOOKALIKE)
    unit = _classes(value)
    best = [math.inf] * (n + 1)
    best[0] = 0.0
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    walk = rep = 0          # lengths of the keyboard walk and of the repeat that end here
    dates: dict[int, list[int]] = {}
    for i in range(n):
        m = _DATE.match(value, i) if value[i].isdigit() else None
        if m and len(m.group()) <= max_segment:
            dates.setdefault(m.end(), []).append(i)
    for j in range(1, n + 1):
        # brute force: one more character, or the start of a span
        opened = 0.0 if back[j - 1][0] == "brute" else SEGMENT_COST
        options = [(best[j - 1] + unit + opened, "brute", j - 1)]
        walk = walk + 1 if j > 1 and (low[j - 2], low[j - 1]) in _NEXT else 1
        rep = rep + 1 if j > 1 and low[j - 2] == low[j - 1] else 1
        if walk >= 3:
            i = j - min(walk, max_segment)
            options.append((best[i] + math.log10(47 * 4 * (j - i)) + SEGMENT_COST, "walk", i))
        if rep >= 3:
            i = j - min(rep, max_segment)
            options.append((best[i] + unit + math.log10(j - i) + SEGMENT_COST, "repeat", i))
        for i in dates.get(j, ()):
            span = (abs(int(m) - YEAR) if (m := value[i:j]).isdigit() and len(m) == 4 else 0) + 20
            options.append((best[i] + math.log10(span * (1 if j - i == 4 else 365)) + SEGMENT_COST, "date", i))
        for i in range(max(0, j - max_segment), j - 2):
            word = plain[i:j]
            rank, changed = words.get(word), word != low[i:j]
            if changed and low[i:j] in words:
                rank, changed = words[low[i:j]], False
            if rank:
                cost = math.log10(rank + 1)
                cost += math.log10(2) * (value[i:j] != low[i:j]) + math.log10(2) * changed
                options.append((best[i] + cost + SEGMENT_COST, "word", i))
        # a block that repeats: abcabc costs abc once
        for size in range(2, min(8, j // 2) + 1):
            if low[j - size:j] == low[j - 2 * size:j - size]:
                options.append((best[j - size] + math.log10(2) + SEGMENT_COST, "repeat", j - size))
        best[j], kind, i = min(options)
        back[j] = (kind, i)
    spans, j = [], n
    while j > 0:
        kind, i = back[j]
        if spans and kind == "brute" == spans[-1][0]:
            spans[-1] = (kind, i, spans[-1][2])
        else:
            spans.append((kind, i, j))
        j = i
    return best[n], spans[::-1]


def find_spans(text: str, min_guesses: float = MIN_GUESSES, words: dict[str, int] = RANK) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all findings, sorted; kind 3 are the added ones."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    covered = sorted((s, e) for s, _, e in out)
    at = 0
    for m in CONTEXT.finditer(text):
        value = m.group(1).rstrip(TRIM)
        start, end = m.start(1), m.start(1) + len(value)
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if len(value) < 6 or at < len(covered) and covered[at][0] < end:
            continue
        if guess_cost(value, words=words)[0] >= min_guesses:
            out.append((start, 3, end))
    return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_guesses: float = MIN_GUESSES) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans`` for every row."""
    words = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, text_col))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"

    def work(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                found = find_spans(value.as_py() or "", min_guesses, words.value)
                counts = [sum(k == kind for _, k, _ in found) for kind in range(4)]
                text = [f"{KINDS[k]}:{s}:{e}" for s, k, e in found]
                base = ",".join(t for t, (_, k, _) in zip(text, found) if k < 3)
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(text)))
            cols = list(zip(*rows)) or [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(c, pa.string()) for c in cols[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [f.split()[0] for f in schema.split(", ")])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)
