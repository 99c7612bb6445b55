"""Exact substring dedup over a distributed sparse suffix array (operator 1).

Every byte of a text that lies in a ``LENGTH``-byte string which also starts in a document with a
smaller id is removed; strings are judged on the input and never cross documents.

Sorting all suffixes would move many times the input, so the array is sparse: of the windows of
``LENGTH`` bytes, each selects the 8-byte gram with the least hash, and the suffixes kept are those
that start there, or ``HALF`` bytes before it if the window reaches that far left. Equal windows
select alike, so each window belongs to one kept suffix, at most ``HALF - 1`` bytes into the window,
and shares at least ``REACH`` leading bytes with every equal one.

1. Documents are packed into batches, written once to the shared folder.
2. Fingerprints of the leading ``REACH`` bytes go to hash parts, once per batch (so copies combine
   first); a suffix whose fingerprint occurs in one document only cannot match and is left out.
   A false alarm costs a comparison, never a result.
3. The remaining suffixes, each distinct context once per batch with its smallest id, are dealt by
   sampled splitters over their leading bytes. Each part sorts its suffixes by multikey quicksort
   (8-byte characters) and compares neighbours. Splitters never separate suffixes that agree in
   the bytes they are cut by, and windows agree in more, so a run of equal suffixes lies within
   one part and no match can straddle a boundary.
4. For each offset the sorted neighbours that agree in the right part of the window, and in the
   bytes left of the suffix, form groups; the smallest id of a group owns its window.
5. Verdicts go back to the batches, which cut the texts.

Memory of a task is a batch or a part; the number of parts follows the bytes. Nothing of the size of
the input reaches the driver (a bounded sample of leading bytes does).

Edge cases: null and empty texts have no bytes; a null id counts as larger than all others; rows with
one id do not remove each other's text; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import Scratch
from .lm import _pack, _unpack
from .neardup import _groups

LENGTH = 50
GRAM = 8
HALF = 22               #: a suffix starts 0 to HALF - 1 bytes into its windows
REACH = LENGTH - HALF + 1
LEAD = 24               #: leading bytes that splitters look at, fewer than REACH
BATCH_BYTES = 6 << 20
PART_BYTES = 24 << 20
SAMPLE_BATCHES, SAMPLE_EACH = 16, 2_000
LARGEST = np.iinfo(np.int64).max


# -- batches ------------------------------------------------------------------------------------

def pack_batches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``batch, part, data``: ids, whether an id is null, lengths and the texts of about ``batch_bytes`` of documents."""
    def work(batches):
        task, i = TaskContext.get().partitionId(), 0
        ids, lengths, texts, size = [], [], [], 0

        def out():
            meta = _pack(np.array([LARGEST if x is None else x for x in ids], np.int64).view(np.uint64),
                         np.array([x is None for x in ids], np.uint64), np.array(lengths, np.uint64))
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | i]), pa.array([size]), pa.array([meta], pa.binary()),
                                               pa.array([body], pa.binary())], ["batch", "size", "meta", "body"])
        for batch in batches:
            for doc, value in zip(batch.column("id").to_pylist(), batch.column("text")):
                text = (value.as_py() or "").encode("utf-8")
                if size and size + len(text) > batch_bytes:
                    yield out()
                    ids, lengths, texts, size, i = [], [], [], 0, i + 1
                ids.append(doc)
                lengths.append(len(text))
                texts.append(text)
                size += len(text)
        if ids:
            yield out()
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        work, "batch long, size long, meta binary, body binary")


def unpack_batch(meta: bytes, body: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, null flags, offsets and bytes."""
    ids, null, lengths = _unpack(meta)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=size + 64), np.uint8)
    return ids.view(np.int64), null.astype(bool), np.r_[0, np.cumsum(lengths.astype(np.int64))], data


# -- suffixes -----------------------------------------------------------------------------------

def _grams(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Big-endian 8-byte words of ``data`` (which must go on for 8 bytes) at all or at the given positions."""
    view = np.lib.stride_tricks.as_strided(data, (len(data) - GRAM + 1, GRAM), (1, 1))
    return np.ascontiguousarray(view if at is None else view[at]).view(">u8").ravel().astype(np.uint64)


def kept_suffixes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept suffixes, sorted, and for each the offsets (bit o) of the windows it stands for."""
    qs, masks = [], []
    span, step = LENGTH - GRAM + 1, 1 << 20
    for base in range(0, max(0, len(data) - LENGTH + 1), step):
        part = data[base:min(len(data), base + step + LENGTH - 1)]
        x = tn.mix(_grams(part))
        x = (x & ~np.uint64(0xFFFFFF)) | np.arange(len(x), dtype=np.uint64)      # leftmost of equal grams
        width = 1
        while width * 2 <= span:
            x = np.minimum(x[:-width], x[width:])
            width *= 2
        x = np.minimum(x[:len(x) - (span - width)], x[span - width:])
        n = min(step, len(part) - LENGTH + 1)
        p = (x[:n] & np.uint64(0xFFFFFF)).astype(np.int64) + base
        s = np.arange(base, base + n)
        end = offsets[np.searchsorted(offsets, s, "right")]
        whole = s + LENGTH <= end
        far = p - s >= HALF
        # runs of windows with one gram and one side
        key = np.where(whole, p * 2 + far, -1)
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        last = np.r_[cut[1:], n] - 1
        good = key[cut] >= 0
        cut, last = cut[good], last[good]
        q = p[cut] - HALF * far[cut]
        low, count = q - s[last], (last - cut + 1)
        qs.append(q)
        masks.append(((np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)) << low.astype(np.uint64))
    if not qs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    q, mask = np.concatenate(qs), np.concatenate(masks)
    order = np.argsort(q, kind="stable")
    q, mask = q[order], mask[order]
    at = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    return q[at], np.bitwise_or.reduceat(mask, at) if len(at) else mask


def _fingerprints(data: np.ndarray, q: np.ndarray) -> np.ndarray:
    """64-bit hash of the REACH bytes from each position."""
    h = np.zeros(len(q), np.uint64)
    if not len(q):
        return h
    for o in (*range(0, REACH - GRAM, GRAM), REACH - GRAM):
        h = tn.mix(h + _grams(data, q + o))
    return h


def _entries(data: np.ndarray, offsets: np.ndarray, n_parts: int):
    """Kept suffixes in the order of (part, fingerprint): positions, masks, documents, starts of equal fingerprints."""
    q, mask = kept_suffixes(data, offsets)
    h = _fingerprints(data, q)
    part, fp = h % np.uint64(n_parts), (tn.mix(h) >> np.uint64(32)).astype(np.uint64)
    order = np.lexsort((fp, part))
    q, mask, part, fp = q[order], mask[order], part[order], fp[order]
    doc = np.searchsorted(offsets, q, "right") - 1
    new = np.ones(len(q), bool)
    new[1:] = (part[1:] != part[:-1]) | (fp[1:] != fp[:-1])
    return q, mask, doc, part, fp, np.flatnonzero(new)


def _many(doc: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which fingerprints occur in more than one document (by id) of the batch."""
    own = ids[doc]
    return (np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)) if len(at) else np.zeros(0, bool)


def multikey_quicksort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``words`` (strings of 8-byte characters), and for each row in that order how many
    leading characters it shares with the row before.

    Character by character: each step sorts only the rows that are still equal, group by group.
    """
    n, m = words.shape
    order, shared = np.arange(n), np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)               # rows of a group are equal so far and neighbours in order
    active = np.arange(n)
    for c in range(m):
        if not len(active):
            break
        rows = order[active]
        perm = np.lexsort((words[rows, c], group[active]))
        order[active] = rows[perm]
        value, g = words[order[active], c], group[active]
        same = np.zeros(len(active), bool)
        same[1:] = (g[1:] == g[:-1]) & (value[1:] == value[:-1])
        shared[active[same]] = c + 1
        ident = np.cumsum(~same)
        group[active] = ident
        size = np.bincount(ident)
        active = active[size[ident] > 1]
    return order, shared


def owners(right: np.ndarray, left: np.ndarray, mask: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bit o of the result: the window o bytes left of the suffix also starts in a document with a smaller id.

    ``right`` has LENGTH bytes from each suffix, ``left`` the HALF - 1 bytes before it, nearest first.
    """
    n = len(ids)
    padded = np.zeros((n, -(-LENGTH // 8) * 8), np.uint8)
    padded[:, :LENGTH] = right
    words = padded.view(">u8").astype(np.uint64)
    order, shared = multikey_quicksort(words)
    right, left, mask, ids = right[order], left[order], mask[order], ids[order]
    # bytes shared with the suffix before
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = right[1:] != right[:-1]
        lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    found = np.zeros(n, np.uint64)
    before = np.zeros(n, np.uint64)             # hash of the o bytes left of the suffix
    for o in range(HALF):
        if o:
            before = tn.mix(before + left[:, o - 1] + np.uint64(1))
        has = (mask >> np.uint64(o)) & np.uint64(1) > 0
        group = np.cumsum(lcp < LENGTH - o)
        rows = np.flatnonzero(has)
        if len(rows) < 2:
            continue
        key = tn.mix(tn.mix(group[rows].astype(np.uint64) ^ np.uint64(0x6A09E667F3BCC909)) + before[rows])
        by = np.argsort(key, kind="stable")
        rows, key = rows[by], key[by]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least = np.repeat(np.minimum.reduceat(ids[rows], at), np.diff(np.r_[at, len(rows)]))
        found[rows[ids[rows] > least]] |= np.uint64(1) << np.uint64(o)
    out = np.empty(n, np.uint64)
    out[order] = found
    return out


# -- the job ------------------------------------------------------------------------------------

def removed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES,
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row; ``kept`` are the remaining bytes."""
    scratch = Scratch(docs.sparkSession, "substrings")
    texts = scratch.write(pack_batches(docs, id_col, text_col, batch_bytes), "batches")
    total = texts.agg(F.sum("size")).first()[0] or 0
    n_parts = max(1, -(-total // part_bytes))
    columns = ("batch", "size", "meta", "body")

    def batch_rows(batches):
        for b in batches:
            for batch, size, meta, body in zip(*(b.column(c) for c in columns)):
                yield batch.as_py(), unpack_batch(meta.as_py(), body.as_py(), size.as_py())

    def fingerprints(batches):
        for batch, (ids, _, offsets, data) in batch_rows(batches):
            _, _, _, part, fp, at = _entries(data, offsets, n_parts)
            part, fp = part[at], fp[at]
            cuts = np.searchsorted(part, np.arange(n_parts + 1))
            out = [(p, _pack(np.diff(fp[cuts[p]:cuts[p + 1]], prepend=np.uint64(0)))) for p in range(n_parts) if cuts[p] < cuts[p + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([batch] * len(out), pa.int64()),
                                              pa.array([d for _, d in out], pa.binary())], ["part", "batch", "data"])

    def shared(batches):
        """Per batch and part a bit for each fingerprint: it occurs in another batch too."""
        for table, bounds in _groups(batches, "part"):
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                lists = [np.cumsum(_unpack(d.as_py())[0]).astype(np.uint32) for d in table.column("data")[lo:hi]]
                every = np.sort(np.concatenate(lists))
                twice = np.unique(every[1:][every[1:] == every[:-1]])
                bits = []
                for own in lists:
                    i = np.minimum(np.searchsorted(twice, own), max(0, len(twice) - 1))
                    bits.append(np.packbits(twice[i] == own if len(twice) else np.zeros(len(own), bool)).tobytes())
                yield pa.RecordBatch.from_arrays([table.column("batch")[lo:hi].combine_chunks(), table.column("part")[lo:hi].combine_chunks(),
                                                  pa.array(bits, pa.binary())], ["batch", "part", "bits"])

    # splitters over the leading bytes of a bounded sample of suffixes; they only balance the parts
    some = texts.select("batch").orderBy(F.xxhash64("batch")).limit(SAMPLE_BATCHES)

    def sample(batches):
        for _, (_, _, offsets, data) in batch_rows(batches):
            q, _ = kept_suffixes(data, offsets)
            q = q[np.argsort(tn.mix(_grams(data, q)))[:SAMPLE_EACH]] if len(q) else q
            yield pa.RecordBatch.from_arrays([pa.array([data[x:x + LEAD].tobytes() for x in q], pa.binary())], ["lead"])
    leads = sorted(bytes(r["lead"]) for r in texts.join(F.broadcast(some), "batch", "left_semi").mapInArrow(sample, "lead binary").collect())
    splitters = np.array([leads[len(leads) * i // n_parts] for i in range(1, n_parts)] if leads else [], dtype=f"S{LEAD}")

    def candidates(batches):
        """Batch rows with their bits to records per range part, and to verdicts that need no other batch."""
        for table, bounds in _groups(batches, "batch"):
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                group = table.slice(lo, hi - lo).to_pylist()
                row = next(r for r in group if r["body"] is not None)
                ids, _, offsets, data = unpack_batch(row["meta"], row["body"], row["size"])
                q, mask, doc, part, fp, at = _entries(data, offsets, n_parts)
                flags = _many(doc, ids, at)
                cuts = np.searchsorted(part[at], np.arange(n_parts + 1))
                for r in group:
                    if r["bits"] is not None:
                        a, b = cuts[r["part"]], cuts[r["part"] + 1]
                        flags[a:b] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a).astype(bool)
                keep = np.repeat(flags, np.diff(np.r_[at, len(q)]))
                q, mask, doc = q[keep], mask[keep], doc[keep]
                if not len(q):
                    continue
                wide = np.concatenate([np.zeros(HALF, np.uint8), data, np.zeros(LENGTH, np.uint8)])
                view = np.lib.stride_tricks.as_strided(wide, (len(data) + 1, HALF + LENGTH), (1, 1))
                context = np.ascontiguousarray(view[q])
                # bytes outside of the windows do not count
                reach = np.frexp(mask.astype(np.float64))[1] - 1                                # largest offset
                least = np.frexp((mask & (~mask + np.uint64(1))).astype(np.float64))[1] - 1     # smallest offset
                place = np.arange(HALF + LENGTH)[None, :]
                context[(place < HALF - reach[:, None]) | (place >= HALF + LENGTH - least[:, None])] = 0
                own = ids[doc]
                padded = np.zeros((len(q), 80), np.uint8)
                padded[:, :HALF + LENGTH] = context
                padded[:, 72:80] = mask.astype(">u8").view(np.uint8).reshape(-1, 8)
                words = padded.view(">u8").astype(np.uint64)
                h = np.zeros(len(q), np.uint64)
                for c in range(words.shape[1]):
                    h = tn.mix(h + words[:, c])
                order = np.lexsort((own, h))
                q, mask, own, context, h = q[order], mask[order], own[order], context[order], h[order]
                new = np.r_[True, h[1:] != h[:-1]]
                first = np.flatnonzero(new)[np.cumsum(new) - 1]
                # a context seen under a smaller id of the batch is owned there, whatever other batches hold
                local = own > own[first]
                out = [(-1, row["batch"], _pack(q[local].astype(np.uint64), mask[local]), b"")] if local.any() else []
                q, mask, own, context = q[~local], mask[~local], own[~local], context[~local]
                lead = np.ascontiguousarray(context[:, HALF:HALF + LEAD]).view(f"S{LEAD}").ravel()
                target = np.searchsorted(splitters, lead, "right")
                order = np.lexsort((lead, target))
                cuts = np.searchsorted(target[order], np.arange(n_parts + 1))
                tool = zstandard.ZstdCompressor(level=1)
                for p in range(n_parts):
                    sel = order[cuts[p]:cuts[p + 1]]
                    if len(sel):
                        out.append((p, row["batch"], _pack(q[sel].astype(np.uint64), mask[sel], own[sel].view(np.uint64)),
                                    tool.compress(context[sel].tobytes())))
                cols = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()),
                                                  pa.array(cols[3], pa.binary())], ["part", "batch", "data", "text"])

    def judge(batches):
        """Records of a range part to the windows of each batch that are owned elsewhere."""
        for table, bounds in _groups(batches, "part"):
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                group = table.slice(lo, hi - lo)
                if group.column("part")[0].as_py() < 0:
                    yield from group.select(["batch", "data"]).combine_chunks().to_batches()
                    continue
                data = [_unpack(d.as_py()) for d in group.column("data")]
                size = [len(d[0]) for d in data]
                context = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(
                    t.as_py(), max_output_size=n * (HALF + LENGTH) + 64), np.uint8).reshape(n, HALF + LENGTH)
                    for t, n in zip(group.column("text"), size)])
                q, mask, own = (np.concatenate(x) for x in zip(*data))
                found = owners(context[:, HALF:], context[:, HALF - 1:0:-1], mask, own.view(np.int64))
                cuts = np.r_[0, np.cumsum(size)]
                out = []
                for i, batch in enumerate(group.column("batch").to_pylist()):
                    a, b = cuts[i], cuts[i + 1]
                    hit = found[a:b] > 0
                    if hit.any():
                        out.append((batch, _pack(q[a:b][hit], found[a:b][hit])))
                cols = list(zip(*out)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], ["batch", "data"])

    def cut(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for table, bounds in _groups(batches, "batch"):
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                group = table.slice(lo, hi - lo).to_pylist()
                row = next(r for r in group if r["body"] is not None)
                ids, null, offsets, data = unpack_batch(row["meta"], row["body"], row["size"])
                edge = np.zeros(len(data) + 1, np.int32)
                for r in group:
                    if r["data"] is not None:
                        q, found = _unpack(r["data"])
                        for o in range(HALF):
                            s = q[(found >> np.uint64(o)) & np.uint64(1) > 0].astype(np.int64) - o
                            np.add.at(edge, s, 1)
                            np.add.at(edge, s + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = offsets[(offsets > 0) & (offsets < len(data))]
                begins[inner] = gone[inner]
                counts = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(begins)]
                kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64(), mask=null), pa.array(np.diff(offsets)), pa.array(np.diff(counts[0][offsets]).astype(np.int64)),
                    pa.array(np.diff(counts[1][offsets]).astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                    pa.array(kept, pa.binary())], names)

    prints = texts.mapInArrow(fingerprints, "part int, batch long, data binary")
    bits = prints.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(shared, "batch long, part int, bits binary")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    whole = texts.select(*columns, null("int", "part"), null("binary", "bits"))
    asked = bits.select("batch", null("long", "size"), null("binary", "meta"), null("binary", "body"), "part", "bits")
    records = whole.union(asked).repartition(n_parts, "batch").sortWithinPartitions("batch").mapInArrow(
        candidates, "part int, batch long, data binary, text binary")
    spread = F.when(F.col("part") < 0, F.col("batch")).otherwise(F.col("part"))
    verdicts = records.repartition(n_parts, spread).sortWithinPartitions("part").mapInArrow(judge, "batch long, data binary")
    whole = texts.select(*columns, null("binary", "data"))
    said = verdicts.select("batch", null("long", "size"), null("binary", "meta"), null("binary", "body"), "data")
    return whole.union(said).repartition(n_parts, "batch").sortWithinPartitions("batch").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def substring_dedup(docs: DataFrame, **options) -> DataFrame:
    """The contract's columns for every document."""
    return removed_text(docs, **options).drop("kept")
