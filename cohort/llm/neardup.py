"""Near-duplicate documents by a chosen-path set similarity join (operator 6).

Documents are sets of five-word shingles; two are linked if their Jaccard similarity is at
least 0.75, and linked documents form components (Christiani and Pagh's chosen path, in the
form of Christiani, Pagh and Sivertsen's recursive join).

1. Equal sets become one representative, the smallest id, by an aggregate; copies cost
   nothing further. Each representative gets ``coords`` minwise tokens.
2. ``trees`` independent trees: a node picks ``fanout`` coordinates by a hash of its path, and
   a document goes to one child per picked coordinate, named by its token there. With fan-out
   2 a pair of similarity 0.75 has 1.5 expected common children. A tree parts it within one,
   two or three levels with probability 0.063, 0.088 or 0.100, all of six trees with 6e-8,
   5e-7 or 1e-6. Trees end there: ``LEVELS`` is three.
3. Nodes of at most ``leaf`` documents are compared exhaustively inside a task. In a larger node
   every document is compared with one pivot; verified links are contracted to components, and
   nodes that still hold more than one component branch again. What is in large nodes of the
   last level, or of any level once it is ``direct`` documents or less, is compared by prefix
   blocks, which part no pair: of two sets of similarity
   0.75 or more, the rarest ``n - ceil(0.75 n) + 1`` shingles of each (in one order for all)
   have one in common, so a block per such shingle holds every pair. A block of more than
   ``leaf`` documents is compared in pieces, each pair of pieces in a task. So the miss does not
   grow with depth: at most 1e-6 for a pair of similarity 0.75, and less above.
4. Candidates whose tokens agree in at least ``floor`` of the coordinates (0.75 expected, 4.6
   deviations less by default, about 3e-6 of such pairs) are verified on the full shingle sets. A pair that earlier links
   already join needs no check, since the result is components, and of the nodes of the first
   level that hold a pair only the first small one checks it.

Only signatures and links travel through the trees; shingle sets are computed from the texts
of candidate documents only. Nothing is collected; each step is written to the shared folder.

Edge cases: null and empty texts have no shingle and stay alone; rows that repeat an id are
one node, linked by that id; rows with a null id are never linked and are kept, with a null
component; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import SHINGLE, Scratch
from .components import components
from .sieve import bitmap, in_bitmap

COORDS = 64
TREES = 6
FANOUT = 2
LEVELS = 3
LEAF = 1024
DIRECT = 50_000               #: documents that prefix blocks take without further levels
PATIENCE = 4
PREFIX_BUCKETS = 1 << 18      #: of shingle counts that order the prefixes; fewer only make blocks larger
PREFIX_BITS = 21              #: of the bitmap of prefix shingles of more than one component; fewer only make more rows
FLOOR = 0.5
PERCENT = 75
BROADCAST_IDS = 20_000

_SIG = "id long, n long, s1 long, s2 long, sig binary"


def _coefficients(coords: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return (rng.integers(0, 2 ** 63, coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).reshape(-1, 1), \
        rng.integers(0, 2 ** 63, coords, dtype=np.uint64).reshape(-1, 1)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for row, end, data, offsets in tn.slices(batch.column("text")):
        hashes, first = tn.word_hashes(data, offsets, lower=True)
        for i in range(end - row):
            yield row + i, tn.shingle_sets(hashes[first[i]:first[i + 1]], k)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coords: int = COORDS, k: int = SHINGLE) -> DataFrame:
    """``id, n, s1, s2, sig``: set size, 128-bit digest of the set and minwise tokens of every row."""
    def work(batches):
        a, b = _coefficients(coords)
        for batch in batches:
            out_n, out_1, out_2, out_s = [], [], [], []
            for _, s in _sets(batch, k):
                out_n.append(len(s))
                out_1.append(s.sum(dtype=np.uint64))
                out_2.append(tn.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                out_s.append(((s * a + b) >> np.uint64(32)).min(axis=1).astype("<u4").tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(out_n, pa.int64()), pa.array(np.array(out_1, np.uint64).astype(np.int64)),
                pa.array(np.array(out_2, np.uint64).astype(np.int64)), pa.array(out_s, pa.binary())], ["id", "n", "s1", "s2", "sig"])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, _SIG)


def _child_paths(path: np.ndarray, sig: np.ndarray, coords: int, fanout: int) -> list[np.ndarray]:
    """Paths of the ``fanout`` children of each row's node; different coordinates for the picks of one node."""
    picks, part, rows, out = tn.mix(path ^ np.uint64(0xD6E8FEB86659FD93)), np.uint64(coords // fanout), np.arange(len(path)), []
    for f in range(fanout):
        pick = ((picks >> np.uint64(8 * f)) + np.uint64(f) * part) % part + np.uint64(f) * part
        token = sig[rows, pick.astype(np.int64)].astype(np.uint64)
        out.append(tn.mix(tn.mix(path + np.uint64(f + 1)) ^ tn.mix(token + (pick << np.uint64(32)))).view(np.int64))
    return out


def _first_nodes(sig: np.ndarray, trees: int, coords: int, fanout: int) -> np.ndarray:
    """Paths of each row's nodes of the first level, a column per tree and pick."""
    return np.stack([p for t in range(trees) for p in _child_paths(np.full(len(sig), t, np.uint64), sig, coords, fanout)], axis=1)


def _children(nodes: DataFrame, coords: int, fanout: int) -> DataFrame:
    """Rows (path, id, s1, sig) of nodes to rows (path, id, s1) of their children."""
    def work(batches):
        for batch in batches:
            path = batch.column("path").to_numpy().view(np.uint64) if batch.num_rows else np.zeros(0, np.uint64)
            if not len(path):
                continue
            paths = _child_paths(path, _matrix(batch.column("sig"), coords), coords, fanout)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(paths)), pa.concat_arrays([batch.column("id")] * fanout),
                pa.concat_arrays([batch.column("s1")] * fanout)], ["path", "id", "s1"])
    return nodes.select("path", "id", "s1", "sig").mapInArrow(work, "path long, id long, s1 long")


def _matrix(column: pa.ChunkedArray | pa.Array, coords: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, coords)


def _groups(batches, key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a partition sorted by ``key``: tables and the bounds of their groups."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield table.slice(0, cut), np.flatnonzero(np.r_[True, keys[1:cut] != keys[:cut - 1], True])
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        keys = rest.column(key).to_numpy()
        yield rest, np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])


def _promising(members: DataFrame, coords: int, floor: float, percent: int, first: tuple | None = None) -> DataFrame:
    """Members (path, id, s1, n, comp, sig) of small nodes that may be similar to a member of another component there.

    With ``first`` (see ``_near``) their ``slot`` says which of a row's nodes of the first level it is."""
    def work(batches):
        for table, bounds in _groups(batches, "path"):
            sig, comp, n = _matrix(table.column("sig"), coords), table.column("comp").to_numpy(), table.column("n").to_numpy()
            keep, slot = np.zeros(table.num_rows, bool), np.full(table.num_rows, -1, np.int32)
            nodes = None
            if first is not None:
                nodes = _first_nodes(sig, first[0], coords, first[1])
                slot = (nodes == table.column("path").to_numpy()[:, None]).argmax(axis=1).astype(np.int32)
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                before = None if first is None else _earlier(nodes[lo:hi], slot[lo], first[2].value)
                keep[lo:hi] = _near(sig[lo:hi], comp[lo:hi], n[lo:hi], floor, percent, before).any(axis=1)
            table = table.append_column("slot", pa.array(slot))
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()
    schema = "path long, id long, s1 long, n long, comp long, sig binary, slot int"
    return members.select("path", "id", "s1", "n", "comp", "sig").repartition("path").sortWithinPartitions("path").mapInArrow(work, schema)


def _earlier(nodes: np.ndarray, slot: int, large: np.ndarray) -> np.ndarray:
    """Which pairs of a node's rows meet in an earlier small node too: they are compared there."""
    out = np.zeros((len(nodes), len(nodes)), bool)
    for j in range(slot):
        small = ~np.isin(nodes[:, j], large) if len(large) else np.ones(len(nodes), bool)
        out |= (nodes[:, None, j] == nodes[None, :, j]) & small[:, None]
    return out


def _near(sig: np.ndarray, comp: np.ndarray, n: np.ndarray, floor: float, percent: int, before: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of a node lie in different components, fit in size, agree in enough coordinates and were not met ``before``."""
    same = np.zeros((len(sig), len(sig)), np.int16)
    for j in range(sig.shape[1]):
        same += sig[:, j, None] == sig[None, :, j]
    fits = 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    fits &= (comp[:, None] != comp[None, :]) & (same >= floor * sig.shape[1])
    return np.where(fits if before is None else fits & ~before, same, 0)


def _shared(own: list[np.ndarray], some: np.ndarray, slab: int = 2048) -> np.ndarray:
    """Intersection sizes of the sets numbered ``some`` with all other sets, by products of their incidence matrices."""
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    col, often = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)[1:]
    often = often > 1                             # a shingle of one set is in no intersection
    row, col = row[often[col]], (np.cumsum(often) - 1)[col[often[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(some), len(own)), np.float32)
    for lo in range(0, int(often.sum()), slab):
        a, b = np.searchsorted(col, [lo, lo + slab])
        x = np.zeros((len(own), slab), np.float32)
        x[row[a:b], col[a:b] - lo] = 1
        out += x[some] @ x.T
    return out


def _links(own: list[np.ndarray], comp: np.ndarray, same: np.ndarray, percent: int, patience: int = PATIENCE) -> list[tuple[int, int]]:
    """Pairs of similar sets that join the components of a node; the most alike of the pairs that ``same`` rates come first,
    and a pair that links found before already join is not checked.

    Once more than ``patience`` checks a set have failed, the rest is checked by matrix products."""
    x, y = np.nonzero(same)
    order = np.argsort(-same[x, y], kind="stable")
    x, y, label, found, failed = x[order], y[order], np.unique(comp, return_inverse=True)[1], [], 0

    def join(i: int, j: int) -> None:
        label[label == label[j]] = label[i]
        found.append((i, j))
    for at, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        if label[i] != label[j]:
            both = len(np.intersect1d(own[i], own[j], assume_unique=True))
            if 100 * both >= percent * (len(own[i]) + len(own[j]) - both):
                join(i, j)
            elif (failed := failed + 1) > patience * len(own):
                break
    else:
        return found
    apart = label[x] != label[y]
    x, y = x[apart], y[apart]
    some = label != np.bincount(label).argmax()   # of two sets in different components one is not in the largest
    x, y = np.where(some[x], x, y), np.where(some[x], y, x)
    both = _shared(own, np.flatnonzero(some))[(np.cumsum(some) - 1)[x], y].astype(np.int64)
    size = np.array([len(s) for s in own])
    ok = 100 * both >= percent * (size[x] + size[y] - both)
    for i, j in zip(x[ok].tolist(), y[ok].tolist()):
        if label[i] != label[j]:
            join(i, j)
    return found


def _links_in_nodes(members: DataFrame, sets: DataFrame, coords: int, floor: float, percent: int, first: tuple | None = None) -> DataFrame:
    """Links ``u, v`` found by comparing full sets across the components of each small node."""
    def work(batches):
        for table, bounds in _groups(batches, "path"):
            sig, comp, n = _matrix(table.column("sig"), coords), table.column("comp").to_numpy(), table.column("n").to_numpy()
            ids, full, slot = table.column("id").to_numpy(), table.column("set"), table.column("slot").to_numpy()
            nodes = None if first is None else _first_nodes(sig, first[0], coords, first[1])
            us, vs = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                before = None if first is None else _earlier(nodes[lo:hi], slot[lo], first[2].value)
                same = np.triu(_near(sig[lo:hi], comp[lo:hi], n[lo:hi], floor, percent, before))
                if same.any():
                    own = [np.frombuffer(full[i].as_py(), "<u8") for i in range(int(lo), int(hi))]
                    for i, j in _links(own, comp[lo:hi], same, percent):
                        us.append(ids[lo + i])
                        vs.append(ids[lo + j])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
    rows = members.join(sets, ["id", "s1"]).select("path", "id", "n", "comp", "sig", "slot", "set")
    return rows.repartition("path").sortWithinPartitions("path").mapInArrow(work, "u long, v long")


def _agreeing(pairs: DataFrame, reps: DataFrame, coords: int, floor: float) -> DataFrame:
    """Pairs (a, a1, b, b1) whose signatures agree in at least ``floor`` of the coordinates."""
    def work(batches):
        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column("sa"), coords) == _matrix(batch.column("sb"), coords)).sum(axis=1)
                yield batch.filter(pa.array(same >= floor * coords)).select(["a", "a1", "b", "b1"])
    left = reps.select(F.col("id").alias("a"), F.col("s1").alias("a1"), F.col("sig").alias("sa"))
    right = reps.select(F.col("id").alias("b"), F.col("s1").alias("b1"), F.col("sig").alias("sb"))
    both = pairs.join(left, ["a", "a1"]).join(right, ["b", "b1"]).select("a", "a1", "b", "b1", "sa", "sb")
    return both.mapInArrow(work, "a long, a1 long, b long, b1 long")


def _full_sets(docs: DataFrame, wanted: DataFrame, n_wanted: int, id_col: str, text_col: str, k: int) -> DataFrame:
    """``id, s1, set`` of the wanted (id, s1): all shingle hashes, computed from the texts."""
    def work(batches):
        for batch in batches:
            sums, sets = [], []
            for _, s in _sets(batch, k):
                sums.append(s.sum(dtype=np.uint64))
                sets.append(s.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array(sums, np.uint64).astype(np.int64)),
                                              pa.array(sets, pa.binary())], ["id", "s1", "set"])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if n_wanted <= BROADCAST_IDS:
        ids = F.broadcast(wanted.select(F.col("id").alias("_id")).distinct())
        rows = rows.join(ids, F.col("id") == F.col("_id")).select("id", "text")
    else:
        # texts never travel: a bitmap of the wanted ids drops most others where they are read, the join below the rest
        sieve = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, F.xxhash64("id")))

        def sift(batches):
            for batch in batches:
                known = in_bitmap(sieve.value, batch.column("h").to_numpy().view(np.uint64))
                yield batch.filter(pa.array(known)).select(["id", "text"])
        rows = rows.select("id", "text", F.xxhash64("id").alias("h"))
        both = lambda batches: work(sift(batches))
        return _only(rows.mapInArrow(both, "id long, s1 long, set binary"), wanted)
    return _only(rows.mapInArrow(work, "id long, s1 long, set binary"), wanted)


def _only(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    return sets.join(wanted, ["id", "s1"], "left_semi").dropDuplicates(["id", "s1"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``u, v`` of the pairs whose full sets are similar enough."""
    def work(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
                p, q = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(p) + len(q) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], ["u", "v"])
    left = sets.select(F.col("id").alias("a"), F.col("s1").alias("a1"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s1").alias("b1"), F.col("set").alias("sb"))
    both = pairs.select("a", "a1", "b", "b1").join(left, ["a", "a1"]).join(right, ["b", "b1"])
    return both.select(F.col("a").alias("u"), F.col("b").alias("v"), "sa", "sb").mapInArrow(work, "u long, v long")


def _prefix_rows(members: DataFrame, sets: DataFrame, percent: int, buckets: int = PREFIX_BUCKETS, bits: int = PREFIX_BITS) -> DataFrame:
    """Rows (path, id, s1, comp): a path for each of the rarest shingles of a set that a similar set must share one of.

    A shingle whose bucket holds one set, or rare shingles of one component only, is in no pair to compare and makes no row."""
    def bucket(s: np.ndarray) -> np.ndarray:
        return (s % np.uint64(buckets)).astype(np.int64)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column("set"):
                np.add.at(total, bucket(np.frombuffer(x.as_py(), "<u8")), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["b", "c"])
    own = sets.join(members.select("id", "s1", "comp"), ["id", "s1"])
    often = np.zeros(buckets, np.int64)
    for r in own.select("set").mapInArrow(count, "b int, c long").groupBy("b").agg(F.sum("c").alias("c")).collect():
        often[r["b"]] = r["c"]
    often = members.sparkSession.sparkContext.broadcast(often)

    def rarest(x: pa.Scalar) -> np.ndarray:
        s = np.frombuffer(x.as_py(), "<u8")
        held = often.value[bucket(s)]
        order = np.lexsort((s, held))[:len(s) - -(-percent * len(s) // 100) + 1]
        return s[order[held[order] > 1]]

    def ends(batches):
        least, most = np.full(1 << bits, np.iinfo(np.int64).max), np.full(1 << bits, np.iinfo(np.int64).min)
        for batch in batches:
            for x, c in zip(batch.column("set"), batch.column("comp").to_pylist()):
                at = (rarest(x) & np.uint64((1 << bits) - 1)).astype(np.int64)
                least[at], most[at] = np.minimum(least[at], c), np.maximum(most[at], c)
        at = np.flatnonzero(least <= most)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(least[at]), pa.array(most[at])], ["b", "lo", "hi"])
    found = own.select("set", "comp").mapInArrow(ends, "b long, lo long, hi long").groupBy("b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    several = members.sparkSession.sparkContext.broadcast(bitmap(found.where("lo < hi"), F.col("b"), bits))

    def prefix(batches):
        for batch in batches:
            paths, rows = [np.zeros(0, np.uint64)], []
            for x in batch.column("set"):
                s = rarest(x)
                paths.append(s[in_bitmap(several.value, s, bits)])
                rows.append(len(paths[-1]))
            at = pa.array(np.repeat(np.arange(batch.num_rows), rows).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths).astype(np.uint64).view(np.int64)),
                                              *[batch.column(c).take(at) for c in ("id", "s1", "comp")]], ["path", "id", "s1", "comp"])
    return own.select("id", "s1", "comp", "set").mapInArrow(prefix, "path long, id long, s1 long, comp long")


def _in_pieces(rows: DataFrame, leaf: int) -> DataFrame:
    """Blocks (path, id, s1, comp) of more than one component. One of more than ``leaf`` documents becomes one node per pair of
    pieces, so that every pair meets in a small node."""
    sizes = rows.groupBy("path").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    rows = rows.join(sizes.select("path", "c"), "path").withColumn("k", F.ceil(F.col("c") / leaf).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id", "s1"), F.col("k")))
    rows = rows.select("path", "id", "s1", "comp", "k", "mine", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    path = F.when(F.col("k") == 1, F.col("path")).otherwise(F.xxhash64("path", F.least("mine", "other"), F.greatest("mine", "other")))
    return rows.select(path.alias("path"), "id", "s1", "comp")


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, coords: int = COORDS,
                      fanout: int = FANOUT, levels: int = LEVELS, leaf: int = LEAF, floor: float = FLOOR, percent: int = PERCENT, k: int = SHINGLE,
                      direct: int = DIRECT) -> DataFrame:
    """``id, n, component`` for every input row."""
    scratch = Scratch(docs.sparkSession, "neardup")
    sig = scratch.write(signatures(docs, id_col, text_col, coords, k), "signatures")
    reps = sig.where("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("id"), F.first("sig").alias("sig"))
    reps = scratch.write(reps.select("id", "s1", "s2", "n", "sig"), "representatives")
    # an id with several texts is one node from the start
    same_id = sig.where("n > 0 and id is not null").join(reps.select("s1", "s2", "n", F.col("id").alias("rep")), ["s1", "s2", "n"])
    same_id = same_id.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    comp, sets = None, None

    def with_comp(rows: DataFrame) -> DataFrame:
        if comp is None:
            return rows.withColumn("comp", F.col("id"))
        return rows.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")

    def add_links(*tables: DataFrame) -> None:
        """Contract what is linked: the components so far stand for all earlier links."""
        nonlocal comp
        found = [scratch.write(t, "found") for t in tables]
        found = [t for t in found if t.limit(1).count()]
        if found:
            old = comp
            known = [] if old is None else [old.select(F.col("node").alias("u"), F.col("component").alias("v"))]
            comp = components(functools.reduce(DataFrame.union, [*known, *found]), scratch)
            scratch.drop(old, *found)

    def load_sets(need: DataFrame) -> None:
        nonlocal sets
        need = need.distinct() if sets is None else need.distinct().join(sets, ["id", "s1"], "left_anti")
        need = scratch.write(need, "need")
        rows = need.count()
        if rows or sets is None:
            new = scratch.write(_full_sets(docs, need, rows, id_col, text_col, k), "sets")
            sets = new if sets is None else sets.union(new)

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows of the nodes that hold more than one component."""
        rows = with_comp(rows)
        keep = rows.groupBy("path").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("path")
        return rows.join(keep, "path")

    roots = reps.select(F.explode(F.array(*[F.lit(t).cast("long") for t in range(trees)])).alias("path"), "id", "s1", "sig")
    rows, level = _children(roots, coords, fanout), 0
    slim = reps.select("id", "s1", "n", "sig")
    while True:
        rows = scratch.write(rows, "nodes")
        sizes = with_comp(rows).groupBy("path").agg(
            F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            F.min_by(F.struct("id", "s1", "comp"), F.xxhash64("path", "id", "s1")).alias("pivot"))
        sizes = scratch.write(sizes.where("c > 1 and lo < hi"), "sizes")
        # a table of its own: its size then says that the join below need not exchange all rows of the level
        big = scratch.write(sizes.where(F.col("c") > leaf), "big")
        any_big = big.limit(1).count() > 0
        first = None
        if level == 0:
            # a pair is compared in the first small node that holds both; of ``leaf`` documents at most ``trees * fanout`` nodes are large
            large = np.array([r[0] for r in big.select("path").collect()], np.int64)
            first = (trees, fanout, docs.sparkSession.sparkContext.broadcast(large))
        small = with_comp(rows.join(sizes.where(F.col("c") <= leaf).select("path"), "path")).join(slim, ["id", "s1"])
        small = scratch.write(_promising(small, coords, floor, percent, first), "promising")
        need = small.select("id", "s1")
        star = None
        if any_big:
            # each member of a large node against the node's pivot, unless links found before join them
            inside = scratch.write(rows.join(big.select("path", "pivot"), "path"), "inside")
            pairs = with_comp(inside).where(F.col("pivot.comp") != F.col("comp")).select(
                F.col("pivot.id").alias("a"), F.col("pivot.s1").alias("a1"), F.col("id").alias("b"), F.col("s1").alias("b1"))
            star = scratch.write(_agreeing(pairs.distinct(), reps, coords, floor), "star")
            need = need.union(star.select("b", "b1")).union(star.select("a", "a1"))
        load_sets(need)
        links = [] if star is None else [_verified(star, sets, percent)]
        if level == 0:
            # the first tree's nodes first; what they join needs no second look
            links.append(_links_in_nodes(small.where(F.col("slot") < fanout), sets, coords, floor, percent, first))
            small = small.where(F.col("slot") >= fanout)
        add_links(*links)
        small = mixed(small.drop("comp")) if comp is not None else small
        add_links(_links_in_nodes(small, sets, coords, floor, percent, first))
        if not any_big:
            break
        rows = mixed(inside).select("path", "id", "s1")
        members = scratch.write(rows.select("id", "s1").distinct(), "members")
        if level == levels - 1 or members.count() <= direct:
            load_sets(members)
            blocks = scratch.write(_prefix_rows(with_comp(members), sets, percent), "blocks")
            blocks = _in_pieces(blocks, leaf).join(slim, ["id", "s1"])
            add_links(_links_in_nodes(scratch.write(_promising(blocks, coords, floor, percent), "promising"), sets, coords, floor, percent))
            break
        rows, level = _children(rows.join(slim.drop("n"), ["id", "s1"]), coords, fanout), level + 1

    add_links(same_id)
    if comp is None:
        return sig.select("id", "n", F.col("id").alias("component"))
    return sig.select("id", "n").join(comp.withColumnRenamed("node", "id"), "id", "left").select(
        "id", "n", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document."""
    out = linked_components(docs, **options)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                      F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows whose id is the smallest of its component, with the input's columns."""
    gone = linked_components(docs, id_col, text_col, **options).where("id <> component").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
