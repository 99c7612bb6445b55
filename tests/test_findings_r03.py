"""One test per finding of the third round: work per row, plan shape or partition size that failed before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort.operators import aggregate as A


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- F2

def test_bootstrap_multiplies_no_rows(spark):
    df = spark.range(40).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") % 7).cast("double").alias("y"))
    plan = _plan(A.bootstrap_interval(df, ["g"], "y", "id", n_boot=20))
    assert "Generate" not in plan and "MapInArrow" in plan      # before: an exploded row per replicate


def test_bootstrap_hands_groups_on_when_many(spark, monkeypatch):
    df = spark.range(60).select(F.col("id"), (F.col("id") % 30).alias("g"), F.col("id").cast("double").alias("y"))
    whole = A.bootstrap_interval(df, ["g"], "y", "id", n_boot=9).orderBy("g").collect()
    work = A._boot_sums(["g"], 9, 42, A.to_arrow_schema(spark.createDataFrame([], "g long, _b int, _w long, _s double, n long, _t double").schema))
    monkeypatch.setattr(A, "BOOT_GROUPS", 4)
    batches = df.select("g", F.col("id").cast("string").alias("_id"), F.col("y").alias("_y")).toArrow().to_batches()
    parts = [b.to_pandas() for b in work(batches)]
    assert len(whole) == 30 and sum(len(p) for p in parts) >= 30 * 9
    n = {g: 0 for g in range(30)}
    for p in parts:
        for g, d in p.groupby("g"):
            n[g] += int(d["n"].iloc[0]) * (len(d) // 9)
    assert set(n.values()) == {2}


# ---------------------------------------------------------------- F1

def test_placebo_sums_equal_the_permuted_rows(spark, monkeypatch):
    from cohort.operators import causal as CA
    monkeypatch.setattr(CA, "RANKED_TOGETHER", 1000)        # nine ranges a replicate over three blocks of the order
    i = F.col("id")
    df = spark.range(9000).select(i, F.when(i % 7 > 0, (i % 3 == 0).cast("int")).alias("t"), F.when(i % 11 > 0, i % 4).alias("z"),
                                  F.when(i % 13 > 0, F.sin("id")).alias("y"))
    got = CA.placebo_cells(df, "id", "t", ["z"], "y", 3, seed=5)
    names = got.groupBy("_cell").count().count()
    assert names == 4
    got = got.groupBy("replicate", "_cell", "_t").agg(F.sum("_rows"), F.sum("_n"), F.round(F.sum("_sy"), 6), F.round(F.min_by("_y", "_at"), 6))
    want = CA.permuted_treatment(df, "id", "t", 3, seed=5).where("z is not null").groupBy("replicate", "z", F.col("placebo").cast("double")).agg(
        F.count(F.lit(1)), F.count("y"), F.round(F.sum("y"), 6), F.round(F.min_by("y", "id"), 6))
    shown = lambda d: sorted(str((r[0], *r[2:])) for r in d.collect())
    assert shown(got) == shown(want)
    assert "FlatMapCoGroupsInArrow" in _plan(CA.placebo_cells(df, "id", "t", ["z"], "y", 3))


# ---------------------------------------------------------------- F6, F7, F13

def _small_forest(spark):
    from cohort.operators import models as MD
    i = F.col("id")
    d = spark.range(600).select(i.alias("row_id"), (i * 7 % 31).cast("double").alias("a"), F.when(i % 9 > 0, (i % 12).cast("double")).alias("b"), (i % 2).cast("int").alias("c"))
    d = d.withColumn("label", F.when(F.col("a") > 20, 2.0).when(F.coalesce("b", F.lit(0.0)) > 6, 1.0).otherwise(0.0))
    return MD.forest_classifier("label", trees=7, depth=4).fit(MD.assemble(d.na.fill(0.0), ["a", "b", "c"])), d


def test_cells_score_like_the_forest(spark):
    from cohort.operators import explain as XP
    from cohort.operators.forest import score_cells
    model, d = _small_forest(spark)
    cells = score_cells(model, 3, 1)
    rows = XP._prob(model, d, ["a", "b", "c"], 1, "_f").toPandas()
    at = sum(cells.of(j, rows[c].to_numpy(float)) for j, c in enumerate(["a", "b", "c"]))
    assert np.array_equal(cells.probability[at], rows["_f"].to_numpy())
    assert score_cells(model, 3, 9) is None


def test_contributions_and_recourse_from_cells_equal_the_scored_rows(spark, monkeypatch):
    from cohort.operators import explain as XP
    model, d = _small_forest(spark)
    few = d.where("row_id % 5 = 0").union(d.where("row_id = 10"))       # a key that repeats
    few = few.withColumn("row_id", F.when(F.col("row_id") != 35, F.col("row_id")))     # and one that is null
    bg = XP.background_sample(d, "row_id", 11)

    def run():
        phi, base = XP.shapley_values(model, few, "row_id", ["a", "b", "c"], 1, bg, samples=6, return_base=True)
        cf = XP.counterfactuals(model, few, "row_id", ["a", "b", "c"], ["b", "a"], 1, k=3)
        return [sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in t.collect()) for t in (phi, base, cf)], _plan(phi), cf.columns
    tables, plan, columns = run()
    assert "Generate explode" not in plan and "MapInArrow" in plan      # before: rows x samples x points
    monkeypatch.setattr(XP, "score_cells", lambda *a: None)
    old, plan, old_columns = run()
    assert "Generate explode" in plan and columns == old_columns and all(tables)
    assert tables == old


# ---------------------------------------------------------------- F11, F12, F16, F17

def test_rows_of_a_fit_come_in_bounded_partitions(spark, monkeypatch):
    from cohort import session
    monkeypatch.setattr(session, "ROWS_PER_PARTITION", 10)
    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(10 * cores).coalesce(1), spark.range(30 * cores).coalesce(1)
    assert session.full_partitions(few) is few
    parts = session.full_partitions(many).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 30 * cores and max(r["count"] for r in parts) <= 20


def test_models_are_fitted_on_bounded_partitions(spark, monkeypatch):
    from cohort.operators import models as MD
    from cohort.plans import modeling, registry
    import __spark_entry__  # noqa: F401
    registry.load_all()
    asked = []
    for module in (modeling, MD):
        monkeypatch.setattr(module, "full_partitions", lambda df, name="rows": asked.append(name) or df)
    for name in ("forest_regression_importance", "what_if_scenarios"):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    modeling._train_test(spark, "/root/testdata/sf0.001")
    assert asked == ["forest-rows", "what-if", "split"]


# ---------------------------------------------------------------- F3, F10

def test_forest_in_blocks_is_scored_like_one_forest(spark):
    from cohort.operators import forest as FO
    model, d = _small_forest(spark)
    from cohort.operators import models as MD
    rows = MD.assemble(d.na.fill(0.0), ["a", "b", "c"])
    trees, cuts = FO.forest_trees(model), [(4, 0.0), (2, 0.01)]
    want = {(r["cut"], r["y"], r["p"]): r["n"] for r in FO.prefix_counts(rows, trees, cuts, [7], "label").collect()}
    held = rows.select(F.col("label").cast("int").alias("y"), FO.vector_to_array("features").alias("x"), F.lit(None).cast("array<double>").alias("v"))
    for block in (trees[:3], trees[3:]):
        held = FO.add_votes(held, block, cuts)
    assert {(r["cut"], r["y"], r["p"]): r["n"] for r in FO.vote_counts(held, 2, 3).collect()} == want


def test_grid_search_holds_few_trees_at_a_time(spark, monkeypatch):
    from cohort.operators import models as MD
    from cohort.operators import search as SE
    _, d = _small_forest(spark)
    rows = MD.assemble(d.na.fill(0.0), ["a", "b", "c"]).withColumn("fold", (F.col("row_id") % 2).cast("int"))
    held = []
    monkeypatch.setattr(SE, "TREE_NODES", 2 * 600 * 3)
    grow = SE.forest_trees
    monkeypatch.setattr(SE, "forest_trees", lambda m: held.append(m.getNumTrees) or grow(m))
    rf = MD.forest_classifier("label", depth=4)
    got = SE.grid_search(rf, {rf.numTrees: [4, 8], rf.maxDepth: [4, 2]}, rows, "label", "fold")
    assert len(got.scores) == 4 and all(s > 0.5 for s in got.scores) and max(held) <= 3 and sum(held) == 16
    monkeypatch.setattr(SE, "TREE_NODES", 2_000_000)
    assert SE._forest_plan(2_400, 8) == (52, 8) and SE._forest_plan(144_000, 8) == (6, 1)


# ---------------------------------------------------------------- F14

def test_box_stats_leaves_the_rows_where_they_are(spark):
    df = spark.range(60).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.when(F.col("id") != 7, F.col("id").cast("double")).alias("x"))
    plan = _plan(A.box_stats(df, "g", "x"))
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan      # before: the rows were dealt by group
    got = {r["g"]: r for r in A.box_stats(df, "g", "x").collect()}
    assert {g: r["n"] for g, r in got.items()} == {None: 20, 1: 19, 2: 20}
    assert (got[None]["whisker_lo"], got[None]["median"], got[None]["whisker_hi"], got[None]["n_outliers"]) == (0.0, 28.5, 57.0, 0)


# ---------------------------------------------------------------- F15

@pytest.mark.parametrize("n", [1, 3, 4, 5, 11, 12])
def test_shadows_are_shifts_of_whole_blocks(spark, monkeypatch, n):
    from cohort.operators import selection as SL
    monkeypatch.setattr(SL, "BLOCK", 4)
    df = spark.range(n).select("id", F.when(F.col("id") != 2, F.col("id") * 10).alias("a"), F.sin("id").alias("b"), F.lit("x").alias("kept"))
    ranked = SL.ranked_rows(df, "id", 3)
    got = SL._shadows(SL._blocks(ranked), ["a", "b"], n, 3, 5)
    assert "Generate" not in _plan(got)         # before: a row per shadow value
    rows, own = {r["_rank"]: r for r in got.collect()}, {r["_rank"]: r for r in ranked.collect()}
    assert sorted(rows) == list(range(n))
    for k, r in rows.items():
        assert [r[c] for c in ("id", "a", "b", "kept")] == [own[k][c] for c in ("id", "a", "b", "kept")]
        for c in ("a", "b"):
            assert r[f"shadow_{c}"] == own[(k + SL._offset(3, 5, c, n)) % n][c]


# ---------------------------------------------------------------- op4

def test_readings_without_a_choice_cost_nothing_and_masks_try_every_letter(monkeypatch):
    import itertools

    from cohort.llm import toxicity as T
    rng = np.random.default_rng(3)
    decoder = T.Decoder(rng.integers(0, 90, T.BUCKETS), rng.integers(0, 90, T.BUCKETS))

    def price(word):
        points = "  " + word + " "
        return sum(decoder.cost(*points[i:i + 3]) for i in range(len(points) - 2))
    for token, masks in (("w*b", 1), ("w**b", 2), ("w3*b", 1)):
        shape = token.replace("3", "e").replace("*" * masks, "{}")
        words = [shape.format("".join(x)) for k in range(masks + 1) for x in itertools.product(T.LETTERS, repeat=k)]
        best = min(words, key=lambda w: price(w) + T.DROP * (masks - (len(w) - len(shape) + 2)))
        assert decoder.best(token) == best
    monkeypatch.setattr(decoder, "cost", None)
    assert decoder.best("w3b") == "web" and decoder.best("xyz***") == "xyz"      # before: searched


def test_runs_are_looked_for_once_and_spelled_words_are_found():
    from cohort.llm import toxicity as T
    decoder = T.Decoder(np.ones(T.BUCKETS), np.ones(T.BUCKETS))
    class Counted:
        calls = 0

        def search(self, text):
            Counted.calls += 1
            return T.re.compile(r"([^\W\d_])\1\1").search(text)
    found, T.RUN = T.RUN, Counted()
    try:
        T.restored_words("many plain words of letters alone " * 9, decoder)
        assert Counted.calls == 1       # before: a search a word
    finally:
        T.RUN = found
    for text in ("a b c", "x a.b.c y", "s-p-a_m", "1 a b c!", "(a b", "a  b  c.", "a b cd", "no", "a. b. c. d"):
        assert T.SPELLED.search(text) is None or T.SPELLED_END.search(text)
    words = {"four", "fives", "six", "fi~"}
    terms = {"four", "five~", "fives~", "sixe~", "fi~"}
    assert T.known_terms(words, dict.fromkeys(terms), *T.first_letters(terms)) == T.terms_of(words) & terms == {"four", "five~", "fi~"}


def _components_by_hand(links):
    import collections
    near = collections.defaultdict(set)
    for u, v in links:
        near[u].add(v)
        near[v].add(u)
    out, seen = {}, set()
    for start in sorted(near):
        todo = [] if start in seen else [start]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                out[x] = start
                todo += near[x] - seen
    return {x: c for x, c in out.items() if x != c}


@pytest.mark.parametrize("links_per_task", [50_000, 40])
def test_components_of_few_links_are_one_pass_and_of_many_the_same(spark, links_per_task):
    """op6_near_duplicates: each call took five rounds of seven exchanges, also for a handful of links."""
    import random

    from cohort.llm.common import Scratch
    from cohort.llm.components import components
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, rng.randrange(501, 600)) for _ in range(80)]
    links += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)] + [(7, 7), (900, 3), (-5, 900)]
    rng.shuffle(links)
    scratch = Scratch(spark, "components")
    rows = spark.createDataFrame([*links, (None, 3)], "u long, v long").repartition(6)
    got = components(rows, scratch, links_per_task=links_per_task).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == _components_by_hand([(u, v) for u, v in links if u != v])
    if links_per_task == 50_000:
        assert scratch.n == 1       # one table written: no rounds


def test_texts_of_wanted_documents_are_not_exchanged(spark, monkeypatch):
    """op6_near_duplicates: more than ``BROADCAST_IDS`` wanted ids sent all texts through an exchange."""
    from cohort.llm import neardup
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 7}_{j}" for j in range(9)) + " tail" * (i % 3)) for i in range(60)] + [(None, "a b c d e f g")],
                                 "doc_id long, text string")
    sig = neardup.signatures(docs)
    wanted = sig.where("id % 2 = 0").select("id", "s1").union(spark.createDataFrame([(3, 0)], "id long, s1 long"))
    plain = neardup._full_sets(docs, wanted, 60, "doc_id", "text", 5)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    sifted = neardup._full_sets(docs, wanted, 60, "doc_id", "text", 5)
    key = lambda rows: sorted((r["id"], r["s1"], bytes(r["set"])) for r in rows)
    assert key(sifted.collect()) == key(plain.collect()) and len(plain.collect()) == 30
    joins = sifted._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins == 1       # of sets with the wanted ids, none of texts


def _families(seed, families=12, copies=6, words=80, most=9):
    """Documents of a few families, each copy with runs of words of its own: similar within a family, some over and some under 0.75."""
    import random
    rng, rows = random.Random(seed), []
    for f in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(words - most)
                text[at:at + most] = [f"x{f}_{c}_{rng.randrange(10 ** 6)}" for _ in range(most)]
            rows.append((100 * f + c, " ".join(text)))
    return rows


def _meetings(rows, nodes_of):
    """How often two rows stand in one node, by pair."""
    import collections
    inside, out = collections.defaultdict(set), collections.Counter()
    for r in rows:
        inside[nodes_of(r)].add(r["id"])
    for ids in inside.values():
        out.update((a, b) for a in ids for b in ids if a < b)
    return out


def test_a_pair_is_compared_in_one_small_node_of_the_first_level(spark):
    """op6_near_duplicates: a pair of similarity 0.5 to 0.75 was checked, with its full sets, in each node that held both."""
    import numpy as np
    from pyspark.sql import functions as F

    from cohort.llm import neardup as nd
    docs = spark.createDataFrame(_families(3), "doc_id long, text string")
    sig = nd.signatures(docs)
    roots = sig.select(F.explode(F.array(*[F.lit(t).cast("long") for t in range(nd.TREES)])).alias("path"), "id", "s1", "sig")
    members = nd._children(roots, nd.COORDS, nd.FANOUT).join(sig.select("id", "s1", "n", "sig"), ["id", "s1"]).withColumn("comp", F.col("id"))
    plain = _meetings(nd._promising(members, nd.COORDS, 0.0, 0).collect(), lambda r: r["path"])
    assert max(plain.values()) > 2
    for large in ([], [r["path"] for r in members.groupBy("path").count().where("count = 3").collect()]):
        held = members.where(~F.col("path").isin(large)) if large else members
        first = (nd.TREES, nd.FANOUT, spark.sparkContext.broadcast(np.array(large, np.int64)))
        counted = _compared_pairs(nd, held, first)
        assert set(counted) == set(_meetings(held.collect(), lambda r: r["path"])) and set(counted.values()) == {1}
        left = _meetings(nd._promising(held, nd.COORDS, nd.FLOOR, 75, first).collect(), lambda r: r["path"])
        assert left and sum(left.values()) < sum(plain.values()) / 2


def _compared_pairs(nd, members, first):
    """In how many nodes a pair is not left to an earlier one."""
    import collections

    import numpy as np
    out, by = collections.Counter(), collections.defaultdict(list)
    for r in members.collect():
        by[r["path"]].append(r)
    for path, rows in by.items():
        nodes = nd._first_nodes(np.stack([np.frombuffer(r["sig"], "<u4") for r in rows]), first[0], nd.COORDS, first[1])
        slots = (nodes == path).argmax(axis=1)
        assert (nodes == path).any(axis=1).all() and len(set(slots)) == 1
        ids = np.array([r["id"] for r in rows])
        met = ~nd._earlier(nodes, slots[0], first[2].value) & (ids[:, None] < ids[None, :])
        out.update((ids[i], ids[j]) for i, j in zip(*np.nonzero(met)))
    return out


@pytest.mark.parametrize("patience", [0, 10 ** 6])
def test_links_of_a_node_by_pairs_and_by_matrix_products_join_the_same(patience):
    """op6_near_duplicates: pairs that fail in a prefix block were checked one by one (32.9 s of 239 s on check_h)."""
    import numpy as np

    from cohort.llm import neardup as nd
    rng = np.random.default_rng(4)
    own, comp = [], []
    for i in range(40):
        base = np.arange(100 * (i % 5), 100 * (i % 5) + 60, dtype=np.uint64)
        new = rng.integers(10 ** 6, 10 ** 7, rng.integers(0, 25)).astype(np.uint64)
        own.append(np.unique(np.concatenate([base[len(new):], new])))
        comp.append(i // 2 * 2 if i % 7 == 0 else i)
    comp = np.array(comp)
    both = np.array([[len(set(a.tolist()) & set(b.tolist())) for b in own] for a in own])
    others = ~np.eye(40, dtype=bool)
    assert (nd._shared(own, np.arange(40), slab=64) == both)[others].all()
    same = np.triu(np.where(comp[:, None] != comp[None, :], 1 + both, 0))
    links = [(int(comp[i]), int(comp[j])) for i in range(40) for j in range(i + 1, 40)
             if 100 * both[i, j] >= 75 * (len(own[i]) + len(own[j]) - both[i, j])]
    found = nd._links(own, comp, same, 75, patience)
    assert 0 < len(found) < 40
    assert _components_by_hand([(int(comp[i]), int(comp[j])) for i, j in found]) == _components_by_hand([x for x in links if x[0] != x[1]])


def test_few_documents_of_large_nodes_branch_no_further(spark, monkeypatch):
    """op6_near_duplicates: large nodes took two more levels of ten steps each, whatever they held; prefix blocks had a row for shingles of one set."""
    import collections

    from pyspark.sql import functions as F

    from cohort.llm import neardup as nd
    from cohort.llm.common import Scratch
    written, plain = [], Scratch.write

    def write(self, df, label):
        out = plain(self, df, label)
        written.append((label, out))
        return out
    monkeypatch.setattr(Scratch, "write", write)
    docs = spark.createDataFrame(_families(5, families=3, copies=30), "doc_id long, text string")
    got = {}
    for direct in (10 ** 6, 0):
        written.clear()
        got[direct] = {r["id"]: r["component"] for r in nd.linked_components(docs, leaf=4, direct=direct).collect()}
        labels = [x for x, _ in written]
        assert labels.count("nodes") == (1 if direct else nd.LEVELS) and labels.count("blocks") == 1
        if direct:
            held = collections.Counter()
            for r in docs.collect():
                w = r["text"].split()
                held.update({tuple(w[i:i + 5]) for i in range(len(w) - 4)})
            blocks = next(t for x, t in written if x == "blocks")
            paths = {r["path"] for r in blocks.collect()}
            assert 0 < len(paths) <= sum(c > 1 for c in held.values())
            ends = blocks.selectExpr(f"pmod(path, {1 << nd.PREFIX_BITS}) AS b", "comp").groupBy("b")
            assert ends.agg(F.countDistinct("comp").alias("c")).where("c = 1").count() == 0
    assert got[0] == got[10 ** 6] and len(set(got[0].values())) < len(got[0])
