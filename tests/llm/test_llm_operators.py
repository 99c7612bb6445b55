"""Training-data operators against DuckDB twins, brute force, round trips and edge-case tables."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohort.llm import decontaminate, lines, lm, mixing, neardup, quality, secrets, substrings, toxicity, warc
from cohort.llm.common import read
from cohort.llm.queries import QUERIES, SQL
from conftest import SF_SMALL
from oracle_compare import compare, duck

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, path string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing extra columns."""
    long = "\n".join(prose(i, 60) for i in range(150))
    base = prose(1, 80)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " more words here", None, "b"),
            (4, None, "en", None), (5, "", "en", "b"), (6, " \n\t ", "en", "b"), (None, base, "en", "a"), (None, None, None, None),
            (7, long, "en", "c"), (8, "x\n" + long, "en", "c"), (9, "é ß 日本 \U0001F600 end", "de", "b"), (9, prose(3, 30), "en", "c"),
            (10, "one two", "en", "a"), (11, "same line of six words here\n" * 4, "en", "a")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y") for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, name):
    assert compare(QUERIES[name](spark, SF_SMALL), duck(SF_SMALL), SQL[name]) == []


def test_each_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


# -- 1 ------------------------------------------------------------------------------------------

def brute_substrings(rows, n=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            k = b[i:i + n]
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i:i + n]] < d:
                gone[i:i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)),
                    hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substrings_match_brute_force(spark):
    docs = read(spark, SF_SMALL, "documents")
    got = substrings.substring_dedup(docs.repartition(3), part_bytes=60_000, batch_bytes=40_000)
    want = brute_substrings([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted(tuple(r) for r in got.collect()) == want


def test_substrings_odd_rows(odd, none):
    big = 1 << 62
    got = [(big if r[0] is None else r[0], *r[1:]) for r in substrings.substring_dedup(odd, batch_bytes=5_000, part_bytes=9_000).collect()]
    assert sorted(got) == brute_substrings([(big if r["doc_id"] is None else r["doc_id"], r["text"]) for r in odd.collect()])
    assert substrings.substring_dedup(none).count() == 0


# -- 2 ------------------------------------------------------------------------------------------

def test_mix_meets_targets(spark, odd, none):
    out = mixing.mix(odd).toPandas()
    assert len(out) == odd.count() and (out["taken"] <= 3 * out["size"]).all()
    per = out.groupby("source_size").agg(t=("target", "first"), taken=("taken", "sum"))
    assert (abs(per["t"] - per["taken"]) <= 1).all()
    assert abs(per["t"].sum() - out["size"].sum()) < 1e-6
    assert mixing.mix(none).count() == 0
    assert "taken" in mixing.mixed_documents(odd.withColumn("size", F.lit("clash"))).columns


# -- 3 ------------------------------------------------------------------------------------------

def test_secret_patterns():
    text = 'é password = "abcdef" token:ab AKIA' + "A" * 16 + " " + "0123456789abcdef" * 2
    spans = [(secrets.KINDS[k], text[s:e]) for s, k, e in secrets.find_spans(text)]
    assert [k for k, _ in spans] == ["assign", "access", "hex"] and spans[0][1].startswith("password")
    assert secrets.find_spans("the paſſword: abcdefgh") == []       # only ASCII letters fold
    found = secrets.find_spans("my pwd is xK9#mQ2$vL7p ok")
    assert [(k, "my pwd is xK9#mQ2$vL7p ok"[s:e]) for s, k, e in found] == [(3, "xK9#mQ2$vL7p")]
    assert secrets.find_spans("my pwd is password123 ok") == []


def test_guess_cost_is_a_minimum_over_segmentations():
    cost = lambda v: secrets.guess_cost(v)[0]
    assert cost("password") < 2 < cost("qwertyuiop") < 4 < cost("2021-05-06") < 6 < cost("xk2qv9zt")
    assert cost("passwordx7") <= cost("password") + cost("x7") + 1
    spans = secrets.guess_cost("dragon2021-05-06zzzzzz")[1]
    assert [k for k, _, _ in spans] == ["word", "date", "repeat"] and spans[-1][2] == 22


def test_clean_prose_holds_no_secret(spark):
    clean = ["password is required here", "the pin is broken again", "the token is expired", "login is necessary now",
             "das secret: notwendig genug", "the spin is always good"]
    prose_rows = [(i, "required broken expired necessary notwendig, always; everything (ordinary) stays") for i in range(6)]
    docs = prose_rows + [(100 + i, t) for i, t in enumerate(clean)] + [
        (200, "my pwd is xK9#mQ2$vL7p ok"), (201, "passphrase: qzvkwjxhgpbt"), (202, "the xspin is qzvkwjxhgpbt")]
    docs += [(300 + i, "pwd is wqpzkvbmxhtd") for i in range(8)]       # copied, still no word
    out = {r["doc_id"]: r["n_guess"] for r in secrets.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [out[100 + i] for i in range(len(clean))] == [0] * len(clean)
    assert [out[i] for i in (200, 201, 202, 300, 307)] == [1, 1, 0, 1, 1]


def test_secret_rows(odd, none):
    out = secrets.scan(odd)
    assert out.count() == odd.count()
    assert {r[0] for r in out.where("doc_id = 4").select("base_sha256").collect()} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.scan(none).count() == 0


# -- 4 ------------------------------------------------------------------------------------------

def test_toxicity_learns_and_restores(spark):
    bad = ["grubfex", "snarvolt"]
    rows = [(i, f"{prose(i, 30)} {bad[i % 2] if i % 4 == 0 else prose(i + 9000, 1)} {prose(i + 5000, 30)}", int(i % 4 == 0)) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    more = [(1000, "well grubf3x said"), (1001, "a g r u b f e x there"), (1002, "plain words"), (1003, None), (1004, "")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + more, "doc_id long, text string")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(out[i]["predicted"], y) for i, _, y in rows if out[i]["held_out"]]
    assert held and sum(p == y for p, y in held) / len(held) > 0.97
    assert [out[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004)] == [1, 1, 0, 0, 0]
    assert out[1003]["score"] == toxicity.BASE


def test_toxicity_reads_mixed_obfuscation(spark):
    rows = [(i, f"{prose(i, 20)} {['idiot', 'shit', 'ass', 'fool'][i // 4 % 4] if i % 4 == 0 else 'fine'} {prose(i + 5000, 20)}", int(i % 4 == 0)) for i in range(800)]
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    odd = ["well 1d10t said", "oh $h!7 no", "such an i d 1 0 t here", "you a s s there", "that f**l went", "this s**t is", "a 1d1*t said",
           "an id" + "i" * 60 + "ot came", "an i.d.1.0.t came", "go $.h.!.7 now", "!d!07 !d!07"]
    plain = ["well 2021 it was", "see a-b and c_d.", "in 10 of 20 1 2 3", "*bold* words", "no" + "o" * 60]
    more = [(1000 + i, t) for i, t in enumerate(odd + plain)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + more, "doc_id long, text string")
    out = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    assert [t for i, t in more if out[i] != (t in odd)] == []


def test_toxicity_weighs_weak_terms(spark):
    # each of three words is in every toxic document and in 30 % of the clean ones: a toxic share of about a half
    rng, rows, bad = random.Random(2), [], ["grubfex", "snarvolt", "plinkour"]
    for i in range(900):
        y = int(i % 4 == 0)
        rows.append((i, " ".join([prose(i, 15), *[w for w in bad if y or rng.random() < 0.3]]), y))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    more = [(1000, "grubfex snarvolt plinkour"), (1001, "snarvolt alone")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + more, "doc_id long, text string")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(out[i]["predicted"], y) for i, _, y in rows if out[i]["held_out"]]
    assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held)
    assert sum(p == y for p, y in held) / len(held) > 0.85
    assert [out[i]["predicted"] for i in (1000, 1001)] == [1, 0]


def test_toxicity_without_labels(odd, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, labels).where("predicted = 1").count() == 0
    assert toxicity.toxicity(none, labels).count() == 0


# -- 5 ------------------------------------------------------------------------------------------

def test_lm_parts_do_not_change_scores(spark):
    docs = read(spark, SF_SMALL, "documents")
    a = {r[0]: tuple(r) for r in lm.scores(docs).collect()}
    b = {r[0]: tuple(r) for r in lm.scores(docs.repartition(4), part_words=3_000, top=40).collect()}
    assert a.keys() == b.keys()
    assert all(a[k][:3] == b[k][:3] and abs(a[k][3] - b[k][3]) < 2e-6 for k in a)


def test_lm_odd_rows(odd, none):
    assert lm.scores(odd).count() == odd.count() and lm.scores(none).count() == 0


# -- 6 ------------------------------------------------------------------------------------------

def brute_components(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1:]:
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets}


@pytest.mark.parametrize("leaf", [1024, 8])
def test_near_duplicates_match_brute_force(spark, leaf):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]
    base = prose(77, 120).split()
    rng = random.Random(5)
    for i in range(40):                       # a family around the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(120)] = f"new{i}"
        rows.append((10_000 + i, " ".join(copy)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf=leaf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_near_duplicates_under_a_template_match_brute_force(spark):
    # unlinked documents of one template at similarity 0.6 stay in large nodes; pairs a little over 0.75 hide among them
    rng, rows = random.Random(11), []
    template = prose(70, 120).split()
    for i in range(300):
        text = template + prose(1000 + i, 40).split()
        rows.append((2 * i, " ".join(text)))
        text[130:130 + rng.randint(8, 14)] = prose(5000 + i, 12).split()
        rows.append((2 * i + 1, " ".join(text)))
    want = brute_components(rows)
    assert sum(c != d for d, (_, c) in want.items()) > 100
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf=8).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want


def test_near_duplicates_odd_rows(odd, none):
    out = neardup.near_duplicates(odd)
    assert out.count() == odd.count()
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[2]["component_id"] == 1 and by[3]["component_id"] == 1 and by[5]["component_id"] == 5 and by[None]["kept"]
    assert neardup.near_duplicates(none).count() == 0


# -- 7 ------------------------------------------------------------------------------------------

def test_lines(spark, odd, none):
    docs = spark.createDataFrame([
        (1, "a b c d e f\nshort one\nx y z\nu v w\nown line of the first document"), (2, "new words stand in this line\n\nx y z\n\nu v w\nlast"),
        (3, "short one\nthis is something else entirely"), (4, "a b c d e f")], "doc_id long, text string")
    out = {r["_row"]["doc_id"]: r["kept_text"] for r in lines.dedup_lines(docs).collect()}
    assert out[2] == "new words stand in this line\n\nlast" and out[3].startswith("short one") and out[4] == ""
    assert sorted(r["doc_id"] for r in lines.without_repeats(docs).collect()) == [1, 2, 3]
    assert lines.line_dedup(odd).count() == odd.count() and lines.line_dedup(none).count() == 0
    assert lines.without_repeats(odd).columns == odd.columns


# -- 8 ------------------------------------------------------------------------------------------

def test_warc(spark):
    same = "<html>" + "p" * 200 + "</html>"
    rows = [(5, "u5", same), (3, "u3", same), (9, None, same), (1, "u\r\n1", "tiny"), (2, "u2", "tiny"), (4, "u4", None), (6, "u6", "é日" * 90000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    out = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in out.items()} == {
        3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), 1: ("response", None), 2: ("response", None), 4: ("response", None), 6: ("response", None)}
    for k, _, html in rows:
        body = (html or "").encode()
        assert (out[k]["payload_bytes"], out[k]["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_reader_rejects_damage():
    import struct

    import zstandard
    raw = b"HTTP/1.1 dictionary " * 20
    tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    record = warc.build_record(1, "u", b"body", hashlib.sha256(b"body").hexdigest(), None, False)
    lead = struct.pack("<II", warc.DICT_MAGIC, len(raw)) + raw
    good = lead + warc.PAD.encode() + tool.compress(record) + warc.PAD.encode()
    assert [r[:2] for r in warc.read_archive(good)] == [(1, 4)]
    for bad in (good[:-12], lead + tool.compress(record.replace(b"body", b"bodx")), lead + tool.compress(record[:-1]), lead[:-3]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(bad))


# -- 9 ------------------------------------------------------------------------------------------

def test_decontamination(spark, odd, none):
    item = prose(500, 30)
    near = item.split()
    near[0], near[-1] = "changed", "too"
    far = item.split()
    far[10], far[20] = "changed", "too"
    docs = spark.createDataFrame([
        (1, prose(1, 40) + " " + item.upper() + " " + prose(2, 40)), (2, " ".join(near)), (3, prose(3, 9) + " " + " ".join(far)),
        (4, prose(4, 200)), (5, None), (6, ""), (7, "tiny item here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "tiny item here"), (4, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["start_word"] for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(1, 1): 40, (2, 1): 0, (7, 3): 0}
    assert sorted(r["doc_id"] for r in decontaminate.clean_documents(docs, bench).collect()) == [3, 4, 5, 6]
    assert decontaminate.matches(odd, bench).count() == 0 and decontaminate.matches(none, bench).count() == 0
    assert decontaminate.matches(docs, bench.where("false")).count() == 0


def test_decontamination_of_repeated_runs(spark):
    # 144 shared shingles; a run of one word in the item is overwritten in the copy: similarity exactly 0.75
    items, docs = [], []
    for i in range(40):
        shared = [f"w{i}x{j}" for j in range(148)]
        items.append((i, " ".join(["blank"] * 24 + shared)))
        docs.append((i, " ".join([f"n{i}x{j}" for j in range(24)] + shared)))

    def shingles(text):
        w = text.split()
        return Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4))
    want = set()
    for (i, x), (_, y) in zip(items, docs):
        p, q = shingles(x), shingles(y)
        if 4 * (p & q).total() >= 3 * (p | q).total():
            want.add(i)
    assert len(want) == 40
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.matches(docs, items).collect()} == want


# -- 10 -----------------------------------------------------------------------------------------

def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def test_quality(spark, odd, none):
    docs = read(spark, SF_SMALL, "documents").select("doc_id", "text").limit(60).union(odd.where("length(text) < 3000 or text is null").select("doc_id", "text"))
    out = quality.quality_rules(docs, quality.trusted_ids(spark, SF_SMALL)).collect()
    want = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), *brute_quality(r["text"])) for r in docs.collect())
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                  r["n_repeat_words"], r["base_failed"]) for r in out)
    assert got == want and not any(r["kept"] and r["base_failed"] for r in out)
    assert quality.quality_rules(none, quality.trusted_ids(spark, SF_SMALL)).count() == 0
    assert quality.keep_good(odd, quality.trusted_ids(spark, SF_SMALL)).columns == odd.columns


def test_quality_without_trusted_rows(spark, odd):
    empty = quality.trusted_ids(spark, SF_SMALL).where("false")
    assert all(r["kept"] == (not r["base_failed"]) for r in quality.quality_rules(odd, empty).collect())


# -- pipeline -----------------------------------------------------------------------------------

def test_pipeline(spark):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, SF_SMALL)
    docs = read(spark, SF_SMALL, "documents")
    assert set(docs.columns) <= set(out.columns) and 0 < out.count() < docs.count()
    assert out.groupBy("doc_id").count().where("count > 1").count() == 0
    leaked = decontaminate.matches(out.select(*docs.columns), read(spark, SF_SMALL, "benchmark"))
    assert leaked.count() == 0
