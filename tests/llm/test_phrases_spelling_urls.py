"""Phrase mining, spelling variants and URL filter against brute force, and on edge-case tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohort.llm import phrases, spelling, urls
from cohort.llm.common import Scratch, read
from conftest import SF_SMALL

DOCS = "doc_id long, text string, lang string, source string, word string, h long, w1 string"
LETTERS = "abcdeé"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, "x", 7, "y") for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows; the table has clashing extra columns."""
    rng = random.Random(5)
    words = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 4))) for _ in range(25)]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", "", ".", ",\t", "\r\n", " \u00a0", "×÷"]) for _ in range(n))
    rows = [(i, prose(40), rng.choice(["en", "de", None, "und"])) for i in range(60)]
    rows += [(1, None, "en"), (2, "", "en"), (None, prose(30), "de"), (None, None, None), (3, " \t\n.,;", "en")]
    rows += [(70, "New York City, new york city; NEW YORK city hall\x0bnew\x0cyork", "en")] * 9
    rows += [(71, prose(8_000), "fr"), (72, "a" * 50_000 + " " + "a" * 49_999 + " " + "a" * 50_000, "fr"), (73, ("a" * 49_999 + "b ") * 2, "fr")]
    return rows


# -- 11 -----------------------------------------------------------------------------------------

def brute_phrases(rows, top, min_count, max_words=4, share=80):
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            ws = [w for w in re.split(r"[ \t]+", piece) if w]
            for k in range(1, max_words + 1):
                counts[lang or "und"].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cands = {p: c for p, c in f.items() if len(p) > 1 and c >= min_count}
        longer = Counter()
        for p, c in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i:i + k]] = max(longer[p[i:i + k]], c)
        kept = []
        for p, a in cands.items():
            if 100 * longer[p] >= share * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.mark.parametrize("top, min_count, first, batch", [(7, 3, 1, 400), (2000, 4, 8, 100_000)])
def test_phrases_match_brute_force_however_the_frontier_is_cut(spark, odd_rows, top, min_count, first, batch):
    got = phrases.phrases(table(spark, odd_rows).repartition(3), top=top, min_count=min_count, first=first, batch=batch)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(odd_rows, top, min_count)


def test_phrases_of_fewer_words(spark, odd_rows):
    for max_words in (2, 3):
        got = phrases.phrases(table(spark, odd_rows), top=30, min_count=4, max_words=max_words)
        assert sorted(tuple(r) for r in got.collect()) == brute_phrases(odd_rows, 30, 4, max_words)


def test_phrases_best_first_leaves_low_bounds_unexpanded(spark):
    """Only phrases whose bound reaches the threshold are counted further."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["p q r", "s t"] + [f"w{j}" for j in range(12)]) for _ in range(60)), "en") for i in range(80)]
    docs = table(spark, rows)
    search = phrases.Search(docs, "lang", "text", 2, 3, 4, 80, 1, 100)
    while search.round():
        pass
    known = sum(t.count() for t in search.three)
    every = len(brute_phrases([(i, t, lang) for i, t, lang in rows], 10 ** 9, 3, 3, share=1000)) - search.two.count()
    assert known < every / 4
    assert sorted(tuple(r) for r in phrases.phrases(docs, top=2, min_count=3, first=1, batch=100).collect()) == brute_phrases(rows, 2, 3)


def test_phrases_count_beyond_64_bit_products(spark):
    a, total = 3 * 10 ** 15, 7 * 10 ** 15 + 1
    df = spark.createDataFrame([(a, total)], "a long, t long")
    assert df.select(phrases._ratio(F.col("a"), F.col("t")).alias("x")).first()["x"] == 2_000_000 * a // total


def test_phrases_empty_table(spark):
    empty = phrases.phrases(spark.createDataFrame([], DOCS))
    assert empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and empty.count() == 0


# -- 12 -----------------------------------------------------------------------------------------

def brute_spelling(rows, min_length=7, ratio=10):
    counts = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= min_length:
                counts[w] += 1
    words = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]
    form, count = {}, {}
    for w, n in words.items():
        found = sorted((-m, v) for v, m in words.items() if near(w, v))
        count[w] = len(found)
        form[w] = found[0][1] if found and -found[0][0] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, count[w], form[w], words.get(form[w]), root))
    return sorted(out)


@pytest.mark.parametrize("symbols, min_length", [(2, 3), (8, 2)])
def test_spelling_matches_brute_force(spark, odd_rows, symbols, min_length):
    got = spelling.spelling_variants(table(spark, odd_rows).repartition(3), min_length=min_length, ratio=2, symbols=symbols)
    want = brute_spelling(odd_rows, min_length, 2)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(r[3] for r in want)


def test_spelling_of_the_small_table(spark):
    docs = read(spark, SF_SMALL, "documents")
    rows = [(r["doc_id"], r["text"], None) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in spelling.spelling_variants(docs).collect()) == brute_spelling(rows)


def test_neighbourhood_holds_every_image_of_a_near_word(spark):
    """The pairs of the join, without the sieve, are all pairs at one edit."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 5))) for _ in range(400)})
    vocabulary = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {(r["word"], r["near"]) for r in spelling.near_pairs(vocabulary, Scratch(spark, "t"), 3, 16).collect()}
    rests = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            rests[(i, w[:i] + w[i + 1:])].add(w)
    want = {(a, b) for g in rests.values() for a in g for b in g if a != b}
    want |= {p for w in words for i in range(len(w)) for v in [w[:i] + w[i + 1:]] if v in set(words) for p in ((w, v), (v, w))}
    assert got == want


def test_roots_follow_long_chains(spark):
    edges = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(19)] + [("x", "w3")], "word string, form string")
    assert {(r["word"], r["root"]) for r in spelling.roots(edges, Scratch(spark, "t")).collect()} == {(f"w{i}", "w19") for i in range(19)} | {("x", "w19")}


def test_spelling_empty_table(spark):
    empty = spelling.spelling_variants(spark.createDataFrame([], DOCS))
    assert empty.columns == ["word", "n", "n_near", "form", "form_n", "root"] and empty.count() == 0


# -- 13 -----------------------------------------------------------------------------------------

URLS = ["http://Example.ORG/es/1", "https://www.example.org/en/1", "http://a.example.org/en/2", "http://org/", "http://org", "http://xorg/", "http://a.b.com/fr/x",
        "http://com/de/", "http://a.com/de", "http://a.com:80/de/", "http://u@a.com/fr/?q#f", "http://a.com?x=/fr/", "http://a.com#/fr/", "ftp://a://b.com/fr/", "no scheme",
        "", "://", ":///", "://org/x", "http://ÄB.org/Ä?", None, "http://a.org/" + "x" * 200_000, "http://" + "a." * 3_000 + "org/es/", "http://example.org/es", "//example.org/es/"]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return (host, path, best and best.host + best.path, best and best.verdict)


@pytest.fixture(scope="module")
def model(spark):
    return urls.train(urls.labelled(spark))


def test_url_rules_match_brute_force(spark, model):
    rows = [(i, u, "h", "p", "r", 0.5) for i, u in enumerate(URLS)] + [(None, URLS[0], None, None, None, None), (0, URLS[0], "h", "p", "r", 0.5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, score double")
    got = urls.filter_urls(pages, model).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute_url(u)
        r = by_id[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))
    assert by_id[None]["rule"] == "example.org/es/"
    assert urls.filter_urls(pages.limit(0), model).count() == 0


def test_url_rule_ties_take_the_longer_host(spark, model):
    rules = [urls.Rule("a.com", "/", "block"), urls.Rule("com", "/x/", "allow"), urls.Rule("com", "/x", "allow")]
    pages = spark.createDataFrame([(1, "http://a.com/x/"), (2, "http://b.a.com/x"), (3, "http://b.com/x/")], "page_id long, url string")
    assert [(r["rule"], r["verdict"]) for r in urls.filter_urls(pages, model, rules).orderBy("page_id").collect()] == [
        ("a.com/", "block"), ("a.com/", "block"), ("com/x/", "allow")]


def test_url_classifier_on_held_out_rows(spark):
    """Four folds by url hash: each row is judged by a model that did not see it."""
    rows = urls.labelled(spark).withColumn("fold", F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(4)))
    right = total = 0
    for k in range(4):
        part = rows.where(F.col("fold") == k).withColumn("page_id", F.lit(0))
        judged = urls.filter_urls(part.select("page_id", "url"), urls.train(rows.where(F.col("fold") != k)), rules=())
        said = {(r["host"], r["path"]): r["verdict"] for r in judged.collect()}
        for r in part.collect():
            host, path, _, _ = brute_url(r["url"])
            right += (said[(host, path)] == "block") == (r["label"] == 1.0)
            total += 1
    assert total == len(urls.BLOCKED.split()) + len(urls.ALLOWED.split()) and right / total >= 0.7        # measured 0.757; always allowing is right for 0.592


def test_url_fit_is_repeatable_and_bounded(spark, model):
    again = urls.train(urls.labelled(spark).repartition(5))
    assert again.stages[-1].coefficients == model.stages[-1].coefficients
    with pytest.raises(ValueError):
        urls.train(urls.labelled(spark), max_rows=10)
    with pytest.raises(ValueError):
        urls.rule_columns(F.lit("a"), F.lit("/"), [urls.Rule("a", "/", "allow")] * 1_001)
