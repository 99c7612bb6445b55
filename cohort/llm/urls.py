"""URL filter (operator 13): host and path rules first, a character n-gram classifier for the rest.

A rule is a host, a path prefix and a verdict. It fits its host and every subdomain if the URL's
path starts with the rule's path; of several that fit the longest (host and path together) decides,
then the longer host, then the smaller text. URLs that no rule fits are judged by a logistic
regression on hashed character n-grams of host and path, fitted on a small table of labelled URLs:
a gram of the host and the same gram of the path are different features, and each counts once.

Both parts are expressions and an MLlib pipeline applied row by row, so there is no shuffle and any
lost task is simply run again. The labelled table is at most ``MAX_LABELLED`` rows and is fitted in
one partition, which makes the sums, and so the weights, the same in every run. The model holds one
weight per hash bucket, whatever the number of pages.

Edge cases: a null URL and one without ``://`` have an empty host and path, fit no rule and get the
classifier's verdict on no feature (its intercept); a host without a path fits no rule whose path is
``/``; ports and user names are part of the host; null ids, repeated rows and extra columns pass
through, one result row per input row; an empty table gives an empty result; a URL of any length is
judged whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAMS = (3, 4, 5)           #: characters in a feature
BUCKETS = 1 << 16           #: features are hashed into so many buckets
REG = 0.003                 #: L2 penalty of the fit
THRESHOLD = 0.5             #: least probability of "block" that blocks
MAX_RULES = 1_000           #: the rules are one expression; a longer list is an error
MAX_LABELLED = 20_000       #: documented bound of the labelled rows; a larger table is an error
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The rules of the registered query.
RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
         Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))

#: A small labelled table. Unwanted hosts carry the vocabulary of gambling, drug sales, adult
#: content, advertising networks and link farms; wanted ones are ordinary sites.
BLOCKED = """
http://www.casino-royal.test/slots
https://online-casino.test/en/412
https://blog.casinos.best-odds.test/de/77
http://lucky-casino.test/en/12.html
https://m.mega-casino.test/fr/930?page=2
https://win-jackpot.test/play
https://big-win.test/en/7198#top
http://winbig.test/lottery/77
https://www.poker-win.test/es/43
https://poker-stars-bonus.test/en/960
http://freepoker.test/table/4
https://blog.sports-bets.test/odds
http://www.bets-online.test/en/18
https://bet-now.test/fr/118
https://best-bets.test/en/9897
http://free-spins.test/es/601
https://m.free-money.test/offer
http://get-free-gifts.test/en/55
https://freebies.test/de/1240
http://blog.cheap-meds.test/en/36
https://cheap-viagra.test/buy
http://www.cheapest-pills.test/en/671?utm_source=feed
https://pills-online.test/fr/15
http://diet-pills.test/es/62202#top
https://buy-pills.test/en/853
http://m.pharmacy-rx.test/cheap
https://canadian-pharmacy.test/de/39547.html
http://cheap-watches.test/en/240
https://replica-bags.test/sale
http://blog.cheap-loans.test/fr/26
https://payday-loans.test/en/2019
http://adult-video.test/watch
https://www.adults-only.test/en/1022
http://www.adult-chat.test/de/120
https://sexy-cams.test/es/33
http://xxx-videos.test/en/3
https://m.porn-tube.test/hot
http://hot-dates-x.test/en/45489
https://x-rated.test/fr/8
http://blog.adultdating.test/en/369
https://spam-mail.test/en/915
http://www.spamhost.test/de/178383
https://bulk-spam.test/send
http://link-farm.test/en/2
https://blog.seo-farm.test/es/53
http://content-farm.test/en/474.html
https://m.farm-of-links.test/fr/45
http://ads-server.test/en/600/
https://adserver.test/click
http://www.ads-network.test/de/44
https://click-ads.test/es/533
http://popads.test/en/130617
https://m.track-click.test/en/728?utm_source=feed
http://tracker-pixel.test/fr/19
https://blog.ad-track.test/en/88
http://tracking.click-ads.test/de/9
https://click-track.test/en/25930
http://malware-download.test/exe
https://crack-keygen.test/en/1
http://www.warez-crack.test/fr/240
https://phish-login.test/verify
http://verify-account-win.test/en/685
"""
ALLOWED = """
https://www.library.test/en/412
http://library.city.test/catalogue/55
https://news.daily-paper.test/2021/04/story.html
http://www.morning-post.test/article/991
https://university.test/faculty/physics
http://physics.university.test/people/12
https://museum.test/exhibitions/17
https://www.weather-report.test/city/oslo
http://weather.test/en/30
https://recipes.test/soup/lentil
http://garden-club.test/plants/rose
https://blog.travel-notes.test/en/853
https://blog.teacher.test/post/33
http://blog.kitchen.test/fr/8
https://blog.harbour.test/de/120#top
https://m.harbour.test/de/77
http://m.river-town.test/es/240
https://m.newspaper.test/en/18
http://www.river-town.test/council/minutes
https://council.test/en/1022?page=2
http://history-society.test/en/474.html
https://www.history.test/de/39547.html
http://school.test/class/5b
https://school-board.test/fr/26
https://docs.software.test/guide/install
http://software.test/releases/4
https://forum.builders.test/thread/882
http://builders.test/en/36675
https://encyclopedia.test/wiki/rivers
http://wiki.test/de/Haus
https://www.theatre.test/programme/9
http://theatre.test/fr/le-malade
https://orchestra.test/concerts/20
http://music-school.test/es/lecciones
https://hospital.test/departments/surgery
http://www.hospital.test/en/visit
https://railway.test/timetable/north
http://railway-museum.test/en/25
https://mountain-club.test/routes/14
http://maps.test/region/41
https://science-journal.test/volume/8/issue/2
http://journal.test/en/671?utm_source=feed
https://www.mathematics.test/notes/algebra.pdf
http://notes.mathematics.test/en/960
https://radio.test/en/685
http://radio.north.test/de/12440#top
https://farmers-market.test/en/88
http://winter-sports.test/fr/19
https://freedom-press.test/essays/4
http://address-book.test/es/533
https://tracks-and-trails.test/hike/7
http://www.extra-lessons.test/en/728?utm_source=feed
https://thehouse.test/en/3
http://another.test/en/7198#top
https://rethinking.test/en/369
http://interest.test/es/26123?page=2&ref=x
https://www.thering.test/de/9
http://station.test/en/11629?utm_source=feed
https://nation.test/fr/25930
http://blog.ration.test/es/62202#top
https://within.test/en/45489
http://m.weather.test/de/35296?page=2&ref=x
https://blog.other.test/en/9897
http://inland.test/en/36
https://northern.test/de/178383
http://river.test/fr/176482?page=2&ref=x
https://blog.than.test/en/130617
http://sh.test/en/53
https://www.when.test/en/2019
http://m.think.test/en/600/
https://tables.test/fr/45
http://handed.test/en/915
https://blog.thread.test/de/44
http://www.bread.test/recipes/rye
https://local-council.test/en/2
http://village.test/en/1
https://books.test/novel/88
http://www.books.test/author/lem
https://archive.test/1911/page/4
http://archive.city.test/maps/12
https://photo-club.test/album/3
http://chess-club.test/games/1972
https://open-source.test/project/readme
http://www.translators.test/es/guia
https://poetry.test/sonnet/18
http://astronomy.test/stars/vega
https://parliament.test/debates/2020
http://courts.test/en/rulings/5
https://bakery.test/bread
http://ferry.test/timetable
"""


def labelled(spark) -> DataFrame:
    """``url, label``: the fixed table, 1 for URLs to block."""
    rows = [(u, 1.0) for u in BLOCKED.split()] + [(u, 0.0) for u in ALLOWED.split()]
    return spark.createDataFrame(rows, "url string, label double")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_columns(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """The text (host and path) and the verdict of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    name = verdict = F.lit(None).cast("string")
    order = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.host + r.path))
    for r in reversed(order):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _with_tokens(urls: DataFrame, url_col: str, keep: Sequence[Column], sizes: Sequence[int]) -> DataFrame:
    """``keep .., host, path, _tokens``: all character n-grams of the host, between marks of its ends, and of the path.

    The texts are cut into characters once, so that a gram is a few array look-ups and a long URL costs its length."""
    host, path = url_parts(F.col(url_col))
    df = urls.select(*keep, host.alias("host"), path.alias("path"))
    marked = F.when(F.col("host") == "", "").otherwise(F.concat(F.lit("."), "host", F.lit("/")))
    df = df.withColumns({"_h": F.split(marked, ""), "_hn": F.length(marked), "_p": F.split("path", ""), "_pn": F.length("path")})
    parts = []
    for mark in ("h", "p"):
        chars, n = F.col(f"_{mark}"), F.col(f"_{mark}n")
        for size in sizes:
            grams = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.concat(F.lit(mark), *[F.get(chars, i + k) for k in range(size)]))  # noqa: B023
            parts.append(F.when(n >= size, grams).otherwise(F.array().cast("array<string>")))
    return df.withColumn("_tokens", F.concat(*parts)).drop("_h", "_hn", "_p", "_pn")


def train(table: DataFrame, url_col: str = "url", label_col: str = "label", sizes: Sequence[int] = GRAMS, buckets: int = BUCKETS,
          reg: float = REG, max_rows: int = MAX_LABELLED) -> PipelineModel:
    """Classifier of URLs from a small table with a 0/1 label; rows without a label are left out."""
    df = _with_tokens(table, url_col, [F.col(label_col).cast("double").alias("_label"), F.col(url_col).alias("_url")], sizes).where("_label is not null")
    n = df.limit(max_rows + 1).count()
    if n > max_rows:
        raise ValueError(f"more than {max_rows} labelled URLs")
    stages = [HashingTF(inputCol="_tokens", outputCol="_features", numFeatures=buckets, binary=True),
              LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_predicted", rawPredictionCol="_raw",
                                 probabilityCol="_probability", regParam=reg, standardization=False, maxIter=200)]
    return Pipeline(stages=stages).fit(df.coalesce(1).sortWithinPartitions("_url", "_label"))


def filter_urls(pages: DataFrame, model: PipelineModel, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url",
                sizes: Sequence[int] = GRAMS, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row; the score is the classifier's probability of block."""
    df = model.transform(_with_tokens(pages, url_col, [F.col(id_col).alias("_id")], sizes))
    name, said = rule_columns(F.col("host"), F.col("path"), rules)
    score = F.round(F.get(vector_to_array("_probability"), F.lit(1)), 6)
    df = df.select(F.col("_id").alias("page_id"), "host", "path", name.alias("rule"), said.alias("_said"), score.alias("score"))
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return df.select("page_id", "host", "path", "rule", F.coalesce("_said", own).alias("verdict"), "score")
