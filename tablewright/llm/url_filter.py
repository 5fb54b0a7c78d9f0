"""URL filters: host rules, and logistic regression on hashed character n-grams.

The rules are few and fixed, so they are one CASE expression: no join at all. The
classifier is trained from a small labelled table of urls, hashed n-grams of host
and path being its only features, and its model is applied column-wise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import table
from tablewright.llm.urls_labelled import kinds

#: (host, path the url's must start with, verdict); a rule holds for the host and its subdomains.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: Lengths of the n-grams, and the number of hashed features.
GRAMS, FEATURES = (3, 4, 5), 1 << 14

#: Words of the labelled table: unwanted and wanted hosts and paths, places that say nothing, endings of hosts.
BAD_HOSTS = (
    "casino", "poker", "betting", "slots", "jackpot", "lottery", "pills", "viagra", "adult", "porn", "sexcam", "escort",
    "adserver", "tracker", "clicks", "popunder", "spam", "warez", "torrents", "keygen", "payday", "hookup", "malware", "phish",
)
GOOD_HOSTS = (
    "library", "museum", "garden", "weather", "university", "recipes", "therapy", "news", "forum", "history", "travel", "health",
    "science", "data", "radio", "cooking", "theatre", "railway", "school", "archive", "council", "journal", "church", "bakery",
)
BAD_PATHS = (
    "online-casino", "free-spins", "bet-now", "buy-pills", "cheap-meds", "xxx-videos", "nude-pics", "adclick", "banner-ads", "crack-serial",
    "free-download-keygen", "payday-loans", "hot-singles", "win-prize", "track-pixel", "phishing-login",
)
GOOD_PATHS = (
    "articles", "opening-hours", "lessons", "guide", "essays", "timetable", "reports", "biography", "chapter", "minutes-of-meeting",
    "exhibition", "soup-and-bread", "field-notes", "glossary", "contact", "events",
)
PLAIN_PATHS = ("/", "/index.html", "/en/{}", "/de/{}/", "/fr/{}.html", "/page/{}", "/p?id={}", "/a/b/{}")
#: How often a hand-written url counts.
COPIES = 2
SYLLABLES = ("ba", "ren", "tol", "mi", "sha", "dor", "ve", "lin", "qua", "stel", "or", "an", "er", "hun", "gra", "pe", "wick", "ton", "field", "ley")
ENDINGS = ("com", "org", "net", "info", "de", "fr")


def labelled_urls() -> list[tuple[str, float]]:
    """(url, label) of the small labelled table, 1 for an unwanted one, no host twice.

    Made by rule from the words above: unwanted hosts with paths that say nothing,
    ordinary and invented hosts with such and with ordinary paths, and the same kinds of
    hosts with unwanted paths, so that hosts and paths both carry a signal.
    """

    def plain(i: int) -> str:
        return PLAIN_PATHS[i % len(PLAIN_PATHS)].format(17 * i % 997)

    def invented(i: int) -> str:
        n = len(SYLLABLES)
        return "".join(SYLLABLES[x % n] for x in (i, 3 * i + i // n, 7 * i + i // 7)[: 2 + i % 2])

    rows = []
    for i in range(360):
        bad, good = (words[i % 24] for words in (BAD_HOSTS, GOOD_HOSTS))
        end = f".example-{i}.{ENDINGS[i % 6]}" if i % 3 == 0 else f".{ENDINGS[i % 6]}"
        host = f"{good}-{GOOD_HOSTS[(i // 24 + 7 * i + 1) % 24]}{i}" if i % 2 else f"{invented(i)}{i if i > 40 else ''}"
        other = f"{invented(i + 400)}-{i}" if i % 2 else f"{good}{i}"
        bad_host = (f"{bad}-{invented(i)}", f"my{bad}{i}", f"best-{bad}-{BAD_HOSTS[(i + i // 24 + 1) % 24]}{i}")[i % 3]
        bad_path = f"/{BAD_PATHS[i % 16]}/{i}" if i % 2 else f"/{plain(i).strip('/').split('?')[0]}/{BAD_PATHS[i % 16]}.html"
        rows += [
            (f"https://{bad_host}{end}{plain(i)}", 1.0), (f"http://{other}{end}{bad_path}", 1.0),
            (f"https://{host}{end}{plain(i + 3)}", 0.0), (f"http://w{other}{end}/{GOOD_PATHS[i % 16]}/{i}", 0.0),
        ]
    return rows


def training_urls(without: str = "") -> list[tuple[str, float]]:
    """The whole labelled table: the urls made by rule, and COPIES of each hand-written one; without a kind, where a test holds it out."""
    return labelled_urls() + [row for kind, rows in kinds().items() if kind != without for row in rows] * COPIES


def labelled(spark: SparkSession) -> DataFrame:
    """url and label (1: unwanted) of the small training table."""
    return spark.createDataFrame(training_urls(), "url string, label double").coalesce(1)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    on_host = (host == rule[0]) | host.endswith(f".{rule[0]}")
    return on_host & path.startswith(rule[1])


def by_rule(host: Column, path: Column, rules, value) -> Column:
    """value(rule) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    return reduce(
        lambda found, rule: found.when(fits(host, path, rule), F.lit(value(rule))),
        ordered,
        F.when(F.lit(False), F.lit(None).cast("string")),
    )


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of ^host$ and of the path, marked by where they stand."""
    host, path = F.concat(F.lit("^"), host, F.lit("$")), path

    def cut(text: Column, n: int, mark: str) -> Column:
        places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1)))
        found = F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: F.substring(text, i, n))
        return F.transform(found, lambda g: F.concat(F.lit(mark), g))

    return F.array_distinct(F.concat(*[cut(x, n, m) for x, m in ((host, "h"), (path, "p")) for n in GRAMS]))


def url_verdicts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, training: DataFrame | None = None
) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, score.

    score is the model's probability that the url is unwanted; without a rule the
    verdict is block from 0.5. A null url, or one without ://, has an empty host and
    path, no rule, and the model's verdict on them. Ids may be null or repeat; an
    empty table gives an empty result. Other columns of pages are ignored.
    """
    training = training if training is not None else labelled(pages.sparkSession)

    def featured(df: DataFrame, url: str, *keep: str) -> DataFrame:
        parts = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
        parts = parts.withColumn("grams", grams(F.col("host"), F.col("path")))
        return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(
            parts.select(*keep, "host", "path", "grams")
        )

    model = LogisticRegression(regParam=0.01, maxIter=50, standardization=False).fit(
        featured(training, "url", "label")
    )
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    scored = model.transform(featured(rows, "url", "page_id"))
    score = vector_to_array("probability")[1]
    host, path = F.col("host"), F.col("path")
    return scored.select(
        "page_id", "host", "path",
        by_rule(host, path, rules, lambda r: r[0] + r[1]).alias("rule"),
        F.coalesce(by_rule(host, path, rules, lambda r: r[2]), F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"),
    )


def op3_url_filter(spark, sf_dir):
    return url_verdicts(table(spark, sf_dir, "pages"))
