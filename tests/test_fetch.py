"""Redirects, versions in time, relative links and failed fetches against plain versions."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tablewright.functions import urls
from tablewright.operators import export, redirects, versions
from tablewright.plans import batch
from tests.test_batch import TOPS

MADE = "url string, renderer string, source_url string, html string, markdown string"


def plain_ends(steps):
    """(final url, hops, smallest url of the circle) by walking."""
    out = {}
    for url in steps:
        seen, at = [url], steps[url]
        while at in steps and at not in seen:
            seen.append(at)
            at = steps[at]
        out[url] = (at, len(seen), None) if at not in steps else (None, None, min(seen[seen.index(at) :]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_redirects_equal_walking(spark, seed):
    r = random.Random(seed)
    n = 120
    steps = {f"u{i:03}": f"u{r.randint(0, n + 20):03}" for i in range(n)}
    steps |= {f"c{i:03}": f"c{i + 1:03}" for i in range(70)}  # a long chain, a long circle with a tail, and one that leads to itself
    steps |= {f"r{i:03}": f"r{(i + 1) % 37:03}" for i in range(37)} | {f"t{i:03}": f"t{i + 1:03}" for i in range(50)} | {"t050": "r011", "self": "self"}
    rows = [*steps.items(), ("u000", "zzz"), (None, "x"), ("y", None)]
    steps["u000"] = min(steps["u000"], "zzz")
    got = redirects.final_urls(spark.createDataFrame(rows, "url string, to string").repartition(3)).collect()
    assert len(got) == len(steps) and {g.url: (g.final_url, g.hops, g.loop) for g in got} == plain_ends(steps)


def test_redirects_of_nothing_and_without_circles(spark):
    assert redirects.final_urls(spark.createDataFrame([], "url string, to string")).collect() == []
    got = redirects.final_urls(spark.createDataFrame([("a", "b"), ("b", "c")], "url string, to string")).collect()
    assert sorted((g.url, g.final_url, g.hops, g.loop) for g in got) == [("a", "c", 2, None), ("b", "c", 1, None)]


def test_relative_links_as_urljoin(spark):
    bases = ["http://h.com/a/b/c/d/e/f/g", "http://h.com/a", "http://h.com/a/", "http://h.com", "https://h.com:8080/x/y.html?q=1#f"]
    hrefs = [
        "../" * 6 + "x", "../../x", "..", "../", ".", "./", "x/../y", "x/./y/..", "x/..", "/a/../../b", "//o.com/p/../q", "?z=../1", "y?u=/../v", "...", "..x/.y",
        "http://k.com/m/../n/.", "x/" + "../" * 9 + "end", "x#/../y",
    ]
    rows = [(b, h) for b in bases for h in hrefs]
    got = spark.createDataFrame(rows, "b string, h string").select("b", "h", urls.resolved(F.col("b"), F.col("h")).alias("u")).collect()
    for g in got:
        want = urljoin(g.b, g.h)
        if "://" in g.h or g.h.startswith("//"):  # urljoin leaves the dots of other hosts
            site, path = want.split("://")[0] + "://" + want.split("/")[2], "/" + want.split("/", 3)[3]
            want = urljoin(site + "/", path)
        if want.count("/") == 2:
            want += "/"
        assert g.u == want.replace("com?", "com/?"), (g.b, g.h)
    own = [("http://h.com/a/b", "%2e%2E/c", "http://h.com/c"), ("http://h.com/a/b/", ".%2e/%2e/d", "http://h.com/a/d"), ("http://h.com/", "a//b/../c", "http://h.com/a//c")]
    for r in spark.createDataFrame(own, "b string, h string, want string").select("want", urls.resolved(F.col("b"), F.col("h")).alias("u")).collect():
        assert r.u == r.want


def test_as_of_equals_looking_back(spark):
    r = random.Random(3)
    seen = [(r.choice("abc"), r.randint(0, 300)) for _ in range(200)] + [("hot", r.randint(0, 3000)) for _ in range(400)] + [(None, 5), ("a", None)]
    asks = [(i, r.choice(["a", "b", "c", "hot", "none", None]), r.randint(-5, 3000)) for i in range(500)] + [(900, "a", None)]
    a, v = spark.createDataFrame(asks, "id int, k string, t int"), spark.createDataFrame(seen, "k string, s int").repartition(6)
    for parts in ("1", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {g.id: g.version_time for g in versions.as_of(a, v, ["k"], "t", "s").collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(got) == len(asks)
        for i, k, t in asks:
            want = [s for key, s in seen if k is not None and key == k and s is not None and t is not None and s <= t]
            assert got[i] == max(want, default=None), (i, k, t)


def test_one_version_at_a_moment(spark):
    rows = [
        ("u", "static", None, "old", "", "2024-01-01 00:00:00", 200, "text/html"), ("u", "static", None, "new", "", "2024-01-03 00:00:00", 200, "text/html"),
        ("u", "static", None, "late", "", "2024-02-01 00:00:00", 200, "text/html"), ("u", "rendered", None, "", "m", None, None, None),
        ("v", "static", None, "x", "", "2024-01-01 00:00:00", 404, "text/html"), ("w", "static", None, "%PDF", "", "2024-01-01 00:00:00", 200, "application/pdf"),
        ("x", "static", None, " ", None, "2024-01-01 00:00:00", 204, "application/xhtml+xml"), ("y", "static", None, "z", "", "2024-03-01 00:00:00", 200, "text/html"),
        (None, "static", None, "z", "", "2024-01-01 00:00:00", 200, "text/html"),
    ]
    docs = spark.createDataFrame(rows, MADE + ", at string, status int, content_type string").withColumn("fetched_at", F.to_timestamp("at")).drop("at")
    got = {(g.url, g.renderer): (g.html, g.failure) for g in versions.one_version(docs, "2024-01-10 00:00:00").collect()}
    assert got == {
        ("u", "static"): ("new", None), ("u", "rendered"): ("", None), ("v", "static"): ("x", "http-status 404"),
        ("w", "static"): ("%PDF", "not-html application/pdf"), ("x", "static"): (" ", "empty-page"),
    }
    last = {(g.url, g.renderer): g.html for g in versions.one_version(docs).collect()}
    assert last[("u", "static")] == "late" and last[("y", "static")] == "z"


ASK = "request_id string, brand string, name string, size_guide_url string, audience string, garment_category string, size_system string, fallback_size_system string, fallback_urls array<string>"


def asked(spark, pairs):
    return spark.createDataFrame([(i, i, None, u, "men", "tops", "INT", None, None) for i, u in pairs], ASK)


def test_failed_repeated_and_redirected_documents(spark):
    dead_end = '<html><body><h1>Tops size guide</h1><p>Our men tops size chart is shown by a script.</p></body></html>'
    rows = [
        ("http://a.com/tops", "rendered", None, "", TOPS, 200), ("http://a.com/tops", "rendered", None, "", TOPS + "\n", 200),
        ("http://b.com/size-guide/mens-tops", "static", None, dead_end, "", 200), ("http://b.com/size-guide/mens-tops", "rendered", None, "", "", 502),
        ("http://c.com/tops", "static", None, "", "", 500), ("http://e.com/new/tops", "rendered", None, "", TOPS, 200),
        ("http://f.com/tops", "static", None, "<h1>Tops size guide</h1><![xyz[ 1 ]]>", "", 200),
    ]
    docs = spark.createDataFrame(rows, MADE + ", status int")
    steps = spark.createDataFrame([("http://d.com/old", "http://e.com/mid"), ("http://e.com/mid", "http://e.com/new/tops")], "url string, to string")
    pairs = [("A", "http://a.com/tops"), ("A", "http://a.com/tops"), ("B", "http://b.com/size-guide/mens-tops"), ("C", "http://c.com/tops"), ("D", "http://d.com/old")]
    pairs += [("F", "http://f.com/tops"), ("G", "http://a.com/tops"), ("H", "http://a.com/tops")]
    reports, sizes = batch.resolve(asked(spark, pairs), docs, steps=steps)
    by = {r.request_id: r for r in reports.collect()}
    codes = {k: [i.code for i in r.all_issues] for k, r in by.items()}
    assert len(by) == 7 and by["A"].has_guide and by["A"].n_candidates == 1
    assert sizes.where("request_id = 'A'").count() == 7
    assert "rendered-refetch-failed" in codes["B"] and not by["B"].has_guide
    assert [i.details for i in by["B"].all_issues if i.code == "rendered-refetch-failed"] == [["http-status 502"]]
    assert codes["C"] == ["server-error"] and by["C"].all_issues[0].details == ["static http-status 500"] and by["C"].run_status == "error"
    assert by["D"].has_guide and by["D"].doc_url == "http://e.com/new/tops"
    # a page that the parser can't take is told of, and the others are read
    assert codes["F"] == ["server-error"] and by["F"].all_issues[0].details[0].startswith("static parse-error AssertionError")
    # equal questions have equal answers, each with its own request in the trace
    for k in "GH":
        assert by[k].has_guide and by[k].trace[0].label == k and by[k].score == by["A"].score
    assert sizes.where("request_id = 'G'").count() == 7
    seen, counts = export.observed(reports)
    seen.write.format("noop").mode("overwrite").save()
    assert counts.get == export.status_counts(reports).first().asDict() == {"accepted": 4, "review": counts.get["review"], "error": counts.get["error"], "waiting": 0}


def test_links_are_scored_once_for_equal_questions(spark):
    hub = '<html><body><h1>Help</h1><a href="/size-guide/men-tops">Men\'s tops size guide</a></body></html>'
    docs = spark.createDataFrame([("http://b.com/help", "static", None, hub, ""), ("http://b.com/size-guide/men-tops", "rendered", None, "", TOPS)], MADE)
    pairs = [(f"r{i}", "http://b.com/help") for i in range(300)]
    ask = batch.attempts(asked(spark, pairs)).withColumn("question", F.lit("same"))
    assert batch.questions(ask).count() == 1
    reports, sizes = batch.resolve(asked(spark, pairs), docs)
    assert reports.where("has_guide AND hop = 1").count() == 300 and sizes.count() == 2100
    assert reports.select("trace").distinct().count() == 300
