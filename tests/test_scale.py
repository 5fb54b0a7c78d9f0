"""How much of a plan's work is spread, and that it isn't done over."""

import random

from pyspark.sql import functions as F

from tablewright.operators import candidates, matrix, redirects, validate
from tablewright.sources import html

TABLE = [["Size", "Chest (cm)", "Waist in", "Chest"], ["32", "88", "30", " 90 "], ["M", "1 1/2", "", "x"], ["note", "1", "2", "3"]]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_of_one_split_are_dealt_to_all_tasks(spark):
    docs = spark.range(40, numPartitions=1).select(F.col("id").cast("string").alias("url"), F.lit("static").alias("renderer"), F.lit("<p>a</p>").alias("html"))
    found = html.parse(docs).groupBy(F.spark_partition_id()).count().collect()
    assert len(found) > 8 and sum(r["count"] for r in found) == 40


def test_markdown_of_one_split_is_made_by_all_tasks(spark):
    docs = spark.range(40, numPartitions=1).select(F.col("id").cast("string").alias("url"), F.lit("<h1>a</h1>").alias("html"), F.lit("").alias("markdown"))
    found = html.with_markdown(docs).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("markdown").alias("m")).collect()
    assert len(found) > 8 and sum(r.n for r in found) == 40 and {r.m for r in found} == {"# a\n\na"}


def test_body_leaves_heads_out():
    page = "a<head>b<style>c</style></head>d<div><head>e<head>f</head></head>g<script>h</script></div>i"
    root = html.parsed(page)
    assert html.body_of(root) == html.clean(root.text(frozenset(("head", *html.RAW)))) == "adgi"


def test_measures_of_a_table_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, TABLE, "unknown", "in")], "id int, matrix array<array<string>>, orientation string, unit string")
    found = matrix.measures(df, ["id"])
    assert "Exchange" not in plan(found) and "Exchange" not in plan(matrix.measured(df, ["id"]))
    want = [(1, "32", "chest", 228.6, "90"), (1, "32", "waist", 76.2, "30"), (2, "M", "chest", 1.5, "1 1/2")]
    assert sorted((r.row_ord, r.label, r.field, r.low_cm, r.raw) for r in found.collect()) == want


def test_a_matrix_is_cleaned_once(spark):
    rows = [[[None, " a\tb ", "c"], ["", "  "], ["d"], [], ["é", "x y", "\u00a0z"]], [], None, [[]]]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(rows)], "i int, matrix array<array<string>>").withColumn("made", matrix.normal(F.col("matrix")))
    assert plan(df).count("regexp_replace") == 1  # and not again for the width of each row
    assert [r.made for r in df.orderBy("i").collect()] == [[["", "a b", "c"], ["d", "", ""], ["é", "x y", "z"]], [], None, []]


def walked(tree):
    return [(n.tag, n.attrs, n.begin, n.end, [c if isinstance(c, str) else c.tag for c in n.children]) for n in tree.nodes]


def test_plain_markup_is_cut_as_the_parser_does(monkeypatch):
    plain = [f"<{t}>" for t in ("p", "table", "tr", "TD", "h2", "br", "li", "b1")] + ["</p>", "</table>", "</tr>", "</TD>", "</x>", '<a href="/s" HREF="t"\n title="q">', "S", " > ", '"=\n', "\t", "é"]
    other = ["&amp;", "<", "<br/>", "<p a=b>", "<p a='b'>", "<!-- <p> -->", "<script>", "<TITLE>", "</p >", '<p a="<">', "</>"]
    rng, calls, left = random.Random(5), [], 0
    feed = html.Tree.feed
    monkeypatch.setattr(html.Tree, "feed", lambda self, page: (calls.append(page), feed(self, page)))
    for k in range(3000):
        page = "".join(rng.choice(plain + other * (k % 2)) for _ in range(rng.randrange(20)))
        one, two = html.Tree(), html.Tree()
        one.take(page)
        assert not calls or k % 2
        left += len(calls)
        calls.clear()
        feed(two, page)
        two.close()
        assert walked(one) == walked(two) and "".join(one.bare) == "".join(two.bare)
    assert 1000 < left < 1500


def test_measured_is_the_wide_form_of_measures(spark):
    turned = [list(x) for x in zip(*TABLE, strict=True)]
    rows = [(1, TABLE, "size-rows", "cm"), (2, turned, "size-columns", "in"), (3, turned, "unknown", None), (4, TABLE, "conversion-grid", "cm"), (5, [], "unknown", "cm"), (6, None, "size-rows", "cm")]
    df = spark.createDataFrame(rows, "id int, matrix array<array<string>>, orientation string, unit string")
    own, long = (sorted(map(str, d.collect())) for d in (matrix.measured(df, ["id"]), matrix.wide(matrix.measures(df, ["id"]), ["id"])))
    assert own == long and len(own) == 6


def test_tables_of_one_split_are_dealt_to_all_tasks(spark):
    df = spark.range(40, numPartitions=1).select(
        F.lit("html-table").alias("kind"), F.lit([["Size", "Chest"], ["S", "88"]]).alias("matrix"), F.array(F.lit("Tops")).alias("heading_path"),
        F.lit("Tops").alias("title"), F.lit("").alias("subheading"), F.lit("").alias("nearby"),
    )
    found = candidates.describe(df).groupBy(F.spark_partition_id()).count().collect()
    assert len(found) > 8 and sum(r["count"] for r in found) == 40


def test_labels_are_brought_to_their_form_once(spark):
    df = spark.createDataFrame(
        [([("S", ["chest"]), ("XL", ["waist"])], ["S", "M"])],
        "rows array<struct<label:string,fields:array<string>>>, size_axis array<string>",
    ).selectExpr(
        "*", "'tshirts' AS asked_category", "'tshirts' AS category", "'INT' AS asked_system", "'INT' AS size_system", "'men' AS asked_audience", "'men' AS audience",
        "'direct-guide-page' AS document_kind", "'cm' AS unit", "false AS link_followed", "0.0D AS navigation", "true AS tabular",
    )
    found = validate.validate(df)
    # one form for the labels and one for the axis, not one in each comparison
    assert plan(found.select("issues")).count("tall|petite|regular|long|short") == 2
    details = {i.code: i.details for i in found.collect()[0].issues}
    assert details["missing-size-sequence"] == ["M", "L"] and details["invented-row-labels"] == ["XL"] and details["size-breadth-warning"] == ["M"]


def ends_by_walks(steps):
    """all_ends() by sets of walks, as its query's SQL has them."""
    walks = level = {(u, t, 1) for u, t in steps}
    while level:
        level = {(u, t2, n + 1) for u, t, n in level if n < redirects.MOST for s, t2 in steps if s == t} - walks
        walks = walks | level
    urls = {u for u, _ in steps}
    circle, out = {u for u, t, _ in walks if u == t}, {}
    for u in urls:
        ends = [(t, n) for x, t, n in walks if x == u and t not in urls]
        loops = [t for x, t, _ in walks if x == u and t in circle]
        out[u] = (max(t for t, _ in ends), max(n for _, n in ends), None) if ends else (None, None, min(loops))
    return out


def test_every_target_of_a_url_is_followed(spark):
    steps = [
        *zip("abb", "bcd"), ("d", "e"),  # a fork behind a step
        *zip("ffgg", "gzfy"),  # a circle with a way out
        *zip("hiijkk", "ijkhki"), ("l", "h"),  # circles through forks without one
        *zip("mmnoo", "nonmq"), *zip("pp", "pp"), ("r", "p"),
    ]
    rng = random.Random(7)
    steps += [(f"x{rng.randrange(60)}", f"x{rng.randrange(75)}") for _ in range(70)]
    df = spark.createDataFrame(steps, "url string, to string")
    found = {r.url: (r.final_url, r.hops, r.loop) for r in redirects.all_ends(df).collect()}
    assert found == ends_by_walks(set(steps))
