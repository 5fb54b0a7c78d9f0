"""Column functions and operators on values worked out by hand."""

import time

import pytest
from pyspark.sql import functions as F

from tablewright.functions import categories, navigation, sizes, text, units, urls
from tablewright.operators import candidates, export, links, markdown, matrix, phrases, select, validate
from tablewright.sources import html, requests, sinks


def column(spark, values, made, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", made(F.col("v")).alias("x")).orderBy("i").collect()]


def test_text(spark):
    raw = ["  Épaule  T-Shirt's ", "ß Œ", "", "Ça  va"]
    assert column(spark, raw, text.token) == [text.plain_token(x) for x in raw] == ["epaule t shirt s", "", "", "ca va"]
    assert column(spark, raw, text.clean) == ["Épaule T-Shirt's", "ß Œ", "", "Ça va"]
    assert column(spark, ["-Ann & Co-", "é"], text.slug) == ["ann-co", "e"]
    assert column(spark, ["men's fit", "women fit", "mens"], lambda c: text.has_any(text.token(c), ["men", "ça va"])) == [True, False, False]
    assert column(spark, ["a, b\n\n ,c", " , ", None], text.list_or_null) == [["a", "b", "c"], None, None]


def test_ranges(spark):
    raw = ['32 1/2–34"', '43–46 1/2"', "28.1", "5'7\" - 6'0\"", "88 à 96", "88à96", "1,234", "3/0", "S", "", None, "90 - 95 - 99", "-5", "96 to 88"]
    got = column(spark, raw, lambda c: units.range_cm(c, F.lit("in")))
    assert [(r.low, r.high) if r else None for r in got[:3]] == [(82.6, 86.4), (109.2, 118.1), (71.4, 71.4)]
    got = [(r.low, r.high) if r else None for r in column(spark, raw, units.value_range)]
    assert got[3:] == [(67, 72), (88, 88), (88, 96), (1.234, 1.234), None, None, None, None, (90, 95), (-5, -5), (88, 96)]
    assert column(spark, ["cm", "86cm", "in.", "(in)", '32"', "inch cm", "win"], units.unit_of) == ["cm", "unknown", "in", "in", "in", "mixed", "unknown"]
    assert column(spark, ["relationship", "country", "taille corporelle", "Largeur du pied", "Épaule", "x"], units.field_of) == ["hips", "neck", "waist", "footLength", "shoulder", None]
    assert column(spark, [[35.0, 40.0], [90.0, 100.0], [5.0], [70.0, 79.0]], units.unit_of_values, "array<double>") == ["in", "cm", "unknown", "cm"]
    assert column(spark, [-2.5, 2.5], lambda c: units.round_half_up(c, 0), "double") == [-2.0, 3.0]


def test_sizes(spark):
    raw = ["SM", "2XL Tall", "32/34", "W32 L34", "32 in", "86 cm", "2X", ""]
    assert column(spark, raw, sizes.is_size) == [True, True, False, True, True, False, True, False]
    assert column(spark, raw, sizes.canonical) == ["S", "XXL", "32 34", "W32 L34", "32 IN", "86 CM", "2X", ""]
    axes = [["S", "40"], ["w32 l34"], ["US 8", "US 9"], ["US 8", "UK 9"], ["34", "36"], [], None]
    assert column(spark, axes, sizes.axis_system, "array<string>") == ["INT", "WAIST_INSEAM", "US", "UNKNOWN", "NUMERIC", "UNKNOWN", "UNKNOWN"]
    assert column(spark, [["XS", "L"], ["S", "M"], ["M"]], sizes.sequence_gaps, "array<string>") == [["S", "M"], [], []]


def test_categories(spark):
    assert column(spark, ["Tops", "coats", "polo", "body guide", None], categories.asked_category) == ["tshirts", "jackets", None, "generic-body-guide", None]
    rule = lambda c: categories.section_rule(c, c, F.array().cast("array<string>"))["category"]
    assert column(spark, ["Jeans", "S Short", "Tops & tees", "Shirts", "How to measure", "Shoe size", "x"], rule) == ["jeans", "shorts", "tops", "shirts", "generic-body-guide", "shoes", "unknown"]
    pairs = spark.createDataFrame([(None, "tops"), (None, "jeans"), ("tshirts", "hoodies"), ("jeans", "pants"), ("shoes", "shoes")], "a string, f string")
    assert [r.m for r in pairs.select(categories.match_mode(F.col("a"), F.col("f")).alias("m")).collect()] == ["none", "exact", "curated", "none", "exact"]


def test_urls(spark):
    df = spark.createDataFrame([("https://WWW.a.co.uk:443/x/y?q#f", "../z", None), ("http://h.com", "b c", "http://h.com/")], "b string, h string, n string")
    row = df.select(urls.origin(F.col("b")).alias("o"), urls.brand(F.col("b")).alias("d"), urls.resolved(F.col("b"), F.col("h")).alias("r"), urls.path(F.col("b")).alias("p")).collect()
    assert (row[0].o, row[0].d, row[0].r, row[0].p) == ("https://www.a.co.uk", "co.uk", "https://WWW.a.co.uk:443/z", "/x/y") and row[1].p == "/"
    assert column(spark, ["http://images.a.com/x", "http://a.com/b.PNG?x", "http://a.com/b"], urls.is_asset) == [True, True, False]
    assert column(spark, ["http://usa.tommy.com/x", "http://www.bananarepublic.gap.com", "nope"], urls.brand) == ["tommyhilfiger", "banana-republic", ""]
    assert column(spark, ["#x", "javascript:1", "", None], lambda c: urls.resolved(F.lit("http://a.com/"), c)) == [None] * 4


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        (1, "html-table", [["", "S", "S Tall", "M"], ["Chest", "80", "82", "84"], ["Waist", "70", "", "74"]], "Tops"),
        (2, "html-table", [["US", "EU"], ["8", "41"]], "Conversion"),
        (3, "html-table", [["Size", "Chest"], ["S", "80"], ["  "]], "x"),
        (4, "advisory-text", [["Fit guide"], ["words"]], "Fit guide"),
        (5, "html-table", [["a"]], "too small"),
    ]
    df = spark.createDataFrame(rows, "id int, kind string, matrix array<array<string>>, title string")
    return candidates.describe(df.withColumns({"heading_path": F.array("title"), "subheading": F.lit(None).cast("string"), "nearby": F.lit(None).cast("string")})).cache()


def test_describe_and_reshape(tables):
    got = {r.id: r for r in candidates.evidence(tables).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1].orientation == "size-columns" and got[2].orientation == "conversion-grid"
    assert got[3].matrix == [["Size", "Chest"], ["S", "80"]] and got[3].orientation == "unknown" and not got[4].tabular
    assert got[1].evidence.startswith("Tops | Headers: , S, S Tall, M")
    long = {(r.id, r.row_ord, r.field): r.low_cm for r in matrix.measures(tables, ["id"]).collect()}
    assert long == {(1, 1, "chest"): 80, (1, 1, "waist"): 70, (1, 2, "chest"): 82, (1, 3, "chest"): 84, (1, 3, "waist"): 74, (3, 1, "chest"): 80}
    wide = {(r.id, r.label): r for r in matrix.wide(matrix.measures(tables, ["id"]), ["id"]).collect()}
    assert (wide[1, "S Tall"].canonical, wide[1, "S Tall"].variant, wide[1, "S Tall"].waist_low) == ("S", "tall", None)


def test_dedupe_keeps_the_first_place(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 0), (1, "b", 5.0, 1), (1, "a", 2.0, 2), (1, "a", 2.0, 3)], "k int, s string, v double, ord int")
    assert [(r.s, r.ord, r.new_ord) for r in candidates.dedupe(df, ["k"], ["s"], "v").orderBy("new_ord").collect()] == [("a", 2, 0), ("b", 1, 1)]


def test_unit_twins(tables):
    inch = tables.where("id = 1").withColumns({"id": F.lit(9), "unit": F.lit("in")})
    both = tables.where("id = 1").unionByName(inch).withColumns(
        {"asked_category": F.lit("tshirts"), "asked_system": F.lit("INT"), "document_kind": F.lit("direct-guide-page"), "navigation": F.lit(0.0), "confidence": F.lit(0.9), "page": F.lit(1)}
    )
    got = {r.id: r for r in select.pick(select.score(both), ["page"], "id").collect()}
    assert got[1].selected and got[1].unit_twin and not got[9].selected and got[1].gap == pytest.approx(0.8)


def test_issues_and_status(spark):
    df = spark.createDataFrame([("polo", "SOCK", "robots"), ("tops", "INT", "men"), (None, None, None)], "c string, s string, a string")
    found = df.select(validate.request_issues(F.col("c"), F.col("s"), F.col("a")).alias("i")).select(validate.codes(F.col("i")).alias("c"), validate.status(F.col("i")).alias("s")).collect()
    assert [len(r.c) for r in found] == [3, 0, 0] and [r.s for r in found] == ["rejected", "accepted", "accepted"]


def test_exports(spark):
    row = {"label": "S Tall", "canonical": "S", "variant": "tall", "u": "x", **{f"{f}_{e}": None for f in ("chest", "waist", "hips", "height", "footLength", "inseam", "outseam", "neck", "shoulder", "sleeve", "footWidth") for e in ("low", "high")}}
    row.update(chest_low=80.0, footLength_high=26.04, inseam_low=70.0)
    kind = ", ".join(f"{k} {'double' if k[-4:] in ('_low', 'high') else 'string'}" for k in row)
    got = export.import_rows(export.strict_rows(spark.createDataFrame([row], kind)), "u").select("*", sinks.payload(d=F.col("dimensions")).alias("json")).first()
    assert got.dimensions["footLengthMm"].max == 260 and got.ignored == ["inseam"] and got.strict.chest_cm == 80
    assert got.notes == "Variant: tall. Source label: S Tall." and '"target":null' in got.json and "waistCm" not in got.json


def test_links(spark):
    base = {"id": 1, "url": "https://www.nike.com/help", "asked_category": "tshirts", "asked_system": "INT", "fallback_urls": ["/mine"]}
    docs = spark.createDataFrame([base], "id int, url string, asked_category string, asked_system string, fallback_urls array<string>")
    known = links.official(docs, ["id", "url", "asked_category", "asked_system"])
    assert [r.href for r in known.orderBy("ord").collect()] == ["https://www.nike.com/mine", "https://www.nike.com/size-fit/mens-tops-alpha"]
    page = [("Men's tops size chart", "/size-chart/mens-tops"), ("Women size guide", "/size-guide/women"), ("Nike Dri-FIT tee $30", "/t/tee-1"), ("Cart", "/cart"), ("Size guide", "#x")]
    raw = docs.crossJoin(spark.createDataFrame([(i, h, t) for i, (t, h) in enumerate(page)], "ord int, href string, label string")).drop("fallback_urls")
    raw = raw.withColumns({"heading_path": F.array().cast("array<string>"), "nearby": F.lit(""), "resolver": F.lit("generic")})
    best = links.follow(links.best_per_url(links.score(raw.unionByName(known)), ["id"]), ["id"], F.lit(True))
    got = {r.label: r for r in best.collect()}
    assert got["Fallback guide fourni 1"].followed and got["Men's tops size chart"].pool == 2
    assert "women" in got["Women size guide"].hard and "product-page" in got["Nike Dri-FIT tee $30"].hard and "Cart" not in got
    clear = links.clear_winner(best, ["id"], F.lit(False)).where("clear").collect()
    assert len(clear) <= 1 and got["Men's tops size chart"].link_score > got["Women size guide"].link_score
    step = best.where("followed").select(links.trace_step().alias("s")).first().s
    assert step.kind == "brand-fallback" and step.confidence <= 0.98


def test_document_kinds(spark):
    df = spark.createDataFrame([(0, 0.0, 0, 0, 0, True), (2, 0.0, 0, 0, 0, False), (1, 2.0, 0, 0, 0, False), (1, 3.0, 0, 0, 0, False), (0, 0.0, 2, 2, 0, False), (0, 0.0, 1, 1, 1, False)], "a int, b double, c int, d int, e int, f boolean")
    got = [r.k for r in df.select(navigation.document_kind(*[F.col(c) for c in "abcdef"]).alias("k")).collect()]
    assert got == ["irrelevant", "guide-hub-page", "irrelevant", "guide-hub-page", "multi-guide-page", "direct-guide-page"]


def test_markdown(spark):
    md = "# A\n## B\n| Size | Chest |\n|---|---|\n| S | 80 |\n| | |\n### C\nSize\tChest\nS\t80\nM\t84\nx [t](/a) ![i](/b)\n"
    lines = markdown.lines(spark.createDataFrame([(1, md), (2, None), (3, "")], "k int, markdown string"), ["k"])
    table = markdown.piped_tables(lines, ["k"]).collect()
    assert [(r.k, r.title, r.heading_path, r.matrix) for r in table] == [(1, "B", ["A", "B"], [["Size", "Chest"], ["S", "80"]])]
    assert [(r.title, len(r.matrix)) for r in markdown.loose_grids(lines, ["k"]).collect()] == [("C", 3)]
    assert [(r.href, r.label, r.heading_path) for r in markdown.links(lines, ["k"]).collect()] == [("/a", "t", ["A", "B", "C"])]


def test_html():
    root = html.parsed('<div><h2>T</h2><p>one<p>two<table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul><a href="/q" title="q"><img></a></div>')
    kinds = {t[1]: t for t in html.tables_of(root)}
    assert kinds["html-table"][2] == [["a", "b"], ["c"]] and kinds["html-table"][3] == ["T"] and kinds["html-table"][6] == "one two x y".replace(" x y", " xy")
    assert html.links_of(root)[0][1:3] == ("/q", "q")
    assert html.to_markdown("<h3>H</h3><table><tr><th>a<th>b<tr><td>1</table>").split("\n\n")[:4] == ["### H", "a | b", "--- | ---", "1 | "]
    assert html.tables_of(html.parsed("")) == [] and html.loose_row("a  b") == ["a", "b"] and html.loose_row("a b") == []


def test_uploads(spark):
    raw = ['{"sources":[{"brand":"A","entry_url":"u","fallback_urls":[" x ",1,""],"target":{"gender":"men","category":"body"}},{"brand":1,"url":"u"}]}', "[]", "oops", '{"a":1}']
    got = requests.normalised(requests.records(spark.createDataFrame([(x,) for x in raw], "json string"))).collect()
    assert [(r.brand, r.size_guide_url, r.audience, r.garment_category, r.fallback_urls) for r in got] == [("A", "u", "men", "generic-body-guide", ["x"])]
    assert column(spark, ["http://a.b/", "ftp://a", "http://[::1]/", "http://a." + "x" * 2100], lambda c: requests.guard(F.lit("b"), c)) == [None, "url-scheme", "url-forbidden-host", "url-too-long"]


def test_nested_sections_cost_their_depth():
    deep = "<div>" * 3000 + "<p>Size</p><p>guide</p>" + "</div><p>x size</p>" * 3000
    began = time.perf_counter()
    root = html.parsed(deep)
    assert html.tables_of(root) == [] and html.links_of(root) == []
    assert time.perf_counter() - began < 3


def test_gate_words_at_the_ends_of_elements():
    root = html.parsed("<div>re<b>size</b>d <i>s\u00efze</i> <u>in</u>seam <s>Cha</s>rt</div>")
    by = {n.tag: n.whole[0].has_gate(*n.whole[1:]) for n in root.walk() if n.tag}
    assert by == {"div": True, "b": True, "i": True, "u": False, "s": False}
    assert not html.parsed("<div>resized</div>").whole[0].has_gate(0, 7)


def test_phrases_equal_looking_for_each(spark):
    texts = ["The size of the size chart", "of", "", None, "size-of-the", "THE SÏZE of", "chart of the the"]
    lists = {"a": ["size of the", "size"], "b": ["of", "the the", "of the"], "c": ["!", "chart of nothing"]}
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {(r.id, r.list, r.phrase): r.times for r in phrases.matches(df, phrases.lists(spark, **lists), "i", "t").collect()}
    want = {}
    for i, t in enumerate(texts):
        words = text.plain_token(t or "").split()
        for name, own in lists.items():
            for p in own:
                w = text.plain_token(p).split()
                n = sum(words[k : k + len(w)] == w for k in range(len(words) - len(w) + 1)) if w else 0
                if n:
                    want[(i, name, p)] = n
    assert got == want
    found = {r.id: r.lists for r in phrases.found_lists(df, phrases.lists(spark, **lists), "i", "t").collect()}
    assert found[0] == ["a", "b"] and 2 not in found and 3 not in found
