"""Queries that run the whole plan, validation, selection and the page parsers over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import urls
from tablewright.operators import candidates, export, links, markdown, matrix, select, validate
from tablewright.plans import batch
from tablewright.plans.catalogue import query, table
from tablewright.sources import html

#: Sizes of the made tables, and the cases of the made requests by supplier key modulo their number.
SIZES = ("XS", "S", "M", "L", "XL", "2XL", "3XL")
DIRECT, HUB, DEAD, SHOES, NUMERIC, BARRED, ABSENT, SPARE = range(8)
CASES = 8


def _table(first: str, rows: list[list[Column]], *heads: str) -> Column:
    lines = [f"| {' | '.join((first, *heads))} |", "|" + "---|" * (1 + len(heads))]
    body = [F.concat(F.lit("| "), *[x for c in r[:-1] for x in (c, F.lit(" | "))], r[-1], F.lit(" |")) for r in rows]
    return F.concat_ws("\n", F.lit("\n".join(lines)), *body)


def made_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(requests, documents): one request for each supplier, its page and where that leads made from the key."""
    k = F.col("s_suppkey")
    base = (80 + k % 5).cast("int")
    site = F.when(k % CASES == BARRED, F.concat(F.lit("http://10.0.0."), k % 200)).otherwise(F.concat(F.lit("http://shop"), k, F.lit(".com")))
    page = F.concat(site, F.when(k % CASES == HUB, F.lit("/help")).otherwise(F.lit("/page")))
    tops_rows = [
        [F.lit(s), F.concat(base + 4 * i, F.lit("-"), base + 4 * i + 4), (base + 4 * i - 10).cast("string"), (base + 4 * i + 5).cast("string")]
        for i, s in enumerate(SIZES)
    ]
    tops = F.concat(F.lit("# Men's tops size guide\n\n"), _table("Size", tops_rows, "Chest (cm)", "Waist (cm)", "Hips (cm)"))
    number_rows = [[F.lit(str(n)), (base + n).cast("string"), (base + n - 20).cast("string")] for n in (34, 36, 38, 40)]
    numeric = F.concat(F.lit("# Tops\n\n"), _table("Size", number_rows, "Chest (cm)", "Waist (cm)"))
    shoes = "# Shoes size chart\n\n| Size | Foot length (cm) | Foot width (cm) |\n|---|---|---|\n| 41 | 26 | 10 |\n| 42 | 27 | 10 |"
    hub = '<html><body><h1>Help</h1><a href="/size-guide/men-tops">Men\'s tops size guide</a> <a href="/size-guide/women">Women size guide</a></body></html>'
    dead = "<html><body><h1>Page not found</h1><p>Our size guide</p></body></html>"
    case = k % CASES
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", page.alias("page"), site.alias("site"), case.alias("case"), tops.alias("tops"), numeric.alias("numeric"))
    c = F.col("case")
    asked = rows.select(
        F.col("s_suppkey").cast("string").alias("request_id"), F.col("s_name").alias("brand"), F.lit(None).cast("string").alias("name"),
        F.col("page").alias("size_guide_url"), F.lit("men").alias("audience"), F.lit("tops").alias("garment_category"),
        F.when(c == SPARE, "EU").otherwise("INT").alias("size_system"), F.when(c == SPARE, "INT").alias("fallback_size_system"),
        F.lit(None).cast("array<string>").alias("fallback_urls"),
    )
    text = F.when(c.isin(DIRECT, BARRED, SPARE), F.col("tops")).when(c == SHOES, shoes).when(c == NUMERIC, F.col("numeric")).otherwise("")
    source = F.when(c == HUB, hub).when(c == DEAD, dead).otherwise("")
    own = rows.where(c != ABSENT).select(
        F.col("page").alias("url"), F.when(c.isin(HUB, DEAD), "static").otherwise("rendered").alias("renderer"),
        F.lit(None).cast("string").alias("source_url"), source.alias("html"), text.alias("markdown"),
    )
    led = rows.where(c == HUB).select(
        F.concat("site", F.lit("/size-guide/men-tops")).alias("url"), F.lit("rendered").alias("renderer"), F.lit(None).cast("string").alias("source_url"),
        F.lit("").alias("html"), F.col("tops").alias("markdown"),
    )
    return asked, own.unionByName(led)


_CASE = "s_suppkey % 8"


@query(f"""
SELECT s_suppkey, {_CASE} IN (0, 1, 7) AS has_guide,
  CASE WHEN {_CASE} IN (0, 1, 7) THEN 'accepted' WHEN {_CASE} = 3 THEN 'ambiguous' ELSE 'rejected' END AS report_status,
  CASE WHEN {_CASE} IN (0, 1, 7) THEN 'done' WHEN {_CASE} IN (5, 6) THEN 'error' ELSE 'review' END AS run_status,
  CASE {_CASE} WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'page-not-found-document' WHEN 3 THEN 'no-unique-section-match'
    WHEN 4 THEN 'size-system-mismatch' WHEN 7 THEN 'fallback-size-system-used' ELSE 'server-error' END AS codes,
  CASE WHEN {_CASE} = 5 THEN 'url-forbidden-host' END AS barred, CAST({_CASE} = 7 AS INTEGER) AS attempt,
  CASE {_CASE} WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 1 THEN 1 ELSE 0 END AS hop,
  CASE {_CASE} WHEN 1 THEN 'requested-url,followed-link' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE 'requested-url' END AS trace
FROM supplier""")
def batch_reports(spark, sf_dir):
    """The report of every supplier's request: direct pages, hubs, dead and foreign pages, barred hosts, the fallback."""
    reports, _ = batch.resolve(*made_corpus(spark, sf_dir))
    return reports.select(
        F.col("request_id").cast("long").alias("s_suppkey"), "has_guide", "report_status", "run_status",
        F.array_join(validate.codes(F.col("all_issues")), ",").alias("codes"), "barred", "attempt", "hop",
        F.array_join(F.transform("trace", lambda t: t["kind"]), ",").alias("trace"),
    )


_LABELS = "['XS', 'S', 'M', 'L', 'XL', 'XXL', '3XL']"


@query(f"""
WITH s AS (SELECT s_suppkey, 80 + s_suppkey % 5 AS base FROM supplier WHERE {_CASE} IN (0, 1, 7)),
r AS (SELECT *, unnest(range(0, 7)) AS i FROM s),
d AS (SELECT *, unnest([{{'n': 'chestCm', 'lo': base + 4 * i, 'hi': base + 4 * i + 4}}, {{'n': 'waistCm', 'lo': base + 4 * i - 10, 'hi': base + 4 * i - 10}},
  {{'n': 'seatHipsCm', 'lo': base + 4 * i + 5, 'hi': base + 4 * i + 5}}]) AS x FROM r)
SELECT s_suppkey, CAST(i AS INTEGER) AS sort_order, {_LABELS}[i + 1] AS label, x.n AS dimension, CAST(x.lo AS DOUBLE) AS low, CAST(x.hi AS DOUBLE) AS high,
  'cm' AS unit, i = 5 AS renamed FROM d""")
def batch_payload_rows(spark, sf_dir):
    """The dimensions of every row of every import payload."""
    reports, sizes = batch.resolve(*made_corpus(spark, sf_dir))
    rows = batch.import_payloads(reports, sizes).select(F.col("request_id").cast("long").alias("s_suppkey"), F.explode("payload.guide.rows").alias("r"))
    return rows.select("s_suppkey", "r.sort_order", "r.label", "r.notes", F.explode("r.dimensions").alias("dimension", "d")).select(
        "s_suppkey", "sort_order", "label", "dimension", F.col("d.min").alias("low"), F.col("d.max").alias("high"), "d.unit", (F.col("notes") != "").alias("renamed")
    )


@query(f"""
SELECT s_suppkey, 'sa-guide-' || slug || '-tshirts-int-' || s_suppkey AS guide_id, s_name || ' – tshirts (INT)' AS name, 'tshirt' AS category, true AS is_complete,
  slug || '_tshirts_int.json' AS file, 'XS,S,M,L,XL,XXL,3XL' AS strict_labels, CAST(7 * (80 + s_suppkey % 5 + 4) + 84 AS DOUBLE) AS strict_chests,
  'chest,waist,hips' AS visible, 'Men''s tops size guide · accepted' AS summary
FROM (SELECT *, lower(replace(s_name, '#', '-')) AS slug FROM supplier) WHERE {_CASE} IN (0, 1, 7)""")
def batch_guides(spark, sf_dir):
    """Every guide's payload, narrow export, visible columns and summary line."""
    reports, sizes = batch.resolve(*made_corpus(spark, sf_dir))
    strict = batch.strict_guides(reports, sizes).select(
        F.col("request_id").alias("of"), F.array_join(F.transform("sizes", lambda r: r["label"]), ",").alias("strict_labels"),
        F.aggregate("sizes", F.lit(0.0), lambda t, r: t + r["chest_cm"]).alias("strict_chests"),
    )
    good = reports.where("has_guide").select("request_id", "attempt", "new_ord", "summary")
    shown = export.visible_fields(sizes.join(good, ["request_id", "attempt", "new_ord"]), ["request_id"])
    made = batch.import_payloads(reports, sizes).join(shown, "request_id").join(good.select("request_id", "summary"), "request_id")
    return made.join(strict, F.col("request_id") == F.col("of")).select(
        F.col("request_id").cast("long").alias("s_suppkey"), "payload.guide.id", "payload.guide.name", "category", "is_complete", "file",
        "strict_labels", "strict_chests", F.array_join("visible", ",").alias("visible"), "summary",
    ).withColumnRenamed("id", "guide_id")


# ---- validation and selection


def _pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def made_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate for each order, its sizes read from the order's lines, with requests that it fits or doesn't."""
    k = F.col("o_orderkey")
    field = F.when(F.col("l_returnflag") == "A", "chest").when(F.col("l_returnflag") == "R", "inseam").otherwise("waist")
    fields = F.array_compact(F.array(field, F.when(F.col("l_discount") > 0.095, "footLength")))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 7").select(
        F.col("l_orderkey").alias("id"), F.struct("l_linenumber", _pick(SIZES, F.col("l_linenumber") - 1).alias("label"), fields.alias("fields")).alias("r")
    )
    rows = lines.groupBy("id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    df = table(spark, sf_dir, "orders").join(rows, k == F.col("id"), "left")
    none = F.array().cast("array<struct<l_linenumber:int,label:string,fields:array<string>>>")
    return df.select(
        "o_orderkey", F.coalesce("rows", none).alias("rows"), _pick(("tshirts", "jeans", "shoes", None), k).alias("asked_category"),
        _pick(("tshirts", "jeans", "shoes", "generic-body-guide", "unknown"), F.floor(k / 4)).alias("category"), _pick(("INT", None, None), k).alias("asked_system"),
        _pick(("INT", "US", "UNKNOWN"), F.floor(k / 3)).alias("size_system"), F.lit("men").alias("asked_audience"),
        _pick(("men", "women", "unknown"), F.floor(k / 5)).alias("audience"),
        F.when(k % 11 == 0, "guide-hub-page").otherwise("direct-guide-page").alias("document_kind"), F.when(k % 13 == 0, "unknown").otherwise("cm").alias("unit"),
        (k % 2 == 0).alias("link_followed"), ((k % 10) / 10).alias("navigation"), (k % 17 != 0).alias("tabular"),
        F.slice(F.array(*map(F.lit, SIZES)), 1, (1 + k % 7).cast("int")).alias("size_axis"),
    )


_VALIDATED = """
WITH l AS (SELECT l_orderkey AS id, count(*) AS m, list_sort(list_distinct(list(l_linenumber))) AS nos, bool_or(l_returnflag = 'A') AS chest,
    bool_or(l_returnflag = 'R') AS inseam, bool_or(l_returnflag = 'N') AS waist, bool_or(l_discount > 0.095) AS foot
  FROM lineitem WHERE l_linenumber <= 7 GROUP BY 1),
c AS (SELECT o_orderkey AS k, ['tshirts', 'jeans', 'shoes', NULL][o_orderkey % 4 + 1] AS asked,
    ['tshirts', 'jeans', 'shoes', 'generic-body-guide', 'unknown'][(o_orderkey // 4) % 5 + 1] AS found, o_orderkey % 3 = 0 AS by_system,
    ['INT', 'US', 'UNKNOWN'][(o_orderkey // 3) % 3 + 1] AS own, ['men', 'women', 'unknown'][(o_orderkey // 5) % 3 + 1] AS audience, 1 + o_orderkey % 7 AS n,
    coalesce(m, 0) AS m, coalesce(nos, []) AS nos, coalesce(chest, false) AS chest, coalesce(inseam, false) AS inseam, coalesce(waist, false) AS waist,
    coalesce(foot, false) AS foot FROM orders LEFT JOIN l ON o_orderkey = id),
f AS (SELECT *, CASE WHEN asked IS NULL AND found <> 'unknown' THEN found WHEN asked = found THEN asked
    WHEN asked = 'tshirts' AND found = 'generic-body-guide' AND chest AND NOT inseam AND NOT foot THEN asked END AS final,
    list_filter(nos, lambda x: x <= 5) AS five, len(list_filter(range(1, n + 1), lambda x: NOT list_contains(nos, CAST(x AS INTEGER)))) AS missing FROM c),
i AS (SELECT *, list_filter([
    CASE WHEN final IS NULL AND asked IS NOT NULL THEN 'ambiguous-category' END, CASE WHEN final IS NULL AND asked IS NULL THEN 'missing-category' END,
    CASE WHEN by_system AND own <> 'INT' THEN 'size-system-mismatch' END, CASE WHEN NOT by_system AND own = 'UNKNOWN' THEN 'missing-size-system' END,
    CASE WHEN audience = 'women' THEN 'repair_candidate_wrong_audience' END, CASE WHEN k % 11 = 0 THEN 'guide-hub-selected' END,
    CASE WHEN k % 13 = 0 THEN 'unknown-units' END, CASE WHEN k % 2 = 0 AND k % 10 < 5.5 THEN 'low-navigation-confidence' END,
    CASE WHEN k % 17 = 0 THEN 'advisory-text' END, CASE WHEN m = 0 THEN 'empty-extraction' END,
    CASE WHEN len(five) >= 2 AND five[-1] - five[1] + 1 > len(five) THEN 'missing-size-sequence' END,
    CASE WHEN len(list_filter(nos, lambda x: x > n)) > 0 THEN 'invented-row-labels' END,
    CASE WHEN missing > 0 AND n >= 4 AND m < ceil(n * 0.75) THEN 'size-breadth-loss' END,
    CASE WHEN missing > 0 AND NOT (n >= 4 AND m < ceil(n * 0.75)) THEN 'size-breadth-warning' END,
    CASE WHEN chest AND inseam THEN 'fused-top-bottom-evidence' END,
    CASE WHEN final = 'tshirts' AND (inseam OR foot) THEN 'top-incompatible-fields' END, CASE WHEN final = 'tshirts' AND inseam THEN 'top-has-inseam' END,
    CASE WHEN final = 'tshirts' AND NOT chest THEN 'top-missing-chest' END, CASE WHEN final = 'jeans' AND (chest OR foot) THEN 'bottom-incompatible-fields' END,
    CASE WHEN final = 'jeans' AND chest THEN 'bottom-has-chest' END, CASE WHEN final = 'shoes' AND (chest OR inseam OR waist) THEN 'shoe-incompatible-fields' END,
    CASE WHEN m = 0 THEN 'no-compatible-fields' END, CASE WHEN m = 0 AND k % 17 <> 0 THEN 'deterministic-extraction-only' END], lambda x: x IS NOT NULL) AS codes FROM f),
s AS (SELECT *, CASE WHEN list_contains(codes, 'ambiguous-category') OR list_contains(codes, 'low-navigation-confidence') THEN 'ambiguous'
    WHEN len(list_filter(codes, lambda x: x NOT IN ('size-breadth-warning', 'deterministic-extraction-only'))) > 0 THEN 'rejected'
    WHEN len(codes) > 0 THEN 'warning' ELSE 'accepted' END AS status FROM i)
"""


@query(_VALIDATED + "SELECT k AS o_orderkey, array_to_string(codes, ',') AS codes, status, final AS resolved_category FROM s")
def validation_rules(spark, sf_dir):
    """All rules of the validation over a candidate for each order."""
    df = validate.validate(made_candidates(spark, sf_dir))
    return df.select("o_orderkey", F.array_join(validate.codes(F.col("issues")), ",").alias("codes"), "status", "resolved_category")


@query(_VALIDATED + """, r AS (SELECT *, CASE WHEN by_system THEN CASE WHEN own = 'INT' THEN own END WHEN own <> 'UNKNOWN' THEN own END AS system FROM s)
SELECT k AS o_orderkey, system AS resolved_system, status = 'accepted' AND final IS NOT NULL AND system IS NOT NULL AS ready,
  NOT list_has_any(codes, ['fused-top-bottom-evidence', 'top-incompatible-fields', 'top-has-inseam', 'bottom-incompatible-fields', 'bottom-has-chest',
    'shoe-incompatible-fields', 'wrong-source-family', 'repair_candidate_wrong_audience']) AS elsewhere FROM r""")
def validation_ready(spark, sf_dir):
    """Whether a candidate may be exported, and whether another extraction may be tried."""
    df = validate.validate(made_candidates(spark, sf_dir))
    ready = validate.is_ready(F.col("status"), F.col("resolved_category"), F.col("resolved_system"))
    return df.select("o_orderkey", "resolved_system", ready.alias("ready"), validate.may_extract_elsewhere(F.col("issues")).alias("elsewhere"))


_SCORED = """
WITH c AS (SELECT p_partkey AS k, p_brand, p_size % 2 = 0 AS tee, p_size % 3 = 0 AS int_, 1 + p_partkey % 6 AS n, p_partkey % 5 = 0 AS inseam,
    ['tshirts', 'tops', 'shoes', 'generic-body-guide', 'unknown'][(p_partkey // 5) % 5 + 1] AS found, ['INT', 'US', 'UNKNOWN', 'FOOTWEAR'][(p_partkey // 2) % 4 + 1] AS own,
    p_partkey % 3 <> 2 AS oriented, ['cm', 'in', 'mixed', 'unknown'][(p_partkey // 3) % 4 + 1] AS unit, p_partkey % 7 <> 0 AS tabular,
    (p_partkey % 10) / CAST(10 AS DOUBLE) AS confidence, (p_partkey % 4) / CAST(10 AS DOUBLE) AS navigation, p_partkey % 11 = 0 AS hub FROM part),
s AS (SELECT *, found = 'generic-body-guide' AND NOT inseam AS body FROM c),
t AS (SELECT *, CAST(hub AS INTEGER) + CAST(NOT tabular AS INTEGER) + CAST(n < 2 AS INTEGER) + CAST(NOT oriented AS INTEGER)
    + CAST(int_ AND own IN ('UNKNOWN', 'FOOTWEAR') AS INTEGER) + CAST(tee AND NOT body AND found NOT IN ('tshirts', 'tops') AS INTEGER)
    + CAST(tee AND inseam AS INTEGER) AS strict,
  CASE WHEN NOT tee THEN CASE WHEN found IN ('tshirts', 'shoes', 'generic-body-guide') THEN 3.0 ELSE -1.0 END
    WHEN found = 'tshirts' THEN 6.0 WHEN found = 'tops' THEN 4.5 WHEN body THEN 4.0 WHEN found = 'generic-body-guide' THEN -3.0 ELSE -4.0 END
  + CASE WHEN NOT int_ THEN CASE WHEN own = 'UNKNOWN' THEN 0.0 ELSE 2.0 END WHEN own = 'INT' THEN 4.0 WHEN own = 'US' THEN 2.5 WHEN own = 'UNKNOWN' THEN -0.5 ELSE -3.0 END
  + CASE WHEN oriented THEN 1.5 ELSE -1.0 END + CASE unit WHEN 'cm' THEN 1.2 WHEN 'in' THEN 0.4 WHEN 'mixed' THEN -0.4 ELSE 0.0 END
  + CASE WHEN tabular THEN 2.0 ELSE -2.0 END + n * 0.15 + confidence * 2 + least(0.5, navigation) AS total FROM s),
r AS (SELECT *, CAST(CASE WHEN strict > 0 THEN -20 - strict ELSE floor(total * 100 + 0.5) / 100 END AS DOUBLE) AS score FROM t),
q AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, k) AS rank FROM r)
"""


@query(_SCORED + """SELECT k AS p_partkey, p_brand, score, CAST(strict AS INTEGER) AS strict, CAST(rank AS INTEGER) AS rank,
  rank = 1 AND score >= 4 AND tabular AS selected FROM q""")
def candidate_scores(spark, sf_dir):
    """Scores, ranks and the choice among a candidate for each part, a brand being a request."""
    k = F.col("p_partkey")
    axis = F.slice(F.array(*map(F.lit, SIZES)), 1, (1 + k % 6).cast("int"))
    heads = F.array(F.lit("Size"), F.lit("Chest (cm)"), F.when(k % 5 == 0, "Inseam (cm)").otherwise("Waist (cm)"))
    none = F.array().cast("array<string>")
    df = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", heads.alias("headers"), axis.alias("stub"), axis.alias("size_axis"),
        F.concat(F.array(heads), F.transform(axis, lambda s: F.array(s, F.lit("88"), F.lit("70")))).alias("matrix"), none.alias("heading_path"),
        F.lit("Chart").alias("title"), F.lit("").alias("subheading"), F.lit("").alias("nearby"), F.when(F.col("p_size") % 2 == 0, "tshirts").alias("asked_category"),
        F.when(F.col("p_size") % 3 == 0, "INT").alias("asked_system"), _pick(("tshirts", "tops", "shoes", "generic-body-guide", "unknown"), F.floor(k / 5)).alias("category"),
        F.lit("tops").alias("family"), _pick(("INT", "US", "UNKNOWN", "FOOTWEAR"), F.floor(k / 2)).alias("size_system"),
        _pick(("size-rows", "size-columns", "unknown"), k).alias("orientation"), _pick(("cm", "in", "mixed", "unknown"), F.floor(k / 3)).alias("unit"),
        (k % 7 != 0).alias("tabular"), ((k % 10) / 10).alias("confidence"), ((k % 4) / 10).alias("navigation"),
        F.when(k % 11 == 0, "guide-hub-page").otherwise("direct-guide-page").alias("document_kind"),
    )
    best = select.pick(select.score(df), ["p_brand"], "p_partkey")
    return best.select("p_partkey", "p_brand", "score", F.size("strict").alias("strict"), "rank", "selected")


# ---- parsers over whole tables


@query(r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS label,
  generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) AS pos FROM pages),
k AS (SELECT *, replace(label, '&amp;', '&') AS shown FROM l WHERE label <> '')
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS ord, href, shown AS label FROM k""")
def html_links(spark, sf_dir):
    """Every link of every page as the parser finds it."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), F.lit("static").alias("renderer"), "html")
    found = html.parse(pages).select(F.col("url").cast("long").alias("page_id"), F.explode("links").alias("l"))
    return found.select("page_id", "l.ord", "l.href", "l.label")


@query("""
WITH r AS (SELECT l_orderkey AS id, l_linenumber, CAST(CAST(trunc(l_quantity) AS INTEGER) + 60 AS VARCHAR) AS a, CAST(CAST(trunc(l_tax * 100) AS INTEGER) + 50 AS VARCHAR) AS b,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_tax) AS i FROM lineitem)
SELECT id, CAST(i AS INTEGER) AS row_ord, CAST(l_linenumber + 30 AS VARCHAR) AS label, CAST(a AS DOUBLE) AS chest_low, CAST(b AS DOUBLE) AS waist_high FROM r""")
def html_table_sizes(spark, sf_dir):
    """Sizes read back from html tables made of each order's lines: the html pass, axes, long and wide form."""
    cell = "concat('<tr><td>', l_linenumber + 30, '</td><td>', int(l_quantity) + 60, '</td><td>', int(l_tax * 100) + 50, '</td></tr>')"
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_tax", F.expr(cell).alias("row")))).alias("rows")
    )
    head = "<html><body><h2>Chart</h2><table><tr><th>Size</th><th>Chest (cm)</th><th>Waist (cm)</th></tr>"
    source = F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["row"]), ""), F.lit("</table></body></html>"))
    docs = lines.select(F.col("l_orderkey").cast("string").alias("url"), F.lit("static").alias("renderer"), source.alias("html"))
    found = html.parse(docs, spread=False).select("url", F.explode("tables").alias("t")).where("t.kind = 'html-table'").select("url", "t.matrix")
    tables = found.withColumns({"matrix": matrix.normal(F.col("matrix")), "unit": F.lit("cm"), "orientation": F.lit("size-rows")})
    rows = matrix.measured(tables, ["url"])
    return rows.select(F.col("url").cast("long").alias("id"), "row_ord", "label", "chest_low", "waist_high")


@query(r"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS new_ord, link_url FROM (
  SELECT page_id, link_url, min(pos) AS pos FROM (
    SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || '/size-guide' || href AS link_url, pos FROM (
      SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="(/[^"]*)">', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="(/[^"]*)">', 1), 1) AS pos FROM pages))
  GROUP BY ALL)""")
def link_scores(spark, sf_dir):
    """Every page's links under its size guide, scored for a request and once each, in the order of the page."""
    hrefs = F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)">'), F.lit(1))
    found = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(hrefs).alias("ord", "at")).withColumns(
        {
            "href": F.concat(F.lit("/size-guide"), "at"), "label": F.lit("Size guide"), "heading_path": F.array().cast("array<string>"), "nearby": F.lit(""),
            "resolver": F.lit("generic"), "asked_category": F.lit("tshirts"), "asked_system": F.lit("INT"),
        }
    )
    return links.best_per_url(links.score(found), ["page_id"]).select("page_id", "new_ord", "link_url")


@query("""
WITH o AS (SELECT o_orderkey AS id, unnest(range(0, 12)) AS line FROM orders),
h AS (SELECT *, CASE WHEN (id + line) % 4 = 0 THEN 'H' || line END AS h FROM o),
p AS (SELECT id, line, list(h) FILTER (WHERE h IS NOT NULL) OVER (PARTITION BY id ORDER BY line) AS l FROM h)
SELECT id, CAST(line AS INTEGER) AS line, array_to_string(coalesce(l, [])[-3:], ' > ') AS path FROM p""")
def markdown_heading_paths(spark, sf_dir):
    """Heading paths of every line of a markdown text of each order."""
    line = lambda i: F.when((F.col("o_orderkey") + i) % 4 == 0, F.lit(f"## H{i}")).otherwise(F.lit(f"text {i}"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws("\n", *[line(i) for i in range(12)]).alias("markdown"))
    return markdown.lines(docs, ["id"]).select("id", "line", F.array_join("path", " > ").alias("path"))


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'table' WHEN 1 THEN 'aria-grid' WHEN 4 THEN 'table' WHEN 5 THEN 'none' ELSE 'markdown-table' END AS strategy,
  CASE WHEN p_size % 3 = 0 THEN 'Chart | Headers: Size, Chest | Sizes: S, M' ELSE 'Headers: Size, Chest | Sizes: S, M | by ' || p_brand END AS evidence FROM part""")
def candidate_evidence(spark, sf_dir):
    """How each kind is read, and the snippet that shows what a candidate was recognised by."""
    chart = F.col("p_size") % 3 == 0
    df = table(spark, sf_dir, "part").select(
        "p_partkey", _pick(("html-table", "aria-grid", "markdown-table", "markdown-grid", "div-grid", "advisory-text"), F.col("p_partkey")).alias("kind"),
        F.when(chart, "Chart").otherwise("").alias("title"), F.lit("").alias("subheading"), F.when(chart, "").otherwise(F.concat(F.lit("by "), "p_brand")).alias("nearby"),
        F.array(F.lit("Size"), F.lit("Chest")).alias("headers"), F.array().cast("array<string>").alias("stub"), F.array(F.lit("S"), F.lit("M")).alias("size_axis"),
    )
    return candidates.evidence(df).select("p_partkey", export.strategy(F.col("kind")).alias("strategy"), "evidence")


@query(r"""SELECT page_id, CASE WHEN regexp_matches(host, '^10\.') THEN 'url-forbidden-host' WHEN length(u) > 2048 THEN 'url-too-long' END AS reason FROM (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '10.0.0.' || page_id % 250 ELSE regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) END AS host,
    CASE WHEN page_id % 3 = 1 THEN url || repeat('x', 3000) ELSE url END AS u FROM pages)""")
def page_guards(spark, sf_dir):
    """The guard over the pages' urls, a third of them moved to a private host and a third made too long."""
    from tablewright.sources import requests

    k, u = F.col("page_id"), F.col("url")
    moved = F.when(k % 3 == 0, F.concat(F.lit("http://10.0.0."), k % 250, urls.path(u))).when(k % 3 == 1, F.concat(u, F.repeat(F.lit("x"), 3000))).otherwise(u)
    return table(spark, sf_dir, "pages").select("page_id", requests.guard(F.lit("brand"), moved).alias("reason"))
