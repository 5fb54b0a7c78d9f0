"""Named queries of the engine over the test tables, with equivalent SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions import categories, navigation, sizes, text, units, urls
from tablewright.operators import candidates, export, markdown, matrix, phrases, select, validate
from tablewright.sources import requests

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: str, names: str) -> DataFrame:
    """An inline table; both engines read the same VALUES list."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")


def numbered(rows: str) -> tuple[str, int]:
    """The rows of a VALUES list with their number before them, and how many there are."""
    found = re.split(r"\),\s*\(", rows.strip()[1:-1])
    return ", ".join(f"({i}, {x})" for i, x in enumerate(found)), len(found)


def picked(spark: SparkSession, sf_dir: str, rows: str, names: str) -> DataFrame:
    """Every part with the row of a VALUES list that its key picks, so that the list meets a whole table."""
    listed, n = numbered(rows)
    case = values(spark, listed, f"i, {names}")
    keys = table(spark, sf_dir, "part").select("p_partkey")
    return keys.join(case, F.col("p_partkey") % n == F.col("i")).drop("i")


def picked_sql(rows: str, names: str) -> str:
    """The same in SQL, as a table t."""
    listed, n = numbered(rows)
    return f"t AS (SELECT p_partkey, v.* EXCLUDE (i) FROM part JOIN (VALUES {listed}) AS v(i, {names}) ON p_partkey % {n} = v.i)"


# ---- links and pages


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    found = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(hrefs).alias("ord", "href"))
    return found.withColumn("link_url", urls.resolved(F.col("url"), F.col("href")))


@query(r"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href,
                  generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS ord FROM pages)
SELECT page_id, CAST(ord AS INTEGER) AS ord, href,
       CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || href END AS link_url FROM l""")
def link_scan(spark, sf_dir):
    return page_links(spark, sf_dir).select("page_id", "ord", "href", "link_url")


@query(r"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href,
                  generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS ord FROM pages),
s AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || href AS link_url, ord, CAST(length(href) AS DOUBLE) AS link_score FROM l),
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, link_url ORDER BY link_score DESC, ord) AS rn,
             min(ord) OVER (PARTITION BY page_id, link_url) AS first FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS new_ord FROM d WHERE rn = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY link_score DESC, new_ord) AS rank FROM n)
SELECT page_id, link_url, link_score, CAST(new_ord AS INTEGER) AS new_ord, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 3""")
def link_dedupe_top(spark, sf_dir):
    """Links of a page once each, numbered by first place, and the three best of them."""
    found = page_links(spark, sf_dir).withColumn("link_score", F.length("href").cast("double"))
    once = candidates.dedupe(found, ["page_id"], ["link_url"], "link_score")
    best = Window.partitionBy("page_id").orderBy(F.desc("link_score"), "new_ord")
    return once.withColumn("rank", F.row_number().over(best)).where("rank <= 3").select(
        "page_id", "link_url", "link_score", "new_ord", "rank"
    )


@query(r"""
SELECT regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '([^.]+\.[^.]+)$', 1) AS brand,
       count(*) AS n, count(*) FILTER (WHERE url LIKE 'https:%') AS secure FROM pages GROUP BY 1""")
def brand_domain_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(urls.brand(F.col("url")).alias("brand")).agg(
        F.count("*").alias("n"), F.count_if(urls.scheme(F.col("url")) == "https").alias("secure")
    )


@query(r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS origin,
       regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
       regexp_replace(url, '#.*$', '') AS document,
       regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '\.(?:gif|png|jpe?g|svg|webp|zip|7z)$') AS asset FROM pages""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.origin(u).alias("origin"), urls.path(u).alias("path"), urls.document(u).alias("document"), urls.is_asset(u).alias("asset")
    )


_GUARD = """('http://example.com/a'), ('https://localhost/x'), ('http://10.1.2.3/'), ('http://172.20.0.1/'), ('http://172.32.0.1/'),
('ftp://example.com'), ('http://a.internal/'), ('http://192.168.1.1:80/x'), ('https://169.254.1.1'), ('nonsense'), ('http://127.0.0.1')"""


@query(f"""
WITH {picked_sql(_GUARD, "url")}, h AS (SELECT p_partkey, url, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM t)
SELECT p_partkey, url, CASE WHEN host = '' THEN 'url-invalid' WHEN NOT regexp_matches(url, '^https?:') THEN 'url-scheme'
  WHEN host = 'localhost' OR host LIKE '%.internal' OR regexp_matches(host, '^(127|10|192\\.168|169\\.254|172\\.(1[6-9]|2[0-9]|3[01]))\\.')
  THEN 'url-forbidden-host' END AS reason FROM h""")
def url_guard(spark, sf_dir):
    return picked(spark, sf_dir, _GUARD, "url").select("p_partkey", "url", requests.guard(F.lit("brand"), F.col("url")).alias("reason"))


@query(r"""
WITH p AS (SELECT page_id, lower(html) AS h FROM pages),
s AS (SELECT page_id, len(regexp_extract_all(h, 'href="')) AS links,
             len(regexp_extract_all(h, '<table')) AS blocks,
             ' ' || trim(regexp_replace(strip_accents(h), '[^a-z0-9]+', ' ', 'g')) || ' ' AS n FROM p),
c AS (SELECT page_id, links, blocks,
  CAST(regexp_matches(n, ' (?:pant|pants|trouser|trousers|pantalon|pantalons|bottom|bottoms|bas|jean|jeans|short|shorts|inseam|entrejambe) ') AS INTEGER)
  + CAST(regexp_matches(n, ' (?:top|tops|haut|hauts|shirt|shirts|chemise|chemises|tee|tees|t shirt|t shirts|tshirt|tshirts) ') AS INTEGER)
  + CAST(regexp_matches(n, ' (?:shoe|shoes|footwear|chaussure|chaussures|foot length|foot width) ') AS INTEGER)
  + CAST(regexp_matches(n, ' (?:bra|cup size) ') AS INTEGER)
  + CAST(regexp_matches(n, ' (?:kid|kids|child|children|junior|baby|infant|toddler|bebe|enfant|enfants|boy|boys|girl|girls) ') AS INTEGER) AS kinds
  FROM s)
SELECT page_id, CASE WHEN blocks = 0 AND links >= 2 THEN 'guide-hub-page' WHEN blocks > 1 OR kinds >= 2 THEN 'multi-guide-page'
  WHEN blocks = 1 THEN 'direct-guide-page' ELSE 'irrelevant' END AS kind, CAST(links AS INTEGER) AS links, CAST(kinds AS INTEGER) AS kinds FROM c""")
def document_classify(spark, sf_dir):
    html = F.col("html")
    links = F.regexp_count(F.lower(html), F.lit('href="'))
    df = table(spark, sf_dir, "pages").select(
        "page_id", links.alias("links"), F.regexp_count(html, F.lit("(?i)<table")).alias("blocks"),
        navigation.table_signals(html, F.lit("")).alias("signals"), navigation.category_signals(html).alias("kinds"),
    )
    kind = navigation.document_kind(F.col("links"), F.lit(0.0), F.col("blocks"), F.col("signals"), F.col("kinds"), F.lit(False))
    return df.select("page_id", kind.alias("kind"), "links", "kinds")


def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's kind with its best link."""
    best = link_dedupe_top(spark, sf_dir).where("rank = 1").select(F.col("page_id").alias("of"), "link_url", "link_score")
    kinds = document_classify(spark, sf_dir)
    return kinds.join(best, kinds.page_id == best.of, "left").drop("of")


# ---- text


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))) AS token_md5,
  regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '^-', ''), '-$', '') AS slug
FROM documents""")
def token_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(text.token(F.col("text"))).alias("token_md5"), text.slug(F.col("text")).alias("slug")
    )


@query(r"""
WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS n FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(n, ' (?:kid|kids|child|children|junior|boys|girls) ') THEN 'kids' WHEN n LIKE '% unisex %' THEN 'unisex'
  WHEN regexp_matches(n, ' (?:women|woman|female|femme|femmes|lady|ladies) ') THEN 'women'
  WHEN regexp_matches(n, ' (?:men|man|male|homme|hommes) ') THEN 'men' ELSE 'unknown' END AS audience,
  CASE WHEN regexp_matches(n, ' (?:tall|long) ') THEN 'tall' WHEN n LIKE '% petite %' THEN 'petite' WHEN n LIKE '% regular %' THEN 'regular'
  WHEN trim(n) <> '' THEN 'standard' ELSE 'unknown' END AS variant,
  regexp_matches(n, ' (?:the|les|der|los) ') AS has_article FROM d""")
def contains_any_flags(spark, sf_dir):
    """The audience and fit that a text names, and whether it has an article, from one pass over the phrase index."""
    docs = table(spark, sf_dir, "documents")
    index = phrases.lists(
        spark, kids=categories.KID_WORDS, unisex=["unisex"], women=[*categories.WOMEN_WORDS, "lady", "ladies"], men=categories.MEN_WORDS,
        tall=["tall", "long"], petite=["petite"], regular=["regular"], article=["the", "les", "der", "los"],
    )
    found = phrases.found_lists(docs, index, "doc_id", "text").select(F.col("id"), "lists")
    named = lambda *names: reduce(lambda c, n: c.when(F.array_contains("lists", n), n), names, F.when(F.lit(False), ""))
    rest = F.when(F.col("text").rlike("[A-Za-z0-9]") | (text.token(F.col("text")) != ""), "standard").otherwise("unknown")
    return docs.join(found, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", F.coalesce(named("kids", "unisex", "women", "men"), F.lit("unknown")).alias("audience"),
        F.coalesce(named("tall", "petite", "regular"), rest).alias("variant"),
        F.coalesce(F.array_contains("lists", "article"), F.lit(False)).alias("has_article"),
    )


@query(r"""
WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
p AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
l AS (SELECT 'of' AS list, 'of the' AS phrase UNION ALL SELECT 'of', 'of' UNION ALL SELECT 'und', 'und die' UNION ALL SELECT 'und', 'de la' UNION ALL SELECT 'and', 'and the')
SELECT doc_id, list, phrase, count(*) AS times FROM p JOIN l ON phrase = a OR phrase = a || ' ' || b GROUP BY ALL""")
def phrase_matches(spark, sf_dir):
    """How often each text holds the phrases of some lists, one of them within another."""
    index = phrases.lists(spark, of=["of the", "Of", "of"], und=["und die", "dé la"], **{"and": ["and   the!"]}, none=["?"])
    return phrases.matches(table(spark, sf_dir, "documents"), index, "doc_id", "text").withColumnRenamed("id", "doc_id")


@query(r"""
WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS h FROM conversations),
p AS (SELECT conv_id, turn, list(h) FILTER (WHERE h IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY turn) AS l FROM t)
SELECT conv_id, turn, array_to_string(coalesce(l, [])[-3:], ' > ') AS path FROM p""")
def heading_path_running(spark, sf_dir):
    """The last three user turns up to each turn."""
    heads = F.when(F.col("role") == "user", F.col("text"))
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", heads.alias("h"))
    return markdown.heading_paths(df, ["conv_id"], "turn", "h").select("conv_id", "turn", F.array_join("path", " > ").alias("path"))


# ---- measures and sizes


@query("""
SELECT p_partkey, CAST(p_size AS DOUBLE) AS low, CAST(p_size + 7 AS DOUBLE) AS high,
  floor(p_size * CAST(2.54 AS DOUBLE) * 10 + 0.5) / 10 AS low_cm, floor((p_size + 7) * CAST(2.54 AS DOUBLE) * 10 + 0.5) / 10 AS high_cm FROM part""")
def range_parse_part(spark, sf_dir):
    raw = F.concat(F.col("p_size") + 7, F.lit('" – '), F.col("p_size"), F.lit(' in'))
    df = table(spark, sf_dir, "part").select("p_partkey", units.value_range(raw).alias("r"), units.range_cm(raw, units.cell_unit(F.lit(""), raw, F.lit("cm"))).alias("cm"))
    return df.select("p_partkey", "r.low", "r.high", F.col("cm.low").alias("low_cm"), F.col("cm.high").alias("high_cm"))


_RANGES = """('32 1/2–34"', 32.5, 34.0), ('43–46 1/2"', 43.0, 46.5), ('88-96', 88.0, 96.0), ('96 to 88', 88.0, 96.0), ('1,5', 1.5, 1.5),
('3/4', 0.75, 0.75), ('90 - 95 - 99', 90.0, 95.0), ('88 cm', 88.0, 88.0)"""


@query(f"""
WITH {picked_sql(_RANGES, "raw, low, high")} SELECT p_partkey, raw, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high,
CASE WHEN raw LIKE '%"%' THEN 'in' WHEN regexp_matches(raw, '\\bcm') THEN 'cm' ELSE 'unknown' END AS unit FROM t""")
def range_parse(spark, sf_dir):
    df = picked(spark, sf_dir, _RANGES, "raw, a, b").select("p_partkey", "raw", units.value_range(F.col("raw")).alias("r"), units.unit_of(F.col("raw")).alias("unit"))
    return df.select("p_partkey", "raw", "r.low", "r.high", "unit")


@query("""
WITH v AS (SELECT p_brand, list_sort(list(CAST(p_size AS DOUBLE) * 2) FILTER (WHERE p_size * 2 BETWEEN 10 AND 260)) AS l FROM part GROUP BY 1)
SELECT p_brand, CASE WHEN len(l) < 2 THEN 'unknown' WHEN l[-1] <= 80 AND l[len(l) // 2 + 1] < 60 THEN 'in'
  WHEN l[-1] >= 80 OR l[len(l) // 2 + 1] >= 65 THEN 'cm' ELSE 'unknown' END AS unit, l[len(l) // 2 + 1] AS median FROM v""")
def implicit_unit(spark, sf_dir):
    """The unit that a brand's measures are in by their size, from counts by value."""
    parts = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size").cast("double") * 2).alias("v"))
    own = Window.partitionBy("brand")
    counts = parts.where(units.in_range(F.col("v"))).groupBy(F.col("p_brand").alias("brand"), "v").agg(F.count("*").alias("c"))
    counts = counts.select("brand", "v", "c", F.sum("c").over(own.orderBy("v")).alias("upto"), F.sum("c").over(own).alias("n"), F.max("v").over(own).alias("top"))
    mid = counts.where("upto > n div 2 AND upto - c <= n div 2")
    return parts.select("p_brand").distinct().join(mid, F.col("p_brand") == F.col("brand"), "left").select(
        "p_brand", F.coalesce(units.unit_by_size(F.col("n"), F.col("top"), F.col("v")), F.lit("unknown")).alias("unit"), F.col("v").alias("median")
    )


@query("SELECT user_id, list_sort(list(value))[count(value) // 2 + 1] AS median, count(*) AS n FROM events GROUP BY 1")
def upper_median_by_user(spark, sf_dir):
    """The element at half of the sorted values, by counts.

    Values are counted by user and whole part, then only those of the part that holds the
    middle by value, so a user with most of the events is no one task's work.
    """
    events = table(spark, sf_dir, "events").select("user_id", "value")
    by_value = events.groupBy("user_id", "value").agg(F.count("*").alias("c"))
    parts = by_value.groupBy(F.col("user_id").alias("u"), F.floor("value").alias("part")).agg(F.sum("c").alias("rows"))
    own = Window.partitionBy("u")
    middle = F.floor(F.sum(F.when(F.col("part").isNotNull(), F.col("rows"))).over(own) / 2) + 1
    upto = F.sum("rows").over(own.orderBy(F.col("part").asc_nulls_last()))
    parts = parts.select("u", "part", "rows", upto.alias("upto"), middle.alias("middle"), F.sum("rows").over(own).alias("n"))
    held = parts.where("part IS NOT NULL AND upto >= middle AND upto - rows < middle")
    near = by_value.join(held, (F.col("user_id") == F.col("u")) & (F.floor("value") == F.col("part")))
    within = F.sum("c").over(Window.partitionBy("user_id").orderBy("value"))
    near = near.withColumn("reached", F.col("upto") - F.col("rows") + within)
    return near.where("reached >= middle AND reached - c < middle").select("user_id", F.col("value").alias("median"), "n")


_LABELS = "('SM'), ('2XL Tall'), ('32/34'), ('W32 L34'), ('96'), ('32 in'), ('cm'), ('S Short'), ('XXXL'), ('US 8'), ('Size'), ('2X'), ('xl petite'), ('')"


@query(rf"""
WITH {picked_sql(_LABELS, "label")}, n AS (SELECT p_partkey, label, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS n FROM t),
u AS (SELECT p_partkey, label, n, upper(trim(regexp_replace(regexp_replace(n, '\b(tall|petite|regular|long|short)\b', '', 'g'), ' +', ' ', 'g'))) AS s FROM n)
SELECT p_partkey, label, n <> '' AND (regexp_matches(n, '^(xxs|xs|s|sm|m|md|l|lg|xl|xxl|2xl|xxxl|3xl|4xl|5xl)( tall| petite| regular| short| long)?$')
  OR regexp_matches(n, '^[0-9]{{2,3}}( tall| petite| regular| short| long)?$') OR regexp_matches(n, '^w[0-9]+\s*l[0-9]+$')
  OR (regexp_matches(n, '^[0-9]+\s*[a-z]{{0,2}}$') AND n NOT LIKE '%cm%')) AS is_size,
  CASE s WHEN 'SM' THEN 'S' WHEN 'MD' THEN 'M' WHEN 'LG' THEN 'L' WHEN '2XL' THEN 'XXL' WHEN 'XXXL' THEN '3XL' WHEN '' THEN upper(label) ELSE s END AS canonical
FROM u""")
def size_label_canon(spark, sf_dir):
    label = F.col("label")
    return picked(spark, sf_dir, _LABELS, "label").select("p_partkey", "label", sizes.is_size(label).alias("is_size"), sizes.canonical(label).alias("canonical"))


# ---- matrices


def sales_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A size table of each order's lines: a row a line, quantity and discount as fields."""
    lines = table(spark, sf_dir, "lineitem")
    row = F.array(
        (F.col("l_linenumber") + 30).cast("string"), F.col("l_quantity").cast("int").cast("string"), (F.col("l_discount") * 100).cast("int").cast("string")
    )
    body = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    head = F.array(F.array(F.lit("Size"), F.lit("Chest (cm)"), F.lit("Waist (cm)")))
    return body.select("id", F.concat(head, "rows").alias("matrix"))


@query("""
WITH o AS (SELECT l_orderkey AS id, l_linenumber + 30 AS s FROM lineitem)
SELECT id, CASE WHEN count(*) >= 2 THEN 'size-rows' ELSE 'unknown' END AS orientation, count(*) AS n FROM o GROUP BY 1""")
def orientation_infer(spark, sf_dir):
    df = matrix.with_axes(sales_matrix(spark, sf_dir))
    return df.select("id", "orientation", F.size("stub").cast("long").alias("n"))


@query("""
WITH r AS (SELECT l_orderkey AS id, CAST(l_linenumber + 30 AS VARCHAR) AS a, CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) AS b,
                  CAST(CAST(trunc(l_discount * 100) AS INTEGER) AS VARCHAR) AS c FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY a, b, c) AS row_ord FROM r)
SELECT id, CAST(row_ord AS INTEGER) AS row_ord, a AS label, 'chest' AS field, CAST(b AS DOUBLE) AS low_cm, CAST(b AS DOUBLE) AS high_cm FROM n
UNION ALL SELECT id, CAST(row_ord AS INTEGER), a, 'waist', CAST(c AS DOUBLE), CAST(c AS DOUBLE) FROM n""")
def matrix_unpivot(spark, sf_dir):
    """Every order's table in long form."""
    df = sales_matrix(spark, sf_dir).withColumns({"orientation": F.lit("size-rows"), "unit": F.lit("cm")})
    return matrix.measures(df, ["id"]).drop("raw")


@query("""
SELECT l_returnflag AS flag, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS chest_low, count(*) AS n,
       max(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS waist_high FROM lineitem GROUP BY 1""")
def matrix_pivot(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"))
    return df.agg(
        F.count_if(F.col("l_linestatus") == "O").alias("chest_low"), F.count("*").alias("n"),
        F.max(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("waist_high"),
    )


@query("""
SELECT r_regionkey AS region, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS ord,
       n_name AS label, CAST(80 + n_nationkey AS VARCHAR) AS chest, CAST(70 + n_nationkey AS VARCHAR) AS waist
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def markdown_table_parse(spark, sf_dir):
    """Markdown text made of each region's nations, and the table read back from it."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey") + 80, F.lit(" | "), F.col("n_nationkey") + 70, F.lit(" |"))
    rows = n.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda x: x["r"]), "\n")
    md = rows.select("r_regionkey", F.concat(F.lit("# "), "r_name", F.lit("\n| Nation | Chest | Waist |\n|---|---|---|\n"), body, F.lit("\n\nend")).alias("markdown"))
    found = markdown.piped_tables(markdown.lines(md, ["r_regionkey"]), ["r_regionkey"])
    lines = F.slice("matrix", 2, F.size("matrix"))
    return found.select(F.col("r_regionkey").alias("region"), F.posexplode(lines).alias("ord", "c")).select(
        "region", "ord", F.get("c", F.lit(0)).alias("label"), F.get("c", F.lit(1)).alias("chest"), F.get("c", F.lit(2)).alias("waist")
    )


# ---- choice


@query("""
WITH s AS (SELECT p_brand, p_partkey, floor(p_retailprice * 100 + 0.5) / 100 AS score FROM part),
r AS (SELECT *, row_number() OVER w AS rank, score - lead(score) OVER w AS gap FROM s WINDOW w AS (PARTITION BY p_brand ORDER BY score DESC, p_partkey))
SELECT p_brand, p_partkey, score, floor(gap * 100 + 0.5) / 100 AS gap FROM r WHERE rank = 1""")
def candidate_argmax(spark, sf_dir):
    """The best part of each brand with its lead over the next."""
    df = table(spark, sf_dir, "part").withColumn("score", units.round_half_up(F.col("p_retailprice"), 2))
    order = Window.partitionBy("p_brand").orderBy(F.desc("score"), "p_partkey")
    # the two best alone, so that each task keeps two rows of a brand before they are shuffled
    two = df.select("p_brand", "p_partkey", "score", F.row_number().over(order).alias("rank")).where("rank <= 2")
    best = two.groupBy("p_brand").agg(
        F.min_by("p_partkey", "rank").alias("p_partkey"), F.min_by("score", "rank").alias("score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
    )
    return best.select("p_brand", "p_partkey", "score", units.round_half_up(F.col("score") - F.col("second"), 2).alias("gap"))


@query(r"""
WITH d AS (SELECT doc_id, lang, source, n_chars, text AS line FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, line ORDER BY n_chars DESC, doc_id) AS rn,
             min(doc_id) OVER (PARTITION BY lang, source, line) AS first FROM d)
SELECT doc_id, source, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY first) - 1 AS INTEGER) AS new_ord FROM r WHERE rn = 1""")
def dedupe_signature(spark, sf_dir):
    """The longest of equal texts by source and language, and its place in the source."""
    df = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    once = candidates.dedupe(df, ["source"], ["lang", "text"], "n_chars", "doc_id", width=4096)
    return once.select("doc_id", "source", "n_chars", "new_ord")


def _flagged(spark, sf_dir, flag):
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select("l_suppkey", "l_partkey").distinct()


_FLAGGED = "(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = '{}')"


@query(f"SELECT a.* FROM {_FLAGGED.format('A')} a ANTI JOIN {_FLAGGED.format('R')} r USING (l_suppkey, l_partkey)")
def missing_labels(spark, sf_dir):
    """Pairs seen with flag A and never with R."""
    return _flagged(spark, sf_dir, "A").join(_flagged(spark, sf_dir, "R"), ["l_suppkey", "l_partkey"], "left_anti")


@query(f"SELECT r.* FROM {_FLAGGED.format('R')} r ANTI JOIN {_FLAGGED.format('A')} a USING (l_suppkey, l_partkey)")
def extra_labels(spark, sf_dir):
    return _flagged(spark, sf_dir, "R").join(_flagged(spark, sf_dir, "A"), ["l_suppkey", "l_partkey"], "left_anti")


@query("SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT l_orderkey FROM lineitem WHERE l_tax > 0.05) l ON o_orderkey = l_orderkey")
def present_fields(spark, sf_dir):
    """Orders that carry a line with a tax above five hundredths."""
    lines = table(spark, sf_dir, "lineitem").where("l_tax > 0.05")
    orders = table(spark, sf_dir, "orders")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


_SIZE_OF = "CASE l_linenumber WHEN 1 THEN 'XS' WHEN 2 THEN 'S' WHEN 3 THEN 'M' WHEN 4 THEN 'L' WHEN 5 THEN 'XL' ELSE '2XL' END"


@query("""
WITH p AS (SELECT l_orderkey, list_distinct(list(l_linenumber)) AS l FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1),
g AS (SELECT l_orderkey, list_filter(range(1, 6), lambda i: len(l) >= 2 AND i > list_min(l) AND i < list_max(l) AND NOT list_contains(l, i)) AS m FROM p)
SELECT l_orderkey, array_to_string(list_transform(m, lambda i: ['XS', 'S', 'M', 'L', 'XL'][i]), ',') AS gaps FROM g WHERE len(m) > 0""")
def sequence_gap(spark, sf_dir):
    """Sizes that an order's sequence between its ends lacks."""
    labels = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.expr(_SIZE_OF)).alias("labels"))
    return labels.select("l_orderkey", F.array_join(sizes.sequence_gaps(F.col("labels")), ",").alias("gaps")).where("gaps <> ''")


@query("""
WITH e AS (SELECT o_orderkey, 1 + o_orderkey % 7 AS visible FROM orders),
g AS (SELECT o_orderkey, any_value(visible) AS visible, count(l_orderkey) AS got FROM e LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, CASE WHEN got >= visible THEN NULL WHEN visible >= 4 AND got < ceil(visible * 0.75) THEN 'size-breadth-loss'
  ELSE 'size-breadth-warning' END AS code FROM g""")
def breadth_rule(spark, sf_dir):
    got = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("got"))
    df = table(spark, sf_dir, "orders").join(got, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    visible, n = 1 + F.col("o_orderkey") % 7, F.coalesce("got", F.lit(0))
    lost = (visible >= 4) & (n < F.ceil(visible * 0.75))
    code = F.when(n >= visible, None).when(lost, "size-breadth-loss").otherwise("size-breadth-warning")
    return df.select("o_orderkey", code.alias("code"))


def order_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with issues by the same rule machinery as candidates."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.max("l_discount").alias("top"), F.count_if(F.col("l_returnflag") == "R").alias("returned")
    )
    df = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    n, priority = F.coalesce("n", F.lit(0)), F.col("o_orderpriority")
    found = validate.issues(
        validate.issue(n == 0, "empty-extraction"),
        validate.issue(F.col("returned") > 2, "ambiguous-category"),
        validate.issue(F.col("top") > 0.09, "unknown-units", "warning"),
        validate.issue(priority == "1-URGENT", "top-missing-chest", details=F.array(priority)),
    )
    return df.select("o_orderkey", found.alias("issues"))


_ISSUES = """
WITH l AS (SELECT l_orderkey, count(*) AS n, max(l_discount) AS top, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, o_orderpriority, coalesce(n, 0) AS n, top, returned FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
i AS (SELECT o_orderkey, 1 AS k, 'empty-extraction' AS code, 'error' AS severity FROM o WHERE n = 0
  UNION ALL SELECT o_orderkey, 2, 'ambiguous-category', 'error' FROM o WHERE returned > 2
  UNION ALL SELECT o_orderkey, 3, 'unknown-units', 'warning' FROM o WHERE top > 0.09
  UNION ALL SELECT o_orderkey, 4, 'top-missing-chest', 'error' FROM o WHERE o_orderpriority = '1-URGENT')
"""


@query(_ISSUES + "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY k) - 1 AS INTEGER) AS ord, code, severity FROM i")
def validation_issues(spark, sf_dir):
    return validate.exploded(order_issues(spark, sf_dir), ["o_orderkey"]).drop("details")


@query(_ISSUES + """, s AS (SELECT o_orderkey, bool_or(code = 'ambiguous-category') AS a, bool_or(severity = 'error') AS e, count(*) AS found FROM i GROUP BY 1)
SELECT o.o_orderkey, CASE WHEN a THEN 'ambiguous' WHEN e THEN 'rejected' WHEN found > 0 THEN 'warning' ELSE 'accepted' END AS status
FROM o LEFT JOIN s USING (o_orderkey)""")
def validation_status(spark, sf_dir):
    return order_issues(spark, sf_dir).select("o_orderkey", validate.status(F.col("issues")).alias("status"))


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS accepted, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS review,
  count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'signup') AS waiting FROM events GROUP BY 1""")
def status_counts_by_user(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "done").when(kind.isin("view", "click"), "review").when(kind == "error", "error").otherwise("pending")
    s = F.col("run_status")
    return table(spark, sf_dir, "events").withColumn("run_status", status).groupBy("user_id").agg(
        F.count_if(s == "done").alias("accepted"), F.count_if(s == "review").alias("review"),
        F.count_if(s == "error").alias("error"), F.count_if(s == "pending").alias("waiting"),
    )


@query("""
SELECT count(*) FILTER (WHERE event_type = 'purchase') AS accepted, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS review,
  count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'signup') AS waiting FROM events""")
def status_counts(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "done").when(kind.isin("view", "click"), "review").when(kind == "error", "error").otherwise("pending")
    return export.status_counts(table(spark, sf_dir, "events").withColumn("run_status", status))


_EXPORT = "('Ann & Co', 'tshirts', 'INT', 80.0, 84.5, 24.25), ('Élan', 'shoes', 'FOOTWEAR', NULL, 90.0, 25.0), ('b', 'bras', 'BRA', 70.0, NULL, NULL)"


@query(f"""
WITH {picked_sql(_EXPORT, "brand, category, system, low, high, foot")}
SELECT p_partkey, brand, CASE category WHEN 'tshirts' THEN 'tshirt' WHEN 'shoes' THEN 'socks' ELSE 'tshirt' END AS export_category,
  CASE system WHEN 'BRA' THEN 'INT' ELSE system END AS export_system, CAST(coalesce(high, low) AS DOUBLE) AS scalar,
  floor(CAST(foot AS DOUBLE) * 10 + 0.5) AS foot_mm,
  regexp_replace(regexp_replace(strip_accents(lower(brand)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '_' || category || '_' ||
  replace(lower(system), '_', '-') || '.json' AS file FROM t""")
def export_rows(spark, sf_dir):
    df = picked(spark, sf_dir, _EXPORT, "brand, category, system, low, high, foot")
    c = {n: F.col(n).cast("double") for n in ("low", "high", "foot")}
    return df.select(
        "p_partkey", "brand", export.export_category(F.col("category")).alias("export_category"), export.export_system(F.col("system")).alias("export_system"),
        export.scalar(c["low"], c["high"]).alias("scalar"), units.mm(c["foot"]).alias("foot_mm"),
        export.file_name(F.col("brand"), F.col("category"), F.col("system")).alias("file"),
    )


@query("""
SELECT o_orderkey, NOT (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS may FROM orders""")
def issue_overlap(spark, sf_dir):
    """Whether another extraction may be tried after an order's issues."""
    p = F.col("o_orderpriority")
    found = validate.issues(
        validate.issue(p == "1-URGENT", "top-has-inseam"), validate.issue(p == "2-HIGH", "bottom-has-chest"), validate.issue(p == "5-LOW", "unknown-units")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", validate.may_extract_elsewhere(found).alias("may"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


_UPLOAD = """('{"sources":[{"brand":" A ","url":"http://a.com","category":"Tops","target":{"sizeSystem":"INT"}},{"brand":"","url":"x"}]}'),
('[{"brand":"B","size_guide_url":"http://b.com","url":"http://no","fallbackUrls":"u1, u2"},{"brand":5,"url":"y"}]'), ('7'), ('{"sources":3}')"""


@query("""
SELECT brand || s_suppkey AS brand, size_guide_url, garment_category, size_system, fallbacks
FROM supplier JOIN (VALUES (0, 'A', 'http://a.com', 'tshirts', 'INT', NULL), (1, 'B', 'http://b.com', NULL, NULL, 'u1|u2'))
  AS t(i, brand, size_guide_url, garment_category, size_system, fallbacks) ON s_suppkey % 4 = i""")
def upload_normalise(spark, sf_dir):
    """The requests of an upload of each supplier, a good or a bad one by its key, which the brands carry."""
    listed, n = numbered(_UPLOAD)
    keys = table(spark, sf_dir, "supplier").select("s_suppkey")
    text = keys.join(values(spark, listed, "i, json"), F.col("s_suppkey") % n == F.col("i"))
    made = F.replace(F.col("json"), F.lit('" A "'), F.concat(F.lit('" A'), "s_suppkey", F.lit(' "')))
    made = F.replace(made, F.lit('"B"'), F.concat(F.lit('"B'), "s_suppkey", F.lit('"')))
    found = requests.normalised(requests.records(text.select(made.alias("json"))))
    return found.select("brand", "size_guide_url", "garment_category", "size_system", F.array_join("fallback_urls", "|").alias("fallbacks"))


_ASKED = "('Tops', 'international', 'Mens'), ('polo', 'socks', 'x'), ('Slim jeans', 'usa', 'kids'), ('Trench coats', 'waist inseam', 'ladies'), (NULL, NULL, NULL)"


_MAPPED = "('Tops', 'tshirts', 'INT', 'men'), ('polo', NULL, NULL, NULL), ('Slim jeans', 'jeans', 'US', 'kids'), ('Trench coats', 'jackets', 'WAIST_INSEAM', 'women'), (NULL, NULL, NULL, NULL)"


@query(f"""WITH {picked_sql(_MAPPED, "raw, category, system, audience")} SELECT * FROM t""")
def request_mapping(spark, sf_dir):
    return picked(spark, sf_dir, _ASKED, "c, s, a").select(
        "p_partkey", F.col("c").alias("raw"), categories.asked_category(F.col("c")).alias("category"), categories.asked_system(F.col("s")).alias("system"),
        categories.asked_audience(F.col("a")).alias("audience"),
    )


_ATTEMPTS = "(1, 'primary', true), (1, 'fallback', true), (2, 'primary', false), (2, 'fallback', true), (3, 'primary', false), (3, 'fallback', false)"


@query(f"""
WITH t AS (SELECT s_suppkey, attempt, has_guide FROM supplier JOIN (VALUES {_ATTEMPTS}) AS v(id, attempt, has_guide) ON s_suppkey % 3 + 1 = id),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY has_guide DESC, attempt = 'fallback') AS rn FROM t)
SELECT s_suppkey, attempt, has_guide FROM r WHERE rn = 1""")
def fallback_resolution(spark, sf_dir):
    order = Window.partitionBy("s_suppkey").orderBy(F.desc("has_guide"), F.col("attempt") == "fallback")
    keys = table(spark, sf_dir, "supplier").select("s_suppkey")
    df = keys.join(values(spark, _ATTEMPTS, "id, attempt, has_guide"), F.col("s_suppkey") % 3 + 1 == F.col("id")).drop("id")
    return df.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


@query("""
WITH l AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation)
SELECT x.a AS start, x.b AS hop1, y.b AS hop2 FROM l x JOIN l y ON y.a = x.b""")
def follow_two_hops(spark, sf_dir):
    """Where two hops along a link table lead."""
    links = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b"))
    second = links.toDF("at", "hop2")
    return links.toDF("start", "hop1").join(second, F.col("hop1") == F.col("at")).drop("at")


_TABLES = """(1, 'markdown-table', array(array('Size', 'Chest (cm)', 'Waist (cm)'), array('S', '80-84', '70'), array('M', '84-88', '74')), 'Tops'),
(2, 'html-table', array(array('', 'XS', 'S', 'M'), array('Chest', '30', '32', '34'), array('Waist', '25', '27', '29')), 'Mens tops'),
(3, 'html-table', array(array('US', 'EU'), array('8', '41'), array('9', '42')), 'Conversion'),
(4, 'advisory-text', array(array('Fit advice'), array('Measure your chest')), 'Fit advice')"""


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate for each part, one of four kinds by its key."""
    t = picked(spark, sf_dir, _TABLES, "id, kind, matrix, title").withColumns(
        {"heading_path": F.array("title"), "subheading": F.lit(""), "nearby": F.lit("")}
    )
    return candidates.describe(t)


_DESCRIBED = """(1, 'size-rows', 'cm', 'tops', 'INT', 2), (2, 'size-columns', 'in', 'tops', 'INT', 3),
(3, 'conversion-grid', 'unknown', 'unknown', 'US', 2), (4, 'unknown', 'unknown', 'generic-body-guide', 'UNKNOWN', 0)"""


@query(f"""WITH {picked_sql(_DESCRIBED, "id, orientation, unit, category, size_system, sizes")} SELECT * FROM t""")
def candidate_describe(spark, sf_dir):
    """What each kind of candidate is recognised as."""
    return described(spark, sf_dir).select("p_partkey", "id", "orientation", "unit", "category", "size_system", F.size("size_axis").alias("sizes"))


_POINTS = """(1, 4.5, 4.0, 1.5, 1.2, 2, ''), (2, 4.5, 4.0, 1.5, 0.4, 3, ''), (3, 0, 0, 0, 0, 2, 'too-few-fields,orientation,category-not-tops,no-chest'),
(4, 0, 0, 0, 0, 0, 'not-tabular,too-few-sizes,too-few-fields,orientation,size-system-not-compatible')"""


@query(f"""
WITH {picked_sql(_POINTS, "id, category, system, orientation, unit, n, strict")},
s AS (SELECT p_partkey, p_partkey // 4 AS page, id, strict, CAST(CASE WHEN strict <> '' THEN -20 - len(string_split(strict, ',')) ELSE floor((category + system + orientation + unit + 2 + n * 0.15
  + 2 * (0.16 + 0.2 + n * 0.05 + 0.18 + 0.12)) * 100 + 0.5) / 100 END AS DOUBLE) AS score FROM t)
SELECT p_partkey, id, score, CAST(row_number() OVER (PARTITION BY page ORDER BY score DESC, id) AS INTEGER) AS rank,
  row_number() OVER (PARTITION BY page ORDER BY score DESC, id) = 1 AND score >= 4 AS selected, strict FROM s""")
def candidate_select(spark, sf_dir):
    """Scores and the selected candidate of pages of four candidates."""
    asked = {"asked_category": F.lit("tshirts"), "asked_system": F.lit("INT"), "document_kind": F.lit("direct-guide-page"), "navigation": F.lit(0.0), "page": F.floor(F.col("p_partkey") / 4)}
    df = described(spark, sf_dir).withColumns(asked).withColumn("confidence", candidates.confidence(F.col("base_confidence"), F.col("navigation")))
    best = select.pick(select.score(df), ["page"], "id")
    return best.select("p_partkey", "id", "score", "rank", "selected", F.array_join("strict", ",").alias("strict"))


from tablewright.plans import batch_queries, fetch_queries, link_queries, page_queries  # noqa: E402, F401 - register their queries beside these
