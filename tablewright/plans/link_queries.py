"""Queries of scored links: every part of a score, the known guides of a host, the log, and sizes as shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.domain import FIELDS
from tablewright.functions import navigation
from tablewright.functions.text import plain_token
from tablewright.operators import export, links
from tablewright.plans.catalogue import query, table
from tablewright.sources.sinks import log_lines

#: (href, label, category that its words name, product's page, utility, concrete guide) of the links of made pages.
_FORMS = (
    ("/size-guide/men-tops", "Men tops size guide", "tops", False, False, True),
    ("/size-guide/women-tops", "Women tops size guide", "tops", False, False, True),
    ("/size-guide/kids-tops", "Kids tops size guide", "tops", False, False, False),
    ("/size-guide/men-shoes", "Men shoes size guide", "shoes", False, False, False),
    ("/size-guide/men-jeans", "Men jeans size guide", "jeans", False, False, False),
    ("http://other.org/size-guide/men-tops", "Men tops size guide", "tops", False, False, True),
    ("/p/123/size", "Tee size", "tshirts", True, False, False),
    ("/help/size", "Help", "unknown", False, True, False),
    ("/size-guide/international", "International size chart", "unknown", False, False, True),
    ("/help#size-guide-men", "Men tops size guide", "tops", False, False, True),
)
_CLOTHES = ("apparel", "clothing", "tops", "tshirts", "shirts", "hauts")


def _has(text: str, *words: str) -> str:
    return f"regexp_matches({text}, ' ({'|'.join(sorted({plain_token(w) for w in words}))}) ')"


def _token(text: str) -> str:
    return f"' ' || trim(regexp_replace(strip_accents(lower({text})), '[^a-z0-9]+', ' ', 'g')) || ' '"


def _points(*rules: tuple[str, float]) -> str:
    return " + ".join(f"CASE WHEN {test} THEN {value} ELSE 0 END" for test, value in rules)


_SITE = "CASE page_id % 4 WHEN 0 THEN 'http://www.puma.com' WHEN 1 THEN 'http://www.newbalance.com' ELSE 'http://shop' || page_id || '.com' END"
_NB = [r for r in links.OFFICIAL if r[0] == "newbalance."][0]
_PUMA = [r for r in links.OFFICIAL if r[0] == "puma."][0]
_VALUES = ", ".join(f"({i}, '{h}', '{t}', '{c}', {p}, {u}, {k})" for i, (h, t, c, p, u, k) in enumerate(_FORMS))
_NEAR = links.NEAR.replace("'", "''")
_ONE_HOP = _points(
    (_has("w", *navigation.TOPS), 3), (_has("w", *navigation.SIZES, "guide des tailles", "tableau des tailles"), 2),
    (_has("w", "chart", "guide", "alpha"), 2), (_has("w", *navigation.FOOTWEAR), -3), (_has("w", *navigation.BOTTOMS), -3),
) + " + CASE who WHEN 'men' THEN 3 WHEN 'women' THEN -8 WHEN 'kids' THEN -13 ELSE 0 END"
_TEES = "coalesce(cat = 'tshirts', false)"
#: Every link of every made page with the parts of its score, from words and flags alone.
_PARTS = f"""
WITH p AS (SELECT page_id, {_SITE} AS site, ['tshirts', NULL, 'jeans'][page_id % 3 + 1] AS cat, CASE WHEN page_id % 5 <> 0 THEN 'INT' END AS sys FROM pages),
f AS (
  SELECT p.*, i AS ord, CASE WHEN starts_with(href, '/') THEN site || href ELSE href END AS link_url, label, found, product, utility, concrete, false AS fb, '' AS around
  FROM p, (VALUES {_VALUES}) AS v(i, href, label, found, product, utility, concrete) WHERE (page_id + i) % 4 <> 0
  UNION ALL SELECT p.*, 100, site || '/mine-size', '{links.GIVEN} 1', 'tops', false, false, false, true, '{links.KNOWN} {_NEAR}' FROM p WHERE page_id % 7 = 0
  UNION ALL SELECT p.*, 101, u, l, 'tops', false, false, false, true, '{links.KNOWN} {_NEAR}'
  FROM p JOIN (VALUES (0, '{_PUMA[2]}', '{_PUMA[3]}'), (1, '{_NB[2]}', '{_NB[3]}'), (1, '{links.SECOND[_NB[0]][0]}', '{links.SECOND[_NB[0]][1]}')) AS k(n, u, l) ON page_id % 4 = n),
w AS (SELECT *, {_token("label || ' ' || around || ' ' || link_url")} AS w, {_token("label || ' ' || link_url")} AS own,
  link_url LIKE 'http://other.org/%' AS off, split_part(link_url, '#', 1) = site || '/help' AS same FROM f),
a AS (SELECT *, CASE WHEN {_has("own", *navigation.KIDS)} THEN 'kids' WHEN {_has("own", *navigation.WOMEN)} THEN 'women' WHEN {_has("own", *navigation.MEN)} THEN 'men' END AS who,
  {_has("w", *navigation.FOOTWEAR)} AS shoes, {_has("w", *navigation.BOTTOMS)} AS bottoms FROM w),
h AS (SELECT *, {_ONE_HOP} AS one_hop,
  CASE WHEN cat IS NULL THEN CASE WHEN found IN ('unknown', 'tops') THEN 0 ELSE 5 END WHEN cat = found THEN 5 WHEN cat = 'tshirts' AND found = 'tops' THEN 4
    WHEN found NOT IN ('unknown', 'tops') THEN -4 ELSE 0 END AS by_category,
  CASE WHEN sys IS NULL THEN 0.0 WHEN {_has("w", "international", "alpha", "xxs", "xs", "xl", "3xl")} THEN 1.5 WHEN shoes THEN -1.5 ELSE 0.0 END AS by_system,
  CASE WHEN NOT fb THEN 0.0 WHEN {_has("w", "newbalance", "new balance")} THEN 6.5 WHEN {_has("w", "puma")} THEN 6.0 ELSE 5.0 END AS by_brand,
  concat_ws(',', CASE WHEN who = 'women' THEN 'women' END, CASE WHEN who = 'kids' THEN 'kids' END, CASE WHEN {_TEES} AND {_has("own", *navigation.FOOTWEAR)} THEN 'footwear' END,
    CASE WHEN {_TEES} AND {_has("own", *navigation.BOTTOMS)} THEN 'bottoms' END, CASE WHEN off THEN 'off-brand' END, CASE WHEN same THEN 'same-page' END,
    CASE WHEN product THEN 'product-page' END, CASE WHEN utility THEN 'utility' END) AS hard,
  concat_ws(',', CASE WHEN who = 'women' THEN 'women' END, CASE WHEN who = 'kids' THEN 'kids' END, CASE WHEN shoes THEN 'footwear' END, CASE WHEN bottoms THEN 'bottoms' END,
    CASE WHEN product THEN 'product-page' END, CASE WHEN utility THEN 'utility' END, CASE WHEN off THEN 'off-brand' END, CASE WHEN same THEN 'same-page' END) AS rejections FROM a),
s AS (SELECT *, CAST(one_hop + 2 + {_points(("product", -20), ("utility", -20), ("off", -5), ("same", -20))} + by_category + by_system + by_brand
    + CASE WHEN shoes THEN CASE WHEN {_TEES} THEN -4 ELSE -1 END ELSE 0 END + CASE WHEN bottoms AND {_TEES} THEN -3 ELSE 0 END AS DOUBLE) AS link_score,
  CAST(CASE WHEN hard <> '' THEN -99 ELSE one_hop + {_points(("concrete OR fb", 3), ("concrete AND NOT fb", 4), ("fb", 2), (f"concrete AND NOT fb AND {_has('own', *_CLOTHES)}", 3))} END AS DOUBLE) AS hub_score,
  row_number() OVER (PARTITION BY page_id ORDER BY ord, link_url) - 1 AS new_ord FROM h),
o AS (SELECT *, CASE WHEN hub_score < 3 THEN NULL WHEN ord = 100 THEN 1 WHEN concrete AND NOT fb THEN 2 WHEN fb THEN 3 END AS pool,
  row_number() OVER (PARTITION BY page_id ORDER BY link_score DESC, new_ord) AS place, link_score - lead(link_score) OVER (PARTITION BY page_id ORDER BY link_score DESC, new_ord) AS gap FROM s),
r AS (SELECT *, pool IS NOT NULL AND row_number() OVER (PARTITION BY page_id ORDER BY pool NULLS LAST, hub_score DESC, link_score DESC, new_ord) = 1 AS followed FROM o)
"""


def made_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored and followed links of a help page made for each page: links of many kinds, supplied and known guides."""
    k = F.col("page_id")
    site = F.when(k % 4 == 0, "http://www.puma.com").when(k % 4 == 1, "http://www.newbalance.com").otherwise(F.concat(F.lit("http://shop"), k, F.lit(".com")))
    asked = F.when(k % 3 == 0, "tshirts").when(k % 3 == 2, "jeans")
    page = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(site, F.lit("/help")).alias("url"), asked.alias("asked_category"), F.when(k % 5 != 0, "INT").alias("asked_system"),
        F.when(k % 7 == 0, F.array(F.lit("/mine-size"))).alias("fallback_urls"),
    )
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f[0]).alias("href"), F.lit(f[1]).alias("label")) for i, f in enumerate(_FORMS)])
    key = ["page_id", "url", "asked_category", "asked_system"]
    own = page.select(*key, F.explode(rows).alias("l")).select(*key, "l.*").where((k + F.col("ord")) % 4 != 0)
    own = own.withColumns({"heading_path": F.array().cast("array<string>"), "nearby": F.lit(""), "resolver": F.lit("generic")})
    known = links.official(page, key).withColumn("ord", F.col("ord") + 100)
    scored = links.best_per_url(links.score(own.unionByName(known)), ["page_id"])
    return links.clear_winner(links.follow(scored, ["page_id"], F.lit(False)), ["page_id"], k % 2 == 0)


@query(_PARTS + """SELECT page_id, CAST(new_ord AS INTEGER) AS new_ord, label, link_url, link_score, rejections, hard, hub_score, CAST(pool AS INTEGER) AS pool, followed,
  place = 1 AND link_score >= CASE WHEN page_id % 2 = 0 THEN 4.5 ELSE 5.5 END AND (gap IS NULL OR gap >= CASE WHEN page_id % 2 = 0 THEN 1 ELSE 1.5 END) AS clear FROM r""")
def link_totals(spark, sf_dir):
    """Scores, rejections, pools and choices of every link of a page, known guides of its host included, and the clear winner."""
    return made_links(spark, sf_dir).select(
        "page_id", "new_ord", "label", "link_url", "link_score", F.array_join("link_rejections", ",").alias("rejections"),
        F.array_join("hard", ",").alias("hard"), F.col("hub_score").cast("double").alias("hub_score"), "pool", "followed", "clear",
    )


@query(_PARTS + f"""SELECT page_id, CAST(place - 1 AS INTEGER) AS ord, 'link ' || CASE WHEN followed THEN 'selected' ELSE 'rejected' END || ': "' || label || '" score=' || hub_score ||
  ' resolver=' || CASE WHEN fb THEN 'brand-fallback' ELSE 'generic' END || ' url=' || link_url || ' reason=' ||
  CASE WHEN hard <> '' THEN split_part(hard, ',', 1) WHEN rejections <> '' THEN split_part(rejections, ',', 1) ELSE 'same-brand' END AS line FROM r WHERE place <= {links.LOGGED}""")
def link_log(spark, sf_dir):
    """The lines of a page's log: its first links by score, whether one is followed, and why."""
    logged = links.logged(made_links(spark, sf_dir), ["page_id"])
    per_page = logged.groupBy("page_id").agg(F.array_sort(F.collect_list("logged")).alias("links"))
    return log_lines(per_page, "page_id")


@query("""
WITH h AS (SELECT p_partkey AS k, ['www.nike.com', 'adidas.de', 'shop.reebok.eu', 'www.underarmour.fr', 'm.zara.com', 'other.org'][p_partkey % 6 + 1] AS host,
  ['tshirts', 'jeans', 'shoes', NULL, 'leggings'][p_size % 5 + 1] AS cat, ['INT', 'FOOTWEAR', 'WAIST_INSEAM', NULL][p_size % 4 + 1] AS sys FROM part),
c AS (SELECT *, coalesce(cat = 'shoes', false) OR coalesce(sys = 'FOOTWEAR', false) AS shoe, coalesce(cat IN ('jeans', 'leggings'), false) AS bottom,
  coalesce(cat = 'tshirts', true) AS top FROM h),
u AS (SELECT k, CASE host
  WHEN 'www.nike.com' THEN CASE WHEN shoe THEN 'https://www.nike.com/size-fit/mens-footwear' WHEN bottom AND sys = 'WAIST_INSEAM' THEN 'https://www.nike.com/size-fit/mens-bottoms-numeric/'
    WHEN bottom THEN 'https://www.nike.com/size-fit/mens_bottoms_alpha' WHEN top THEN 'https://www.nike.com/size-fit/mens-tops-alpha' END
  WHEN 'adidas.de' THEN 'https://www.adidas.com/us/help/size_charts/men-' || CASE WHEN shoe THEN 'shoes' WHEN bottom THEN 'pants_shorts' ELSE 'shirts_tops' END
  WHEN 'shop.reebok.eu' THEN CASE WHEN top THEN 'https://www.reebok.com/us/men-tops-size-chart' ELSE 'https://www.reebok.com/us/size-chart-men' END
  WHEN 'www.underarmour.fr' THEN 'https://www.underarmour.com/en-us/t/size-guide/mens' || CASE WHEN top THEN '-tops/' ELSE '/' END
  WHEN 'm.zara.com' THEN 'https://www.zara.com/fr/fr/help/size-guide-h38.html' END AS href,
  CASE host WHEN 'www.nike.com' THEN 'Nike guide officiel ' || CASE WHEN shoe THEN 'chaussures' WHEN bottom THEN 'bas' ELSE 'hauts' END || ' homme'
  WHEN 'adidas.de' THEN 'adidas guide officiel ' || CASE WHEN shoe THEN 'chaussures' WHEN bottom THEN 'bas' ELSE 'hauts' END || ' homme'
  WHEN 'shop.reebok.eu' THEN 'Reebok guide officiel ' || CASE WHEN top THEN 'hauts' ELSE 'tailles' END || ' homme'
  WHEN 'www.underarmour.fr' THEN 'Under Armour guide officiel ' || CASE WHEN top THEN 'hauts' ELSE 'tailles' END || ' homme'
  WHEN 'm.zara.com' THEN 'Zara guide officiel tailles' END AS label FROM c)
SELECT k AS p_partkey, href, label FROM u WHERE href IS NOT NULL""")
def official_guides(spark, sf_dir):
    """The known guide of each part's host, by the category and the size system that are asked for."""
    k, s = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))
    asked = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("https://"), pick(("www.nike.com", "adidas.de", "shop.reebok.eu", "www.underarmour.fr", "m.zara.com", "other.org"), k), F.lit("/x")).alias("url"),
        pick(("tshirts", "jeans", "shoes", None, "leggings"), s).alias("asked_category"), pick(("INT", "FOOTWEAR", "WAIST_INSEAM", None), s).alias("asked_system"),
        F.lit(None).cast("array<string>").alias("fallback_urls"),
    )
    return links.official(asked, ["p_partkey"]).select("p_partkey", "href", "label")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, CASE WHEN l_linenumber % 3 <> 0 THEN trunc(l_quantity) + 0.5 END AS lo,
  CASE WHEN l_linenumber % 4 <> 0 THEN trunc(l_quantity) + CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE 3 END END AS hi, trunc(l_tax * 100) AS w FROM lineitem),
t AS (SELECT *, CAST(lo AS VARCHAR) AS a, regexp_replace(CAST(CAST(hi AS DOUBLE) AS VARCHAR), '[.]0$', '') AS b FROM l)
SELECT l_orderkey, l_linenumber, l_quantity, concat_ws(', ', CASE WHEN lo IS NOT NULL OR hi IS NOT NULL THEN 'chest ' ||
  CASE WHEN lo IS NULL THEN b WHEN hi IS NULL OR lo = hi THEN CAST(CAST(lo AS DOUBLE) AS VARCHAR) ELSE CAST(CAST(lo AS DOUBLE) AS VARCHAR) || '–' || b END END,
  'waist ' || CAST(CAST(w AS BIGINT) AS VARCHAR)) AS shown FROM t""")
def sizes_shown(spark, sf_dir):
    """Sizes made of every line as a reader is shown them: single values, ranges, and one end alone."""
    n, whole = F.col("l_linenumber"), F.floor("l_quantity").cast("double")
    low, high = F.when(n % 3 != 0, whole + 0.5), F.when(n % 4 != 0, whole + F.when(n % 2 == 0, 0.5).otherwise(3.0))
    waist = F.expr("double(bigint(l_tax * 100))")
    ends = {"chest_low": low, "chest_high": high, "waist_low": waist, "waist_high": waist}
    rest = {f"{f}_{e}": F.lit(None).cast("double") for f in FIELDS for e in ("low", "high") if f"{f}_{e}" not in ends}
    shown = export.shown_rows(table(spark, sf_dir, "lineitem").withColumns({**ends, **rest}))
    text = F.array_join(F.transform("shown", lambda x: F.concat_ws(" ", x["field"], x["text"])), ", ")
    return shown.select("l_orderkey", "l_linenumber", "l_quantity", text.alias("shown"))
