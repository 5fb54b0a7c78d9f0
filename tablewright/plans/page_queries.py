"""Queries of the HTML pass: kinds of tables, and where tables and links stand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import links
from tablewright.plans.catalogue import query, table
from tablewright.sources import html

_GRID = "<div class=g><div><span>Size</span> <span>Chest</span></div> <div><span>S</span> <span>{}</span></div></div>"
_ROLES = (
    '<div role="table"><div role="row"><span role="columnheader">Size</span> <span role="columnheader">Chest</span></div> '
    '<div role="row"><span role="cell">S</span> <span role="cell">{}</span></div></div>'
)


@query("""
WITH p AS (SELECT p_partkey AS k, p_brand AS brand, p_type AS t, p_size AS s, CAST(90 + p_partkey % 9 AS VARCHAR) AS n, p_partkey % 3 AS c FROM part),
f AS (
  SELECT k, 0 AS ord, 'aria-grid' AS kind, 'Size|Chest|S|' || n AS cells, 'Men ' || t AS title, 'Size guide ' || brand || ' > Men ' || t AS path,
    'before ' || k AS subheading, 'before ' || k || ' after ' || s AS nearby FROM p WHERE c = 0
  UNION ALL SELECT k, CASE c WHEN 0 THEN 1 ELSE 0 END, 'div-grid', 'Size|Chest|S|' || n, 'Men ' || t, 'Size guide ' || brand || ' > Men ' || t,
    'before ' || k, 'before ' || k || ' after ' || s FROM p WHERE c < 2
  UNION ALL SELECT k, CASE c WHEN 1 THEN 1 ELSE 0 END, 'advisory-text', 'Size guide ' || brand || '|Men ' || t || 'before ' || k ||
      CASE c WHEN 1 THEN 'Size Chest S ' || n ELSE 'Measure well' END || 'after ' || s, 'Size guide ' || brand, 'Size guide ' || brand, '',
    'Men ' || t || 'before ' || k || CASE c WHEN 1 THEN 'Size Chest S ' || n ELSE 'Measure well' END || 'after ' || s FROM p WHERE c > 0)
SELECT k AS p_partkey, CAST(ord AS INTEGER) AS ord, kind, cells, title, path, subheading, nearby FROM f""")
def html_table_kinds(spark, sf_dir):
    """Grids of roles and of divisions and advice under a heading, with all that is read around them, in a page of each part."""
    k = F.col("p_partkey")
    n = (90 + k % 9).cast("string")
    made = lambda form: F.concat(F.lit(form.split("{}")[0]), n, F.lit(form.split("{}")[1]))
    inner = F.when(k % 3 == 0, made(_ROLES)).when(k % 3 == 1, made(_GRID)).otherwise("<p>Measure   well</p>")
    page = F.concat(
        F.lit("<html><body><h1>Size guide "), "p_brand", F.lit("</h1><section><h2>Men "), "p_type", F.lit("</h2><p>before "), k, F.lit("</p>"), inner,
        F.lit("<p>after "), "p_size", F.lit("</p></section></body></html>"),
    )
    docs = table(spark, sf_dir, "part").select(k.cast("string").alias("url"), F.lit("static").alias("renderer"), page.alias("html"))
    found = html.parse(docs).select("url", F.explode("tables").alias("t"))
    return found.select(
        F.col("url").cast("long").alias("p_partkey"), "t.ord", "t.kind", F.array_join(F.flatten("t.matrix"), "|").alias("cells"), "t.title",
        F.array_join("t.heading_path", " > ").alias("path"), "t.subheading", "t.nearby",
    )


@query("""
WITH s AS (SELECT s_suppkey AS k, s_name AS name, unnest(range(0, 3)) AS i, 'Deep ' || (s_suppkey % 7) AS deep FROM supplier)
SELECT k AS s_suppkey, CAST(i AS INTEGER) AS ord, '/g/' || i AS href, CASE i WHEN 1 THEN 'titled' ELSE 'Guide ' || i END AS label,
  CASE i WHEN 0 THEN 'Top > ' || name ELSE 'Top > ' || deep END AS path,
  CASE i WHEN 0 THEN 'about ' || name WHEN 1 THEN 'left right' ELSE 'more' END AS nearby FROM s""")
def html_link_context(spark, sf_dir):
    """Labels, heading paths and texts around the links of a page of each supplier."""
    k = F.col("s_suppkey")
    page = F.concat(
        F.lit("<html><body><h1>Top</h1><div><h2>"), "s_name", F.lit('</h2><p>about '), "s_name", F.lit('</p><a href="/g/0"><b>Guide</b>  0</a><h3>Deep '),
        (k % 7).cast("string"), F.lit('</h3><div><span>left</span><a href="/g/1" title="titled"><script>var a = 1;</script></a><span>right</span></div>'),
        F.lit('<section><p>more</p><a href="/g/2">Guide\n2</a></section><a name="x">no link</a></div></body></html>'),
    )
    docs = table(spark, sf_dir, "supplier").select(k.cast("string").alias("url"), F.lit("static").alias("renderer"), page.alias("html"))
    found = html.parse(docs).select("url", F.explode("links").alias("l"))
    return found.select(
        F.col("url").cast("long").alias("s_suppkey"), "l.ord", "l.href", "l.label", F.array_join("l.heading_path", " > ").alias("path"), "l.nearby",
    )


#: (href, label, reasons never to follow) of the links of a made page; a page has those whose number its own doesn't rule out.
_LINKS = (
    ("/size-guide/men-tops", "Men tops size guide", ""), ("/size-guide/women-tops", "Women tops size guide", "women"),
    ("/size-guide/kids-tops", "Kids tops size guide", "kids"), ("/size-guide/men-shoes", "Men shoes size guide", "footwear"),
    ("/size-guide/men-jeans", "Men jeans size guide", "bottoms"), ("http://other.org/size-guide/men-tops", "Men tops size guide", "off-brand"),
    ("#size-guide-men-tops", "Men tops size guide", None), ("/help#size-guide-men", "Men tops size guide", "same-page"),
    ("http://other.org/size-guide/women-shoes", "Women shoes size guide", "women,footwear,off-brand"),
)
_LISTED = ", ".join(f"({i}, '{label}', {'NULL' if hard is None else repr(hard)})" for i, (_, label, hard) in enumerate(_LINKS))


@query(f"""
WITH l AS (SELECT page_id, i, label, hard FROM pages, (VALUES {_LISTED}) AS v(i, label, hard) WHERE (page_id + i) % 4 <> 0 AND hard IS NOT NULL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS new_ord, label, hard,
  CAST(CASE WHEN hard = '' THEN 2 END AS INTEGER) AS pool, hard = '' AS followed FROM l""")
def link_choice(spark, sf_dir):
    """Which links of a page may never be followed and why, the pool of the others, and the one that is followed."""
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(h).alias("href"), F.lit(t).alias("label")) for i, (h, t, _) in enumerate(_LINKS)])
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("http://shop"), "page_id", F.lit(".com/help")).alias("url"), F.explode(rows).alias("l"))
    found = pages.select("page_id", "url", "l.*").where((F.col("page_id") + F.col("i")) % 4 != 0).withColumnRenamed("i", "ord").withColumns(
        {
            "heading_path": F.array().cast("array<string>"), "nearby": F.lit(""), "resolver": F.lit("generic"),
            "asked_category": F.lit("tshirts"), "asked_system": F.lit("INT"),
        }
    )
    best = links.follow(links.best_per_url(links.score(found), ["page_id"]), ["page_id"], F.lit(False))
    return best.select("page_id", "new_ord", "label", F.array_join("hard", ",").alias("hard"), "pool", "followed")
