"""Link operators: scoring for a request, dedupe, the official fallbacks, and the link to follow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.domain import BOTTOM_CATEGORIES, TOP_CATEGORIES
from tablewright.functions import categories, navigation, sizes, urls
from tablewright.functions.text import has_any, joined, let, token
from tablewright.functions.units import round_half_up
from tablewright.operators.candidates import dedupe
from tablewright.operators.select import reasons

#: Least score of a link that may be followed, and score of one that may not.
LEAST, NEVER = 3.0, -99.0

# fixed values: (part of the host, class of request, url, label) of known official guides, first match first
OFFICIAL = (
    ("nike.com", "shoe", "https://www.nike.com/size-fit/mens-footwear", "Nike guide officiel chaussures homme"),
    ("nike.com", "waist-inseam", "https://www.nike.com/size-fit/mens-bottoms-numeric/", "Nike guide officiel bas homme"),
    ("nike.com", "bottom", "https://www.nike.com/size-fit/mens_bottoms_alpha", "Nike guide officiel bas homme"),
    ("nike.com", "top", "https://www.nike.com/size-fit/mens-tops-alpha", "Nike guide officiel hauts homme"),
    ("adidas.", "shoe", "https://www.adidas.com/us/help/size_charts/men-shoes", "adidas guide officiel chaussures homme"),
    ("adidas.", "bottom", "https://www.adidas.com/us/help/size_charts/men-pants_shorts", "adidas guide officiel bas homme"),
    ("adidas.", "any", "https://www.adidas.com/us/help/size_charts/men-shirts_tops", "adidas guide officiel hauts homme"),
    ("puma.", "any", "https://eu.puma.com/de/en/size-charts.html", "PUMA guide officiel tailles homme"),
    ("reebok.", "top", "https://www.reebok.com/us/men-tops-size-chart", "Reebok guide officiel hauts homme"),
    ("reebok.", "any", "https://www.reebok.com/us/size-chart-men", "Reebok guide officiel tailles homme"),
    ("underarmour.", "top", "https://www.underarmour.com/en-us/t/size-guide/mens-tops/", "Under Armour guide officiel hauts homme"),
    ("underarmour.", "any", "https://www.underarmour.com/en-us/t/size-guide/mens/", "Under Armour guide officiel tailles homme"),
    ("newbalance.", "any", "https://www.newbalance.com/customercare-sizeguide-apparel.html", "New Balance guide officiel vêtements homme"),
    ("patagonia.", "any", "https://www.patagonia.com/guides/size-fit/mens/", "Patagonia guide officiel tailles homme"),
    ("zara.", "any", "https://www.zara.com/fr/fr/help/size-guide-h38.html", "Zara guide officiel tailles"),
    ("tommy.com", "any", "https://usa.tommy.com/en/size-guide-men.html", "Tommy Hilfiger guide officiel tailles homme"),
    ("tommyhilfiger.", "any", "https://usa.tommy.com/en/size-guide-men.html", "Tommy Hilfiger guide officiel tailles homme"),
    ("calvinklein.", "any", "https://www.calvinklein.us/en/men-size-guide.html", "Calvin Klein guide officiel tailles homme"),
    ("columbia.", "any", "https://www.columbia.com/sizefit?isPage=true&r=1", "Columbia guide officiel hauts homme"),
    ("thenorthface.", "any", "https://www.thenorthface.com/en-us/help/size-charts", "The North Face guide officiel hauts homme"),
    ("lacoste.", "any", "https://www.lacoste.com/ca/fr/sizeguide/", "Lacoste guide officiel tailles homme"),
)
# fixed values: a second guide that is offered beside the first, label of supplied guides, heading and text around official ones
SECOND = {"newbalance.": ("https://www.newbalance.com/sizechart-apparel.html", "New Balance ancien guide vêtements homme")}
GIVEN = "Fallback guide fourni"
KNOWN = "Guide officiel connu"
NEAR = (
    "Official brand size guide fallback. Guide des tailles officiel. Men's tops size chart. "
    "Lien de secours officiel utilisé lorsque la page fournie ne contient pas directement de tableau exploitable."
)
#: Links of a page that a report's log names.
LOGGED = 8


def official(docs: DataFrame, key: list[str]) -> DataFrame:
    """Fallback links of requests: those they supply (fallback_urls), then the official guides of their host.

    Needs url, asked_category, asked_system and fallback_urls. The rules are one CASE
    expression; nothing is joined.
    """
    host, asked, system = urls.host(F.col("url")), F.col("asked_category"), F.coalesce("asked_system", F.lit(""))
    shoe = (F.coalesce(asked, F.lit("")) == "shoes") | (system == "FOOTWEAR")
    bottom = F.coalesce(asked.isin(*BOTTOM_CATEGORIES), F.lit(False))
    fits = {
        "shoe": shoe, "waist-inseam": ~shoe & bottom & (system == "WAIST_INSEAM"), "bottom": ~shoe & bottom,
        "top": asked.isNull() | asked.isin(*TOP_CATEGORIES), "any": F.lit(True),
    }

    def link(url: str, label: str) -> Column:
        return F.struct(F.lit(url).alias("href"), F.lit(label).alias("label"))

    def offered(part: str, url: str, label: str) -> Column:
        return F.array(link(url, label), *([link(*SECOND[part])] if part in SECOND else []))

    none = F.array().cast("array<struct<href:string,label:string>>")
    known = reduce(lambda c, r: c.when(host.contains(r[0]) & fits[r[1]], offered(r[0], *r[2:])), OFFICIAL, F.when(F.lit(False), none))
    given = F.transform(
        F.coalesce("fallback_urls", F.array().cast("array<string>")),
        lambda u, i: F.struct(urls.resolved(F.col("url"), u).alias("href"), F.concat(F.lit(f"{GIVEN} "), i + 1).alias("label")),
    )
    usable = F.filter(given, lambda x: x["href"].isNotNull() & ~urls.is_asset(x["href"]))
    return docs.select(*key, F.posexplode(F.concat(usable, F.coalesce(known, none))).alias("ord", "_l")).select(
        *key, "ord", "_l.href", "_l.label", F.array(F.lit(KNOWN)).alias("heading_path"), F.lit(NEAR).alias("nearby"),
        F.lit("brand-fallback").alias("resolver"),
    )


def score(links: DataFrame) -> DataFrame:
    """Adds link_url, link_score, link_reasons and link_rejections to raw links of requests.

    Needs url (the page's), href, label, heading_path, nearby, resolver,
    asked_category and asked_system. Links that can't be resolved, point to assets or,
    if generic, are not guide-like are left out.
    """
    df = links.withColumn("link_url", urls.resolved(F.col("url"), F.col("href"))).where(F.col("link_url").isNotNull())
    df = df.where(~urls.is_asset(F.col("link_url"))).withColumn("label", navigation.label_or_url(F.col("label"), F.col("link_url")))
    url, label = F.col("link_url"), F.col("label")
    path = F.array_join("heading_path", " ")
    df = df.withColumn("_context", joined(label, path, F.col("nearby"), url)).withColumn("_primary", joined(label, url))
    df = df.where((F.col("resolver") == "brand-fallback") | navigation.is_guide_like(F.col("_context")))
    context = F.col("_context")
    none = F.array().cast("array<string>")
    df = df.withColumns(
        {
            "_category": categories.section_rule(label, context, none)["category"],
            "_system": sizes.table_system(none, none, none, context),
            "_who": navigation.link_audience(F.col("_primary")),
            "_product": navigation.is_product(url, label),
            "_utility": navigation.is_utility(url, label) | navigation.is_bad_target(url, label),
            "_inside": urls.same_brand(F.col("url"), url),
            "_same": urls.document(F.col("url")) == urls.document(url),
            "_guide": navigation.is_guide_like(context),
            "_concrete": navigation.is_concrete_guide(url, F.col("_primary")),
            "_words": token(context),
        }
    )
    asked, found, words = F.col("asked_category"), F.col("_category"), F.col("_words")
    mode = categories.match_mode(asked, found)
    tshirts = F.coalesce(asked == "tshirts", F.lit(False))

    def when(test: Column, value: float) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), value).otherwise(0.0)

    by_category = (
        F.when(mode == "exact", 5.0).when(mode == "curated", 4.0).when(found == "generic-body-guide", -2.0)
        .when(asked.isNotNull() & ~found.isin("unknown", "tops", "bottoms"), -4.0).otherwise(0.0)
    )
    system, own = F.col("asked_system"), F.col("_system")
    by_system = (
        F.when(system.isNull(), 0.0).when(own == system, 2.0)
        .when((system == "INT") & has_any(words, ("international", "alpha", "xxs", "xs", "xl", "3xl")), 1.5)
        .when(own != "UNKNOWN", -1.5).otherwise(0.0)
    )
    apparel = has_any(words, (*navigation.APPAREL, *navigation.TOPS))
    newbalance = has_any(words, ("newbalance", "new balance"))
    fallback = (
        F.when(has_any(words, ("underarmour", "under armour")) & has_any(words, navigation.TOPS), 6.5)
        .when(newbalance & apparel, 6.5).when(newbalance & has_any(words, navigation.FOOTWEAR), -2.0)
        .when(has_any(words, ("puma", "adidas", "reebok", "nike")) & apparel, 6.0).otherwise(5.0)
    )
    shoes, bottoms = has_any(words, navigation.FOOTWEAR), has_any(words, navigation.BOTTOMS)
    total = (
        navigation.one_hop(context, F.col("_who"))
        + when(F.col("_product"), -20.0) + when(F.col("_utility"), -20.0) + when(~F.col("_inside"), -5.0)
        + when(url == F.col("url"), -3.0) + when(F.col("_same"), -20.0) + when(F.col("_guide"), 2.0)
        + by_category + by_system + F.when(F.col("resolver") == "brand-fallback", fallback).otherwise(0.0)
        + F.when(shoes, F.when(tshirts, -4.0).otherwise(-1.0)).otherwise(0.0) + when(bottoms & tshirts, -3.0)
    )
    return df.withColumns(
        {
            "link_score": round_half_up(total, 2),
            "link_reasons": reasons((F.col("_inside"), "same-brand"), (F.col("_guide"), "guide-like"), (by_category > 0, "category"), (by_system > 0, "size-system")),
            "link_rejections": reasons(
                (F.col("_who") == "women", "women"), (F.col("_who") == "kids", "kids"), (shoes, "footwear"), (bottoms, "bottoms"),
                (F.col("_product"), "product-page"), (F.col("_utility"), "utility"), (~F.col("_inside"), "off-brand"), (F.col("_same"), "same-page"),
            ),
        }
    )


def best_per_url(links: DataFrame, key: list[str]) -> DataFrame:
    """One link for each url of a page: the first of its highest score; new_ord gives its place."""
    return dedupe(links, key, ["link_url"], "link_score")


def follow(links: DataFrame, key: list[str], concrete_only: Column) -> DataFrame:
    """Adds hub_score, hard (names of reasons never to follow), pool and followed to scored links.

    Of the links that may be followed the pool decides first (supplied fallback, then
    concrete guide found on the page, then official fallback), then score, then place.
    concrete_only says of a row that only concrete guides count.
    """
    fallback = F.col("resolver") == "brand-fallback"
    concrete = F.col("_concrete") | fallback
    primary = F.col("_primary")
    tshirts = F.coalesce(F.col("asked_category") == "tshirts", F.lit(False))
    who = F.col("_who")
    own = token(primary)
    hard = reasons(
        (who == "women", "women"), (who == "kids", "kids"),
        (tshirts & has_any(own, navigation.FOOTWEAR), "footwear"), (tshirts & has_any(own, navigation.BOTTOMS), "bottoms"),
        (~F.col("_inside"), "off-brand"), (F.col("_same"), "same-page"), (F.col("_product"), "product-page"),
        (F.col("_utility"), "utility"), (concrete_only & ~concrete, "not-concrete"),
    )
    df = links.withColumn("hard", hard)
    generic = ~fallback & F.col("_concrete")
    bonus = (
        F.when(concrete, 3.0).otherwise(0.0) + F.when(generic, 4.0).otherwise(0.0) + F.when(fallback, 2.0).otherwise(0.0)
        + F.when(generic & let(own, lambda n: has_any(n, ("apparel", "clothing", "tops", "tshirts", "shirts", "hauts"))), 3.0).otherwise(0.0)
    )
    hub = F.when(F.size("hard") == 0, navigation.one_hop(F.col("_context"), who) + bonus).otherwise(F.lit(NEVER))
    pool = F.when(fallback & F.lower("label").startswith(GIVEN.lower()), 1).when(generic, 2).when(fallback, 3)
    df = df.withColumn("hub_score", hub).withColumn("pool", F.when(F.col("hub_score") >= LEAST, pool))
    order = Window.partitionBy(*key).orderBy(F.col("pool").asc_nulls_last(), F.desc("hub_score"), F.desc("link_score"), "new_ord")
    return df.withColumn("followed", (F.row_number().over(order) == 1) & F.col("pool").isNotNull())


def clear_winner(links: DataFrame, key: list[str], hub: Column) -> DataFrame:
    """Adds clear: the best link where it scores well and well above the next (4.5 and 1 on hubs, else 5.5 and 1.5)."""
    order = Window.partitionBy(*key).orderBy(F.desc("link_score"), "new_ord")
    gap = F.col("link_score") - F.lead("link_score").over(order)
    df = links.withColumns({"_rn": F.row_number().over(order), "_gap": gap})
    least, apart = F.when(hub, 4.5).otherwise(5.5), F.when(hub, 1.0).otherwise(1.5)
    fine = (F.col("_rn") == 1) & (F.col("link_score") >= least) & (F.col("_gap").isNull() | (F.col("_gap") >= apart))
    return df.withColumn("clear", fine).drop("_rn", "_gap")


def logged(links: DataFrame, key: list[str]) -> DataFrame:
    """Adds logged to followed links: for the first LOGGED of a page by score, what its log says of them; null for the others."""
    order = Window.partitionBy(*key).orderBy(F.desc("link_score"), "new_ord")
    why = F.coalesce(F.get("hard", F.lit(0)), F.get("link_rejections", F.lit(0)), F.get("link_reasons", F.lit(0)))
    entry = F.struct(
        F.row_number().over(order).alias("place"), "label", F.col("hub_score").alias("score"), "resolver", F.col("link_url").alias("url"),
        F.col("followed").alias("selected"), why.alias("reason"),
    )
    return links.withColumn("_entry", entry).withColumn("logged", F.when(F.col("_entry.place") <= LOGGED, F.col("_entry"))).drop("_entry")


def trace_step(link=None) -> Column:
    """The step that following a link adds to a request's trace; link gives its columns by name, by default the table's."""
    link = link or F.col
    kind = F.when(link("resolver") == "brand-fallback", "brand-fallback").otherwise("followed-link")
    return F.struct(
        kind.alias("kind"), link("link_url").alias("url"), link("label").alias("label"),
        navigation.follow_confidence(link("hub_score")).alias("confidence"), link("link_reasons").alias("reasons"),
    )
