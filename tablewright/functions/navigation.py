"""What a link and a document are good for: predicates, scores, document kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions import urls
from tablewright.functions.text import clean, has_any, let, token

# fixed values: word lists of navigation
MEN = ("men", "mens", "homme", "hommes", "man", "male")
WOMEN = ("women", "womens", "woman", "female", "femme", "femmes", "lady", "ladies")
KIDS = (
    "kid", "kids", "child", "children", "junior", "baby", "infant", "toddler", "bebe", "enfant", "enfants", "boy", "boys",
    "girl", "girls",
)
TOPS = ("top", "tops", "haut", "hauts", "shirt", "shirts", "chemise", "chemises", "tee", "tees", "t-shirt", "t-shirts", "tshirt", "tshirts")
BOTTOMS = (
    "pant", "pants", "trouser", "trousers", "pantalon", "pantalons", "bottom", "bottoms", "bas", "jean", "jeans", "short",
    "shorts", "inseam", "entrejambe",
)
SIZES = (
    "size", "taille", "tailles", "fit", "guide", "chart", "charts", "alpha", "officiel", "official", "sizing", "measurement",
    "measurements", "mesure", "mesures", "sizeguide", "sizeguides", "sizechart", "sizecharts",
)
FOOTWEAR = ("shoe", "shoes", "footwear", "chaussure", "chaussures", "foot length", "foot width")
APPAREL = ("apparel", "clothing")
GUIDE_PHRASES = (
    "size chart", "size charts", "size guide", "size guides", "size fit", "guide des tailles", "tableau des tailles",
    "mens tops alpha", "men tops alpha",
)
UTILITY = (
    "skip to footer content", "skip to main content", "skip to content", "acceder au contenu principal", "main content",
    "create account", "sign in", "log in", "login", "cart", "bag", "wishlist", "menu", "search", "rechercher",
    "voir le contenu", "acceder au haut de la page", "link to main navigation", "link to search", "link to footer",
    "skip to search", "send us feedback", "site feedback", "your opinion counts", "contact us", "customer service", "help",
    "support", "accessibility", "privacy", "terms", "newsletter", "cookie", "cookie settings", "change country",
    "store locator", "find a store", "storefinder", "select a store", "youre shopping", "you're shopping", "order status",
    "faq", "imprint", "sitemap", "promotions", "student promotion", "digital greeting card", "authenticity",
    "payment methods", "saved items", "styling book", "style guide", "gift guide", "denim fit guide", "gifts for him",
    "gifts for her", "gifts for mom", "spring selection", "summer selection", "new arrivals", "sale", "deals", "uniqlo u",
    "shop by gender", "gender", "explore", "my account", "account", "premium", "spring summer", "limited time offers",
    "best sellers", "coming soon", "gift selection", "outdoor guide", "fabric guide", "work office wear",
    "work and office wear", "top picks", "new in",
)
DEAD = (
    "page not found", "page non trouvee", "page non trouve", "http error 404", "this page can t be found",
    "no webpage was found", "we can t locate that page", "can t locate that page", "vous cherchez votre chemin",
    "our apologies there has been an error",
)
ANCHORS = (
    "content|footer|main|maincontent|footercontent|header-desktop|header__search--desktop|shopify-section-footer|"
    "search-input-header-modal|topnavwrapper|sitewide-footer"
)
GUIDE_IN_PATH = r"size[-_/]?(?:fit|chart|guide)|mens?[-_]?tops?[-_]?alpha|tops?[-_]?alpha|apparel[-_/]size"
PRODUCT_PATH = r"/(?:p|product|products|sku)/|/t/(?!size-guide(?:/|$))[^/?#]+|/(?:lacoste|homme|femme|men|women)/.+/[^/]+\.html$"
PRODUCT_QUERY = r"(?:^|[?&])(?:color|size|sku|pid|productid)="
GARMENT = r"\b(?:t[\s-]?shirt|tee|shirt|hoodie|pants?|shorts?)\b"
SOLD_BY = rf"\b(?:nike|adidas|puma|reebok|new balance|under armour)\b.*{GARMENT}"
FABRIC = r"\b(?:dri[\s-]?fit|drycell|climacool|heatgear|coldgear|nb dry)\b"
SPORT = r"\bmen'?s\b.*\b(?:fitness|training|running|basketball|graphic)\b.*\b(?:t[\s-]?shirt|tee|shirt)\b"
BAD_PATH = (
    "/(?:stores?|store-locator|retail|promotions?|gift|gifts|stylingbook|stories|journal|rlmag|wishlist|saved-items|"
    "payment-methods|sitemap|privacy|terms|authenticity|student-promotions|digital-card|help|faq)(?:/|$)"
)
MEASURES = r"(?i)\b(?:chest|waist|hips|inseam|foot length)\b"


def link_audience(text: Column) -> Column:
    """kids, women, unisex, men or unknown, in this order."""
    return let(
        token(text),
        lambda n: F.when(has_any(n, KIDS), "kids")
        .when(has_any(n, WOMEN), "women")
        .when(has_any(n, ("unisex", "gender neutral")), "unisex")
        .when(has_any(n, MEN), "men")
        .otherwise("unknown"),
    )


def is_guide_like(text: Column) -> Column:
    return has_any(token(text), (*SIZES, *TOPS, *APPAREL, "vetement", "vetements"))


def is_concrete_guide(url: Column, text: Column) -> Column:
    """Whether url or text name a size guide, and nothing but tops."""
    words = token(F.concat_ws(" ", text, url))
    named = urls.is_guide_path(url) | F.lower(urls.path(url)).rlike(f"{GUIDE_IN_PATH}|sizecharts?|sizeguides?")
    return let(
        words,
        lambda n: (named | has_any(n, (*GUIDE_PHRASES, "sizeguide", "sizeguides", "sizechart", "sizecharts")))
        & ~has_any(n, (*FOOTWEAR, *KIDS, *BOTTOMS, "bra", "bras")),
    )


def is_product(url: Column, label: Column) -> Column:
    """Whether a link looks like one product's page."""
    raw, low = F.concat_ws(" ", label, url), F.lower(urls.path(url))
    guide = (
        raw.rlike(r"(?i)\b(?:size|chart|guide|alpha|measurements?|tailles?|officiel)\b")
        | urls.is_guide_path(url)
        | F.lower(url).rlike(r"size[-_/]?(?:fit|chart|guide)")
        | low.rlike(GUIDE_IN_PATH)
    )
    price = label.rlike(r"(?i)[$]\s?\d|\b(?:usd|gbp|cad|aud)\s?\d")
    query = F.lower(urls.query(url)).rlike(PRODUCT_QUERY) | url.rlike("%22|%27|[\"']")
    title = raw.rlike(f"(?i){SOLD_BY}|{FABRIC}|{SPORT}") | (label.rlike(r"(?i)\bproduct\b") & label.rlike(f"(?i){GARMENT}"))
    return price | low.rlike(PRODUCT_PATH) | query | (~guide & title)


def is_utility(url: Column, label: Column) -> Column:
    """Whether a link serves the site's own navigation."""
    n = token(label)
    guarded = has_any(n, (*SIZES, *TOPS, *APPAREL))
    jump = F.lower(urls.path(url)).rlike("^/?(?:#|main|content|skip)") | F.lower(urls.fragment(url)).rlike(f"^#(?:{ANCHORS})$")
    return ~guarded & (jump | has_any(n, UTILITY))


def is_bad_target(url: Column, label: Column) -> Column:
    """Whether a link leads to marketing, help or shop pages."""
    n, low = token(label), F.lower(urls.path(url))
    shop = F.lower(urls.fragment(url)).rlike(f"cookie|change[-_ ]?country|^#(?:{ANCHORS})$") | F.lower(urls.query(url)).rlike(PRODUCT_QUERY)
    return (
        url.rlike("%22|%27|[\"']")
        | (has_any(n, UTILITY) & ~has_any(n, GUIDE_PHRASES))
        | (~is_concrete_guide(url, label) & (has_any(token(F.concat_ws(" ", label, url)), UTILITY) | shop | low.rlike(BAD_PATH)))
    )


def one_hop(text: Column, audience: Column) -> Column:
    """Score of a link's context for a guide of men's tops."""

    def of(n: Column) -> Column:
        def points(words, value: float) -> Column:
            return F.when(has_any(n, words), value).otherwise(0.0)

        return (
            points(TOPS, 3.0) + points((*SIZES, "guide des tailles", "tableau des tailles"), 2.0)
            + points(("chart", "guide", "alpha"), 2.0) + points(FOOTWEAR, -3.0) + points(BOTTOMS, -3.0)
        )

    who = F.when(audience == "men", 3.0).when(audience == "women", -8.0).when(audience == "kids", -13.0).otherwise(0.0)
    return let(token(text), of) + who


def table_signals(html: Column, markdown: Column) -> Column:
    """Tables, half the piped lines, and up to four measure words."""
    tables = F.regexp_count(html, F.lit(r"(?i)<table\b")) + F.regexp_count(html, F.lit("(?i)role=[\"']table[\"']"))
    pipes = F.floor(F.regexp_count(markdown, F.lit(r"(?m)^\|.+\|$")) / 2)
    return tables + pipes + F.least(F.regexp_count(markdown, F.lit(MEASURES)), F.lit(4))


def has_table_content(html: Column, markdown: Column) -> Column:
    return html.rlike("(?i)<table\\b|role=[\"']table[\"']") | markdown.rlike(r"(?m)^\|.+\|$") | markdown.rlike(MEASURES)


def is_dead(text: Column) -> Column:
    return has_any(token(text), DEAD)


def category_signals(text: Column) -> Column:
    """How many kinds of garments a text names."""

    def of(n: Column) -> Column:
        out = F.lit(0)
        for words in (TOPS, BOTTOMS, FOOTWEAR, ("bra", "cup size"), KIDS):
            out = out + has_any(n, words).cast("int")
        return out

    return let(token(text), of)


def document_kind(n_links: Column, best_link: Column, blocks: Column, signals: Column, categories: Column, dead: Column) -> Column:
    """guide-hub-page, multi-guide-page, direct-guide-page or irrelevant."""
    bare = (blocks == 0) & (signals == 0)
    return (
        F.when(bare & dead, "irrelevant")
        .when(bare & ((n_links >= 2) | ((n_links == 1) & (best_link >= 3))), "guide-hub-page")
        .when((blocks > 1) | (categories >= 2), "multi-guide-page")
        .when((blocks == 1) | (signals > 0), "direct-guide-page")
        .otherwise("irrelevant")
    )


def source_type(kind: Column, url: Column) -> Column:
    product = F.lower(url).rlike("product|sku|/p/|/products/")
    return (
        F.when(kind == "guide-hub-page", "guide-hub-page")
        .when(kind == "multi-guide-page", "generic-multi-guide-page")
        .when((kind == "direct-guide-page") & product, "product-page-size-guide")
        .otherwise("category-specific-page")
    )


def follow_confidence(score: Column) -> Column:
    return F.least(F.lit(0.98), F.lit(0.35) + score / 10)


def label_or_url(label: Column, url: Column) -> Column:
    return F.when(clean(label) != "", clean(label)).otherwise(url)
