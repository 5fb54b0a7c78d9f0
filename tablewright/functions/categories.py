"""Classifiers: garment categories, audiences, size systems asked for, and how they match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.domain import TOP_FIELDS
from tablewright.functions.text import has_any, let, token

# fixed values: word lists of the classifiers
TOP_WORDS = ("top", "tops", "haut", "hauts", "upper body")
BOTTOM_WORDS = ("bottom", "bottoms", "bas", "lower body")
OUTER_WORDS = (
    "jacket", "jackets", "coat", "coats", "outerwear", "manteau", "manteaux", "veste", "vestes", "parka", "parkas",
    "doudoune", "doudounes",
)
BROAD_TOP_WORDS = ("tops tees", "tees tops", "shirts tops", "tops shirts")
KID_WORDS = ("kid", "kids", "child", "children", "junior", "boys", "girls")
WOMEN_WORDS = ("women", "woman", "female", "femme", "femmes")
MEN_WORDS = ("men", "man", "male", "homme", "hommes")
TEE_WORDS = ("t shirt", "tshirt", "tshirts", "tee", "tees")
SHIRT_WORDS = ("shirt", "shirts", "chemise", "chemises")
HOODIE_WORDS = ("hoodie", "hoodies", "sweatshirt", "sweatshirts")
JEAN_WORDS = ("jean", "jeans", "denim")
SHORT_WORDS = ("short", "shorts")
LEGGING_WORDS = ("legging", "leggings", "tight", "tights")
PANT_WORDS = ("pant", "pants", "trouser", "trousers", "pantalon", "pantalons", "chino", "cargo")
SHOE_WORDS = ("shoe", "shoes", "footwear", "chaussure", "chaussures")
BODY_WORDS = (
    "body measurement", "body measurements", "body measure", "body measures", "body guide", "guide des mesures",
)
#: What a request may ask for, in order of precedence.
ASKED = (
    ("tshirts", TEE_WORDS),
    ("shirts", SHIRT_WORDS),
    ("hoodies", HOODIE_WORDS),
    ("jackets", OUTER_WORDS),
    ("jeans", JEAN_WORDS),
    ("shorts", SHORT_WORDS),
    ("leggings", LEGGING_WORDS),
    ("pants", (*PANT_WORDS, "cargos")),
    ("bras", ("bra", "bras", "brassiere", "brassieres")),
    ("shoes", (*SHOE_WORDS, "sneaker", "sneakers")),
    ("generic-body-guide", ("generic", "body", *BODY_WORDS, "guide morphologie", "generic body guide")),
)
ASKED_SYSTEMS = {
    "INT": ("int", "international", "alpha", "letter"),
    "EU": ("eu", "europe", "european"),
    "FR": ("fr", "france", "francais"),
    "US": ("us", "usa", "american"),
    "UK": ("uk", "british"),
    "IT": ("it", "italy", "italian"),
    "WAIST_INSEAM": ("waist inseam",),
    "FOOTWEAR": ("footwear", "shoe size"),
    "BRA": ("bra",),
}
#: Rules that find a section's category, in order: name, family, words.
WORD_RULES = (
    ("bras", "bras", ("bra", "bras", "brassiere", "cup")),
    ("jeans", "bottoms", JEAN_WORDS),
    ("shorts", "bottoms", SHORT_WORDS),
    ("leggings", "bottoms", LEGGING_WORDS),
    ("pants", "bottoms", PANT_WORDS),
    ("tops", "tops", BROAD_TOP_WORDS),
    ("tshirts", "tops", TEE_WORDS),
    ("shirts", "tops", SHIRT_WORDS),
    ("hoodies", "tops", HOODIE_WORDS),
    ("jackets", "tops", OUTER_WORDS),
)
RESOLVED = (
    "tshirts", "shirts", "hoodies", "jackets", "pants", "jeans", "shorts", "leggings", "bras", "shoes",
    "generic-body-guide",
)
SERVES_TSHIRTS = ("tops", "shirts", "hoodies", "jackets")



def _first(rules, otherwise=None) -> Column:
    """The value of the first (condition, value) that holds."""
    start = F.when(F.lit(False), F.lit("").cast("string"))
    found = reduce(lambda c, rule: c.when(rule[0], F.lit(rule[1])), rules, start)
    return found if otherwise is None else found.otherwise(otherwise)


def asked_category(raw: Column) -> Column:
    """The category that a request's text asks for, else null."""
    return let(
        token(raw),
        lambda n: _first([(n.isin("top", "tops"), "tshirts"), *((has_any(n, words), name) for name, words in ASKED)]),
    )


def asked_system(raw: Column) -> Column:
    """The size system that a request's text asks for, else null."""
    return let(token(raw), lambda n: _first([(n.isin(*words), name) for name, words in ASKED_SYSTEMS.items()]))


def asked_audience(raw: Column) -> Column:
    """The audience that a request's text asks for, else null."""
    return let(token(raw), lambda n: _first([
        (has_any(n, (*MEN_WORDS, "mens")), "men"),
        (has_any(n, (*WOMEN_WORDS, "ladies", "womens")), "women"),
        (has_any(n, KID_WORDS), "kids"),
        (has_any(n, ("unisex", "gender neutral", "mixed")), "unisex"),
    ]))


def audience_of(text: Column) -> Column:
    """The audience that a section's text names."""
    return let(token(text), lambda n: _first([
        (has_any(n, KID_WORDS), "kids"),
        (has_any(n, ("unisex",)), "unisex"),
        (has_any(n, (*WOMEN_WORDS, "lady", "ladies")), "women"),
        (has_any(n, MEN_WORDS), "men"),
    ], "unknown"))


def section_rule(section: Column, text: Column, fields: Column) -> Column:
    """struct(category, family, rule) of a section.

    section is its title, subheading and headers, text these with stub, sizes and
    nearby text; fields are those that its labels name.
    """

    def made(name: str, family: str, rule: str) -> Column:
        return F.struct(F.lit(name).alias("category"), F.lit(family).alias("family"), F.lit(rule).alias("rule"))

    def of(own: Column) -> Column:
        s, n = own["s"], own["n"]

        def has(*names: str) -> Column:
            return F.arrays_overlap(own["f"], F.array(*map(F.lit, names)))

        chest, inseam = has("chest"), has("inseam")
        rules = [
            (chest & inseam, "generic-body-guide", "body", "chest-and-inseam"),
            (has_any(s, (*BODY_WORDS, "size advice", "fit advice", "how to measure")), "generic-body-guide", "body", "body-title"),
            (has("footLength", "footWidth") | has_any(n, (*SHOE_WORDS, "foot length", "foot width")), "shoes", "shoes", "footwear"),
            *((has_any(n, words), name, family, f"{name}-words") for name, family, words in WORD_RULES),
            (has_any(n, TOP_WORDS) | chest, "tops", "tops", "broad-tops"),
            (has_any(n, BOTTOM_WORDS) | inseam, "bottoms", "bottoms", "broad-bottoms"),
        ]
        first, *rest = rules
        found = reduce(lambda c, r: c.when(r[0], made(*r[1:])), rest, F.when(first[0], made(*first[1:])))
        return found.otherwise(made("unknown", "unknown", "no-evidence"))

    return let(F.struct(token(section).alias("s"), token(text).alias("n"), fields.alias("f")), of)


def mapping_mode(category: Column, text: Column, fields: Column) -> Column:
    """How a section's category maps to what can be asked for."""
    tops_only = (F.size(fields) > 0) & F.forall(fields, lambda f: f.isin(*TOP_FIELDS))

    def curated(n: Column) -> Column:
        bottoms = has_any(n, BOTTOM_WORDS) | F.array_contains(fields, "inseam")
        broad = has_any(n, ("top", "tops", "haut", "hauts")) & ~has_any(n, OUTER_WORDS) & ~bottoms & tops_only
        return has_any(n, BROAD_TOP_WORDS) | broad

    return (
        F.when(category == "generic-body-guide", "generic-body")
        .when(category == "unknown", "unknown")
        .when(category != "tops", "exact")
        .when(let(token(text), curated), "curated-broad-top")
        .otherwise("unknown")
    )


def match_mode(asked: Column, found: Column) -> Column:
    """exact, curated, generic-body or none for a category asked for (null: any) and one found."""
    return (
        F.when(asked.isNull() & (found == "generic-body-guide"), "generic-body")
        .when(asked.isNull() & found.isin(*RESOLVED), "exact")
        .when(asked.isNull(), "none")
        .when(asked == found, "exact")
        .when((asked == "tshirts") & found.isin(*SERVES_TSHIRTS), "curated")
        .otherwise("none")
    )


def matched_category(asked: Column, found: Column) -> Column:
    """The category that a match stands for, null for none."""
    return F.when(match_mode(asked, found) != "none", F.coalesce(asked, found))
