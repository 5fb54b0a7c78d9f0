"""Size labels: recognition, canonical form, fit variants, size systems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.text import has_any, let, token

# fixed values: label patterns on token() form, shorthands, system words
ALPHA = r"^(?:xxs|xs|s|sm|m|md|l|lg|xl|xxl|2xl|xxxl|3xl|4xl|5xl)(?: tall| petite| regular| short| long)?$"
NUMBER = r"^\d{2,3}(?: tall| petite| regular| short| long)?$"
WAIST_INSEAM = r"^w\d+\s*l\d+$"
BARE = r"^\d+\s*[a-z]{0,2}$"
SHORTHANDS = {"SM": "S", "MD": "M", "LG": "L", "2XL": "XXL", "XXXL": "3XL"}
SYSTEM_WORDS = ("us", "uk", "eu", "fr", "it")
BASE_SEQUENCE = ("XS", "S", "M", "L", "XL")


def is_alpha(normal: Column) -> Column:
    return normal.rlike(ALPHA)


def is_size(label: Column) -> Column:
    """Whether a raw label looks like a size."""


    def test(n: Column) -> Column:
        bare = n.rlike(BARE) & ~n.contains("cm")
        return (n != "") & (is_alpha(n) | n.rlike(NUMBER) | n.rlike(WAIST_INSEAM) | bare)

    # digits alone, as many labels are, stay as they are in token() form
    return label.rlike(r"^\d+\z") | let(token(label), test)


def fit_variant(text: Column) -> Column:
    """tall, petite, regular or standard; unknown without a word."""
    return let(
        token(text),
        lambda n: F.when(has_any(n, ["tall", "long"]), "tall")
        .when(has_any(n, ["petite"]), "petite")
        .when(has_any(n, ["regular"]), "regular")
        .when(n != "", "standard")
        .otherwise("unknown"),
    )


def row_variant(label: Column) -> Column:
    """fit_variant() of a row's label, where unknown counts as standard."""
    return let(fit_variant(label), lambda v: F.when(v == "unknown", "standard").otherwise(v))


def canonical(label: Column) -> Column:
    """A label in upper case without its variant word, shorthands written out."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(token(label), r"\b(?:tall|petite|regular|long|short)\b", ""), " +", " "))

    def written_out(upper: Column) -> Column:
        short = reduce(lambda c, kv: c.when(upper == kv[0], F.lit(kv[1])), SHORTHANDS.items(), F.when(F.lit(False), F.lit("")))
        return F.coalesce(short, F.when(upper != "", upper), F.upper(F.trim(label)))

    return let(F.upper(bare), written_out)


def explicit_system(label: Column) -> Column:
    """The first of the numeric systems that a label names, else null."""
    none = F.when(F.lit(False), F.lit(""))
    return let(token(label), lambda n: reduce(lambda c, w: c.when(has_any(n, [w]), F.lit(w.upper())), SYSTEM_WORDS, none))


def names_system(label: Column) -> Column:
    """Whether a raw label holds a system's name as a word."""
    return label.rlike(r"(?i)(?<![A-Za-z0-9_])(?:us|uk|eu|fr|it|int|international)(?![A-Za-z0-9_])")


def axis_system(labels: Column) -> Column:
    """The size system of an axis from its labels."""


    def of(own: Column) -> Column:
        def named(found: Column) -> Column:
            return F.when(F.size(found) == 1, F.get(found, F.lit(0)))

        return (
            F.when(F.size(own) == 0, "UNKNOWN")
            .when(F.exists(own, is_alpha), "INT")
            .when(F.exists(own, lambda x: x.rlike(WAIST_INSEAM)), "WAIST_INSEAM")
            .otherwise(
                F.coalesce(
                    let(F.array_distinct(F.filter(F.transform(own, explicit_system), lambda x: x.isNotNull())), named),
                    F.when(F.forall(own, lambda x: x.rlike(r"^\d{2,3}$")), "NUMERIC").otherwise("UNKNOWN"),
                )
            )
        )

    none = F.array().cast("array<string>")
    return let(F.filter(F.transform(F.coalesce(labels, none), token), lambda x: x != ""), of)


def table_system(axis: Column, headers: Column, stub: Column, context: Column) -> Column:
    """The size system of a table: axes first, then context words, then any label's system."""
    every = F.concat(headers, axis, stub)
    named = F.filter(F.transform(every, explicit_system), lambda x: x.isNotNull())

    def by_words(words: Column) -> Column:
        return F.when(has_any(words, ["footwear", "shoe size", "chaussure", "shoes"]), "FOOTWEAR").when(
            has_any(words, ["bra", "cup size"]), "BRA"
        )

    def of(systems: Column) -> Column:
        return F.coalesce(
            F.get(F.filter(systems, lambda x: ~x.isin("UNKNOWN", "NUMERIC")), F.lit(0)),
            F.when(F.array_contains(systems, "NUMERIC"), "NUMERIC"),
            let(token(F.concat_ws(" ", F.array_join(every, " "), context)), by_words),
            F.get(named, F.lit(0)),
            F.lit("UNKNOWN"),
        )

    return let(F.array(axis_system(axis), axis_system(headers)), of)


def sequence_gaps(labels: Column) -> Column:
    """Sizes missing between the smallest and the largest of XS to XL that labels (raw) hold."""
    return canonical_gaps(F.transform(labels, canonical))


def canonical_gaps(labels: Column) -> Column:
    """sequence_gaps() of labels in canonical() form."""
    base = F.array(*map(F.lit, BASE_SEQUENCE))

    def of(held: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.lit(len(BASE_SEQUENCE))), lambda i: F.array_contains(held, F.get(base, i - 1)))

        def between(at: Column) -> Column:
            low, high = F.array_min(at), F.array_max(at)
            return F.when(F.size(at) >= 2, F.array_except(F.slice(base, low, high - low + 1), held))

        return F.coalesce(let(at, between), F.array().cast("array<string>"))

    return let(labels, of)
