"""Measures: fields of headers, units, numbers, ranges, centimetres."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.text import BLANKS, let
from tablewright.domain import TOP_FIELDS

_W = "[A-Za-z0-9_]"  # ASCII word characters; \b of Java 17 takes accented letters too

# fixed values: words of each field in order of precedence, as substrings
FIELD_WORDS = {
    "chest": r"chest|bust|poitrine",
    "waist": rf"waist|taille(?!{_W})|tour de taille",
    "hips": r"hip|hanche",
    "inseam": r"inseam|inside leg|entrejambe",
    "outseam": r"outseam|outside leg",
    "height": r"height|stature|hauteur|taille corporelle|torso|body length|front length|back length|garment length",
    "sleeve": r"sleeve|manche",
    "neck": r"neck|collar|encolure|cou",
    "shoulder": r"shoulder|epaule|épaule",
    "footLength": r"foot length|length of foot|longueur du pied|pied",
    "footWidth": r"foot width|largeur du pied",
}
IN_CM = 2.54


def field_of(header: Column) -> Column:
    """The first field whose words a header holds, else null."""
    none = F.when(F.lit(False), F.lit(""))
    return let(
        header, lambda h: reduce(lambda c, kv: c.when(h.rlike(f"(?iu){kv[1]}"), F.lit(kv[0])), FIELD_WORDS.items(), none)
    )


def fields_of(labels: Column) -> Column:
    """The fields of labels, repeats included."""
    return F.filter(F.transform(labels, field_of), lambda x: x.isNotNull())


def unit_of(text: Column) -> Column:
    """cm, in, mixed or unknown."""


    def of(low: Column) -> Column:
        cm = low.rlike(f"(?<!{_W})(?:cm|centim)")
        inch = low.rlike(rf'(?<!{_W})inch(?:es)?(?!{_W})|\([{BLANKS}]*in[{BLANKS}]*\)|(?<!{_W})in\.|"')
        return F.when(cm & inch, "mixed").when(cm, "cm").when(inch, "in").otherwise("unknown")

    return let(F.lower(text), of)


def cell_unit(header: Column, raw: Column, table_unit: Column) -> Column:
    """The unit that header or cell names, else the table's inches, else cm."""
    return let(
        unit_of(F.concat_ws(" ", header, raw)),
        lambda own: F.when(own.isin("cm", "in"), own).when(table_unit == "in", "in").otherwise("cm"),
    )


def number(text: Column) -> Column:
    """The double of digits with a comma or point; null for an empty string."""
    return F.when(text != "", F.replace(text, F.lit(","), F.lit(".")).cast("double"))


def number_phrase(raw: Column) -> Column:
    """A mixed fraction, a fraction or the first decimal of a phrase; null without one."""
    bare = F.regexp_replace(raw, "[“”\"]", "")
    bare = F.regexp_replace(bare, f"(?i)(?<!{_W})(?:cm|centimeters?|centimetres?|in|inch|inches)(?!{_W})", "")
    bare = F.trim(F.regexp_replace(bare, f"[{BLANKS}]+", " "))

    mixed, part = r"^(-?\d+(?:[.,]\d+)?) (\d+)/(\d+)$", r"^(-?\d+)/(\d+)$"

    def of(bare: Column) -> Column:
        def group(pattern: str, n: int) -> Column:
            return number(F.regexp_extract(bare, pattern, n))

        return (
            F.when(group(mixed, 3) > 0, group(mixed, 1) + group(mixed, 2) / group(mixed, 3))
            .when(bare.rlike(part), F.when(group(part, 2) > 0, group(part, 1) / group(part, 2)))
            .otherwise(group(r"(-?\d+(?:[.,]\d+)?)", 1))
        )

    return let(bare, of)


def feet(raw: Column) -> Column:
    """Heights such as 5'7 in inches, in order."""
    token = r"(\d+)\s*'\s*(\d+(?:[.,]\d+)?)?"
    whole = F.regexp_extract_all(raw, F.lit(token), F.lit(1))
    rest = F.regexp_extract_all(raw, F.lit(token), F.lit(2))
    return F.zip_with(whole, rest, lambda a, b: number(a) * 12 + F.coalesce(number(b), F.lit(0.0)))


def value_range(raw: Column) -> Column:
    """struct(low, high) of a number or a range in its own unit; null without a number."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, "[“”\"]", ""), f"[{BLANKS}]+", " "))
    cut = rf"(?i) *(?:-|–|—|(?<!{_W})to(?!{_W})|(?<={_W})à(?={_W})|(?<!{_W})a(?!{_W})) *"

    def pair(ends: Column) -> Column:
        return F.when(
            F.size(ends) > 0, F.struct(F.array_min(F.slice(ends, 1, 2)).alias("low"), F.array_max(F.slice(ends, 1, 2)).alias("high"))
        )

    def read(phrases: Column) -> Column:
        ends = F.transform(F.slice(phrases, 1, 2), number_phrase)
        return let(ends, lambda e: F.when((F.size(e) == 2) & F.forall(e, lambda x: x.isNotNull()), pair(e)))

    def of(bare: Column) -> Column:
        one = F.filter(F.array(number_phrase(bare)), lambda x: x.isNotNull())
        # a number alone, as most cells are, needs none of the other forms
        return F.when(bare.rlike(r"^\d+(?:[.,]\d+)?$"), pair(F.array(number(bare)))).otherwise(
            F.coalesce(let(feet(raw), pair), let(F.filter(F.split(bare, cut), lambda x: x != ""), read), let(one, pair))
        )

    return let(bare, of)


def to_cm(value: Column, unit: Column) -> Column:
    """Centimetres, rounded half up to a tenth."""
    return F.floor(F.when(unit == "in", value * F.lit(IN_CM)).otherwise(value) * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)


def range_cm(raw: Column, unit: Column) -> Column:
    """value_range() in centimetres."""

    def of(r: Column) -> Column:
        return F.when(
            r["range"].isNotNull(),
            F.struct(to_cm(r["range"]["low"], r["unit"]).alias("low"), to_cm(r["range"]["high"], r["unit"]).alias("high")),
        )

    return let(F.struct(value_range(raw).alias("range"), unit.alias("unit")), of)


def numbers(text: Column) -> Column:
    """All unsigned numbers of a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)), number)


def upper_median(values: Column) -> Column:
    """The element at half the size of an array, rounded down, in sorted order."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def in_range(value: Column) -> Column:
    """Whether a number may be a body measure in either unit."""
    return (value >= 10) & (value <= 260)


def unit_by_size(count: Column, top: Column, mid: Column) -> Column:
    """cm or in from the greatest and the upper median of body measures; unknown from fewer than two of them."""
    return (
        F.when(count < 2, "unknown").when((top <= 80) & (mid < 60), "in").when((top >= 80) | (mid >= 65), "cm").otherwise("unknown")
    )


def unit_of_values(values: Column) -> Column:
    """unit_by_size() of the body measures in an array."""
    return let(F.filter(values, in_range), lambda own: unit_by_size(F.size(own), F.array_max(own), upper_median(own)))


def implicit_unit(matrix: Column, fields: Column) -> Column:
    """unit_of_values() of a matrix that has a field of the upper body."""
    apt = F.arrays_overlap(fields, F.array(*map(F.lit, TOP_FIELDS)))
    return F.when(apt, unit_of_values(F.flatten(F.transform(F.flatten(matrix), numbers)))).otherwise("unknown")


def table_unit(matrix_unit: Column, context_unit: Column, implicit: Column) -> Column:
    """The matrix's own unit; inches of the values over centimetres of the context; context; values."""
    return (
        F.when(matrix_unit != "unknown", matrix_unit)
        .when((context_unit == "cm") & (implicit == "in"), "in")
        .when(context_unit != "unknown", context_unit)
        .otherwise(implicit)
    )


def shown_range(low: Column, high: Column) -> Column:
    """A range for display."""

    def plain(x: Column) -> Column:
        return F.regexp_replace(x.cast("string"), r"\.0$", "")

    return (
        F.when(low.isNull() & high.isNull(), "—")
        .when(low.isNull(), plain(high))
        .when(high.isNull() | (low == high), plain(low))
        .otherwise(F.concat(plain(low), F.lit("–"), plain(high)))
    )


def round_half_up(value: Column, places: int) -> Column:
    """floor(x * 10**places + 0.5) / 10**places."""
    by = float(10**places)
    return F.floor(value * F.lit(by) + F.lit(0.5)) / F.lit(by)


def mm(value: Column) -> Column:
    """Whole millimetres of centimetres."""
    return F.floor(value * F.lit(10.0) + F.lit(0.5)).cast("double")
