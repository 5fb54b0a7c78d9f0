"""Candidate selection: hard rejections, score, and the best candidate of each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.domain import TOP_FIELDS
from tablewright.functions import categories, units
from tablewright.functions.text import has_any, joined, token

#: Least score of a selected candidate, and systems that can stand for INT.
LEAST = 4.0
FOR_INT = ("INT", "US", "EU", "UK", "FR", "IT", "NUMERIC")
LETTERLESS = ("INT", "WAIST_INSEAM", "FOOTWEAR", "SOCK", "BRA")
INSEAM_WORDS = ("inseam", "inside leg", "entrejambe")
BODY_BLOCKERS = (*INSEAM_WORDS, "outseam", "foot length", "foot width", "shoe size", "footwear", "chaussure")


def _has(fields: Column, *names: str) -> Column:
    return F.arrays_overlap(fields, F.array(*map(F.lit, names)))


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in order."""
    none = F.lit(None).cast("string")
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)).otherwise(none) for c, n in rules]))


def score(df: DataFrame) -> DataFrame:
    """Adds all_fields, strict (names of hard rejections), reasons, rejections and score.

    Needs described candidates with asked_category, asked_system, document_kind,
    confidence and navigation.
    """
    every = F.concat(F.col("headers"), F.col("stub"), F.col("size_axis"), F.flatten("matrix"))
    df = df.withColumn("all_fields", F.array_distinct(units.fields_of(every))).withColumn(
        "_text",
        token(joined(F.col("title"), F.col("subheading"), F.array_join("heading_path", " "), F.col("nearby"), F.col("headers"), F.col("stub"), F.flatten("matrix"))),
    )
    asked, found, fields = F.col("asked_category"), F.col("category"), F.col("all_fields")
    system, own = F.col("asked_system"), F.col("size_system")
    mode = categories.match_mode(asked, found)
    tshirts = F.coalesce(asked == "tshirts", F.lit(False))
    body = (
        (found == "generic-body-guide")
        & _has(fields, "chest", "height")
        & F.forall(fields, lambda f: f.isin(*TOP_FIELDS))
        & ~has_any(F.col("_text"), BODY_BLOCKERS)
    )
    bad_system = F.when(system == "INT", ~own.isin(*FOR_INT)).otherwise(
        system.isNotNull() & (own != system) & ~own.isin("UNKNOWN", "NUMERIC")
    )
    strict = reasons(
        (F.col("document_kind") == "guide-hub-page", "hub-page"),
        (~F.col("tabular"), "not-tabular"),
        (F.size("size_axis") < 2, "too-few-sizes"),
        (F.size(fields) < 2, "too-few-fields"),
        (F.col("orientation").isin("unknown", "conversion-grid"), "orientation"),
        (bad_system, "size-system-not-compatible"),
        (tshirts & ~body & ((mode == "none") | ~found.isin("tshirts", *categories.SERVES_TSHIRTS)), "category-not-tops"),
        (tshirts & ~_has(fields, "chest", "height"), "no-chest"),
        (tshirts & (_has(fields, "inseam") | has_any(F.col("_text"), INSEAM_WORDS)), "inseam"),
        (tshirts & (_has(fields, "footLength", "footWidth") | has_any(F.col("_text"), ("shoe size", "footwear", "foot length", "chaussure"))), "footwear"),
    )
    any_category = asked.isNull()
    by_category = (
        F.when(any_category & (mode != "none"), 3.0)
        .when(any_category, -1.0)
        .when(mode == "exact", 6.0)
        .when(mode == "curated", 4.5)
        .when(mode == "generic-body", 5.0)
        .when(tshirts & body, 4.0)
        .when(found == "generic-body-guide", -3.0)
        .when(found.isin("tops", "bottoms"), 0.5)
        .otherwise(-4.0)
    )
    for_int = (system == "INT") & own.isin(*FOR_INT)
    numeric = (own == "NUMERIC") & ~system.isin(*LETTERLESS)
    by_system = (
        F.when(system.isNull() & ~own.isin("UNKNOWN", "NUMERIC"), 2.0)
        .when(system.isNull(), 0.0)
        .when(own == system, 4.0)
        .when(for_int, 2.5)
        .when(numeric, 1.5)
        .when(own == "UNKNOWN", -0.5)
        .otherwise(-3.0)
    )
    by_orientation = F.when(F.col("orientation").isin("size-rows", "size-columns"), 1.5).otherwise(-1.0)
    by_unit = F.when(F.col("unit") == "cm", 1.2).when(F.col("unit") == "in", 0.4).when(F.col("unit") == "mixed", -0.4).otherwise(0.0)
    total = (
        by_category + by_system + by_orientation + by_unit
        + F.when(F.col("tabular"), 2.0).otherwise(-2.0)
        + F.least(F.size("size_axis"), F.lit(10)) * 0.15
        + F.col("confidence") * 2
        + F.least(F.lit(0.5), F.col("navigation"))
    )
    df = df.withColumn("strict", strict)
    return df.withColumns(
        {
            "score": units.round_half_up(F.when(F.size("strict") > 0, -20.0 - F.size("strict")).otherwise(total), 2),
            "reasons": reasons(
                (by_category >= 3, "category"), (by_system > 0, "size-system"), (by_orientation > 0, "orientation"),
                (by_unit > 0, "unit"), (tshirts & body, "body-for-tops"),
            ),
            "rejections": F.concat(
                F.col("strict"),
                reasons(
                    (by_category < 3, "category"), (by_system <= 0, "size-system"), (by_orientation < 0, "orientation"),
                ),
            ),
        }
    ).drop("_text")


def same_shape(a: str, b: str) -> Column:
    """Whether two candidates (struct columns) measure the same, one in cm and one in inches."""
    def of(name: str, key: str) -> Column:
        return F.col(f"{name}.{key}")

    alike = [of(a, k) == of(b, k) for k in ("category", "family", "orientation")]
    alike.append(F.array_sort(of(a, "all_fields")) == F.array_sort(of(b, "all_fields")))
    alike.append(F.transform(of(a, "size_axis"), token) == F.transform(of(b, "size_axis"), token))
    units_differ = of(a, "unit").isin("cm", "in") & of(b, "unit").isin("cm", "in") & (of(a, "unit") != of(b, "unit"))
    out = units_differ
    for x in alike:
        out = out & x
    return out


def pick(df: DataFrame, key: list[str], ord_col: str = "ord") -> DataFrame:
    """Adds rank, gap (to the next score), unit_twin (the next is the same table in the
    other unit) and selected: the first of the highest scores, if that is high enough
    and the candidate is a table that can be read."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), ord_col)
    shape = F.struct("category", "family", "orientation", "all_fields", "size_axis", "unit")
    df = df.withColumns(
        {"rank": F.row_number().over(order), "_own": shape, "_next": F.lead(shape).over(order), "gap": F.col("score") - F.lead("score").over(order)}
    )
    fits = (F.col("rank") == 1) & (F.col("score") >= LEAST) & F.col("tabular") & (F.col("orientation") != "conversion-grid")
    return df.withColumn("unit_twin", F.coalesce(same_shape("_own", "_next"), F.lit(False))).withColumn("selected", fits).drop("_own", "_next")
