"""Exports: strict rows, import payloads, file names, run status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tablewright.domain import FIELDS
from tablewright.functions.text import slug
from tablewright.functions.units import mm, round_half_up, shown_range

# fixed values: names of the import schema
CATEGORY_NAMES = {
    "tshirts": "tshirt", "shirts": "chemise", "hoodies": "hoodie", "jackets": "veste_legere", "pants": "pantalon",
    "jeans": "jean", "shorts": "short", "shoes": "socks", "generic-body-guide": "tshirt",
}
DIMENSIONS = (("chest", "chestCm"), ("waist", "waistCm"), ("hips", "seatHipsCm"), ("height", "heightCm"), ("footLength", "footLengthMm"))
IGNORED = ("inseam", "outseam", "neck", "shoulder", "sleeve", "footWidth")


def export_category(category: Column) -> Column:
    """The import schema's category, tshirt for those it lacks."""
    return reduce(lambda c, kv: c.when(category == kv[0], F.lit(kv[1])), CATEGORY_NAMES.items(), F.when(F.lit(False), F.lit(""))).otherwise("tshirt")


def export_system(system: Column) -> Column:
    return F.when(system == "BRA", "INT").otherwise(system)


def scalar(low: Column, high: Column) -> Column:
    """The upper end of a range, the lower one where that is all there is."""
    return F.coalesce(high, low)


def falls_back(category: Column) -> Column:
    """Whether the import schema lacks a category."""
    return ~category.isin(*CATEGORY_NAMES)


def strict_rows(wide: DataFrame) -> DataFrame:
    """Adds strict: struct(label, chest_cm, waist_cm) of the narrow export."""
    return wide.withColumn(
        "strict",
        F.struct(
            F.col("canonical").alias("label"),
            scalar(F.col("chest_low"), F.col("chest_high")).alias("chest_cm"),
            scalar(F.col("waist_low"), F.col("waist_high")).alias("waist_cm"),
        ),
    )


def strict_error(category: Column, system: Column) -> Column:
    """The narrow export serves tshirts in INT only."""
    return F.when(~((category == "tshirts") & (system == "INT")), "only-tshirts-in-int")


def dimensions(low_high: dict[str, tuple[Column, Column]], note: Column) -> Column:
    """map of dimension to struct(min, max, target, unit, sourceNote), without absent ones."""
    kind = "map<string,struct<min:double,max:double,target:double,unit:string,sourceNote:string>>"
    entries = []
    for field, name in DIMENSIONS:
        low, high = low_high[field]
        if name.endswith("Mm"):
            low, high = mm(low), mm(high)
        value = F.struct(low.alias("min"), high.alias("max"), F.lit(None).cast("double").alias("target"), F.lit(name[-2:].lower()).alias("unit"), note.alias("sourceNote"))
        entries.append(F.when(low.isNotNull() | high.isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries))).cast(kind)


def import_rows(wide: DataFrame, url: str = "source_url") -> DataFrame:
    """Adds dimensions, ignored (fields that the schema lacks) and notes."""
    ends = {f: (F.col(f"{f}_low"), F.col(f"{f}_high")) for f, _ in DIMENSIONS}
    ignored = F.array_compact(F.array(*[F.when(F.col(f"{f}_low").isNotNull() | F.col(f"{f}_high").isNotNull(), F.lit(f)) for f in IGNORED]))
    notes = F.concat_ws(
        " ",
        F.when(F.col("variant") != "standard", F.concat(F.lit("Variant: "), F.col("variant"), F.lit("."))),
        F.when(F.col("label") != F.col("canonical"), F.concat(F.lit("Source label: "), F.col("label"), F.lit("."))),
    )
    return wide.withColumns({"dimensions": dimensions(ends, F.col(url)), "ignored": ignored, "notes": notes})


def is_complete(rows: Column) -> Column:
    """Whether there are rows and each has two dimensions (rows: array of maps)."""
    return (F.size(rows) > 0) & F.forall(rows, lambda d: F.size(d) >= 2)


def uncertainty(confidence: Column) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), 1 - confidence))


def extraction_confidence(confidence: Column, rows: Column) -> Column:
    return F.when(rows > 0, F.least(F.lit(0.99), confidence + rows * 0.02)).otherwise(F.lit(0.1))


#: How rows of a candidate's kind are read.
STRATEGIES = {
    "html-table": "table", "aria-grid": "aria-grid", "markdown-table": "markdown-table", "markdown-grid": "markdown-table", "div-grid": "table",
}


def strategy(kind: Column) -> Column:
    """The extraction of a candidate's kind, none for texts."""
    return reduce(lambda c, kv: c.when(kind == kv[0], F.lit(kv[1])), STRATEGIES.items(), F.when(F.lit(False), F.lit(""))).otherwise("none")


def visible_fields(sizes: DataFrame, key: list[str]) -> DataFrame:
    """key and visible: the fields that have a value in any of a guide's sizes, in their usual order."""
    shown = [F.when(F.count(F.coalesce(f"{f}_low", f"{f}_high")) > 0, F.lit(f)) for f in FIELDS]
    return sizes.groupBy(*key).agg(F.array_compact(F.array(*shown)).alias("visible"))


def summary(has_guide: Column, title: Column, status: Column, external: Column, issue_codes: Column, rejections: Column) -> Column:
    """One line on a finished request: its guide, else its first issue, else why its candidate was passed over."""
    guide = F.concat(F.coalesce(title, F.lit("")), F.lit(" · "), status, F.when(external, F.lit(" · external rows")).otherwise(""))
    return F.when(has_guide, guide).otherwise(
        F.coalesce(F.get(issue_codes, F.lit(0)), F.get(rejections, F.lit(0)), F.lit("no-validated-guide"))
    )


def external_confidence(rows: Column) -> Column:
    return F.least(F.lit(0.8), rows * 0.05 + 0.3)


def strict_confidence(confidence: Column) -> Column:
    return round_half_up(confidence, 2)


def file_name(brand: Column, category: Column, system: Column, suffix: str = "") -> Column:
    return F.concat(F.concat_ws("_", slug(brand), slug(category), slug(system)), F.lit(f"{suffix}.json"))


def run_status(has_guide: Column, issue_codes: Column, review: Column) -> Column:
    """done, error or review of a finished request."""
    return (
        F.when(has_guide, "done").when(F.array_contains(issue_codes, "server-error"), "error").when(review, "review").otherwise("error")
    )


def status_counts(results: DataFrame, status: str = "run_status") -> DataFrame:
    """One row: accepted, review, error and waiting requests."""
    s = F.col(status)
    return results.agg(
        F.count_if(s == "done").alias("accepted"), F.count_if(s == "review").alias("review"),
        F.count_if(s == "error").alias("error"), F.count_if(s.isin("pending", "running")).alias("waiting"),
    )


def observed(results: DataFrame, status: str = "run_status") -> tuple[DataFrame, Observation]:
    """results, and status_counts() of them that come by the way when they are written or collected."""
    s, seen = F.col(status), Observation("runs")
    return results.observe(
        seen, F.count_if(s == "done").alias("accepted"), F.count_if(s == "review").alias("review"),
        F.count_if(s == "error").alias("error"), F.count_if(s.isin("pending", "running")).alias("waiting"),
    ), seen


def status_rollup(results: DataFrame, brand: str = "brand", system: str = "size_system", status: str = "run_status") -> DataFrame:
    """requests by brand, system and status with the totals of each, of both and of all, in one pass.

    level tells which columns a total leaves out (a bit each: 4 brand, 2 system, 1 status),
    so that a null of the data isn't taken for one.
    """
    b, y, s = (F.col(c) for c in (brand, system, status))
    return results.groupingSets([[b, y, s], [b, s], [y, s], [s], []], b, y, s).agg(F.count("*").alias("requests"), F.grouping_id().alias("level"))


def shown_rows(wide: DataFrame) -> DataFrame:
    """Adds shown to wide sizes: field and text of each measure that the size has, as a reader is shown it."""
    ends = [(f, F.col(f"{f}_low"), F.col(f"{f}_high")) for f in FIELDS]
    cells = [F.when(low.isNotNull() | high.isNotNull(), F.struct(F.lit(f).alias("field"), shown_range(low, high).alias("text"))) for f, low, high in ends]
    return wide.withColumn("shown", F.array_compact(F.array(*cells)))
