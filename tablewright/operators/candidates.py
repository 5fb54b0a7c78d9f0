"""Candidates: what a discovered table is, its confidence, and which of equal tables stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions import categories, sizes, units
from tablewright.functions.text import joined
from tablewright.operators.matrix import normal, with_axes
from tablewright.sources.shared import dealt

_EMPTY = ("title", "subheading", "nearby")


def describe(tables: DataFrame) -> DataFrame:
    """Adds to raw tables all that is known of them before a request is seen.

    Needs kind, matrix, heading_path, title, subheading, nearby. Adds headers, stub,
    size_axis, orientation, fields, unit, category, family, rule, mapping, audience,
    variant, size_system, tabular and base_confidence (without the navigation's part).
    Tables without two rows in normal form are left out. Tables are dealt to all tasks
    first, as their rules cost far more than to ship them.
    """
    df = dealt(tables).withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in _EMPTY})
    df = df.withColumn("heading_path", F.coalesce("heading_path", F.array().cast("array<string>")))
    df = with_axes(df.withColumn("matrix", normal(F.col("matrix"))).where(F.size("matrix") >= 2))
    headers, stub, axis, fields = map(F.col, ("headers", "stub", "size_axis", "fields"))
    path = F.array_join("heading_path", " ")
    df = df.withColumn("fields", units.fields_of(F.concat(headers, stub, axis)))
    df = df.withColumn("context", joined(F.col("title"), F.col("subheading"), path, F.col("nearby"), headers, stub))
    own_unit = units.unit_of(joined(headers, stub, axis, F.flatten("matrix")))
    df = df.withColumn(
        "unit", units.table_unit(own_unit, units.unit_of(F.col("context")), units.implicit_unit(F.col("matrix"), fields))
    )
    section = joined(F.col("title"), F.col("subheading"), headers)
    df = df.withColumn(
        "_rule", categories.section_rule(section, joined(section, stub, axis, F.col("nearby")), F.array_distinct(fields))
    ).withColumns({name: F.col(f"_rule.{name}") for name in ("category", "family", "rule")})
    label = F.when(F.col("title") != "", F.col("title")).otherwise(
        F.when(F.col("category") == "generic-body-guide", "generic body guide").otherwise(F.col("category"))
    )
    df = df.withColumn("category_label", label).withColumn(
        "mapping",
        categories.mapping_mode(
            F.col("category"), joined(F.col("category_label"), F.col("title"), F.col("subheading"), F.col("nearby")), fields
        ),
    )
    tabular = F.col("kind") != "advisory-text"
    confidence = (
        F.lit(0.16)
        + F.when(F.size(fields) > 0, 0.2).otherwise(0.0)
        + F.least(F.size(axis), F.lit(10)) * 0.05
        - F.when(tabular, 0.0).otherwise(0.2)
        + F.when(F.col("orientation") != "unknown", 0.18).otherwise(0.0)
        + F.when(F.col("category") != "unknown", 0.12).otherwise(0.0)
    )
    return df.withColumns(
        {
            "tabular": tabular,
            "audience": categories.audience_of(F.col("context")),
            "variant": sizes.fit_variant(F.col("context")),
            "size_system": sizes.table_system(axis, headers, stub, F.col("context")),
            "base_confidence": confidence,
        }
    ).drop("_rule")


def evidence(df: DataFrame) -> DataFrame:
    """Adds the snippet that shows what a candidate was recognised by, 600 characters at most."""

    def shown(name: str, labels: str, most: int):
        return F.when(F.size(labels) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(labels, 1, most), ", ")))

    parts = F.array_compact(
        F.array(
            F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("subheading"), F.lit("")), shown("Headers", "headers", 1000),
            shown("Stub", "stub", 8), shown("Sizes", "size_axis", 12), F.nullif(F.col("nearby"), F.lit("")),
        )
    )
    return df.withColumn("evidence", F.substring(F.array_join(parts, " | "), 1, 600))


def confidence(base, navigation):
    """base_confidence with the navigation's part, between 0.08 and 0.99."""
    part = F.when(navigation > 0, F.least(F.lit(0.1), navigation / 4)).otherwise(0.0)
    return F.greatest(F.lit(0.08), F.least(F.lit(0.99), base + part))


def numbered(df: DataFrame, key: list[str], ord_col: str, out: str, width: int | None = None) -> DataFrame:
    """Adds out, a row's place from 0 within key by ord_col.

    With width, the rows of each stretch of that many whole numbers of ord_col are counted
    first and ranked only among themselves, so that a key with most of the rows spreads
    over many tasks.
    """
    if width is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(ord_col)) - 1)
    rows = df.withColumn("_stretch", F.floor(F.col(ord_col) / width))
    own = [F.col(k).alias(f"_{i}") for i, k in enumerate(key)]
    before = Window.partitionBy(*[f"_{i}" for i in range(len(key))]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*own, F.col("_stretch").alias("_at")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = F.col("_stretch").eqNullSafe(F.col("_at"))
    for i, k in enumerate(key):
        same &= F.col(k).eqNullSafe(F.col(f"_{i}"))
    inside = F.row_number().over(Window.partitionBy(*key, "_stretch").orderBy(ord_col)) - 1
    placed = rows.join(counts, same).withColumn(out, (F.col("_ahead") + inside).cast("int"))
    return placed.drop("_stretch", "_at", "_ahead", *[f"_{i}" for i in range(len(key))])


def dedupe(
    df: DataFrame, key: list[str], signature: list[str], score: str, ord_col: str = "ord", width: int | None = None
) -> DataFrame:
    """One row for each signature within key: the first of the highest score, at the first one's place.

    Adds new_ord from 0. Equal rows meet by an aggregation, so copies are reduced before
    they are shuffled; width is that of numbered().
    """
    others = [c for c in df.columns if c not in (*key, *signature)]
    best = F.max_by(F.struct(*others), F.struct(F.col(score), -F.col(ord_col)))
    once = df.groupBy(*key, *signature).agg(best.alias("_best"), F.min(ord_col).alias("_first"))
    once = once.select(*key, *signature, "_best.*", "_first")
    return numbered(once, key, "_first", "new_ord", width).select(*df.columns, "new_ord")


SIGNATURE = ["title", "orientation", "headers", "stub", "size_axis"]
