"""What is asked of another extraction, and what it answered: an outbox and an inbox by key.

A key stands for a section and the fields that may be read from it, so equal sections are
asked once, whichever requests need them, and a rerun asks nothing that was answered.
The engine calls nothing itself: pending() is the outbox to be worked off, and an inbox is
a table (key, status, message, warnings, row_ord, label, <field>_low, <field>_high), a row
for each size of an answer with status ok, one row for any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.domain import BOTTOM_CATEGORIES, BOTTOM_FIELDS, FIELDS, SHOE_FIELDS, TOP_FIELDS
from tablewright.operators import validate

BODY_FIELDS = tuple(f for f in FIELDS if f not in SHOE_FIELDS)
INBOX = "key string, status string, message string, warnings array<string>, row_ord int, label string, " + ", ".join(
    f"{f}_{end} double" for f in FIELDS for end in ("low", "high")
)
SECTION = ["title", "subheading", "heading_path", "orientation", "headers", "stub", "size_axis", "matrix"]


def allowed(category: Column) -> Column:
    """The fields that an extraction for a requested category may give."""
    fields = lambda names: F.array(*map(F.lit, names))
    return (
        F.when(category == "shoes", fields(SHOE_FIELDS)).when(category == "generic-body-guide", fields(BODY_FIELDS))
        .when(category.isin(*BOTTOM_CATEGORIES), fields(BOTTOM_FIELDS)).otherwise(fields(TOP_FIELDS))
    )


def asks(validated: DataFrame, by: list[str]) -> DataFrame:
    """by, external_key, external_fields and external_section (JSON) of candidates that aren't ready and may be extracted elsewhere."""
    ready = validate.is_ready(F.col("status"), F.col("resolved_category"), F.col("resolved_system"))
    open_ = validated.where(~ready & validate.may_extract_elsewhere(F.col("issues")))
    section = F.to_json(F.struct(*SECTION, "asked_category", "asked_system"), {"ignoreNullFields": "false"})
    open_ = open_.select(*by, allowed(F.col("asked_category")).alias("external_fields"), section.alias("external_section"))
    return open_.withColumn("external_key", F.sha2(F.concat_ws("|", F.array_join("external_fields", ","), "external_section"), 256))


def pending(asked: DataFrame, inbox: DataFrame) -> DataFrame:
    """key, fields and section of what was asked and has no answer, each once."""
    open_ = asked.where("external_key IS NOT NULL").groupBy(F.col("external_key").alias("key")).agg(
        F.first("external_fields").alias("fields"), F.first("external_section").alias("section")
    )
    return open_.join(inbox.select("key").distinct(), "key", "left_anti")


def answers(asked: DataFrame, inbox: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, outcomes) of asks: the answered rows with nothing but allowed fields, and by, external_outcome and external_message.

    The outcome is rows, no-rows (the section wasn't found, or had none), error or pending.
    """
    met = asked.select(*by, F.col("external_key").alias("key"), "external_fields").join(inbox.where("status = 'ok' AND label IS NOT NULL"), "key")
    kept = {f"{f}_{end}": F.when(F.array_contains("external_fields", f), F.col(f"{f}_{end}")) for f in FIELDS for end in ("low", "high")}
    rows = met.select(*by, "row_ord", "label", "warnings", *[c.alias(n) for n, c in kept.items()])
    state = inbox.groupBy(F.col("key").alias("_key")).agg(
        F.count_if((F.col("status") == "ok") & F.col("label").isNotNull()).alias("_n"), F.bool_or(F.col("status") == "error").alias("_bad"), F.min("message").alias("external_message")
    )
    outcome = F.when(F.col("_key").isNull(), "pending").when(F.col("_n") > 0, "rows").when(F.col("_bad"), "error").otherwise("no-rows")
    outcomes = asked.join(state, F.col("external_key") == F.col("_key"), "left").withColumn("external_outcome", outcome)
    return rows, outcomes.select(*by, "external_key", "external_fields", "external_section", "external_outcome", "external_message")
