"""Constraint validation: typed issues, status, and what a selected candidate resolves to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.domain import BOTTOM_CATEGORIES, BOTTOM_FIELDS, FIELDS, SHOE_FIELDS, TOP_CATEGORIES, TOP_FIELDS
from tablewright.functions import categories, sizes
from tablewright.functions.text import let

ISSUE = "struct<code:string,severity:string,details:array<string>>"

#: Codes that make a failed result ambiguous, and those after which no other extraction is tried.
AMBIGUOUS = ("ambiguous-category", "low-navigation-confidence")
BLOCKERS = (
    "fused-top-bottom-evidence", "top-incompatible-fields", "top-has-inseam", "bottom-incompatible-fields",
    "bottom-has-chest", "shoe-incompatible-fields", "wrong-source-family", "repair_candidate_wrong_audience",
)
CONFIDENT = 0.55


def issue(when: Column, code: str, severity: str = "error", details: Column | None = None) -> Column:
    """The issue where when holds, else null."""
    none = F.array().cast("array<string>")
    made = F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (none if details is None else details).alias("details"))
    return F.when(F.coalesce(when, F.lit(False)), made.cast(ISSUE))


def issues(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def request_issues(category: Column, system: Column, audience: Column) -> Column:
    """Issues of a request whose texts stand for nothing known."""

    def unmapped(raw: Column, mapped: Column) -> Column:
        return raw.isNotNull() & (raw != "") & mapped.isNull()

    return issues(
        issue(unmapped(category, categories.asked_category(category)), "invalid-requested-category", details=F.array(category)),
        issue(unmapped(system, categories.asked_system(system)), "invalid-requested-size-system", details=F.array(system)),
        issue(unmapped(audience, categories.asked_audience(audience)), "invalid-requested-audience", details=F.array(audience)),
    )


def audience_fits(asked: Column, own: Column) -> Column:
    return asked.isNull() | own.isin("unknown", "unisex") | (asked == "unisex") | (asked == own)


def validate(df: DataFrame) -> DataFrame:
    """Adds present, resolved_category, resolved_system, issues and status.

    Needs a candidate's columns, its request's asked_category, asked_system and
    asked_audience, link_followed (boolean), navigation, and rows: the extracted sizes
    as array<struct<label, fields>>.
    """
    labels = F.transform("rows", lambda r: r["label"])
    held = F.array_distinct(F.flatten(F.transform("rows", lambda r: r["fields"])))
    df = df.withColumn("present", F.array_intersect(F.array(*map(F.lit, FIELDS)), held))
    present, asked, found = F.col("present"), F.col("asked_category"), F.col("category")

    def has(name: str) -> Column:
        return F.array_contains(present, name)

    def beyond(allowed: tuple[str, ...]) -> Column:
        return F.array_except(present, F.array(*map(F.lit, allowed)))

    anchored = asked.isin(*TOP_CATEGORIES) & (found == "generic-body-guide") & (has("chest") | has("height"))
    body = anchored & (F.size(beyond(TOP_FIELDS)) == 0)
    system, own = F.col("asked_system"), F.col("size_system")
    df = df.withColumn("resolved_category", F.coalesce(categories.matched_category(asked, found), F.when(body, asked)))
    df = df.withColumn(
        "resolved_system",
        F.when(system.isNotNull(), F.when(own == system, system)).otherwise(F.when(~own.isin("UNKNOWN", "NUMERIC"), own)),
    )
    visible = F.col("size_axis")
    # every label's canonical form once, not once for each that it is held against
    both = F.struct(
        visible.alias("visible"), F.transform(visible, sizes.canonical).alias("seen"), labels.alias("labels"), F.transform(labels, sizes.canonical).alias("got")
    )

    def held_against(b: Column) -> Column:
        return F.struct(
            sizes.canonical_gaps(b["got"]).alias("gaps"),
            F.filter(b["labels"], lambda _, i: ~F.array_contains(b["seen"], F.get(b["got"], i))).alias("extra"),
            F.filter(b["visible"], lambda _, i: ~F.array_contains(b["got"], F.get(b["seen"], i))).alias("missing"),
        )

    df = df.withColumn("_labels", let(both, held_against))
    df = df.withColumns({f"_{name}": F.col(f"_labels.{name}") for name in ("gaps", "extra", "missing")}).drop("_labels")
    n, m = F.size(visible), F.size("rows")
    lost = (n >= 4) & (m < F.ceil(n * 0.75))
    some = F.size("_missing") > 0
    variants = F.filter("_missing", lambda x: x.rlike(r"(?i)(?<![A-Za-z0-9_])(?:tall|petite|short|long)(?![A-Za-z0-9_])"))
    final = F.col("resolved_category")
    top, bottom = final.isin(*TOP_CATEGORIES), final.isin(*BOTTOM_CATEGORIES)
    made = issues(
        issue(final.isNull() & asked.isNotNull(), "ambiguous-category"),
        issue(final.isNull() & asked.isNull(), "missing-category"),
        issue(system.isNotNull() & (own != system), "size-system-mismatch", details=F.array(own, system)),
        issue(system.isNull() & own.isin("UNKNOWN", "NUMERIC"), "missing-size-system"),
        issue(~audience_fits(F.col("asked_audience"), F.col("audience")), "repair_candidate_wrong_audience", details=F.array("audience")),
        issue(F.col("document_kind") == "guide-hub-page", "guide-hub-selected"),
        issue(F.col("unit") == "unknown", "unknown-units"),
        issue(F.col("link_followed") & (F.col("navigation") < CONFIDENT), "low-navigation-confidence"),
        issue(~F.col("tabular"), "advisory-text"),
        issue(m == 0, "empty-extraction"),
        issue(F.size("_gaps") > 0, "missing-size-sequence", details=F.col("_gaps")),
        issue(F.size("_extra") > 0, "invented-row-labels", details=F.col("_extra")),
        issue(some & lost, "size-breadth-loss", details=F.col("_missing")),
        issue(some & ~lost, "size-breadth-warning", "warning", F.col("_missing")),
        issue(F.size(variants) > 0, "fit-variant-loss", details=variants),
        issue(has("chest") & has("inseam"), "fused-top-bottom-evidence"),
        issue(top & (F.size(beyond(TOP_FIELDS)) > 0), "top-incompatible-fields", details=beyond(TOP_FIELDS)),
        issue(top & has("inseam"), "top-has-inseam"),
        issue(top & ~has("chest") & ~has("height"), "top-missing-chest"),
        issue(top & (found == "shoes"), "wrong-source-family"),
        issue(bottom & (F.size(beyond(BOTTOM_FIELDS)) > 0), "bottom-incompatible-fields", details=beyond(BOTTOM_FIELDS)),
        issue(bottom & has("chest"), "bottom-has-chest"),
        issue((final == "shoes") & (F.size(beyond(SHOE_FIELDS)) > 0), "shoe-incompatible-fields", details=beyond(SHOE_FIELDS)),
        issue((final == "generic-body-guide") & (found != "generic-body-guide"), "generic-body-guide-labeling"),
        issue(F.size(present) == 0, "no-compatible-fields"),
        issue((m == 0) & F.col("tabular"), "deterministic-extraction-only", "warning"),
    )
    return df.withColumn("issues", made).withColumn("status", status(F.col("issues"))).drop("_gaps", "_extra", "_missing")


def status(found: Column) -> Column:
    """accepted without issues, warning with warnings alone, else ambiguous or rejected."""
    errors = F.filter(found, lambda x: x["severity"] == "error")
    return (
        F.when(F.exists(errors, lambda x: x["code"].isin(*AMBIGUOUS)), "ambiguous")
        .when(F.size(errors) > 0, "rejected")
        .when(F.size(found) > 0, "warning")
        .otherwise("accepted")
    )


def codes(found: Column) -> Column:
    return F.transform(found, lambda x: x["code"])


def is_ready(df_status: Column, category: Column, system: Column) -> Column:
    """Whether a result may be exported: accepted, without any warning, both targets resolved."""
    return (df_status == "accepted") & category.isNotNull() & system.isNotNull()


def may_extract_elsewhere(found: Column) -> Column:
    """Whether another extraction may be tried after these issues."""
    return ~F.arrays_overlap(codes(found), F.array(*map(F.lit, BLOCKERS)))


def exploded(df: DataFrame, key: list[str]) -> DataFrame:
    """One row for each issue: key, ord, code, severity, details."""
    return df.select(*key, F.posexplode("issues").alias("ord", "_i")).select(*key, "ord", "_i.*")
