"""Requests: upload scan, normalisation of aliases, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import urls
from tablewright.functions.text import list_or_null, text_or_null, token

#: Longest brand and url that are accepted.
BRAND, URL = 200, 2048

#: Names of a record's url, first come first served.
URLS = ("size_guide_url", "sizeGuideUrl", "entry_url", "url")


#: Columns of a request beside its id.
COLUMNS = (
    "brand", "name", "size_guide_url", "audience", "garment_category", "size_system", "fallback_size_system", "fallback_urls",
)


def _string(record: Column, path: str) -> Column:
    """The non-blank string at a path of a variant, else null."""
    value = F.try_variant_get(record, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", text_or_null(F.try_variant_get(record, path, "string")))


def _list(record: Column, path: str) -> Column:
    value = F.try_variant_get(record, path, "variant")
    items = F.filter(
        F.transform(
            F.try_variant_get(value, "$", "array<variant>"),
            lambda v: F.when(F.schema_of_variant(v) == "STRING", text_or_null(F.try_variant_get(v, "$", "string"))),
        ),
        lambda x: x.isNotNull(),
    )
    return F.coalesce(F.when(F.size(items) > 0, items), list_or_null(_string(record, path)))


def _category(value: Column) -> Column:
    n = token(value)
    return F.when(n.isin("top", "tops"), "tshirts").when(n.isin("generic", "body", "body guide"), "generic-body-guide").otherwise(value)


def _items(text: Column) -> Column:
    """The list of records that an upload's text holds (variants), null where there is none."""
    root = F.try_parse_json(text)
    return F.coalesce(F.try_variant_get(root, "$.sources", "array<variant>"), F.try_variant_get(root, "$", "array<variant>"))


def records(uploads: DataFrame, text: str = "json") -> DataFrame:
    """upload (a hash of its text), ord and record (variant) of every item of uploaded JSON texts.

    An upload is an object with a list named sources, or a list. Any other text has
    no records; upload_errors() names those.
    """
    upload = F.sha2(F.col(text), 256).alias("upload")
    return uploads.select(upload, F.posexplode(_items(F.col(text))).alias("ord", "record"))


def upload_errors(uploads: DataFrame, text: str = "json") -> DataFrame:
    """uploads with upload and error: invalid-json, not-a-list, no-valid-source, or null where requests were found."""
    def valid(record: Column) -> Column:
        url = F.coalesce(*[_string(record, f"$.{k}") for k in URLS])
        return _string(record, "$.brand").isNotNull() & url.isNotNull()

    items = _items(F.col(text))
    error = (
        F.when(F.try_parse_json(F.col(text)).isNull(), "invalid-json").when(items.isNull(), "not-a-list")
        .when(~F.exists(items, valid), "no-valid-source")
    )
    return uploads.withColumns({"upload": F.sha2(F.col(text), 256), "error": error})


def normalised(found: DataFrame, record: str = "record") -> DataFrame:
    """Adds the request's columns to variant records; records without brand or url are left out.

    request_id stands for all of these columns and the record's place in its upload. Of
    several names for a value the first that holds a non-blank string counts, top
    level before target.
    """
    r = F.col(record)

    def first(*paths: str, of=_string) -> Column:
        return F.coalesce(*[of(r, f"$.{p}") for p in paths])

    out = found.withColumns(
        {
            "brand": first("brand"),
            "name": first("name"),
            "size_guide_url": first(*URLS),
            "audience": first("audience", "gender", "target.audience", "target.gender"),
            "garment_category": F.coalesce(*[_category(_string(r, f"$.{p}")) for p in ("garmentCategory", "category", "target.category")]),
            "size_system": first("sizeSystem", "size_system", "target.sizeSystem", "target.size_system"),
            "fallback_size_system": first(
                "fallbackSizeSystem", "fallback_size_system", "target.fallbackSizeSystem", "target.fallback_size_system"
            ),
            "fallback_urls": first("fallbackUrls", "fallback_urls", "target.fallbackUrls", "target.fallback_urls", of=_list),
        }
    )
    out = out.where(F.col("brand").isNotNull() & F.col("size_guide_url").isNotNull())
    place = [c for c in ("upload", "ord") if c in found.columns]
    return out.withColumn("request_id", F.sha2(F.to_json(F.struct(*place, *COLUMNS), {"ignoreNullFields": "false"}), 256))


def guard(brand: Column, url: Column) -> Column:
    """Why a request must not be run, null where it may."""
    return (
        F.when(F.length(brand) > BRAND, "brand-too-long")
        .when(F.length(url) > URL, "url-too-long")
        .when(urls.host(url) == "", "url-invalid")
        .when(~urls.scheme(url).isin("http", "https"), "url-scheme")
        .when(~urls.is_allowed(url), "url-forbidden-host")
    )


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Normalised requests of the JSON files at path, each file one upload."""
    return normalised(records(spark.read.text(path, wholetext=True), "value"))


def has_guide_signal(html: Column, markdown: Column) -> Column:
    """Whether a statically fetched page is worth reading."""
    words = r"\b(?:size|sizing|guide|chart|fit|taille|mesure|mens?|homme|chest|waist|hips)\b"
    return html.rlike(r"(?i)<table\b") | F.lower(F.concat_ws(" ", html, markdown)).rlike(words)


def chosen_documents(documents: DataFrame) -> DataFrame:
    """url and renderer of the document that stands for each url: the static one where it has a
    guide signal, else the rendered one, else none."""
    html, markdown = F.coalesce("html", F.lit("")), F.coalesce("markdown", F.lit(""))
    fine = (F.col("renderer") == "static") & has_guide_signal(html, markdown) & (F.trim(html) != "")
    rendered = (F.col("renderer") == "rendered") & ((html != "") | (markdown != ""))
    rank = F.when(fine, 1).when(rendered, 2)
    ranked = documents.withColumn("_rank", rank).where(F.col("_rank").isNotNull())
    return ranked.groupBy("url").agg(F.min_by("renderer", "_rank").alias("renderer"))
