"""Matrix operators: normal form, orientation, and measures in long and wide form.

A matrix is a column of array<array<string>>; nothing here shuffles but wide(), which
groups cells by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.domain import FIELDS
from tablewright.functions import sizes, units
from tablewright.functions.text import clean, let


def padded(matrix: Column) -> Column:
    """Every row as long as the longest."""

    def to(rows: Column, width: Column) -> Column:
        return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))

    # bound, as else the matrix would be made anew for each of its rows
    return let(matrix, lambda m: let(F.array_max(F.transform(m, F.size)), lambda w: to(m, w)))


def normal(matrix: Column) -> Column:
    """Cleaned cells, no blank rows, rows of one length."""

    def own(c: Column) -> Column:
        # ASCII without blanks, as most cells are, stays as it is
        return F.when(c.rlike(r"^[!-~]*\z"), c).otherwise(clean(F.coalesce(c, F.lit(""))))

    cells = F.transform(matrix, lambda r: F.transform(r, own))
    return padded(F.filter(cells, lambda r: F.exists(r, lambda c: c != "")))


def with_axes(df: DataFrame, matrix: str = "matrix") -> DataFrame:
    """Adds headers, stub, size_axis and orientation of a matrix in normal form."""
    rows = F.col(matrix)
    none = F.array().cast("array<string>")
    df = df.withColumn("headers", F.coalesce(F.get(rows, F.lit(0)), none)).withColumn(
        "stub",
        F.filter(F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda r: r[0]), lambda x: x != ""),
    )
    tail = F.slice(F.col("headers"), 2, F.greatest(F.size("headers"), F.lit(1)))
    df = df.withColumn("_top", F.filter(tail, sizes.is_size)).withColumn("_side", F.filter("stub", sizes.is_size))

    def count(labels: str, test) -> Column:
        return F.size(F.filter(labels, test))

    top, side = F.size("_top"), F.size("_side")
    systems = (count("headers", sizes.names_system) >= 2) | (count("stub", sizes.names_system) >= 2)
    top_fields = count("headers", lambda x: units.field_of(x).isNotNull())
    orientation = (
        F.when(systems | ((top >= 2) & (side >= 2)), "conversion-grid")
        .when((side >= 2) & ((top_fields > 0) | (top == 0)), "size-rows")
        .when(top >= 2, "size-columns")
        .when(side >= 2, "size-rows")
        .otherwise("unknown")
    )
    axis = (
        F.when(F.col("orientation") == "conversion-grid", F.when(side >= top, F.col("_side")).otherwise(F.col("_top")))
        .when(F.col("orientation") == "size-rows", F.col("_side"))
        .when(F.col("orientation") == "size-columns", F.col("_top"))
        .otherwise(none)
    )
    return df.withColumn("orientation", orientation).withColumn("size_axis", axis).drop("_top", "_side")


def cells(df: DataFrame, key: list[str], matrix: str = "matrix", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each cell of a padded matrix: key, keep, row, col, text, header, stub_text."""
    rows = df.select(*key, *keep, F.col(matrix).alias("_m"), F.posexplode(matrix).alias("row", "_cells"))
    return rows.select(
        *key, *keep, "row", F.get(F.col("_cells"), F.lit(0)).alias("stub_text"), F.get("_m", F.lit(0)).alias("_headers"),
        F.posexplode("_cells").alias("col", "text"),
    ).withColumn("header", F.get("_headers", F.col("col"))).drop("_headers")


#: A number alone, as most cells are; a unit is then its header's.
_NUMBER = r"^\d+(?:[.,]\d+)?\z"


def _lines(matrix: Column, table_unit: Column) -> Column:
    """The sizes of a padded matrix whose first column holds them and whose first row names fields.

    array<struct<row_ord, label, cells: array<struct<field, cm, raw>>>>, of rows that hold a
    measure. Headers are read once a table, labels once a row; of two cells for one field
    the later stands.
    """
    heads = F.transform(
        F.get(matrix, F.lit(0)),
        lambda h: F.struct(units.field_of(h).alias("field"), units.cell_unit(h, F.lit(""), table_unit).alias("unit"), h.alias("text")),
    )

    def cell(text: Column, head: Column) -> Column:
        plain = let(units.number(text), lambda v: F.struct(units.to_cm(v, head["unit"]).alias("low"), units.to_cm(v, head["unit"]).alias("high")))
        cm = F.when(text.rlike(_NUMBER), plain).otherwise(units.range_cm(text, units.cell_unit(head["text"], text, table_unit)))
        return F.when((text != "") & head["field"].isNotNull(), F.struct(head["field"].alias("field"), cm.alias("cm"), text.alias("raw")))

    def last(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda c: c["field"]))
        latest = F.transform(names, lambda f: F.element_at(F.filter(found, lambda c: c["field"] == f), -1))
        return F.when(F.size(names) < F.size(found), latest).otherwise(found)

    def line(row: Column, at: Column, heads: Column) -> Column:
        read = F.transform(row, lambda text, i: F.when(i > 0, let(F.trim(text), lambda t: cell(t, F.get(heads, i)))))
        fine = F.filter(read, lambda c: c["cm"].isNotNull())
        named = let(F.trim(F.get(row, F.lit(0))), lambda n: F.when((at > 0) & (n != "") & sizes.is_size(n), n))
        return let(
            named, lambda n: F.when(n.isNotNull(), F.struct(at.alias("row_ord"), n.alias("label"), let(fine, last).alias("cells")))
        )

    rows = let(heads, lambda h: F.transform(matrix, lambda r, i: line(r, i, h)))
    return F.filter(rows, lambda x: F.size(x["cells"]) > 0)


def _read(df: DataFrame, key: list[str]) -> DataFrame:
    """One row for each size of candidates (key, matrix, orientation, unit): key, row_ord, label and cells."""
    m, unit, way = F.col("_m"), F.col("unit"), F.col("orientation")
    width = F.size(F.get(m, F.lit(0)))
    turned = F.when(width > 0, F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), lambda j: F.transform(m, lambda r: F.get(r, j))))
    ways = F.when(way == "size-rows", F.array(m)).when(way == "size-columns", F.array(turned)).when(way == "unknown", F.array(m, turned))
    # of an unknown orientation columns count only where no row was read
    found = F.get(F.filter(F.transform(ways, lambda t: _lines(t, unit)), lambda r: F.size(r) > 0), F.lit(0))
    padded_ = df.select(*key, "orientation", "unit", padded(F.col("matrix")).alias("_m"))
    return padded_.select(*key, F.explode(found).alias("_l")).select(*key, "_l.*")


def measures(df: DataFrame, key: list[str]) -> DataFrame:
    """Long form of the measures of candidates (key, matrix, orientation, unit).

    key, row_ord, label, field, low_cm, high_cm, raw. size-rows reads fields from the
    headers and sizes from the first column, size-columns the other way round, a
    conversion grid nothing; of an unknown orientation rows are tried, then columns.
    Of two cells for one size and field the later stands. Key names one candidate;
    nothing is shuffled, as a candidate holds all of its table.
    """
    found = _read(df, key).select(*key, "row_ord", "label", F.explode("cells").alias("_c"))
    return found.select(
        *key, "row_ord", "label", "_c.field", F.col("_c.cm.low").alias("low_cm"), F.col("_c.cm.high").alias("high_cm"), "_c.raw"
    )


def measured(df: DataFrame, key: list[str]) -> DataFrame:
    """wide() of measures(), made from each table in place."""
    rows = _read(df, key).withColumn("_at", F.map_from_entries(F.transform("cells", lambda c: F.struct(c["field"], c["cm"]))))
    ends = [F.col("_at")[f][end].alias(f"{f}_{end}") for f in FIELDS for end in ("low", "high")]
    raw = F.map_from_entries(F.array_sort(F.transform("cells", lambda c: F.struct(c["field"], c["raw"]))))
    return _named(rows.select(*key, "row_ord", "label", *ends, raw.alias("raw")))


def wide(long: DataFrame, key: list[str]) -> DataFrame:
    """One row for each size: label, canonical label, variant, low and high columns of every field, raw map."""
    ends = [
        F.max(F.when(F.col("field") == f, F.col(f"{end}_cm"))).alias(f"{f}_{end}") for f in FIELDS for end in ("low", "high")
    ]
    rows = long.groupBy(*key, "row_ord", "label").agg(
        *ends, F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "raw")))).alias("raw")
    )
    return _named(rows)


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("canonical", sizes.canonical(F.col("label"))).withColumn("variant", sizes.row_variant(F.col("label")))
