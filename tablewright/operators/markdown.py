"""Markdown operators: lines, heading paths, piped tables, delimited grids, links.

Documents are split into lines once; runs of table lines are found with windows per
document, and the cells of a run are gathered once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions import sizes, units
from tablewright.functions.text import BLANKS, clean
from tablewright.operators.matrix import normal, with_axes

HEADING = r"^#{1,6}\s+(.+)$"


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def is_separator(line: Column) -> Column:
    """Dashes, colons, pipes and blanks only; an empty line is none."""
    return trimmed(line).rlike(rf"^[:|\-{BLANKS}]+$")


def piped_cells(line: Column) -> Column:
    """Cells of a table line, one pipe at either edge left out."""
    return F.transform(F.split(F.regexp_replace(trimmed(line), r"^\||\|$", ""), r"\|"), clean)


def loose_cells(line: Column) -> Column:
    """Cells of a line that tabs or wide gaps split; none without them."""
    own = trimmed(line)

    def cut(pattern: str) -> Column:
        return F.filter(F.transform(F.split(own, pattern), clean), lambda c: c != "")

    wide = cut(f"[{BLANKS}]{{2,}}")
    return F.when(own.contains("\t"), cut(r"\t+")).when(F.size(wide) >= 2, wide).otherwise(F.array().cast("array<string>"))


def lines(docs: DataFrame, key: list[str], text: str = "markdown") -> DataFrame:
    """One row for each line: key, line (from 0), text, heading (null outside headings),
    path (the last three headings up to the line), before and after (neighbouring lines)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*key, F.posexplode(F.split(whole, r"\r?\n")).alias("line", "text"))
    head = F.regexp_extract(trimmed(F.col("text")), HEADING, 1)
    rows = rows.withColumn("heading", F.when(head != "", clean(head)))
    return heading_paths(rows, key, "line", "heading").withColumns(
        {
            "before": F.coalesce(F.lag("text").over(Window.partitionBy(*key).orderBy("line")), F.lit("")),
            "after": F.coalesce(F.lead("text").over(Window.partitionBy(*key).orderBy("line")), F.lit("")),
        }
    )


def heading_paths(df: DataFrame, key: list[str], ord_col: str, heading: str, most: int = 3) -> DataFrame:
    """Adds path: the last most non-null headings up to each row.

    A heading's own path needs the few headings before it, any other row has that of the
    last heading, so no row gathers more than its path.
    """
    among = Window.partitionBy(*key, F.col(heading).isNull()).orderBy(ord_col)
    own = F.array_compact(F.array(*[F.lag(heading, i).over(among) for i in reversed(range(1, most))], F.col(heading)))
    up_to = Window.partitionBy(*key).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_own", F.when(F.col(heading).isNotNull(), own))
    return df.withColumn("path", F.coalesce(F.last("_own", ignorenulls=True).over(up_to), F.array().cast("array<string>"))).drop("_own")


def _runs(rows: DataFrame, key: list[str], member: Column) -> DataFrame:
    """Adds stop: the first later line that isn't a member (one past the last line at the end)."""
    later = Window.partitionBy(*key).orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    end = Window.partitionBy(*key)
    broken = F.min(F.when(~member, F.col("line"))).over(later)
    return rows.withColumn("stop", F.coalesce(broken, F.max("line").over(end) + 1))


def _matrices(heads: DataFrame, body: DataFrame, key: list[str]) -> DataFrame:
    """heads (start, stop, sep, cells) with matrix: a head's own cells and the run's rows below it."""
    below = F.filter("_all", lambda r: r["line"] > F.col("start") + F.col("sep").cast("int"))
    own = F.when(F.col("filled"), F.array("cells")).otherwise(F.array().cast("array<array<string>>"))
    return heads.join(body, [*key, "stop"]).withColumn("matrix", F.concat(own, F.transform(below, lambda r: r["cells"]))).drop("_all")


def _valid(found: DataFrame) -> DataFrame:
    """Those of heads with matrices that are tables; one without a separator needs three columns, a field and two sizes."""
    found = found.where(F.size("matrix") >= 2)
    plain = with_axes(found.where("NOT sep").withColumn("matrix", normal(F.col("matrix"))))
    fields = F.size(F.filter(F.flatten("matrix"), lambda c: units.field_of(c).isNotNull()))
    plain = plain.where((F.size("matrix") >= 2) & (F.size(F.get("matrix", F.lit(0))) >= 3) & (fields > 0) & (F.size("size_axis") >= 2))
    return found.where("sep").unionByName(plain.select(*found.columns))


def piped_tables(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, ord, kind, matrix, heading_path, title, subheading, nearby of the piped tables of lines().

    A table is a line with a pipe, an optional separator, and the piped lines that
    follow up to a blank row. Without a separator it needs three columns, a field and
    two size labels. A table goes to the end of its run of lines, so a run holds one at
    most. Nearly always that begins at the run's first line; only runs where it doesn't
    are searched from their other lines, too, if they hold a field and two sizes at all.
    """
    cells = F.when(F.col("text").contains("|"), piped_cells(F.col("text")))
    rows = rows.withColumn("cells", cells).withColumn("filled", F.coalesce(F.exists("cells", lambda c: c != ""), F.lit(False)))
    ahead = Window.partitionBy(*key).orderBy("line")
    rows = rows.withColumn("sep", F.coalesce(is_separator(F.lead("text").over(ahead)), F.lit(False)))
    # a separator's own run begins two lines below the header, any other one line below
    rows = _runs(rows, key, F.col("filled")).withColumn("stop_sep", F.lead("stop").over(ahead))
    heads = rows.where(F.col("cells").isNotNull() & F.col("heading").isNull()).select(
        *key, F.col("line").alias("start"), "sep", F.when(F.col("sep"), F.coalesce("stop_sep", "stop")).otherwise(F.col("stop")).alias("stop"),
        "path", "before", "cells", "filled",
    )
    heads = heads.withColumn("turn", F.row_number().over(Window.partitionBy(*key, "stop").orderBy("start")))
    said = F.sum(F.size(F.filter("cells", lambda c: units.field_of(c).isNotNull())))
    sized = F.sum(F.size(F.filter("cells", sizes.is_size)))
    body = rows.where("filled").groupBy(*key, "stop").agg(
        F.array_sort(F.collect_list(F.struct("line", "cells"))).alias("_all"), ((said > 0) & (sized >= 2)).alias("_apt")
    )
    first = _valid(_matrices(heads.where("turn = 1"), body.drop("_apt"), key))
    left = heads.where("turn > 1").join(first.select(*key, "stop"), [*key, "stop"], "left_anti")
    left = left.join(body.select(*key, "stop", "_apt"), [*key, "stop"]).where("_apt OR sep").drop("_apt")
    later = _valid(_matrices(left, body.drop("_apt"), key))
    later = later.withColumn("_rn", F.row_number().over(Window.partitionBy(*key, "stop").orderBy("start"))).where("_rn = 1").drop("_rn")
    return _finished(first.unionByName(later), rows, key, "markdown-table", "Markdown table")


def loose_grids(rows: DataFrame, key: list[str]) -> DataFrame:
    """The same of grids whose cells tabs or wide gaps split: two lines and three signals at least.

    Of a run's lines the first that is no heading begins its grid: any later one has fewer signals.
    """
    rows = rows.withColumn("cells", loose_cells(F.col("text"))).withColumn("filled", F.size("cells") >= 2)
    rows = _runs(rows, key, F.col("filled"))
    heads = rows.where(F.col("filled") & F.col("heading").isNull()).select(
        *key, F.col("line").alias("start"), "stop", "path", "before", "cells", "filled", F.lit(False).alias("sep"),
        F.row_number().over(Window.partitionBy(*key, "stop").orderBy("line")).alias("turn"),
    )
    body = rows.where("filled").groupBy(*key, "stop").agg(F.array_sort(F.collect_list(F.struct("line", "cells"))).alias("_all"))
    found = _matrices(heads.where("turn = 1"), body, key)
    signals = F.filter(F.flatten("matrix"), lambda c: sizes.is_size(c) | units.field_of(c).isNotNull())
    return _finished(found.where((F.size("matrix") >= 2) & (F.size(signals) >= 3)), rows, key, "markdown-grid", "Markdown grid")


def _finished(taken: DataFrame, rows: DataFrame, key: list[str], kind: str, name: str) -> DataFrame:
    after = rows.select(*key, F.col("line").alias("stop"), F.col("text").alias("_after"))
    return taken.join(after, [*key, "stop"], "left").select(
        *key, F.col("start").alias("ord"), F.lit(kind).alias("kind"), "matrix", F.col("path").alias("heading_path"),
        F.coalesce(F.get("path", F.size("path") - 1), F.lit(name)).alias("title"), F.lit("").alias("subheading"),
        clean(F.concat_ws(" ", "before", "_after")).alias("nearby"),
    )


def links(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, ord, href, label, heading_path, nearby of the [label](href) links of lines(), images left out."""
    pattern = r"(!?)\[([^\]]+)\]\(([^)]+)\)"
    own = trimmed(F.col("text"))
    parts = F.arrays_zip(*[F.regexp_extract_all(own, F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "image"), (2, "label"), (3, "href"))])
    found = rows.where(F.col("heading").isNull() & own.contains("](")).select(
        *key, "line", F.col("path").alias("heading_path"), clean(F.concat_ws(" ", "before", own, "after")).alias("nearby"),
        F.posexplode(parts).alias("at", "link"),
    )
    return found.where("link.image = ''").select(
        *key, (F.col("line").cast("long") * 10**6 + F.col("at")).alias("ord"), F.col("link.href").alias("href"), clean(F.col("link.label")).alias("label"), "heading_path", "nearby"
    )
