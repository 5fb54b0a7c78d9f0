"""Sinks: export payloads as JSON lines by kind, and the run's log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JSON = {"ignoreNullFields": "false"}


def payload(pretty: bool = False, **columns: Column) -> Column:
    """JSON text of named columns, nulls written out."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return F.to_json(made, {**JSON, "pretty": str(pretty).lower()})


def write_exports(df: DataFrame, path: str) -> None:
    """Write (export_kind, file, json) as text, one folder for each kind."""
    df.select("export_kind", F.to_json(F.struct("file", "json"), JSON).alias("value")).write.partitionBy("export_kind").text(path)


def log_lines(reports: DataFrame, key: str, links: str = "links", most: int = 8) -> DataFrame:
    """key, ord and line: the first links (structs label, score, resolver, url, selected, reason) of each report."""
    head = reports.select(key, F.posexplode(F.slice(links, 1, most)).alias("ord", "l"))
    state = F.when(F.col("l.selected"), "selected").otherwise("rejected")
    line = F.concat(
        F.lit("link "), state, F.lit(': "'), F.col("l.label"), F.lit('" score='), F.col("l.score"), F.lit(" resolver="),
        F.col("l.resolver"), F.lit(" url="), F.col("l.url"), F.lit(" reason="), F.coalesce("l.reason", F.lit("none")),
    )
    return head.select(key, "ord", line.alias("line"))
