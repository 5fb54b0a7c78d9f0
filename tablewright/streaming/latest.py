"""The last accepted result of each source over a stream, in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """Keeps the greatest (at, ord, body) of a key, and tells when a greater one comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "at long, ord long, body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.held.get()) if self.held.exists() else None
        best = held
        for part in rows:
            for row in zip(part["at"].tolist(), part["ord"].tolist(), part["body"].tolist(), strict=True):
                best = row if best is None or row > best else best
        if best != held:
            self.held.update(best)
            yield pd.DataFrame({"source_key": [key[0]], "at": [best[0]], "ord": [best[1]], "body": [best[2]]})

    def close(self) -> None:
        pass


def _named(results: DataFrame, keys: list[str], at: str, order: str) -> DataFrame:
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    moment = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**63)))
    body = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return results.select(key.alias("source_key"), moment.alias("at"), F.coalesce(F.col(order).cast("long"), F.lit(-1)).alias("ord"), body.alias("body"))


def latest_stream(results: DataFrame, keys: list[str], at: str, order: str) -> DataFrame:
    """The rows of a streamed results that are the last of their keys so far, as they come (update mode).

    The last is that of the greatest at, then order, then of its JSON, so neither late nor
    repeated uploads change what stands, and a stream ends as one batch would. A null at or order comes first.
    State holds one row a key, in RocksDB; results must not have aggregates before it.
    """
    results.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    named = _named(results, keys, at, order)
    kept = named.groupBy("source_key").transformWithStateInPandas(
        statefulProcessor=Newest(), outputStructType="source_key string, at long, ord long, body string", outputMode="Update", timeMode="None"
    )
    return kept.select(F.from_json("body", results.schema).alias("r")).select("r.*")


def latest(results: DataFrame, keys: list[str], at: str, order: str) -> DataFrame:
    """The same of a table: the last row of each key, by an aggregation that keeps one row a key in each task."""
    best = _named(results, keys, at, order).groupBy("source_key").agg(F.max(F.struct("at", "ord", "body")).alias("b"))
    return best.select(F.from_json("b.body", results.schema).alias("r")).select("r.*")
