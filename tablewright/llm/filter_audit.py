"""Audit of five document filters in every order, by scanning Arrow buffers.

A task reads the UTF-8 bytes of a batch of texts where Arrow holds them, without making
a string of any. Byte classes come from a table of 256 entries, and prefix sums over the
classes give each document's code points, capitals, signs and words as differences at
its ends. A word's 64-bit hash is a sum of its bytes' table values times powers of an odd
number; a document's words are sorted by hash and length, neighbours that agree are
compared byte by byte, and only where bytes differ (a collision) are words counted by
themselves. So distinct counts are exact.

A document then is a mask of failed filters and the SHA-256 of its text. That rows are
identical table-wide is decided from these small rows by aggregations with partial sums,
so a text with a third of all rows costs its tasks one row each. What is left is a count
for each part and mask (32 at most), from which every order and step is a sum.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import body, table, written

FILTERS = "ABCDE"

#: Bytes that are scanned at a time; a longer text is scanned in pieces that end at white space.
CHUNK = 1 << 20

_WHITE, _SIGNS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#$%&*|"
_SPACE, _CAPITAL, _SIGN, _POINT = (np.zeros(256, bool) for _ in range(4))
_SPACE[list(_WHITE)] = True
_CAPITAL[list(range(ord("A"), ord("Z") + 1))] = True
_SIGN[list(_SIGNS)] = True
_POINT[[b for b in range(256) if b & 0xC0 != 0x80]] = True  # all but the continuation bytes of UTF-8
_VALUE = np.random.default_rng(13).integers(0, 2**64, 256, np.uint64, endpoint=False)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def sums_between(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set between neighbouring ends, by prefix sums."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[ends])


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs outside white space; the caller sees to runs that documents' ends cut."""
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of data; slices don't overlap and aren't empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    inside = np.repeat(starts, length)
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    powers = np.cumprod(np.full(int(length.max()), _ODD, np.uint64))
    terms = _VALUE[data[inside + at]] * powers[at]
    return np.add.reduceat(terms, np.cumsum(length) - length)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the slices of these lengths that start at a and at b are equal, pair by pair."""
    if not len(a):
        return np.zeros(0, bool)
    first = np.cumsum(length) - length
    at = np.arange(length.sum()) - np.repeat(first, length)
    differ = data[np.repeat(a, length) + at] != data[np.repeat(b, length) + at]
    return ~np.logical_or.reduceat(differ, first)


def distinct_words(data: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: np.ndarray, docs: int) -> np.ndarray:
    """Distinct words of each of docs documents; word i is data[starts[i]:ends[i]] of document doc[i]."""
    length = ends - starts
    order = np.lexsort((length, hashed, doc))
    doc, starts, length, hashed = doc[order], starts[order], length[order], hashed[order]
    alike = (doc[1:] == doc[:-1]) & (hashed[1:] == hashed[:-1]) & (length[1:] == length[:-1])
    pair = np.flatnonzero(alike)
    verified = np.zeros(len(alike), bool)
    differ = []
    for a in range(0, len(pair), 1 << 16):  # bounds what the comparison holds at a time
        own = pair[a : a + (1 << 16)]
        verified[own] = same_bytes(data, starts[own], starts[own + 1], length[own])
        differ += own[~verified[own]].tolist()
    counts = np.bincount(doc, minlength=docs) - np.bincount(doc[1:][alike], minlength=docs)
    groups = np.concatenate([[0], np.cumsum(~alike)]) if len(doc) else np.zeros(0, int)
    for g in {int(groups[i]) for i in differ}:  # collisions
        own = np.flatnonzero(groups == g)
        counts[doc[own[0]]] += len({data[s : s + n].tobytes() for s, n in zip(starts[own], length[own], strict=True)}) - 1
    return counts


def _cuts(data: np.ndarray, offsets: np.ndarray):
    """(first document, last, cuts): runs of documents of about CHUNK bytes, and where their bytes are cut."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1
        if j > i:
            yield i, j, [int(offsets[i]), int(offsets[j])]
        else:  # one long text: cut where white space begins after each CHUNK bytes
            j, cuts = i + 1, [int(offsets[i])]
            while cuts[-1] < offsets[j]:
                at = min(cuts[-1] + CHUNK, int(offsets[j]))
                while at < offsets[j]:
                    found = np.flatnonzero(_SPACE[data[at : min(at + CHUNK, int(offsets[j]))]])
                    at = at + int(found[0]) if len(found) else min(at + CHUNK, int(offsets[j]))
                    if len(found):
                        break
                cuts.append(at)
            yield i, j, cuts
        i = j


def scanned(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """words, distinct, capitals, signs and points (code points) of the texts data[offsets[i]:offsets[i + 1]]."""
    n = len(offsets) - 1
    out = {k: np.zeros(n, np.int64) for k in ("words", "distinct", "capitals", "signs", "points")}
    for lo, hi, cuts in _cuts(data, offsets):
        found = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = data[a:b]
            ends = np.clip(offsets[lo : hi + 1] - a, 0, b - a)
            for name, kind in (("capitals", _CAPITAL), ("signs", _SIGN), ("points", _POINT)):
                out[name][lo:hi] += sums_between(kind[own], ends)
            starts, stops = words_of(own)
            if not len(starts):
                continue
            # a word that runs over a document's end is one of each document
            cut = ends[1:-1]
            k = np.searchsorted(starts, cut, "right") - 1
            cut = np.unique(cut[(k >= 0) & (starts[k] < cut) & (cut < stops[k])])
            starts, stops = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([stops, cut]))
            doc = np.searchsorted(ends, starts, "right") - 1
            out["words"][lo:hi] += np.bincount(doc, minlength=hi - lo)
            found.append((doc, starts + a, stops + a, hashes(own, starts, stops)))
        if found:
            doc, starts, stops, hashed = map(np.concatenate, zip(*found, strict=True))
            out["distinct"][lo:hi] = distinct_words(data, doc, starts, stops, hashed, hi - lo)
    return out


def mask_of(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Bit i is set if a text fails FILTERS[i]; the last filter needs the whole table."""
    fails = [
        counts["words"] < 100, 100 * counts["distinct"] < 80 * counts["words"],
        100 * counts["capitals"] > 10 * counts["points"], counts["signs"] > 0,
    ]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow column of binary values without nulls, not copied."""
    import pyarrow as pa

    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, part, digest (SHA-256 of the text) and mask of the filters before the last, a row for each row of docs."""

    def scan(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = buffers(batch.column("text"))
            whole = memoryview(data)
            digests = [hashlib.sha256(whole[a:b]).digest() for a, b in zip(offsets, offsets[1:], strict=False)]
            mask = mask_of(scanned(data, offsets))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(mask, pa.int32())],
                ["doc_id", "part", "digest", "mask"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), body(F.col(lang_col)).alias("part"), body(F.col(text_col)).cast("binary").alias("text")
    )
    return rows.mapInArrow(scan, "doc_id long, part string, digest binary, mask int")


def counted(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask (of all filters), docs, good and toxic: how many rows of masks() there are of each."""
    keys = ["digest", "part", "mask"]
    once = rows.groupBy(*keys, "doc_id").agg(F.count("*").alias("n"))
    known = labels.select(F.col(id_col).cast("long").alias("label_id"), *[(F.col(c) == 1).cast("int").alias(c) for c in ("quality", "toxic")])
    known = known.where(F.col("label_id").isNotNull()).groupBy("label_id").agg(
        F.coalesce(F.max("quality"), F.lit(0)).alias("good"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic")
    )
    once = once.join(known, F.col("doc_id") == F.col("label_id"), "left").fillna(0, ["good", "toxic"])
    numbered = F.col("doc_id").isNotNull()
    kinds = once.groupBy(*keys, "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(numbered, F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(~numbered, F.col("n")).otherwise(0)).alias("unnumbered")
    )
    # of identical texts only the rows of the smallest id, and those without an id, pass the last filter
    kinds = kinds.withColumn("smallest", F.min("first.doc_id").over(Window.partitionBy("digest")))
    passing = F.col("unnumbered") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    last = 1 << (len(FILTERS) - 1)
    both = F.array(F.struct(F.col("mask"), passing.alias("docs")), F.struct((F.col("mask") + last).alias("mask"), (F.col("n") - passing).alias("docs")))
    each = kinds.select("part", "good", "toxic", F.inline(both))
    return each.where(F.col("docs") > 0).groupBy("part", "mask").agg(
        F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("good")).alias("good"), F.sum(F.col("docs") * F.col("toxic")).alias("toxic")
    )


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """A row for each part, order of the filters and step, with what the step does to the part's documents.

    A null text counts as empty (no words, so it fails A and none of B, C and D), a null
    language as the empty string. Identical texts are those with the same bytes, held by
    their SHA-256. Ids may be null or repeat: a row without an id never fails E and lets
    no other row fail it, and rows of the same id and text don't fail each other. Of
    repeated or null labels of an id a 1 counts. An empty table gives an empty result.
    Other columns are ignored.
    """
    counts = written(counted(masks(docs, id_col, text_col, lang_col), labels, id_col), "audit-masks")
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for i, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            steps.append(("".join(order), i + 1, before, bit))
            before |= bit
    plan = pd.DataFrame(steps, columns=["filter_order", "step", "before", "bit"]).to_dict("records")
    struct = "array<struct<filter_order:string,step:int,before:int,bit:int>>"
    steps = F.from_json(F.lit(json.dumps(plan)), struct)
    rows = counts.withColumn("s", F.explode(steps)).select("part", "mask", "docs", "good", "toxic", "s.*")
    mask, before, bit = F.col("mask"), F.col("before"), F.col("bit")
    reached, fails = mask.bitwiseAND(before) == 0, mask.bitwiseAND(bit) != 0

    def total(value, when):
        return F.sum(F.when(when, value).otherwise(0)).cast("long")

    turns = factorial(len(FILTERS))
    # of the orders of all filters, a document's removal falls to each of its failed ones equally often
    return rows.groupBy("part", "filter_order", "step").agg(
        total(F.col("docs"), mask.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total(F.col("docs"), reached & fails).alias("removed"),
        total(F.col("docs"), ~reached & fails).alias("redundant"),
        total(F.col("docs"), mask == bit).alias("unique_fails"),
        total(F.col("good"), reached & fails).alias("good_lost"),
        total(F.col("toxic"), reached & fails).alias("toxic_lost"),
        total(F.col("docs") * F.lit(turns) / F.greatest(F.bit_count(mask), F.lit(1)), fails).alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
f AS (
  SELECT doc_id, part,
         len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
m AS (
  SELECT part, a, b, c, d, e, count(*) AS docs, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
n AS (SELECT *, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails FROM m),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM x p, x q, x r, x s, x t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
g AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o),
h AS (
  SELECT part, filter_order, step, docs, good, toxic, substr(filter_order, step, 1) AS own, fails,
         list_contains(fails, substr(filter_order, step, 1)) AS failing,
         len(list_filter(fails, lambda y: position(y IN filter_order) < step)) > 0 AS gone
  FROM n, g)
SELECT part, filter_order, step,
       CAST(sum(CASE WHEN NOT gone AND NOT failing THEN docs ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN NOT gone AND failing THEN docs ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN gone AND failing THEN docs ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN fails = [own] THEN docs ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(CASE WHEN failing THEN docs * 120 // len(fails) ELSE 0 END) AS BIGINT) AS shapley
FROM h GROUP BY part, filter_order, step
"""
