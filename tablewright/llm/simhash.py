"""SimHash near-dedup by deletion-variant signatures.

Fingerprints are made in the map tasks from whole texts. Two fingerprints that
differ in at most LINK bits agree in all but one bit of at least one of SEGMENTS
segments, so each segment is indexed once for every bit left out, and links are
found by an equality join on (left-out bit, rest of the segment). The join's own
condition verifies the distance and lets only the first matching variant of a pair
through, so no pair is emitted that isn't a link, and none twice. Keys that many
fingerprints share get second keys from the other bits. Equal fingerprints are one
row before the join. Components come from alternating large
and small stars over the links, each round a written table.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import body, forget, fresh, table, written

#: Words of a shingle, seed of its hash, bits, and most differing bits of a link.
WORDS, SEED, BITS, LINK = 4, 42, 64, 4

#: (first bit, bits) of the segments; one more than half of LINK are enough.
SEGMENTS = ((0, 22), (22, 21), (43, 21))

#: Fingerprints with one value of a segment from which its keys get second keys.
HOT = 512

#: Hashes whose bits are counted at a time.
CHUNK = 65536


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a whole text; 0 without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    line, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    n = min(WORDS, len(words))
    starts = [0, *ends[: len(words) - n]]
    ones, count = np.zeros(BITS, np.int64), len(starts)
    for a in range(0, count, CHUNK):
        found = np.array(
            [digest(line[s : e - 1], SEED) for s, e in zip(starts[a : a + CHUNK], ends[a + n - 1 : a + n - 1 + CHUNK], strict=False)],
            dtype="<u8",
        )
        bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def run(batches):
        for part in batches:
            made = np.array([fingerprint(t) for t in part["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": part["doc_id"], "fp": made})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(F.col(text_col)).alias("text"))
    return rows.mapInPandas(run, "doc_id long, fp long")


def trailing_zeros(bit: Column) -> Column:
    return F.bit_count(bit - 1)


def first_variant(x: Column) -> Column:
    """Of two fingerprints that differ in x: the first left-out bit under which a segment agrees."""
    found = F.lit(-1)
    for first, n in reversed(SEGMENTS):
        part = F.shiftright(x, first).bitwiseAND(F.lit((1 << n) - 1))
        here = F.when(part == 0, F.lit(first)).otherwise(trailing_zeros(part) + first)
        found = F.when(F.bit_count(part) <= 1, here).otherwise(found)
    return found


def variants(fp: Column) -> Column:
    """All (left-out bit, rest of its segment), each as one long."""
    keys = []
    for first, n in SEGMENTS:
        part = F.shiftright(fp, first).bitwiseAND(F.lit((1 << n) - 1))
        keys += [
            part.bitwiseAND(F.lit(((1 << n) - 1) & ~(1 << b))).bitwiseOR(F.lit((first + b) << 32)) for b in range(n)
        ]
    return F.array(*keys)


def parts_outside(first: int, n: int, most: int) -> list[int]:
    """Masks of most + 1 parts of the bits outside a segment: of at most most differing bits one part has none."""
    rest = [b for b in range(BITS) if not first <= b < first + n]
    made = [sum(1 << b for b in own.tolist()) for own in np.array_split(rest, most + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in made]


def of_segment(left_out: Column, value) -> Column:
    """value(first, n) of the segment that the left-out bit lies in."""
    found = F.lit(None)
    for first, n in SEGMENTS:
        found = F.when((left_out >= first) & (left_out < first + n), value(first, n)).otherwise(found)
    return found


def links(fps: DataFrame, most: int = LINK, hot: int = HOT) -> DataFrame:
    """a < b: the pairs of different fingerprints (column fp, distinct) in at most most differing bits.

    Keys that come from a segment's value in more than hot fingerprints would meet too
    many others: these have, beside the segment's variant, each of most + 1 parts of
    the other bits as a second key, one of which is equal in every link.

    The index meets itself by a merge, by a hint: it has 64 rows and more for each of fps, but
    Spark sizes what an explode makes as what goes in, and would send it to the driver.
    """
    values = [F.struct(F.lit(first).alias("first"), F.shiftright("fp", first).bitwiseAND(F.lit((1 << n) - 1)).alias("part")) for first, n in SEGMENTS]
    often = fps.select(F.explode(F.array(*values)).alias("v")).groupBy("v.first", "v.part").count().where(F.col("count") > hot)
    whole = F.expr("shiftleft(part, first)")
    of_part = F.filter(variants(whole), lambda k: of_segment(F.shiftright(k, 32), lambda first, n: F.lit(first)) == F.col("first"))
    busy = written(often.select(F.explode(of_part).alias("busy")).distinct(), "simhash-busy")

    def second(first: int, n: int) -> Column:
        masks = parts_outside(first, n, most)
        return F.array(*[F.struct(F.lit(j).alias("no"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for j, m in enumerate(masks)])

    index = fps.select("fp", F.explode(variants(F.col("fp"))).alias("key")).join(busy, F.col("key") == F.col("busy"), "left")
    none = F.array(F.struct(F.lit(-1).alias("no"), F.lit(0).cast("long").alias("bits")))
    more = F.when(F.col("busy").isNull(), none).otherwise(of_segment(F.shiftright("key", 32), second))
    index = index.select("fp", "key", F.explode(more).alias("s")).select("fp", "key", "s.no", "s.bits")
    left, right = index.toDF("a", "key", "no", "bits"), index.toDF("b", "other", "its_no", "its_bits")
    x = F.col("a").bitwiseXOR(F.col("b"))

    def first_part(first: int, n: int) -> Column:
        found = F.lit(-1)
        for j, m in reversed(list(enumerate(parts_outside(first, n, most)))):
            found = F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(j)).otherwise(found)
        return found

    return left.hint("merge").join(
        right,
        (F.col("key") == F.col("other"))
        & (F.col("no") == F.col("its_no"))
        & (F.col("bits") == F.col("its_bits"))
        & (F.col("a") < F.col("b"))
        & (F.bit_count(x) <= most)
        & (first_variant(x) == F.shiftright("key", 32))
        & ((F.col("no") < 0) | (F.col("no") == of_segment(F.shiftright("key", 32), first_part))),
    ).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that it is joined to, for the nodes of edges (a, b).

    Large and small stars in turn until nothing changes: the rounds grow with the
    logarithm of a component's size, and each shuffles only the edges.
    """
    now, before = written(edges.select("a", "b"), "links"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if not state[0] or state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("u"), "m")
        large = large.where("u <> m").distinct()
        # small star: every edge points from the larger u to the smaller m
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("m").alias("low"))
        small = large.join(low, F.col("u") == F.col("n"))
        small = small.select(F.col("m").alias("u"), F.col("low").alias("m")).unionByName(small.select("u", F.col("low").alias("m")))
        after = written(small.where("u <> m").distinct().select(F.col("m").alias("a"), F.col("u").alias("b")), "links")
        forget(now)
        now = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (hex), component_id.

    A null text counts as empty; texts without words have fingerprint zero and link
    like any other. component_id is the smallest id reachable over links; null ids
    count for it only where a component has no other. Ids may repeat. An empty
    table gives an empty result. Other columns of docs are ignored.
    """
    rows = written(fingerprints(docs, id_col, text_col), "simhash")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    joined = components(links(fps))
    roots = fps.join(joined, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    first = roots.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    named = roots.join(first, F.col("root") == F.col("r")).select(F.col("fp").alias("own"), "component_id")
    return rows.join(named, F.col("fp") == F.col("own")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the smallest id of their component, with all their columns.

    Ids must identify rows; rows without an id stay where no other row of their
    component has one.
    """
    key = fresh("first_id", docs.columns)
    first = near_duplicates(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return docs.join(first.select(F.col("doc_id").alias(key)), F.col(id_col).eqNullSafe(F.col(key)), "left_semi")


def op7_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
