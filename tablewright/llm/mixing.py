"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations.

The words of each source are laid end to end in a shuffled document order and cut
into blocks of BLOCK words, the same for all sources. Slot i of the mix has the golden-ratio
point frac(i * phi), taken in whole numbers of 1 / 2**64, so that it neither overflows
nor comes round; the source whose stretch of the cumulated targets (in blocks)
holds the point gets the slot. The r-th slot of a source takes its block r, beginning
anew after the last, so a source is repeated evenly and never more than CAP times. Slots
beyond a source's target are dropped, the few that points left it short of are appended,
and its last slot takes a part of a block, so targets are met to the word.

At scale: the text is read once and never shuffled; ids, sizes and slots are all
that moves. A source with most of the rows is spread by buckets of its shuffled
order and of the slots' numbers. Sources are one row each, of any number: their ranks
and targets come from running sums over ranges, and single numbers reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import fresh, running_start, running_sums, table, word_count, written

#: Weights of the sources in order, repeating, and the most often that a source may be taken.
WEIGHTS, CAP = (5, 2, 1), 3

#: Words of a block.
BLOCK = 64

#: Rows of one (group, bucket) of the running sums, about.
ROWS = 4096

#: Fractional part of the golden ratio, times 2**64, rounded to the next odd number.
GOLDEN, TURN = 11400714819323198485, 1 << 64

#: Cells of the unit interval in which points and the sources' stretches are matched.
CELLS = 4096


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size and target of each source of sizes (source, size).

    Sources by code point, null last, weigh as weights, repeating, and share all
    sizes; targets stop at cap times the source's size, and the excess is shared
    again by weight until none is above. Sources without words get 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_sums(totals, by_source(), turn=F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("weight"), (cap * F.col("source_size")).alias("limit"))
    # sources stop in the order of limit by weight; the first one that doesn't tells the share of all that follow
    ranked = running_sums(ranked, [F.col("limit") / F.col("weight"), *by_source()], stopped=F.col("limit"), spent=F.col("weight"))
    whole = ranked.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weights")).first()
    share = (F.lit(whole["all"] or 0) - F.col("stopped")) / (F.lit(whole["weights"] or 0) - F.col("spent"))
    free = ranked.select(share.alias("share"), "limit", "weight").where(F.col("share") * F.col("weight") <= F.col("limit"))
    found = free.agg(F.max("share")).first()[0]
    return ranked.select(
        "source", "source_size", F.least(F.col("weight") * F.lit(float(found or 0.0)), F.col("limit").cast("double")).alias("target")
    )


def by_source() -> list[Column]:
    """The order of sources: by code point, null last."""
    return [F.col("source").isNull(), F.col("source").cast("binary")]


def point(slot: Column) -> Column:
    """The point of a slot in the unit interval; the product has 38 digits at most, up to slot 10**18."""
    whole = slot.cast("decimal(18,0)") * F.lit(str(GOLDEN)).cast("decimal(20,0)") + F.lit(str(TURN // 2)).cast("decimal(20,0)")
    return (whole % F.lit(str(TURN)).cast("decimal(20,0)")).cast("double") / float(TURN)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, cap: int = CAP, seed: int = 0,
) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, source.

    Null texts have size 0 and are never taken; null is a source of its own, the
    last. Repeated ids are rows of their own. taken is at most cap times size. An
    empty table gives an empty result. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    rows = written(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            # the text too, so that rows of one repeated or null id are shuffled apart
            F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("key"),
        ),
        "mix-rows",
    )
    n = rows.count()
    # a source's words are whole rounds over its blocks and a rest, of which the last slot takes a part of a block
    size, words = F.col("source_size"), F.least(F.floor(F.col("target") + 0.5), cap * F.col("source_size"))
    goal = targets(rows, weights, cap).withColumns({"blocks": F.ceil(size / BLOCK), "words": words})
    rest = F.coalesce(F.col("words") % F.nullif("source_size", F.lit(0)), F.lit(0))
    rounds = F.coalesce(F.expr("words div nullif(source_size, 0)"), F.lit(0))
    goal = goal.withColumns({"rest": rest, "slots": rounds * F.col("blocks") + F.ceil(rest / BLOCK)})
    goal = written(goal.withColumn("last", F.when(F.col("rest") % BLOCK != 0, F.col("rest") % BLOCK)), "mix-targets")
    n_slots = goal.agg(F.sum("slots")).first()[0] or 0

    # the shuffled order of each source, cut into blocks
    bits = max(0, math.ceil(math.log2(max(1, n / ROWS))))
    part = F.shiftright("key", 64 - bits) if bits else F.lit(0)
    laid = running_start(rows.where("size > 0"), "source", ["key", "row_id"], F.col("size"), part, "start")
    end, block = F.col("start") + F.col("size"), F.lit(BLOCK).cast("long")
    inside = laid.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block)))
    ).select(
        "row_id", "source", "block", (F.greatest("start", F.col("block") * block) - F.col("block") * block).alias("from"),
        (F.least(end, (F.col("block") + 1) * block) - F.col("block") * block).alias("to"),
    )

    # slots: points through the cumulated targets, ranked within the source
    stretch = running_sums(goal.where("slots > 0").select("source", "blocks", "slots", "last"), by_source(), low=F.col("slots"))
    ends = {"low": F.col("low") / F.lit(max(n_slots, 1)), "high": (F.col("low") + F.col("slots")) / F.lit(max(n_slots, 1))}
    stretch = stretch.select("source", "blocks", "slots", "last", *[c.alias(k) for k, c in ends.items()])
    cells = F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.col("high") * CELLS))
    stretch = stretch.withColumn("cell", F.explode(cells))
    slots = spark.range(0, n_slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("point"))
    dealt = slots.withColumn("at", F.floor(F.col("point") * CELLS)).join(
        stretch, (F.col("at") == F.col("cell")) & (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))
    )
    dealt = running_start(dealt, "source", ["slot"], F.lit(1), F.floor(F.col("slot") / ROWS), "rank")
    # points fall near their number: a source's surplus slots are dropped, the few that it lacks come after all others
    held = dealt.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("held"))
    facts = ["source", "blocks", "slots", "last"]
    lacking = goal.select(*facts).join(held, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("held", F.coalesce("held", F.lit(0)))
    lacking = lacking.where("held < slots").select(*facts, F.explode(F.sequence(F.col("held"), F.col("slots") - 1)).alias("rank"))
    slots = dealt.where("rank < slots").select(*facts, "rank").unionByName(lacking)
    part = F.when(F.col("rank") == F.col("slots") - 1, F.col("last"))
    taken_blocks = slots.groupBy(F.col("source").alias("of"), (F.col("rank") % F.col("blocks")).alias("no")).agg(
        F.count_if(part.isNull()).alias("times"), F.max(part).alias("part")
    )
    words = (F.col("to") - F.col("from")) * F.col("times") + F.greatest(F.lit(0), F.least("to", F.coalesce("part", F.lit(0))) - F.col("from"))
    taken = (
        inside.hint("merge")  # a row for each block of a document, but Spark sizes the table before its explode
        .join(taken_blocks, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("no")))
        .groupBy(F.col("row_id").alias("row"))
        .agg(F.sum(words).alias("taken"))
    )
    return (
        rows.join(taken, F.col("row_id") == F.col("row"), "left")
        .join(goal.select(F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of")))
        .select(
            "doc_id", "size", "source_size", "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source",
        )
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs as often as the mix takes them, to the nearest whole document.

    All columns stay. A document of which the mix takes less than half is left out,
    and so is one without words.
    Ids must identify rows; a repeated id would take its copies from each other.
    """
    key, times, turn = (fresh(x, docs.columns) for x in ("mixed_id", "mixed_times", "mixed_turn"))
    copies = (
        mix(docs, id_col)
        .groupBy(F.col("doc_id").alias(key))
        .agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
        .select(key, F.floor(F.col("t") / F.nullif(F.col("s"), F.lit(0)) + 0.5).cast("int").alias(times))
        .where(F.col(times) > 0)
    )
    found = docs.join(copies, F.col(id_col).eqNullSafe(F.col(key)))
    return found.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op2_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("source")
