"""Best-fit packing with swap-based local search.

Whole texts are tokenised in the map tasks and only the pieces' places travel,
never their ids. Pieces of full length are sequences of their own. The others are
dealt at random into groups of about GROUP pieces, and each group is packed by
best fit and then improved by local search, which ends when no trade is left or a
lower bound is met. Groups of random lengths end 0 to 0.6 % above the bound (README),
and no task ever holds more than a group.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import body, table, written

#: Tokens of a sequence, the id that ends a document, and pieces of a packing group.
CAPACITY, END, GROUP = 1024, 2, 8192

#: The vocabulary: the tokenizer's file, and its rank file, which gives the same ids several times faster.
VOCABULARY, RANKS, SPECIAL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256}

#: White space so long that the faster encoder's pattern would need a stack of its length.
_LONG_SPACE = re.compile(r"\s{4096}")


@lru_cache(maxsize=2)
def tokenizer(path: str | None):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))


@lru_cache(maxsize=1)
def ranked():
    """The encoder of the installed rank file; None without one."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(text: str, path: str | None = None) -> list[int]:
    """The ids of a whole text; the special token's string gives its id.

    The ids are those of the tokenizer's file at path. The installed vocabulary is read
    through its rank file, but for texts with very long white space.
    """
    if path or _LONG_SPACE.search(text):
        return tokenizer(path).encode(text, add_special_tokens=False).ids
    if any(x in text for x in SPECIAL):
        return ranked().encode(text, allowed_special=set(SPECIAL))
    return ranked().encode_ordinary(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than capacity."""
    first = n % capacity if n > capacity else n
    starts = [0, *range(first, n, capacity)] if first else list(range(0, n, capacity))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


class Bins:
    """Sequences being filled: items by bin, and bins by the room that is left."""

    def __init__(self, capacity: int):
        self.capacity, self.room, self.items = capacity, [], []

    def best_fit(self, lengths: np.ndarray) -> None:
        """Longest first, each into the fullest bin that has room for it."""
        self.lengths = lengths.tolist()
        having = [[] for _ in range(self.capacity + 1)]
        open_rooms = 0  # bit r is set while some bin has room r
        for i in np.argsort(-lengths, kind="stable").tolist():
            n = self.lengths[i]
            fitting = open_rooms >> n
            if fitting:
                room = n + (fitting & -fitting).bit_length() - 1
                b = having[room].pop()
                if not having[room]:
                    open_rooms &= ~(1 << room)
                self.items[b].append(i)
            else:
                room, b = self.capacity, len(self.items)
                self.items.append([i])
                self.room.append(0)
            self.room[b] = room - n
            having[room - n].append(b)
            open_rooms |= 1 << (room - n)

    def least(self) -> int:
        """No packing has fewer bins: all tokens, or the pieces above half a bin."""
        return max(math.ceil(sum(self.lengths) / self.capacity), sum(n > self.capacity // 2 for n in self.lengths))

    def trade(self, give: list[int], take: list[int], donor: int, other: int) -> None:
        for i in give:
            self.items[donor].remove(i)
            self.items[other].append(i)
        for i in take:
            self.items[other].remove(i)
            self.items[donor].append(i)
        moved = sum(self.lengths[i] for i in give) - sum(self.lengths[i] for i in take)
        self.room[donor] += moved
        self.room[other] -= moved

    def sums(self, b: int, most: int) -> dict[int, list[int]]:
        """At most most (1 or 2) of the items of b, none too, by the sum of their lengths.

        Items of one length are alike, and different lengths that fit a bin together
        are few, so full bins of small items cost no more than others.
        """
        own: dict[int, list[int]] = {}
        for i in self.items[b]:
            own.setdefault(int(self.lengths[i]), []).append(i)
        found: dict[int, list[int]] = {0: []}
        if most > 1:
            found.update((2 * n, same[:2]) for n, same in own.items() if len(same) > 1)
            found.update((n + m, [own[n][0], own[m][0]]) for x, n in enumerate(own) for m in list(own)[x + 1 :])
        found.update((n, same[:1]) for n, same in own.items())
        return found

    def gains(self, b: int, most: int) -> np.ndarray:
        """For each length given to b, the most that b can grow by without overfilling
        when it gives at most most items for it; 0 where no such trade is."""
        takes = np.array(sorted(self.sums(b, most)))
        given = np.arange(self.capacity + 1)
        at = np.minimum(np.searchsorted(takes, given - self.room[b]), len(takes) - 1)
        return np.maximum(given - takes[at], 0) * (takes[at] >= given - self.room[b])

    def improve(self) -> None:
        """Take each bin, the emptiest first, as donor and trade with bins that are at
        least as full, again and again until no trade is left or no packing could have
        fewer bins.

        A trade is a move, one for one, one for two or two for one, and makes the
        fuller bin fuller, so the sum of squared fills grows and the search ends. Of all
        trades of a donor the one that leaves least room is made. What each bin could
        gain from each length is kept in a table, and only the two bins of a trade are
        computed anew.
        """
        least, left = self.least(), sum(map(bool, self.items))
        bins = [b for b, r in enumerate(self.room) if r and self.items[b]]
        if left <= least or len(bins) < 2:
            return
        room = np.array([self.room[b] for b in bins])
        gain = np.zeros((2, len(bins), self.capacity + 1), np.int32)  # for two given items, and for one

        def renew(x: int) -> None:
            b = bins[x]
            room[x] = self.room[b]
            for k in (0, 1):
                trading = self.items[b] and self.room[b]
                gain[k, x] = self.gains(b, k + 1) if trading else 0

        for x in range(len(bins)):
            renew(x)
        going = True
        while going:
            going = False
            for donor in np.argsort(-room, kind="stable").tolist():
                d = bins[donor]
                while self.room[d] and self.items[d]:
                    fuller = np.flatnonzero((room <= room[donor]) & (room > 0))
                    fuller = fuller[fuller != donor]
                    best = None
                    for k, gives in enumerate(((2, 1), (1,))):
                        # two items may be given for one at most, one for two
                        given = np.array(sorted({g for g, own in self.sums(d, 2).items() if len(own) in gives}), np.int64)
                        if not len(given) or not len(fuller):
                            continue
                        table = gain[k][np.ix_(fuller, given)]
                        rest = np.where(table > 0, room[fuller][:, None] - table, self.capacity + 1)
                        at = int(rest.argmin())
                        x, y = divmod(at, len(given))
                        if rest[x, y] <= self.capacity and (best is None or rest[x, y] < best[0]):
                            best = int(rest[x, y]), k, int(fuller[x]), int(given[y]), int(table[x, y])
                    if best is None:
                        break
                    _, k, other, g, grown = best
                    give = self.sums(d, 2)[g]
                    take = self.sums(bins[other], k + 1)[g - grown]
                    self.trade(give, take, d, bins[other])
                    going = True
                    renew(donor)
                    renew(other)
                if not self.items[d] and room[donor]:
                    room[donor] = 0
                    left -= 1
                    if left <= least:
                        return


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    bins = Bins(capacity)
    bins.best_fit(lengths)
    bins.improve()
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, items in enumerate(x for x in bins.items if x):
        at = 0
        for i in items:
            where[i], offset[i] = b, at
            at += bins.lengths[i]
    return where, offset


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end: int, vocabulary: str | None, with_ids: bool):
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*token_ids(text.as_py(), vocabulary), end], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    rows.append((doc_id, k, start, length, zlib.crc32(own.tobytes()), *([own.astype(np.int32)] * with_ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(fields), schema.types, strict=True)],
                schema=schema,
            )

    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(F.col(text_col)).alias("text"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return text.mapInArrow(run, kinds)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END,
    group: int = GROUP, vocabulary: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null text counts as empty: one piece that holds the end id alone. Only
    documents above capacity are cut. Ids may be null or repeat: every row of docs
    is packed. An empty table gives an empty result. vocabulary is the path of a
    tokenizer's file on the executors, by default the installed one.
    """
    made = written(pieces(docs, id_col, text_col, capacity, end, vocabulary, with_ids), "pack-pieces")
    made = made.withColumn("uid", F.monotonically_increasing_id())
    full = F.col("length") == capacity
    n = made.where(~full).count()
    alone = made.where(full).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))

    def packed(key, part: pd.DataFrame) -> pd.DataFrame:
        where, offset = place(part["length"].to_numpy(), capacity)
        return part.assign(sequence_id=(int(key[0]) << 32) + where, offset=offset)[names]

    names = [*made.columns, "sequence_id", "offset"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in alone.schema.fields)
    dealt = F.pmod(F.xxhash64("uid"), F.lit(max(1, math.ceil(n / group))))
    rest = made.where(~full).groupBy(dealt.alias("part")).applyInPandas(packed, kinds)
    return alone.unionByName(rest).drop("uid")


def op4_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
