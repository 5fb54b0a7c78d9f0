"""Removal of long repeated byte strings by prefix-free parsing.

Parsing. A rolling hash of WIDTH bytes is a trigger where it falls in one of RATE
classes. A phrase runs from one trigger to the end of the next, so neighbouring phrases
share a trigger and equal stretches of text are cut into equal phrases. A window (LENGTH
bytes) holds some whole phrases; its anchor is the longest of them, then the one of the
greater hash, then the first; where it holds none, the first smallest rolling hash. Equal
windows have equal anchors in the same place. Neighbouring windows mostly share their
anchor, so a text becomes a short list of sections: runs of windows with one anchor.

Dictionary. Sections are named by a 128-bit digest and counted by anchor. An anchor that
occurs once has no equal window anywhere, which settles most text that doesn't repeat;
a section that occurs twice is repeated as a whole, which settles the inside of copies.
Neither step sees any text but what it parses, nor does it compare texts pair by pair.

Order. What is left are anchors with different sections, the ends of repeats. One section
of each kind is cut from its text and sorted twice in a task that owns the anchor: by the
bytes before the anchor read backwards (the suffixes of the dictionary's side) and by the
bytes from the anchor on (those of the parse). Common prefixes of neighbours turn each
order into classes at every depth; a window is a pair of such classes, and pairs that occur
twice are repeated windows. So the two orders combine into that of the corpus at the
anchors, cut at depth LENGTH, which is all that the question needs; no suffix array of the
whole corpus is made.

Hot anchors. The sections of an anchor that has more than HOT of them are dealt to
several tasks. Each of them packs its classes by a digest of the window into as many
buckets as there are such tasks, and a task for each bucket finds the digests that two packs hold.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import body, table, written

#: Bytes of a repeated string; of a trigger, and one of how many hashes is one.
LENGTH, WIDTH, RATE = 400, 12, 32

#: Bytes (and windows of a long text) that are parsed at a time.
CHUNK = 1 << 18

#: Sections that a task sorts together, and of one anchor at most.
HOT = 512

_VALUE = np.random.default_rng(12).integers(0, 2**64, 256, np.uint64, endpoint=False)
_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse (modulo 2**64), n at least; kept for the next chunk."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        n = max(n, CHUNK + 2 * LENGTH)
        up, down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, x, np.uint64))]) for x in (_ODD, pow(_ODD, -1, 2**64)))
        _POWERS[0] = up, down
    return _POWERS[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The numbers' bits stirred, in place."""
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= _MIX
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of all slices of some bytes from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.powers = _powers(len(data) + 1)
        terms = _VALUE[data] * self.powers[0][: len(data)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def runs(self, width: int) -> np.ndarray:
        """The hashes of all slices of this width."""
        return _mixed((self.sums[width:] - self.sums[:-width]) * self.powers[1][: len(self.sums) - width])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.powers[1][starts])


def greatest(rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of the greatest of the different numbers rank[a[i]..b[i]], for each i."""
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    levels, width = [rank], 1
    most = int((b - a + 1).max(initial=1))
    while 2 * width <= most:
        last = levels[-1]
        levels.append(np.maximum(last[:-width], last[width:]))
        width *= 2
    level = np.floor(np.log2(b - a + 1)).astype(int)
    out = np.empty(len(a), np.int64)
    for k, held in enumerate(levels):
        own = level == k
        out[own] = np.maximum(held[a[own]], held[b[own] - (1 << k) + 1])
    return place[out]


def smallest_ahead(values: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Place of the first smallest of values[p : p + span], for each p of starts."""
    view = np.lib.stride_tricks.sliding_window_view(values, span)
    return np.concatenate([p + view[p].argmin(1) for p in np.array_split(starts, len(starts) // 2048 + 1)])


def sections(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, start, windows, place, anchor) of the sections of the texts data[offsets[i]:offsets[i + 1]].

    start counts from the text's own begin, place is the anchor's distance from start, anchor its hash.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    size = np.diff(offsets)
    if not (size >= length).any():
        return none
    rolling = Rolling(data)
    grams = rolling.runs(WIDTH)
    at = np.flatnonzero(grams < np.uint64(2**64 // RATE))
    text = np.searchsorted(offsets, at, "right") - 1
    keep = at + WIDTH <= offsets[text + 1]
    at, text = at[keep], text[keep]
    both = np.flatnonzero(text[1:] == text[:-1])
    starts, ends = at[both], at[both + 1] + WIDTH

    # the phrases that a window holds change after a phrase's start and before a phrase's end
    own = np.flatnonzero(size >= length)
    turns = np.unique(np.concatenate([offsets[own], starts + 1, ends - length]))
    turns = turns[turns >= 0]
    text = np.searchsorted(offsets, turns, "right") - 1
    last = offsets[1:] - length  # the last window of each text
    turns, text = (x[turns <= last[np.minimum(text, len(size) - 1)]] for x in (turns, text))
    until = np.minimum(np.append(turns[1:], np.iinfo(np.int64).max), last[text] + 1)

    a, b = np.searchsorted(starts, turns), np.searchsorted(ends, turns + length, "right") - 1
    some = b >= a
    pick, hashed = np.zeros(len(turns), np.int64), np.zeros(len(turns), np.uint64)
    if some.any():
        phrase = rolling.of(starts, ends)
        rank = np.empty(len(starts), np.int64)
        rank[np.lexsort((-starts, phrase, ends - starts))] = np.arange(len(starts))
        best = greatest(rank, a[some], b[some])
        pick[some], hashed[some] = starts[best], phrase[best]
    bare = np.flatnonzero(~some)
    if len(bare):  # windows without a phrase are looked at one by one
        each = np.concatenate([np.arange(turns[i], until[i]) for i in bare])
        first = smallest_ahead(grams, each, length - WIDTH + 1)
        turns, until = np.concatenate([turns[some], each]), np.concatenate([until[some], each + 1])
        text = np.concatenate([text[some], np.searchsorted(offsets, each, "right") - 1])
        pick, hashed = np.concatenate([pick[some], first]), np.concatenate([hashed[some], grams[first] ^ _MIX])
        order = np.argsort(turns)
        turns, until, text, pick, hashed = (x[order] for x in (turns, until, text, pick, hashed))
    new = np.append(True, (turns[1:] != until[:-1]) | (pick[1:] != pick[:-1]) | (hashed[1:] != hashed[:-1]) | (text[1:] != text[:-1]))
    head = np.flatnonzero(new)
    start, end = turns[head], until[np.append(head[1:], len(turns)) - 1]
    return text[head], start - offsets[text[head]], end - start, pick[head] - start, hashed[head]


def pieces(texts: list[bytes], length: int = LENGTH):
    """Groups of (index, offset, bytes) of about CHUNK bytes; a long text comes in pieces that share length - 1 bytes."""
    group, held = [], 0
    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text) - length + 1), CHUNK):
            piece = text[a : a + CHUNK + length - 1] if len(text) > CHUNK else text
            if group and held + len(piece) > CHUNK:
                yield group
                group, held = [], 0
            group.append((i, a, piece))
            held += len(piece)
    if group:
        yield group


def parsed(keys: list[bytes], texts: list[bytes], times: np.ndarray, length: int = LENGTH) -> pd.DataFrame:
    """anchor, digest, n, key, start, windows, place: the sections of texts, each text with how often it occurs.

    Sections that already repeat here come once, and as rows without an anchor that say where they are.
    """
    found = []
    for group in pieces(texts, length):
        data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(p) for _, _, p in group])])
        where, start, windows, place, anchor = sections(data, offsets, length)
        whole = memoryview(data)
        begin = start + offsets[where]
        digests = [hashlib.blake2b(whole[s : s + m + length - 1], digest_size=16).digest() for s, m in zip(begin.tolist(), windows.tolist(), strict=True)]
        index, offset = (np.array([p[k] for p in group])[where] for k in (0, 1))
        found.append(pd.DataFrame({"anchor": anchor.view(np.int64), "digest": digests, "text": index, "start": start + offset, "windows": windows, "place": place}))
    rows = pd.concat(found, ignore_index=True) if found else pd.DataFrame({c: [] for c in ("anchor", "digest", "text", "start", "windows", "place")})
    rows["n"] = times[rows["text"].to_numpy(int)]
    group = rows.groupby(["anchor", "digest"], sort=False)["n"]
    rows["n"] = group.transform("sum")
    sure = rows[rows["n"] > 1].sort_values(["text", "start"])
    run = ((sure["text"] != sure["text"].shift()) | (sure["start"] != (sure["start"] + sure["windows"]).shift())).cumsum()
    sure = sure.groupby(run, sort=False).agg(text=("text", "first"), start=("start", "first"), windows=("windows", "sum"))
    out = pd.concat([rows.drop_duplicates(["anchor", "digest"]), sure.assign(anchor=None, digest=None, n=2, place=0)], ignore_index=True)
    out["key"] = [keys[i] for i in out["text"].astype(int)]
    return out[["anchor", "digest", "n", "key", "start", "windows", "place"]].astype({"anchor": "Int64"})


def depths(sorted_texts: list[bytes], apart: np.ndarray) -> np.ndarray:
    """Common prefix of each text with the one before it; -1 for the first and where apart says so."""
    n, size = len(sorted_texts), np.array([len(t) for t in sorted_texts])
    width = int(size.max(initial=1)) or 1
    held = np.zeros((n, width), np.uint8)
    for i, t in enumerate(sorted_texts):
        held[i, : len(t)] = np.frombuffer(t, np.uint8)
    differ = held[1:] != held[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width) if n > 1 else np.zeros(0, int)
    out = np.append(-1, np.minimum(common, np.minimum(size[1:], size[:-1])))
    out[1:][apart] = -1
    return out


def classes(texts: list[bytes], anchors: np.ndarray, depth: int) -> np.ndarray:
    """A matrix: at [d, i] the class of text i by anchor and its first d bytes, for each d to depth."""
    order = np.array(sorted(range(len(texts)), key=lambda i: (anchors[i], texts[i])), int)
    common = depths([texts[i] for i in order], anchors[order][1:] != anchors[order][:-1])
    out = np.empty((depth + 1, len(texts)), np.int32)
    for d in range(depth + 1):
        out[d, order] = np.cumsum(common < d)
    return out


def window_classes(anchors: np.ndarray, windows: np.ndarray, place: np.ndarray, texts: list[bytes], length: int = LENGTH):
    """(section, window, class) of every window of some sections; windows are equal if their classes are."""
    before = classes([t[p - 1 :: -1] if p else b"" for t, p in zip(texts, place.tolist(), strict=True)], anchors, length)
    behind = classes([t[p : p + length] for t, p in zip(texts, place.tolist(), strict=True)], anchors, length)
    section = np.repeat(np.arange(len(texts)), windows)
    window = np.arange(len(section)) - np.repeat(np.cumsum(windows) - windows, windows)
    left = place[section] - window  # bytes of the window before its anchor
    n = len(texts) + 1
    return section, window, (left * n + before[left, section]) * n + behind[length - left, section]


_FOUND = "key binary, start int, windows int, bucket int, digests binary, single binary, keys binary, starts binary"


def compared(part: pd.DataFrame, buckets: int, length: int = LENGTH) -> pd.DataFrame:
    """Runs of repeated windows of the sections in part that occur once; of hot anchors also the classes of windows.

    part: anchor, n, hot, key, start, windows, place and text. A row with a bucket packs the
    classes whose digests fall in it: digest, whether it is a single window, and that
    window's key and start.
    """
    part = part.sort_values(["anchor", "key", "start"]).reset_index(drop=True)
    texts = list(part["text"])
    windows, place = part["windows"].to_numpy(int), part["place"].to_numpy(int)
    section, window, named = window_classes(part["anchor"].to_numpy(), windows, place, texts, length)
    _, first, of, count = np.unique(named, return_index=True, return_inverse=True, return_counts=True)
    n, keys, start = part["n"].to_numpy(), part["key"].to_numpy(), part["start"].to_numpy(int)
    again = (count[of] > 1) & (n[section] == 1)
    edge = np.flatnonzero(again & ~np.append(False, again[:-1] & (section[1:] == section[:-1])))
    stop = np.flatnonzero(again & ~np.append(again[1:] & (section[1:] == section[:-1]), False))
    rows = [
        (keys[s], int(start[s] + w), int(m), None, None, None, None, None)
        for s, w, m in zip(section[edge].tolist(), window[edge].tolist(), (stop - edge + 1).tolist(), strict=True)
    ]
    one = first[part["hot"].to_numpy(bool)[section[first]]]
    if len(one):
        cut = [hashlib.blake2b(texts[s][w : w + length], digest_size=16).digest() for s, w in zip(section[one].tolist(), window[one].tolist(), strict=True)]
        single = ((count[of[one]] == 1) & (n[section[one]] == 1)).astype(np.uint8)
        at = (start[section[one]] + window[one]).astype(np.int32)
        bucket = np.frombuffer(b"".join(cut), np.uint32)[::4] % np.uint32(buckets)
        for b, own in pd.Series(np.arange(len(one))).groupby(bucket):
            own = own.to_numpy()
            packed = b"".join(cut[i] for i in own), single[own].tobytes(), b"".join(keys[section[one[i]]] for i in own), at[own].tobytes()
            rows.append((None, None, None, int(b), *packed))
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")])
    return out.astype({c: "Int64" for c in ("start", "windows", "bucket")})


def met(part: pd.DataFrame) -> pd.DataFrame:
    """key, start and windows (1) of the single windows whose class another task holds, too; part packs the classes of a bucket."""
    digest, key = (np.frombuffer(b"".join(part[c]), "V16") for c in ("digests", "keys"))
    single, start = np.frombuffer(b"".join(part["single"]), bool), np.frombuffer(b"".join(part["starts"]), np.int32)
    words = digest.view(np.uint64).reshape(-1, 2)
    order = np.lexsort((words[:, 1], words[:, 0]))
    same = (words[order][1:] == words[order][:-1]).all(1)
    own = order[(np.append(False, same) | np.append(same, False)) & single[order]]
    return pd.DataFrame({"key": [key[i].tobytes() for i in own], "start": start[own], "windows": 1})


def covered(ranges, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows cover, from (start, windows) pairs."""
    out: list[list[int]] = []
    for start, windows in sorted(ranges):
        end = start + windows - 1 + length
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """key, text, ranges: each text that holds a repeated window, once, with (start, windows) of those.

    key is the first half of the text's SHA-256; a text is everything that rows with the same key share.
    """
    text = body(F.col(text_col)).cast("binary")
    rows = docs.select(_key(F.sha2(text, 256)).alias("key"), text.alias("text")).where(F.octet_length("text") >= length)

    def parse(batches):
        for part in batches:
            part = part.assign(times=part.groupby("key")["text"].transform("size")).drop_duplicates("key")
            for a in range(0, len(part), 256):
                own = part.iloc[a : a + 256]
                yield parsed(list(own["key"]), list(own["text"]), own["times"].to_numpy(), length)

    schema = "anchor long, digest binary, n long, key binary, start int, windows int, place int"
    made = written(rows.mapInPandas(parse, schema), "repeats-sections")
    kinds = made.where(F.col("anchor").isNotNull())
    again = kinds.groupBy(F.col("anchor").alias("a")).agg(F.sum("n").alias("total")).where("total > 1").select("a")
    kinds = written(kinds.join(again, F.col("anchor") == F.col("a")).drop("a"), "repeats-kinds")

    first = F.min(F.struct("key", "start", "windows", "place")).alias("first")
    counted = written(kinds.groupBy("anchor", "digest").agg(F.sum("n").alias("n"), first), "repeats-counted")
    many = counted.where("n > 1").select(F.col("anchor").alias("a"), F.col("digest").alias("d"))
    sure = kinds.join(many, (F.col("anchor") == F.col("a")) & (F.col("digest") == F.col("d"))).select("key", "start", "windows")
    sure = sure.unionByName(made.where(F.col("anchor").isNull()).select("key", "start", "windows"))

    forms = counted.groupBy(F.col("anchor").alias("a")).agg(F.count("*").alias("forms"), F.sum((F.col("n") == 1).cast("long")).alias("open"))
    forms = forms.where("forms > 1 AND open > 0")
    cut = counted.join(forms, F.col("anchor") == F.col("a")).select("anchor", "n", "forms", "first.*")
    cut = written(cut, "repeats-open")
    share = F.ceil(F.col("forms") / hot)
    deal = F.pmod(F.xxhash64("key", "start"), share)
    cut = cut.select("key", F.struct("anchor", "n", (share > 1).alias("hot"), F.when(share > 1, deal).otherwise(0).alias("deal"), "start", "windows", "place").alias("cut"))

    wanted = cut.groupBy("key").agg(F.collect_list("cut").alias("cuts"))
    ranges = sure.distinct().groupBy("key").agg(F.collect_list(F.struct("start", "windows")).alias("sure"))
    info = wanted.join(ranges, "key", "full").withColumnRenamed("key", "k")
    touched = rows.groupBy("key").agg(F.first("text").alias("text")).join(info, F.col("key") == F.col("k")).drop("k")
    touched = written(touched, "repeats-touched")

    def snippets(batches):
        for part in batches:
            out = [
                (c["anchor"], c["n"], c["hot"], c["deal"], key, c["start"], c["windows"], c["place"], text[c["start"] : c["start"] + c["windows"] + length - 1])
                for key, text, cuts in zip(part["key"], part["text"], part["cuts"], strict=True)
                for c in cuts
            ]
            for a in range(0, len(out), 4096):
                yield pd.DataFrame(out[a : a + 4096], columns=["anchor", "n", "hot", "deal", "key", "start", "windows", "place", "text"])

    # hot anchors are named with their deal; the others are dealt in groups of about as many sections
    groups = max(1, math.ceil(cut.count() / hot))
    cuts = touched.where(F.col("cuts").isNotNull()).select("key", "text", "cuts")
    cuts = cuts.mapInPandas(snippets, "anchor long, n long, hot boolean, deal long, key binary, start int, windows int, place int, text binary")
    task = F.when(F.col("hot"), F.xxhash64("anchor", "deal")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(groups)))
    found = cuts.groupBy(task.alias("task")).applyInPandas(lambda part: compared(part, groups, length), _FOUND)
    found = written(found, "repeats-found")

    across = found.where(F.col("bucket").isNotNull()).select("bucket", "digests", "single", "keys", "starts")
    across = across.groupBy("bucket").applyInPandas(met, "key binary, start int, windows int")
    more = found.where(F.col("bucket").isNull()).select("key", "start", "windows").unionByName(across)
    more = more.groupBy("key").agg(F.collect_list(F.struct("start", "windows")).alias("more")).withColumnRenamed("key", "k")
    none = F.array().cast("array<struct<start:int,windows:int>>")
    settled = touched.where(F.col("cuts").isNull()).select("key", "text", F.col("sure").alias("ranges"))
    rest = touched.where(F.col("cuts").isNotNull()).join(more, F.col("key") == F.col("k"), "left")
    rest = rest.select("key", "text", F.concat(F.coalesce("sure", none), F.coalesce("more", none)).alias("ranges"))
    return settled.unionByName(rest).where(F.size("ranges") > 0)


def _key(sha):
    return F.unhex(F.substring(sha, 1, 32))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT
) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes' spans.

    Every byte goes that is covered by a string of length bytes which also starts
    anywhere else, in the same text or another. A null text counts as empty; texts
    shorter than length keep everything. Ids may be null or repeat; rows with the same
    text are copies of each other and lose all their windows. Long texts are parsed
    piece by piece. An empty table gives an empty result. Other columns are ignored.
    """
    found = repeats(docs, text_col, length, hot)

    def cut(batches):
        for part in batches:
            out = []
            for key, text, ranges in zip(part["key"], part["text"], part["ranges"], strict=True):
                runs = covered([(r["start"], r["windows"]) for r in ranges], length)
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out.append((key, sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [{"start": a, "end": b} for a, b in runs]))
            yield pd.DataFrame(out, columns=["k", "gone", "runs", "sha", "spans"])

    cuts = found.mapInPandas(cut, "k binary, gone long, runs long, sha string, spans array<struct<start:long,end:long>>")
    text = body(F.col(text_col)).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    rows = rows.join(cuts, _key(F.col("whole")) == F.col("k"), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return rows.select(
        "doc_id", "n_bytes", F.coalesce("gone", F.lit(0)).alias("n_removed"), F.coalesce("runs", F.lit(0)).alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"), spans.alias("spans"),
    )


def op12_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
