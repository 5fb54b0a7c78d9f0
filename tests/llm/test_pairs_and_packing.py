"""SimHash, top-k, packing and personal data against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import packing, pii, simhash, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, fp string, piece int"


def plain_fingerprint(text):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, most=4):
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= most:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{v:016x}" for i, v in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == plain_components(fps)


def test_simhash_edge_cases(frame):
    rows = [(5, None, "x", 1), (4, "", None, None), (6, " \n", None, None), (7, "A b", None, None), (8, "a B", None, None), (9, "word " * 50000, None, None), (None, "a b", None, None)]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(rows, DOCS)).collect()}
    assert {got[i].component_id for i in (4, 5, 6)} == {4} and got[4].fingerprint == "0" * 16
    assert got[7].component_id == got[8].component_id == got[None].component_id == 7
    assert got[9].component_id == 9
    assert simhash.near_duplicates(frame([], DOCS)).collect() == []
    kept = simhash.near_dedup_documents(frame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "fp", "piece"] and sorted(r.doc_id for r in kept.collect()) == [4, 7, 9]


@pytest.mark.parametrize("hot", [1, 20, 512])
def test_links_find_every_pair_once(frame, hot):
    r = np.random.default_rng(3)
    base = [int(x) for x in r.integers(0, 2**63, 40)]
    fps = set(base)
    for x in base:
        for k in range(1, 7):
            y = x
            for b in r.choice(64, k, replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    # fingerprints that share a whole segment, so that its keys are hot
    signed += [int(x) << 22 | 77 for x in r.integers(-(2**41), 2**41, 60)]
    signed += [signed[-1] ^ 1 << 50, signed[-2] ^ 7 << 30, signed[-3] ^ 15 << 40, signed[-4] ^ 1]
    got = sorted(tuple(x) for x in simhash.links(frame([(x,) for x in signed], "fp long"), hot=hot).collect())
    want = sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert got == want


def test_index_of_links_is_never_broadcast(spark):
    # no value of a segment is hot, so that the plan's sizes come from the few bytes before the explode
    found = simhash.links(spark.range(300).select(F.xxhash64("id").alias("fp")))
    assert found.collect() == []
    last = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in last and "BroadcastHashJoin" not in last


def test_components_of_long_chains(frame):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (200, 199)]
    got = {r.node: r.root for r in simhash.components(frame(edges, "a long, b long")).collect()}
    assert {got.get(i, 0) for i in range(61)} == {0} and got[101] == 100 and got[200] == 199
    assert simhash.components(frame([], "a long, b long")).collect() == []


def plain_top(rows, k=5):
    out = []
    for q, v in rows.items():
        if q % 50 == 0:
            x = np.floor(256 * v.astype(float))
            scores = sorted((-int(x @ np.floor(256 * c.astype(float))), i) for i, c in rows.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, np.float32) for r in vectors.collect()}
    assert sorted(map(tuple, topk.top_k(vectors).collect())) == plain_top(rows)


def test_blocks_are_never_broadcast(spark, monkeypatch):
    # a block of vectors counts as a hundred bytes in the plan's sizes, and its copies as none
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    found = topk.top_k(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert found.count() == len(found.collect()) == 50
    last = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in last and "BroadcastHashJoin" not in last


def test_topk_edge_cases(frame):
    kind = "vec_id long, embedding array<float>, score string"
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], "x"), (50, [0.5, 0.5], None), (3, [1.0, 0.0], None), (2, [1.0, 0.0], None), (4, None, None), (5, [1.0, None], None), (6, [nan, 1.0], None), (7, [inf, 1.0], None), (None, [1.0, 1.0], None), (8, [1.0], None), (100, [1.0], None), (150, [], None)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(frame(rows, kind)).collect())
    assert got == [(0, 1, 2, 65536), (0, 2, 3, 65536), (0, 3, 50, 32768), (50, 1, 0, 32768), (50, 2, 2, 32768), (50, 3, 3, 32768), (100, 1, 8, 65536)]
    assert topk.top_k(frame([], kind)).collect() == []
    huge = topk.top_k(frame([(0, [3e30], None), (1, [2e30], None), (2, [-2e30], None)], kind)).collect()
    assert [(r.vec_id, r.score) for r in sorted(huge, key=lambda r: r.rank)] == [(1, 2**63 - 1), (2, -(2**63))]


def test_topk_of_components_beyond_the_scale(frame):
    kind = "vec_id long, embedding array<double>"
    rows = [(0, [1e306, 1.0]), (1, [1e306, 2.0]), (2, [1e-300, 3.0]), (3, [-1e306, 0.0])]
    got = topk.top_k(frame(rows, kind)).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 2**63 - 1), (2, 256 * 768), (3, -(2**63))]


def test_bounds_hold():
    r = np.random.default_rng(0)
    q, c = r.normal(0, 50, (20, 30)).round(), r.normal(5, 50, (40, 30)).round()
    for n in (1, 4, 7, 30, 64):
        assert (topk.bounds_of(q, n) @ topk.bounds_of(c, n).T >= q @ c.T - 1e-6).all()


def plain_pieces(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for doc_id, text in rows:
        ids = made.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        at = [0] + list(range(first or 1024, len(ids), 1024))
        for k, (a, b) in enumerate(zip(at, at[1:] + [len(ids)], strict=True)):
            out.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=str)


def test_packing_is_valid_and_tight(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == plain_pieces([(r.doc_id, r.text) for r in docs.collect()])
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.02 * -(-sum(r.length for r in got) // 1024) + 1


def test_packing_edge_cases(frame):
    text = "<|endoftext|> a<|endoftext|>"
    rows = [(1, None, "x", 1), (2, "", None, None), (2, "", None, None), (None, text, None, None), (4, "tok " * 3000, None, None), (5, "é" * 9000, None, None)]
    got = packing.pack(frame(rows, DOCS), with_ids=True).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == plain_pieces([r[:2] for r in rows])
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert packing.pack(frame([], DOCS)).collect() == []


def test_ids_of_long_white_space_and_words():
    made = packing.tokenizer(None)
    for text in (" " * 5000 + "a b", "x" + "\n \t" * 3000 + "y<|endoftext|> z", "é" * 9000, " \u00a0" * 5000):
        assert packing.token_ids(text) == made.encode(text, add_special_tokens=False).ids
    assert packing.token_ids(" " * 3000000 + "a")[-1] == packing.token_ids(" a")[-1]
    assert packing.token_ids("x" * 300000)


def test_local_search_empties_bins():
    bins = packing.Bins(10)
    bins.lengths = [6, 3, 5, 4, 2]
    bins.items, bins.room = [[0, 1], [2, 3], [4]], [1, 1, 8]
    bins.improve()
    assert sum(map(bool, bins.items)) == 2
    assert all(sum(bins.lengths[i] for i in x) <= 10 for x in bins.items)


def has_trade(bins, most=24):
    from itertools import combinations

    n = bins.lengths
    for d, o in ((d, o) for d, x in enumerate(bins.items) for o, y in enumerate(bins.items) if d != o and x and y):
        if not 0 < bins.room[o] <= bins.room[d] or max(len(bins.items[d]), len(bins.items[o])) > most:
            continue
        for a, b in ((1, 0), (1, 1), (1, 2), (2, 0), (2, 1)):
            for give in combinations(bins.items[d], a):
                for take in combinations(bins.items[o], b):
                    if 0 < sum(n[i] for i in give) - sum(n[i] for i in take) <= bins.room[o]:
                        return True
    return False


@pytest.mark.parametrize("low, high", [(300, 700), (100, 600), (20, 400)])
def test_local_search_ends_without_trades(low, high):
    bins = packing.Bins(1024)
    bins.best_fit(np.random.default_rng(5).integers(low, high, 900))
    bins.improve()
    assert sorted(i for x in bins.items for i in x) == list(range(900))
    assert all(1024 - sum(bins.lengths[i] for i in x) == r >= 0 for x, r in zip(bins.items, bins.room, strict=True))
    assert sum(map(bool, bins.items)) == bins.least() or not has_trade(bins)


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            fine = (
                True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True,
                12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15,
            )[kind]
            if fine:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    import random

    r = random.Random(1)
    parts = ["a", "b@", "@", ".", "c.d", "1", "23", "4.5", " ", "-", "+", "(", "%", "192.168.0.1", "4111 1111 1111 1111", "+1 (23) 4567890", "x@y.z", "é"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_base_scan_is_linear():
    pii.base_spans("a" * 300000 + "@" + "1" * 300000 + "." * 100 + "+1" + "-1" * 100000)


def test_long_numbers_and_many_contacts():
    assert pii.base_spans("1.2.3." + "0" * 10000) == [(0, 1, 10006)] and pii.base_spans("1.2.3." + "9" * 10000) == []
    line = "write to ann at example dot com, call (030) 123-4567 or mail a@b.org phone 0301 234 567\n"
    base, spans = pii.all_spans(line * 8000, pii.trained())
    assert len(base) == 8000 and len(spans) >= 24000


def test_chosen_spans_equal_a_plain_choice():
    import random

    r = random.Random(2)
    for _ in range(300):
        taken = sorted({(a := r.randint(0, 60), r.randint(0, 3), a + r.randint(1, 9)) for _ in range(3)})
        found = [(r.randint(0, 5) / 5, a := r.randint(0, 60), r.randint(0, 3), a + r.randint(1, 9)) for _ in range(8)]
        want = []
        for _, a, k, b in sorted(found, key=lambda x: (-x[0], x[1:])):
            if not any(x < b and a < y for x, _, y in [*taken, *want]):
                want.append((a, k, b))
        assert pii.best_apart(found, taken) == sorted([*taken, *want])


#: Sentences labelled by hand: what is in brackets is personal data, other numbers are none.
BY_HAND = (
    "Please reach me under [(415) 555-0132] after six.", "Our office: phone [030 123 4567], ask for Jo.", "You can mail [mary dot smith at example dot org] any time.",
    "Contact [jane.doe [at] mail [dot] com] for keys.", "The host [10[.]0[.]4[.]17] was down all night.", "Call [0171 555 0199] or write.",
    "Tel [212-555-0187] is answered by a machine.", "Invoice 2021 443 221 was paid in full.", "Order 100 200 300 went out on Monday.",
    "The score was 120 110 98 at the end.", "Version 10.2.331 fixes the bug.", "Look at the dot on the map.", "We met at noon dot by dot.", "ISBN 978 316 1484 is out of print.",
)


def test_added_spans_on_sentences_labelled_by_hand():
    model = pii.trained()
    right = wrong = missed = 0
    for sentence in BY_HAND:
        a, b = sentence.find("["), sentence.rfind("]") - 1
        text = sentence if a < 0 else sentence[:a] + sentence[a + 1 : b + 1] + sentence[b + 2 :]
        hit = [(x, y) for x, _, y in pii.all_spans(text, model)[1]]
        found = a >= 0 and any(x < b and a < y for x, y in hit)
        right, missed = right + found, missed + (a >= 0 and not found)
        wrong += sum(not (a >= 0 and x < b and a < y) for x, y in hit)
    assert right >= 5 and wrong <= 1


#: Kind (or none) that is added for a number in a sentence of a reviewer.
KINDS_BY_HAND = (
    ("card 4111.1111.1111.1111", "card"), ("Pay with 4111_1111_1111_1111 today", "card"), ("my card is 4111/1111/1111/1111.", "card"),
    ("call 030 1234567", "phone"), ("reach me at 030/1234567", "phone"), ("call me on (0221) 123456 today", "phone"), ("tel 0171 234 5678", "phone"),
    ("server 10[.]0[.]0[.]1", "ip"), ("john at mail dot com", "email"), ("invoice 4111.1111.1111.1112", None), ("article 030 1234567", None),
    ("order no 0171 2345678", None), ("page 12 3456789", None), ("version 123.456.78", None), ("in 1999 1234567 people", None),
)


def test_kinds_of_added_spans():
    model = pii.trained()
    for text, kind in KINDS_BY_HAND:
        assert [pii.KINDS[k] for _, k, _ in pii.all_spans(text, model)[1]] == [kind] * (kind is not None), text


def test_pii_rows(spark, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    for r in docs.collect():
        spans = plain_spans(r.text or "")
        own = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert set(filter(None, own.split(","))) <= set(g.spans.split(","))
    rows = [(1, None, None, None), (None, "write to ann at example dot com or x@y.org", None, None), (2, "", None, None)]
    found = {r.doc_id: r for r in pii.find_pii(frame(rows, DOCS), with_text=True).collect()}
    assert found[1].spans == "" and found[None].redacted == "write to [EMAIL] or [EMAIL]" and found[None].n_email == 1
    assert pii.find_pii(frame([], DOCS)).collect() == []


def test_added_spans_are_right_on_unseen_examples():
    model = pii.trained()
    right = wrong = missed = 0
    for text, kind, start, end, label in pii.examples(600, seed=99):
        spans = pii.all_spans(text, model)[1]
        hit = any(a < end and start < b for a, _, b in spans)
        right, wrong, missed = right + (hit and label), wrong + (hit and not label), missed + (not hit and label)
    assert right / (right + wrong) > 0.93 and right / (right + missed) > 0.6
