"""Exact dedup, mixing and URL filters against plain versions, with their edge cases."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.llm import exact_dedup, mixing, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, hash int"
ROWS = [
    (1, "a b", "en", "x", 3, "clash", 0), (2, "ab", "en", "x", 2, None, 0), (3, "a  b", "en", None, 4, None, 0),
    (4, None, None, None, None, None, 0), (5, "", "en", "y", 0, None, 0), (6, " \n", "en", "y", 2, None, 0),
    (7, "Ab", "en", "z", 2, None, 0), (7, "Ab", "en", "z", 2, None, 0), (None, "ab ", "en", "x", 3, None, 0),
    (9, "w " * 70000, "en", "x", 0, None, 0), (10, "w" * 70000, "en", "x", 0, None, 0), (11, "é\u00a0b", "fr", "x", 3, None, 0),
]


def plain_dedup(rows):
    groups = defaultdict(list)
    for r in rows:
        norm = re.sub("[\x20\x09-\x0d]", "", r[1] or "")
        groups[norm].append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    out = []
    for norm, own in groups.items():
        best = min(own)
        for x in own:
            out.append((None if x[1] else x[2], None if best[1] else best[2], len(own), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("capacity", [1, 4, 16384])
def test_exact_dedup_equals_a_plain_version(frame, capacity):
    got = exact_dedup.exact_dedup(frame(ROWS, DOCS), capacity=capacity).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain_dedup(ROWS)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}, "one row of each group stays, repeated rows too"


def test_exact_dedup_of_nothing(frame):
    assert exact_dedup.exact_dedup(frame([], DOCS)).collect() == []
    assert exact_dedup.dedup_documents(frame([], DOCS)).collect() == []


def test_dedup_documents_keeps_columns_and_one_row_a_text(frame):
    got = exact_dedup.dedup_documents(frame(ROWS, DOCS))
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    texts = [re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in got.collect()]
    assert len(texts) == len(set(texts)) == len(plain_dedup(ROWS)) - sum(n - 1 for n in (4, 3, 2, 2))


def hashed(spark, n):
    return spark.range(n).select(F.xxhash64("id").alias("hash"))


@pytest.mark.parametrize("n, capacity", [(1, 4), (500, 16), (3000, 64)])
def test_directory_doubles_until_buckets_fit(spark, n, capacity):
    slots, depth = exact_dedup.directory(hashed(spark, n), n, capacity)
    lead = {r.slot: (r.bucket, r.local_depth) for r in slots.collect()}
    held, seen = defaultdict(int), defaultdict(set)
    for r in hashed(spark, n).collect():
        s = (r.hash % 2**64) >> (64 - depth)
        held[lead[s]] += 1
        seen[lead[s]].add(s)
    assert max(held.values()) <= capacity and max(local for _, local in lead.values()) == depth
    for (_, local), own in seen.items():  # the slots of a bucket share its bits
        assert len({s >> (depth - local) for s in own}) == 1
    every = [(r.hash % 2**64) >> (64 - depth) for r in hashed(spark, n).collect()]
    for (_, local), own in seen.items():  # what was split had not fitted
        above = {s >> (depth - local + 1) for s in own}
        assert local == 0 or sum(s >> (depth - local + 1) in above for s in every) > capacity
    assert (depth == 0) == (n <= capacity)


def test_directory_of_nothing(spark):
    heavy = hashed(spark, 100).withColumn("bytes", F.lit(exact_dedup.BYTES // 10))
    found = exact_dedup.directory(heavy, 100, 10**6, 10 * exact_dedup.BYTES)[0].select("bucket").distinct().count()
    assert found >= 10  # few keys, split by the bytes that meet at them
    slots, depth = exact_dedup.directory(hashed(spark, 0), 0, 4)
    assert slots.collect() == [] and depth == 0


def test_rows_are_owned_and_found_by_bucket(frame):
    rows = [(i, f"text {i % 300}", "en", "x", 0, None, 0) for i in range(600)]
    keys, index = exact_dedup.index_of(frame(rows, DOCS), "doc_id", "text", 16, 4096)
    size = defaultdict(int)
    for r in index.collect():
        size[r.bucket] += 1
    assert sum(size.values()) == 300 and max(size.values()) <= 16 and len(size) > 300 / 16
    assert {r.bucket for r in keys.collect()} == set(size)
    files = defaultdict(set)
    for r in index.select("bucket", F.input_file_name().alias("file")).collect():
        files[r.bucket].add(r.file)
    assert all(len(x) == 1 for x in files.values()), "a bucket lies in one file"
    moved = index.withColumn("bucket", F.col("bucket") + 1)
    assert exact_dedup.found_in((keys, moved)).count() < 600, "an entry is only found in its bucket"


def test_hot_texts_are_split_and_merged(frame):
    rows = [(i, "hot" if i % 3 else f"t{i}", "en", "x", 0, None, 0) for i in range(300)]
    keys, index = exact_dedup.index_of(frame(rows, DOCS), "doc_id", "text", 16, 20)
    assert len({r.salt for r in keys.collect() if r.text_sha256 == hashlib.sha256(b"hot").hexdigest()}) == 10
    got = exact_dedup.found_in((keys, index)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain_dedup(rows)
    assert sum(r.kept for r in got) == 101


def plain_targets(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {**full, **share}
        full.update({s: cap * sizes[s] for s in over})


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    words = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in rows}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += words[r.doc_id]
    for r in got:
        assert r["size"] == words[r.doc_id] and r.taken <= 3 * r["size"] and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s, t in plain_targets(sizes).items():
        assert target[s] == pytest.approx(t)
        assert taken[s] == pytest.approx(t, rel=0.01)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)


def plain_mix(rows, key):
    """Words taken of each row (id, text, source) by the plain schedule; key gives a row's place in the shuffled order."""
    words = {r[0]: len(re.findall("[^\x20\x09-\x0d]+", r[1] or "")) for r in rows}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += words[r[0]]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target, size = plain_targets(sizes), mixing.BLOCK
    goal = {s: min(int(target[s] + 0.5), 3 * sizes[s]) for s in order}
    blocks = {s: -(-sizes[s] // size) for s in order}
    rest = {s: goal[s] % sizes[s] if sizes[s] else 0 for s in order}
    slots = {s: (goal[s] // sizes[s] if sizes[s] else 0) * blocks[s] + -(-rest[s] // size) for s in order}
    total, use, rank = sum(slots.values()), defaultdict(list), defaultdict(int)
    points = [((i * mixing.GOLDEN + mixing.TURN // 2) % mixing.TURN) / mixing.TURN for i in range(total)]
    dealt, low = [], 0
    for s in order:
        dealt += [s for p in points if low / total <= p < (low + slots[s]) / total]
        low += slots[s]
    for s in dealt + [s for s in order for _ in range(slots[s])]:
        if rank[s] < slots[s]:
            use[s, rank[s] % blocks[s]].append(rest[s] % size or size if rank[s] == slots[s] - 1 else size)
            rank[s] += 1
    taken = {}
    for s in order:
        at = 0
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: key[r[0]]):
            n = words[r[0]]
            taken[r[0]] = sum(sum((at + w) % size < part for part in use[s, (at + w) // size]) for w in range(n))
            at += n
    return taken


@pytest.mark.parametrize("first", [0, 2**32 - 3, 10**11, 10**17])
def test_points_of_far_slots_are_exact_and_even(spark, first):
    ids = range(first, first + 2000)
    got = [r.p for r in spark.range(first, first + 2000).select("id", mixing.point(F.col("id")).alias("p")).orderBy("id").collect()]
    assert got == [((i * mixing.GOLDEN + mixing.TURN // 2) % mixing.TURN) / mixing.TURN for i in ids]
    assert all(abs(sum(p < x for p in got) / len(got) - x) < 0.005 for x in (0.1, 0.25, 0.5, 0.77)) and len(set(got)) == len(got)


def test_mix_follows_the_plain_schedule(frame):
    rows = [(i, "w " * (1 + i * 7 % 50) if i % 11 else None, ("a", "b", None, "d")[min(3, i % 9)]) for i in range(90)]
    docs = frame([(i, t, None, s, 0, None, 0) for i, t, s in rows], DOCS)
    key = {r.doc_id: r.key for r in docs.select("doc_id", F.xxhash64("doc_id", "text", F.lit(0)).alias("key")).collect()}
    got = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    assert got == plain_mix(rows, key)


def test_mix_documents_on_odd_rows(frame):
    rows = [(1, "a " * 900, None, "big", 0, "k", 0), (1, "a " * 900, None, "big", 0, "k", 0), (2, "b " * 40, None, "a", 0, None, 0), (3, None, None, None, 0, None, 0), (None, "c " * 50, None, None, 0, None, 0)]
    docs = frame([r + ("x", 1) for r in rows], f"{DOCS}, mixed_id string, taken int")
    got = mixing.mix_documents(docs)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} <= {1, 2, None}
    assert mixing.mix_documents(docs.limit(0)).collect() == []


def test_mix_of_many_sources(frame):
    rows = [(i, "w " * (1 + i % 5), None, f"s{i % 500}", 0, None, 0) for i in range(2000)]
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += 1 + r[0] % 5
    want = plain_targets(sizes)
    got = mixing.mix(frame(rows, DOCS)).select("source", "target").distinct().collect()
    assert {r.source: r.target for r in got} == pytest.approx(want)


def test_blocks_of_documents_are_never_broadcast(spark):
    # 60 rows hold 37500 blocks, which the plan's sizes don't count
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 40000).alias("text"), F.lit("a").alias("source"))
    found = mixing.mix(docs)
    assert {(r.size, r.taken) for r in found.collect()} == {(40000, 40000)}
    last = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    by_block = [x for x in last.splitlines() if "Join [" in x and ", block#" in x]
    assert by_block and all("SortMergeJoin" in x for x in by_block)


def test_mix_with_nulls_caps_and_nothing(frame):
    rows = [(1, "a " * 900, None, "big", 0, None, 0), (2, "b " * 40, None, "a", 0, None, 0), (3, None, None, None, 0, None, 0), (4, "c " * 50, None, None, 0, None, 0)]
    got = {r.doc_id: r for r in mixing.mix(frame(rows, DOCS)).collect()}
    sizes = {"big": 900, "a": 40, None: 50}
    for i, s in ((1, "big"), (2, "a"), (4, None)):
        assert got[i].target == pytest.approx(plain_targets(sizes)[s])
        assert got[i].taken <= 3 * got[i]["size"]
    assert got[2].taken == pytest.approx(120, abs=2) and got[3].taken == 0
    assert mixing.mix(frame([], DOCS)).collect() == []
    assert mixing.mix(frame([(1, "", None, "s", 0, None, 0)], DOCS).limit(1)).collect()[0].taken == 0


def test_word_count_equals_the_pattern(frame):
    from tablewright.llm.common import word_count
    from pyspark.sql import functions as F

    texts = ["", " ", "a", " a", "a ", " a\t\nb\x0b", "a\u00a0b c", None, "\x1ca"]
    got = frame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in texts]


def plain_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    hit = next((r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), None)
    return host, path, hit and hit[0] + hit[1], hit and hit[2]


def test_url_verdicts_follow_the_rules(frame, spark):
    urls = [
        "http://A.Example.NET/en/1?x", "http://example.net/en", "https://net/", "http://x.net", "http://b.example.com/de/1#t",
        "http://q.org/fr/", "http://q.org/en/", None, "", "nothing", "http://www.cheap-pills.example.com/en/4", "x://y://z/",
        "http://notexample.com/de/", "http://h.org?u=http://net/", "http://h.org/a\nb",
    ]
    pages = frame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if got[i].score >= 0.5 else "allow"))
    assert got[10].verdict == "block"
    assert url_filter.url_verdicts(frame([], "page_id long, url string")).collect() == []


def test_dedup_documents_with_names_of_its_own(frame):
    rows = [(1, "a b", "l", "s", 1, "x", "y"), (2, "ab", "l", "s", 1, "x", "y")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_key string, text_key_k string"
    got = exact_dedup.dedup_documents(frame(rows, schema)).collect()
    assert [r.doc_id for r in got] == [1]


def auc(scores, labels):
    pairs = [(p > q) + 0.5 * (p == q) for p, v in zip(scores, labels, strict=True) if v for q, w in zip(scores, labels, strict=True) if not w]
    return sum(pairs) / len(pairs)


def test_url_model_on_held_out_urls(frame):
    rows = url_filter.labelled_urls()
    hosts = [plain_rule(u)[0] for u, _ in rows]
    assert len(set(hosts)) == len(rows) > 1000 and sum(v for _, v in rows) == len(rows) / 2
    held = [i for i in range(len(rows)) if int(hashlib.md5(hosts[i].encode()).hexdigest(), 16) % 4 == 0]
    training = frame([r for i, r in enumerate(rows) if i not in set(held)], "url string, label double")
    pages = frame([(i, rows[i][0]) for i in held], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages, rules=(), training=training).collect()}
    score = {i: got[i].score for i in held}
    assert auc([score[i] for i in held], [rows[i][1] for i in held]) > 0.97
    # of ordinary and invented hosts alone, only the path tells
    own = [i for i in held if not any(w in hosts[i] for w in url_filter.BAD_HOSTS)]
    assert auc([score[i] for i in own], [rows[i][1] for i in own]) > 0.95


def test_url_model_on_urls_of_other_make(frame):
    bad = ["http://mega-casino.example.org/", "http://pillshop.co.uk/en/1", "http://blog.village.net/buy-pills/2", "http://spamlinks.example.net/a"]
    good = ["http://thorne.example.org/", "http://village-library.example.com/x", "http://blog.village.net/essays/2", None, "no url"]
    long = "http://h.example.com/" + "a/b" * 30000
    rows = [*enumerate([*bad, *good, long]), (None, bad[0]), (None, bad[0])]
    got = url_filter.url_verdicts(frame([r + ("x", 2) for r in rows], "page_id long, url string, score string, grams int"), rules=()).collect()
    score = {r.page_id: r.score for r in got if r.page_id is not None}
    assert len(got) == len(rows) and min(score[i] for i in range(4)) > max(score[i] for i in range(4, 9))
    assert [r.verdict for r in got if r.page_id is None] == ["block"] * 2


def test_native_plans_hold_no_python(spark):
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages"))
    for df in (exact_dedup.exact_dedup(docs), mixing.mix(docs), url_filter.url_verdicts(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
