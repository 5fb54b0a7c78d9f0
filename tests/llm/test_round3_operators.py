"""Whitening, removal of repeats and the filter audit against plain versions."""

import hashlib
import random
from collections import Counter
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest

from tablewright.llm import filter_audit, suffix_dedup, url_filter, urls_labelled, whitening
from tests.llm.conftest import DOCS

SF = "/root/testdata/sf0.001"


# whitening


def plain_covariance(x):
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = [[Fraction(v) - Fraction(s, n) for v, s in zip(r, sums, strict=True)] for r in x]
    k = len(sums)
    return n, sums, d, [[float(sum(r[i] * r[j] for r in d) / n) for j in range(k)] for i in range(k)]


def test_outer_sums_are_exact_where_doubles_cancel():
    r = random.Random(1)
    x = np.array([[10**12 + r.randint(-3, 3), -(10**9) + r.randint(-5, 5), r.randint(0, 1)] for _ in range(3000)])
    n, sums, _, want = plain_covariance(x.tolist())
    fit = whitening.Fit(n, sums)
    high, low = whitening.outer_sums(*whitening.centred(x.astype(float), fit.high, fit.low))
    assert np.allclose(high / n + low / n, want, rtol=1e-15, atol=1e-18)


def test_whitening_equals_exact_arithmetic(frame):
    r = random.Random(2)
    base = [[r.gauss(0, 1) * (1 + j) for j in range(5)] for _ in range(300)]
    rows = [(i, [float(v) for v in b], "x") for i, b in enumerate(base)]
    odd = [(900, None, "x"), (901, [1.0, None, 2.0, 3.0, 4.0], "x"), (902, [float("nan")] * 5, "x"), (903, [float("inf")] * 5, "x"), (904, [], "x")]
    rows += [(None, rows[3][1], "x"), (7, rows[7][1], "x")]
    df = frame(rows + odd, "vec_id long, embedding array<double>, whitened string").repartition(6)
    got = whitening.whiten(df).collect()
    x = [[int(np.floor(64 * v)) + 1000000 for v in row[1]] for row in rows]
    n, sums, d, cov = plain_covariance(x)
    values, vectors = np.linalg.eigh(np.array(cov))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == len(rows) * 5 and {g.n for g in got} == {n}
    assert max(g.identity_error for g in got) < 1e-9
    white = np.array([[float(v) for v in row] for row in d]) @ vectors / np.sqrt(values)
    by = {(g.vec_id, g.component): g for g in got}
    for k in range(5):
        own = np.array([by[(row[0], k + 1)].whitened for row in rows])
        assert np.allclose(own * np.sign(own @ white[:, k]), white[:, k], atol=1e-9)
        assert abs(by[(0, k + 1)].explained - values[k] / values.sum()) < 1e-12
    for row, own in zip(rows, x, strict=True):
        assert by[(row[0], 1)].deviation == sum((n * v - s) ** 2 for v, s in zip(own, sums, strict=True))


def test_whitening_of_few_flat_and_uneven_vectors(frame):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(frame([], schema)).collect() == []
    got = whitening.whiten(frame([(1, [1.0, 2.0])], schema)).collect()
    assert [(g.component, g.deviation, g.whitened, g.explained, g.identity_error) for g in got] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    got = whitening.whiten(frame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [9.0])], schema)).collect()
    by = {(g.vec_id, g.component): g for g in got}
    assert abs(abs(by[(1, 1)].whitened) - 1) < 1e-12 and by[(1, 2)].whitened is None and by[(3, 1)].n == 1
    assert by[(1, 1)].explained == 1 and by[(1, 2)].explained == 0
    huge = whitening.whiten(frame([(1, [1e30]), (2, [-1e30])], schema)).collect()
    assert [g.deviation for g in huge] == [2**63 - 1] * 2


def test_whitening_returns_32_of_more_components(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = whitening.op11_whitening(spark, SF)
    first = got.where("component = 1").collect()
    assert got.count() == 32 * len(first) == 32 * df.where("embedding IS NOT NULL").count()
    assert max(g.identity_error for g in first) < 1e-6


# repeats


def plain_repeats(texts, length):
    """(bytes, removed, spans, sha) of each text, by looking at every window."""
    found = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if found[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def made_texts(seed):
    r = random.Random(seed)

    def word():
        return "".join(r.choice("abcdefgh é") for _ in range(r.randint(2, 9)))

    passages = [" ".join(word() for _ in range(r.choice([60, 80, 100, 300]))) for _ in range(6)]
    texts = [None, "", passages[3], passages[3], passages[3] * 2]
    for _ in range(90):
        t = ""
        for _ in range(r.randint(0, 5)):
            k = r.random()
            if k < 0.45:
                p = r.choice(passages)
                a = r.randint(0, len(p) // 3)
                t += p[a : a + r.randint(300, len(p))]
            elif k < 0.8:
                t += " ".join(word() for _ in range(r.randint(1, 120)))
            else:
                t += r.choice(["a", " ", "\0", "abc "]) * r.randint(1, 900)
        texts.append(t)
    return texts


@pytest.mark.parametrize("seed,length,hot,chunk", [(0, 400, 512, 1 << 20), (1, 400, 3, 1 << 20), (2, 100, 5, 1 << 20), (3, 400, 512, 700), (4, 60, 4, 500)])
def test_repeats_equal_brute_force(frame, monkeypatch, seed, length, hot, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    texts = made_texts(seed)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = frame(rows, "doc_id long, text string, key string").repartition(5)
    got = {g.doc_id: g for g in suffix_dedup.remove_repeats(df, length=length, hot=hot).collect()}
    want = plain_repeats([(t or "").encode() for t in texts], length)
    assert len(got) == len(texts) and sum(w[1] for w in want) > 0
    for i, w in enumerate(want):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == w
        assert sum(s.end - s.start for s in got[i].spans) == w[1]


def test_sections_hold_each_window_once_and_equal_windows_alike():
    r = random.Random(5)
    part = bytes(r.choice(b"abcd ") for _ in range(900))
    texts = [part[100:], part[:700], b"x" * 650, bytes(r.choice(b"abcd ") for _ in range(1000)), b"short"]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    seen, anchors = set(), {}
    for text, start, windows, place, anchor in zip(*suffix_dedup.sections(data, ends), strict=True):
        for w in range(windows):
            assert (text, start + w) not in seen and 0 <= place - w < 400
            seen.add((text, start + w))
            window = texts[text][start + w : start + w + 400]
            assert anchors.setdefault(window, (int(anchor), int(place - w))) == (int(anchor), int(place - w))
    assert len(seen) == sum(max(0, len(t) - 399) for t in texts)


def test_repeats_of_odd_tables(frame):
    assert suffix_dedup.remove_repeats(frame([], DOCS)).collect() == []
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(3000))
    rows = [(1, long, "l", "s", 1), (1, long, "l", "s", 1), (None, "y" + long[500:1000], None, None, None), (2, long[:399], "l", "s", 1)]
    got = sorted(suffix_dedup.remove_repeats(frame(rows, DOCS)).collect(), key=str)
    want = plain_repeats([(r[1] or "").encode() for r in rows], 400)
    assert sorted((g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == sorted(want)


# filter audit


def plain_mask(text):
    words = [w for w in text.translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    fails = ""
    fails += "A" if len(words) < 100 else ""
    fails += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    fails += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else ""
    return fails + ("D" if set(text) & set("#$%&*|") else "")


def plain_audit(rows, labels):
    smallest = {}
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    docs = []
    for i, text, lang in rows:
        late = i is not None and i > smallest[text or ""]
        own = [v for v in labels if v[0] == i and i is not None]
        docs.append((lang or "", plain_mask(text or "") + "E" * late, any(v[1] == 1 for v in own), any(v[2] == 1 for v in own)))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        turns = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                turns[f] += len(gone)
                earlier = sum(f in d[1] and any(e in d[1] for e in order[: step - 1]) for d in own)
                out[(part, "".join(order), step)] = [len(left), len(gone), earlier, sum(d[1] == f for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(turns[order[step - 1]])
    return out


def audit_rows(seed):
    r = random.Random(seed)
    rows = []
    for i in range(120):
        words = [r.choice(["Ab", "über", "XYZ", "a$b", "q", "wörd%d" % r.randint(0, 80)]) for _ in range(r.choice([0, 5, 99, 100, 150]))]
        if r.random() < 0.5:
            words = ["w%d" % j for j in range(len(words))]
        rows.append((i, r.choice([" ", "\t\n", "\x0b", "  "]).join(words), r.choice(["en", "de", None])))
    rows += [(200 + i, rows[i][1], "en") for i in range(10)] + [(3, rows[3][1], "fr"), (None, rows[4][1], "en"), (None, None, None), (5, None, "en"), (500, "", "en")]
    return rows


def test_audit_equals_brute_force(frame):
    rows = audit_rows(1)
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 130, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (6, None, None)]
    docs = frame([(*r, "x") for r in rows], "doc_id long, text string, lang string, mask string").repartition(4)
    got = filter_audit.audit(docs, frame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(g.part, g.filter_order, g.step): [g[n] for n in names] for g in got} == plain_audit(rows, labels)
    assert filter_audit.audit(frame([], DOCS), frame([], "doc_id long, quality int, toxic int")).collect() == []


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_scan_of_bytes(monkeypatch, chunk):
    monkeypatch.setattr(filter_audit, "CHUNK", chunk)
    texts = [r[1] or "" for r in audit_rows(2)] + ["x" * 500, " " * 300, "end", "next", "", "ä" * 40 + " " + "ä" * 40]
    raw = [t.encode() for t in texts]
    got = filter_audit.scanned(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, t in enumerate(texts):
        words = [w for w in t.translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]
        want = (len(words), len(set(words)), sum("A" <= c <= "Z" for c in t), sum(c in "#$%&*|" for c in t), len(t))
        assert tuple(int(got[k][i]) for k in ("words", "distinct", "capitals", "signs", "points")) == want


def test_words_of_equal_hash_are_told_apart():
    data = np.frombuffer(b"aa bb aa cc bb", np.uint8)
    starts, ends = filter_audit.words_of(data)
    same = np.zeros(len(starts), np.uint64)
    assert filter_audit.distinct_words(data, np.zeros(5, int), starts, ends, same, 1).tolist() == [3]


def test_audit_equals_its_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = filter_audit.op13_filter_audit(spark, SF)
    want = db.execute(filter_audit.SQL)
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(want.fetchall())


# urls


def test_url_model_on_well_known_and_invented_urls(frame):
    bad = [
        "http://mega-casino.example.org/", "http://pillshop.co.uk/en/1", "http://spamlinks.example.net/a", "https://pornhub.com/", "http://bet365.com/en/",
        "https://cheapviagra.biz/", "https://www.slots4free.net/", "https://mybetting.tips/", "http://warezdownload.ru/", "https://online-poker.example.fr/de/2",
    ]
    good = [
        "https://docs.python.org/3/library/re.html", "http://thorne.example.org/", "https://www.sussex.ac.uk/", "https://essexlibrary.org/",
        "https://www.heise.de/news/1", "http://www.monet.fr/peintures", "https://en.wikipedia.org/wiki/Poker_hand", "http://karlsruhe.de/rathaus", "no url",
    ]
    pages = frame(list(enumerate(bad + good)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.url_verdicts(pages, rules=()).collect()}
    assert [got[i] for i in range(len(bad + good))] == ["block"] * len(bad) + ["allow"] * len(good)


def test_url_model_without_a_kind_ranks_that_kind(frame):
    """Kinds of urls that training never saw: unwanted ones score higher than ordinary ones."""
    kinds = urls_labelled.kinds()
    scores = {0.0: [], 1.0: []}
    for kind in ("medicine 1", "adverts 1", "loans and tricks 1", "news 0", "public 0", "small sites 0"):
        training = frame(url_filter.training_urls(kind), "url string, label double").coalesce(1)
        pages = frame([(i, u) for i, (u, _) in enumerate(kinds[kind])], "page_id long, url string")
        got = url_filter.url_verdicts(pages, rules=(), training=training).collect()
        scores[kinds[kind][0][1]] += [r.score for r in got]
    pairs = [p > q for p in scores[1.0] for q in scores[0.0]]
    assert sum(pairs) / len(pairs) > 0.85
