"""The whole plan on small pages, with statuses and numbers worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tablewright.operators import export, outbox
from tablewright.plans import batch
from tablewright.sources import files, requests, sinks
from tablewright.streaming.requests import run_uploads, stream_uploads

TOPS = "\n".join(
    ["# Men's tops size guide", "", "| Size | Chest (cm) | Waist (cm) | Hips (cm) |", "| --- | --- | --- | --- |"]
    + [f"| {s} | {80 + 4 * i}-{84 + 4 * i} | {70 + 4 * i} | {85 + 4 * i} |" for i, s in enumerate(["XS", "S", "M", "L", "XL", "2XL", "3XL"])]
)
NUMERIC = "\n".join(["# Tops", "", "| Size | Chest (cm) | Waist (cm) |", "|---|---|---|"] + [f"| {n} | {n + 60} | {n + 40} |" for n in (34, 36, 38, 40)])
HUB = '<html><body><h1>Help</h1><a href="/size-guide/men-tops">Men\'s tops size guide</a> <a href="/size-guide/women">Women size guide</a></body></html>'
DEAD = "<html><body><h1>Page not found</h1><p>Our size guide</p></body></html>"
EMPTY = "# Men's tops size guide\n\n| Size | Chest (cm) | Waist (cm) |\n|---|---|---|\n| S | ask | us |\n| M | ask | us |"
SHOES = "# Shoes size chart\n\n| Size | Foot length (cm) | Foot width (cm) |\n|---|---|---|\n| 41 | 26 | 10 |\n| 42 | 27 | 10 |"

PAGES = [
    ("http://a.com/tops", "rendered", None, "", TOPS),
    ("http://b.com/help", "static", None, HUB, ""),
    ("http://b.com/size-guide/men-tops", "rendered", None, "", TOPS),
    ("http://c.com/size", "static", None, DEAD, ""),
    ("http://d.com/shoes", "rendered", None, "", SHOES),
    ("http://e.com/tops", "rendered", None, "", NUMERIC),
    ("http://10.0.0.1/tops", "rendered", None, "", TOPS),
    ("http://h.com/tops", "rendered", None, "", EMPTY),
]
OTHER = [
    ("H", 1, "S", 80.0, 84.0, 30.0, ["rounded"]), ("H", 2, "M", 84.0, None, None, None), ("H", 3, " ", 1.0, None, None, None),
    ("A", 1, "S", 10.0, 10.0, None, None),
]
ASKED = [
    {"brand": "A", "url": "http://a.com/tops", "category": "tshirts", "sizeSystem": "INT", "audience": "men"},
    {"brand": "B", "url": "http://b.com/help", "category": "tops", "sizeSystem": "INT"},
    {"brand": "C", "url": "http://c.com/size", "category": "tshirts", "sizeSystem": "INT"},
    {"brand": "D", "url": "http://d.com/shoes", "category": "tshirts", "sizeSystem": "INT"},
    {"brand": "E", "url": "http://e.com/tops", "category": "tshirts", "sizeSystem": "INT"},
    {"brand": "F", "url": "http://f.com/none", "category": "polo"},
    {"brand": "G", "url": "http://10.0.0.1/tops", "category": "tshirts", "sizeSystem": "INT"},
    {"brand": "H", "url": "http://h.com/tops", "category": "tshirts", "sizeSystem": "INT", "name": "H guide"},
]


@pytest.fixture(scope="module")
def resolved(spark):
    docs = spark.createDataFrame(PAGES, "url string, renderer string, source_url string, html string, markdown string")
    asked = requests.normalised(requests.records(spark.createDataFrame([(json.dumps(ASKED),)], "json string")))
    other = spark.createDataFrame(OTHER, "brand string, row_ord int, label string, chest_low double, chest_high double, sleeve_low double, warnings array<string>")
    other = other.join(asked.select("brand", "request_id"), "brand").drop("brand")
    reports, own = batch.resolve(asked, docs, other)
    reports, own = reports.cache(), own.cache()
    return reports, own, {r.brand: r for r in reports.collect()}


def codes(report):
    return [i.code for i in report.all_issues]


def test_a_direct_page_gives_a_guide(resolved):
    _, own, by = resolved
    a = by["A"]
    assert a.has_guide and a.report_status == "accepted" and a.run_status == "done" and codes(a) == []
    assert (a.resolved_category, a.resolved_system, a.unit, a.orientation) == ("tshirts", "INT", "cm", "size-rows")
    rows = {r.label: r for r in own.where(F.col("request_id") == a.request_id).collect()}
    assert len(rows) == 7 and (rows["XS"].chest_low, rows["XS"].chest_high, rows["3XL"].hips_high) == (80, 84, 109)
    assert rows["2XL"].canonical == "XXL"


def test_a_hub_is_followed(resolved):
    b = resolved[2]["B"]
    assert b.has_guide and b.hop == 1 and [s.kind for s in b.trace] == ["requested-url", "followed-link"]
    assert b.doc_url == "http://b.com/size-guide/men-tops" and 0.55 < b.navigation <= 0.98


def test_failures_name_their_reason(resolved):
    by = resolved[2]
    assert "page-not-found-document" in codes(by["C"]) and by["C"].report_status == "rejected"
    assert "no-unique-section-match" in codes(by["D"]) and by["D"].report_status == "ambiguous"
    assert not by["E"].has_guide and "size-system-mismatch" in codes(by["E"])
    assert {"invalid-requested-category", "server-error"} <= set(codes(by["F"])) and by["F"].run_status == "error"


def test_payloads(resolved):
    reports, own, _ = resolved
    got = {r.brand: r for r in batch.import_payloads(reports, own).collect()}
    assert set(got) == {"A", "B", "H"}
    first, last = got["A"].size_rows[0], got["A"].size_rows[6]
    assert (first.label, first.sort_order, last.label, last.sort_order) == ("XS", 0, "3XL", 6) and first.id.endswith("-row-1")
    assert {k: (d.min, d.max, d.unit) for k, d in first.dimensions.items()} == {"chestCm": (80, 84, "cm"), "waistCm": (70, 70, "cm"), "seatHipsCm": (85, 85, "cm")}
    guide = got["A"].payload.guide
    assert guide.name == "A – tshirts (INT)" and guide.rows == got["A"].size_rows and got["H"].payload.guide.name == "H guide"
    assert got["A"].payload.brand.website == "http://a.com" and got["A"].warnings == []
    assert got["A"].provenance.size_axis == ["XS", "S", "M", "L", "XL", "2XL", "3XL"] and got["A"].provenance.variants == ["standard"]
    assert got["A"].provenance.strategy == "markdown-table" and "Headers: Size, Chest (cm)" in got["A"].provenance.evidence
    assert got["A"].is_complete and got["A"].category == "tshirt" and got["A"].file == "a_tshirts_int.json" and got["A"].strict_error is None
    assert len(got["A"].size_rows) == 7 and 0.05 <= got["A"].uncertainty < 0.1


def test_a_barred_host_is_not_read(resolved):
    g = resolved[2]["G"]
    assert not g.has_guide and g.barred == "url-forbidden-host" and g.run_status == "error"
    assert [(i.code, i.details) for i in g.all_issues] == [("server-error", ["url-forbidden-host"])]


def test_external_rows_give_measures(resolved):
    reports, own, by = resolved
    h, a = by["H"], by["A"]
    assert h.has_guide and h.strategy == "external" and h.summary.endswith("external rows") and codes(h) == ["llm-warning"]
    assert h.all_issues[0].details == ["rounded"] and a.strategy == "markdown-table" and a.summary == "Men's tops size guide · accepted"
    rows = {r.label: r for r in own.where(F.col("request_id") == h.request_id).collect()}
    assert set(rows) == {"S", "M"} and (rows["M"].chest_low, rows["M"].chest_high) == (84, 84)
    payload = {r.brand: r for r in batch.import_payloads(reports, own).collect()}["H"]
    assert payload.size_rows[0].ignored == ["sleeve"] and [w.code for w in payload.warnings] == ["shopping-assistant-dimensions-ignored"]


def test_strict_guides_and_files(resolved, spark, tmp_path):
    reports, own, _ = resolved
    got = {r.brand: r for r in batch.strict_guides(reports, own).collect()}
    assert [(x.label, x.chest_cm, x.waist_cm) for x in got["A"].sizes][:2] == [("XS", 84, 70), ("S", 88, 74)] and got["A"].error is None
    assert got["A"].confidence == round(got["A"].confidence, 2)
    files = batch.export_files(reports, own)
    sinks.write_exports(files, str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out" / "export_kind=shopping-assistant")).collect()]
    assert sorted(x["file"] for x in lines) == ["a_tshirts_int.json", "b_tshirts_int.json", "h_tshirts_int.json"]
    body = {x["file"]: json.loads(x["json"]) for x in lines}["a_tshirts_int.json"]
    assert body["guide"]["rows"][0]["dimensions"]["chestCm"]["max"] == 84.0
    shown = {r.request_id: r.visible for r in export.visible_fields(own, ["request_id"]).collect()}
    assert shown[resolved[2]["H"].request_id] == ["chest", "sleeve"]


def test_a_file_a_guide_and_an_archive(resolved, spark, tmp_path):
    reports, own, _ = resolved
    want = {(r.export_kind, r.file): r.json for r in batch.export_files(reports, own, pretty=True).collect()}
    assert len(want) == 6 and all("\n" in x for x in want.values())
    for form in ("files", "zip"):
        path = str(tmp_path / form)
        batch.write_guides(reports, own, path, form)
        got = files.read_files(spark, path).collect()
        assert len(got) == 6 and {(r.folder, r.file): r.text for r in got} == want
    (tmp_path / "zip" / "half.zip").write_bytes(b"PK")
    assert files.read_files(spark, str(tmp_path / "zip")).count() == 6


def test_failed_and_repeated_tasks_leave_no_files(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(40).repartition(4).select(F.lit("f").alias("folder"), F.lit("x.json").alias("file"), F.col("id").cast("string").alias("text"))
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):
        files.write_files(rows.withColumn("text", F.when(F.col("text") == "33", F.raise_error(F.lit("no"))).otherwise(F.col("text"))), path)
    assert files.parts_of(path) == [] and files.read_files(spark, path).collect() == []
    writer = files.FilesWriter(path, "files")
    some = rows.limit(5).collect()
    writer.write(iter(some[:3]))  # an attempt that was lost after it wrote
    writer.commit([writer.write(iter(some)), writer.write(iter([])), None])
    assert sorted(r.text for r in files.read_files(spark, path).collect()) == sorted(r.text for r in some)
    files.write_files(rows, path)  # 40 files of one name: numbered, none lost
    assert files.read_files(spark, path).count() == 45


def test_outbox_and_inbox(spark):
    """Equal sections are asked once; answers count with allowed fields only; a rerun asks what is left."""
    docs = spark.createDataFrame(
        [(f"http://{h}.com/tops", "rendered", None, "", EMPTY) for h in ("h", "i")] + [("http://j.com/tops", "rendered", None, "", EMPTY.replace("| S |", "| XL |"))],
        "url string, renderer string, source_url string, html string, markdown string",
    )
    ask = [{"brand": b, "url": f"http://{h}.com/tops", "category": "tshirts", "sizeSystem": "INT"} for b, h in (("H", "h"), ("H2", "h"), ("I", "i"), ("J", "j"))]
    asked = requests.normalised(requests.records(spark.createDataFrame([(json.dumps(ask),)], "json string")))
    reports, _ = batch.resolve(asked, docs, inbox=spark.createDataFrame([], outbox.INBOX))
    left = outbox.pending(reports, spark.createDataFrame([], outbox.INBOX)).collect()
    assert len(left) == 2 and all(r.fields == ["chest", "waist", "hips", "height", "sleeve", "neck", "shoulder"] for r in left)
    assert {r.brand: r.external_outcome for r in reports.collect()} == dict.fromkeys(("H", "H2", "I", "J"), "pending")
    keys = {r.brand: r.external_key for r in reports.collect()}
    assert keys["H"] == keys["H2"] == keys["I"] != keys["J"]
    none = dict.fromkeys(c.split()[0] for c in outbox.INBOX.split(", "))
    rows = [{**none, "key": keys["H"], "status": "ok", "row_ord": i, "label": s, "chest_low": 80.0 + i, "footLength_low": 9.0} for i, s in enumerate("SM")]
    rows.append({**none, "key": keys["J"], "status": "error", "message": "upstream 502"})
    inbox = spark.createDataFrame([tuple(r.values()) for r in rows], outbox.INBOX)
    reports, own = batch.resolve(asked, docs, inbox=inbox)
    by = {r.brand: r for r in reports.collect()}
    assert outbox.pending(reports, inbox).collect() == []
    for b in ("H", "H2", "I"):
        assert by[b].has_guide and by[b].strategy == "external" and by[b].external_outcome == "rows" and by[b].present == ["chest"]
        got = own.where(F.col("request_id") == by[b].request_id).collect()
        assert {(r.label, r.chest_low, r.footLength_low) for r in got} == {("S", 80.0, None), ("M", 81.0, None)}
    assert not by["J"].has_guide and by["J"].external_outcome == "error"
    assert [(i.severity, i.details) for i in by["J"].all_issues if i.code == "llm-fallback-error"] == [("warning", ["upstream 502"])]


def test_near_equal_requests_stay_apart(spark):
    base = {"brand": "A", "url": "http://a.com/tops"}
    asked = [base, {**base, "category": "tshirts"}, {**base, "sizeSystem": "tshirts"}, {**base, "category": "tshirts", "fallbackSizeSystem": "INT"}, {**base, "name": "x"}, base]
    found = requests.normalised(requests.records(spark.createDataFrame([(json.dumps(asked),)], "json string"))).collect()
    assert len(found) == len({r.request_id for r in found}) == 6


def test_upload_errors(spark):
    texts = ["{", "7", '{"sources": 3}', "[]", '[{"brand": "", "url": "x"}]', '[{"brand": "A", "url": "x"}, 5]', None]
    got = {r.json: r.error for r in requests.upload_errors(spark.createDataFrame([(t,) for t in texts], "json string")).collect()}
    assert [got[t] for t in texts] == ["invalid-json", "not-a-list", "not-a-list", "no-valid-source", "no-valid-source", None, "invalid-json"]


def test_uploads_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"sources": ASKED[:2]}))
    seen = []
    query = run_uploads(stream_uploads(spark, str(tmp_path / "in")), lambda df, n: seen.extend(r.brand for r in df.collect()), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert sorted(seen) == ["A", "B"]
