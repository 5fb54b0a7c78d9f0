"""The last accepted result by source: a stream in batches against one batch."""

import json

from pyspark.sql import functions as F

from tablewright.streaming.latest import latest, latest_stream

ROWS = "brand string, url string, at timestamp, ord int, file string, score double"


def test_a_stream_ends_as_one_batch(spark, tmp_path):
    row = lambda b, u, day, n, f: {"brand": b, "url": u, "at": f"2024-01-0{day}T00:00:00Z", "ord": n, "file": f, "score": n / 2}
    batches = [
        [row("A", "u", 2, 0, "a1"), row("A", "u", 2, 1, "a2"), row("B", "v", 1, 0, "b1"), {**row("C", None, 3, 0, "c1"), "score": None}],
        [row("A", "u", 1, 9, "late"), row("A", "u", 2, 1, "a2"), row("B", "v", 4, 0, "b2")],
        [row("B", "v", 3, 5, "late"), row("D", "w", 1, 0, "d1"), row("C", None, 3, 1, "c2"), {**row("D", "w", 1, 0, "old"), "at": None}],
    ]
    source, seen = tmp_path / "in", []
    source.mkdir()

    def run():
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", "1").json(str(source))
        out = latest_stream(stream, ["brand", "url"], "at", "ord").writeStream.outputMode("update")
        query = out.foreachBatch(lambda df, n: seen.append([tuple(r) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "ck"))
        assert query.trigger(availableNow=True).start().awaitTermination(180)

    for i, own in enumerate(batches):  # each run begins again from the checkpoint
        (source / f"{i}.json").write_text("\n".join(map(json.dumps, own)))
        if i != 1:  # the second and third file come to one run
            run()
    run()
    held = {}
    for rows in seen:
        for r in rows:
            held[r[:2]] = r
    table = spark.read.schema(ROWS).json(str(source))
    want = {tuple(r)[:2]: tuple(r) for r in latest(table, ["brand", "url"], "at", "ord").collect()}
    assert held == want and {k: v[4] for k, v in want.items()} == {("A", "u"): "a2", ("B", "v"): "b2", ("C", None): "c2", ("D", "w"): "d1"}
    assert ("A", "u") not in [r[:2] for rows in seen[1:] for r in rows]  # late and repeated uploads say nothing
    assert table.groupBy("brand", "url").agg(F.count("*")).count() == len(want)
