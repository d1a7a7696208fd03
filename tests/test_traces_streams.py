import datetime
import json

from pyspark.sql import functions as F

from uipatterns.operators import explain as X
from uipatterns.operators import traces as T
from uipatterns.sources import archive as A
from uipatterns.sources import tables as TB
from uipatterns.schema import DATASET_ROW, GOLD_COLUMNS
from uipatterns.streaming import ledger, live
from uipatterns.streaming.cadence import cadence_batch, cadence_stream, value_trend

START = datetime.datetime(2024, 1, 1)


def upload(**over):
    return json.dumps({"scan_id": "s", "url": "https://a.example/x", "page_score": 5, "entries": [{"id": "1", "text": "t"}], **over})


def test_validation(spark):
    rows = [upload(), upload(url="ftp://a"), upload(page_score=101), upload(extra=1), upload(scan_id="x" * 101), upload(entries=[{"id": "1", "text": "t", "odd": 1}]),
            upload(entries=[{"id": "1", "text": "t"}] * 5001), "[]", upload(entries=[{"text": "no id"}])]
    good, bad = T.validate_traces(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, value string"))
    assert [r.i for r in good.collect()] == [0]
    assert {r.i: r.reason for r in bad.collect()} == {
        1: "url must be http(s)", 2: "page_score out of range", 3: "unknown field", 4: "bad scan_id", 5: "unknown entry field", 6: "too many entries",
        7: "not a JSON object", 8: "entry without id or text"}


def test_status_tells_null_from_empty(spark):
    df = spark.createDataFrame([(None, True), (None, False), ([], True), (["x"], True)], "l array<string>, s boolean")
    assert [r[0] for r in df.select(T.entry_status(F.col("l"), F.col("s"))).collect()] == ["pending", "not sent (duplicate)", "benign", "flagged"]


def test_trace_files_in_three_shapes(spark, tmp_path):
    e = {"id": "1", "text": "t", "findingLabels": None}
    shapes = {"a": [e], "b": {"url": "https://Shop.example/p", "entries": [e, {**e, "findingLabels": []}]}, "c": {"version": 2, "url": "https://x.example", "rows": [e]}, "d": {"other": 1}}
    for name, body in shapes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    rows, bad = A.read_traces(spark, str(tmp_path))
    got = sorted((r.file[-6], r.host, r.seq, r.findingLabels) for r in rows.collect())
    assert got == [("a", "", 0, None), ("b", "shop.example", 0, None), ("b", "shop.example", 1, []), ("c", "x.example", 0, None)]
    assert [r.file[-6] for r in bad.collect()] == ["d"]


def capture(spark, scans, minute, host="a.example"):
    rows = [(s, f"https://{host}/{s}", 1, START + datetime.timedelta(minutes=minute), [(s, f"text {minute}")]) for s in scans]
    df = spark.createDataFrame(rows, "scan_id string, url string, page_score int, captured_at timestamp, e array<struct<id:string,text:string>>")
    schema = dict((f.name, f.dataType) for f in spark.read.schema(A.ARCHIVE).json(spark.sparkContext.emptyRDD()).schema.fields)["entries"]
    return df.withColumn("entries", F.from_json(F.to_json("e"), schema)).drop("e")


def test_archive_replaces_a_scan_and_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "arch")
    A.write_archive(capture(spark, ["s1", "s2"], 1), path)
    A.write_archive(capture(spark, ["s3"], 1, "b.example"), path)
    A.write_archive(capture(spark, ["s2"], 9), path)
    got = {r.scan_id: r.entries[0].text for r in A.read_archive(spark, path).collect()}
    assert got == {"s1": "text 1", "s2": "text 9", "s3": "text 1"}
    assert [r.scan_id for r in A.read_archive(spark, path, "b.example").collect()] == ["s3"]
    plan = A.read_archive(spark, path, "b.example")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(host" in plan


def test_dataset_files(spark, tmp_path):
    row = {f.name: 0 if f.name.startswith("y_") else 'a "quoted", text\nline' for f in DATASET_ROW.fields}
    df = spark.createDataFrame([row], DATASET_ROW).withColumn("part", F.explode(F.array(F.lit("train"), F.lit("val"), F.lit("test"))))
    TB.write_parts(df, str(tmp_path), "s")
    back = TB.read_parts(spark, str(tmp_path), "s")
    assert sorted(r.part for r in back.collect()) == ["test", "train", "val"] and back.first().text == row["text"]
    df.drop("y_benign").coalesce(1).write.csv(str(tmp_path / "bad/train.csv"), header=True)
    try:
        TB.read_split(spark, str(tmp_path), "bad", "train")
        raise AssertionError("a missing column must fail")
    except ValueError as error:
        assert "y_benign" in str(error)


def test_annotation_sheet_columns(spark, tmp_path):
    path = str(tmp_path / "sheet")
    df = spark.createDataFrame([tuple(f"{c},\"x\"" for c in GOLD_COLUMNS), tuple("" for _ in GOLD_COLUMNS)], ", ".join(f"{c} string" for c in GOLD_COLUMNS))
    TB.write_annotation_sheet(df, path)
    rows = TB.read_gold(spark, path).collect()
    assert len(rows) == 1 and rows[0].asDict() == {c: f"{c},\"x\"" for c in GOLD_COLUMNS}


TICKS = [
    ("even", [(i * 1000, f"{9 - i}") for i in range(6)]), ("short", [(i * 1000, f"{9 - i}") for i in range(4)]),
    ("gap", [(0, "9"), (1000, "8"), (2000, "7"), (7000, "6"), (8000, "5"), (9000, "4")]),
    ("cleared", [(0, "9"), (1000, "8"), (2000, "7"), (3000, "6"), (4000, "5"), (5000, "done"), (6000, "4")]),
    ("still", [(0, "9"), (500, "9"), (1000, "8"), (1500, "8"), (2000, "7"), (3000, "6"), (4000, "5")]), ("fast", [(i * 300, f"{i}") for i in range(9)]),
]
WANT = {"even": (5, 5), "short": (3, 3), "gap": (2, 2), "cleared": (4, 0), "still": (4, 4), "fast": (0, 0)}


def observations():
    return [(k, START + datetime.timedelta(milliseconds=ms), t) for k, seq in TICKS for ms, t in seq]


def test_cadence_batch(spark):
    df = spark.createDataFrame(observations(), "key string, ts timestamp, text string")
    for seconds in (1, 2, 3600):
        got = {r.key: (r.longest, r.current) for r in cadence_batch(df, chunk_seconds=seconds).collect()}
        assert got == WANT


def test_cadence_stream_equals_batch(spark, tmp_path):
    rows = sorted(observations(), key=lambda r: r[1])
    src = tmp_path / "in"
    for part in range(0, len(rows), 7):  # several files, one per trigger
        spark.createDataFrame(rows[part:part + 7], "key string, ts timestamp, text string").coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema("key string, ts timestamp, text string").option("maxFilesPerTrigger", 1).json(str(src))
    query = cadence_stream(stream).writeStream.format("memory").queryName("ticks").option("checkpointLocation", str(tmp_path / "cp")).outputMode(
        "append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = spark.table("ticks").groupBy("key").agg(F.max_by("current", "ts").alias("c"))
    assert {r.key: r.c for r in last.collect()} == {k: v[1] for k, v in WANT.items()}


def test_stream_dedupe_equals_batch(spark, tmp_path):
    rows = [("https://a.example/p#x", "s1", "Only 3 left", 0), ("https://a.example/p#y", "s1", "Only 2 left", 1), ("https://a.example/q", "s1", "Only 2 left", 2),
            ("https://a.example/p", "s2", "Only 2 left", 3)]
    df = spark.createDataFrame([(u, s, t, START + datetime.timedelta(seconds=i)) for u, s, t, i in rows], "url string, selector string, text string, ts timestamp")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    query = live.stream_dedupe(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda d: sorted((r.document, r.churn) for r in d.collect())
    assert key(spark.table("once")) == key(live.dedupe_batch(df)) and len(key(live.dedupe_batch(df))) == 3
    assert live.late_rows(df, str(START + datetime.timedelta(seconds=3)), watermark="1 second").count() == 2


FOUND = "cand_id string, seen_at timestamp, findings array<struct<label:string,confidence:string>>"


def test_findings_table_replaces_and_deletes_without_a_cap(spark):
    one = [("scarcity", "likely")]
    schema = f"document string, {FOUND}"
    empty = spark.createDataFrame([], live.STATE)
    at = lambda s: START + datetime.timedelta(seconds=s)
    first = live.upsert_findings(empty, spark.createDataFrame([("d", c, at(i), one) for i, c in enumerate("abc")], schema))
    second = live.upsert_findings(first, spark.createDataFrame([("d", "a", at(9), [("scarcity", "possible")]), ("d", "b", at(9), []), ("d", "x", at(9), one), ("d", "y", at(10), one)], schema))
    assert {r.cand_id for r in second.collect()} == {"a", "c", "x", "y"}
    kept, gone = live.keep_latest(second, 3)
    assert {r.cand_id for r in kept.collect()} == {"c", "x", "y"} and {r.cand_id for r in gone.collect()} == {"a"}
    assert live.document_scores(kept).first().page_score == 30
    many = spark.createDataFrame([("d", f"c{i}", at(i), one) for i in range(700)], schema)
    assert live.upsert_findings(empty, many).count() == 700


def test_stream_findings_survive_restarts_late_rows_and_a_new_checkpoint(spark, tmp_path):
    one, schema = [("scarcity", "likely")], f"url string, {FOUND}"
    batches = [[("d1#x", "a", 0, one), ("d2", "b", 0, one)], [("d1", "c", 1, one), ("d3", "e", 1, one)], [("d2", "b", 2, []), ("d1", "a", 2, [])],
               [("d2", "b", 1, one), *[("d4", f"m{i}", 3, one) for i in range(700)]]]
    for i, rows in enumerate(batches):
        data = [(f"https://a.example/{u}", c, START + datetime.timedelta(seconds=s), f) for u, c, s, f in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").json(str(tmp_path / f"in/{i}"))
    out = str(tmp_path / "out")
    for i in range(len(batches)):  # one run per batch, so that state is read back after a restart
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in/[0-{i}]")
        live.stream_findings(stream, out, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination(120)
    want = {("d1", "c"), ("d3", "e"), *[("d4", f"m{i}") for i in range(700)]}
    found = lambda: {(r.document[-2:], r.cand_id) for r in live.read_findings(spark, out).collect()}
    assert found() == want
    assert [(r.document[-2:], r.cand_id) for r in live.read_dead_letters(spark, out).collect()] == [("d2", "b")]
    assert {(r.document[-2:], r.page_score) for r in live.read_scores(spark, out).collect()} == {("d1", 10), ("d3", 10), ("d4", 100)}
    # a new checkpoint over the old table: its first batches bring old rows, an older one and new ones
    more = [("d1", "c", 0, [("scarcity", "possible")]), ("d2", "b", 1, one), ("d5", "n", 1, one), ("d3", "e", 9, [("scarcity", "possible")])]
    data = [(f"https://a.example/{u}", c, START + datetime.timedelta(seconds=s), f) for u, c, s, f in more]
    spark.createDataFrame(data, schema).coalesce(1).write.json(str(tmp_path / "in/4"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/[3-4]")
    live.stream_findings(stream, out, str(tmp_path / "cp2"), {"availableNow": True}).awaitTermination(120)
    want = want | {("d5", "n")}
    scores = {("d1", 10), ("d3", 5), ("d4", 100), ("d5", 10)}

    def check():
        assert found() == want
        assert {(r.document[-2:], r.page_score) for r in live.read_scores(spark, out).collect()} == scores
        assert [(r.document[-2:], r.cand_id) for r in live.read_dead_letters(spark, out).collect()] == [("d2", "b")]

    check()
    assert live.compact_findings(spark, out) and not live.compact_findings(spark, out)
    seen = ledger.view(spark, out)
    assert seen.snapshot and not seen.tail
    check()
    assert ledger.tidy(spark, out) == 0  # a reader may still be at it
    assert ledger.tidy(spark, out, 0) >= 6
    check()
    # the deletion is in the snapshot: a third checkpoint can't bring d2 back, and its new rows arrive
    spark.createDataFrame([("https://a.example/d6", "z", START, one)], schema).coalesce(1).write.json(str(tmp_path / "in/5"))
    stream = spark.readStream.schema(schema).json(f"{tmp_path}/in/[0,5]")
    live.stream_findings(stream, out, str(tmp_path / "cp3"), {"availableNow": True}).awaitTermination(120)
    want, scores = want | {("d6", "z")}, scores | {("d6", 10)}
    check()
    assert len({folder.split("/")[-2] for folder in ledger.view(spark, out).tail}) == 1


def test_a_batch_is_written_once(spark, tmp_path):
    path, one = str(tmp_path / "t"), [("scarcity", "likely")]
    rows = lambda c: spark.createDataFrame([("d", c, START, one, "upsert")], live.CHANGES)
    assert ledger.append(rows("a"), path, "r1", 0)
    # a try that died between its rows and its entry is not read, and the next try replaces it
    rows("lost").write.parquet(f"{path}/changes/r1/{1:012d}")
    assert {r.cand_id for r in live.read_findings(spark, path).collect()} == {"a"}
    assert ledger.append(rows("b"), path, "r1", 1) and not ledger.append(rows("again"), path, "r1", 1)
    assert ledger.append(rows("c"), path, "r2", 0)
    assert {r.cand_id for r in live.read_findings(spark, path).collect()} == {"a", "b", "c"}
    assert live.compact_findings(spark, path) and ledger.tidy(spark, path, 0) == 3
    assert not ledger.append(rows("again"), path, "r1", 1)  # covered by the snapshot
    assert ledger.append(rows("d"), path, "r1", 2)
    assert {r.cand_id for r in live.read_findings(spark, path).collect()} == {"a", "b", "c", "d"}


def test_of_two_compactions_one_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    row = spark.createDataFrame([("d", "a", START, [("scarcity", "likely")], "upsert")], live.CHANGES)
    ledger.append(row, path, "r", 0)
    seen = ledger.view(spark, path)
    tables = {"state": live.newest_changes(spark, path, seen), "dead": live.dead_letters(spark, seen)}
    assert ledger.commit_snapshot(spark, path, seen, tables) and not ledger.commit_snapshot(spark, path, seen, tables)
    assert len(ledger.Files(spark, path).names(f"{path}/snapshots")) == 1 and live.read_findings(spark, path).count() == 1


def test_silent_findings_expire(spark, tmp_path):
    import time

    schema = f"url string, {FOUND}"
    for i, c in enumerate("ab"):
        spark.createDataFrame([("u", c, START, [("scarcity", "likely")])], schema).coalesce(1).write.json(str(tmp_path / f"in/{i}"))
    for i in range(2):
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in/[0-{i}]")
        live.stream_findings(stream, str(tmp_path / "out"), str(tmp_path / "cp"), {"availableNow": True}, "1 second").awaitTermination(120)
        time.sleep(2)
    assert "b" in {r.cand_id for r in live.read_findings(spark, str(tmp_path / "out")).collect()}
    assert {r.cand_id for r in live.newest_changes(spark, str(tmp_path / "out"), ledger.view(spark, str(tmp_path / "out"))).filter("kind = 'expired'").collect()} == {"a"}


def test_ties_have_one_answer(spark):
    rows = [("k", START, t) for t in ("9 left", "7 left", "8 left")]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        df = spark.createDataFrame(order, "key string, ts timestamp, text string").coalesce(1)
        assert [(r.strictly_decreasing, r.changes) for r in value_trend(df).collect()] == [(False, 2)]


def test_value_trend(spark):
    rows = [("down", i, f"Only {9 - i} left") for i in range(4)] + [("mixed", i, f"{(3, 5, 4)[i]} viewing") for i in range(3)] + [("one", 0, "1 left"), ("words", 0, "none")]
    df = spark.createDataFrame([(k, START + datetime.timedelta(hours=i), t) for k, i, t in rows], "key string, ts timestamp, text string")
    assert {r.key: (r.strictly_decreasing, r.changes) for r in value_trend(df).collect()} == {"down": (True, 3), "mixed": (False, 2), "one": (False, 0)}


def test_fencing_and_policy(spark):
    df = spark.createDataFrame([("a --- b ```c``` <|end|>\n d",), ("this violates things",), ("an issue of FRAUD",), ("plain issue",), ("éfraud and fraudé",)], "t string")
    got = df.select(X.sanitize_untrusted(F.col("t")), X.policy_violation(F.col("t"))).collect()
    assert got[0][0] == "a b c d" and [r[1] for r in got] == [None, "violates", "FRAUD", None, None]
