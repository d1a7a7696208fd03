import datetime
import random
import time

from pyspark.sql import functions as F

from uipatterns.streaming.pace import pace_stream, paced_passes

START = datetime.datetime(2024, 1, 1)


def by_hand(times, quiet, floor):
    """The rule with one timer, instant by instant."""
    out, due, ran, waiting = [], None, None, []
    for t in sorted(set(times)):
        if due is not None and t >= due:
            out.append((due, waiting[-1], len(waiting)))
            ran, waiting = due, []
        waiting += [t] * times.count(t)
        due = t + quiet if ran is None else max(t + quiet, ran + floor)
    return out + ([(due, waiting[-1], len(waiting))] if waiting else [])


def test_passes_against_one_timer(spark):
    rng, rows = random.Random(3), []
    for doc in ["a", "b", "c", "d", None]:
        t = 0
        for _ in range(400):
            t += rng.choice([0, 10, 100, 299, 300, 301, 700, 1000, 1300, 1999, 2000, 2001, 9000])
            rows.append((doc, t))
    rows += [("once", 5), ("tie", 7), ("tie", 7), ("tie", 307)]
    df = spark.createDataFrame([(d, START + datetime.timedelta(milliseconds=t)) for d, t in rows] + [("a", None)], "key string, ts timestamp")
    ms = lambda t: round((t - START).total_seconds() * 1000)
    for quiet, floor, seconds in ((300, 1000, 3600), (300, 1000, 2), (1000, 300, 5), (0, 1000, 60)):
        got = {}
        for r in paced_passes(df, quiet_ms=quiet, floor_ms=floor, chunk_seconds=seconds).collect():
            got.setdefault(r.key, []).append((ms(r.pass_at), ms(r.last_seen), r.signals))
        assert {k: sorted(v) for k, v in got.items()} == {
            k: by_hand([t for d, t in rows if d == k], quiet, floor) for k in {d for d, _ in rows}}
    assert paced_passes(df.limit(0)).count() == 0


def test_stream_keeps_the_pace(spark, tmp_path):
    schema = "key string, ts timestamp, text string"
    floor = 4000

    def send(*rows):
        spark.createDataFrame([(k, START + datetime.timedelta(seconds=s), t) for k, s, t in rows], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def wait(n):
        for _ in range(600):
            rows = sorted(spark.table("paced").collect(), key=lambda r: r.emitted_at)
            if len(rows) >= n:
                return rows
            time.sleep(0.1)
        raise AssertionError(rows)

    send(("a", 1, "one"), ("a", 3, "three"), ("a", 2, "two"), ("b", 1, None))
    query = pace_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), quiet_ms=100, floor_ms=floor).writeStream.format("memory").queryName(
        "paced").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        assert {(r.key, r.text, r.signals) for r in wait(2)} == {("a", "three", 3), ("b", None, 1)}
        send(("a", 5, "five"))
        send(("a", 4, "four"))  # an older row doesn't take the newer one's place
        rows = [r for r in wait(3) if r.key == "a"]
        while sum(r.signals for r in rows) < 5:
            rows = [r for r in wait(len(rows) + 2) if r.key == "a"]
        assert rows[1].text in ("five", "four") and sum(r.signals for r in rows) == 5
        assert all((y.emitted_at - x.emitted_at).total_seconds() * 1000 >= floor for x, y in zip(rows, rows[1:]))
        state = lambda: query.lastProgress["stateOperators"][0]["numRowsTotal"]
        for _ in range(300):
            if state() == 0:
                break
            time.sleep(0.1)
        assert state() == 0  # nothing waits, the floor has passed: nothing is kept
        assert spark.table("paced").agg(F.sum("signals")).first()[0] == 6
    finally:
        query.stop()
