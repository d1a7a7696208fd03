"""How often a document is looked at: after it has been quiet, and never twice within an interval."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uipatterns.operators.ordered import previous_row, running_sums, time_chunk

# --- fixed values: a pass 300 ms after the last change, 1000 ms after the last pass ---
QUIET_MS, FLOOR_MS = 300, 1000
# --- end of fixed values ------------------------------------------------------------


def paced_passes(
    signals: DataFrame, key: str = "key", ts: str = "ts", quiet_ms: int = QUIET_MS, floor_ms: int = FLOOR_MS,
    chunk_seconds: int = 3600,
) -> DataFrame:
    """When passes over each key run: ``key, pass_at, last_seen, signals``.

    Each signal sets the next pass to ``quiet_ms`` after itself or ``floor_ms``
    after the pass before, whichever is later; a signal that comes before it
    sets it anew, one at that instant belongs to the next pass.  Signals of one
    instant come together.  Every signal is counted in one pass, and the last of
    them is the one it shows.  Signals without a time are none; a null key is a key.

    Signals closer than ``quiet_ms`` are one burst.  After a silence in which
    any pass and the floor behind it must end, nothing earlier matters: there
    a new episode begins.  Both are found in time chunks.  Only the bursts
    of an episode are walked in order, one after the other and without keeping them.
    """
    quiet, floor = quiet_ms * 1000, floor_ms * 1000
    chunk = time_chunk("at", chunk_seconds)
    rows = signals.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("at")).dropna(subset=["at"])
    rows = rows.groupBy("key", "at").agg(F.count(F.lit(1)).alias("n"))
    seen = previous_row(rows, ["key"], ["at"], {"_before": "at"}, chunk)
    gap = F.unix_micros("at") - F.unix_micros("_before")
    starts = lambda silence: F.coalesce(gap >= silence, F.lit(True)).cast("int")
    numbered = running_sums(seen, ["key"], [F.col("at")], {"burst": starts(quiet), "episode": starts(floor + max(quiet, floor))}, chunk)
    bursts = numbered.groupBy("key", "episode", "burst").agg(
        F.unix_micros(F.min("at")).alias("first"), F.unix_micros(F.max("at")).alias("last"), F.sum("n").alias("n"))

    def walk(batches):
        group, due, last, n = object(), None, None, 0  # the pass that waits: when, for which signal, for how many
        kind = None
        for batch in batches:
            kind, rows, out = batch.schema.field("key").type, batch.to_pydict(), []
            for name, episode, first, end, count in zip(*(rows[c] for c in ("key", "episode", "first", "last", "n"))):
                ran = None
                if (name, episode) != group:
                    if due is not None:
                        out.append((group[0], due, last, n))
                    group, n = (name, episode), 0
                elif first >= due:
                    out.append((name, due, last, n))
                    ran, n = due, 0
                else:
                    ran = passed
                due = end + quiet if ran is None else max(end + quiet, ran + floor)
                passed, last, n = ran, end, n + count
            yield _passes(out, kind)
        if due is not None:
            yield _passes([(group[0], due, last, n)], kind)

    ordered = bursts.repartition("key", "episode").sortWithinPartitions("key", "episode", "burst")
    made = ordered.mapInArrow(walk, T.StructType([T.StructField("key", bursts.schema["key"].dataType), *[
        T.StructField(c, T.LongType()) for c in ("due", "last", "signals")]]))
    return made.select("key", F.timestamp_micros("due").alias("pass_at"), F.timestamp_micros("last").alias("last_seen"), "signals")


def _passes(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int64(), pa.int64()))],
                                      names=["key", "due", "last", "signals"])


def pace_stream(
    stream: DataFrame, key: str = "key", ts: str = "ts", quiet_ms: int = QUIET_MS, floor_ms: int = FLOOR_MS,
) -> DataFrame:
    """The same rule on a stream, by the clock of arrival: the newest row of each key that has been let through.

    Gives the stream's columns, ``signals`` (rows since the key's last one) and
    ``emitted_at``.  A timer per key lets the waiting row through; two rows of a
    key are never less than ``floor_ms`` apart.  State is the waiting row and
    the time of the last, and it is removed when the floor has passed with
    nothing waiting.  Of rows of one instant the larger one stays.  A key that is never
    quiet waits, as the rule has it; ``quiet_ms=0`` is the plain rate limit.
    Rows that wait when the query stops wait in its checkpoint.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    columns = ["name", "row", "signals", "emitted"]

    def step(group, frames, state):
        now = state.getCurrentProcessingTimeMs()
        row, at, n, due, last = state.get if state.exists else ("", 0, 0, 0, -1)
        out = []
        if n and now >= due:  # a key with new rows gets no call for its timer
            out.append((group[0], row, n, now))
            n, last = 0, now
        if state.hasTimedOut and not out:
            state.remove()
            return
        fresh = 0
        for frame in [] if state.hasTimedOut else frames:
            newest = frame.sort_values(["at", "row"]).iloc[-1]
            if not n + fresh or (newest["at"], newest["row"]) > (at, row):
                row, at = newest["row"], int(newest["at"])
            fresh += len(frame)
        if fresh:
            n, due = n + fresh, now + quiet_ms if last < 0 else max(now + quiet_ms, last + floor_ms)
        state.update((row if n else "", at, int(n), int(due), int(last)))
        state.setTimeoutDuration(max(1, (due if n else last + floor_ms) - now))
        yield pd.DataFrame(out, columns=columns)

    name = F.col(key).cast("string")
    rows = stream.select(name.alias("name"), F.to_json(F.struct(*stream.columns), {"ignoreNullFields": "false"}).alias("row"),
                         F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(0)).alias("at"))
    made = rows.groupBy("name").applyInPandasWithState(
        step, "name string, row string, signals long, emitted long", "row string, at long, n long, due long, last long",
        "append", GroupStateTimeout.ProcessingTimeTimeout)
    return made.select(F.from_json("row", stream.schema).alias("r"), "signals", F.timestamp_millis("emitted").alias("emitted_at")).select(
        "r.*", "signals", "emitted_at")
