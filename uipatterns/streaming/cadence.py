"""Texts that tick: digits changing at a steady pace, batch and streaming."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uipatterns.operators.ordered import previous_row, running_sums, time_chunk
from uipatterns.session import cut_lineage

# --- fixed values: a tick every 700 to 1500 ms, four in a row ---------------------
MIN_GAP_MS, MAX_GAP_MS, RUN_LENGTH = 700, 1500, 4
# --- end of fixed values ------------------------------------------------------------


def cadence_batch(
    obs: DataFrame, key: str = "key", ts: str = "ts", text: str = "text", min_ms: int = MIN_GAP_MS,
    max_ms: int = MAX_GAP_MS, n: int = RUN_LENGTH, chunk_seconds: int = 3600,
) -> DataFrame:
    """Per key: the longest run of ticks, the run at the end, and both verdicts.

    Text without digits forgets everything before it.  An unchanged text is
    ignored, a change outside the pace starts the count again.  Sightings of one
    instant follow each other by text.  Keys are worked
    on in time chunks, so one busy element does not sit in one task.
    """
    rows = obs.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(text).alias("text")).withColumn(
        "digits", F.col("text").rlike("[0-9]"))
    chunk = time_chunk("ts", chunk_seconds)
    seen = previous_row(rows, ["key"], ["ts", "text"], {"_text": "text", "_digits": "digits"}, chunk)
    fresh = ~F.coalesce(F.col("_digits"), F.lit(False))
    changed = F.col("digits") & (fresh | (F.col("_text") != F.col("text")))
    # The changes are few next to the sightings and every step below reads them twice.
    changes = cut_lineage(seen.filter(changed).select("key", "ts", "text", fresh.alias("fresh")))
    changes = previous_row(changes, ["key"], ["ts", "text"], {"_ts": "ts"}, chunk)
    gap = (F.unix_micros("ts") - F.unix_micros("_ts")) / 1000
    tick = ~F.col("fresh") & F.coalesce(gap.between(min_ms, max_ms), F.lit(False))
    changes = changes.withColumn("tick", tick)
    runs = running_sums(changes, ["key"], [F.col("ts"), F.col("text")], {"run": (~F.col("tick")).cast("int")}, chunk)
    per_run = runs.groupBy("key", "run").agg(F.count_if("tick").alias("ticks"))
    ends = rows.groupBy("key").agg(F.max_by("digits", F.struct("ts", "text")).alias("alive"))
    return per_run.groupBy("key").agg(
        F.max("ticks").alias("longest"), F.max_by("ticks", "run").alias("current")
    ).join(ends, "key", "right").select(
        "key", F.coalesce("longest", F.lit(0)).alias("longest"),
        F.when(F.col("alive"), F.coalesce("current", F.lit(0))).otherwise(F.lit(0)).alias("current"),
    ).withColumns({"ever_animated": F.col("longest") >= n, "is_animated": F.col("current") >= n})


def cadence_stream(
    obs: DataFrame, key: str = "key", ts: str = "ts", text: str = "text", watermark: str = "30 seconds",
    min_ms: int = MIN_GAP_MS, max_ms: int = MAX_GAP_MS, n: int = RUN_LENGTH,
) -> DataFrame:
    """The streaming form: one row per key whenever its run changes.

    State is three values per key.  A key that is silent past the watermark is
    forgotten.  Rows of one trigger are put in time order per key; a row older
    than the change counted last is passed over.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    keep_ms = max(max_ms * n, 60_000)

    def step(group, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, at, run = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "text"], kind="stable")
        for now, value in zip(rows["ts"].astype("int64") // 1_000, rows["text"]):
            if last is not None and now < at:
                continue  # arrived after a later one was counted
            if not any("0" <= c <= "9" for c in value):
                last, at, run = None, 0, 0
            elif last is None:
                last, at, run = value, now, 0
            elif value != last:
                paced = min_ms * 1000 <= now - at <= max_ms * 1000
                last, at, run = value, now, run + 1 if paced else 0
        latest = int(rows["ts"].max().timestamp() * 1000)
        if last is None:
            if state.exists:
                state.remove()
        else:
            state.update((last, int(at), int(run)))
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1) + keep_ms)
        yield pd.DataFrame({"key": [group[0]], "ts": [rows["ts"].max()], "current": [int(run)], "is_animated": [run >= n]})

    rows = obs.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(text).alias("text"))
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return rows.groupBy("key").applyInPandasWithState(
        step, "key string, ts timestamp, current long, is_animated boolean", "last string, at long, run long",
        "append", GroupStateTimeout.EventTimeTimeout)


def value_trend(obs: DataFrame, key: str = "key", ts: str = "ts", text: str = "text", chunk_seconds: int = 3600) -> DataFrame:
    """How the first number in a text moves: only down (a shrinking stock) or at all.

    Readings of one instant follow each other by value.
    """
    number = F.regexp_extract(text, "([0-9]+)", 1).try_cast("bigint")
    rows = obs.select(F.col(key).alias("key"), F.col(ts).alias("ts"), number.alias("value")).filter("value is not null")
    seen = previous_row(rows, ["key"], ["ts", "value"], {"_before": "value"}, time_chunk("ts", chunk_seconds))
    step = F.when(F.col("_before").isNotNull(), F.col("value") < F.col("_before"))
    return seen.groupBy("key").agg(
        F.count(F.lit(1)).alias("observations"), F.coalesce(F.bool_and(step), F.lit(False)).alias("strictly_decreasing"),
        F.count_if(F.col("value") != F.col("_before")).alias("changes"))
