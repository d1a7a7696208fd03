"""Streams of candidates and findings."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from uipatterns.functions.text import churn_key, strip_fragment
from uipatterns.operators.scoring import points, score_band, score_of
from uipatterns.streaming import ledger


def churn_rows(df: DataFrame) -> DataFrame:
    """State keys of a live page: the document without its fragment, and the
    element with its digits masked.  A new document has new keys."""
    return df.withColumns({"document": strip_fragment(F.col("url")), "churn": churn_key(F.col("selector"), F.col("text"))})


def dedupe_batch(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The first sighting per document and churn key."""
    rest = [c for c in df.columns if c != ts]
    first = churn_rows(df).groupBy("document", "churn").agg(F.min_by(F.struct(ts, *rest), F.struct(ts, "text")).alias("_r"))
    return first.select("document", "churn", "_r.*")


def stream_dedupe(stream: DataFrame, ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """The same on a stream; keys are forgotten once the watermark has passed them."""
    return churn_rows(stream).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["document", "churn"])


def late_rows(batch: DataFrame, newest: str, ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """Rows older than the watermark allows: what a stream drops silently."""
    return batch.filter(F.col(ts) < F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {watermark}"))


STATE = (
    "document string, cand_id string, seen_at timestamp, first_seen timestamp, "
    "findings array<struct<label:string,confidence:string>>"
)
CHANGES = "document string, cand_id string, seen_at timestamp, findings array<struct<label:string,confidence:string>>, kind string"
SNAPSHOT = f"{STATE}, kind string"
SNAPSHOT_COLUMNS = ["document", "cand_id", "seen_at", "first_seen", "findings", "kind"]


def upsert_findings(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Findings per document after a batch: the newest row per candidate counts, an empty finding list deletes it."""
    both = state.unionByName(batch.withColumn("first_seen", F.col("seen_at")).select(state.columns))
    newest = both.groupBy("document", "cand_id").agg(
        F.max("seen_at").alias("seen_at"), F.min("first_seen").alias("first_seen"),
        F.max_by("findings", F.struct("seen_at", "findings")).alias("findings"))
    return newest.filter(F.size("findings") > 0).select(state.columns)


def keep_latest(state: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """Of each document the ``cap`` latest findings to appear, and those that had to go."""
    latest = Window.partitionBy("document").orderBy(F.col("first_seen").desc(), F.col("cand_id"))
    ranked = state.withColumn("_rn", F.row_number().over(latest))
    return ranked.filter(F.col("_rn") <= cap).drop("_rn"), ranked.filter(F.col("_rn") > cap).drop("_rn")


def document_scores(state: DataFrame) -> DataFrame:
    sums = state.select("document", F.explode("findings").alias("f")).groupBy("document").agg(
        F.sum(points(F.col("f.confidence"))).alias("_p"))
    return sums.select("document", score_of(F.col("_p")).alias("page_score")).withColumn("band", score_band(F.col("page_score")))


def finding_changes(stream: DataFrame, ttl: str = "1 day") -> DataFrame:
    """What a stream of sightings changes, one row per change, and what it doesn't.

    State is keyed by document and candidate, so no document is too large for
    a task: the time of the newest sighting and its findings.  ``kind`` is
    ``upsert``, ``delete`` (no finding left; the key stays known as deleted, so
    an older row can't bring it back), ``stale`` (older than what is known: the
    dead letters) or ``expired`` (silent for ``ttl``).  The clock of ``ttl`` is that
    of arrival: the watermark is on the arrival time, so no row is ever dropped as late.
    Rows of one trigger are put in order of time, then findings.
    """
    import json

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    wait = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(group, frames, state):
        document, cand = group
        if state.hasTimedOut:
            at, _ = state.get
            state.remove()
            yield pd.DataFrame({"document": [document], "cand_id": [cand], "at": [at], "found": ["[]"], "kind": ["expired"]})
            return
        at, found = state.get if state.exists else (None, "[]")
        # Plain lists: most keys have a few rows, and frames of their own cost more than the rows.
        rows, newest = [], None
        for frame in frames:
            rows += zip(frame["at"].tolist(), frame["found"].tolist())
            newest = frame["arrived"].max() if newest is None else max(newest, frame["arrived"].max())
        out = []
        for now, said in sorted(rows):
            if at is not None and now < at:
                out.append((int(now), said, "stale"))
                continue
            if said != found or at is None:
                out.append((int(now), said, "upsert" if json.loads(said) else "delete"))
            at, found = int(now), said
        state.update((at, found))
        arrived = max(int(newest.timestamp() * 1000), state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(arrived + wait)
        if out:
            yield pd.DataFrame({"document": [document] * len(out), "cand_id": [cand] * len(out), "at": [x[0] for x in out],
                                "found": [x[1] for x in out], "kind": [x[2] for x in out]})

    rows = stream.select(strip_fragment(F.col("url")).alias("document"), "cand_id", F.unix_micros("seen_at").alias("at"),
                         F.to_json(F.coalesce("findings", F.array().cast("array<struct<label:string,confidence:string>>"))).alias("found"),
                         F.current_timestamp().alias("arrived")).withWatermark("arrived", "0 seconds")
    made = rows.groupBy("document", "cand_id").applyInPandasWithState(
        step, "document string, cand_id string, at long, found string, kind string", "at long, found string",
        "append", GroupStateTimeout.EventTimeTimeout)
    return made.select("document", "cand_id", F.timestamp_micros("at").alias("seen_at"),
                       F.from_json("found", "array<struct<label:string,confidence:string>>").alias("findings"), "kind")


def stream_findings(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, ttl: str = "1 day") -> StreamingQuery:
    """Append the changes of a stream to the table at ``path``; at most one pass per second by default.

    Batches are written once each, by (checkpoint, batch); see ``ledger``.  A
    new checkpoint over an old table starts with empty state and its own run:
    all it sends arrives, and readers take the newest change of each key from
    all runs, so an older row can't bring a deleted finding back.
    """
    return (finding_changes(stream, ttl).writeStream.outputMode("append").foreachBatch(ledger.appender(path, checkpoint))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start())


def newest_changes(spark: SparkSession, path: str, seen: ledger.View) -> DataFrame:
    """The newest change of each key, deletions and expiries too: the newest snapshot and later changes, nothing older."""
    log = ledger.tail_rows(spark, seen, CHANGES).filter("kind <> 'stale'").withColumn("first_seen", F.col("seen_at")).select(*SNAPSHOT_COLUMNS)
    if seen.snapshot:
        log = log.unionByName(spark.read.schema(SNAPSHOT).parquet(f"{seen.snapshot}/state"))
    order = F.struct("seen_at", (F.col("kind") == "expired").alias("last"), "findings")
    newest = log.groupBy("document", "cand_id").agg(
        F.max_by(F.struct("findings", "seen_at", "kind"), order).alias("n"), F.min("first_seen").alias("first_seen"))
    return newest.select("document", "cand_id", "n.seen_at", "first_seen", "n.findings", "n.kind")


def dead_letters(spark: SparkSession, seen: ledger.View) -> DataFrame:
    late = ledger.tail_rows(spark, seen, CHANGES).filter("kind = 'stale'").drop("kind")
    return late.unionByName(spark.read.schema(late.schema).parquet(f"{seen.snapshot}/dead")) if seen.snapshot else late


def compact_findings(spark: SparkSession, path: str) -> bool:
    """Put the newest change of each key into a new snapshot; False if there is nothing new or another compaction came first.

    Deletions stay in it, else a late row under a new checkpoint could bring a finding back.
    """
    seen = ledger.view(spark, path)
    if not seen.tail:
        return False
    return ledger.commit_snapshot(spark, path, seen, {"state": newest_changes(spark, path, seen), "dead": dead_letters(spark, seen)})


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """The findings that stand now: the newest change of each key, unless it took the finding away."""
    return newest_changes(spark, path, ledger.view(spark, path)).filter(F.size("findings") > 0).drop("kind")


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """Sightings that came after a newer one of their key."""
    return dead_letters(spark, ledger.view(spark, path))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return document_scores(read_findings(spark, path))
