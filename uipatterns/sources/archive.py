"""The scan archive on a file system, partitioned by host and day."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uipatterns.functions.text import archive_host, host_of, safe_segment, utc_day
from uipatterns.operators.traces import latest_per_scan
from uipatterns.schema import TRACE_ENTRY
from uipatterns.session import cut_lineage, work_tasks
from uipatterns.streaming.ledger import Files

BUSY_DAY = 5_000  # scans of a host and day that make one file

_ENTRIES = f"array<{TRACE_ENTRY.simpleString()}>"


def read_traces(spark: SparkSession, path: str, one_per_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """Entries of traces in any of their three shapes, and the documents refused.

    A trace is a bare array, an object with ``entries``, or an exported object
    with ``rows``.  It is one file, or, where many were packed together, one
    line of a file.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=one_per_file).withColumn(
        "file", F.col("_metadata.file_path"))
    body = F.trim("value")
    inner = F.when(body.startswith("["), body).otherwise(
        F.coalesce(F.get_json_object("value", "$.entries"), F.get_json_object("value", "$.rows")))
    url = F.when(body.startswith("{"), F.get_json_object("value", "$.url"))
    parsed = files.withColumns({
        "entries": F.from_json(inner, _ENTRIES), "url": F.coalesce(url, F.lit("")),
        "scan_id": F.when(body.startswith("{"), F.get_json_object("value", "$.scan_id")),
    })
    good = parsed.filter("entries is not null").select(
        "file", "scan_id", "url", host_of(F.col("url"), "").alias("host"), F.posexplode("entries").alias("seq", "e"))
    bad = parsed.filter("entries is null").select("file", F.lit("not a trace").alias("reason"))
    return good.select("file", "scan_id", "url", "host", "seq", "e.*"), bad


def write_archive(traces: DataFrame, path: str) -> None:
    """Write the newest capture per scan under host/year/month/day.

    A scan stays in the partition of its first capture, so a re-sent scan
    replaces its earlier capture whatever day it comes on.  Only partitions
    that get captures are read and rewritten: the archive's scan ids are read
    alone to find them, then the partitions by a filter on their names.
    """
    spark = traces.sparkSession
    keyed = latest_per_scan(traces).withColumns({
        "host": safe_segment(archive_host(F.col("url")), "unknown-host"), **{name: F.date_format(utc_day(F.col("captured_at")), form) for name, form in (("year", "yyyy"), ("month", "MM"), ("day", "dd"))},
    })
    day = ["host", "year", "month", "day"]
    merged = keyed
    if Files(spark, path).exists(path):
        archive = read_archive(spark, path)
        keyed = cut_lineage(keyed)  # read for its scans, its days and its captures
        known = archive.select("scan_id", F.struct(*day).alias("_at")).join(keyed.select("scan_id").distinct(), "scan_id", "left_semi").groupBy(
            "scan_id").agg(F.min("_at").alias("_at"))
        placed = cut_lineage(keyed.join(known, "scan_id", "left").withColumns({c: F.coalesce(F.col("_at")[c], F.col(c)) for c in day}).drop("_at"))
        # One row per host and day of this batch; few are a filter on names, many a join.
        touched = placed.select(*day).distinct()
        few = [tuple(r) for r in touched.limit(201).collect()]
        old = archive.filter(F.struct(*day).isin([F.struct(*[F.lit(v) for v in d]) for d in few])) if len(few) <= 200 else archive.join(
            touched, day, "left_semi")
        merged = latest_per_scan(placed.unionByName(old, allowMissingColumns=True).select(keyed.columns))
    # The read above must be finished before its files are replaced.
    stage = f"{path.rstrip('/')}_stage/{uuid.uuid4().hex}"
    merged.write.mode("overwrite").parquet(stage)
    staged = spark.read.parquet(stage)
    # Rows of one day stay together, in one file: only busy days, of which there can't be many, are cut by scan.
    busy = staged.groupBy(*day).agg(F.ceil(F.count(F.lit(1)) / BUSY_DAY).cast("int").alias("_n")).filter("_n > 1")
    cut = staged.join(F.broadcast(busy), day, "left").withColumn("_cut", F.pmod(F.xxhash64("scan_id"), F.coalesce("_n", F.lit(1)))).drop("_n")
    # The executors put their files into place, else the driver would move them one by one.
    (cut.repartition(work_tasks(spark), *day, "_cut").drop("_cut").write.mode("overwrite")
     .options(**{"partitionOverwriteMode": "dynamic", "mapreduce.fileoutputcommitter.algorithm.version": "2"}).partitionBy(*day).parquet(path))


def read_archive(spark: SparkSession, path: str, host: str | None = None) -> DataFrame:
    """Archived traces; with ``host`` only that host's folders are listed."""
    rows = spark.read.schema(ARCHIVE).parquet(path)
    return rows if host is None else rows.filter(F.col("host") == host)


ARCHIVE = (
    f"scan_id string, captured_at timestamp, url string, page_score int, entries {_ENTRIES}, "
    "host string, year string, month string, day string"
)
