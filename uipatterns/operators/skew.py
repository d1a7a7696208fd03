"""Joining rows to a one-row-per-key table when few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000


def join_by_key(
    rows: DataFrame, lookup: DataFrame, key: str, copies: str, row_id: list[str], how: str = "inner",
    hot_rows: int = HOT_ROWS, counts: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to ``lookup``, which has one row per ``key`` and says in
    ``copies`` how many rows carry it.

    Keys with more than ``hot_rows`` copies are spread over several shuffle
    partitions: their rows get a salt, and their lookup row is repeated once
    per salt.  The list of hot keys is broadcast; it cannot have more than
    rows / hot_rows entries of two numbers each.  The salt comes from
    ``row_id``, so a task that is run again places its rows as before.
    ``counts`` gives key and copies where ``lookup`` is costly to compute.
    """
    # Two keys may share a hash; both then use the larger fan-out, which stays right.
    hot = (
        (lookup if counts is None else counts).filter(F.col(copies) > hot_rows)
        .groupBy(F.xxhash64(key).alias("_h"))
        .agg(F.ceil(F.max(copies) / F.lit(hot_rows)).cast("int").alias("_n"))
    )
    spread = F.coalesce(F.col("_n"), F.lit(1))
    left = (
        rows.withColumn("_h", F.xxhash64(key)).join(F.broadcast(hot), "_h", "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*row_id), spread).cast("int"))
        .drop("_h", "_n")
    )
    right = (
        lookup.drop(copies).withColumn("_h", F.xxhash64(key)).join(F.broadcast(hot), "_h", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), spread - 1)))
        .drop("_h", "_n")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")
