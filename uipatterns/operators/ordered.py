"""Ordered work over groups that may be arbitrarily large.

A plain window sends a whole group to one task.  When one key can hold a third
of all rows that task becomes the job.  The functions here cut each group into
ordered chunks, work inside the chunks in parallel, run the only truly serial
part over one summary row per chunk, and put the two together.  Results equal
those of the plain window, whatever the chunk size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(
    df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column], chunk: Column,
) -> DataFrame:
    """Add inclusive running sums.  ``chunk`` must not decrease along ``order``.

    Every chunk gets one extra row in front that carries the sum of the chunks
    before it, so the rows themselves are shuffled once and joined to nothing.
    """
    rows = df.withColumns({"_chunk": chunk, "_row": F.lit(1), **{f"_v_{n}": c for n, c in sums.items()}})
    before = (
        Window.partitionBy(*(group or [F.lit(0)])).orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    front = (
        rows.groupBy(*group, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
        .select(*group, "_chunk", F.lit(0).alias("_row"), *[F.sum(f"_t_{n}").over(before).alias(f"_v_{n}") for n in sums])
    )
    inside = Window.partitionBy(*group, "_chunk").orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(front, allowMissingColumns=True)
    out = both.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in sums}).filter("_row = 1")
    return out.drop("_chunk", "_row", *[f"_v_{n}" for n in sums])


def previous_row(
    df: DataFrame, group: list[str], order: list[str], values: dict[str, str], chunk: Column,
) -> DataFrame:
    """Add columns of the row just before, per group.  ``values`` maps new to old names.

    The last row of each chunk is repeated in front of the group's next chunk.
    """
    rows = df.withColumns({"_chunk": chunk, "_row": F.lit(1)})
    wanted = sorted(set(values.values()))
    packed = F.struct(*wanted)
    last = rows.groupBy(*group, "_chunk").agg(F.max_by(packed, F.struct(*order)).alias("_last"))
    carried = F.lag("_last").over(Window.partitionBy(*group).orderBy("_chunk"))
    front = last.select(*group, "_chunk", F.lit(0).alias("_row"), carried.alias("_c")).filter("_c is not null").select(
        *group, "_chunk", "_row", *[F.col(f"_c.{c}").alias(c) for c in wanted if c not in group])
    inside = Window.partitionBy(*group, "_chunk").orderBy("_row", *order)
    both = rows.unionByName(front, allowMissingColumns=True)
    out = both.withColumn("_prev", F.lag(packed).over(inside)).filter("_row = 1")
    return out.withColumns({new: F.col("_prev")[old] for new, old in values.items()}).drop("_prev", "_chunk", "_row")


def row_numbers(
    df: DataFrame, group: list[str], order: list[Column], chunk: Column, name: str = "rank",
) -> DataFrame:
    """``row_number`` that does not need a whole group in one task."""
    return running_sums(df, group, order, {name: F.lit(1)}, chunk)


def hash_chunk(hashed: str, digits: int = 4) -> Column:
    """Ordered chunks of a hexadecimal hash: even by construction."""
    return F.substring(F.col(hashed), 1, digits)


def time_chunk(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col(ts)) / F.lit(seconds))
