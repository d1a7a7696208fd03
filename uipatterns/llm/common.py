"""What the operators of this subpackage share: the common folder, written tables, words, components."""

from __future__ import annotations

import sys
import uuid
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def by_value(module: str) -> None:
    """Send a module's functions with the tasks, so executors need not have it installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that the driver and all executors see.

    It lies below ``spark.checkpoint.dir``; where the session names none, below
    the warehouse, which is shared as well.  The caller may delete it once the
    results that were read from it are written.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table below ``folder`` and read it back: cuts the lineage and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, for plans that meet a table twice."""
    kept = {f"{c}__": F.col(c) for c in df.columns}
    return df.select([v.alias(k) for k, v in kept.items()]).select([F.col(k).alias(k[:-2]) for k in kept])


def hash_sample(df: DataFrame, size: int, *key: str) -> DataFrame:
    """About ``size`` rows of ``df``, all if it has fewer: those of smallest key hash, the same in every run.

    The hash is even, so a threshold finds them in one pass without sorting;
    the caller still limits what it collects.
    """
    rows = df.count()
    part = 1.0 if rows <= size else size / rows
    return df if part >= 1 else df.filter(F.shiftrightunsigned(F.xxhash64(*key), 11) < F.lit(int(part * 2 ** 53)))


def n_words(text: str) -> Column:
    """Number of words of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def text_key(text: str) -> Column:
    """Tells apart rows that share an id."""
    return F.xxhash64(text)


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that ``df`` doesn't have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, label) of every node of the edges (u, v): the smallest node of its component.

    Each round gives every node the smallest of its neighbours, follows that
    pointer once, and contracts the edges to what still joins two labels.  A
    round is a few joins and aggregations over edges alone; their number goes
    down geometrically, so a long chain takes logarithmically many rounds.
    """
    edges = written(edges.select("u", "v").filter("u <> v").distinct(), folder, f"{name}-edges")
    total, turn = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        first = written(first, folder, f"{name}-min{turn}")
        jump = first.alias("a").join(first.alias("b"), F.col("a.p") == F.col("b.u")).select(
            F.col("a.u").alias("node"), F.col("b.p").alias("label"))
        jump = written(jump, folder, f"{name}-jump{turn}")
        to_u, to_v = jump.toDF("u", "lu"), jump.toDF("v", "lv")
        edges = written(
            edges.join(to_u, "u").join(to_v, "v").filter("lu <> lv").select(F.col("lu").alias("u"), F.col("lv").alias("v")).distinct(),
            folder, f"{name}-edges{turn}")
        if total is None:
            total = jump
        else:
            step = jump.toDF("label", "next")
            total = written(total.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")), folder, f"{name}-all{turn}")
        turn += 1
    return total if total is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
