"""Train, validation and test parts that do not leak into each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uipatterns.operators.ordered import hash_chunk, row_numbers
from uipatterns.operators.skew import HOT_ROWS, join_by_key
from uipatterns.session import cut_lineage

PARTS = ["train", "val", "test"]
PAIRS = [("train", "val"), ("train", "test"), ("val", "test")]


def part_rank(part: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in PARTS]), part)


def _assign(df: DataFrame, group: list[str], key: str, seed: str, part: Column, row_id: list[str], hot_rows: int) -> DataFrame:
    # One row per key, read several times below: the rows themselves are read twice only.
    units = cut_lineage(df.groupBy(*group, key).agg(F.count(F.lit(1)).alias("_copies")))
    hashed = units.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    ranked = row_numbers(hashed, group, [F.col("_h"), F.col(key)], hash_chunk("_h"), "_rank")
    sizes = units.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    placed = ranked.join(sizes, group).withColumn("part", part)
    # A key may occur in several groups; one part must hold it everywhere.
    one = placed.groupBy(key).agg(
        F.element_at(F.array(*[F.lit(p) for p in PARTS]), F.max(part_rank(F.col("part"))).cast("int")).alias("part"),
        F.sum("_copies").alias("_copies"))
    return join_by_key(df, one, key, "_copies", row_id, hot_rows=hot_rows)


def split_by_group(
    df: DataFrame, group: list[str], key: str, seed: str = "14", row_id: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Whole templates to parts: per group 20 % test (two at least), 15 % validation
    (one at least), the rest train.  Which templates is decided by hash."""
    n, rank = F.col("_n"), F.col("_rank")
    n_test = F.greatest(F.lit(2), F.bround(n * 0.2, 0).cast("int"))
    n_val = F.greatest(F.lit(1), F.bround(n * 0.15, 0).cast("int"))
    part = F.when(rank <= n_test, "test").when(rank <= n_test + n_val, "val").otherwise("train")
    return _assign(df, group, key, seed, part, row_id or df.columns, hot_rows)


def split_small_groups(
    df: DataFrame, group: list[str], key: str, seed: str = "21", row_id: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """About 60/15/25 over whole templates; tiny groups keep something to train on."""
    n, rank = F.col("_n"), F.col("_rank")
    n_val = F.greatest(F.lit(1), F.bround(n * 0.15, 0).cast("int"))
    n_test = F.greatest(F.lit(1), F.bround(n * 0.25, 0).cast("int"))
    tiny = n - n_val - n_test < 1
    n_train = F.when(tiny, F.greatest(F.lit(1), n - 2)).otherwise(n - n_val - n_test)
    n_val = F.when(tiny, F.least(F.lit(1), n - 1)).otherwise(n_val)
    part = F.when(rank <= n_train, "train").when(rank <= n_train + n_val, "val").otherwise("test")
    return _assign(df, group, key, seed, part, row_id or df.columns, hot_rows)


def split_random(df: DataFrame, key: str, seed: str = "15") -> DataFrame:
    """Exactly 15 % test and 15 % validation, by rank of a hash of ``key``."""
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    ranked = row_numbers(hashed, [], [F.col("_h"), F.col(key)], hash_chunk("_h"), "_rank")
    held = df.agg(F.floor(F.count(F.lit(1)) * 0.15)).scalar()
    part = F.when(F.col("_rank") <= F.col("_held"), "test").when(F.col("_rank") <= 2 * F.col("_held"), "val").otherwise("train")
    return ranked.withColumn("_held", held).withColumn("part", part).drop("_h", "_rank", "_held")


def extend_split(old: DataFrame, additions: DataFrame) -> DataFrame:
    """Add rows to a split; every row keeps the part it has."""
    return old.unionByName(additions)


def _parts_of(df: DataFrame, key: str) -> DataFrame:
    """The parts each key occurs in: three at most, so the set is small."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set("part")).alias("parts"))


def _pairs(df: DataFrame, key: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in PAIRS])
    shared = F.filter(pairs, lambda p: F.array_contains("parts", p["a"]) & F.array_contains("parts", p["b"]))
    return _parts_of(df, key).filter(F.size("parts") > 1).select(key, F.explode(shared).alias("p")).select(
        F.col("p.a").alias("part_a"), F.col("p.b").alias("part_b"), key)


def shared_keys(df: DataFrame, key: str) -> DataFrame:
    """Per pair of parts: how many keys they share, with the first three."""
    return _pairs(df, key).groupBy("part_a", "part_b").agg(
        F.count(F.lit(1)).alias("shared"), F.min(key).alias("example"))


def assert_disjoint(df: DataFrame, key: str) -> None:
    bad = shared_keys(df, key).limit(len(PAIRS)).collect()
    if bad:
        raise AssertionError("; ".join(f"{r.part_a} & {r.part_b}: {r.shared} shared, e.g. {r.example}" for r in bad))


def cross_part_duplicates(df: DataFrame) -> DataFrame:
    """Texts found in more than one part, one row per pair of parts."""
    return _pairs(df, "text")


def drop_cross_part(df: DataFrame, row_id: list[str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keep a text only in its first part (train, then val, then test).

    Copies within that part stay.  Only texts that do cross parts are joined.
    """
    rank = part_rank(F.col("part"))
    crossing = df.groupBy("text").agg(
        F.min(rank).alias("_first"), F.max(rank).alias("_last"), F.count(F.lit(1)).alias("_copies")
    ).filter(F.col("_first") < F.col("_last")).drop("_last")
    joined = join_by_key(df, crossing, "text", "_copies", row_id or df.columns, "left", hot_rows)
    keep = F.col("_first").isNull() | (part_rank(F.col("part")) == F.col("_first"))
    return joined.filter(keep).select(df.columns)


def describe_parts(df: DataFrame) -> DataFrame:
    y_cols = [c for c in df.columns if c.startswith("y_")]
    hits = sum((F.col(c) for c in y_cols), F.lit(0))
    langs = [c for c in ("lang",) if c in df.columns]
    return df.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"), *([F.countDistinct("template_id").alias("templates")] if "template_id" in df.columns else []),
        *[F.countDistinct(c).alias("langs") for c in langs], F.count_if(hits > 1).alias("multi_label"),
        *[F.sum(c).alias(c) for c in y_cols])


def pos_weights(long: DataFrame) -> DataFrame:
    """Negatives per positive for each label of ``(label, y)``; 1 without positives."""
    pos, n = F.sum("y"), F.count(F.lit(1))
    return long.groupBy("label").agg(
        F.when(pos > 0, (n - pos) / F.greatest(pos, F.lit(1))).otherwise(F.lit(1.0)).alias("pos_weight"))
