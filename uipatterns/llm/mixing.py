"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uipatterns.llm.common import n_words, spare, text_key

WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, weight: Column, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources: (source, source_size, target, rate).

    ``sizes`` has one row per source with its ``source_size``; ``weight`` is
    computed over the columns ``source`` and ``place`` (from 1, by code point,
    null last).  The sources share ``share`` times the whole size by weight.
    No target exceeds ``most`` times its source; what is over goes to the
    others by weight, until no target is above.  That fixed point is a level L
    with target = min(most * size, L * weight): the sources that reach their
    limit are those of the smallest size per weight, so one pass over running
    sums finds L.  These windows see one row per source.

    A source of size 0 gets target 0 and rate 0; no source gets no rows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", weight)
    whole = Window.partitionBy()
    by_need = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "place")
    upto = by_need.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "all_size": F.sum("source_size").over(whole), "all_weight": F.sum("weight").over(whole),
        "cum_size": F.sum("source_size").over(upto), "cum_weight": F.sum("weight").over(upto)})
    # The level if the sources of smaller need, and they alone, are at their limit.
    before = (share * F.col("all_size") - most * (F.col("cum_size") - F.col("source_size"))) / (
        F.col("all_weight") - F.col("cum_weight") + F.col("weight"))
    rows = rows.withColumns({"need": F.row_number().over(by_need), "before": before})
    rows = rows.withColumn("full", most * F.col("source_size") <= F.col("before") * F.col("weight"))
    first_free = F.min(F.when(~F.col("full"), F.struct("need", "before"))).over(whole)
    rows = rows.withColumn("level", first_free["before"])
    target = F.when(F.col("full") | F.col("level").isNull(), most * F.col("source_size")).otherwise(F.col("level") * F.col("weight"))
    return rows.withColumn("target", target.cast("double")).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def coin(seed: int, *key: Column) -> Column:
    """A number from 0 up to 1 that depends on the seed and the key alone: 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2 ** 52))


def repetition_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, by_text: bool = False,
    also: Column | None = None,
) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies of each row.

    Sizes are numbers of words.  A row is taken floor(rate) times, and once
    more if its coin, drawn from seed and id, falls below the fraction.  Sizes
    are summed per source with map-side combine, so a source may hold any
    share of the rows; the rows then meet one row per source, which adaptive
    execution broadcasts or splits.

    Null or empty text: size 0, repeated like the others.  Null source: a
    source of its own, last in order.  Null id: one coin for all such rows;
    rows that share an id are likewise taken or left together.  With
    ``by_text`` the text is part of the coin's key, so that only equal rows
    (id and text) share one; ``also`` is a part of the key of one's own.  Repeated rows: each is a row of its own, with equal coins.  Empty table:
    empty result.  New columns whose names are taken get an underscore.
    """
    size, source_size, target, rate, copies = spare(docs, "size", "source_size", "target", "rate", "copies")
    sized = docs.withColumn(size, n_words(text_col))
    sizes = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("source_size"))
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place") - 1, F.lit(n)) + 1)
    targets = source_targets(sizes, weight, share, most).toDF("_source", source_size, target, rate)
    joined = sized.join(targets, sized[source_col].eqNullSafe(targets["_source"]), "left").drop("_source")
    whole = F.floor(F.col(rate))
    more = coin(seed, F.col(id_col), *[text_key(text_col)] * by_text, *([] if also is None else [also])) < F.col(rate) - whole
    return joined.withColumn(copies, (whole + more.cast("long")).cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: every row of ``docs`` as often as its plan says, with the columns of ``docs``."""
    copies = spare(docs, "size", "source_size", "target", "rate", "copies")[-1]
    plan = repetition_plan(docs, **options).filter(F.col(copies) > 0)
    return plan.select(*[plan[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(copies))).alias("_copy")).drop("_copy")


