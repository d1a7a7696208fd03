"""Choosing rows for annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from uipatterns.functions.text import guess_lang, trim_space, url_no_query
from uipatterns.schema import BENIGN, GOLD_COLUMNS
from uipatterns.session import cut_lineage


def dedupe_entries(entries: DataFrame, order: str = "seq") -> DataFrame:
    """The first entry per (trimmed text, role); blank texts are dropped."""
    text = trim_space(F.coalesce("text", F.lit("")))
    rest = [order] + [c for c in entries.columns if c != order]
    keyed = entries.filter(text != "").groupBy(text.alias("_text"), F.coalesce("role", F.lit("none")).alias("_role"))
    return keyed.agg(F.min_by(F.struct(*rest), order).alias("_e")).select("_e.*").select(entries.columns)


def _pick(rows: DataFrame, budget: int, seed: str) -> DataFrame:
    """Pick ``budget`` ids from the strata of one side (``id, stratum``).

    Every stratum gives an even share, then hash order fills up.  An id lies in
    several strata when it has several labels, and counts once.  No stratum can
    give more than the budget, so its other rows stop at the first limit, before
    the shuffle.
    """
    order = Window.partitionBy("stratum").orderBy(F.md5(F.concat(F.lit(seed), F.col("stratum"), F.lit(":"), F.col("id"))), "id")
    first = rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= max(budget, 1))
    n_strata = rows.select("stratum").distinct().groupBy().agg(F.count(F.lit(1))).scalar()
    share = F.greatest(F.lit(1), F.floor(F.lit(budget) / n_strata))
    plus = F.md5(F.concat(F.lit(f"{seed}+"), F.col("id")))
    core = cut_lineage(first.withColumn("_share", share).filter(F.col("_rank") <= F.col("_share")).select("id").distinct())
    left = max(budget - core.count(), 0)
    more = rows.select("id").distinct().join(core, "id", "left_anti").orderBy(plus, "id").limit(left)
    return core.withColumn("_o", F.concat(F.lit("0"), plus)).unionByName(more.withColumn("_o", F.concat(F.lit("1"), plus)))


def stratified_sample(entries: DataFrame, target: int, seed: str = "13") -> DataFrame:
    """``target`` entries: half flagged, half known to be benign, spread over labels
    and scripts.  Entries whose outcome is unknown are left out.

    ``id`` may be missing or blank; text and role stand in for it then.
    """
    known = entries.filter(F.col("findingLabels").isNotNull()).withColumn("id", F.coalesce(
        F.nullif(F.col("id"), F.lit("")), F.concat_ws("\u0000", "text", F.coalesce("role", F.lit("none")))))
    lang = guess_lang(F.coalesce("text", F.lit("")))
    flagged = known.filter(F.size("findingLabels") > 0).select("id", F.explode("findingLabels").alias("l"), lang.alias("g"))
    flagged = flagged.select("id", F.concat_ws("|", "l", "g").alias("stratum")).distinct()
    benign = known.filter(F.size("findingLabels") == 0).select("id", F.concat_ws("|", F.lit(BENIGN), lang).alias("stratum")).distinct()

    one = cut_lineage(_pick(flagged, target // 2, seed))  # about half the target, whatever the input
    other = _pick(benign.join(one.select("id"), "id", "left_anti"), max(target - one.count(), 0), seed)
    picked = one.withColumn("_side", F.lit(0)).unionByName(other.withColumn("_side", F.lit(1))).orderBy(
        "_side", "_o", "id").limit(target).select("id")
    rows = known.join(picked, "id", "left_semi")
    rest = [c for c in known.columns if c != "id"]
    first = F.struct("seq", "text") if "seq" in rest else F.struct("text")
    return rows.groupBy("id").agg(F.min_by(F.struct(*rest), first).alias("_e")).select("id", "_e.*").select(known.columns)


def annotation_sheet(sample: DataFrame) -> DataFrame:
    """The sheet an annotator fills, columns in reading order."""
    listed = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
    return sample.select(
        "text", guess_lang(F.col("text")).alias("lang"), F.coalesce("role", F.lit("none")).alias("role"),
        F.coalesce("tag", F.lit("span")).alias("tag"), F.lit("").alias("gold_labels"), F.lit("").alias("notes"), "host",
        listed("findingLabels").alias("model_labels"), listed("ruleHits").alias("rule_hits"), "id",
        url_no_query(F.col("url")).alias("url"),
    ).select(GOLD_COLUMNS)
