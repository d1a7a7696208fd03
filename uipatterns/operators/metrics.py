"""Multi-label evaluation on long rows ``(row_id, label, y, p[, prob, lang])``.

``y`` and ``p`` are 0/1.  Everything is a sum per label, so the work is one
shuffle of partial sums whatever the number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uipatterns.functions.text import WS
from uipatterns.operators.ordered import running_sums
from uipatterns.schema import BENIGN

# --- fixed values ------------------------------------------------------------------
# 91 thresholds from 0.05 in steps of 0.01, as doubles accumulate them.
GRID = [0.05 + i * ((0.05 + 0.01) - 0.05) for i in range(91)]
PROFILES = {"precision": (0.80, None), "balanced": (None, None), "recall": (None, 0.80)}
# --- end of fixed values -------------------------------------------------------------


def ratio(num: Column, den: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def apply_thresholds(scores: DataFrame, thresholds: DataFrame | float, on_missing: float | None = 0.5) -> DataFrame:
    """Add ``p``.  ``thresholds`` has one row per label; ``on_missing=None`` makes a
    label without one an error."""
    if not isinstance(thresholds, DataFrame):
        return scores.withColumn("p", (F.col("prob") >= float(thresholds)).cast("int"))
    cut = F.col("_cut")
    if on_missing is None:
        cut = F.coalesce(cut, F.raise_error(F.concat(F.lit("no threshold for "), F.col("label"))).cast("double"))
    else:
        cut = F.coalesce(cut, F.lit(float(on_missing)))
    side = thresholds.select("label", F.col("threshold").alias("_cut"))
    return scores.join(side, "label", "left").withColumn("p", (F.col("prob") >= cut).cast("int")).drop("_cut")


def counts(df: DataFrame, by: list[str]) -> DataFrame:
    hit = lambda y, p: F.sum(((F.col("y") == y) & (F.col("p") == p)).cast("bigint"))
    return df.groupBy(*by).agg(
        hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), F.count(F.lit(1)).alias("n"))


def rates(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "support": tp + fn, "predicted": tp + fp,
    })


def per_class(df: DataFrame, by: tuple[str, ...] = ("label",)) -> DataFrame:
    return rates(counts(df, list(by))).select(*by, "precision", "recall", "f1", "support", "predicted")


def average_precision(df: DataFrame, chunks: int = 64) -> DataFrame:
    """Average precision per label; equal scores are one step; null without positives.

    Steps are worked on in chunks of log odds, ``chunks`` to a unit, so scores
    that crowd near 0 or 1, as a classifier's do, are spread as well.
    """
    steps = df.groupBy("label", "prob").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    p = F.col("prob")
    rising = F.when(p <= 0, -1_000_000).when(p >= 1, 1_000_000).otherwise(F.floor(F.ln(p / (1 - p)) * chunks))
    falling = -rising
    cum = running_sums(steps, ["label"], [F.col("prob").desc()], {"tp": F.col("pos"), "seen": F.col("n")}, falling)
    # Sum of (recall step) x precision, with recall's denominator taken out.
    return cum.groupBy("label").agg(
        F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("_area"), F.sum("pos").alias("_pos")
    ).select("label", F.when(F.col("_pos") > 0, F.col("_area") / F.col("_pos")).alias("avg_precision"))


def summary(df: DataFrame, benign: str = BENIGN, by: tuple[str, ...] = ()) -> DataFrame:
    """Macro and micro figures per group of ``by``; ``benign`` stays out of the dark ones."""
    dark = F.col("label") != benign
    per_label = rates(counts(df, [*by, "label"]))
    cells = per_label.groupBy(*by).agg(
        F.avg(F.when(dark, F.col("f1"))).alias("macro_f1_dark"), F.avg("f1").alias("macro_f1_all"),
        ratio(2 * F.sum("tp"), F.sum(2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("micro_f1"),
        F.avg(F.when(dark, F.col("precision"))).alias("macro_precision_dark"),
        F.avg(F.when(dark, F.col("recall"))).alias("macro_recall_dark"),
        (1 - F.sum(F.col("fp") + F.col("fn")) / F.sum("n")).alias("hamming_accuracy"),
    )
    rows = df.groupBy(*by, "row_id").agg(F.bool_and(F.col("y") == F.col("p")).alias("ok")).groupBy(*by).agg(
        F.avg(F.col("ok").cast("double")).alias("exact_match"), F.count(F.lit(1)).alias("n_rows"))
    if by:
        return cells.join(rows, list(by))
    return cells.withColumn("_r", rows.select(F.struct("exact_match", "n_rows")).scalar()).select(*cells.columns, "_r.*")


def per_language(df: DataFrame, benign: str = BENIGN) -> DataFrame:
    return summary(df, benign, ("lang",)).select(
        "lang", F.col("n_rows").alias("n"), "macro_f1_dark", "micro_f1")


def spread(languages: DataFrame) -> DataFrame:
    return languages.agg(
        (F.max("macro_f1_dark") - F.min("macro_f1_dark")).alias("spread"),
        F.min_by("lang", F.struct("macro_f1_dark", "lang")).alias("worst_lang"),
    ).withColumn("lags", F.col("spread") > 0.10)


def macro_supported(df: DataFrame, benign: str = BENIGN) -> DataFrame:
    rows = per_class(df).filter(F.col("label") != benign)
    has = F.col("support") > 0
    return rows.agg(
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
        F.coalesce(F.avg(F.when(has, F.col("f1"))), F.lit(0.0)).alias("macro_f1_supported"),
        F.count_if(has).alias("n_supported"),
    )


def label_sets(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per ``row_id`` with its true and predicted labels (at most one of each kind)."""
    pick = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) == 1, F.col("label"))))
    return df.groupBy("row_id").agg(pick("y").alias("gold"), pick("p").alias("pred"),
                                    *[F.min(c).alias(c) for c in keep])


def confusion_pairs(df: DataFrame, k: int = 12) -> DataFrame:
    """The ``k`` most frequent (missed label, label predicted instead) pairs."""
    sets = label_sets(df.filter(F.col("y") != F.col("p")))  # agreeing labels cancel out
    return (
        sets.select(F.explode("gold").alias("true"), "pred")
        .select("true", F.explode("pred").alias("predicted_instead"))
        .groupBy("true", "predicted_instead").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "true", "predicted_instead").limit(k)
    )


def error_rows(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per wrong (row, label) with the row's label sets as text."""
    words = lambda a: F.coalesce(F.nullif(F.array_join(a, " "), F.lit("")), F.lit(BENIGN))
    sets = label_sets(df, keep)
    wrong = F.concat(
        F.transform(F.array_except("pred", "gold"), lambda x: F.struct(F.lit("false_positive").alias("kind"), x.alias("label"))),
        F.transform(F.array_except("gold", "pred"), lambda x: F.struct(F.lit("false_negative").alias("kind"), x.alias("label"))),
    )
    return sets.select(
        "row_id", *keep, words(F.col("gold")).alias("gold_labels"), words(F.col("pred")).alias("predicted_labels"),
        F.explode(wrong).alias("e"),
    ).select("e.kind", "e.label", "row_id", *keep, "gold_labels", "predicted_labels")


def error_examples(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rows with a false positive and the first ``n`` with a false negative."""
    first = Window.partitionBy("kind").orderBy("row_id")
    rows = error_rows(df).select("kind", "row_id", "gold_labels", "predicted_labels").distinct()
    return rows.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= n).drop("_rn")


def at_thresholds(scores: DataFrame, grid: list[float] = GRID, by: tuple[str, ...] = ("label",)) -> DataFrame:
    """Counts and rates per group at every threshold of ``grid``.

    Each row falls into one of ``len(grid) + 1`` bins, the number of thresholds
    at or below its score.  Sums per bin, added up from the top, give the counts
    at every threshold: rows are read once instead of once per threshold.
    """
    steps = F.array(*[F.lit(g) for g in grid])
    bin_no = reduce(lambda a, g: a + (F.col("prob") >= g).cast("int"), grid, F.lit(0))
    bins = scores.groupBy(*by, bin_no.alias("bin")).agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    # Bins per label are few and fixed, so they fit one array per label.
    packed = bins.groupBy(*by).agg(F.collect_list(F.struct("bin", "pos", "n")).alias("bins"), F.sum("pos").alias("all_pos"))
    at = packed.select(*by, "all_pos", "bins", F.posexplode(steps).alias("i", "threshold"))
    over = F.filter("bins", lambda b: b["bin"] > F.col("i"))
    add = lambda f: F.aggregate(over, F.lit(0).cast("bigint"), lambda acc, b: acc + b[f])
    counted = at.withColumns({"tp": add("pos"), "_p": add("n")}).withColumns(
        {"fp": F.col("_p") - F.col("tp"), "fn": F.col("all_pos") - F.col("tp")})
    return rates(counted).select(*by, "i", "threshold", "precision", "recall", "f1")


def _best(rows: DataFrame, ok: Column, by: tuple[str, ...]) -> DataFrame:
    """The first threshold of best F1 among those that are ``ok``, else among all."""
    best = F.struct("f1", (-F.col("i")).alias("down"), "threshold", "precision", "recall")
    return rows.groupBy(*by).agg(F.max(F.when(ok, best)).alias("met"), F.max(best).alias("any")).select(
        *by, *[F.coalesce(F.col(f"met.{c}"), F.col(f"any.{c}")).alias(c) for c in ("threshold", "f1", "precision", "recall")],
        F.col("met").isNull().alias("constraint_unmet"),
    )


def _above(floor: Column | float | None, rate: str) -> Column:
    limit = floor if isinstance(floor, Column) else F.lit(floor).cast("double")
    return F.coalesce(F.col(rate) >= limit, F.lit(True))


def sweep(scores: DataFrame, grid: list[float] = GRID, min_precision: float | None = None,
          min_recall: float | None = None, by: tuple[str, ...] = ("label",)) -> DataFrame:
    """Best-F1 threshold per label under optional floors."""
    ok = _above(min_precision, "precision") & _above(min_recall, "recall")
    return _best(at_thresholds(scores, grid, by), ok, by)


def tune_profiles(scores: DataFrame, profiles: dict = PROFILES, grid: list[float] = GRID) -> DataFrame:
    """Thresholds for each profile, rounded to three places, with edge and weak marks.

    All profiles choose from the same counts: the scores are read once.
    """
    floors = F.array(*[
        F.struct(F.lit(name).alias("profile"), F.lit(p).cast("double").alias("min_p"), F.lit(r).cast("double").alias("min_r"))
        for name, (p, r) in profiles.items()])
    rows = at_thresholds(scores, grid).withColumn("_f", F.explode(floors)).select("*", "_f.*")
    ok = _above(F.col("min_p"), "precision") & _above(F.col("min_r"), "recall")
    return _best(rows, ok, ("profile", "label")).withColumn("threshold", F.bround("threshold", 3)).withColumns({
        "at_edge": (F.col("threshold") <= 0.06) | (F.col("threshold") >= 0.94), "weak": F.col("precision") < 0.50,
    })


def leakage_gap(primary: DataFrame, leaky: DataFrame, benign: str = BENIGN) -> DataFrame:
    macro = lambda df: df.groupBy().agg(F.avg("f1"))
    dark = lambda df: macro(per_class(df).filter(F.col("label") != benign))
    both = dark(primary).toDF("primary").withColumn("leaky", dark(leaky).scalar())
    return both.withColumn("gap", F.col("leaky") - F.col("primary"))


def parity(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compare two models' ``(row_id, label, prob, p)``: per label, and overall with a verdict."""
    both = a.select("row_id", "label", F.col("prob").alias("pa"), F.col("p").alias("a")).join(
        b.select("row_id", "label", F.col("prob").alias("pb"), F.col("p").alias("b")), ["row_id", "label"])
    diff, same = F.abs(F.col("pa") - F.col("pb")), (F.col("a") == F.col("b")).cast("double")
    by_label = both.groupBy("label").agg(
        F.sum("a").cast("bigint").alias("a_pos"), F.sum("b").cast("bigint").alias("b_pos"), F.avg(same).alias("agreement"),
        F.avg(diff).alias("drift"), F.sum(diff).alias("_d"), F.max(diff).alias("_m"), F.count(F.lit(1)).alias("_n"),
        F.sum(same).alias("_s"),
    ).withColumn("flag", F.when((F.col("a_pos") >= 5) & (F.col("b_pos") < F.col("a_pos") * 0.5), "COLLAPSED")
                 .when(F.col("agreement") < 0.97, "DISAGREES").otherwise(""))
    rows = both.groupBy("row_id").agg(F.bool_and(F.col("a") == F.col("b")).alias("ok")).agg(
        F.avg(F.col("ok").cast("double")).alias("row_agreement"))
    total = by_label.agg(
        (F.sum("_d") / F.sum("_n")).alias("mean_abs"), F.max("_m").alias("max_abs"),
        (F.sum("_s") / F.sum("_n")).alias("label_agreement"), F.count_if(F.col("agreement") < 0.97).alias("disagreeing"),
        F.count_if((F.col("a_pos") >= 5) & (F.col("b_pos") < F.col("a_pos") * 0.5)).alias("collapsed"),
    ).withColumn("row_agreement", rows.scalar())
    passed = (F.col("mean_abs") < 0.02) & (F.col("label_agreement") >= 0.99) & (F.col("disagreeing") == 0) & (
        F.col("collapsed") == 0)
    return by_label.drop("_d", "_m", "_n", "_s"), total.withColumn("passed", passed)


def sample_per_lang(df: DataFrame, n: int = 600, seed: str = "13", key: str = "row_id") -> DataFrame:
    """``n`` rows per language in hash order."""
    order = Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")


def fertility(df: DataFrame, unk: str = "[UNK]", special: int = 2) -> DataFrame:
    """Tokens per word and per snippet from ``(model_key, lang, text, tokens)``.

    ``p95_tokens`` counts the ``special`` tokens a model puts around a text.
    """
    n = F.size("tokens")
    words = F.greatest(F.size(F.filter(F.split("text", WS), lambda w: w != "")), F.lit(1))
    unknown = F.size(F.filter("tokens", lambda t: t == unk))
    return df.groupBy("model_key", "lang").agg(
        F.round(F.sum(n) / F.sum(words), 3).alias("fertility"), F.round(F.avg(n), 1).alias("tokens_per_snippet"),
        F.floor(F.percentile(n + special, F.lit(0.95))).cast("bigint").alias("p95_tokens"),
        F.round(F.sum(unknown) / F.greatest(F.sum(n), F.lit(1)), 5).alias("unk_rate"),
    )


def fertility_report(res: DataFrame, langs: list[str], hard: str, easy: str, max_tokens: int = 64) -> DataFrame:
    """One row per model: fertility by language, hard/easy ratio, best model and warnings."""
    wide = res.groupBy("model_key").pivot("lang", langs).agg(F.first("fertility"))
    flags = res.groupBy("model_key").agg(F.max("unk_rate").alias("worst_unk"), F.max("p95_tokens").alias("max_p95"))
    best = Window.partitionBy(F.lit(0)).orderBy(F.col(hard).asc_nulls_last(), "model_key")  # one row per model
    return wide.join(flags, "model_key").withColumns({
        "ratio": F.col(hard) / F.col(easy), "is_best": F.row_number().over(best) == 1,
        "exclude": F.col("worst_unk") > 0.005, "too_long": F.col("max_p95") > max_tokens,
    })


def parse_labels(cell: Column) -> Column:
    """A label cell (blanks and commas between names) as a sorted array without benign."""
    names = F.split(F.translate(cell, ",", " "), WS)
    return F.array_sort(F.array_remove(F.array_distinct(F.filter(names, lambda x: x != "")), BENIGN))


def ablation(gold: DataFrame, model: DataFrame, rules: DataFrame, benign: str = BENIGN) -> DataFrame:
    """Model alone against model with rules.

    ``gold``: ``row_id, label, y``; ``model`` and ``rules``: ``row_id, label`` of
    what each says.  One row with both figures and their differences.
    """
    said = model.select("row_id", "label", F.lit(1).alias("m"), F.lit(0).alias("r")).unionByName(
        rules.select("row_id", "label", F.lit(0).alias("m"), F.lit(1).alias("r")))
    said = said.groupBy("row_id", "label").agg(F.max("m").alias("m"), F.max("r").alias("r"))
    both = gold.filter(F.col("label") != benign).join(said, ["row_id", "label"], "left").fillna(0, ["m", "r"])
    rows = both.select("row_id", "label", "y", F.explode(F.array(
        F.struct(F.lit("model").alias("variant"), F.col("m").alias("p")),
        F.struct(F.lit("merged").alias("variant"), F.greatest("m", "r").alias("p")))).alias("v"))
    scored = per_class(rows.select("row_id", "label", "y", "v.variant", "v.p"), ("variant", "label"))
    pick = lambda v, c, only: F.coalesce(
        F.avg(F.when((F.col("variant") == v) & only, F.col(c))), F.lit(0.0))
    every, has = F.lit(True), F.col("support") > 0
    return scored.agg(
        pick("model", "f1", every).alias("macro_model"), pick("merged", "f1", every).alias("macro_merged"),
        pick("model", "f1", has).alias("supported_model"), pick("merged", "f1", has).alias("supported_merged"),
    ).withColumns({"delta": F.col("macro_merged") - F.col("macro_model"),
                   "delta_supported": F.col("supported_merged") - F.col("supported_model")})


def latency_report(timings: DataFrame, budget_ms: float | None = None, percents: tuple[int, ...] = (50, 95),
                   chunks: int = 4096) -> DataFrame:
    """Nearest-rank percentiles per case, and whether the last one keeps the budget.

    ``timings``: ``case, ms``.  Equal values are counted first, then added up,
    in chunks of the logarithm, so that any scale of values is spread.
    """
    steps = timings.groupBy("case", "ms").agg(F.count(F.lit(1)).alias("n"))
    cum = running_sums(steps, ["case"], [F.col("ms")], {"upto": F.col("n")}, F.when(F.col("ms") > 0, F.floor(F.ln("ms") * chunks)).otherwise(-10_000_000))
    total = timings.groupBy("case").agg(F.count(F.lit(1)).alias("total"), F.min("ms").alias("min"), F.max("ms").alias("max"))
    joined = cum.join(total, "case")

    def nearest(p: int) -> Column:
        rank = F.least(F.col("total"), F.greatest(F.lit(1), F.bround(F.lit(p / 100.0) * F.col("total") + 0.5, 0).cast("bigint")))
        return F.min(F.when(F.col("upto") >= rank, F.col("ms"))).alias(f"p{p}")

    out = joined.groupBy("case", "min", "max").agg(*[nearest(p) for p in percents])
    if budget_ms is None:
        return out
    return out.withColumn("verdict", F.when(F.col(f"p{percents[-1]}") > budget_ms, "OVER").otherwise("ok"))
