"""From scores to findings: model input, scoring, thresholds, merge, page score."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uipatterns.functions.ids import cache_key
from uipatterns.functions.text import churn_key, matches, trim_space
from uipatterns.operators.skew import HOT_ROWS, join_by_key
from uipatterns.schema import (
    BENIGN, LABEL_DESCRIPTIONS, LABELS, LANGS, MAX_SNIPPET_CHARS,
)

# --- fixed values ------------------------------------------------------------------
DEFAULT_TAG, NO_ROLE = "span", "none"
RULE_DESCRIPTIONS = {
    "stock_counter": "A shrinking stock count is used to create urgency.",
    "countdown_timer": "A countdown timer is used to create urgency.",
    "viewer_counter": "A live viewer count is used as social pressure.",
    "prechecked_optin": "A marketing consent box starts pre-checked.",
    "hidden_optout": "The decline option is hard to see (small text, low contrast, or faded out).",
    "cta_asymmetry": "The accept button is made much more prominent than the decline option.",
    "late_fee": "A new charge appears only once you reach the payment step.",
    "cancel_offsite":
        "Cancelling routes you off the page (phone/email/another site) instead of handling it here.",
    "discount_badge":
        "A discount percentage badge may be inflated or artificial, creating a false sense of savings.",
    "forced_action_gate":
        "A required field or modal step explicitly states you must complete it to continue.",
}
CANCEL_INTENT = (
    r"\b(cancel|unsubscribe|refund|terminate|close (my )?account|opt[- ]?out|return)\b|रद्द|फिर्ता|खारेज"
)
TITLE_REASON = "product title -- seller copy, the same policy the rules follow"
SUPPORT_REASON = "support line with no cancellation wording -- an offer of help, not an obstruction"
WEIGHTS = {"likely": 2, "possible": 1}
SATURATION = 20
# --- end of fixed values -------------------------------------------------------------


def model_input(text: Column, tag: Column, role: Column) -> Column:
    return F.concat(F.lit("[TAG="), tag, F.lit("] [ROLE="), role, F.lit("] "), text)


def norm_tag(tag: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(trim_space(tag)), F.lit("")), F.lit(DEFAULT_TAG))


def norm_role(role: Column) -> Column:
    return F.coalesce(F.nullif(F.translate(F.lower(trim_space(role)), "- ", "__"), F.lit("")), F.lit(NO_ROLE))


def to_score(cands: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Candidates a scorer should see: no prose, nothing personal, not seen before.

    ``seen`` has ``page_id, cand_id, churn`` of earlier passes.
    """
    rows = cands.filter(~F.col("field").isin("prose", "personal")).withColumn(
        "churn", churn_key(F.col("selector"), F.col("text"))
    )
    if seen is None:
        return rows
    return rows.join(seen.select("page_id", "cand_id"), ["page_id", "cand_id"], "left_anti").join(
        seen.select("page_id", "churn"), ["page_id", "churn"], "left_anti"
    )


def score_distinct(
    df: DataFrame, scorer: Callable[[DataFrame], DataFrame], key: str = "model_input",
    row_id: list[str] | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Score every distinct ``key`` once and give the result to all its rows.

    ``scorer`` gets the distinct keys and adds columns.  Repeated microcopy can
    be most of the input, so the way back spreads keys with many copies.
    """
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_copies"))
    return join_by_key(df, scorer(counted), key, "_copies", row_id or df.columns, hot_rows=hot_rows, counts=counted)


def score_incremental(
    df: DataFrame, predictions: DataFrame, scorer: Callable[[DataFrame], DataFrame],
    version: str, profile: str, now: Column, ttl_seconds: int,
) -> tuple[DataFrame, DataFrame]:
    """Use stored predictions where they are valid and score the rest.

    Returns all distinct inputs with their decision, and the fresh rows to
    append to ``predictions`` (``cache_key, model_version, profile, decided_at,
    decision``).  Another version or profile has other keys, so it never hits.
    """
    keyed = df.select("lang", "tag", "role", "text").distinct().withColumn("cache_key", cache_key(
        F.lit(version), F.lit(profile), F.col("lang"), F.col("tag"), F.col("role"), F.col("text")))
    valid = predictions.filter(
        (F.col("model_version") == version) & (F.col("profile") == profile)
        & (F.col("decided_at") > now - F.make_interval(secs=F.lit(ttl_seconds)))
    )
    newest = valid.groupBy("cache_key").agg(F.max_by("decision", "decided_at").alias("decision"))
    hits = keyed.join(newest, "cache_key").withColumn("cached", F.lit(True))
    fresh = scorer(keyed.join(newest.select("cache_key"), "cache_key", "left_anti")).withColumn("cached", F.lit(False))
    store = fresh.select("cache_key", F.lit(version).alias("model_version"), F.lit(profile).alias("profile"),
                         now.alias("decided_at"), "decision")
    return hits.unionByName(fresh), store


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def score_with(
    df: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], text_col: str = "model_input",
    out: str = "probs",
) -> DataFrame:
    """Score with a caller's model.  ``load`` runs once per Python worker and
    returns a function from a batch of texts to one probability row each."""
    for module in {__name__, load.__module__} - {"__main__"}:
        cloudpickle.register_pickle_by_value(sys.modules[module])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series([[float(v) for v in row] for row in model(batch.tolist())], dtype="object")

    return df.withColumn(out, F.pandas_udf(run, "array<double>")(text_col))


def threshold_array(thresholds: dict[str, float], labels: list[str] = LABELS) -> Column:
    missing = [name for name in labels if name not in thresholds]
    if missing:
        raise ValueError(f"no threshold for {missing}")
    return F.array(*[F.lit(float(thresholds[name])) for name in labels])


def decide(df: DataFrame, thresholds: dict[str, float], probs: str = "probs", labels: list[str] = LABELS) -> DataFrame:
    """Add ``findings``, ``benign``, ``benign_score`` and ``scores`` to rows with a
    probability array in label order.  A score equal to its threshold counts, and
    the benign class is reported but never decides."""
    p, names = F.col(probs), F.array(*[F.lit(x) for x in labels])
    checked = F.when(F.size(p) == len(labels), p).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {len(labels)} scores, got "), F.size(p).cast("string")))
    )
    rows = F.zip_with(
        F.arrays_zip(names.alias("label"), threshold_array(thresholds, labels).alias("threshold")), checked,
        lambda lt, s: F.struct(lt["label"].alias("label"), s.alias("score"), lt["threshold"].alias("threshold")),
    )
    over = F.filter(rows, lambda f: (f["label"] != BENIGN) & (f["score"] >= f["threshold"]))
    # Highest score first; equal scores keep label order.
    ranked = F.array_sort(F.transform(over, lambda f: F.struct(
        (-F.bround(f["score"], 6)).alias("down"), F.array_position(names, f["label"]).alias("at"), f.alias("f"))))
    findings = F.transform(ranked, lambda r: F.struct(
        r["f"]["label"].alias("label"), F.bround(r["f"]["score"], 6).alias("score"),
        r["f"]["threshold"].alias("threshold")))
    return df.withColumn("findings", findings).withColumns({
        "benign": F.size("findings") == 0,
        "benign_score": F.bround(F.element_at(p, labels.index(BENIGN) + 1), 6),
        "scores": F.map_from_arrays(names, F.transform(p, lambda s: F.bround(s, 6))),
    })


def threshold_problems(thresholds: DataFrame, profile: str, labels: list[str] = LABELS) -> DataFrame:
    """Rows that make a threshold table unusable: ``(label, threshold, problem)``."""
    spark = thresholds.sparkSession
    need = spark.createDataFrame([(x,) for x in labels], "label string")
    mine = thresholds.filter(F.col("profile") == profile).select("label", F.col("threshold").cast("double"))
    problem = (
        F.when(F.col("threshold").isNull(), "missing or not a number")
        .when(~((F.col("threshold") > 0) & (F.col("threshold") < 1)) | F.isnan("threshold"), "out of range")
    )
    single = need.join(mine, "label", "left").withColumn("problem", problem).filter("problem is not null")
    twice = mine.groupBy("label").agg(F.min("threshold").alias("threshold"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").join(need, "label", "left_semi")
    return single.unionByName(twice.select("label", "threshold", F.lit("given more than once").alias("problem")))


def load_thresholds(thresholds: DataFrame, profile: str, labels: list[str] = LABELS) -> dict[str, float]:
    """The checked thresholds of one profile.  One row per label, so it is small by nature."""
    bad = threshold_problems(thresholds, profile, labels).limit(2 * len(labels)).collect()
    if bad:
        raise ValueError(f"profile {profile!r}: " + "; ".join(f"{r.label}: {r.problem}" for r in bad))
    rows = thresholds.filter((F.col("profile") == profile) & F.col("label").isin(labels)).collect()
    return {r.label: float(r.threshold) for r in rows}


def check_label_order(labels: list[str]) -> None:
    if list(labels) != LABELS:
        raise ValueError(f"label order drift: expected {LABELS}, got {list(labels)}")


def withhold_reason(label: Column, field: Column, role: Column, text: Column) -> Column:
    return (
        F.when((field == "title") & (role != "heading"), TITLE_REASON)
        .when((label == "obstruction") & (role == "support_link") & ~matches(text, CANCEL_INTENT), SUPPORT_REASON)
    )


def withhold(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split model findings into shown and withheld ones; the latter keep a reason."""
    tagged = findings.withColumn(
        "reason", withhold_reason(F.col("label"), F.col("field"), F.col("role"), F.col("text")))
    return tagged.filter("reason is null").drop("reason"), tagged.filter("reason is not null")


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def describe(rule: Column, label: Column) -> Column:
    return F.coalesce(_lookup(RULE_DESCRIPTIONS, rule), _lookup(LABEL_DESCRIPTIONS, label), F.lit(""))


def merge_findings(rule_hits: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Merge per label: a rule makes a finding likely, a model alone possible.

    ``rule_hits``: keys, ``rule, label`` and optionally ``seq`` (order of rules).
    ``model``: keys, ``label, score, threshold`` after ``withhold``.
    """
    seq = "seq" if "seq" in rule_hits.columns else "rule"
    rules = rule_hits.groupBy(*keys, "label").agg(F.min_by("rule", seq).alias("rule"))
    both = rules.join(model.select(*keys, "label", "score", "threshold"), [*keys, "label"], "full_outer")
    return merged_columns(both).select(
        *keys, "label", "score", "threshold", "confidence", "source", "description")


def merged_columns(both: DataFrame) -> DataFrame:
    """The merge policy on rows that have ``rule`` and/or ``score``."""
    by_rule, by_model = F.col("rule").isNotNull(), F.col("score").isNotNull()
    return both.withColumns({
        "source": F.array_compact(F.array(F.when(by_rule, F.lit("rule")), F.when(by_model, F.lit("model")))),
        "confidence": F.when(by_rule, "likely").otherwise("possible"),
        "description": F.when(by_model, _lookup(LABEL_DESCRIPTIONS, F.col("label"))).otherwise(
            describe(F.col("rule"), F.col("label"))),
        "score": F.coalesce("score", F.lit(1.0)),
        "threshold": F.when(by_model, F.col("threshold")).otherwise(F.lit(0.0)),
    })


def points(confidence: Column) -> Column:
    return F.when(confidence == "likely", WEIGHTS["likely"]).otherwise(WEIGHTS["possible"])


def score_of(total: Column) -> Column:
    """0-100 from a sum of points; half rounds up."""
    return F.floor(F.least(F.lit(1.0), F.coalesce(total, F.lit(0)) / SATURATION) * 100 + 0.5).cast("int")


def score_band(score: Column) -> Column:
    return F.when(score < 30, "low").when(score < 65, "medium").otherwise("high")


def page_score(findings: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per page of ``pages``; pages without findings score 0."""
    sums = findings.groupBy(key).agg(F.sum(points(F.col("confidence"))).alias("_points"))
    scored = pages.select(key).join(sums, key, "left").select(key, score_of(F.col("_points")).alias("page_score"))
    return scored.withColumn("band", score_band(F.col("page_score")))


def validate_snippets(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows a scorer accepts, and the others with what is wrong."""
    blank = trim_space(F.col("text")) == ""
    reason = (
        F.when(F.col("text").isNull() | (F.col("text") == ""), "empty text")
        .when(F.length("text") > MAX_SNIPPET_CHARS, "text too long")
        .when(blank, "blank text")
        .when(~F.coalesce(F.col("lang"), F.lit("en")).isin(LANGS), "unknown language")
        .when(F.length(F.col("ref")) > 200, "ref too long")
    )
    tagged = df.withColumn("reason", reason)
    good = tagged.filter("reason is null").drop("reason").withColumns(
        {"tag": norm_tag(F.col("tag")), "role": norm_role(F.col("role")), "lang": F.coalesce("lang", F.lit("en"))})
    return good, tagged.filter("reason is not null")
