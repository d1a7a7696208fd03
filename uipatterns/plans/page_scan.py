"""The whole way from pages to findings and page scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uipatterns.functions.ids import occurrence_id
from uipatterns.functions.text import collapse_space
from uipatterns.operators.candidates import page_candidates
from uipatterns.operators.rules import add_accept_area, run_rules
from uipatterns.operators.scoring import (
    decide, merged_columns, model_input, points, score_band, score_distinct, score_of, to_score, withhold_reason,
)

from uipatterns.session import cut_lineage


def tagged_hits(pages: DataFrame, animated: DataFrame | None = None, layout: DataFrame | None = None) -> DataFrame:
    """Rows of kind ``candidate`` with the rules that fire, ``checkbox`` where one fires, and one ``page`` for each page.

    All come from one parse.  A checkbox has no text of its own and so is no
    candidate; its rule is evaluated on the element, with the label that the
    parser found, and that label becomes its text.  With a ``layout`` that has
    ``area``, decline controls are compared with the buttons near them.
    """
    rows = page_candidates(pages, layout, animated, kinds=True)
    if layout is not None and "area" in layout.columns:
        rows = cut_lineage(rows)  # the sweep and the rows themselves read them
        plain = rows.filter("kind = 'candidate'")
        rows = add_accept_area(plain, rows.filter("kind = 'button'")).unionByName(
            rows.filter("kind IN ('checkbox', 'page')"), allowMissingColumns=True)
    box = F.col("kind") == "checkbox"
    rows = rows.withColumns({
        "role": F.when(box, "checkbox").otherwise(F.col("role")), "field": F.when(box, "unknown").otherwise(F.col("field")),
        "text": F.when(box, "").otherwise(F.col("text"))})
    hits = run_rules(rows).filter(F.when(box, F.size("rule_hits") > 0).otherwise(True))
    hits = hits.withColumn("text", F.when(box, collapse_space("label_text")).otherwise(F.col("text")))
    return hits.withColumn("cand_id", F.when(box, occurrence_id(F.col("lang"), F.col("selector"), F.col("text"))).otherwise(F.col("cand_id"))).drop("label_text")


def checkbox_hits(pages: DataFrame) -> DataFrame:
    """Checkboxes that start checked and whose label asks for consent."""
    return tagged_hits(pages).filter("kind = 'checkbox'").drop("kind")


def candidates_with_hits(pages: DataFrame, animated: DataFrame | None = None, layout: DataFrame | None = None) -> DataFrame:
    """Candidates and checkboxes with the rules that fire."""
    return tagged_hits(pages, animated, layout).filter("kind <> 'page'").drop("kind")


def rule_findings(cands: DataFrame) -> DataFrame:
    """Findings of rules alone: one row per candidate and label."""
    hits = cands.select("page_id", "cand_id", F.posexplode("rule_hits").alias("seq", "h"))
    first = hits.groupBy("page_id", "cand_id", F.col("h.label").alias("label")).agg(F.min_by("h.rule", "seq").alias("rule"))
    rows = first.withColumns({"score": F.lit(None).cast("double"), "threshold": F.lit(None).cast("double")})
    return merged_columns(rows).drop("rule")


def page_report(pages: DataFrame, animated: DataFrame | None = None, layout: DataFrame | None = None) -> DataFrame:
    """One row per page: candidates, findings by confidence, score and band.

    Rules only.  Pages without any candidate are in the result with score 0.
    """
    rows = tagged_hits(pages, animated, layout)
    page = F.col("kind") == "page"
    labels = F.array_distinct(F.transform("rule_hits", lambda h: h["label"]))
    # Within a page's partition: the one exchange of the candidates serves this too.
    sums = rows.groupBy("page_id", "url").agg(
        F.count_if(page).alias("pages"), F.count_if(~page).alias("candidates"), F.sum(F.when(page, 0).otherwise(F.size(labels))).alias("findings"))
    out = sums.filter("pages > 0").select(
        "page_id", "url", "candidates", F.col("findings").cast("bigint").alias("findings"), score_of(F.col("findings") * 2).alias("page_score"),
        F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("copy"))
    return out.drop("copy").withColumn("band", score_band(F.col("page_score")))


def scan_pages(
    pages: DataFrame, scorer: Callable[[DataFrame], DataFrame], thresholds: dict[str, float],
    animated: DataFrame | None = None, layout: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Candidates with merged findings, and page scores.

    ``scorer`` adds a ``probs`` array to rows with ``model_input``; each distinct
    input is scored once.
    """
    # Scoring and merging both read the candidates: parse the pages once.
    cands = cut_lineage(candidates_with_hits(pages, animated, layout).select(
        "page_id", "cand_id", "selector", "text", "tag", "role", "field", "rule_hits",
        model_input(F.col("text"), F.col("tag"), F.col("role")).alias("model_input")))
    asked = to_score(cands).select("page_id", "cand_id", "model_input")
    scored = decide(score_distinct(asked, scorer, row_id=["page_id", "cand_id"]), thresholds)
    both = cands.join(scored.select("page_id", "cand_id", F.col("findings").alias("model")).hint("merge"), ["page_id", "cand_id"], "left")
    rules = F.transform("rule_hits", lambda h, i: F.struct(h["label"].alias("label"), h["rule"].alias("rule"), i.alias("seq"),
                                                           F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("threshold")))
    model = F.transform(F.coalesce("model", F.array().cast("array<struct<label:string,score:double,threshold:double>>")),
                        lambda f: F.struct(f["label"].alias("label"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("int").alias("seq"), f["score"].alias("score"),
                                           f["threshold"].alias("threshold")))
    long = both.select("page_id", "cand_id", "field", "role", "text", F.inline(F.concat(rules, model)))
    reason = F.when(F.col("rule").isNull(), withhold_reason(F.col("label"), F.col("field"), F.col("role"), F.col("text")))
    shown = long.withColumn("reason", reason).filter("reason is null")
    per_label = shown.groupBy("page_id", "cand_id", "label").agg(
        F.min_by("rule", "seq").alias("rule"), F.max("score").alias("score"), F.max("threshold").alias("threshold"))
    findings = merged_columns(per_label)
    sums = findings.groupBy("page_id").agg(F.sum(points(F.col("confidence"))).alias("_p"))
    scores = pages.select("page_id", "url").join(sums, "page_id", "left").select(
        "page_id", "url", score_of(F.col("_p")).alias("page_score")).withColumn("band", score_band(F.col("page_score")))
    return findings, scores
