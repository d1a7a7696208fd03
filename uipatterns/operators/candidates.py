"""Candidate texts of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uipatterns.functions.ids import occurrence_id
from uipatterns.functions.text import contrast_ratio, infer_step, parse_rgb, text_gate, trim_space
from uipatterns.operators.fields import card_root, infer_field, refine_titles
from uipatterns.operators.nodes import (
    ancestors, attr, bind, explode_nodes, in_sticky_chrome, in_video_player, is_skipped, is_visible, marked,
    stable_selector, style_value,
)
from uipatterns.operators.roles import infer_role
from uipatterns.schema import DEFAULT_ROLE, MAX_TEXT, MIN_TEXT
from uipatterns.sources.html import DIALOG, FORM, LABEL, STRUCK, STYLED


#: So many nearest ancestors of a candidate are kept as scopes.
NEAR_SCOPES = 16
#: Characters of HTML whose candidates one task works on.
PART_CHARS = 2_000_000


def _stated(prop: str) -> Column:
    """The nearest value an inline style on the path states for ``prop``."""
    styled = F.filter("path", lambda n: n["style"].isNotNull())
    values = F.filter(F.transform(styled, lambda n: style_value(n["style"], prop)),
                      lambda v: v.isNotNull() & (v != "transparent"))
    return F.try_element_at(values, F.lit(-1))


def extract_candidates(
    nodes: DataFrame, layout: DataFrame | None = None, animated: DataFrame | None = None,
) -> DataFrame:
    """Candidates of ``nodes``, before any per-page step.

    ``nodes`` comes from ``explode_nodes(..., candidate_texts=True)``.
    ``layout`` may give measured ``font_px``, ``contrast``, ``opacity`` and
    ``area`` by ``(page_id, node_no)``; inline style is used otherwise.
    ``animated`` lists the ``(page_id, selector)`` whose text ticks.

    Rows with a ``kind`` keep it; those other than candidates have no text,
    card or id, so the steps for candidates pass them through.
    """
    shown = ~is_skipped() & is_visible()
    passes = text_gate(F.col("text"), MIN_TEXT, MAX_TEXT) & shown & ~in_sticky_chrome("chrome_top" in nodes.columns)
    tagged = "kind" in nodes.columns
    plain = F.col("kind") == "candidate" if tagged else F.lit(True)
    if tagged:
        passes = F.when(plain, passes).when(F.col("kind") == "checkbox", shown).otherwise(True)
    only = lambda c: F.when(plain, c) if tagged else c
    ok = nodes.filter(passes)
    style = attr("style")
    number = lambda c: F.regexp_extract(c, r"^([0-9.]+)", 1).try_cast("double")
    rows = ok.select(
        "page_id", "url", "lang", infer_step(F.col("url")).alias("step"),
        "node_no", "parent_no", "sub_end", "depth", "tag", "attrs", only(F.col("text")).alias("text"), "run_text",
        *(["kind", "label_text"] if tagged else []),
        stable_selector().alias("selector"), F.col("scope.no").alias("scope_no"),
        (F.exists("text_parts", lambda t: trim_space(t) != "") | ~plain).alias("own"),
        F.transform(ancestors(NEAR_SCOPES), lambda n: F.struct(n["node_no"].alias("no"), n["sub_end"].alias("end"))).alias("scopes"),
        F.coalesce("block_no", F.lit(-1)).alias("block_no"),
        only(card_root()).alias("card_no"),
        "link_no", "control_no", marked(LABEL).alias("in_label"), marked(DIALOG).alias("in_dialog"), marked(FORM).alias("in_form"),
        (marked(STRUCK) | F.when(
            marked(STYLED), F.coalesce(_stated("text-decoration(?:-line)?").contains("line-through"), F.lit(False))).otherwise(False)).alias("struck"),
        in_video_player().alias("in_video"),
        number(style_value(style, "font-size")).alias("font_px"),
        number(style_value(style, "opacity")).alias("opacity"),
        F.when(
            marked(STYLED),
            bind(F.struct(parse_rgb(_stated("color")).alias("fg"), parse_rgb(_stated("background-color")).alias("bg")),
                 lambda c: contrast_ratio(c["fg"], c["bg"])),
        ).alias("contrast"),
        F.lit(None).cast("double").alias("area"),
    ).withColumn("cand_id", occurrence_id(F.col("lang"), F.col("selector"), F.col("text")))
    if layout is not None:
        measured = [c for c in ("font_px", "contrast", "opacity", "area") if c in layout.columns]
        side = layout.select("page_id", "node_no", *[F.col(c).cast("double").alias(f"_{c}") for c in measured])
        rows = rows.join(side.hint("merge"), ["page_id", "node_no"], "left")  # a row per element: too many to broadcast
        rows = rows.withColumns({c: F.coalesce(f"_{c}", c) for c in measured}).drop(*[f"_{c}" for c in measured])
    if animated is not None:
        ticking = animated.select("page_id", "selector").distinct().withColumn("is_animated", F.lit(True))
        rows = rows.join(ticking, ["page_id", "selector"], "left")
        rows = rows.withColumn("is_animated", F.coalesce("is_animated", F.lit(False)))
    else:
        rows = rows.withColumn("is_animated", F.lit(False))
    col = F.col
    box = (col("tag") == "input") & F.lower(F.try_element_at("attrs", F.lit("type"))).isin("checkbox", "radio")
    return rows.withColumns({
        "checked": F.when(box, F.map_contains_key("attrs", "checked")),
        "role": infer_role(
            col("text"), col("tag"), col("lang"), col("attrs"), in_label=col("in_label"), in_dialog=col("in_dialog"),
            in_form=col("in_form"), in_video=col("in_video"), font_px=col("font_px"), is_animated=col("is_animated"),
        ),
    }).withColumn("field", infer_field(col("text"), col("tag"), col("role"), col("struck")))


def dedupe_occurrences(cands: DataFrame) -> DataFrame:
    """First in document order per page and occurrence id."""
    same = Window.partitionBy("page_id", "cand_id").orderBy("node_no")
    first = F.col("_rn") == 1
    if "kind" in cands.columns:
        first = first | (F.col("kind") != "candidate")
    return cands.withColumn("_rn", F.row_number().over(same)).filter(first).drop("_rn")


def collapse_nested(cands: DataFrame) -> DataFrame:
    """Of a wrapper and an inner element with the same text keep the inner one.

    A wrapper has no text of its own.  Node numbers are preorder, so a wrapper
    holds an equal text iff the next equal text starts before its subtree ends.
    A kept ``body`` element takes over the role of the closest wrapper that has
    a better one: donors open at their number and close after their subtree, a
    running count gives the nesting level, and the last donor of that level is
    the enclosing one.  Ordered passes only, no pairs.
    """
    col = F.col
    equal = Window.partitionBy("page_id", "text").orderBy("node_no")
    wraps = ~col("own") & F.coalesce(F.lead("node_no").over(equal) <= col("sub_end"), F.lit(False))
    marked = cands.withColumn("_wraps", wraps)
    donor = col("_wraps") & (col("role") != DEFAULT_ROLE)
    opening = F.struct(col("node_no").alias("at"), F.lit(1).alias("step"))
    closing = F.struct(col("sub_end").alias("at"), F.lit(2).alias("step"))
    events = marked.withColumn("_donor", donor).withColumn(
        "_e", F.explode(F.when(col("_donor"), F.array(opening, closing)).otherwise(F.array(opening)))
    )
    sweep = Window.partitionBy("page_id", "text").orderBy("_e.at", "_e.step", col("sub_end").desc())
    change = F.when(~col("_donor"), 0).when(col("_e.step") == 1, 1).otherwise(-1)
    leveled = events.withColumn("_level", F.sum(change).over(sweep.rowsBetween(Window.unboundedPreceding, 0)))
    level = Window.partitionBy("page_id", "text", "_level").orderBy("_e.at", "_e.step")
    opened = F.when(col("_donor") & (col("_e.step") == 1), col("role"))
    given = F.last(opened, ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, 0))
    return (
        leveled.withColumn("_given", F.when(col("_level") > 0, given))
        .filter(~col("_wraps"))
        .withColumn("role", F.when(col("role") == DEFAULT_ROLE, F.coalesce("_given", "role")).otherwise(col("role")))
        .drop("_wraps", "_donor", "_e", "_level", "_given")
    )


def cap_per_page(df: DataFrame, n: int, order: str = "node_no") -> DataFrame:
    """The first ``n`` of each page; the page plan doesn't use it."""
    first = Window.partitionBy("page_id").orderBy(order)
    return df.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= n).drop("_rn")


def page_candidates(
    pages: DataFrame, layout: DataFrame | None = None, animated: DataFrame | None = None, kinds: bool = False,
) -> DataFrame:
    """Pages to final candidates: extraction, duplicates, nesting, card titles.

    ``kinds=True`` carries the other kinds of rows of the same parse along (see
    ``explode_nodes``); buttons only where the layout has their ``area``.
    """
    areas = layout is not None and "area" in layout.columns
    cands = extract_candidates(explode_nodes(pages, candidates_only=True, kinds=kinds, buttons=kinds and areas), layout, animated)
    # One exchange: every later step works within a page and reuses it.  Those steps sort the rows several times in one
    # task, and rows are far larger there than in the exchange, by whose bytes partitions would be put together.
    parts = -(-(pages.agg(F.sum(F.length("html"))).first()[0] or 0) // PART_CHARS)
    by_page = cands.repartition(parts, "page_id") if parts > pages.sparkSession.sparkContext.defaultParallelism else cands.repartition("page_id")
    return refine_titles(collapse_nested(dedupe_occurrences(by_page)))
