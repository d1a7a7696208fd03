"""Page trees as node rows, and questions about a node's ancestors.

Everything is computed inside the page row by array expressions before the
nodes are spread into rows, so no shuffle and no self-join is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uipatterns.functions.text import (
    ascii_regex, collapse_self_dup, collapse_space, own_text, page_lang, text_gate, trim_space,
)
from uipatterns.schema import MAX_TEXT, MIN_TEXT
from uipatterns.sources.html import HIDDEN, NAMED, NEAR_STEPS, SKIPPED, STYLED, VIDEO, parse_pages

# --- fixed values: element names and patterns --------------------------------
INLINE_TAGS = [
    "a", "abbr", "acronym", "b", "bdo", "big", "br", "button", "cite", "code", "dfn", "em", "i", "img",
    "input", "kbd", "label", "map", "object", "output", "q", "s", "samp", "select", "small", "span",
    "strong", "sub", "sup", "textarea", "time", "tt", "u", "var",
]

CHROME_HINT = (
    r"(?:^|[-_\s])(?:nav|navbar|nav-bar|navigation|header|topbar|top-bar|masthead|toolbar|appbar|app-bar|"
    r"site-header|global-header|gh|sticky-header|page-header)(?:[-_\s]|$)"
)
VIDEO_PLAYER = r"\b(video-?player|media-?player|vjs-|plyr|ytp-)\b"
# --- end of fixed values -------------------------------------------------------

CHROME_DEPTH = NEAR_STEPS
VIDEO_DEPTH = 6


def _slice_text(pieces: Column, lo: Column, hi: Column) -> Column:
    return F.slice(pieces, lo + 1, hi - lo)


def class_tokens(cls: Column) -> Column:
    """Distinct class tokens without the generated ones (three digits in a row)."""
    tokens = F.filter(F.split(trim_space(F.coalesce(cls, F.lit(""))), r"\s+"),
                      lambda t: (t != "") & ~t.rlike(r"[0-9]{3,}"))
    return F.array_sort(F.array_distinct(tokens))


def looks_like_twin(a: Column, b: Column) -> Column:
    """Two class-token arrays of one template: half of the smaller one is shared."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), True).when(smaller == 0, False).otherwise(
        F.size(F.array_intersect(a, b)) / smaller >= 0.5
    )


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def candidate_text(own: Column, leaf: Column) -> Column:
    """An element's own text, or its inline children's where that is unusable."""
    usable = F.length(own).between(MIN_TEXT, MAX_TEXT)
    return bind(F.when(usable, own).otherwise(F.coalesce(leaf, F.lit(""))), collapse_self_dup)


def explode_nodes(
    pages: DataFrame, text_content: bool = False, with_lang: bool = True, candidate_texts: bool = False,
    candidates_only: bool = False, kinds: bool = False, buttons: bool = False,
) -> DataFrame:
    """One row per element, in document order within a page.

    ``path`` lists steps from the root down to the element itself with what
    questions about ancestors need: the last 24, and of those above them the
    nearest of each kind that a question asks about at any distance.  ``marks``
    has a bit for each thing that some step of the whole path is, so that steps
    are only looked at one by one where one of them can answer; ``block_no``,
    ``link_no`` and ``control_no`` are the innermost non-inline ancestor, link
    and control.  ``leaf_text`` is the joined text of an
    element whose children are all text or inline; ``run_text`` is the text of
    the whole subtree.  Both are null where they would be longer than a
    candidate may be.  ``text_content=True`` adds the unbounded text of every
    subtree, ``candidate_texts=True`` the ``text`` a candidate would have;
    ``candidates_only=True`` also leaves out elements without a usable one
    before their paths are built, and skipped subtrees in the parser.

    Open shadow roots (``<template shadowrootmode="open">``) and documents of
    same-origin ``srcdoc`` frames are scopes of their own, numbered after the
    document: their paths, selectors and siblings end at the scope's root.
    ``scope`` tells the scope's number (0: the document), its kind
    (``document``, ``shadow`` or ``frame``), the element that hosts it, and
    whether that host is ``gone`` or ``dark`` (invisible).  Closed roots and
    frames from elsewhere can't be reached, as in a browser.

    ``kinds=True`` (with ``candidates_only``) emits rows of several kinds from
    the one parse: ``candidate``, ``checkbox`` with its ``label_text``,
    ``button`` if ``buttons`` is set, and one ``page`` for each page, with or
    without elements.  An element of two kinds is two rows.
    """
    if with_lang and "lang" not in pages.columns:
        pages = pages.withColumn("lang", page_lang(F.col("html")))
    parsed = parse_pages(pages, skipped=not candidates_only)

    def joined(parts: Column) -> Column:
        trimmed = F.transform(parts, trim_space)
        return collapse_space(F.array_join(F.filter(trimmed, lambda x: x != ""), " "))

    def brief(n: Column) -> Column:
        get = lambda name: node_attr(n, name)
        return F.struct(
            n["node_no"].alias("node_no"), n["tag"].alias("tag"), get("id").alias("id"), get("class").alias("cls"),
            get("role").alias("role"), get("style").alias("style"),
            (get("aria-hidden") == "true").alias("aria_hidden"), has_attr(n, "hidden").alias("hidden"),
            has_attr(n, "href").alias("href"), n["sub_end"].alias("sub_end"), n["sib_no"].alias("sib_no"),
            n["sib_n"].alias("sib_n"), n["twin"].alias("is_card"),
        )

    def leaf_of(pieces: Column, n: Column) -> Column:
        inline = (F.size(n["kids"]) > 0) & F.forall(
            n["kids"], lambda k: k["tag"].isNull() | k["tag"].isin(INLINE_TAGS))
        child_text = lambda k: F.array_join(_slice_text(pieces, k["lo"], k["hi"]), "")
        return F.when(inline & (n["text_len"] <= MAX_TEXT), joined(F.transform(n["kids"], child_text)))

    def texts(pieces: Column, n: Column) -> Column:
        parts = F.transform(F.filter(n["kids"], lambda k: k["tag"].isNull()), lambda k: pieces[k["lo"]])
        base = bind(F.struct(parts.alias("text_parts"), leaf_of(pieces, n).alias("leaf_text")), lambda t: t)
        if not (candidate_texts or candidates_only):
            return base
        return bind(base, lambda t: t.withField(
            "text", bind(own_text(t["text_parts"]), lambda own: candidate_text(own, t["leaf_text"]))))

    def usable(x: Column) -> Column:
        return text_gate(x["t"]["text"], MIN_TEXT, MAX_TEXT)

    def row_kinds(x: Column) -> Column:
        named = [F.when(usable(x), "candidate"), F.when(x["n"]["label_text"].isNotNull(), "checkbox")]
        if buttons:
            named.append(F.when(is_button(x["n"]["tag"], x["n"]["attrs"]), "button"))
        return F.array_compact(F.array(*named))

    def shape(pieces: Column, briefs: Column, scopes: Column, x: Column) -> Column:
        n, t = x["n"], x["t"]
        run = F.when(n["text_len"] <= MAX_TEXT, joined(_slice_text(pieces, n["piece_lo"], n["piece_hi"])))
        on = F.get(scopes, n["scope_no"])
        fields = [
            F.struct(n["scope_no"].alias("no"), on["kind"].alias("kind"), on["host_no"].alias("host_no"),
                     on["gone"].alias("gone"), on["dark"].alias("dark")).alias("scope"),
            *[n[c].alias(c) for c in ("node_no", "parent_no", "depth", "sub_end", "tag", "attrs")],
            n["twin"].alias("is_card"), F.transform(F.concat(n["anc"], F.array(x["i"])), lambda a: briefs[a]).alias("path"),
            *[n[c].alias(c) for c in ("marks", "block_no", "link_no", "control_no")],
            t["text_parts"].alias("text_parts"), t["leaf_text"].alias("leaf_text"), run.alias("run_text"),
        ]
        if candidate_texts or candidates_only:
            fields.append(t["text"].alias("text"))
        if kinds:
            fields += [n["label_text"].alias("label_text"), row_kinds(x).alias("kinds")]
        if text_content:
            content = F.array_join(_slice_text(pieces, n["piece_lo"], n["piece_hi"]), "")
            fields.append(content.alias("text_content"))
        return F.struct(*fields)

    def spread(page: Column) -> Column:
        nodes, pieces, scopes = page["nodes"], page["pieces"], page["page_scopes"]
        briefs = F.transform(nodes, brief)
        rows = F.transform(nodes, lambda n, i: F.struct(n.alias("n"), texts(pieces, n).alias("t"), i.alias("i")))
        if kinds:
            rows = F.filter(rows, lambda x: F.size(row_kinds(x)) > 0)
        elif candidates_only:
            rows = F.filter(rows, usable)
        return bind(briefs, lambda b: F.transform(rows, lambda x: shape(pieces, b, scopes, x)))

    kept = [c for c in parsed.columns if c not in ("pieces", "nodes", "page_scopes")]
    rows = bind(F.struct("nodes", "pieces", "page_scopes"), spread)
    if not kinds:
        return parsed.select(*kept, F.inline(rows))
    spread_rows = parsed.select(*kept, F.posexplode_outer(rows).alias("_at", "_row")).select(*kept, "_at", "_row.*")
    page = F.when(F.coalesce("_at", F.lit(0)) == 0, F.array(F.lit("page"))).otherwise(F.array().cast("array<string>"))
    both = F.concat(F.coalesce("kinds", F.array().cast("array<string>")), page)
    return spread_rows.withColumn("kind", F.explode(both)).drop("_at", "kinds")


def is_button(tag: Column, attrs: Column) -> Column:
    get = lambda name: F.coalesce(F.try_element_at(attrs, F.lit(name)), F.lit(""))
    named = F.arrays_overlap(F.split(get("class"), r"\s+"), F.array(F.lit("btn"), F.lit("button")))
    return (tag == "button") | (get("role") == "button") | ((tag == "input") & (F.lower(get("type")) == "submit")) | ((tag == "a") & named)


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def marked(bits: int) -> Column:
    """True if the node or one of its ancestors is one of ``bits`` (see ``uipatterns.sources.html``)."""
    return F.col("marks").bitwiseAND(F.lit(bits)) != 0


def near(test: Callable[[Column], Column], limit: int | None = None) -> Column:
    """True if the node or one of its ancestors passes ``test``."""
    return F.exists(path_end(limit), lambda n: F.coalesce(test(n), F.lit(False)))


def path_end(limit: int | None = None) -> Column:
    """The node and its nearest ancestors: the last ``limit`` steps of the path."""
    path = F.col("path")
    return path if limit is None else F.slice(path, -F.least(F.size(path), F.lit(limit)), F.lit(limit))


def ancestors(limit: int | None = None) -> Column:
    path = F.col("path")
    above = F.slice(path, F.lit(1), F.size(path) - 1)
    return above if limit is None else F.slice(above, -F.least(F.size(above), F.lit(limit)), F.lit(limit))


def has_attr(node: Column, name: str) -> Column:
    return F.map_contains_key(node["attrs"], name)


def node_attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def class_and_id(attrs: Column) -> Column:
    get = lambda name: F.coalesce(F.try_element_at(attrs, F.lit(name)), F.lit(""))
    return F.concat(get("class"), F.lit(" "), get("id"))


def is_skipped() -> Column:
    return marked(SKIPPED)


def prune(nodes: DataFrame) -> DataFrame:
    """Drop skipped subtrees and those marked ``aria-hidden="true"``."""
    return nodes.filter(~is_skipped())


def style_value(style: Column, prop: str) -> Column:
    """Value of one property of an inline style, lower-cased, else null."""
    found = F.regexp_extract(F.lower(style), rf"(?:^|;)\s*{prop}\s*:\s*([^;!]+)", 1)
    return F.nullif(F.trim(found), F.lit(""))


def visible_only(nodes: DataFrame) -> DataFrame:
    """Drop what the page hides through inline style or the ``hidden`` attribute, on the element, above it or above its scope's host."""
    return nodes.filter(is_visible())


def is_visible() -> Column:
    path = F.col("path")
    me = F.element_at(path, -1)

    def gone(n: Column) -> Column:
        return F.coalesce(style_value(n["style"], "display") == "none", F.lit(False)) | n["hidden"]

    # Visibility is inherited, also into a shadow root: the nearest stated value counts.
    stated = F.filter(
        F.transform(F.filter(path, lambda n: n["style"].isNotNull()), lambda n: style_value(n["style"], "visibility")),
        lambda v: v.isNotNull(),
    )
    invisible = F.coalesce(F.try_element_at(stated, F.lit(-1)) == "hidden", F.col("scope.dark"), F.lit(False))
    faded = F.coalesce(style_value(me["style"], "opacity").try_cast("double") == 0.0, F.lit(False))
    pinned = F.coalesce(style_value(me["style"], "position").isin("fixed", "sticky"), F.lit(False))
    host_gone, host_dark = (F.coalesce(f"scope.{c}", F.lit(False)) for c in ("gone", "dark"))
    closely = ~(gone(me) | invisible | faded) & (pinned | ~(F.exists(path, gone) | host_gone))
    return F.when(marked(STYLED | HIDDEN), closely).otherwise(~(host_gone | host_dark))


def drop_sticky_chrome(nodes: DataFrame) -> DataFrame:
    """Drop nodes inside a pinned navigation bar.

    Pinned comes from inline style; a source that measured layout can add
    ``chrome_top`` and ``chrome_height_ratio`` columns for the node's nearest
    pinned ancestor, which then also have to say that it sits near the top.
    """
    return nodes.filter(~in_sticky_chrome("chrome_top" in nodes.columns))


def in_sticky_chrome(measured: bool = False) -> Column:
    hint = ascii_regex(CHROME_HINT, True)

    def pinned_nav(n: Column) -> Column:
        pinned = style_value(n["style"], "position").isin("fixed", "sticky")
        named = n["tag"].isin("header", "nav") | F.coalesce(n["role"].isin("banner", "navigation"), F.lit(False))
        return pinned & (named | F.coalesce(n["id"].rlike(hint), F.lit(False))
                         | F.coalesce(n["cls"].rlike(hint), F.lit(False)))

    chrome = near(pinned_nav, CHROME_DEPTH)
    if measured:
        at_top = (F.col("chrome_top") <= 160) & (F.col("chrome_height_ratio") <= 0.4)
        chrome = chrome & F.coalesce(at_top, F.lit(True))
    return F.when(marked(STYLED), chrome).otherwise(False)


def stable_selector(max_parts: int = 6) -> Column:
    """CSS path of at most ``max_parts`` steps, starting anew at an id."""
    path = path_end(max_parts)
    has_id = lambda n: F.coalesce(n["id"] != "", F.lit(False))
    # Position of the innermost step with an id; the path starts there.
    start = F.greatest(F.array_max(F.transform(path, lambda n, i: F.when(has_id(n), i + 1).otherwise(F.lit(0)))), F.lit(1))
    escaped = lambda v: F.regexp_replace(
        F.regexp_replace(v, r"([\x21-\x2C./:-@\[-\^`{-~])", r"\\$1"), r"^([0-9])", r"\\3$1 "
    )

    def part(n: Column) -> Column:
        return (
            F.when(has_id(n), F.concat(n["tag"], F.lit("#"), escaped(n["id"])))
            .when(n["sib_n"] > 1, F.concat(n["tag"], F.lit(":nth-of-type("), n["sib_no"], F.lit(")")))
            .otherwise(n["tag"])
        )

    plain = lambda n: F.when(
        n["sib_n"] > 1, F.concat(n["tag"], F.lit(":nth-of-type("), n["sib_no"], F.lit(")"))).otherwise(n["tag"])
    steps = F.when(marked(NAMED), F.transform(F.slice(path, start, F.lit(max_parts)), part)).otherwise(F.transform(path, plain))
    return F.array_join(steps, " > ")


def in_video_player() -> Column:
    """A ``<video>``, a subtree holding one, or a player class within six levels."""
    path = path_end(VIDEO_DEPTH)
    tokens = lambda n: F.concat_ws(" ", n["cls"], n["id"])
    named = F.exists(path, lambda n: (n["tag"] == "video") | tokens(n).rlike(ascii_regex(VIDEO_PLAYER, True)))
    # The lower levels lie inside the highest one, so its subtree decides.
    top = F.element_at(path, 1)
    holds = F.exists(F.col("video_nos"), lambda v: v.between(top["node_no"], top["sub_end"]))
    return F.when(marked(VIDEO), named).otherwise(False) | holds


__all__ = [
    "ancestors", "attr", "bind", "candidate_text", "class_and_id", "class_tokens", "drop_sticky_chrome",
    "explode_nodes", "has_attr", "in_sticky_chrome", "in_video_player", "is_button", "is_skipped", "is_visible", "looks_like_twin", "marked", "near", "node_attr", "path_end", "prune",
    "stable_selector", "style_value", "visible_only",
]
