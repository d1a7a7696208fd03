"""Semantic role of an element: one ordered CASE over structure and wording."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uipatterns.functions.text import by_lang, matches
from uipatterns.operators.nodes import bind, class_and_id
from uipatterns.schema import DEFAULT_ROLE, ROLES

# --- fixed values: word lists and patterns that decide a role ----------------
DECLINE_WORDS = {
    "en": ["cancel", "no thanks", "decline", "skip", "not now", "maybe later"],
    "hi": ["रद्द करें", "नहीं धन्यवाद", "अभी नहीं"],
    "ne": ["रद्द गर्नुहोस्", "पछि", "अहिले होइन"],
}
CTA_WORDS = {
    "en": ["buy", "add to cart", "checkout", "continue", "confirm", "subscribe", "get started"],
    "hi": ["खरीदें", "जारी रखें", "अभी सदस्यता लें"],
    "ne": ["किन्नुहोस्", "जारी राख्नुहोस्", "सदस्यता लिनुहोस्"],
}
SUPPORT_WORDS = {
    "en": ["contact support", "contact us", "help center", "help section", "customer service", "call us"],
    "hi": ["सहायता केंद्र", "हमसे संपर्क करें", "हमें कॉल"],
    "ne": ["सहायता केन्द्र", "हामीलाई सम्पर्क गर्नुहोस्", "हामीलाई कल", "हामीलाई फोन"],
}
WORDS = {"decline": DECLINE_WORDS, "cta": CTA_WORDS, "support": SUPPORT_WORDS}

FINE_PRINT = r"fine-?print|disclaimer|legal|terms?[-_]?(and|&)?[-_]?conditions"
BADGE = r"\bbadge\b"
PROMO = r"promo|discount|deal|offer|pdp-discount|price-discount|deal-badge"
TOAST = r"toast|snackbar"
MODAL = r"modal|dialog|popup|overlay"
HELP = r"help|hint|tooltip"
LINE_ITEM = r"line-?item|cart-?item|price-?row|order-?item"
STOCK = r"stock|inventory"
TIMER = r"timer|countdown"
BANNER = r"banner|announcement"
DISCOUNT_TEXT = r"(?:^|\s)-\d+%(?:\s|$)|\b\d+%\s*off\b|\bsave\s+[\d,]+|\bsave\s+\d+%"
CLOCK = r"\b\d{1,2}:\d{2}(:\d{2})?\b"

CAROUSEL = (
    r"\b(carousel|slider|slide|gallery)\b.*\b(next|prev(ious)?)\b|"
    r"\b(next|prev(ious)?)\b.*\b(carousel|slider|slide|gallery)\b"
)
PAGINATION = r"\bpagination\b|\b(next|prev(ious)?)[\s-]*page\b|\bpage[\s-]*(next|prev(ious)?)\b"
FILTER_SORT = r"\b(filter|sort)\b"
EXPAND = r"\b(expand|collapse|accordion)\b"
CLOSE = r"^(close|dismiss|×|✕|✖)$"
QUANTITY = r"\b(qty|quantity)\b|\b(increase|decrease|increment|decrement)\b"
MENU = r"\b(dropdown|menu)\b"
# --- end of fixed values -------------------------------------------------------


def keyword_pattern(words: list[str]) -> str:
    """Latin words match whole, words of other scripts match anywhere."""
    latin = [re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", w) for w in words if w.isascii()]
    other = [w for w in words if not w.isascii()]
    return "|".join(([rf"\b(?:{'|'.join(latin)})\b"] if latin else []) + other)


def matches_any(text: Column, lang: Column, kind: str) -> Column:
    """Does the text hold a ``decline``, ``cta`` or ``support`` keyword of its language?"""
    return by_lang(lang, text, {name: keyword_pattern(w) for name, w in WORDS[kind].items()})


def _get(attrs: Column, name: str) -> Column:
    return F.try_element_at(attrs, F.lit(name))


def accessible_name(attrs: Column) -> Column:
    return F.coalesce(_get(attrs, "aria-label"), _get(attrs, "title"), F.lit(""))


def is_generic_control(attrs: Column, text: Column) -> Column:
    """Carousel, pager, filter, expander, close, quantity and menu controls."""
    name, tokens = F.lower(accessible_name(attrs)), class_and_id(attrs)
    either = "|".join(f"(?:{p})" for p in (CAROUSEL, PAGINATION, FILTER_SORT, EXPAND, QUANTITY))
    return (
        F.map_contains_key(attrs, "aria-expanded") | F.map_contains_key(attrs, "aria-haspopup")
        | matches(name, either) | matches(tokens, either)
        | matches(F.trim(text), CLOSE) | matches(tokens, MENU)
    )


def infer_role(
    text: Column, tag: Column, lang: Column, attrs: Column, *,
    in_label: Column | None = None, in_dialog: Column | None = None, in_form: Column | None = None,
    in_video: Column | None = None, font_px: Column | None = None, is_animated: Column | None = None,
) -> Column:
    no = F.lit(False)
    name = lambda c: F.coalesce(c, no) if c is not None else no
    in_label, in_dialog, in_form, in_video, animated = map(name, (in_label, in_dialog, in_form, in_video, is_animated))
    attrs = F.coalesce(attrs, F.create_map().cast("map<string,string>"))
    role_attr = F.coalesce(_get(attrs, "role"), F.lit(""))
    type_attr = F.lower(F.coalesce(_get(attrs, "type"), F.lit("")))
    contact = (tag == "a") & F.coalesce(_get(attrs, "href"), F.lit("")).rlike("^(mailto:|tel:)")
    small = F.coalesce(font_px < 11, no) if font_px is not None else no
    needed = F.map_contains_key(attrs, "required")
    wording = F.lower(F.coalesce(F.nullif(text, F.lit("")), accessible_name(attrs)))

    def by_wording(words: Column, tokens: Column) -> Column:
        named = lambda pattern: (tokens != " ") & matches(tokens, pattern)
        return (
            F.when((tag == "input") & (type_attr == "checkbox"), "checkbox")
            .when(tag.rlike("^h[1-6]$"), "heading")
            .when((tag == "nav") | (role_attr == "navigation"), "nav")
            .when(tag == "form", "form")
            .when((tag == "label") | in_label, "label")
            .when(tag.isin("input", "select", "textarea") & needed & in_form, "form_gate")
            .when(in_dialog | (role_attr == "dialog") | named(MODAL), "modal_text")
            .when(matches_any(words, lang, "support") | contact, "support_link")
            .when(matches_any(words, lang, "decline"), "decline")
            .when(matches_any(words, lang, "cta"), "cta")
            .when((tag == "button") & (type_attr == "submit"), "cta")
            .when(((tag == "button") | (role_attr == "button")) & ~is_generic_control(attrs, words), "cta")
            .when(named(FINE_PRINT) | small, "fine_print")
            .when((named(TIMER) | (animated & matches(words, CLOCK))) & ~in_video, "timer")
            .when(named(STOCK), "stock")
            .when(named(LINE_ITEM), "line_item")
            .when(named(TOAST), "toast")
            .when(named(HELP), "help_text")
            .when(named(BADGE), "badge")
            .when((words.rlike("[0-9]") & matches(words, DISCOUNT_TEXT)) | named(PROMO), "promo")
            .when(named(BANNER), "banner")
            .otherwise(DEFAULT_ROLE)
        )

    return bind(F.struct(wording.alias("words"), class_and_id(attrs).alias("tokens")),
                lambda x: by_wording(x["words"], x["tokens"]))


def unknown_roles(df: DataFrame) -> DataFrame:
    """Roles outside the vocabulary, with their row counts: should be empty."""
    return df.filter(~F.coalesce("role", F.lit("")).isin(ROLES)).groupBy("role").agg(F.count(F.lit(1)).alias("n"))
