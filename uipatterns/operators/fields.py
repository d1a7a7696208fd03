"""Which part of a product listing a text is, and the cards it sits in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uipatterns.functions.text import ascii_regex, matches, matches_one_of, word_count
from uipatterns.operators.nodes import ancestors, class_tokens, looks_like_twin

# --- fixed values: patterns that decide a field --------------------------------
EMAIL = r"[^\s@]+@[^\s@]+\.[^\s@]{2,}"
PAYMENT_CARD = r"\b(?:\d[ -]?){13,19}\b"
LONG_NUMBER = r"\b\d[\d-]{8,}\d\b"
CURRENCY = r"(?:rs\.?|npr|inr|₹|\$|€|£)\s*[\d,]+(?:\.\d+)?"
DISCOUNT = r"(?:^|\s)-\s?\d+\s?%|\b\d+\s*%\s*off\b"
RATING = r"\b\d(?:\.\d+)?\s*(?:out of\s*5|\/\s*5)\b|★"
SOLD = r"\b\d[\d,]*\+?\s*(?:pieces?\s*)?sold\b"
STOCK_LEFT = r"\bonly\s+\d+\s+(?:left|items?\s+left)\b|\b\d+\s*(?:items?\s*)?left in stock\b"
SHIPPING = r"\bfree\s+(?:delivery|shipping)\b|\bdelivery\s+by\b"
SENTENCE_END = r"[.!?।](?:\s|$)"
PROSE_EXEMPT = ["cta", "decline", "checkbox", "form_gate", "fine_print", "toast", "label"]
PRODUCT_FIELDS = ["price", "strike_price", "discount", "rating", "sold_count"]
# --- end of fixed values ---------------------------------------------------------

CARD_DEPTH = 8


def is_personal(text: Column) -> Column:
    # The cheap tests first: most texts have neither an @ nor a digit.
    return (text.contains("@") & matches(text, EMAIL, False)) | (
        text.rlike("[0-9]") & matches_one_of(text, [PAYMENT_CARD, LONG_NUMBER], ignore_case=False)
    )


def is_prose(text: Column, role: Column) -> Column:
    words = word_count(text)
    ends = F.regexp_count(text, F.lit(ascii_regex(SENTENCE_END)))
    return ~role.isin(PROSE_EXEMPT) & ((words >= 25) | ((ends >= 2) & (words >= 8)))


def infer_field(text: Column, tag: Column, role: Column, struck: Column | None = None) -> Column:
    struck = F.lit(False) if struck is None else F.coalesce(struck, F.lit(False))
    digit = text.rlike("[0-9]")
    return (
        F.when(is_personal(text), "personal")
        .when(tag.rlike("^h[1-6]$"), "title")
        .when(digit & matches(text, DISCOUNT), "discount")
        .when((digit | text.contains("★")) & matches(text, RATING), "rating")  # the cheap tests first
        .when(digit & matches(text, SOLD), "sold_count")
        .when(digit & matches(text, STOCK_LEFT), "stock")
        .when(matches(text, SHIPPING), "shipping")
        .when(matches(text, CURRENCY), F.when(struck, "strike_price").otherwise("price"))
        .when(is_prose(text, role), "prose")
        .otherwise("unknown")
    )


def card_nodes(nodes: DataFrame) -> DataFrame:
    """``(page_id, node_no)`` of elements that have a look-alike sibling."""
    return nodes.filter("is_card").select("page_id", "node_no")


def card_root(depth: int = CARD_DEPTH) -> Column:
    """The nearest of eight ancestors that is a card, else null."""
    cards = F.filter(ancestors(depth), lambda n: n["is_card"])
    return F.try_element_at(F.transform(cards, lambda n: n["node_no"]), F.lit(-1))


def refine_titles(cands: DataFrame) -> DataFrame:
    """In a card that sells something, the longest still-unknown link text is the title."""
    card = Window.partitionBy("page_id", "card_no")
    sells = F.max(F.col("field").isin(PRODUCT_FIELDS)).over(card)
    linked = F.coalesce(F.col("link_no") >= F.col("card_no"), F.lit(False))
    may = F.col("card_no").isNotNull() & (F.col("field") == "unknown") & linked
    first = F.row_number().over(card.orderBy(F.col("_may").desc(), F.length("text").desc(), F.col("node_no")))
    return (
        cands.withColumn("_may", may)
        .withColumns({"_sells": sells, "_first": first})
        .withColumn("field", F.when(F.col("_may") & F.col("_sells") & (F.col("_first") == 1), "title")
                    .otherwise(F.col("field")))
        .drop("_may", "_sells", "_first")
    )


__all__ = ["card_nodes", "card_root", "class_tokens", "infer_field", "is_personal", "is_prose", "looks_like_twin",
           "refine_titles"]
