"""Deterministic rules: each is one boolean column, all run in a single pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uipatterns.functions.text import by_lang, matches, matches_one_of
from uipatterns.operators.nodes import class_and_id
from uipatterns.operators.sweeps import accept_areas

# --- fixed values: rule patterns, limits and the fields a rule must not judge ----
STOCK_COUNTER = [
    r"only\s+\d+\s+left",
    r"केवल\s*\d+\s*(बाकी|बाँकी)",
    r"\d+\s*(बाकी|बाँकी)\s*(छ|है)",
    r"lowest\s+price",
    r"limited\s+(time|offer|stock)",
    r"hurry[!,\s]",
]
VIEWER_COUNTER = [
    r"\d[\d,]*\s*(people|users?)?\s*(are\s+)?(currently\s+)?(viewing|watching|looking at this)",
    r"\d[\d,]*\s*(लोग|व्यक्ति)\s*(देख रहे|देखा रहे)",
    r"\d[\d,]*\s*जना\s*(हेर्दैछन्|हेरिरहेका छन्)",
]
RECENT_ACTIVITY = [
    r"\d[\d,]*\+?\s*(people|users?|customers?|shoppers?)?\s*(have\s+)?(bought|purchased|sold|ordered)\b[^.]{0,40}"
    r"\b(in|within|over)\s+the\s+(last|past)\s+\d*\s*(second|minute|hour|day|week|month)",
    r"\b(in|within|over)\s+the\s+(last|past)\s+\d*\s*(second|minute|hour|day|week|month)[^.]{0,40}"
    r"\d[\d,]*\+?\s*(people|users?|customers?|shoppers?)?\s*(have\s+)?(bought|purchased|sold|ordered)\b",
    r"\b(selling|going)\s+fast\b",
    r"(पिछले|बीते)\s*\d*\s*(घंटे|घंटों|दिन|दिनों)\s*में[^।]{0,40}(खरीदा|खरीदे|ऑर्डर)",
    r"(गत|विगत)\s*\d*\s*(घण्टा|घण्टामा|दिन|दिनमा)[^।]{0,40}(किने|किन्नुभयो|अर्डर)",
]
DISCOUNT_BADGE = r"^-\d+%$|^\d+%\s*off\b|\bsave\s+[\d,]+|\bsave\s+\d+%"
LATE_FEE = {
    "en": r"\b(service fee|processing fee|handling fee|convenience fee|surcharge)\b",
    "hi": r"(सेवा शुल्क|प्रोसेसिंग शुल्क|अतिरिक्त शुल्क)",
    "ne": r"(सेवा शुल्क|प्रशोधन शुल्क|थप शुल्क)",
}
DEPENDENCY = {
    "en": r"\b(to continue|to proceed|to unlock|required to|you must|in order to)\b",
    "hi": r"(जारी रखने के लिए|आगे बढ़ने के लिए|अनिवार्य है)",
    "ne": r"(जारी राख्न|अगाडि बढ्न|अनिवार्य छ)",
}
CONSENT_WORDS = [
    "email", "sms", "newsletter", "text message", "marketing", "offers", "ईमेल", "समाचार", "इमेल",
]
MIN_FONT_PX, MIN_CONTRAST, MIN_OPACITY, AREA_RATIO, BUTTON_LEVELS = 11, 3.0, 0.6, 3, 4

DENIED_FIELDS = {
    "stock_counter": ["title", "rating", "price", "strike_price", "prose", "personal"],
    "recent_activity": ["title", "rating", "price", "strike_price", "prose", "personal"],
    "viewer_counter": ["title", "rating", "price", "strike_price", "prose", "personal"],
    "discount_badge": ["title", "rating", "sold_count", "prose", "personal"],
    "countdown_timer": ["price", "strike_price", "rating", "sold_count", "title", "prose", "personal"],
    "cancel_offsite": ["title", "prose", "personal"],
    "cta_asymmetry": ["title"],
}
# --- end of fixed values -----------------------------------------------------------


def stock_counter() -> Column:
    return matches_one_of(F.col("text"), STOCK_COUNTER)


def countdown_timer() -> Column:
    return F.coalesce(F.col("is_animated"), F.lit(False))


def viewer_counter() -> Column:
    return matches_one_of(F.col("text"), VIEWER_COUNTER)


def prechecked_optin() -> Column:
    """Needs ``label_text``: the text of the labels tied to the checkbox."""
    label = F.lower(F.coalesce(F.col("label_text"), F.lit("")))
    worded = label.rlike("|".join(CONSENT_WORDS))
    return (F.col("role") == "checkbox") & F.coalesce(F.col("checked"), F.lit(False)) & worded


def hidden_optout() -> Column:
    low = lambda c, limit: F.coalesce(F.col(c) < limit, F.lit(False))
    faint = low("font_px", MIN_FONT_PX) | low("contrast", MIN_CONTRAST) | low("opacity", MIN_OPACITY)
    return (F.col("role") == "decline") & faint


def cta_asymmetry() -> Column:
    """Needs ``accept_area``: the largest nearby button (see ``add_accept_area``)."""
    ratio = F.when((F.col("area") > 0) & (F.col("accept_area") > 0), F.col("accept_area") / F.col("area"))
    return (F.col("role") == "decline") & F.coalesce(ratio > AREA_RATIO, F.lit(False))


def late_fee() -> Column:
    due = (F.col("role") == "line_item") & (F.col("step") == "payment")
    return F.coalesce(due, F.lit(False)) & by_lang(F.col("lang"), F.col("text"), LATE_FEE)


def cancel_offsite() -> Column:
    href = F.try_element_at("attrs", F.lit("href"))
    part = lambda u, p: F.lower(F.try_parse_url(u, F.lit(p)))
    absolute = F.when(href.startswith("//"), F.concat(part(F.col("url"), "PROTOCOL"), F.lit(":"), href)).otherwise(href)
    web = matches(absolute, r"^https?://")
    port = lambda u: F.regexp_replace(
        F.concat_ws("://", part(u, "PROTOCOL"), F.regexp_replace(part(u, "AUTHORITY"), "^[^@]*@", "")),
        r"^(http://.*):80$|^(https://.*):443$", "$1$2",
    )
    elsewhere = web & (port(absolute) != port(F.col("url")))
    # Other schemes have an opaque origin; script links do not leave the page.
    opaque = matches(href, r"^[a-z][a-z0-9+.-]*:") & ~matches(href, r"^(https?|javascript):")
    return (F.col("role") == "decline") & (F.col("tag") == "a") & F.coalesce(opaque | elsewhere, F.lit(False))


def discount_badge() -> Column:
    return (F.col("role") == "promo") & matches(F.col("text"), DISCOUNT_BADGE)


def forced_action_gate() -> Column:
    return F.col("role").isin("form_gate", "modal_text") & by_lang(F.col("lang"), F.col("text"), DEPENDENCY)


def recent_activity() -> Column:
    return matches_one_of(F.col("text"), RECENT_ACTIVITY)


# Name, labels, condition.  Users may pass their own list of the same shape.
Rule = tuple[str, list[str], Callable[[], Column]]
RULES: list[Rule] = [
    ("stock_counter", ["scarcity"], stock_counter),
    ("countdown_timer", ["false_urgency"], countdown_timer),
    ("viewer_counter", ["social_proof"], viewer_counter),
    ("prechecked_optin", ["sneaking"], prechecked_optin),
    ("hidden_optout", ["sneaking", "obstruction"], hidden_optout),
    ("cta_asymmetry", ["obstruction"], cta_asymmetry),
    ("late_fee", ["sneaking"], late_fee),
    ("cancel_offsite", ["obstruction"], cancel_offsite),
    ("discount_badge", ["false_urgency"], discount_badge),
    ("forced_action_gate", ["forced_action"], forced_action_gate),
    ("recent_activity", ["social_proof"], recent_activity),
]
OPTIONAL_INPUTS = {
    "is_animated": "boolean", "label_text": "string", "checked": "boolean", "font_px": "double",
    "contrast": "double", "opacity": "double", "area": "double", "accept_area": "double",
    "attrs": "map<string,string>", "url": "string", "step": "string",
}


def rule_allowed(rule: str, field: Column) -> Column:
    denied = DENIED_FIELDS.get(rule, [])
    return ~F.coalesce(field, F.lit("unknown")).isin(denied) if denied else F.lit(True)


def run_rules(cands: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Add ``rule_hits``: the (rule, label) pairs that fire and may fire on the field.

    Inputs a source does not have are taken as unknown and their rules stay silent.
    """
    missing = {c: F.lit(None).cast(t) for c, t in OPTIONAL_INPUTS.items() if c not in cands.columns}
    hits = [
        F.when(cond() & rule_allowed(name, F.col("field")),
               F.struct(F.lit(name).alias("rule"), F.lit(label).alias("label")))
        for name, labels, cond in rules for label in labels
    ]
    return cands.withColumns(missing).withColumn("rule_hits", F.array_compact(F.array(*hits))).drop(*missing)


def rule_hits_long(cands: DataFrame, keys: list[str]) -> DataFrame:
    return cands.select(*keys, F.explode("rule_hits").alias("h")).select(*keys, "h.rule", "h.label")


def new_fee_lines(lines: DataFrame, session: str = "session_id") -> DataFrame:
    """The full late-fee test: fee lines at payment that the session's cart did not show."""
    fees = lines.filter((F.col("role") == "line_item") & by_lang(F.col("lang"), F.col("text"), LATE_FEE))
    seen = fees.filter(F.col("step") == "cart").select(session, "text").distinct()
    return fees.filter(F.col("step") == "payment").join(seen, [session, "text"], "left_anti")


def add_accept_area(cands: DataFrame, buttons: DataFrame) -> DataFrame:
    """Add ``accept_area`` to decline controls: the largest other button inside the
    nearest of four ancestors that holds one.

    ``buttons`` has page_id, node_no and area of the page's buttons.  Buttons
    and decline controls of a page meet in one sweep of numbers alone.
    """
    kind = cands.schema["page_id"].dataType.simpleString()
    scopes = F.slice("scopes", -F.least(F.size("scopes"), F.lit(BUTTON_LEVELS)), F.lit(BUTTON_LEVELS))
    asks = cands.filter(F.col("role") == "decline").select("page_id", "node_no", F.lit(None).cast("double").alias("b_area"), scopes.alias("scopes"))
    found = buttons.select("page_id", "node_no", F.coalesce(F.col("area").cast("double"), F.lit(0.0)).alias("b_area"))
    near = found.unionByName(asks, allowMissingColumns=True).groupBy("page_id").applyInPandas(
        accept_areas, f"page_id {kind}, node_no int, accept_area double")
    return cands.join(near.hint("merge"), ["page_id", "node_no"], "left")  # a row per decline control: too many to broadcast


__all__ = ["RULES", "class_and_id", "run_rules", "rule_hits_long", "rule_allowed", "new_fee_lines",
           "add_accept_area"]
