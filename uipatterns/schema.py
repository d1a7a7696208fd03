"""Row shapes and fixed vocabularies shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: names and order are part of the data contract -----------
LABELS = [
    "confirmshaming",
    "false_urgency",
    "forced_action",
    "obstruction",
    "scarcity",
    "sneaking",
    "social_proof",
    "benign",
]
BENIGN = "benign"
DARK_LABELS = [name for name in LABELS if name != BENIGN]

LABEL_DESCRIPTIONS = {
    "confirmshaming": "Wording that shames or guilts you for declining.",
    "false_urgency": "A deadline or countdown that may be fabricated or resetting.",
    "forced_action": "Requires an unrelated action to proceed, such as signing up.",
    "obstruction": "Makes an action harder than it needs to be, such as cancelling.",
    "scarcity": "Claims limited stock or availability that may be unverifiable.",
    "sneaking": "Slips in a charge, opt-in or condition you did not choose.",
    "social_proof": "Unverifiable real-time activity used as peer pressure.",
    "benign": "No manipulative pattern detected.",
}

ROLES = [
    "badge", "banner", "body", "checkbox", "cta", "decline", "fine_print", "form",
    "form_gate", "heading", "help_text", "label", "line_item", "modal_text", "nav",
    "promo", "stock", "support_link", "timer", "toast",
]
DEFAULT_ROLE = "body"

FIELDS = [
    "title", "price", "strike_price", "discount", "rating", "sold_count", "stock",
    "shipping", "prose", "personal", "unknown",
]
LANGS = ["en", "hi", "ne"]

MIN_TEXT = 3
MAX_TEXT = 200
MAX_SNIPPET_CHARS = 2000
MAX_TRACE_ENTRIES = 5000
# --- end of fixed values ----------------------------------------------------

FINDING = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
])

TRACE_ENTRY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("groupId", T.StringType()),
    T.StructField("step", T.StringType()),
    T.StructField("selector", T.StringType()),
    T.StructField("ruleHits", T.ArrayType(T.StringType())),
    T.StructField("sentToModel", T.BooleanType()),
    T.StructField("withheld", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]))),
    T.StructField("findingLabels", T.ArrayType(T.StringType())),
    T.StructField("firstSeenAt", T.LongType()),
    T.StructField("lastSeenAt", T.LongType()),
])

TRACE = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("page_score", T.IntegerType()),
    T.StructField("entries", T.ArrayType(TRACE_ENTRY)),
])

DATASET_ROW = T.StructType(
    [T.StructField(name, T.StringType()) for name in (
        "text", "labels", "primary_label", "lang", "tag", "role", "model_input",
        "template_id", "source",
    )]
    + [T.StructField(f"y_{name}", T.IntegerType()) for name in LABELS]
)

GOLD_COLUMNS = [
    "text", "lang", "role", "tag", "gold_labels", "notes", "host", "model_labels",
    "rule_hits", "id", "url",
]
GOLD_ROW = T.StructType([T.StructField(name, T.StringType()) for name in GOLD_COLUMNS])
