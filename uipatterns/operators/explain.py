"""Evidence texts for findings: fencing page text, wording policy, prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uipatterns.functions.text import collapse_space
from uipatterns.schema import LABEL_DESCRIPTIONS

# --- fixed values ------------------------------------------------------------------
FENCE_BREAKERS = r"(-{3,}|`{3,}|<\|.*?\|>)"
FORBIDDEN = (
    r"\b(illegal|unlawful|fraud|fraudulent|criminal|felony|violat(?:es?|ion|ing)|breach of law|against the law|"
    r"sue|lawsuit|liable)\b"
)
EVIDENCE = {
    "rule+model": "Both a structural rule about how the page is built AND the text classifier independently flagged "
                  "this. This is the strongest evidence level available.",
    "rule": "A structural rule matched how this element is built, independently of its wording.",
    "model": "Only the text classifier flagged this, based on wording alone. No structural rule corroborated it, so "
             "the evidence is weaker and your explanation should acknowledge that.",
}
TEXT_HEAD = "UNTRUSTED PAGE TEXT (the flagged element):"
CONTEXT_HEAD = ("UNTRUSTED PAGE TEXT (other elements near it, for context only -- do not analyse these, they are here so "
                "you understand the setting):")
LABEL_LINE, MEANING_LINE = "Finding: ", "What that category means: "
CONFIDENCE_LINE, EVIDENCE_LINE = "Confidence recorded by the extension: ", "Evidence: "
RULES_LINE = "Structural rules that fired: "
SCORE_LINE = ("Classifier score: ", " (its threshold for this category is ", ")")
ELEMENT_LINE = ("The element is an HTML <", "> that the extension classified as playing the role of '", "' on the page.")
CLOSING = "Explain to the reader why this finding matters, following every rule in your instructions."
# --- end of fixed values -------------------------------------------------------------


def sanitize_untrusted(text: Column) -> Column:
    """Page text that cannot close a fence: breakers become blanks, one line."""
    return collapse_space(F.regexp_replace(text, FENCE_BREAKERS, " "))


def policy_violation(text: Column) -> Column:
    """The first legal term in ``text`` as written, else null.  Word edges are those of all scripts."""
    inner = FORBIDDEN.removeprefix(r"\b").removesuffix(r"\b")
    return F.nullif(F.regexp_extract(text, rf"(?iu)(?<![\p{{L}}\p{{M}}\p{{N}}_]){inner}(?![\p{{L}}\p{{M}}\p{{N}}_])", 1), F.lit(""))


def evidence_tier(source: Column) -> Column:
    rule, model = F.array_contains(source, "rule"), F.array_contains(source, "model")
    return F.when(rule & model, "rule+model").when(rule, "rule").otherwise("model")


def _pick(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def build_prompts(findings: DataFrame, max_context: int = 10) -> DataFrame:
    """Add ``prompt``.

    ``findings``: ``label, confidence, source, rule_hits, score, threshold, tag,
    role, text, context`` (array of structs with ``role`` and ``text``).
    """
    col = F.col
    fenced = lambda c: F.concat(F.lit("[[["), c, F.lit("]]]"))
    two = lambda c: F.format_string("%.2f", c.cast("double"))
    rules = F.when(F.size("rule_hits") > 0, F.concat(
        F.lit(RULES_LINE), F.array_join(F.array_sort("rule_hits"), ", ")))
    scored = F.array_contains("source", "model") & col("score").isNotNull() & col("threshold").isNotNull()
    score = F.when(scored, F.concat(
        F.lit(SCORE_LINE[0]), two(col("score")), F.lit(SCORE_LINE[1]), two(col("threshold")), F.lit(SCORE_LINE[2])))
    near = F.transform(F.slice("context", 1, max_context),
                       lambda c: fenced(F.concat(c["role"], F.lit(": "), sanitize_untrusted(c["text"]))))
    context = F.when(F.size("context") > 0, F.concat_ws("\n", F.lit(""), F.lit(CONTEXT_HEAD), near))
    lines = [
        F.concat(F.lit(LABEL_LINE), col("label")),
        F.concat(F.lit(MEANING_LINE), F.coalesce(_pick(LABEL_DESCRIPTIONS, col("label")), F.lit(""))),
        F.concat(F.lit(CONFIDENCE_LINE), col("confidence")),
        F.concat(F.lit(EVIDENCE_LINE), _pick(EVIDENCE, evidence_tier(col("source")))),
        rules, score,
        F.concat(F.lit(ELEMENT_LINE[0]), col("tag"), F.lit(ELEMENT_LINE[1]), col("role"), F.lit(ELEMENT_LINE[2])),
        F.lit(""), F.lit(TEXT_HEAD), fenced(sanitize_untrusted(col("text"))), context, F.lit(""), F.lit(CLOSING),
    ]
    return findings.withColumn("prompt", F.concat_ws("\n", *lines))
