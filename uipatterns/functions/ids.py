"""Identity hashes: SHA-1 over NUL-separated parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from uipatterns.functions.text import NUL


def _digest(*parts: Column) -> Column:
    joined: list[Column] = []
    for i, part in enumerate(parts):
        if i:
            joined.append(F.lit(NUL))
        joined.append(part)
    return F.sha1(F.concat(*joined))


def occurrence_id(lang: Column, selector: Column, text: Column) -> Column:
    return _digest(lang, selector, text)


def model_key(lang: Column, tag: Column, role: Column, text: Column) -> Column:
    return _digest(lang, tag, role, text)


def snippet_id(lang: Column, text: Column) -> Column:
    return _digest(lang, text)


def cache_key(version: Column, profile: Column, lang: Column, tag: Column, role: Column, text: Column) -> Column:
    return F.concat(F.lit("dp:v"), version, F.lit(":"), _digest(version, profile, lang, tag, role, text))


def explain_key(
    model: Column, label: Column, lang: Column, tag: Column, role: Column, confidence: Column,
    source: Column, rule_hits: Column, text: Column, context: Column,
) -> Column:
    """``context`` is an array of structs with ``role`` and ``text``."""
    lines = F.transform(context, lambda c: F.concat(c["role"], F.lit(":"), c["text"]))
    return F.concat(F.lit("dp:explain:"), _digest(
        model, label, lang, tag, role, confidence,
        F.array_join(F.array_sort(source), ","),
        F.array_join(F.array_sort(rule_hits), ","),
        text,
        F.array_join(lines, "|"),
    ))


def hash_fraction_bucket(seed: str, key: Column, n: Column | int) -> Column:
    """A repeatable bucket in ``[0, n)`` from the first 32 bits of an MD5."""
    value = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 8), 16, 10).cast("bigint")
    return F.pmod(value, n if isinstance(n, Column) else F.lit(n))
