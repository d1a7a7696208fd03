"""Text expressions.  All of them stay in the JVM.

Regular expressions here are Java's.  Two habits of the browser dialect matter
to the answers and are spelled out instead of relied upon: ``\\b`` is an ASCII
word boundary, and white space includes the no-break and typographic spaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CLASS = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WS = f"[{SPACE_CLASS}]+"
NUL = "\u0000"

_WORD_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_regex(pattern: str, ignore_case: bool = False) -> str:
    """A browser-style pattern as a Java one with the same meaning."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\b":
            out.append(_WORD_EDGE)
        elif two == r"\s":
            out.append(SPACE_CLASS if in_class else f"[{SPACE_CLASS}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            in_class = two[0] == "[" or (in_class and two[0] != "]")
            out.append(two[0])
            i -= 1
        i += 2
    return ("(?i)" if ignore_case else "") + "".join(out)


def matches(col: Column, pattern: str, ignore_case: bool = True) -> Column:
    return col.rlike(ascii_regex(pattern, ignore_case))


def matches_one_of(col: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    """One alternation, so the text is scanned by a single expression."""
    return matches(col, "|".join(f"(?:{p})" for p in patterns), ignore_case)


def by_lang(lang: Column, text: Column, patterns: dict[str, str], ignore_case: bool = True) -> Column:
    """Match ``text`` with the pattern of its language; other languages use English."""
    branches = [(name, p) for name, p in patterns.items() if name != "en"]
    start = F.when(F.lit(False), F.lit(False))
    chain = reduce(
        lambda acc, item: acc.when(lang == item[0], matches(text, item[1], ignore_case)), branches, start
    )
    return F.coalesce(chain.otherwise(matches(text, patterns["en"], ignore_case)), F.lit(False))


def collapse_space(col: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(col, WS, " "))


def trim_space(col: Column) -> Column:
    return F.regexp_replace(col, f"^{WS}|{WS}$", "")


def word_count(col: Column) -> Column:
    """Words between white space; blank text counts as one, like ``''.split(re)``."""
    return F.size(F.split(collapse_space(col), " "))


def own_text(parts: Column) -> Column:
    return collapse_space(F.array_join(parts, " "))


def collapse_self_dup(col: Column, min_half: int = 4) -> Column:
    """``Shop nowShop now`` becomes ``Shop now``."""
    n = F.length(col)
    half = (n / 2).cast("int")
    first = F.substring(col, F.lit(1), half)
    doubled = (n % 2 == 0) & (half >= min_half) & (first == F.substring(col, half + 1, half))
    return F.when(doubled, first).otherwise(col)


def text_gate(col: Column, low: int = 3, high: int = 200) -> Column:
    return F.length(col).between(low, high) & ~col.rlike("^[0-9]+$")


def guess_lang(col: Column) -> Column:
    return F.when(col.rlike(r"[ऀ-ॿ]"), "dev").otherwise("en")


def churn_key(selector: Column, text: Column) -> Column:
    return F.concat(selector, F.lit("|"), F.regexp_replace(text, "[0-9]+", "#"))


def page_lang(html: Column, allowed: tuple[str, ...] = ("hi", "ne"), default: str = "en") -> Column:
    head = F.lower(F.substring(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", 1), 1, 2))
    return F.when(head.isin(*allowed), head).otherwise(default)


def host_of(url: Column, fallback: str | Column = "(unknown page)") -> Column:
    """Lower-case host without port.  A blank URL gives ``fallback``; a URL
    without a host gives itself."""
    blank = url.isNull() | (url == "")
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when(blank, fallback).otherwise(F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), url))


def archive_host(url: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("")), F.lit("unknown-host"))


def utc_day(ts: Column) -> Column:
    """The UTC date of an instant, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86_400).cast("int"))


def url_no_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def strip_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def infer_step(url: Column) -> Column:
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return (
        F.when(matches(path, r"checkout|payment|pay\b", False), "payment")
        .when(matches(path, r"cart|bag", False), "cart")
        .otherwise("product")
    )


def safe_segment(col: Column, fallback: str = "unknown") -> Column:
    """A value made safe for one path segment."""
    cleaned = F.btrim(F.regexp_replace(col, "[^a-zA-Z0-9._-]", "-"), F.lit("-."))
    return F.coalesce(F.nullif(F.substring(cleaned, 1, 100), F.lit("")), F.lit(fallback))


def relative_luminance(rgb: Column) -> Column:
    """WCAG relative luminance of an ``array<int>`` of red, green, blue."""
    def linear(i: int) -> Column:
        v = rgb[i] / F.lit(255.0)
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return linear(0) * 0.2126 + linear(1) * 0.7152 + linear(2) * 0.0722


def contrast_ratio(fg: Column, bg: Column) -> Column:
    a, b = relative_luminance(fg), relative_luminance(bg)
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def parse_rgb(css: Column) -> Column:
    """``rgb(1, 2, 3)`` or ``rgba(...)`` as an array of ints, else null."""
    p = r"rgba?\((\d+),\s*(\d+),\s*(\d+)"
    return F.when(
        css.rlike(p), F.array(*[F.regexp_extract(css, p, i).cast("int") for i in (1, 2, 3)])
    )
