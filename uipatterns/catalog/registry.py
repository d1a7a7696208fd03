"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# White space as every operator understands it, for the other engine's patterns.
SPACE = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SQL_WS = f"[{SPACE}]+"


def query(name: str, sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Register a query, with its equivalent SQL where there is one."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
        return fn

    return add


def re2(pattern: str) -> str:
    """A browser-style pattern for the other engine: only white space differs."""
    out, inside = [], False
    i = 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
            i += 2
            continue
        if two[0] == "\\":
            out.append(two)
            i += 2
            continue
        inside = two[0] == "[" or (inside and two[0] != "]")
        out.append(two[0])
        i += 1
    return "".join(out)


def hit(col: str, pattern: str, flags: str = "i") -> str:
    quoted = re2(pattern).replace("'", "''")
    return f"regexp_matches({col}, '{quoted}', '{flags}')"


def any_hit(col: str, patterns: list[str], flags: str = "i") -> str:
    return "(" + " OR ".join(hit(col, p, flags) for p in patterns) + ")"


def collapse_sql(col: str) -> str:
    return f"trim(regexp_replace({col}, '{SQL_WS}', ' ', 'g'))"


def bucket_sql(text: str, n: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % {n})"
