"""Ordered passes over the elements of one page, for questions about nesting.

Elements are numbered in document order and a subtree is a range of numbers,
so a stack or a lookup by number takes the place of joins on ancestors.  Each
function gets the few columns it needs of one page.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MEMBER = pa.struct([("node_no", pa.int32()), ("cand_id", pa.string()), ("text", pa.string()), ("is_animated", pa.bool_())])
#: The columns of a group; the type of ``page_id`` is the page's.
GROUP = {
    "page_id": None, "node_no": pa.int32(), "cand_id": pa.string(), "text": pa.string(), "run_text": pa.string(),
    "is_animated": pa.bool_(), "in_video": pa.bool_(), "members": pa.list_(_MEMBER),
}


def groups_of_page(page: pd.DataFrame) -> pd.DataFrame:
    """Candidates that hold others through inline elements, with their members.

    ``page``: node_no, sub_end, cand_id, text, run_text, control_no, block_no
    (the member's nearest block ancestor, -1 without one), may_join (its tag is
    inline), may_hold (its whole text has a usable length), is_animated,
    in_video.  The stack holds the open candidates; a member climbs to the
    first block above it, so what it costs is what it joins.  Of nested groups
    of one text the inner one stays.
    """
    return pd.DataFrame(_groups(page.sort_values("node_no").to_dict("records")), columns=list(GROUP))


def group_table(page: pa.Table) -> pa.Table:
    """``groups_of_page`` for ``applyInArrow``: a frame per page costs more than the sweep."""
    names = page.column_names
    rows = [dict(zip(names, r)) for r in zip(*(page.column(c).to_pylist() for c in names))]
    kept = _groups(sorted(rows, key=lambda r: r["node_no"]))
    schema = pa.schema([(c, t or page.schema.field(c).type) for c, t in GROUP.items()])
    return pa.table([pa.array([r[c] for r in kept], schema.field(c).type) for c in schema.names], schema=schema)


def _groups(rows: list[dict]) -> list[dict]:
    open_, found = [], []
    for r in rows:
        while open_ and open_[-1]["sub_end"] < r["node_no"]:
            open_.pop()
        if r["may_join"]:
            for o in reversed(open_):
                if o["node_no"] < r["block_no"]:
                    break
                if o["may_hold"] and (r["control_no"] is None or r["control_no"] != r["control_no"] or r["control_no"] == o["control_no"]):
                    if "members" not in o:
                        o["members"] = []
                        found.append(o)
                    o["members"].append({k: r[k] for k in ("node_no", "cand_id", "text", "is_animated")})
        open_.append(r)
    found.sort(key=lambda o: o["node_no"])
    after: dict[str, int] = {}  # the next group of the same text
    kept = []
    for o in reversed(found):
        if not after.get(o["run_text"], sys.maxsize) <= o["sub_end"]:
            kept.append(o)
        after[o["run_text"]] = o["node_no"]
    return kept[::-1]


def accept_areas(page: pd.DataFrame) -> pd.DataFrame:
    """For each row with ``scopes``: the largest other button in the nearest of them that holds one.

    ``page``: node_no, b_area (of buttons, else null), scopes (of the rows that
    ask, outermost first).  Ranges of buttons are found by number, their
    largest area by a table of ranges of powers of two.
    """
    buttons = page[page["b_area"].notna()].sort_values("node_no")
    numbers, tables = buttons["node_no"].to_numpy(), [buttons["b_area"].to_numpy(float)]
    while 2 ** len(tables) <= len(numbers):
        half = 2 ** (len(tables) - 1)
        tables.append(np.maximum(tables[-1][:-half], tables[-1][half:]))

    def largest(lo: int, hi: int) -> float | None:
        if hi <= lo:
            return None
        k = (hi - lo).bit_length() - 1
        return max(tables[k][lo], tables[k][hi - 2 ** k])

    out = []
    for page_id, no, scopes in page.loc[page["scopes"].notna(), ["page_id", "node_no", "scopes"]].itertuples(index=False):
        own = np.searchsorted(numbers, [no, no + 1])
        for scope in reversed(list(scopes)):
            lo, hi = np.searchsorted(numbers, [scope["no"] + 1, scope["end"] + 1])
            best = [a for a in (largest(int(lo), int(min(hi, own[0]))), largest(int(max(lo, own[1])), int(hi))) if a is not None]
            if best:
                out.append((page_id, no, max(best)))
                break
    return pd.DataFrame(out, columns=["page_id", "node_no", "accept_area"])
