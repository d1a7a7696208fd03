import numpy as np
import pandas as pd

from uipatterns.operators.sweeps import accept_areas, groups_of_page


def random_tree(rng, n):
    """parent and subtree end of n elements in document order."""
    parent = [-1] + [int(rng.integers(max(0, i - 4), i)) for i in range(1, n)]
    order, kids = [], {i: [j for j in range(n) if parent[j] == i] for i in range(n)}

    def walk(i):
        order.append(i)
        for j in kids[i]:
            walk(j)

    walk(0)
    number = {i: no for no, i in enumerate(order)}
    parents = {number[i]: number[parent[i]] if i else -1 for i in range(n)}
    ends = list(range(n))
    for no in reversed(range(1, n)):
        ends[parents[no]] = max(ends[parents[no]], ends[no])
    return parents, ends


def above(parents, no):
    out = []
    while parents[no] >= 0:
        no = parents[no]
        out.append(no)
    return out  # nearest first


def test_areas_equal_those_of_ancestor_lists():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 120):
        parents, ends = random_tree(rng, n)
        buttons = {i: float(rng.integers(1, 50)) for i in range(n) if rng.random() < 0.3}
        asks = [i for i in range(n) if rng.random() < 0.4]
        rows = [(7, i, a, None) for i, a in buttons.items()]
        rows += [(7, i, None, [{"no": s, "end": ends[s]} for s in reversed(above(parents, i)[:4])]) for i in asks]
        got = accept_areas(pd.DataFrame(rows, columns=["page_id", "node_no", "b_area", "scopes"]).astype({"b_area": float}))
        want = {}
        for i in asks:
            for s in above(parents, i)[:4]:
                inside = [a for b, a in buttons.items() if b != i and s in above(parents, b)]
                if inside:
                    want[i] = max(inside)
                    break
        assert dict(zip(got["node_no"], got["accept_area"])) == want


def test_groups_equal_those_of_ancestor_lists():
    rng = np.random.default_rng(2)
    for n in (1, 6, 50, 150):
        parents, ends = random_tree(rng, n)
        inline = [bool(rng.random() < 0.8) for _ in range(n)]
        control = [int(rng.integers(0, 3)) if rng.random() < 0.3 else None for _ in range(n)]
        cands = [i for i in range(n) if rng.random() < 0.6]
        hold, text = {i: bool(rng.random() < 0.8) for i in cands}, {i: f"t{rng.integers(0, 4)}" for i in cands}
        blocks = {i: next((a for a in above(parents, i) if not inline[a]), -1) for i in cands}
        rows = [(7, i, ends[i], f"c{i}", "x", text[i], control[i], blocks[i], inline[i], hold[i], False, False) for i in cands]
        page = pd.DataFrame(rows, columns=["page_id", "node_no", "sub_end", "cand_id", "text", "run_text", "control_no", "block_no",
                                           "may_join", "may_hold", "is_animated", "in_video"])
        got = {r["node_no"]: [m["node_no"] for m in r["members"]] for r in groups_of_page(page).to_dict("records")}
        members = {}
        for m in cands:
            for a in above(parents, m) if inline[m] else []:
                if a in hold and hold[a] and (control[m] is None or control[m] == control[a]):
                    members.setdefault(a, []).append(m)
                if not inline[a]:
                    break
        # of nested groups of one text the inner one stays: the next group of that text starts inside
        want = {}
        for o in members:
            later = sorted(p for p in members if p > o and text[p] == text[o])
            if not (later and later[0] <= ends[o]):
                want[o] = members[o]
        assert got == want
