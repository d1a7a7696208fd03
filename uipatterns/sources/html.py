"""HTML pages as rows.

One page is one row and parses on its own, so the read is parallel over pages
without a shuffle.  The Python helper only rebuilds the tree: element numbers in
document order, subtree ends, attributes and the text pieces.  Every text is
stored once; a subtree is a slice of the page's pieces.  All meaning is added
later by DataFrame expressions.

A page is one or more scopes: its document, the open shadow roots that it
declares and the documents of its ``srcdoc`` frames.  Each scope is a tree of
its own, with roots without a parent, its own ids, labels and siblings.  The
scopes' numbers follow each other, the document's first and then those of each
host in document order, so ranges of numbers never cross a scope.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NODE_TYPE = (
    "struct<node_no:int,parent_no:int,depth:int,sub_end:int,tag:string,attrs:map<string,string>,"
    "anc:array<int>,piece_lo:int,piece_hi:int,text_len:int,sib_no:int,sib_n:int,twin:boolean,"
    "kids:array<struct<no:int,tag:string,lo:int,hi:int>>,label_text:string,scope_no:int,"
    "marks:int,block_no:int,link_no:int,control_no:int>"
)
SCOPE_TYPE = "struct<kind:string,host_no:int,gone:boolean,dark:boolean>"

# --- fixed values: the HTML standard's void elements and implied end tags ---
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
ENDS_SIBLING = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
PARAGRAPH_SCOPE = {"button", "td", "th", "caption", "object", "template", "html"}
# Elements whose subtrees hold no interface text, controls, and elements that don't end a run of text.
SKIP_TAGS = ["script", "style", "noscript", "svg", "head", "template"]
CONTROL_TAGS = ["a", "button", "input", "select", "textarea"]
CONTROL_ROLES = ["button", "link"]
# Elements that may carry a shadow root, beside those with a hyphen in their name.
SHADOW_HOSTS = set("article aside blockquote body div footer h1 h2 h3 h4 h5 h6 header main nav p section span".split())
GROUP_INLINE = [
    "a", "abbr", "b", "bdo", "big", "br", "button", "cite", "code", "dfn", "em", "i", "img", "input", "kbd",
    "label", "mark", "output", "q", "s", "samp", "select", "small", "span", "strong", "sub", "sup",
    "textarea", "time", "tt", "u", "var", "wbr",
]
# --- end of fixed values -----------------------------------------------------

_INLINE = frozenset(GROUP_INLINE)

#: Steps of a node's path that are always there: itself and its nearest ancestors.
NEAR_STEPS = 24

#: Bits of ``marks``: what a node or any of its ancestors is.  ``VIDEO`` and ``STYLED`` only say that a closer look may find something.
SKIPPED, LABEL, FORM, DIALOG, STRUCK, HIDDEN, STYLED, VIDEO, NAMED = (1 << i for i in range(9))
_TAG_MARKS = {tag: SKIPPED for tag in SKIP_TAGS} | {"label": LABEL, "form": FORM, "s": STRUCK, "del": STRUCK, "video": VIDEO}
_PLAYER_HINT = re.compile("player|vjs-|plyr|ytp-", re.IGNORECASE)


def marks_of(tag: str, attrs: dict[str, str]) -> int:
    """The ``marks`` of one element, without its ancestors."""
    marks = _TAG_MARKS.get(tag, 0)
    if attrs:
        if attrs.get("aria-hidden") == "true":
            marks |= SKIPPED
        if attrs.get("role") == "dialog":
            marks |= DIALOG
        if "hidden" in attrs:
            marks |= HIDDEN
        if "style" in attrs:
            marks |= STYLED
        if attrs.get("id"):
            marks |= NAMED
        if _PLAYER_HINT.search(f"{attrs.get('class', '')} {attrs.get('id', '')}"):
            marks |= VIDEO
    return marks


COMMENT = "#comment"
_GENERATED = re.compile("[0-9]{3}")
_NO_TOKENS: frozenset[str] = frozenset()


def with_twins(families: Counter) -> set[frozenset]:
    """The class-token sets of siblings that have a twin: an equal set, or one that shares half of the smaller set.

    Only distinct sets are compared.  A token of a set of one or two makes
    twins of all sets that hold it.  A set of s tokens, three or more, must
    share ceil(s / 2) with a set as large or larger, so one of its s -
    ceil(s / 2) + 1 rarest tokens: those alone are looked up, and the tokens
    that all siblings carry are not.
    """
    found = {s for s, n in families.items() if n > 1}
    holders = defaultdict(list)
    for s in families:
        for t in s:
            holders[t].append(s)
    for t, sets in holders.items():
        small = [s for s in sets if len(s) <= 2]
        if small and len(sets) > 1:
            found.update(sets)
    for s in families:
        need = -(-len(s) // 2)
        if len(s) >= 3:
            for t in sorted(s, key=lambda t: (len(holders[t]), t))[:len(s) - need + 1]:
                for other in holders[t]:
                    if other is not s and len(other) >= len(s) and not (s in found and other in found) and len(s & other) >= need:
                        found.update((s, other))
    return found


_STATED = {p: re.compile(rf"(?:^|;)\s*{p}\s*:\s*([^;!]+)", re.ASCII) for p in (
    "display", "visibility", "color", "background-color", "text-decoration(?:-line)?")}


def lasting_kinds(tag: str, attrs: dict[str, str]) -> list[str]:
    """What an ancestor is that a question may ask about from any depth below it."""
    found = [] if tag in GROUP_INLINE else ["block"]
    if tag in SKIP_TAGS or attrs.get("aria-hidden") == "true":
        found.append("skipped")
    if tag in ("label", "form"):
        found.append(tag)
    if tag in ("s", "del"):
        found.append("struck")
    if tag == "a" and "href" in attrs:
        found.append("link")
    if tag in CONTROL_TAGS or attrs.get("role") in CONTROL_ROLES:
        found.append("control")
    if attrs.get("role") == "dialog":
        found.append("dialog")
    if "hidden" in attrs:
        found.append("gone")
    if "style" in attrs:
        found.append("styled")
        for name, pattern in _STATED.items():
            m = pattern.search(attrs["style"].lower())
            value = m[1].strip(" ") if m else ""
            if name == "display":
                found += ["gone"] if value == "none" else []
            elif value and (name == "visibility" or value != "transparent"):
                found.append(name)
    return found


class _Tree:
    """The elements of one scope.

    ``anc`` of a node is what its path is made of: its nearest ancestors, and
    of those above them the nearest of each lasting kind.  That is carried
    down the stack, so time and memory stay in proportion to the page however
    deep its elements lie.  ``marks``, ``block_no`` (the innermost ancestor
    that doesn't stand in a line of text), ``link_no`` and ``control_no`` (the
    innermost link and control, itself included) are carried down too.
    """

    def __init__(self, skipped: bool = True, kind: str = "document", markup: str | None = None, host: dict | None = None, outer=None) -> None:
        self.skipped = skipped
        self.kind, self.markup, self.host, self.outer = kind, markup, host, outer
        self.gone = self.dark = False
        self.inner: list[_Tree] = []
        self.inside_skipped = 0
        self.count = 0
        self.videos: list[int] = []
        self.labels: list[dict] = []  # open ones
        self.ids: dict[str, dict] = {}
        self.labels_for: dict[str, list[dict]] = defaultdict(list)
        self.boxes: list[tuple[dict, dict, dict | None]] = []
        self.nodes: list[dict] = []
        self.all: list[tuple[int | None, str, str, dict]] = []  # skipped ones too: siblings count them
        self.pieces: list[str] = []
        self.open: list[dict] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements, by tag
        self.chars = 0
        self.text_joins = False

    def start(self, tag: str, named: dict[str, str]) -> None:
        if tag in ENDS_PARAGRAPH:
            self._close_open({"p"}, PARAGRAPH_SCOPE)
        if tag in ENDS_SIBLING:
            self._close_open(*ENDS_SIBLING[tag])
        parent = self.open[-1] if self.open else None
        depth = len(self.open)
        far = parent["_far"] if parent else {}
        if depth >= NEAR_STEPS:
            leaving = self.open[depth - NEAR_STEPS]
            kinds = lasting_kinds(leaving["tag"], leaving["_named"])
            if kinds:
                far = far | {kind: leaving["_at"] for kind in kinds}
        skips = self.inside_skipped or tag in SKIP_TAGS
        no = self.count
        marks, block, link, control = marks_of(tag, named), None, None, None
        if parent:
            marks |= parent["marks"]
            block = parent["block_no"] if parent["tag"] in _INLINE else parent["node_no"]
            link, control = parent["link_no"], parent["control_no"]
        if tag == "a" and "href" in named:
            link = no
        if tag in CONTROL_TAGS or named.get("role") in CONTROL_ROLES:
            control = no
        node = {
            "node_no": no, "parent_no": parent["node_no"] if parent else None, "depth": depth, "tag": tag,
            "marks": marks, "block_no": block, "link_no": link, "control_no": control,
            "attrs": list(named.items()), "anc": (sorted(set(far.values())) if far else []) + [n["_at"] for n in self.open[max(0, depth - NEAR_STEPS + 1):]],
            "piece_lo": len(self.pieces), "kids": [], "label_text": None,
            "_at": len(self.nodes), "_from": self.chars, "_far": far, "_named": named, "_skips": bool(skips),
        }
        self.count += 1
        self.all.append((node["parent_no"], tag, named.get("class", ""), node))
        if self.skipped or not skips:
            self.nodes.append(node)
        if skips:
            self.inside_skipped += 1
        self._note(node, tag, named)
        self.places[tag].append(len(self.open))
        self.open.append(node)
        self.text_joins = False
        if tag == "iframe" and "srcdoc" in named and not skips and _same_origin(named):
            self.attach("frame", named["srcdoc"])
        if tag in VOID:
            self._close_to(len(self.open) - 1)

    def may_host(self, template: dict[str, str]) -> bool:
        """Whether a template that starts here is the open shadow root of the element it stands in."""
        if template.get("shadowrootmode", "").lower() != "open" or not self.open or self.inside_skipped:
            return False
        host = self.open[-1]
        return "_shadow" not in host and (host["tag"] in SHADOW_HOSTS or "-" in host["tag"])

    def attach(self, kind: str, markup: str | None = None):
        """A scope of its own below the innermost open element."""
        host = self.open[-1]
        if kind == "shadow":
            host["_shadow"] = True
        self.inner.append(_Tree(self.skipped, kind, markup, host, self))
        return self.inner[-1]

    def _inherit(self) -> None:
        """``gone``: the host isn't displayed.  ``dark``: a shadow root inherits that the host is invisible; a frame doesn't."""
        if self.outer is None:
            return
        self.gone, self.dark = self.outer.gone, self.outer.dark
        for step in [self.outer.nodes[at] for at in self.host["anc"]] + [self.host]:
            kinds = lasting_kinds(step["tag"], step["_named"])
            self.gone |= "gone" in kinds
            if "visibility" in kinds:
                self.dark = _STATED["visibility"].search(step["_named"]["style"].lower())[1].strip(" ") == "hidden"
        self.dark &= self.kind == "shadow"

    def _note(self, node: dict, tag: str, named: dict[str, str]) -> None:
        """Remember what checkboxes need to find their labels, and where videos are."""
        if tag == "video":
            self.videos.append(node["node_no"])
        if named.get("id"):
            self.ids.setdefault(named["id"], node)
        if tag == "label":
            self.labels.append(node)
            if named.get("for"):
                self.labels_for[named["for"]].append(node)
        if tag == "input" and named.get("type", "").lower() == "checkbox":
            self.boxes.append((node, named, self.labels[-1] if self.labels else None))

    def _text_of(self, node: dict) -> str:
        return "".join(self.pieces[node["piece_lo"]:node["piece_hi"]])

    def _label_boxes(self) -> None:
        """Labels tied by ``for`` or by enclosing, then the enclosing one, aria-label, the element that aria-labelledby names."""
        for box, named, outer in self.boxes:
            tied = list(self.labels_for.get(named.get("id") or None, ()))
            if outer is not None and not outer["_named"].get("for"):
                tied.append(outer)
            tied = sorted({n["node_no"]: n for n in tied}.items())
            if tied:
                box["label_text"] = " ".join(self._text_of(n) for _, n in tied)
            elif outer is not None:
                box["label_text"] = self._text_of(outer)
            else:
                by = self.ids.get(named.get("aria-labelledby") or None)
                box["label_text"] = named.get("aria-label") or (self._text_of(by) if by else "")

    def _nearest(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def end(self, tag):
        at = self._nearest(tag)
        if at >= 0:
            self._close_to(at)

    def comment(self):
        """A comment is a child that is neither text nor an inline element."""
        self.text_joins = False
        if self.open:
            at = len(self.pieces)
            self.open[-1]["kids"].append({"no": None, "tag": COMMENT, "lo": at, "hi": at})

    def text(self, data):
        if not self.open or self.places["template"]:  # what a template holds is no text of the page
            return
        self.chars += len("".join(data.split()))
        if self.text_joins:
            self.pieces[-1] += data
            return
        at = len(self.pieces)
        self.pieces.append(data)
        self.open[-1]["kids"].append({"no": None, "tag": None, "lo": at, "hi": at + 1})
        self.text_joins = True

    def _close_open(self, tags, scope):
        at = max(map(self._nearest, tags))
        if at >= 0 and at >= max(map(self._nearest, scope)):
            self._close_to(at)

    def _close_to(self, at):
        while len(self.open) > at:
            node = self.open.pop()
            self.places[node["tag"]].pop()
            if node["tag"] == "label":
                self.labels.pop()
            if node["_skips"]:
                self.inside_skipped -= 1
            node["sub_end"] = self.count - 1
            node["piece_hi"] = len(self.pieces)
            node["text_len"] = self.chars - node.pop("_from")
            if self.open:
                self.open[-1]["kids"].append(
                    {"no": node["node_no"], "tag": node["tag"], "lo": node["piece_lo"], "hi": node["piece_hi"]}
                )
        self.text_joins = False

    def finish(self):
        self._inherit()
        self._label_boxes()
        families = defaultdict(list)
        for parent_no, tag, classes, node in self.all:
            members = families[parent_no, tag]
            members.append((node, frozenset([t for t in classes.split() if not _GENERATED.search(t)]) if classes else _NO_TOKENS))
            node["sib_no"] = len(members)
        for (parent_no, _), members in families.items():
            alone = parent_no is None or len(members) == 1
            twins = () if alone else with_twins(Counter(tokens for _, tokens in members))
            for node, tokens in members:
                node["sib_n"], node["twin"] = len(members), tokens in twins


def _same_origin(frame: dict[str, str]) -> bool:
    return "sandbox" not in frame or "allow-same-origin" in frame["sandbox"].lower().split()


class _Source(HTMLParser):
    """Deals a document's markup to the scopes it belongs to."""

    def __init__(self, document: _Tree) -> None:
        super().__init__(convert_charrefs=True)
        self.trees = [document]  # and the shadow roots that are open in it

    def handle_starttag(self, tag, attrs):
        named: dict[str, str] = {}
        for name, value in attrs:
            named.setdefault(name, value or "")
        tree = self.trees[-1]
        if tag == "template" and tree.may_host(named):
            self.trees.append(tree.attach("shadow"))
        else:
            tree.start(tag, named)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        tree = self.trees[-1]
        if tag == "template" and len(self.trees) > 1 and tree._nearest("template") < 0:
            self.trees.pop()._close_to(0)
        else:
            tree.end(tag)

    def updatepos(self, i, j):
        """Lines aren't counted."""
        return j

    def handle_comment(self, data):
        self.trees[-1].comment()

    def handle_data(self, data):
        self.trees[-1].text(data)

    def read(self) -> bool:
        """False if the markup breaks the parser; what was read so far stays."""
        try:
            self.feed(self.trees[0].markup)
            self.close()
            return True
        except Exception:
            return False
        finally:
            for tree in reversed(self.trees):
                tree._close_to(0)


def _append(page: _Tree, scope: _Tree, scope_no: int) -> None:
    """Put a scope's elements and texts behind those of the page, with numbers that go on."""
    first, at, piece = page.count, len(page.nodes), len(page.pieces)
    for node in scope.nodes:
        node["scope_no"] = scope_no
        node["node_no"] += first
        node["sub_end"] += first
        for of in ("parent_no", "block_no", "link_no", "control_no"):
            if node[of] is not None:
                node[of] += first
        node["anc"] = [a + at for a in node["anc"]]
        node["piece_lo"] += piece
        node["piece_hi"] += piece
        for kid in node["kids"]:
            kid["lo"] += piece
            kid["hi"] += piece
            if kid["no"] is not None:
                kid["no"] += first
    page.count += scope.count
    page.nodes += scope.nodes
    page.pieces += scope.pieces
    page.videos += [v + first for v in scope.videos]


def _tree_of(html: str | None, skipped: bool = True):
    """All scopes of a page as one list of elements, in ``scopes`` what each hangs on."""
    page, failed = _Tree(skipped, markup=html or ""), False
    page.scopes, waiting = [], [page]
    while waiting:
        scope = waiting.pop()
        if scope.markup is not None:
            failed |= not _Source(scope).read()
        scope.finish()
        # The host has its final number by now: its scope was appended before.
        page.scopes.append({"kind": scope.kind, "host_no": scope.host and scope.host["node_no"], "gone": scope.gone, "dark": scope.dark})
        waiting += reversed(scope.inner)
        if scope is page:
            for node in page.nodes:
                node["scope_no"] = 0
        else:
            _append(page, scope, len(page.scopes) - 1)
    return page, failed


_INT, _TEXT = pa.int32(), pa.string()
_NODE_ARROW = pa.struct([
    *[(name, _INT) for name in ("node_no", "parent_no", "depth", "sub_end")],
    ("tag", _TEXT), ("attrs", pa.map_(_TEXT, _TEXT)), ("anc", pa.list_(_INT)),
    *[(name, _INT) for name in ("piece_lo", "piece_hi", "text_len", "sib_no", "sib_n")],
    ("twin", pa.bool_()),
    ("kids", pa.list_(pa.struct([("no", _INT), ("tag", _TEXT), ("lo", _INT), ("hi", _INT)]))),
    ("label_text", _TEXT),
    *[(name, _INT) for name in ("scope_no", "marks", "block_no", "link_no", "control_no")],
])
_SCOPE_ARROW = pa.struct([("kind", _TEXT), ("host_no", _INT), ("gone", pa.bool_()), ("dark", pa.bool_())])


def _parse_batches(batches, html_col: str, page_chunk: int, skipped: bool):
    for batch in batches:
        kept = [f for f in batch.schema if f.name != html_col]
        schema = pa.schema(kept + [
            pa.field("parse_error", pa.bool_()), pa.field("pieces", pa.list_(_TEXT)),
            pa.field("nodes", pa.list_(_NODE_ARROW)), pa.field("video_nos", pa.list_(_INT)), pa.field("page_scopes", pa.list_(_SCOPE_ARROW)),
        ])
        for start in range(0, batch.num_rows, page_chunk):
            part = batch.slice(start, page_chunk)
            trees = [_tree_of(html, skipped) for html in part.column(html_col).to_pylist()]
            made = ([failed for _, failed in trees], [t.pieces for t, _ in trees], [t.nodes for t, _ in trees], [t.videos for t, _ in trees],
                    [t.scopes for t, _ in trees])
            arrays = [part.column(f.name) for f in kept]
            arrays += [pa.array(v, schema.field(len(kept) + i).type) for i, v in enumerate(made)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def parse_pages(pages: DataFrame, html_col: str = "html", page_chunk: int = 64, skipped: bool = True) -> DataFrame:
    """``pages`` without its HTML, plus ``parse_error``, ``pieces``, ``nodes``, ``video_nos`` and ``page_scopes``.

    ``skipped=False`` leaves out what lies in scripts, styles, templates and
    the like; numbers of nodes and siblings stay the same.  ``anc`` holds
    places in ``nodes`` and ``scope_no`` one in ``page_scopes``.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    out = T.StructType([f for f in pages.schema.fields if f.name != html_col])
    for name, ddl in (("parse_error", "boolean"), ("pieces", "array<string>"), ("nodes", f"array<{NODE_TYPE}>"), ("video_nos", "array<int>"),
                      ("page_scopes", f"array<{SCOPE_TYPE}>")):
        out = out.add(name, T.DataType.fromDDL(ddl))

    def run(batches):
        return _parse_batches(batches, html_col, page_chunk, skipped)

    return pages.mapInArrow(run, out)
