"""Structure between candidates: groups, neighbours, and finding them again later."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uipatterns.functions.text import collapse_space, matches
from uipatterns.operators.sweeps import group_table
from uipatterns.schema import MAX_TEXT, MIN_TEXT
from uipatterns.sources.html import GROUP_INLINE

# --- fixed values ------------------------------------------------------------------
CLOCK = r"\b\d{1,2}:\d{2}(:\d{2})?\b"
TIMER_LABEL = r"\b(ends?|starts?|closes?|expires?|left)\b|मा सकिदै|सकिन|समाप्त|बाँकी|खत्म|शेष"
VIDEO_READOUT = r"\bremaining time\b|\belapsed\b|\bduration\b|\bcurrent time\b|\bplayback\b"
CURRENCY = r"(?:rs\.?|npr|inr|₹|\$|€|£|रु\.?)"
AMOUNT = r"\d[\d,]*(?:\.\d+)?"
REASONS = {
    "timer_label_value": "a countdown's label and its value, split across elements",
    "currency_amount": "a currency symbol and its amount, split across elements",
    "price_comparison": "two prices in one element -- the was/now comparison",
    "other": "a parent's text continued by its inline children",
}
# --- end of fixed values -------------------------------------------------------------


def group_type(text: Column, fragments: Column, in_video: Column) -> Column:
    from uipatterns.functions.text import ascii_regex

    clock = matches(text, CLOCK) & matches(text, TIMER_LABEL) & ~matches(text, VIDEO_READOUT) & ~in_video
    prices = F.regexp_count(text, F.lit(ascii_regex(rf"{CURRENCY}\s*{AMOUNT}", True)))
    only_sign = F.exists(fragments, lambda f: matches(f, CURRENCY) & ~matches(f, AMOUNT))
    only_number = F.exists(fragments, lambda f: matches(f, AMOUNT) & ~matches(f, CURRENCY))
    return (
        F.when(clock, "timer_label_value").when(prices >= 2, "price_comparison")
        .when(only_sign & only_number, "currency_amount").otherwise("other")
    )


def propose_groups(cands: DataFrame) -> DataFrame:
    """One group per candidate that contains others through inline elements only.

    A sweep over the page's candidates in document order (``group_table``)
    finds the members: no join, and no exchange beyond the one by page that
    candidates already have.
    """
    kind = cands.schema["page_id"].dataType.simpleString()
    grouped = cands.select(
        "page_id", "node_no", "sub_end", "cand_id", "text", "run_text", "control_no", "block_no", F.col("tag").isin(GROUP_INLINE).alias("may_join"),
        F.coalesce(F.length("run_text").between(MIN_TEXT, MAX_TEXT), F.lit(False)).alias("may_hold"), "is_animated", "in_video",
    ).groupBy("page_id").applyInArrow(group_table, f"""page_id {kind}, node_no int, cand_id string, text string, run_text string,
        is_animated boolean, in_video boolean, members array<struct<node_no:int,cand_id:string,text:string,is_animated:boolean>>""")
    fragments = F.concat(F.array("text"), F.transform("members", lambda m: m["text"]))
    rows = grouped.select(
        "page_id", "node_no", F.col("cand_id").alias("group_id"), F.col("run_text").alias("text"),
        F.concat(F.array("cand_id"), F.transform("members", lambda m: m["cand_id"])).alias("member_ids"),
        fragments.alias("fragments"), group_type(F.col("run_text"), fragments, F.col("in_video")).alias("type"),
        (F.col("is_animated") | F.exists("members", lambda m: m["is_animated"])).alias("animated"),
        (F.col("run_text") != F.col("text")).alias("reconstructed"),
    )
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return rows.withColumn("reason", reason[F.col("type")])


def neighbour_context(
    targets: DataFrame, cands: DataFrame, levels: int = 5, enough: int = 3, take: int = 10, chars: int = 200,
) -> DataFrame:
    """Candidates near each target: climb until an ancestor holds ``enough`` others.

    ``targets`` are candidates (``page_id, node_no, cand_id, scopes``);
    ``levels`` is at most the number of scopes kept.  A scope is a range of
    element numbers, so running counts give how many candidates it holds and
    which come first in it; no candidate meets its ancestors.
    """
    numbered = cands.select("page_id", "node_no", "text", "tag", "role", F.row_number().over(
        Window.partitionBy("page_id").orderBy("node_no")).alias("place"))
    climbs = targets.select(
        "page_id", F.col("cand_id").alias("target_id"), F.col("node_no").alias("target_no"),
        F.posexplode(F.reverse(F.slice("scopes", -F.least(F.size("scopes"), F.lit(levels)), F.lit(levels)))).alias("level", "scope"),
    ).select("page_id", "target_id", "target_no", "level", "scope.no", "scope.end")
    # The number of candidates up to each bound of a scope.
    ends = climbs.select("page_id", F.explode(F.array("no", "end")).alias("at")).distinct().withColumn("one", F.lit(0))
    points = ends.unionByName(numbered.select("page_id", F.col("node_no").alias("at"), F.lit(1).alias("one")))
    upto = points.withColumn("upto", F.sum("one").over(Window.partitionBy("page_id").orderBy("at"))).filter("one = 0")
    # Several rows per candidate, whatever size the planner takes them for: nothing here is broadcast.
    sized = (climbs.join(upto.select("page_id", F.col("at").alias("no"), F.col("upto").alias("lo")).hint("merge"), ["page_id", "no"])
             .join(upto.select("page_id", F.col("at").alias("end"), F.col("upto").alias("hi")).hint("merge"), ["page_id", "end"]))
    # The target itself lies in every scope, hence one less.
    met = (F.col("hi") - F.col("lo") - 1) >= enough
    scope = F.struct("lo", "hi")
    chosen = sized.groupBy("page_id", "target_id", "target_no").agg(
        F.coalesce(F.min_by(F.when(met, scope), F.when(met, F.col("level"))), F.max_by(scope, "level")).alias("s"))
    first = chosen.select("page_id", "target_id", "target_no", F.explode(
        F.sequence((F.col("s.lo") + 1).cast("int"), F.least(F.col("s.hi"), F.col("s.lo") + take + 1).cast("int"))).alias("place"))
    near = first.join(numbered.hint("merge"), ["page_id", "place"]).filter("node_no <> target_no")
    lines = F.slice(F.array_sort(F.collect_list(F.struct("node_no", F.substring("text", 1, chars).alias("text"),
                                                         "tag", "role"))), 1, take)
    return near.groupBy("page_id", "target_id").agg(
        F.transform(lines, lambda x: F.struct(x["text"].alias("text"), x["tag"].alias("tag"),
                                              x["role"].alias("role"))).alias("context")
    )


def _fitting_nodes(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """``page_id, cand_id, matches, node_no``: the first node of a finding's tag that holds its text, and how many do.

    ``asked``: ``page_id, cand_id, tag, target``; ``nodes``: ``page_id, node_no,
    tag, content``.  A page's findings come first and make one automaton per tag; its nodes
    then pass by in order, each read once whatever the number of findings.  A
    task holds the findings of one page and one batch of nodes.  Counting ends
    at 2, which already says "ambiguous".  Findings no node fits have no row.
    Rows without a page, tag or text fit nothing; repeated findings count once.
    """
    asked = asked.dropna(subset=["page_id", "tag", "target"])
    wanted = nodes.dropna(subset=["content"]).join(asked.select("page_id", "tag").distinct().hint("merge"), ["page_id", "tag"], "left_semi")
    stream = asked.select("page_id", F.lit(None).cast(nodes.schema["node_no"].dataType).alias("node_no"), "tag",
                          F.col("target").alias("content"), "cand_id", F.lit(False).alias("is_node")).unionByName(
        wanted.select("page_id", "node_no", "tag", "content", F.lit(None).cast(asked.schema["cand_id"].dataType).alias("cand_id"),
                      F.lit(True).alias("is_node")))

    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def search(batches):
        from ahocorasick import Automaton

        page, machines, hits, fields = object(), {}, {}, None

        def done():
            return [(page, cand, len(places), places[0]) for cand, places in hits.items()]

        for batch in batches:
            fields = [batch.schema.field(c).type for c in ("page_id", "cand_id", "node_no")]
            rows, out = batch.to_pydict(), []
            for at, no, tag, text, cand, is_node in zip(*(rows[c] for c in ("page_id", "node_no", "tag", "content", "cand_id", "is_node"))):
                if at != page:
                    out += done()
                    page, machines, hits = at, {}, {}
                if not is_node:
                    machine = machines.setdefault(tag, Automaton())
                    machine.get(text, None) or machine.add_word(text, set())
                    machine.get(text).add(cand)
                    continue
                machine = machines[tag]
                machine.make_automaton()  # does nothing once made
                met = set()
                for _, cands in machine.iter(text):
                    met |= cands
                for one in met:
                    places = hits.setdefault(one, [])
                    if len(places) < 2:
                        places.append(no)
            yield _hit_batch(out, fields)
        if fields:
            yield _hit_batch(done(), fields)

    ordered = stream.repartition("page_id").sortWithinPartitions("page_id", "is_node", "node_no", "cand_id")
    kinds = {f.name: f.dataType for f in stream.schema}
    return ordered.mapInArrow(search, T.StructType([
        T.StructField("page_id", kinds["page_id"]), T.StructField("cand_id", kinds["cand_id"]),
        T.StructField("matches", T.IntegerType()), T.StructField("node_no", kinds["node_no"])]))


def _hit_batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    page, cand, node = kinds
    columns = zip(*rows) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (page, cand, pa.int32(), node))],
                                      names=["page_id", "cand_id", "matches", "node_no"])


def resolve_snapshot(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Find stored findings again in a later snapshot of their page.

    ``findings``: ``page_id, cand_id, tag, text, selector``.  ``nodes``:
    ``page_id, node_no, cand_id, tag, selector, text_content``.  By id first,
    then by selector with tag and text, then by tag and text if exactly one
    unclaimed node fits.  Where two findings want one node the smaller id wins.
    Both sides hold several rows for every element of every page, far more than
    the size of the pages tells the planner, so no side is ever broadcast.
    """
    def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        return left.join(right.hint("merge"), keys, how)

    # A step without a position means the first fitting element.
    place = F.regexp_replace("selector", r"(^| > )([a-z][a-z0-9-]*)(?= > |$)", "$1$2:nth-of-type(1)").alias("selector")
    nodes = nodes.select("page_id", "node_no", "cand_id", "tag", place,
                         collapse_space(F.col("text_content")).alias("content"))
    wanted = findings.select("page_id", "cand_id", "tag", place, collapse_space(F.col("text")).alias("target"))
    by_id = (
        meet(wanted, nodes.select("page_id", "cand_id", "tag", "node_no"), ["page_id", "cand_id", "tag"])
        .groupBy("page_id", "cand_id").agg(F.min("node_no").alias("node_no"))
        .withColumn("outcome", F.lit("registry"))
    )
    claimed = by_id.select("page_id", "node_no")
    rest = meet(wanted, by_id.select("page_id", "cand_id"), ["page_id", "cand_id"], "left_anti")

    spot = nodes.groupBy("page_id", "selector").agg(F.min_by(F.struct("node_no", "tag", "content"), "node_no").alias("s"))
    fits = meet(rest, spot, ["page_id", "selector"]).filter(
        (F.col("target") != "") & (F.col("s.tag") == F.col("tag")) & F.contains("s.content", "target")
    ).select("page_id", "cand_id", F.col("s.node_no").alias("node_no"))
    free = meet(fits, claimed, ["page_id", "node_no"], "left_anti").groupBy("page_id", "node_no").agg(
        F.min("cand_id").alias("winner"))
    by_selector = (
        meet(fits, free, ["page_id", "node_no"], "left")
        .withColumn("outcome", F.when(F.col("winner").eqNullSafe(F.col("cand_id")), "selector").otherwise("claimed"))
        .select("page_id", "cand_id", F.when(F.col("outcome") == "selector", F.col("node_no")).alias("node_no"), "outcome")
    )
    claimed = claimed.unionByName(by_selector.filter("outcome = 'selector'").select("page_id", "node_no"))
    rest = meet(rest, by_selector.select("page_id", "cand_id"), ["page_id", "cand_id"], "left_anti")

    unclaimed = meet(nodes, claimed, ["page_id", "node_no"], "left_anti")
    per = _fitting_nodes(rest.filter(F.length("target") >= MIN_TEXT), unclaimed)
    owner = per.filter("matches = 1").groupBy("page_id", "node_no").agg(F.min("cand_id").alias("owner"))
    by_text = meet(meet(rest.select("page_id", "cand_id"), per, ["page_id", "cand_id"], "left"), owner, ["page_id", "node_no"], "left")
    found = (F.col("matches") == 1) & (F.col("owner") == F.col("cand_id"))
    by_text = by_text.select(
        "page_id", "cand_id", F.when(found, F.col("node_no")).alias("node_no"),
        F.when(found, "reresolved").when(F.col("matches") > 1, "ambiguous").otherwise("not-found").alias("outcome"),
    )
    return by_id.unionByName(by_selector).unionByName(by_text)
