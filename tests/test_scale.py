"""What must hold for an operator to grow with its tables: partitions, exchanges and files."""

import datetime
import glob
from collections import Counter

from pyspark.sql import functions as F

from uipatterns.catalog import QUERIES
from uipatterns.catalog import inputs as I
from uipatterns.operators import baseline as B
from uipatterns.operators import candidates as C
from uipatterns.operators import groups as G
from uipatterns.operators import nodes as N
from uipatterns.sources import archive as A
from uipatterns.sources import html as H


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_finding_again_broadcasts_no_side(spark):
    found = spark.createDataFrame([(1, "c", "b", "abc", "p > b")], "page_id long, cand_id string, tag string, text string, selector string")
    nodes = spark.createDataFrame([(1, 2, "d", "b", "p > b", "abc")], "page_id long, node_no int, cand_id string, tag string, selector string, text_content string")
    out = G.resolve_snapshot(found, nodes)
    assert "BroadcastHashJoin" not in plan_of(out)
    assert [(r.node_no, r.outcome) for r in out.collect()] == [(2, "selector")]


def test_context_broadcasts_no_side(page):
    cands = C.page_candidates(page("<div><b>one</b><i>two</i><p>three</p></div>"))
    assert "BroadcastHashJoin" not in plan_of(G.neighbour_context(cands.filter("tag = 'b'"), cands))


def test_measured_layout_is_not_broadcast(spark, page):
    layout = spark.createDataFrame([(1, 2, 5.0)], "page_id long, node_no int, area double")
    assert "BroadcastHashJoin" not in plan_of(C.page_candidates(page("<b>one</b>"), layout))


def test_part_pages_have_more_partitions_than_their_bytes_ask_for(spark, tmp_path):
    spark.range(320).select(F.col("id").alias("p_partkey"), F.lit("x").alias("p_name")).write.parquet(str(tmp_path / "part.parquet"))
    pages = I.part_pages(spark, str(tmp_path), ["<b>#</b>"])
    assert pages.rdd.getNumPartitions() >= 8 and pages.count() == 10


def test_candidates_of_many_characters_have_partitions_for_them(page, monkeypatch):
    monkeypatch.setattr(C, "PART_CHARS", 10)
    cands = C.page_candidates(page("<b>one</b>", "<b>two</b>"))
    assert cands.rdd.getNumPartitions() >= 8
    assert sorted(r.text for r in cands.collect()) == ["one", "two"]


def test_grams_are_counted_without_being_shuffled(spark, monkeypatch):
    monkeypatch.setattr(B, "_HELD", 3)
    texts = [(1, "ab  c"), (1, "ab"), (2, "ab x"), (None, "c"), (None, "ab"), (3, None)]
    df = spark.createDataFrame(texts, "row_id long, model_input string")
    out = B.fit_vocabulary(df)
    assert "Generate" not in plan_of(out)
    rows = df.select("row_id", F.explode(B.char_ngrams(F.col("model_input"))).alias("gram")).distinct().collect()
    want = {g for g, n in Counter(r.gram for r in rows).items() if n >= 2}
    assert {r.gram for r in out.collect()} == want and want


def test_a_quiet_day_is_one_file(spark, tmp_path):
    path = str(tmp_path / "arch")
    at = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(f"s{i}", "https://a.example/x", 1, at) for i in range(40)], "scan_id string, url string, page_score int, captured_at timestamp")
    A.write_archive(rows.withColumn("entries", F.lit(None).cast(A._ENTRIES)), path)
    assert len(glob.glob(f"{path}/**/*.parquet", recursive=True)) == 1
    assert A.read_archive(spark, path).count() == 40


def test_marks_say_what_the_steps_of_a_path_say(page):
    deep = "<i>" * 30
    df = N.explode_nodes(page(
        '<label><a href="/x">one <b hidden>two</b></a></label><form role="dialog"><s>three</s><div style="color:red"><p>four</p></div></form>'
        f'<svg><p>five</p></svg><p aria-hidden="true"><b>six</b></p><button><em id="e">seven</em></button><a>eight</a>'
        f'<div class="VJS-x"><del>{deep}nine</del></div><section role="button"><template shadowrootmode="open"><b>ten</b></template></section>'))
    has = lambda test: F.exists("path", lambda n: F.coalesce(test(n), F.lit(False)))
    last = lambda steps, test: F.try_element_at(F.transform(F.filter(steps, lambda n: F.coalesce(test(n), F.lit(False))), lambda n: n["node_no"]), F.lit(-1))
    checks = {
        "skipped": N.marked(H.SKIPPED) == has(lambda n: n["tag"].isin(H.SKIP_TAGS) | n["aria_hidden"]),
        "label": N.marked(H.LABEL) == has(lambda n: n["tag"] == "label"),
        "form": N.marked(H.FORM) == has(lambda n: n["tag"] == "form"),
        "dialog": N.marked(H.DIALOG) == has(lambda n: n["role"] == "dialog"),
        "struck": N.marked(H.STRUCK) == has(lambda n: n["tag"].isin("s", "del")),
        "hidden": N.marked(H.HIDDEN) == has(lambda n: n["hidden"]),
        "styled": N.marked(H.STYLED) == has(lambda n: n["style"].isNotNull()),
        "block": F.col("block_no").eqNullSafe(last(N.ancestors(), lambda n: ~n["tag"].isin(H.GROUP_INLINE))),
        "link": F.col("link_no").eqNullSafe(last("path", lambda n: (n["tag"] == "a") & n["href"])),
        "control": F.col("control_no").eqNullSafe(last("path", lambda n: n["tag"].isin(H.CONTROL_TAGS) | n["role"].isin(H.CONTROL_ROLES))),
        "video": ~(has(lambda n: n["cls"] == "VJS-x") & ~N.marked(H.VIDEO)),
    }
    rows = df.select("tag", *[c.alias(n) for n, c in checks.items()]).collect()
    assert len(rows) >= 50 and [(r.tag, n) for r in rows for n in checks if r[n] is not True] == []


def test_groups_are_swept_without_a_frame_per_page(page):
    cands = C.page_candidates(page("<time>Ends in<span>09:52</span></time><div>Rs. 10 and<b>Rs. 20</b></div><a>no group</a>", "<p>none</p>"))
    groups = G.propose_groups(cands)
    assert "FlatMapGroupsInArrow" in plan_of(groups)
    assert sorted((r.page_id, r.text, r.type, len(r.member_ids)) for r in groups.collect()) == [
        (1, "Ends in 09:52", "timer_label_value", 2), (1, "Rs. 10 and Rs. 20", "price_comparison", 2)]


def test_nested_texts_spread_candidates_only(spark, monkeypatch):
    spread, explode = [], N.explode_nodes
    monkeypatch.setattr(N, "explode_nodes", lambda *a, **k: spread.append(explode(*a, **k)) or spread[-1])
    assert QUERIES["x15_collapse_nested"](spark, "/root/testdata/sf0.001").count() > 0
    assert spread[0].filter("text IS NULL OR length(text) < 3").count() == 0
