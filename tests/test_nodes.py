from pyspark.sql import functions as F

from uipatterns.functions import text as X
from uipatterns.operators import nodes as N
from uipatterns.operators.candidates import extract_candidates, page_candidates


def texts(df):
    return sorted(r.text for r in df.select("text").collect())


def tree(df):
    rows = df.orderBy("node_no").select("node_no", "parent_no", "sub_end", "tag").collect()
    return [(r.node_no, r.parent_no, r.sub_end, r.tag) for r in rows]


def test_implied_end_tags(page):
    df = N.explode_nodes(page("<p>one<p>two<ul><li>a<li>b</ul><br>x"))
    assert tree(df) == [
        (0, None, 7, "html"), (1, 0, 7, "body"), (2, 1, 2, "p"), (3, 1, 3, "p"), (4, 1, 6, "ul"), (5, 4, 5, "li"),
        (6, 4, 6, "li"), (7, 1, 7, "br"),
    ]


def test_broken_and_empty_pages_do_not_fail(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<div><p>open<b>"), (4, "u", "<p>ok</p></div></x>")]
    df = N.explode_nodes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r["count"] for r in df.groupBy("page_id").count().collect()} == {3: 3, 4: 1}


def test_whole_text_of_a_long_page_is_read(page):
    body = "".join(f"<p>line number {i} of the page</p>" for i in range(3000))
    df = N.explode_nodes(page(body), text_content=True)
    assert df.filter("tag = 'p'").count() == 3000
    assert df.filter("tag = 'body'").select(F.length("text_content")).first()[0] == sum(
        len(f"line number {i} of the page") for i in range(3000))


def test_prune_drops_skipped_and_hidden_subtrees(page):
    df = N.prune(N.explode_nodes(page('<script>x</script><div aria-hidden="true"><p>no</p></div><p>yes</p>')))
    assert [r.tag for r in df.orderBy("node_no").collect()] == ["html", "body", "p"]


def test_leaf_text_joins_inline_children_only(page):
    df = N.explode_nodes(page('<div id="a"><s>Rs 1</s><span>Rs 2</span></div><div id="b"><p>x</p><span>y</span></div>'))
    got = {r.id: r.leaf_text for r in df.filter("tag = 'div'").select(N.attr("id").alias("id"), "leaf_text").collect()}
    assert got == {"a": "Rs 1 Rs 2", "b": None}


def test_visibility(page):
    body = ('<p>shown text</p><p style="display: none">gone one</p><p hidden>gone two</p>'
            '<div style="visibility:hidden"><p>gone three</p><p style="visibility:visible">seen again</p></div>'
            '<p style="opacity:0">gone four</p><div style="display:none"><p style="position:fixed">pinned text</p></div>')
    assert texts(extract_candidates(N.explode_nodes(page(body), candidate_texts=True))) == [
        "pinned text", "seen again", "shown text"]


def test_sticky_navigation_is_dropped_but_banners_stay(page):
    body = ('<header style="position:sticky"><a href="/o">Returns and orders</a></header>'
            '<div class="site-header" style="position: fixed"><p>Top links</p></div>'
            '<div class="consent" style="position:fixed"><p>We use cookies</p></div><header><p>Plain header</p></header>')
    assert texts(extract_candidates(N.explode_nodes(page(body), candidate_texts=True))) == ["Plain header", "We use cookies"]


def test_selector(page):
    body = '<div><p>a</p><p id="x1"><b>c</b></p><p>d</p></div>'
    df = N.explode_nodes(page(body)).select("tag", "node_no", N.stable_selector().alias("s")).orderBy("node_no")
    assert [r.s for r in df.collect()] == [
        "html", "html > body", "html > body > div", "html > body > div > p:nth-of-type(1)", "p#x1", "p#x1 > b",
        "html > body > div > p:nth-of-type(3)"]


def test_selector_has_six_steps_at_most(page):
    df = N.explode_nodes(page("<div>" * 8 + "<b>deep</b>" + "</div>" * 8)).filter("tag = 'b'")
    assert df.select(N.stable_selector()).first()[0] == "div > div > div > div > div > b"


def test_video_context(page):
    body = '<div class="vjs-"><span id="a">0:35</span></div><div><video></video><p><span id="b">0:40</span></p></div><div><div><div><div><div><div><div><span id="c">0:41</span></div></div></div></div></div></div></div>'
    df = N.explode_nodes(page(body)).filter("tag = 'span'").select(N.attr("id").alias("id"), N.in_video_player().alias("v"))
    assert {r.id: r.v for r in df.collect()} == {"a": True, "b": True, "c": False}


def test_self_duplicates(spark):
    rows = spark.createDataFrame([("Shop nowShop now",), ("aaaa",), ("abcabc",), ("no repeat",)], "t string")
    got = {r.t: r.x for r in rows.select("t", X.collapse_self_dup(F.col("t")).alias("x")).collect()}
    assert got == {"Shop nowShop now": "Shop now", "aaaa": "aaaa", "abcabc": "abcabc", "no repeat": "no repeat"}


def test_wrapper_duplicates_keep_the_inner_and_its_role(page):
    df = page_candidates(page(
        '<div class="stock"><span>Low stock</span></div><div>Hi there<span>Hi there</span></div>'
        '<div class="promo"><div class="toast"><b><i>Nested words</i></b></div></div>'))
    got = sorted((r.text, r.tag, r.role) for r in df.collect())
    assert got == [("Hi there", "div", "body"), ("Hi there", "span", "body"), ("Low stock", "span", "stock"), ("Nested words", "i", "toast")]


def test_many_equal_wrappers_on_one_page(page):
    body = '<div class="stock"><span>Low stock</span></div><div><span>Low stock</span></div>' * 500
    df = page_candidates(page(body))
    got = {r.role: r["count"] for r in df.groupBy("role").count().collect()}
    assert got == {"stock": 500, "body": 500} and df.filter("tag = 'div'").count() == 0


def test_ascii_word_edges_and_no_break_space(spark):
    rows = spark.createDataFrame([("cancelé now",), ("cancelling",), ("please cancel",)], "t string")
    got = [r[0] for r in rows.select(X.matches(F.col("t"), r"\bcancel\b")).collect()]
    assert got == [True, False, True]
    nbsp = spark.createDataFrame([("a  b　c ",)], "t string")
    assert nbsp.select(X.collapse_space(F.col("t")), X.word_count(F.col("t"))).first() == ("a b c", 3)


def test_page_lang_step_host(spark):
    rows = spark.createDataFrame([
        ('<html class="x" lang="ne-NP">', "https://A.Example:8080/Checkout/1?x"), ("<html>", "https://b.example/bag"), ('<html lang=fr>', "not a url")],
        "html string, url string")
    got = rows.select(X.page_lang(F.col("html")), X.infer_step(F.col("url")), X.host_of(F.col("url"))).collect()
    assert [tuple(r) for r in got] == [("ne", "payment", "a.example"), ("en", "cart", "b.example"), ("en", "product", "not a url")]


def test_twins_equal_the_comparison_of_all_pairs():
    import random
    from collections import Counter

    from uipatterns.sources.html import with_twins

    rng = random.Random(1)
    for _ in range(400):
        sets = [frozenset(rng.sample("abcdefghij", rng.randint(0, 6))) for _ in range(rng.randint(1, 12))]
        want = {a for i, a in enumerate(sets) for j, b in enumerate(sets)
                if i != j and (not a and not b or min(len(a), len(b)) > 0 and 2 * len(a & b) >= min(len(a), len(b)))}
        assert with_twins(Counter(sets)) == want


def test_many_siblings_with_partly_shared_classes_parse_in_seconds():
    import time

    from uipatterns.sources.html import _tree_of

    start = time.time()
    for cls in ("t{m} u{i}", "card item a{i} b{i} c{i}", "card t{m} x{i}"):
        items = "".join(f'<li class="{cls.format(m=i % 3, i=f"{i // 26:x}q{i % 26}")}">x</li>' for i in range(20_000))
        tree, failed = _tree_of(f"<ul>{items}</ul>")
        assert not failed and len(tree.nodes) == 20_001
    assert time.time() - start < 30


def test_a_comment_child_makes_no_leaf_text(page):
    from uipatterns.operators.nodes import explode_nodes

    rows = explode_nodes(page("<p><span>ab</span><!-- --><span>cd</span></p><p><span>ab</span> <span>cd</span></p>")).filter("tag = 'p'").orderBy("node_no").collect()
    assert [r["leaf_text"] for r in rows] == [None, "ab cd"]


def test_deep_pages_take_linear_time(spark, page):
    import time

    from uipatterns.sources.html import _tree_of

    def took(n):
        start = time.process_time()
        tree, failed = _tree_of("<b>" * n + "<div><a href='x'>" * n + "</zz>" * n)
        assert not failed and len(tree.nodes) == 3 * n and max(len(x["anc"]) for x in tree.nodes) < 40
        return time.process_time() - start

    took(1000)
    assert took(20_000) < 8 * took(5_000) + 0.5


def test_questions_about_far_ancestors(page):
    """What lies above the last 24 steps still counts."""
    deep = "<i>" * 40
    body = (f'<label><form role="dialog"><a href="/x">{deep}in all{"</i>" * 40}</a></form></label>'
            f'<div hidden>{deep}unseen{"</i>" * 40}</div><div style="color: rgb(1, 2, 3)"><s>{deep}old price{"</i>" * 40}</s></div>'
            f'<div style="visibility:hidden">{deep}dark{"</i>" * 40}</div><div aria-hidden="true">{deep}mute{"</i>" * 40}</div>'
            f'<div style="visibility:hidden"><div style="visibility:visible">{deep}lit up{"</i>" * 40}</div></div>')
    rows = {r.text: r for r in extract_candidates(N.explode_nodes(page(body), candidate_texts=True)).filter("own").collect()}
    assert set(rows) == {"in all", "old price", "lit up"}
    one = rows["in all"]
    assert one.in_label and one.in_form and one.in_dialog and one.link_no == one.control_no == one.node_no - 40
    assert rows["old price"].struck and not rows["lit up"].struck and one.block_no >= 0
    # a member of an inline run longer than the path still finds the candidate that holds it
    run = f"<p>Ends in{deep}<b>09:52</b>{'</i>' * 40}</p>"
    from uipatterns.operators.groups import propose_groups

    assert [(r.text, r.type) for r in propose_groups(page_candidates(page(run))).collect()] == [("Ends in 09:52", "timer_label_value")]


def test_rows_are_the_same_without_skipped_subtrees(page):
    body = ('<div><svg><g><video></video><text id="t">x</text></g></svg><script>var a = "<p>no</p>"</script><p>one</p><template><p>never</p></template>'
            '<p>two</p></div><noscript><b>three</b></noscript><ul><li class="c">a b</li><li class="c">c d</li></ul>')
    cols = ["node_no", "parent_no", "sub_end", "text", "selector", "card_no", "in_video", "block_no"]
    some = lambda df: sorted(tuple(r) for r in extract_candidates(df).select(*cols).collect())
    got = some(N.explode_nodes(page(body), candidates_only=True))
    assert got == some(N.explode_nodes(page(body), candidate_texts=True)) and [r[3] for r in got] == ["one", "two", "a b", "c d"]


def test_page_report_parses_once(spark, page):
    from uipatterns.plans.page_scan import page_report

    body = '<label><input type="checkbox" checked>Send me offers</label><p>Only 3 left</p><b>-</b>'
    df = page_report(page(body, "", body).unionByName(page("<p>alone</p>")))
    assert sorted((r.page_id, r.candidates, r.findings) for r in df.collect()) == [(1, 4, 2), (1, 4, 2), (2, 0, 0), (3, 3, 2)]
    plan = page_report(page(body))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


SCOPED = (
    '<div id="h"><template shadowrootmode="open"><p class="a">in root</p><p>next one</p><my-tag><template shadowrootmode="open"><b>inner root</b>'
    '</template>light text</my-tag></template><p class="a">in light</p></div><p>after it</p>'
    '<iframe srcdoc="&lt;body&gt;&lt;p&gt;in frame&lt;/p&gt;&lt;label for=x&gt;Offers&lt;/label&gt;&lt;input type=checkbox id=x&gt;&lt;/body&gt;"></iframe>'
)


def test_shadow_roots_and_frames_are_scopes(page):
    rows = N.explode_nodes(page(SCOPED)).filter("tag IN ('p', 'b', 'my-tag')").select(
        "node_no", "leaf_text", "parent_no", N.stable_selector().alias("s"), "scope.no", "scope.kind", "scope.host_no").orderBy("node_no").collect()
    # 0 html, 1 body, 2 div, 3 p, 4 p, 5 iframe; 6-8 the outer root; 9 the inner root; 10 body, 11 p ... of the frame
    assert [tuple(r) for r in rows] == [
        (3, "in light", 2, "div#h > p", 0, "document", None), (4, "after it", 1, "html > body > p", 0, "document", None),
        (6, "in root", None, "p:nth-of-type(1)", 1, "shadow", 2), (7, "next one", None, "p:nth-of-type(2)", 1, "shadow", 2),
        (8, "light text", None, "my-tag", 1, "shadow", 2), (9, "inner root", None, "b", 2, "shadow", 8),
        (11, "in frame", 10, "body > p", 3, "frame", 5)]
    box = N.explode_nodes(page(SCOPED), candidates_only=True, kinds=True).filter("kind = 'checkbox'").collect()
    assert [(b.label_text, b.scope.no, b.node_no) for b in box] == [("Offers", 3, 13)]
    host = N.explode_nodes(page(SCOPED), text_content=True).filter("node_no = 2").first()
    assert host.text_content == "in light" and host.sub_end == 3


def test_scopes_that_nobody_reaches(page):
    """Closed roots, roots on elements that can't host one, second roots, frames from elsewhere, anything in skipped parts."""
    root = '<template shadowrootmode="open"><p>in here</p></template>'
    frame = '<iframe srcdoc="<p>in here</p>"{}></iframe>'
    for body, n in ((f"<div>{root}</div>", 1), (f"<b>{root}</b>", 0), (f"<div>{root}{root}</div>", 1), (f"<noscript><div>{root}</div></noscript>", 0),
                    (f"<div>{root.replace('open', 'closed')}</div>", 0), (f"<template><div>{root}</div></template>", 0), (frame.format(""), 1),
                    (frame.format(" sandbox"), 0), (frame.format(' sandbox="allow-same-origin"'), 1), ('<iframe srcdoc=""></iframe>', 0)):
        assert texts(page_candidates(page(body)).filter("scope_no > 0")) == ["in here"] * n, body


def test_text_of_a_template_belongs_to_nothing(page):
    rows = N.explode_nodes(page("<div><b>ab<template><i>no</i></template>cd</b></div>"), text_content=True).filter("tag IN ('div', 'b')")
    # a template is no inline child, so only the outer element is a leaf
    assert [(r.leaf_text, r.text_content) for r in rows.orderBy("node_no").collect()] == [("abcd", "abcd"), (None, "abcd")]


def test_hidden_hosts_hide_their_scopes(page):
    root, lit = '<template shadowrootmode="open"><p>in here</p></template>', '<template shadowrootmode="open"><p style="visibility:visible">in here</p></template>'
    frame = '<iframe srcdoc="<p>in here</p>"></iframe>'
    for body, shown in (
        (f'<div hidden>{root}</div>', False), (f'<div style="display:none"><div>{root}</div></div>', False), (f'<div hidden>{frame}</div>', False),
        (f'<div style="visibility:hidden">{root}</div>', False), (f'<div style="visibility:hidden">{lit}</div>', True),
        (f'<div style="visibility:hidden">{frame}</div>', True), (f'<div hidden>{"<i>" * 40}<div>{root}</div></div>', False),
        (f'<div hidden><div><template shadowrootmode="open"><div>{root}</div></template></div></div>', False),
        (f'<div style="opacity:0"><div>{root}</div></div>', True), (f'<div aria-hidden="true"><div>{root}</div></div>', True),
    ):
        assert texts(page_candidates(page(body))) == ["in here"] * shown, body


def test_steps_within_a_page_stay_in_their_scope(page):
    """Equal texts of host and root are no nested duplicates; one id stands for one selector and text."""
    twice = '<div><template shadowrootmode="open"><p>Only 3 left</p></template><span>Only 3 left</span></div>'
    got = sorted(tuple(r) for r in page_candidates(page(twice + twice)).select("text", "tag", "scope_no").collect())
    assert got == [("Only 3 left", "p", 1), ("Only 3 left", "span", 0), ("Only 3 left", "span", 0)]


def test_many_and_deep_scopes_take_linear_time():
    import time

    from uipatterns.sources.html import _tree_of

    def took(n):
        start = time.process_time()
        deep = '<div><template shadowrootmode="open">' * n + "<p>x</p>" + "</template></div>" * n
        tree, failed = _tree_of(deep + '<iframe srcdoc="<p>x</p>"></iframe>' * n)
        assert not failed and len(tree.scopes) == 2 * n + 1 and len(tree.nodes) == 3 * n + 1
        return time.process_time() - start

    took(500)
    assert took(8_000) < 8 * took(2_000) + 0.5
