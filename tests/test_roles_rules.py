from pyspark.sql import functions as F

from uipatterns.operators import groups as G
from uipatterns.operators import nodes as N
from uipatterns.operators import rules as R
from uipatterns.operators.candidates import extract_candidates, page_candidates
from uipatterns.operators.fields import infer_field
from uipatterns.operators.roles import infer_role



def role_of(spark, text, tag="span", lang="en", **attrs):
    made = F.create_map(*[F.lit(x) for kv in attrs.items() for x in (kv[0].replace("_", "-"), kv[1])]) if attrs else F.create_map().cast("map<string,string>")
    return spark.range(1).select(infer_role(F.lit(text), F.lit(tag), F.lit(lang), made)).first()[0]


def test_roles(spark):
    cases = [
        ("Noise Cancelling headphones", "a", "en", {}, "body"), ("Cancel", "a", "en", {}, "decline"),
        ("रद्द करें", "a", "hi", {}, "decline"), ("Add to cart", "div", "en", {}, "cta"), ("Go", "button", "en", {}, "cta"),
        ("Next", "button", "en", {"class": "carousel-next slider next"}, "body"), ("Pay", "button", "en", {"type": "submit", "class": "menu"}, "cta"),
        ("Close", "button", "en", {}, "body"), ("More", "button", "en", {"aria_expanded": "false"}, "body"),
        ("call us for help", "p", "en", {}, "support_link"), ("x", "a", "en", {"href": "tel:1"}, "support_link"),
        ("Title", "h3", "en", {"class": "modal"}, "heading"), ("words", "p", "en", {"class": "modal-body"}, "modal_text"),
        ("Rs. 2,499 -54%", "span", "en", {}, "promo"), ("terms", "p", "en", {"class": "fine-print"}, "fine_print"),
        ("x", "input", "en", {"type": "CHECKBOX"}, "checkbox"), ("few", "p", "en", {"id": "stock-note"}, "stock"),
        ("05:00", "p", "en", {"class": "countdown"}, "timer"), ("05:00", "p", "en", {}, "body"),
    ]
    assert [(c[0], role_of(spark, *c[:3], **c[3])) for c in cases] == [(c[0], c[4]) for c in cases]


def test_structural_roles(page):
    body = ('<form><label>Your name <input required></label><input required aria-label="E-mail please"></form>'
            '<div role="dialog"><p>Wait here</p></div><p style="font-size:10px">small words</p>')
    df = page_candidates(page(body))
    assert {r.text: r.role for r in df.collect()} == {"Your name": "label", "Wait here": "modal_text", "small words": "fine_print"}


def test_ticking_clock_becomes_timer(page):
    pages = page("<p><b>02:10</b> left</p>")
    ticking = extract_candidates(N.explode_nodes(pages, candidate_texts=True)).filter("tag = 'b'").select("page_id", "selector")
    df = page_candidates(pages, animated=ticking)
    assert {r.text: (r.role, r.is_animated) for r in df.collect()} == {"02:10": ("timer", True), "left": ("body", False)}
    hits = R.run_rules(df).filter("is_animated").select("rule_hits").first()[0]
    assert [(h.rule, h.label) for h in hits] == [("countdown_timer", "false_urgency")]


def test_fields(spark):
    rows = [("-54%", "span"), ("Rs. 1,199", "s"), ("Rs. 1,199", "b"), ("4.6 out of 5", "span"), ("a@b.co", "p"), ("★★★★", "p"), ("120 sold", "p"),
            ("Free delivery", "p"), ("only 3 left", "p"), ("4111 1111 1111 1111", "p"), ("Big words", "h2"), ("word " * 25, "p"), ("One. Two three four five six seven eight.", "p")]
    df = spark.createDataFrame(rows, "text string, tag string")
    got = [r[0] for r in df.select(infer_field(F.col("text"), F.col("tag"), F.lit("body"), F.col("tag") == "s")).collect()]
    assert got == ["discount", "strike_price", "price", "rating", "personal", "rating", "sold_count", "shipping", "stock", "personal", "title",
                   "prose", "prose"]


CARD = '<li class="card {c}"><a href="/p"><b>Sponsored</b><i>{t}</i></a><s>Rs. 900</s><u>Rs. 500</u></li>'


def test_card_titles(page):
    grid = "<ul>" + CARD.format(c="a1", t="A long product name") + CARD.format(c="hot", t="Another product") + "</ul>"
    menu = '<ol><li><a href="/x">Skin products of all kinds</a></li><li><a href="/y">Medicines</a></li></ol>'
    df = page_candidates(page(grid + menu))
    fields = {r.text: r.field for r in df.filter("tag in ('i', 'b', 's', 'u', 'a')").collect()}
    assert fields["Sponsored A long product name"] == "title" and fields["Sponsored Another product"] == "title"
    assert fields["Sponsored"] == "unknown" and fields["Rs. 900"] == "strike_price" and fields["Rs. 500"] == "price"
    assert fields["Skin products of all kinds"] == "unknown"


def cand(spark, text, **over):
    row = {"text": text, "role": "body", "field": "unknown", "lang": "en", "step": "product", "tag": "p", **over}
    return spark.createDataFrame([row])


def fired(df):
    return [(h.rule, h.label) for h in R.run_rules(df).first().rule_hits]


def test_rule_hits_and_near_misses(spark):
    cases = [
        (cand(spark, "Only 4 left"), [("stock_counter", "scarcity")]), (cand(spark, "40 units in stock"), []), (cand(spark, "120 sold"), []),
        (cand(spark, "Limited stock", field="title"), []), (cand(spark, "Limited stock", field="stock"), [("stock_counter", "scarcity")]),
        (cand(spark, "18 people are viewing"), [("viewer_counter", "social_proof")]), (cand(spark, "18 reviews"), []),
        (cand(spark, "25 people bought this in the last 6 hours"), [("recent_activity", "social_proof")]), (cand(spark, "25 sold"), []),
        (cand(spark, "You must register to continue", role="form_gate"), [("forced_action_gate", "forced_action")]),
        (cand(spark, "You must register to continue"), []),
        (cand(spark, "Service fee Rs. 50", role="line_item", step="payment"), [("late_fee", "sneaking")]),
        (cand(spark, "Service fee Rs. 50", role="line_item", step="cart"), []),
        (cand(spark, "-30%", role="promo", field="discount"), [("discount_badge", "false_urgency")]), (cand(spark, "-30%"), []),
        (cand(spark, "No", role="decline", opacity=0.5), [("hidden_optout", "sneaking"), ("hidden_optout", "obstruction")]),
        (cand(spark, "No", role="decline", font_px=12.0), []), (cand(spark, "No", role="decline", contrast=2.9), [("hidden_optout", "sneaking"), ("hidden_optout", "obstruction")]),
    ]
    for df, want in cases:
        assert fired(df) == want, df.first()


def test_cancel_offsite(spark):
    def hit(href):
        df = cand(spark, "Cancel", role="decline", tag="a").withColumns({"attrs": F.create_map(F.lit("href"), F.lit(href)), "url": F.lit("https://shop.example/cart")})
        return fired(df) == [("cancel_offsite", "obstruction")]

    got = [hit(h) for h in ("tel:1", "mailto:a@b.co", "https://other.example/x", "//cdn.example/a", "/cancel", "https://shop.example:443/c", "#x")]
    assert got == [True, True, True, True, False, False, False]


def test_prechecked_optin_label_order(page):
    body = ('<label for="a">Send me offers</label><input type="checkbox" id="a" checked><label>Join the newsletter <input type="checkbox" checked></label>'
            '<input type="checkbox" aria-label="SMS alerts" checked><span id="n">Marketing mail</span><input type="checkbox" aria-labelledby="n" checked>'
            '<label>I agree <input type="checkbox" checked></label><label>Get emails <input type="checkbox"></label>')
    df = N.explode_nodes(page(body), candidates_only=True, kinds=True).filter("kind = 'checkbox'").withColumns({
        "role": F.lit("checkbox"), "field": F.lit("unknown"), "text": F.lit(""), "checked": F.map_contains_key("attrs", F.lit("checked"))})
    got = [(r.label_text.strip(), r.fires) for r in df.withColumn("fires", R.prechecked_optin()).orderBy("node_no").collect()]
    assert got == [("Send me offers", True), ("Join the newsletter", True), ("SMS alerts", True), ("Marketing mail", True), ("I agree", False), ("Get emails", False)]


def test_cta_asymmetry_takes_the_nearest_scope(page):
    body = '<div><div><button>Accept all</button><a class="btn">No thanks</a></div><button>Huge other button</button></div>'
    nodes = N.explode_nodes(page(body), candidate_texts=True)
    area = F.when(F.col("text") == "Accept all", 400.0).when(F.col("text") == "No thanks", 100.0).when(F.col("text").startswith("Huge"), 9000.0)
    nodes = nodes.withColumn("area", area)
    cands = extract_candidates(nodes, layout=nodes.select("page_id", "node_no", "area"))
    out = R.add_accept_area(cands, nodes.filter(N.is_button(F.col("tag"), F.col("attrs")))).filter("text = 'No thanks'")
    assert out.select("area", "accept_area").first() == (100.0, 400.0)
    assert ("cta_asymmetry", "obstruction") in fired(out)


def test_new_fee_lines(spark):
    rows = [("s1", "cart", "Service fee Rs. 5"), ("s1", "payment", "Service fee Rs. 5"), ("s2", "payment", "Handling fee"), ("s2", "payment", "Total")]
    df = spark.createDataFrame(rows, "session_id string, step string, text string").withColumns({"role": F.lit("line_item"), "lang": F.lit("en")})
    assert [(r.session_id, r.text) for r in R.new_fee_lines(df).collect()] == [("s2", "Handling fee")]


def test_groups(page):
    body = ('<time>Ends in<span>09:52</span></time><div>3190.01<span>Rs.</span></div><div>Rs. 10 and<b>Rs. 20</b></div>'
            '<p>Read our <a href="/t">full terms</a></p><div><time>Closes in<b>01:02</b></time></div><div>Remaining time<b>00:10</b></div><div>Text<p>block child</p></div>')
    df = G.propose_groups(page_candidates(page(body)))
    got = sorted((r.text, r.type, list(r.fragments)) for r in df.collect())
    assert got == [
        ("3190.01 Rs.", "currency_amount", ["3190.01", "Rs."]), ("Closes in 01:02", "timer_label_value", ["Closes in", "01:02"]),
        ("Ends in 09:52", "timer_label_value", ["Ends in", "09:52"]), ("Remaining time 00:10", "other", ["Remaining time", "00:10"]),
        ("Rs. 10 and Rs. 20", "price_comparison", ["Rs. 10 and", "Rs. 20"])]


def test_neighbour_context(page):
    df = page_candidates(page("<div><p>aaa one</p><p>bbb two</p></div><p>ccc three</p><p>ddd four</p>"))
    out = G.neighbour_context(df.filter("text = 'aaa one'"), df).first()
    assert [c.text for c in out.context] == ["bbb two", "ccc three", "ddd four"]
    few = G.neighbour_context(df.filter("text = 'aaa one'"), df, take=2).first()
    assert [c.text for c in few.context] == ["bbb two", "ccc three"]


def test_resolve_snapshot(page):
    from uipatterns.functions.ids import occurrence_id

    old = page_candidates(page("<p>first</p><div><b>moved text</b></div><p>twice</p><i>gone</i>"))
    found = old.select("page_id", "cand_id", "tag", "text", "selector")
    later = page("<p>first</p><section><em>x</em><b>moved text</b></section><h1>t</h1><h2><p>twice</p><p>twice</p></h2>")
    nodes = N.explode_nodes(later, text_content=True, candidate_texts=True).withColumn("selector", N.stable_selector()).withColumn(
        "cand_id", occurrence_id(F.col("lang"), F.col("selector"), F.col("text")))
    out = G.resolve_snapshot(found, nodes).join(found.select("cand_id", "text"), "cand_id")
    assert {r.text: r.outcome for r in out.collect()} == {
        "first": "selector", "moved text": "reresolved", "twice": "ambiguous", "gone": "not-found"}


def test_fitting_nodes_against_containment(spark):
    """Texts that lie in and across each other, repeated findings, rows without a text; compared with a test of every pair."""
    import random

    rng = random.Random(5)
    words = ["ab", "abc", "bca", "ca b", "नेपाल", "😀a", "a"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    asked = [(p, f"c{p}_{i}", rng.choice(["b", "p", None]), text(rng.randint(1, 3))) for p in range(6) for i in range(30)]
    asked += asked[:20] + [(1, "none", "p", None), (None, "lost", "p", "ab"), (9, "alone", "p", "ab")]
    nodes = [(p, n, rng.choice(["b", "p", "i"]), text(rng.randint(0, 6))) for p in range(8) for n in range(25)] + [(1, 99, "p", None), (None, 1, "p", "ab")]
    got = G._fitting_nodes(spark.createDataFrame(asked, "page_id long, cand_id string, tag string, target string"),
                           spark.createDataFrame(nodes, "page_id long, node_no int, tag string, content string")).collect()
    want = {}
    for page, cand, tag, target in set(asked):
        fits = sorted(n for p, n, t, content in nodes if p is not None and p == page and t == tag and None not in (tag, target, content) and target in content)
        if fits:
            want[page, cand] = (min(len(fits), 2), fits[0])
    assert len(got) == len(want) > 50 and {(r.page_id, r.cand_id): (r.matches, r.node_no) for r in got} == want
    assert {m for m, _ in want.values()} == {1, 2}
