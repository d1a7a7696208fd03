"""Registered queries: sources, extraction, roles, fields, groups, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from uipatterns.catalog import inputs as I
from uipatterns.catalog.registry import any_hit, collapse_sql, hit, query, re2
from uipatterns.functions import ids, text as X
from uipatterns.operators import candidates as C
from uipatterns.operators import fields as FD
from uipatterns.operators import groups as G
from uipatterns.operators import nodes as N
from uipatterns.operators import roles as RO
from uipatterns.session import cut_lineage

_SCHEME_HOST = r"^[a-z]+://(?:[^@/?#]*@)?([^:/?#]+)"
# Pages without comments, scripts and styles; the last form also without their head.
_BARE = r"regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(<(?:script|style)[^>]*>).*?</(?:script|style)>', '\1', 'gs')"
_TAGS = f"SELECT page_id, unnest(regexp_extract_all({_BARE}, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages"
_BODY_ONLY = "regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<head.*?</head>', '', 's'), '<(?:script|style).*?</(?:script|style)>', '', 'gs')"
_KEPT = f"SELECT page_id, unnest(regexp_extract_all({_BODY_ONLY}, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages"


@query("s04_host_of", f"SELECT page_id, coalesce(nullif(lower(regexp_extract(url, '{_SCHEME_HOST}', 1)), ''), url) AS host FROM pages")
def s04(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", X.host_of(F.col("url")).alias("host"))


@query("s05_url_trim", "SELECT page_id, split_part(url, '?', 1) AS no_query, split_part(url, '#', 1) AS no_fragment FROM pages")
def s05(spark, sf):
    return I.table(spark, sf, "pages").select(
        "page_id", X.url_no_query(F.col("url")).alias("no_query"), X.strip_fragment(F.col("url")).alias("no_fragment"))


@query("s07_safe_segment",
       "SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(url, '[^a-zA-Z0-9._-]', '-', 'g'), '-.'), 1, 100), ''), 'unknown') AS segment FROM pages")
def s07(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", X.safe_segment(F.col("url")).alias("segment"))


@query("x01_explode_nodes", f"SELECT page_id, tag, count(*) AS n FROM ({_TAGS}) GROUP BY ALL")
def x01(spark, sf):
    return N.explode_nodes(I.pages(spark, sf)).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


_OPEN, _END = '<template shadowrootmode="open">', "</template>"
_SCOPES = [
    f"<div>{_OPEN}<p>#</p>{_END}</div>", '<iframe srcdoc="&lt;body&gt;&lt;p&gt;#&lt;/p&gt;&lt;b&gt;-&lt;/b&gt;&lt;/body&gt;"></iframe>',
    f"<div hidden>{_OPEN}<p>#</p>{_END}</div>", f"<div>{_OPEN.replace('open', 'closed')}<p>#</p>{_END}</div>",
    f"<div>{_OPEN}<my-card>{_OPEN}<i><b>#</b></i>{_END}</my-card>{_END}</div>", f"<b>{_OPEN}<p>#</p>{_END}</b>",
    '<iframe sandbox srcdoc="<p>#</p>"></iframe>', f"<div>{_OPEN}<s>-</s><s>#</s>{_END}<p>#</p></div>"]


@query("x01_scopes",
       """SELECT page_id, scope_no::INT AS scope_no, selector, text FROM (
          SELECT p_partkey // 32 AS page_id, p_partkey % 8 AS form, p_name || ' no ' || p_partkey AS text,
          p_partkey % 32 + 1 AS k,
          sum(CASE p_partkey % 8 WHEN 4 THEN 2 WHEN 3 THEN 0 WHEN 5 THEN 0 WHEN 6 THEN 0 ELSE 1 END) OVER (PARTITION BY p_partkey // 32 ORDER BY p_partkey) AS n,
          count(*) OVER (PARTITION BY p_partkey // 32) AS items FROM part) JOIN (VALUES
          (0, 1, 'p'), (1, 1, 'body > p'), (4, 1, 'i > b'), (7, 1, 's:nth-of-type(2)'), (7, 0, '')) f(form, inner_scope, own) USING (form),
          LATERAL (SELECT CASE inner_scope WHEN 1 THEN n ELSE 0 END AS scope_no,
          CASE inner_scope WHEN 1 THEN own ELSE 'html > body > ul > li' || CASE WHEN items > 1 THEN ':nth-of-type(' || k || ')' ELSE '' END || ' > div > p' END AS selector)""")
def x01_scopes(spark, sf):
    return C.page_candidates(I.part_pages(spark, sf, _SCOPES)).select("page_id", "scope_no", "selector", "text")


@query("x02_prune", f"SELECT page_id, tag, count(*) AS n FROM ({_KEPT}) GROUP BY ALL")
def x02(spark, sf):
    return N.prune(N.explode_nodes(I.pages(spark, sf))).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("x03_own_text", f"SELECT doc_id, md5({collapse_sql('array_to_string(string_split(text, chr(10)), chr(32))')}) AS text_md5 FROM documents")
def x03(spark, sf):
    return I.documents(spark, sf).select("doc_id", F.md5(X.own_text(F.split("text", "\n"))).alias("text_md5"))


@query("x04_leaf_text", f"SELECT p_partkey // 32 AS page_id, {collapse_sql('text')} AS leaf_text FROM microcopy", I.SQL_MICROCOPY)
def x04(spark, sf):
    nodes = N.prune(N.explode_nodes(I.shop_pages(spark, sf)))
    return nodes.filter("tag = 'div' and leaf_text is not null").select("page_id", "leaf_text")


@query("x05_collapse_self_dup",
       """SELECT page_id, n, CASE WHEN length(d) % 2 = 0 AND length(d) // 2 >= 4 AND left(d, length(d) // 2) = right(d, length(d) // 2)
          THEN left(d, length(d) // 2) ELSE d END AS text
          FROM (SELECT page_id, n, CASE WHEN n % 2 = 0 THEN text || text ELSE text END AS d FROM chunks)""", I.SQL_CHUNKS)
def x05(spark, sf):
    d = F.when(F.col("n") % 2 == 0, F.concat("text", "text")).otherwise(F.col("text"))
    return I.chunks(spark, sf).select("page_id", "n", X.collapse_self_dup(d).alias("text"))


@query("x06_text_gate",
       """SELECT page_id, n, piece_no, piece, length(piece) BETWEEN 3 AND 200 AND NOT regexp_full_match(piece, '[0-9]+') AS ok FROM (
          SELECT page_id, n, generate_subscripts(string_split(text, ' '), 1) AS piece_no, unnest(string_split(text, ' ')) AS piece FROM chunks)""",
       I.SQL_CHUNKS)
def x06(spark, sf):
    rows = I.chunks(spark, sf).select("page_id", "n", F.posexplode(F.split("text", " ")).alias("p", "piece"))
    return rows.select("page_id", "n", (F.col("p") + 1).cast("bigint").alias("piece_no"), "piece", X.text_gate(F.col("piece")).alias("ok"))


@query("x07_visible_only", f"SELECT page_id, count(*) AS n FROM ({_TAGS}) GROUP BY ALL")
def x07(spark, sf):
    return N.visible_only(N.explode_nodes(I.pages(spark, sf))).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("x08_drop_sticky_chrome", f"SELECT page_id, count(*) AS n FROM ({_TAGS}) GROUP BY ALL")
def x08(spark, sf):
    return N.drop_sticky_chrome(N.explode_nodes(I.pages(spark, sf))).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


def _lum(r, g, b):
    lin = lambda c: f"(CASE WHEN {c}/255.0::DOUBLE <= 0.03928 THEN {c}/255.0::DOUBLE/12.92 ELSE pow(({c}/255.0::DOUBLE+0.055)/1.055, 2.4) END)"
    return f"(0.2126*{lin(r)}+0.7152*{lin(g)}+0.0722*{lin(b)})"


@query("x09_contrast_ratio",
       f"""SELECT p_partkey, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 6) AS contrast FROM (
           SELECT p_partkey, {_lum('(p_partkey % 256)', '(p_size * 5 % 256)', '(p_partkey * 7 % 256)')} AS a,
           {_lum('(p_partkey * 3 % 256)', '(p_size * 11 % 256)', '(p_partkey * 13 % 256)')} AS b FROM part)""")
def x09(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    fg, bg = F.array(k % 256, s * 5 % 256, k * 7 % 256), F.array(k * 3 % 256, s * 11 % 256, k * 13 % 256)
    return I.table(spark, sf, "part").select("p_partkey", F.round(X.contrast_ratio(fg, bg), 6).alias("contrast"))


@query("x10_page_lang",
       """SELECT page_id, CASE WHEN l IN ('fr', 'de', 'es') THEN l ELSE 'en' END AS lang FROM (
          SELECT page_id, lower(left(regexp_extract(html, '<html[^>]*?\\slang="([A-Za-z-]+)"', 1), 2)) AS l FROM pages)""")
def x10(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", X.page_lang(F.col("html"), ("fr", "de", "es")).alias("lang"))


_STEP_URL = "'https://shop.example/' || CASE event_type WHEN 'purchase' THEN 'Checkout' WHEN 'signup' THEN 'bag' WHEN 'error' THEN 'pay' ELSE 'item' END || '/' || event_id"


@query("x11_infer_step",
       f"""SELECT event_id, CASE WHEN regexp_matches(lower(p), 'checkout|payment|pay\\b') THEN 'payment'
           WHEN regexp_matches(lower(p), 'cart|bag') THEN 'cart' ELSE 'product' END AS step
           FROM (SELECT event_id, regexp_extract({_STEP_URL}, '^[a-z]+://[^/]+([^?#]*)', 1) AS p FROM events)""")
def x11(spark, sf):
    name = F.when(F.col("event_type") == "purchase", "Checkout").when(F.col("event_type") == "signup", "bag").when(
        F.col("event_type") == "error", "pay").otherwise("item")
    url = F.concat(F.lit("https://shop.example/"), name, F.lit("/"), F.col("event_id").cast("string"))
    return I.table(spark, sf, "events").select("event_id", X.infer_step(url).alias("step"))


@query("x12_stable_selector",
       """SELECT page_id, 'html > body > ul > li' || CASE WHEN n > 1 THEN ':nth-of-type(' || k || ')' ELSE '' END || ' > ' || t AS selector FROM (
          SELECT p_partkey // 32 AS page_id, p_partkey % 32 + 1 AS k, count(*) OVER (PARTITION BY p_partkey // 32) AS n FROM part)
          CROSS JOIN (VALUES ('s'), ('div > span'), ('time > span'), ('a > b')) v(t)""")
def x12(spark, sf):
    return N.explode_nodes(I.shop_pages(spark, sf)).filter("tag in ('s', 'span', 'b')").select("page_id", N.stable_selector().alias("selector"))


_HIDING = [
    '<p style="display: none"><b>#</b></p>', '<p hidden><b>#</b></p>', '<p style="visibility:hidden"><b style="visibility:visible">#</b></p>',
    '<p style="visibility: hidden"><b>#</b></p>', '<p style="opacity:0"><b>#</b></p>', '<p><b>#</b></p>',
    '<p style="display:none"><b style="position:fixed">#</b></p>']


@query("x07_visible_styled",
       """SELECT p_partkey // 32 AS page_id, count(*) FILTER (p_partkey % 7 = 5) AS p, count(*) FILTER (p_partkey % 7 IN (2, 4, 5, 6)) AS b
          FROM part GROUP BY 1""")
def x07_styled(spark, sf):
    shown = N.visible_only(N.explode_nodes(I.part_pages(spark, sf, _HIDING)))
    return shown.groupBy("page_id").agg(F.count_if(F.col("tag") == "p").alias("p"), F.count_if(F.col("tag") == "b").alias("b"))


_BARS = [
    '<nav style="position:fixed"><b>#</b></nav>', '<div class="site-header" style="position: sticky"><b>#</b></div>',
    '<div style="position:fixed"><b>#</b></div>', '<nav><b>#</b></nav>', '<div role="banner" style="position:fixed"><i><b>#</b></i></div>',
    '<div id="topbar" style="position:sticky"><b>#</b></div>', '<div id="subtopbars" style="position:sticky"><b>#</b></div>']


@query("x08_sticky_bars", "SELECT p_partkey // 32 AS page_id, count(*) FILTER (p_partkey % 7 IN (2, 3, 6)) AS b FROM part GROUP BY 1")
def x08_bars(spark, sf):
    rest = N.drop_sticky_chrome(N.explode_nodes(I.part_pages(spark, sf, _BARS)))
    return rest.groupBy("page_id").agg(F.count_if(F.col("tag") == "b").alias("b"))


_PLAYERS = [
    '<div class="plyr"><b>#</b></div>', '<p><video src="#"></video></p><b>#</b>', '<div id="x vjs-tech"><b>#</b></div>',
    '<div class="plyrs"><b>#</b></div>', '<b>#</b>', '<div class="Media-Player"><p></p><i><b>#</b></i></div>']


@query("f04_video_cards", "SELECT p_partkey // 32 AS page_id, count(*) AS n, count(*) FILTER (p_partkey % 6 IN (0, 1, 2, 5)) AS in_video FROM part GROUP BY 1")
def f04_cards(spark, sf):
    nodes = N.explode_nodes(I.part_pages(spark, sf, _PLAYERS, depth=5)).withColumn("v", N.in_video_player()).filter("tag = 'b'")
    return nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("v").alias("in_video"))


@query("x13_guess_lang", "SELECT row_id, CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'dev' ELSE 'en' END AS lang FROM microcopy", I.SQL_MICROCOPY)
def x13(spark, sf):
    return I.microcopy(spark, sf).select("row_id", X.guess_lang(F.col("text")).alias("lang"))


@query("x14_dedupe_occurrences",
       "SELECT page_id, min(n) AS node_no, sha1('en' || chr(0) || tag || chr(0) || text) AS cand_id FROM chunks GROUP BY page_id, cand_id", I.SQL_CHUNKS)
def x14(spark, sf):
    rows = I.chunks(spark, sf).select("page_id", F.col("n").alias("node_no"),
                                      ids.occurrence_id(F.lit("en"), F.col("tag"), F.col("text")).alias("cand_id"))
    return C.dedupe_occurrences(rows)


# Texts whose card shows them in a wrapper and a span: the span alone must stay.
_SHOWN = "SELECT p_partkey // 32 AS page_id, text, count(*) AS n FROM microcopy GROUP BY ALL"


@query("x15_collapse_nested",
       f"""SELECT page_id, text, n, 'span' AS tags FROM ({_SHOWN})""", I.SQL_MICROCOPY)
def x15(spark, sf):
    cands = C.extract_candidates(N.explode_nodes(I.shop_pages(spark, sf), candidates_only=True))
    kept = C.collapse_nested(C.dedupe_occurrences(cands))
    shown = I.microcopy(spark, sf).select(F.floor(F.col("p_partkey") / 32).alias("page_id"), "text").distinct()
    return kept.join(shown, ["page_id", "text"], "left_semi").groupBy("page_id", "text").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


@query("x16_cap_per_page", "SELECT page_id, n, tag, text FROM chunks QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n) <= 12", I.SQL_CHUNKS)
def x16(spark, sf):
    return C.cap_per_page(I.chunks(spark, sf), 12, "n")


def _word_sql(kind):
    w = RO.WORDS[kind]
    when = " ".join(f"WHEN lang = '{g}' THEN {hit('lower(text)', RO.keyword_pattern(w[g]))}" for g in ("hi", "ne"))
    return f"CASE {when} ELSE {hit('lower(text)', RO.keyword_pattern(w['en']))} END"


@query("f01_matches_any",
       f"SELECT row_id, {_word_sql('decline')} AS decline, {_word_sql('cta')} AS cta, {_word_sql('support')} AS support FROM microcopy", I.SQL_MICROCOPY)
def f01(spark, sf):
    m = lambda k: RO.matches_any(F.lower("text"), F.col("lang"), k).alias(k)
    return I.microcopy(spark, sf).select("row_id", m("decline"), m("cta"), m("support"))


ROLE_SQL = f"""CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' WHEN tag = 'label' THEN 'label'
  WHEN {hit('cls', RO.MODAL)} THEN 'modal_text' WHEN {_word_sql('support')} THEN 'support_link'
  WHEN {_word_sql('decline')} THEN 'decline' WHEN {_word_sql('cta')} THEN 'cta' WHEN {hit('cls', RO.FINE_PRINT)} THEN 'fine_print'
  WHEN {hit('cls', RO.TIMER)} THEN 'timer' WHEN {hit('cls', RO.STOCK)} THEN 'stock' WHEN {hit('cls', RO.LINE_ITEM)} THEN 'line_item'
  WHEN {hit('cls', RO.TOAST)} THEN 'toast' WHEN {hit('cls', RO.HELP)} THEN 'help_text' WHEN {hit('cls', RO.BADGE)} THEN 'badge'
  WHEN {hit('lower(text)', RO.DISCOUNT_TEXT)} OR {hit('cls', RO.PROMO)} THEN 'promo' WHEN {hit('cls', RO.BANNER)} THEN 'banner' ELSE 'body' END"""


@query("f02_infer_role", f"SELECT row_id, {ROLE_SQL} AS role FROM (SELECT *, replace(role, '_', '-') || ' ' AS cls FROM microcopy)", I.SQL_MICROCOPY)
def f02(spark, sf):
    attrs = F.create_map(F.lit("class"), F.translate("role", "_", "-"))
    return I.microcopy(spark, sf).select("row_id", RO.infer_role(F.col("text"), F.col("tag"), F.col("lang"), attrs).alias("role"))


@query("f02_unknown_roles", "SELECT p_type AS role, count(*) AS n FROM part GROUP BY 1")
def f02u(spark, sf):
    rows = I.microcopy(spark, sf).select("role").unionByName(I.table(spark, sf, "part").select(F.col("p_type").alias("role")))
    return RO.unknown_roles(rows)


_NAMES = ["next slide carousel", "previous page", "filter", "expand all", "close", "quantity", "menu", "buy", "sorting", "nextpage", "slide", "Gallery next"]
_LIST = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
_EITHER = [RO.CAROUSEL, RO.PAGINATION, RO.FILTER_SORT, RO.EXPAND, RO.QUANTITY]


@query("f03_is_generic_control",
       f"""SELECT p_partkey, p_size = 1 OR {any_hit('lower(name)', _EITHER)} OR {any_hit('cls', _EITHER)} OR {hit('trim(lower(name))', RO.CLOSE)}
           OR {hit('cls', RO.MENU)} AS generic FROM (SELECT p_partkey, p_size, {_LIST}[p_partkey % 12 + 1] AS name,
           {_LIST}[p_size % 12 + 1] || ' ' AS cls FROM part)""")
def f03(spark, sf):
    names = F.array(*[F.lit(n) for n in _NAMES])
    name, cls = F.get(names, (F.col("p_partkey") % 12).cast("int")), F.get(names, (F.col("p_size") % 12).cast("int"))
    flag = F.when(F.col("p_size") == 1, F.lit("aria-expanded")).otherwise(F.lit("data-x"))
    attrs = F.create_map(F.lit("aria-label"), name, F.lit("class"), cls, flag, F.lit("1"))
    return I.table(spark, sf, "part").select("p_partkey", RO.is_generic_control(attrs, F.lower(name)).alias("generic"))


@query("f04_in_video_player", f"SELECT page_id, count(*) AS n, 0 AS in_video FROM ({_TAGS}) GROUP BY page_id")
def f04(spark, sf):
    nodes = N.explode_nodes(I.pages(spark, sf)).withColumn("v", N.in_video_player())
    return nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("v").alias("in_video"))


_PERSONAL_SQL = any_hit("text", [FD.EMAIL, FD.PAYMENT_CARD, FD.LONG_NUMBER], "c")


def _prose_sql(role):
    exempt = ", ".join(f"'{r}'" for r in FD.PROSE_EXEMPT)
    words = f"len(string_split({collapse_sql('text')}, ' '))"
    ends = f"len(regexp_extract_all(text, '{re2(FD.SENTENCE_END)}'))"
    return f"({role} NOT IN ({exempt}) AND ({words} >= 25 OR ({ends} >= 2 AND {words} >= 8)))"


FIELD_SQL = f"""CASE WHEN {_PERSONAL_SQL} THEN 'personal' WHEN regexp_matches(tag, '^h[1-6]$') THEN 'title'
  WHEN {hit('text', FD.DISCOUNT)} THEN 'discount' WHEN {hit('text', FD.RATING)} THEN 'rating' WHEN {hit('text', FD.SOLD)} THEN 'sold_count'
  WHEN {hit('text', FD.STOCK_LEFT)} THEN 'stock' WHEN {hit('text', FD.SHIPPING)} THEN 'shipping'
  WHEN {hit('text', FD.CURRENCY)} THEN CASE WHEN struck THEN 'strike_price' ELSE 'price' END WHEN {_prose_sql('role')} THEN 'prose' ELSE 'unknown' END"""


@query("f05_infer_field", f"SELECT row_id, {FIELD_SQL} AS field FROM (SELECT *, p_size % 2 = 0 AS struck FROM microcopy)", I.SQL_MICROCOPY)
def f05(spark, sf):
    field = FD.infer_field(F.col("text"), F.col("tag"), F.col("role"), F.col("p_size") % 2 == 0)
    return I.microcopy(spark, sf).select("row_id", field.alias("field"))


@query("f06_is_personal", f"SELECT doc_id, {_PERSONAL_SQL} AS personal FROM documents")
def f06(spark, sf):
    return I.documents(spark, sf).select("doc_id", FD.is_personal(F.col("text")).alias("personal"))


@query("f07_is_prose", f"SELECT doc_id, {_prose_sql('role')} AS prose FROM (SELECT doc_id, text, CASE WHEN source = 'src8' THEN 'cta' ELSE 'body' END AS role FROM documents)")
def f07(spark, sf):
    role = F.when(F.col("source") == "src8", "cta").otherwise("body")
    return I.documents(spark, sf).select("doc_id", FD.is_prose(F.col("text"), role).alias("prose"))


@query("f08_is_struck", "SELECT p_partkey // 32 AS page_id, count(*) AS struck FROM part WHERE length('Rs. ' || floor(p_retailprice)) >= 3 GROUP BY ALL")
def f08(spark, sf):
    cands = C.extract_candidates(N.explode_nodes(I.shop_pages(spark, sf), candidate_texts=True))
    return cands.filter("struck").groupBy("page_id").agg(F.count(F.lit(1)).alias("struck"))


@query("f09_card_nodes", "SELECT p_partkey // 32 AS page_id, count(*) AS cards FROM part GROUP BY ALL HAVING count(*) > 1")
def f09(spark, sf):
    nodes = N.prune(N.explode_nodes(I.shop_pages(spark, sf)))
    return nodes.filter("is_card and tag = 'li'").groupBy("page_id").agg(F.count(F.lit(1)).alias("cards"))


_TOK = lambda c: f"list_sort(list_distinct(list_filter(regexp_split_to_array(trim({c}), ' +'), lambda t: t <> '' AND NOT regexp_matches(t, '[0-9]{{3}}'))))"


@query("f10_looks_like_twin",
       f"""SELECT a_key, b_key, CASE WHEN len(a) = 0 AND len(b) = 0 THEN true WHEN least(len(a), len(b)) = 0 THEN false
           ELSE len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) >= 0.5 END AS twin FROM (
           SELECT p.p_partkey AS a_key, q.p_partkey AS b_key, {_TOK("p.p_name || ' ' || p.p_type || ' k' || p.p_partkey")} AS a,
           {_TOK("CASE WHEN q.p_size % 7 = 0 THEN ' x123 ' ELSE q.p_name END")} AS b FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1)""")
def f10(spark, sf):
    p = I.table(spark, sf, "part")
    a = p.select(F.col("p_partkey").alias("a_key"), (F.col("p_partkey") + 1).alias("b_key"), N.class_tokens(
        F.concat_ws(" ", "p_name", "p_type", F.concat(F.lit("k"), F.col("p_partkey").cast("string")))).alias("a"))
    b = p.select(F.col("p_partkey").alias("b_key"), N.class_tokens(
        F.when(F.col("p_size") % 7 == 0, " x123 ").otherwise(F.col("p_name"))).alias("b"))
    return a.join(b, "b_key").select("a_key", "b_key", N.looks_like_twin(F.col("a"), F.col("b")).alias("twin"))


@query("f11_refine_titles",
       """SELECT page_id, node_no, CASE WHEN may AND sells AND rn = 1 THEN 'title' ELSE field END AS field FROM (
          SELECT *, bool_or(field IN ('price', 'strike_price', 'discount', 'rating', 'sold_count')) OVER (PARTITION BY page_id, card_no) AS sells,
          row_number() OVER (PARTITION BY page_id, card_no ORDER BY may DESC, length(text) DESC, node_no) AS rn FROM (
          SELECT *, card_no IS NOT NULL AND field = 'unknown' AND coalesce(link_no >= card_no, false) AS may FROM (
          SELECT p_partkey // 32 AS page_id, p_partkey % 32 + 2 AS node_no, CASE WHEN p_partkey % 32 < 24 THEN 1 END AS card_no,
          CASE WHEN p_size % 2 = 0 THEN 2 END AS link_no, field, text FROM microcopy)))""", I.SQL_MICROCOPY)
def f11(spark, sf):
    k = F.col("p_partkey")
    rows = I.microcopy(spark, sf).select(
        F.floor(k / 32).alias("page_id"), (k % 32 + 2).alias("node_no"), F.when(k % 32 < 24, 1).alias("card_no"),
        F.when(F.col("p_size") % 2 == 0, 2).alias("link_no"), "field", "text")
    return FD.refine_titles(rows).select("page_id", "node_no", "field")


@query("f12_propose_groups",
       """SELECT p_partkey // 32 AS page_id, 'Ends in 09:' || lpad((p_size % 60)::VARCHAR, 2, '0') AS text, 'timer_label_value' AS type,
          2 AS members, true AS reconstructed FROM part""")
def f12(spark, sf):
    cands = C.page_candidates(I.shop_pages(spark, sf)).select(
        "page_id", "node_no", "sub_end", "cand_id", "tag", "text", "run_text", "control_no", "is_animated", "in_video", "block_no")
    groups = G.propose_groups(cands).filter(F.col("type") == "timer_label_value")
    return groups.select("page_id", "text", "type", F.size("member_ids").alias("members"), "reconstructed")


_GROUPS = ['<time>Ends in<span>09:52</span></time>', '<div>3190.01<span>Rs.</span></div>', '<div>Rs. 10 and<b>Rs. 20</b></div>',
           '<div>Remaining time<b>00:10</b></div>', '<div>#</div>']


@query("f12_group_types",
       """SELECT p_partkey // 32 AS page_id, ['timer_label_value', 'currency_amount', 'price_comparison', 'other'][p_partkey % 5 + 1] AS type, count(*) AS n
          FROM part WHERE p_partkey % 5 < 4 GROUP BY ALL""")
def f12_types(spark, sf):
    groups = G.propose_groups(C.page_candidates(I.part_pages(spark, sf, _GROUPS)))
    return groups.groupBy("page_id", "type").agg(F.count(F.lit(1)).alias("n"))


# Items of an earlier snapshot and the same items later, one form per outcome.
_EARLIER = ["<b>(#)</b>"] * 5 + ['<b id="#">(#)</b><b id="#">(#) more</b>']
_LATER = ["<b>(#)</b>", "<b>(#), now</b>", "<p><b>(#)</b></p>", "<p><b>(#)</b></p><p><b>(#)</b></p>", "<b>gone</b>", '<b id="#">(#) more and more</b>']


@query("f15_outcomes",
       """SELECT p_partkey // 32 AS page_id, count(*) FILTER (p_partkey % 6 = 0) AS registry, count(*) FILTER (p_partkey % 6 IN (1, 5)) AS selector,
          count(*) FILTER (p_partkey % 6 = 2) AS reresolved, count(*) FILTER (p_partkey % 6 = 3) AS ambiguous,
          count(*) FILTER (p_partkey % 6 IN (4, 5)) AS not_found, count(*) FILTER (p_partkey % 6 = 5) AS claimed FROM part GROUP BY 1""")
def f15_outcomes(spark, sf):
    found = C.page_candidates(I.part_pages(spark, sf, _EARLIER)).select("page_id", "cand_id", "tag", "text", "selector")
    nodes = N.prune(N.explode_nodes(I.part_pages(spark, sf, _LATER), text_content=True, candidate_texts=True))
    nodes = nodes.withColumn("selector", N.stable_selector()).withColumn("cand_id", ids.occurrence_id(F.col("lang"), F.col("selector"), F.col("text")))
    out = G.resolve_snapshot(cut_lineage(found), cut_lineage(nodes.select("page_id", "node_no", "cand_id", "tag", "selector", "text_content")))
    return out.groupBy("page_id").agg(*[F.count_if(F.col("outcome") == o).alias(o.replace("-", "_")) for o in (
        "registry", "selector", "reresolved", "ambiguous", "not-found", "claimed")])


@query("f13_churn_key", "SELECT row_id, 'p' || template_id || '|' || regexp_replace(text, '[0-9]+', '#', 'g') AS churn FROM microcopy", I.SQL_MICROCOPY)
def f13(spark, sf):
    return I.microcopy(spark, sf).select("row_id", X.churn_key(F.concat(F.lit("p"), F.col("template_id").cast("string")), F.col("text")).alias("churn"))


@query("f14_neighbour_context",
       """SELECT p_partkey // 32 AS page_id, p_name || ' ' || p_type || ' no ' || p_partkey || '|' || text || '|Ends in|09:' || lpad((p_size % 60)::VARCHAR, 2, '0') AS context
          FROM microcopy""", I.SQL_MICROCOPY)
def f14(spark, sf):
    cands = cut_lineage(C.page_candidates(I.shop_pages(spark, sf)))
    near = G.neighbour_context(cands.filter("tag = 's'"), cands)
    return near.select("page_id", F.array_join(F.transform("context", lambda c: c["text"]), "|").alias("context"))


@query("f15_resolve_snapshot",
       """SELECT p_partkey // 32 AS page_id, 'registry' AS outcome, 5 * count(*) AS n FROM part GROUP BY ALL
          UNION ALL SELECT DISTINCT p_partkey // 32, 'selector', 1 FROM part""")
def f15(spark, sf):
    pages = I.shop_pages(spark, sf)
    found = cut_lineage(C.page_candidates(pages).select("page_id", "cand_id", "tag", "text", "selector"))
    # The later snapshot: a line above every list, and another headline.
    later = pages.withColumn("html", F.replace("html", F.lit("<h1>Our offers</h1>"), F.lit("<p>New</p><h1>Our offers today</h1>")))
    nodes = N.prune(N.explode_nodes(later, text_content=True, candidate_texts=True))
    nodes = nodes.withColumn("selector", N.stable_selector()).withColumn(
        "cand_id", ids.occurrence_id(F.col("lang"), F.col("selector"), F.col("text")))
    out = G.resolve_snapshot(found, cut_lineage(nodes.select("page_id", "node_no", "cand_id", "tag", "selector", "text_content")))
    return out.groupBy("page_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("h01_occurrence_id", "SELECT row_id, sha1(lang || chr(0) || tag || chr(0) || text) AS id FROM microcopy", I.SQL_MICROCOPY)
def h01(spark, sf):
    return I.microcopy(spark, sf).select("row_id", ids.occurrence_id(F.col("lang"), F.col("tag"), F.col("text")).alias("id"))


@query("h02_model_key", "SELECT row_id, sha1(lang || chr(0) || tag || chr(0) || role || chr(0) || text) AS id FROM microcopy", I.SQL_MICROCOPY)
def h02(spark, sf):
    return I.microcopy(spark, sf).select("row_id", ids.model_key(F.col("lang"), F.col("tag"), F.col("role"), F.col("text")).alias("id"))


@query("h03_snippet_id", "SELECT doc_id, sha1(lang || chr(0) || text) AS id FROM documents")
def h03(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", ids.snippet_id(F.col("lang"), F.col("text")).alias("id"))


@query("h04_cache_key",
       "SELECT row_id, 'dp:v1.0.0:' || sha1('1.0.0' || chr(0) || 'precision' || chr(0) || lang || chr(0) || tag || chr(0) || role || chr(0) || text) AS id FROM microcopy",
       I.SQL_MICROCOPY)
def h04(spark, sf):
    key = ids.cache_key(F.lit("1.0.0"), F.lit("precision"), *[F.col(c) for c in ("lang", "tag", "role", "text")])
    return I.microcopy(spark, sf).select("row_id", key.alias("id"))


@query("h05_explain_key",
       """SELECT row_id, 'dp:explain:' || sha1('m' || chr(0) || label || chr(0) || lang || chr(0) || tag || chr(0) || role || chr(0) || 'likely' || chr(0) ||
          'model,rule' || chr(0) || 'a_rule,' || step || chr(0) || text || chr(0) || role || ':' || p_name || '|' || role || ':' || p_type) AS id FROM microcopy""",
       I.SQL_MICROCOPY)
def h05(spark, sf):
    ctx = F.array(F.struct("role", F.col("p_name").alias("text")), F.struct("role", F.col("p_type").alias("text")))
    key = ids.explain_key(
        F.lit("m"), F.col("label"), F.col("lang"), F.col("tag"), F.col("role"), F.lit("likely"),
        F.array(F.lit("rule"), F.lit("model")), F.array(F.col("step"), F.lit("a_rule")), F.col("text"), ctx)
    return I.microcopy(spark, sf).select("row_id", key.alias("id"))
