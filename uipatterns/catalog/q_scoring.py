"""Registered queries: rules, scoring, decisions, merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from uipatterns.catalog import inputs as I
from uipatterns.catalog.q_pages import FIELD_SQL, ROLE_SQL
from uipatterns.catalog.registry import any_hit, collapse_sql, hit, query
from uipatterns.operators import rules as R
from uipatterns.operators import scoring as S
from uipatterns.operators.nodes import explode_nodes
from uipatterns.plans import page_scan
from uipatterns.schema import LABEL_DESCRIPTIONS, LABELS
from uipatterns.streaming.cadence import cadence_batch

M = I.SQL_MICROCOPY


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lang_sql(patterns):
    when = " ".join(f"WHEN lang = '{g}' THEN {hit('text', patterns[g])}" for g in ("hi", "ne"))
    return f"(CASE {when} ELSE {hit('text', patterns['en'])} END)"


RULE_SQL = {
    "stock_counter": any_hit("text", R.STOCK_COUNTER),
    "viewer_counter": any_hit("text", R.VIEWER_COUNTER),
    "late_fee": f"(role = 'line_item' AND step = 'payment' AND {_lang_sql(R.LATE_FEE)})",
    "discount_badge": f"(role = 'promo' AND {hit('text', R.DISCOUNT_BADGE)})",
    "forced_action_gate": f"(role IN ('form_gate', 'modal_text') AND {_lang_sql(R.DEPENDENCY)})",
    "recent_activity": any_hit("text", R.RECENT_ACTIVITY),
}
RULE_LABEL = {name: labels[0] for name, labels, _ in R.RULES}
SQL_HITS = "hits AS (" + " UNION ALL ".join(
    f"SELECT row_id, '{n}' AS rule, '{RULE_LABEL[n]}' AS label FROM microcopy WHERE {c}"
    + (f" AND field NOT IN ({', '.join(_q(x) for x in R.DENIED_FIELDS[n])})" if n in R.DENIED_FIELDS else "")
    for n, c in RULE_SQL.items()) + ")"


def _fires(name, rule):
    def run(spark, sf):
        return I.microcopy(spark, sf).select("row_id", rule().alias("fires"))

    query(name, f"SELECT row_id, {RULE_SQL[name.split('_', 1)[1]]} AS fires FROM microcopy", M)(run)


for _name, _rule in (
    ("r01_stock_counter", R.stock_counter), ("r03_viewer_counter", R.viewer_counter), ("r07_late_fee", R.late_fee),
    ("r09_discount_badge", R.discount_badge), ("r10_forced_action_gate", R.forced_action_gate),
    ("r11_recent_activity", R.recent_activity),
):
    _fires(_name, _rule)

# Runs of paced changes, for the other engine: one hour to twelve hours apart.
SQL_RUNS = I.SQL_OBSERVATIONS + """,
o1 AS (SELECT *, regexp_matches(text, '[0-9]') AS digits, lag(text) OVER w AS before, lag(regexp_matches(text, '[0-9]')) OVER w AS bd
  FROM observations WINDOW w AS (PARTITION BY key ORDER BY ts, text)),
o2 AS (SELECT key, ts, text, NOT coalesce(bd, false) AS fresh FROM o1 WHERE digits AND (NOT coalesce(bd, false) OR before <> text)),
o3 AS (SELECT *, NOT fresh AND coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY key ORDER BY ts, text)) BETWEEN 3600000000 AND 43200000000, false) AS tick FROM o2),
o4 AS (SELECT *, sum((NOT tick)::INT) OVER (PARTITION BY key ORDER BY ts, text) AS run FROM o3),
o5 AS (SELECT key, run, count(*) FILTER (WHERE tick) AS ticks FROM o4 GROUP BY ALL),
ends AS (SELECT key, max_by(digits, {'ts': ts, 'text': text}) AS alive FROM o1 GROUP BY key),
runs AS (SELECT e.key, coalesce(max(ticks), 0) AS longest, CASE WHEN alive THEN coalesce(max_by(ticks, run), 0) ELSE 0 END AS current
  FROM ends e LEFT JOIN o5 ON o5.key = e.key GROUP BY e.key, alive)"""


@query("r02_countdown_timer", "SELECT key, longest >= 4 AS fires FROM runs", SQL_RUNS)
def r02(spark, sf):
    ticks = cadence_batch(I.observations(spark, sf), min_ms=3_600_000, max_ms=43_200_000, chunk_seconds=86_400)
    return ticks.select("key", F.col("ever_animated").alias("is_animated")).select("key", R.countdown_timer().alias("fires"))


@query("r04_prechecked_optin",
       f"""SELECT row_id, p_size % 2 = 0 AND regexp_matches(lower(label_text), '{'|'.join(R.CONSENT_WORDS)}') AS fires FROM (
           SELECT *, text || CASE WHEN p_size % 3 = 0 THEN ' by Email' ELSE '' END AS label_text FROM microcopy)""", M)
def r04(spark, sf):
    rows = I.microcopy(spark, sf).withColumns({
        "role": F.lit("checkbox"), "checked": F.col("p_size") % 2 == 0,
        "label_text": F.concat("text", F.when(F.col("p_size") % 3 == 0, " by Email").otherwise(""))})
    return rows.select("row_id", R.prechecked_optin().alias("fires"))


_BOXES = ['<label><input type="checkbox" checked>Send me offers about #</label>', '<label><input type="checkbox">Send me offers about #</label>',
          '<input id="c" type="checkbox" checked aria-label="Join the newsletter on #">', '<input type="checkbox" checked aria-label="I agree to #">', '<b>#</b>']


@query("r04_checked_boxes_of_pages", "SELECT p_partkey // 32 AS page_id, count(*) AS fired FROM part WHERE p_partkey % 5 IN (0, 2) GROUP BY 1")
def r04_pages(spark, sf):
    hits = page_scan.checkbox_hits(I.part_pages(spark, sf, _BOXES))
    return hits.filter(F.exists("rule_hits", lambda h: h["rule"] == "prechecked_optin")).groupBy("page_id").agg(F.count(F.lit(1)).alias("fired"))


_PAIRS = ['<div><div><button>Accept all of #</button><a class="btn">No thanks, #</a></div></div>'] * 2 + ['<div><b>#</b></div>']


@query("r06_areas_of_pages", "SELECT p_partkey // 32 AS page_id, count(*) AS fired FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 4 = 0 GROUP BY 1")
def r06_pages(spark, sf):
    # Measured areas: of every fourth part the accepting button is four times as large.
    pages = I.part_pages(spark, sf, _PAIRS)
    nodes = explode_nodes(pages, candidate_texts=True).filter(F.col("tag").isin("button", "a"))
    number = F.regexp_extract("text", " no ([0-9]+)$", 1).try_cast("int")
    area = F.when((F.col("tag") == "button") & (number % 4 == 0), 400.0).otherwise(100.0)
    hits = page_scan.candidates_with_hits(pages, layout=nodes.select("page_id", "node_no", area.alias("area")))
    return hits.filter(F.exists("rule_hits", lambda h: h["rule"] == "cta_asymmetry")).groupBy("page_id").agg(F.count(F.lit(1)).alias("fired"))


@query("r05_hidden_optout",
       """SELECT row_id, role = 'decline' AND (p_size < 11 OR p_retailprice / 300 < 3.0 OR coalesce(CASE WHEN p_size % 2 = 0 THEN p_size / 50.0 END < 0.6, false)) AS fires
          FROM microcopy""", M)
def r05(spark, sf):
    rows = I.microcopy(spark, sf).withColumns({
        "font_px": F.col("p_size").cast("double"), "contrast": F.col("p_retailprice") / 300,
        "opacity": F.when(F.col("p_size") % 2 == 0, F.col("p_size") / 50.0)})
    return rows.select("row_id", R.hidden_optout().alias("fires"))


@query("r06_cta_asymmetry", "SELECT row_id, role = 'decline' AND p_size > 0 AND p_retailprice / 10 / p_size > 3 AS fires FROM microcopy", M)
def r06(spark, sf):
    rows = I.microcopy(spark, sf).withColumns({"area": F.col("p_size").cast("double"), "accept_area": F.col("p_retailprice") / 10})
    return rows.select("row_id", R.cta_asymmetry().alias("fires"))


@query("r07_late_fee_strict",
       """SELECT DISTINCT session_id, text FROM f WHERE step = 'payment' AND NOT EXISTS
          (SELECT 1 FROM f c WHERE c.step = 'cart' AND c.session_id = f.session_id AND c.text = f.text)""",
       M, f"f AS (SELECT p_size AS session_id, template AS text, step FROM microcopy WHERE role = 'line_item' AND {_lang_sql(R.LATE_FEE)})")
def r07s(spark, sf):
    rows = I.microcopy(spark, sf).withColumn("session_id", F.col("p_size")).withColumn("text", F.col("template"))
    return R.new_fee_lines(rows).select("session_id", "text").distinct()


_HREFS = ["tel:1", "https://other.example/x", "/cancel", "https://shop.example/y", "mailto:a@b.co", "HTTPS://SHOP.example:443/z", "//cdn.example/a", "#top"]


@query("r08_cancel_offsite",
       """SELECT row_id, role = 'decline' AND tag = 'a' AND k IN (0, 1, 4, 6) AS fires FROM (SELECT *, p_size % 8 AS k FROM microcopy)""", M)
def r08(spark, sf):
    href = F.get(F.array(*[F.lit(h) for h in _HREFS]), F.col("p_size") % 8)
    rows = I.microcopy(spark, sf).withColumns({"attrs": F.create_map(F.lit("href"), href), "url": F.lit("https://shop.example/cart")})
    return rows.select("row_id", R.cancel_offsite().alias("fires"))


@query("r12_run_rules", "SELECT row_id, rule, label FROM hits", M, SQL_HITS)
def r12(spark, sf):
    return R.rule_hits_long(R.run_rules(I.microcopy(spark, sf)), ["row_id"])


@query("m01_model_input", "SELECT row_id, '[TAG=' || tag || '] [ROLE=' || role || '] ' || text AS model_input FROM microcopy", M)
def m01(spark, sf):
    return I.microcopy(spark, sf).select("row_id", S.model_input(F.col("text"), F.col("tag"), F.col("role")).alias("model_input"))


@query("m02_norm_tag_role",
       """SELECT p_partkey, coalesce(nullif(lower(trim(t)), ''), 'span') AS tag, coalesce(nullif(replace(replace(lower(trim(r)), '-', '_'), ' ', '_'), ''), 'none') AS role
          FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN ' ' ELSE ' ' || upper(p_type) || ' ' END AS t, CASE WHEN p_size % 7 <> 0 THEN ' ' || p_name || '-X ' END AS r FROM part)""")
def m02(spark, sf):
    t = F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), F.upper("p_type"), F.lit(" ")))
    r = F.when(F.col("p_size") % 7 != 0, F.concat(F.lit(" "), "p_name", F.lit("-X ")))
    return I.table(spark, sf, "part").select("p_partkey", S.norm_tag(t).alias("tag"), S.norm_role(r).alias("role"))


def _candidates(spark, sf):
    return I.microcopy(spark, sf).withColumns({
        "page_id": F.floor(F.col("p_partkey") / 50), "cand_id": F.sha1("text"),
        "selector": F.concat(F.lit("p"), F.col("template_id").cast("string"))})


@query("m03_to_score",
       """SELECT row_id FROM c WHERE field NOT IN ('prose', 'personal') AND NOT EXISTS (SELECT 1 FROM s WHERE s.page_id = c.page_id AND s.cand_id = c.cand_id)
          AND NOT EXISTS (SELECT 1 FROM s WHERE s.page_id = c.page_id AND s.churn = c.churn)""", M,
       """c AS (SELECT *, p_partkey // 50 AS page_id, sha1(text) AS cand_id, 'p' || template_id || '|' || regexp_replace(text, '[0-9]+', '#', 'g') AS churn FROM microcopy),
          s AS (SELECT page_id, cand_id, churn FROM c WHERE lang = 'ne' OR step = 'payment' OR text LIKE 'Only 1%')""")
def m03(spark, sf):
    rows = _candidates(spark, sf)
    seen = rows.filter((F.col("lang") == "ne") | (F.col("step") == "payment") | F.col("text").startswith("Only 1")).withColumn(
        "churn", S.churn_key(F.col("selector"), F.col("text")))
    return S.to_score(rows, seen).select("row_id")


def _length_scorer(df):
    return df.withColumn("score", F.least(F.lit(0.999), F.length("model_input") / 100.0))


@query("m04_score_distinct",
       "SELECT row_id, round(least(0.999, length('[TAG=' || tag || '] [ROLE=' || role || '] ' || text) / 100.0), 6) AS score FROM microcopy", M)
def m04(spark, sf):
    rows = I.microcopy(spark, sf).select("row_id", S.model_input(F.col("text"), F.col("tag"), F.col("role")).alias("model_input"))
    out = S.score_distinct(rows, _length_scorer, row_id=["row_id"])
    return out.select("row_id", F.round(F.col("score").cast("double"), 6).alias("score"))


@query("m05_score_incremental",
       """SELECT lang, text, tag, role, lang = 'en' AND step0 <> 'cart' AS cached, CASE WHEN lang = 'en' AND step0 <> 'cart' THEN 'stored' ELSE 'fresh' END AS decision
          FROM (SELECT lang, text, tag, role, min(step) AS step0 FROM microcopy GROUP BY ALL)""", M)
def m05(spark, sf):
    rows = I.microcopy(spark, sf)
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    firsts = rows.groupBy("lang", "tag", "role", "text").agg(F.min("step").alias("step0"))
    # English answers are stored; those first seen at the cart are too old to use.
    old = F.lit("2024-05-01 00:00:00").cast("timestamp")
    stored = firsts.filter("lang = 'en'").select(
        S.cache_key(F.lit("1.0.0"), F.lit("precision"), F.col("lang"), F.col("tag"), F.col("role"), F.col("text")).alias("cache_key"),
        F.lit("1.0.0").alias("model_version"), F.lit("precision").alias("profile"),
        F.when(F.col("step0") == "cart", old).otherwise(now - F.expr("INTERVAL 1 HOUR")).alias("decided_at"), F.lit("stored").alias("decision"))
    out, _ = S.score_incremental(rows, stored, lambda d: d.withColumn("decision", F.lit("fresh")), "1.0.0", "precision", now, 86_400)
    return out.select("lang", "text", "tag", "role", "cached", "decision")


@query("m06_sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value - 20))), 6) AS p FROM events")
def m06(spark, sf):
    return I.table(spark, sf, "events").select("event_id", F.round(S.sigmoid(F.col("value") - 20), 6).alias("p"))


@query("m07_baseline")
def m07(spark, sf):
    from uipatterns.operators.baseline import fit_baseline, score_baseline

    rows = I.microcopy(spark, sf).select(
        "row_id", S.model_input(F.col("text"), F.col("tag"), F.col("role")).alias("model_input"),
        *[(F.col("label") == n).cast("int").alias(f"y_{n}") for n in LABELS])
    return score_baseline(fit_baseline(rows), rows).select("row_id", "probs")


@query("m07_vocabulary",
       """SELECT gram, round(ln((1 + (SELECT count(*) FROM microcopy)) / (1.0 + count(DISTINCT row_id))) + 1, 6) AS idf FROM (
          SELECT row_id, substr(w, i, n) AS gram FROM words CROSS JOIN range(2, 6) a(n), unnest(range(1, greatest(length(w) - n + 1, 1) + 1)) b(i) WHERE length(w) >= n OR n = 2)
          GROUP BY gram HAVING count(DISTINCT row_id) >= 2""", M,
       "words AS (SELECT row_id, ' ' || unnest(string_split('[TAG=' || tag || '] [ROLE=' || role || '] ' || text, ' ')) || ' ' AS w FROM microcopy)")
def m07v(spark, sf):
    from uipatterns.operators.baseline import fit_vocabulary

    rows = I.microcopy(spark, sf).select("row_id", S.model_input(F.col("text"), F.col("tag"), F.col("role")).alias("model_input"))
    return fit_vocabulary(rows).select("gram", F.round("idf", 6).alias("idf"))


def _word_model():
    return lambda texts: [[len(t) / 1000.0, float("left" in t)] for t in texts]


@query("m08_score_with", "SELECT row_id, round(length(text) / 1000.0, 6) AS p0, CASE WHEN contains(text, 'left') THEN 1.0 ELSE 0.0 END AS p1 FROM microcopy", M)
def m08(spark, sf):
    out = S.score_with(I.microcopy(spark, sf).select("row_id", "text"), _word_model, "text")
    return out.select("row_id", F.round(F.col("probs")[0], 6).alias("p0"), F.col("probs")[1].alias("p1"))


THRESHOLDS = {name: round(0.2 + 0.08 * i, 2) for i, name in enumerate(LABELS)}


def _probs(rows):
    k = F.col("row_id")
    return rows.withColumn("probs", F.array(*[((k * (7 + 4 * i) + i * 131) % 1000) / 1000.0 for i in range(len(LABELS))]))


SQL_PROBS = "probs AS (" + " UNION ALL ".join(
    f"SELECT row_id, '{n}' AS label, {i} AS pos, ((row_id * {7 + 4 * i} + {i * 131}) % 1000) / 1000.0::DOUBLE AS score, {THRESHOLDS[n]}::DOUBLE AS threshold FROM microcopy"
    for i, n in enumerate(LABELS)) + ")"


@query("m09_decide",
       """SELECT row_id, coalesce(string_agg(label, ',' ORDER BY score DESC, pos) FILTER (WHERE score >= threshold AND label <> 'benign'), '') AS labels,
          round(coalesce(max(score) FILTER (WHERE score >= threshold AND label <> 'benign'), 0), 6) AS top,
          count(*) FILTER (WHERE score >= threshold AND label <> 'benign') = 0 AS benign,
          round(max(score) FILTER (WHERE label = 'benign'), 6) AS benign_score FROM probs GROUP BY row_id""", M, SQL_PROBS)
def m09(spark, sf):
    out = S.decide(_probs(I.microcopy(spark, sf)), THRESHOLDS)
    return out.select(
        "row_id", F.array_join(F.transform("findings", lambda f: f["label"]), ",").alias("labels"),
        F.round(F.coalesce(F.get("findings", F.lit(0))["score"], F.lit(0.0)), 6).alias("top"), "benign", F.round("benign_score", 6).alias("benign_score"))


_NAMES_SQL = "[" + ", ".join(_q(n) for n in LABELS) + "]"


@query("m10_threshold_problems",
       f"""SELECT n.label, round(t.threshold, 6) AS threshold, CASE WHEN t.threshold IS NULL THEN 'missing or not a number' ELSE 'out of range' END AS problem
           FROM (SELECT unnest({_NAMES_SQL}) AS label) n LEFT JOIN (SELECT {_NAMES_SQL}[p_partkey % 6 + 1] AS label, avg(p_size) / 25 AS threshold FROM part
           GROUP BY ALL) t ON t.label = n.label WHERE t.threshold IS NULL OR NOT (t.threshold > 0 AND t.threshold < 1)""")
def m10(spark, sf):
    k = (F.col("p_partkey") % 6).cast("int")
    table = I.table(spark, sf, "part").groupBy(F.get(F.array(*[F.lit(n) for n in LABELS]), k).alias("label")).agg(
        (F.avg("p_size") / 25).alias("threshold")).withColumn("profile", F.lit("precision"))
    return S.threshold_problems(table, "precision").withColumn("threshold", F.round("threshold", 6))


@query("m11_withhold",
       f"""SELECT row_id, CASE WHEN field = 'title' AND role2 <> 'heading' THEN {_q(S.TITLE_REASON)}
           WHEN role2 = 'support_link' AND NOT {hit('text', S.CANCEL_INTENT)} THEN {_q(S.SUPPORT_REASON)} END AS reason
           FROM (SELECT *, CASE WHEN role = 'decline' OR p_size % 2 = 0 THEN 'support_link' ELSE role END AS role2 FROM microcopy)""", M)
def m11(spark, sf):
    rows = I.microcopy(spark, sf).withColumns({
        "label": F.lit("obstruction"), "role": F.when((F.col("role") == "decline") | (F.col("p_size") % 2 == 0), "support_link").otherwise(F.col("role"))})
    shown, kept = S.withhold(rows)
    return shown.select("row_id", F.lit(None).cast("string").alias("reason")).unionByName(kept.select("row_id", "reason"))


def _model(spark, sf):
    return I.microcopy(spark, sf).filter(F.col("label") != "benign").select(
        "row_id", "label", ((F.col("row_id") % 97) / 100.0).alias("score"), F.lit(0.3).alias("threshold")).filter("score >= threshold")


SQL_MERGED = """model AS (SELECT row_id, label, (row_id % 97) / 100.0::DOUBLE AS score, 0.3::DOUBLE AS threshold FROM microcopy
  WHERE label <> 'benign' AND (row_id % 97) / 100.0::DOUBLE >= 0.3::DOUBLE),
merged AS (SELECT coalesce(h.row_id, m.row_id) AS row_id, coalesce(h.label, m.label) AS label, coalesce(score, 1.0) AS score, coalesce(threshold, 0.0) AS threshold,
  CASE WHEN h.label IS NOT NULL THEN 'likely' ELSE 'possible' END AS confidence,
  CASE WHEN h.label IS NULL THEN 'model' WHEN m.label IS NULL THEN 'rule' ELSE 'rule,model' END AS source, h.rule AS rule, m.label AS m_label
  FROM (SELECT row_id, label, min(rule) AS rule FROM hits GROUP BY ALL) h FULL JOIN model m ON h.row_id = m.row_id AND h.label = m.label)"""


def _merged(spark, sf):
    hits = R.rule_hits_long(R.run_rules(I.microcopy(spark, sf)), ["row_id"])
    return S.merge_findings(hits, _model(spark, sf), ["row_id"])


@query("m12_merge_findings", "SELECT row_id, label, round(score, 6) AS score, round(threshold, 6) AS threshold, confidence, source FROM merged", M, SQL_HITS, SQL_MERGED)
def m12(spark, sf):
    return _merged(spark, sf).select("row_id", "label", F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"), "confidence",
                                     F.array_join("source", ",").alias("source"))


_DESC = "CASE " + " ".join(f"WHEN label = {_q(k)} THEN {_q(v)}" for k, v in LABEL_DESCRIPTIONS.items()) + " END"
_RDESC = "CASE " + " ".join(f"WHEN rule = {_q(k)} THEN {_q(v)}" for k, v in S.RULE_DESCRIPTIONS.items()) + f" ELSE {_DESC} END"


@query("m13_describe", f"SELECT row_id, rule, {_RDESC} AS description FROM hits", M, SQL_HITS)
def m13(spark, sf):
    hits = R.rule_hits_long(R.run_rules(I.microcopy(spark, sf)), ["row_id"])
    return hits.select("row_id", "rule", S.describe(F.col("rule"), F.col("label")).alias("description"))


_SCORE_SQL = """SELECT p.page_id, floor(least(1.0, coalesce(pts, 0) / 20.0) * 100 + 0.5)::INT AS page_score FROM (SELECT DISTINCT p_partkey // 8 AS page_id FROM part) p
  LEFT JOIN (SELECT row_id // 800 AS page_id, sum(CASE WHEN confidence = 'likely' THEN 2 ELSE 1 END) AS pts FROM merged GROUP BY ALL) f ON f.page_id = p.page_id"""


@query("m14_page_score", _SCORE_SQL, M, SQL_HITS, SQL_MERGED)
def m14(spark, sf):
    pages = I.table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 8).alias("page_id")).distinct()
    return S.page_score(_merged(spark, sf).withColumn("page_id", F.floor(F.col("row_id") / 800)), pages).select("page_id", "page_score")


@query("m15_score_band", f"SELECT page_id, CASE WHEN page_score < 30 THEN 'low' WHEN page_score < 65 THEN 'medium' ELSE 'high' END AS band FROM ({_SCORE_SQL})", M, SQL_HITS, SQL_MERGED)
def m15(spark, sf):
    return m14(spark, sf).select("page_id", S.score_band(F.col("page_score")).alias("band"))


@query("m16_validate_snippets",
       f"""SELECT doc_id, CASE WHEN text = '' THEN 'empty text' WHEN length(text) > 2000 THEN 'text too long' WHEN {collapse_sql('text')} = '' THEN 'blank text'
           WHEN lang NOT IN ('en', 'hi', 'ne') THEN 'unknown language' END AS reason FROM documents""")
def m16(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "text", "lang", F.lit("P").alias("tag"), F.lit("fine print").alias("role"), F.lit(None).cast("string").alias("ref"))
    good, bad = S.validate_snippets(docs)
    return good.select("doc_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("doc_id", "reason"))


# The listing pages again: each text stands in a span inside a div whose class names a role.
SQL_LISTED = f"""listed0 AS (SELECT p_partkey // 32 AS page_id, row_id, text, 'en' AS lang, 'payment' AS step, 'span' AS tag, false AS struck, 'body' AS role, role AS of_div FROM microcopy),
listed1 AS (SELECT *, {FIELD_SQL} AS field FROM listed0),
listed2 AS (SELECT * EXCLUDE (cls), {ROLE_SQL} AS by_text FROM (SELECT *, ' ' AS cls FROM listed1)),
listed3 AS (SELECT * EXCLUDE (cls), {ROLE_SQL} AS by_class FROM (SELECT *, replace(of_div, '_', '-') || ' ' AS cls FROM listed2)),
listed AS (SELECT page_id, row_id, text, lang, step, field, CASE WHEN by_text = 'body' THEN by_class ELSE by_text END AS role FROM listed3),
listed_hits AS (""" + " UNION ".join(
    f"SELECT row_id, page_id, '{RULE_LABEL[n]}' AS label FROM listed WHERE {c}"
    + (f" AND field NOT IN ({', '.join(_q(x) for x in R.DENIED_FIELDS[n])})" if n in R.DENIED_FIELDS else "")
    for n, c in RULE_SQL.items()) + ")"


@query("page_report_listings",
       """SELECT p.page_id, 5 * cards + 1 AS candidates, coalesce(f, 0) AS findings, floor(least(1.0, coalesce(f, 0) * 2 / 20.0) * 100 + 0.5)::INT AS page_score FROM (
          SELECT p_partkey // 32 AS page_id, count(*) AS cards FROM part GROUP BY ALL) p LEFT JOIN (SELECT page_id, count(*) AS f FROM listed_hits GROUP BY ALL) h ON h.page_id = p.page_id""",
       M, SQL_LISTED)
def page_report_listings(spark, sf):
    return page_scan.page_report(I.shop_pages(spark, sf)).select("page_id", "candidates", "findings", "page_score")


@query("page_report")
def page_report(spark, sf):
    return page_scan.page_report(I.pages(spark, sf))


def _all_scores(df):
    n = F.length("model_input")
    return df.withColumn("probs", F.array(*[((n * (7 + 4 * i) + i * 131) % 1000) / 1000.0 for i in range(len(LABELS))]))


_ARMS = " UNION ALL ".join(
    f"SELECT page_id, k, row_id, '{n}' AS label FROM asked WHERE ((size * {7 + 4 * i} + {i * 131}) % 1000) / 1000.0::DOUBLE >= {THRESHOLDS[n]}::DOUBLE"
    + (f" AND NOT (role = 'support_link' AND NOT {hit('text', S.CANCEL_INTENT)})" if n == "obstruction" else "")
    for i, n in enumerate(LABELS) if n != "benign")
SQL_SCANNED = f"""shown AS (SELECT page_id, 'span' AS k, row_id, 'span' AS tag, role, field, text FROM listed
  UNION ALL SELECT p_partkey // 32, 'b', row_id, 'b', 'body', 'title', p_name || ' ' || p_type || ' no ' || p_partkey FROM microcopy
  UNION ALL SELECT p_partkey // 32, 's', row_id, 's', 'body', 'strike_price', 'Rs. ' || floor(p_retailprice)::BIGINT FROM microcopy
  UNION ALL SELECT p_partkey // 32, 'time', row_id, 'time', 'body', 'unknown', 'Ends in' FROM microcopy
  UNION ALL SELECT p_partkey // 32, 'clock', row_id, 'span', 'body', 'unknown', '09:' || lpad((p_size % 60)::VARCHAR, 2, '0') FROM microcopy
  UNION ALL SELECT DISTINCT p_partkey // 32, 'h1', -1, 'h1', 'heading', 'title', 'Our offers' FROM microcopy),
asked AS (SELECT *, length('[TAG=' || tag || '] [ROLE=' || role || '] ' || text) AS size FROM shown
  WHERE field NOT IN ('prose', 'personal') AND NOT (field = 'title' AND role <> 'heading')),
said AS ({_ARMS}),
scanned AS (SELECT coalesce(s.page_id, h.page_id) AS page_id, coalesce(s.label, h.label) AS label, CASE WHEN h.label IS NULL THEN 'possible' ELSE 'likely' END AS confidence,
  CASE WHEN h.label IS NULL THEN 'model' WHEN s.label IS NULL THEN 'rule' ELSE 'rule,model' END AS source
  FROM said s FULL JOIN listed_hits h ON s.k = 'span' AND s.row_id = h.row_id AND s.label = h.label)"""


@query("page_scan_findings", "SELECT page_id, label, confidence, source, count(*) AS n FROM scanned GROUP BY ALL", M, SQL_LISTED, SQL_SCANNED)
def page_scan_findings(spark, sf):
    findings, _ = page_scan.scan_pages(I.shop_pages(spark, sf), _all_scores, THRESHOLDS)
    return findings.groupBy("page_id", "label", "confidence", F.array_join("source", ",").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("page_scan_scores",
       """SELECT page_id, floor(least(1.0, sum(CASE WHEN confidence = 'likely' THEN 2 ELSE 1 END) / 20.0) * 100 + 0.5)::INT AS page_score FROM scanned GROUP BY page_id""",
       M, SQL_LISTED, SQL_SCANNED)
def page_scan_scores(spark, sf):
    _, scores = page_scan.scan_pages(I.shop_pages(spark, sf), _all_scores, THRESHOLDS)
    return scores.select("page_id", "page_score")
