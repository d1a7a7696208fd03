"""Registered queries: archive, gold set, explanations, and the batch forms of streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from uipatterns.catalog import inputs as I
from uipatterns.catalog.q_scoring import M, SQL_HITS, SQL_MERGED, SQL_RUNS, _merged, _q
from uipatterns.catalog.registry import collapse_sql, query
from uipatterns.operators import explain as X
from uipatterns.operators import gold as G
from uipatterns.operators import rules as R
from uipatterns.operators import traces as T
from uipatterns.schema import DARK_LABELS, LABEL_DESCRIPTIONS
from uipatterns.session import shared_folder
from uipatterns.streaming import live
from uipatterns.streaming.cadence import cadence_batch, value_trend
from uipatterns.streaming.pace import paced_passes

EN, CA, OB = I.SQL_ENTRIES, I.SQL_CAPTURES, I.SQL_OBSERVATIONS
_TRIM = lambda c: collapse_sql(c)


@query("g01_dedupe_entries",
       f"SELECT id FROM entries WHERE {_TRIM('text')} <> '' QUALIFY row_number() OVER (PARTITION BY regexp_replace(text, '^\\s+|\\s+$', '', 'g'), role ORDER BY seq) = 1", EN)
def g01(spark, sf):
    return G.dedupe_entries(I.entries(spark, sf)).select("id")


# 200 entries: even shares of 100 flagged over (label, script), then 100 benign.
_DEV = "CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'dev' ELSE 'en' END"


def _side_sql(name, source, budget):
    return f"""{name}_r AS (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('13' || stratum || ':' || id), id) AS rn FROM {source}),
      {name}_c AS (SELECT id, bool_or(rn <= greatest(1, floor({budget} / (SELECT count(DISTINCT stratum) FROM {source})))) AS core FROM {name}_r GROUP BY id),
      {name}_o AS (SELECT *, (CASE WHEN core THEN '0' ELSE '1' END) || md5('13+' || id) AS o FROM {name}_c),
      {name} AS (SELECT id, o FROM {name}_o QUALIFY core OR row_number() OVER (ORDER BY o, id) <= {budget})"""


@query("g02_stratified_sample", "SELECT id FROM (SELECT id, o, 0 AS s FROM fl UNION ALL SELECT id, o, 1 FROM be) ORDER BY s, o, id LIMIT 200", EN,
       f"""f0 AS (SELECT DISTINCT id, l || '|' || g AS stratum FROM (SELECT id, unnest("findingLabels") AS l, {_DEV} AS g FROM entries WHERE len("findingLabels") > 0))""",
       _side_sql("fl", "f0", "100"),
       f"""b0 AS (SELECT DISTINCT id, 'benign|' || {_DEV} AS stratum FROM entries WHERE len("findingLabels") = 0 AND id NOT IN (SELECT id FROM fl))""",
       _side_sql("be", "b0", "(200 - (SELECT count(*) FROM fl))"))
def g02(spark, sf):
    return G.stratified_sample(I.entries(spark, sf), 200).select("id")


def _uploads(spark, sf):
    c = I.captures(spark, sf).filter("minute(captured_at) = 2")
    k = F.substring_index("scan_id", "-", -1).cast("bigint")
    url = F.when(k % 7 == 0, F.concat(F.lit("ftp://x/"), k.cast("string"))).otherwise(F.col("url"))
    score = F.when(k % 11 == 0, 101).otherwise(F.col("page_score"))
    slim = F.transform("entries", lambda e: F.struct(e["id"].alias("id"), e["text"].alias("text"), e["findingLabels"].alias("findingLabels")))
    body = F.to_json(F.struct("scan_id", url.alias("url"), score.alias("page_score"), slim.alias("entries")))
    return c.select("scan_id", F.when(k % 13 == 0, F.concat(F.lit('{"extra":1,'), F.substr(body, F.lit(2)))).otherwise(body).alias("value"))


@query("t01_validate_traces",
       """SELECT scan_id, CASE WHEN k % 13 = 0 THEN 'unknown field' WHEN k % 7 = 0 THEN 'url must be http(s)' WHEN k % 11 = 0 THEN 'page_score out of range' END AS reason
          FROM (SELECT DISTINCT 'scan-' || scan_no AS scan_id, scan_no AS k FROM entries)""", EN)
def t01(spark, sf):
    raw = _uploads(spark, sf).withColumnRenamed("scan_id", "upload")
    good, bad = T.validate_traces(raw)
    return good.select(F.col("upload").alias("scan_id"), F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select(F.col("upload").alias("scan_id"), "reason"))


@query("t02_latest_per_scan", "SELECT scan_id, max(captured_s) AS captured_s, max_by(len(entries), captured_s) AS n FROM captures GROUP BY scan_id", CA)
def t02(spark, sf):
    out = T.latest_per_scan(I.captures(spark, sf))
    return out.select("scan_id", F.unix_seconds("captured_at").alias("captured_s"), F.size("entries").alias("n"))


_INDEX = """idx AS (SELECT scan_id, 'shop' || ((split_part(scan_id, '-', 2))::BIGINT % 5) || '.example' AS host, url, captured_s, len(entries) AS candidate_count,
  len(list_filter(entries, lambda e: coalesce(len(e.labels) > 0, false))) AS flagged_count, page_score,
  array_to_string(list_sort(list_distinct(flatten(list_transform(entries, lambda e: coalesce(e.labels, []))))), ',') AS labels
  FROM captures QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY captured_s DESC) = 1)"""


def _index(spark, sf):
    return T.trace_index(T.latest_per_scan(I.captures(spark, sf)))


@query("t03_trace_index",
       """SELECT scan_id, 'traces/' || host || '/' || strftime(make_timestamp(captured_s * 1000000), '%Y/%m/%d') || '/' || scan_id || '.json' AS object_key, host, url, captured_s,
          candidate_count, flagged_count, page_score, labels FROM idx""", CA, _INDEX)
def t03(spark, sf):
    out = _index(spark, sf).withColumn("captured_s", F.unix_seconds("captured_at")).withColumn("labels", F.array_join("labels", ","))
    return out.drop("captured_at")


@query("t04_find_traces", "SELECT scan_id FROM idx WHERE host = 'shop2.example' AND list_contains(string_split(labels, ','), 'sneaking') ORDER BY captured_s DESC, scan_id LIMIT 10 OFFSET 2", CA, _INDEX)
def t04(spark, sf):
    return T.find_traces(_index(spark, sf), "shop2.example", "sneaking", 10, 2)[0].select("scan_id")


@query("t04_totals", "SELECT count(*) AS total_indexed, count(*) FILTER (WHERE host = 'shop2.example' AND list_contains(string_split(labels, ','), 'sneaking')) AS total_matching FROM idx", CA, _INDEX)
def t04t(spark, sf):
    return T.find_traces(_index(spark, sf), "shop2.example", "sneaking")[1]


_STATUS = """CASE WHEN "findingLabels" IS NULL AND "sentToModel" THEN 'pending' WHEN "findingLabels" IS NULL THEN 'not sent (duplicate)' WHEN len("findingLabels") > 0 THEN 'flagged' ELSE 'benign' END"""


@query("t05_entry_status", f"SELECT id, {_STATUS} AS status FROM entries", EN)
def t05(spark, sf):
    return I.entries(spark, sf).select("id", T.entry_status(F.col("findingLabels"), F.col("sentToModel")).alias("status"))


@query("t06_report_summary",
       f"""SELECT url, count(*) AS candidates, count(*) FILTER (WHERE s = 'benign') AS benign, count(*) FILTER (WHERE s = 'flagged') AS flagged, count(*) FILTER (WHERE s = 'pending') AS pending,
           count(*) FILTER (WHERE s LIKE 'not%') AS not_sent, count(*) FILTER (WHERE len("ruleHits") > 0) AS corroborated,
           (count(*) FILTER (WHERE len("ruleHits") > 0) * 100) // count(*) AS corroborated_pct FROM (SELECT *, {_STATUS} AS s FROM entries) GROUP BY url""", EN)
def t06(spark, sf):
    return T.report_summary(I.entries(spark, sf), ("url",))


@query("t06_report_labels", """SELECT label, count(*) AS count, (count(*) * 100 // sum(count(*)) OVER ())::BIGINT AS share_pct FROM (SELECT unnest("findingLabels") AS label FROM entries) GROUP BY label""", EN)
def t06l(spark, sf):
    return T.report_labels(I.entries(spark, sf))


@query("t06_report_roles", "SELECT role, count(*) AS count FROM entries GROUP BY role ORDER BY 2 DESC, 1 LIMIT 15", EN)
def t06r(spark, sf):
    return T.report_roles(I.entries(spark, sf))


@query("t07_label_examples",
       """SELECT label, rn AS rank, CASE WHEN length(t) > 100 THEN left(t, 97) || '...' ELSE t END AS text, tag, role,
          CASE WHEN len(h) > 0 THEN 'rule: ' || array_to_string(h, ', ') ELSE 'model only' END AS evidence FROM (
          SELECT label, trim(replace(text, chr(10), ' ')) AS t, tag, role, "ruleHits" AS h, row_number() OVER (PARTITION BY label ORDER BY seq, id) AS rn
          FROM (SELECT *, unnest("findingLabels") AS label FROM entries)) WHERE rn <= 3""", EN)
def t07(spark, sf):
    return T.label_examples(I.entries(spark, sf), 3)


@query("t08_same_document_only",
       """SELECT event_id FROM (SELECT event_id, user_id, 'https://x.example/' || event_type AS doc FROM events) e WHERE EXISTS (
          SELECT 1 FROM (SELECT user_id, 'https://x.example/' || max_by(event_type, ts) AS doc FROM events GROUP BY user_id) d WHERE d.user_id = e.user_id AND d.doc = e.doc)""")
def t08(spark, sf):
    ev = I.table(spark, sf, "events")
    url = lambda c: F.concat(F.lit("https://x.example/"), c)
    now = ev.groupBy(F.col("user_id").alias("session_id")).agg(F.concat(url(F.max_by("event_type", "ts")), F.lit("#now")).alias("url"))
    seen = ev.select("event_id", F.col("user_id").alias("session_id"), F.concat(url(F.col("event_type")), F.lit("#a"), F.col("event_id").cast("string")).alias("url"))
    return T.same_document_only(seen, now).select("event_id")


def _facts(spark, sf):
    caps = T.latest_per_scan(I.captures(spark, sf)).withColumns({"lang": F.lit("en"), "step": F.lit("product"), "model_version": F.lit("1.0.0")})
    found = caps.select("scan_id", "captured_at", F.inline("entries")).filter("size(findingLabels) > 0").select(
        "scan_id", "captured_at", F.explode("findingLabels").alias("label"), F.lit(1.0).alias("score"), F.lit("likely").alias("confidence"),
        F.array(F.lit("model")).alias("source"), "tag", "role", F.lit("p").alias("selector"), "text")
    return T.to_fact_tables(caps, found)


@query("t09_scans", "SELECT scan_id, host, sha256(url) AS url_hash, candidate_count AS snippet_count, page_score FROM idx", CA, _INDEX)
def t09(spark, sf):
    return _facts(spark, sf)[0].select("scan_id", "host", "url_hash", "snippet_count", "page_score")


@query("t09_findings", """SELECT 'scan-' || scan_no AS scan_id, unnest("findingLabels") AS label, role, sha256(text) AS text_hash FROM entries""", EN)
def t09f(spark, sf):
    return _facts(spark, sf)[1].select("scan_id", "label", "role", "text_hash")


_FENCE = "regexp_replace(text, '(-{3,}|`{3,}|<\\|.*?\\|>)', ' ', 'g')"


@query("p01_sanitize_untrusted", f"SELECT doc_id, md5({collapse_sql(_FENCE)}) AS text_md5 FROM (SELECT doc_id, '<|x|>' || text || '---end' AS text FROM documents)")
def p01(spark, sf):
    text = F.concat(F.lit("<|x|>"), "text", F.lit("---end"))
    return I.documents(spark, sf).select("doc_id", F.md5(X.sanitize_untrusted(text)).alias("text_md5"))


@query("p02_policy_violation",
       rf"""SELECT row_id, nullif(regexp_extract(t, '(?:^|[^\pL\pM\pN_]){X.FORBIDDEN[2:-2]}(?:$|[^\pL\pM\pN_])', 1, 'i'), '') AS term
          FROM (SELECT row_id, text || CASE p_size % 6 WHEN 0 THEN ' is ILLEGAL here' WHEN 1 THEN ' an issue' WHEN 2 THEN ' violates law' WHEN 3 THEN ' éfraud' WHEN 4 THEN ' fraudé, sue' ELSE '' END AS t FROM microcopy)""", M)
def p02(spark, sf):
    k = F.col("p_size") % 6
    tail = F.when(k == 0, " is ILLEGAL here").when(k == 1, " an issue").when(k == 2, " violates law").when(k == 3, " éfraud").when(
        k == 4, " fraudé, sue").otherwise("")
    return I.microcopy(spark, sf).select("row_id", X.policy_violation(F.concat("text", tail)).alias("term"))


@query("p03_evidence_tier", "SELECT row_id, label, CASE source WHEN 'rule,model' THEN 'rule+model' ELSE source END AS tier FROM merged", M, SQL_HITS, SQL_MERGED)
def p03(spark, sf):
    return _merged(spark, sf).select("row_id", "label", X.evidence_tier(F.col("source")).alias("tier"))


_DESCRIBE = "CASE " + " ".join(f"WHEN f.label = '{k}' THEN {_q(v)}" for k, v in LABEL_DESCRIPTIONS.items() if k in DARK_LABELS) + " END"
_TIER = "CASE source " + " ".join(f"WHEN '{k.replace('+', ',')}' THEN {_q(v)}" for k, v in X.EVIDENCE.items()) + " END"


@query("p04_build_prompts",
       f"""SELECT f.row_id, f.label, md5(concat_ws(chr(10), 'Finding: ' || f.label, 'What that category means: ' || {_DESCRIBE}, 'Confidence recorded by the extension: ' || confidence,
           'Evidence: ' || {_TIER}, CASE WHEN rule IS NOT NULL THEN 'Structural rules that fired: ' || rule END,
           CASE WHEN m_label IS NOT NULL THEN 'Classifier score: ' || printf('%.2f', score) || ' (its threshold for this category is ' || printf('%.2f', threshold) || ')' END,
           'The element is an HTML <' || tag || '> that the extension classified as playing the role of ''' || role || ''' on the page.', '', {_q(X.TEXT_HEAD)},
           '[[[' || text || ']]]', '', {_q(X.CONTEXT_HEAD)}, '[[[' || role || ': ' || p_name || ']]]', '', {_q(X.CLOSING)})) AS prompt_md5
           FROM merged f JOIN microcopy c ON c.row_id = f.row_id""", M, SQL_HITS, SQL_MERGED)
def p04(spark, sf):
    hits = R.rule_hits_long(R.run_rules(I.microcopy(spark, sf)), ["row_id"]).groupBy("row_id", "label").agg(F.collect_set("rule").alias("rule_hits"))
    cands = I.microcopy(spark, sf).select("row_id", "tag", "role", "text", F.array(F.struct("role", F.col("p_name").alias("text"))).alias("context"))
    rows = _merged(spark, sf).join(cands, "row_id").join(hits, ["row_id", "label"], "left").withColumn(
        "rule_hits", F.coalesce("rule_hits", F.array().cast("array<string>")))
    return X.build_prompts(rows).select("row_id", "label", F.md5("prompt").alias("prompt_md5"))


@query("w01_dedupe_batch",
       """SELECT min(event_id) AS event_id, 'https://x.example/' || event_type AS document, 'u' || user_id || '|' || regexp_replace(value::VARCHAR, '[0-9]+', '#', 'g') AS churn FROM events GROUP BY 2, 3""")
def w01(spark, sf):
    rows = I.table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("https://x.example/"), "event_type", F.lit("#"), F.col("event_id").cast("string")).alias("url"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("selector"), F.col("value").cast("string").alias("text"))
    return live.dedupe_batch(rows).select("event_id", "document", "churn")


@query("w02_cadence", "SELECT key, longest, current FROM runs", SQL_RUNS)
def w02(spark, sf):
    out = cadence_batch(I.observations(spark, sf), min_ms=3_600_000, max_ms=43_200_000, chunk_seconds=86_400)
    return out.select("key", "longest", "current")


_W03 = """SELECT document, floor(least(1.0, sum(pts) / 20.0) * 100 + 0.5)::INT AS page_score FROM (SELECT document, pts FROM (
          SELECT event_type AS document, user_id, max_by(value, ts) AS last_value, min(ts) AS first_seen, CASE WHEN max_by(value, ts) > 20 THEN 2 ELSE 1 END AS pts
          FROM events GROUP BY ALL) WHERE last_value > 10) GROUP BY document"""


def _sightings(events):
    found = F.when(F.col("value") > 10, F.array(F.struct(F.lit("scarcity").alias("label"), F.when(F.col("value") > 20, "likely").otherwise("possible").alias("confidence"))))
    return events.select(
        F.col("event_type").alias("document"), F.col("user_id").cast("string").alias("cand_id"), F.col("ts").cast("timestamp").alias("seen_at"),
        F.coalesce(found, F.array().cast("array<struct<label:string,confidence:string>>")).alias("findings"))


@query("w03_document_scores", _W03)
def w03(spark, sf):
    state = live.upsert_findings(spark.createDataFrame([], live.STATE), _sightings(I.table(spark, sf, "events")))
    return live.document_scores(state).select("document", "page_score")


@query("w03_live_table", _W03)
def w03_table(spark, sf):
    """All events through the stream and its table: two checkpoints with half of the events each, a compaction between them."""
    root = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    for half in (1, 0):  # the second checkpoint brings other rows, and in part older ones
        events = spark.readStream.schema(I.table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet").filter(F.col("event_id") % 2 == half)
        rows = _sightings(events).withColumnRenamed("document", "url")
        live.stream_findings(rows, f"{root}/table", f"{root}/checkpoint{half}", {"availableNow": True}).awaitTermination()
        if half:
            live.compact_findings(spark, f"{root}/table")
    return live.read_scores(spark, f"{root}/table").select("document", "page_score")


@query("w04_document_keys",
       """SELECT split_part(url, '#', 1) AS document, count(DISTINCT page_id % 3) AS elements, count(*) AS rows FROM pages GROUP BY 1""")
def w04(spark, sf):
    rows = I.table(spark, sf, "pages").select(
        "url", F.concat(F.lit("p"), (F.col("page_id") % 3).cast("string")).alias("selector"), F.concat(F.lit("Only "), F.col("page_id").cast("string")).alias("text"))
    return live.churn_rows(rows).groupBy("document").agg(F.countDistinct("churn").alias("elements"), F.count(F.lit(1)).alias("rows"))


_QUIET, _FLOOR = 3 * 3_600_000, 12 * 3_600_000


@query("w05_paced_passes",
       f"""SELECT user_id, strftime(make_timestamp(due), '%Y-%m-%d %H:%M:%S.%f') AS pass_at, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f') AS last_seen, waiting AS signals
          FROM walk WHERE following IS NULL OR following >= due""",
       f"""RECURSIVE signals AS (SELECT user_id, epoch_us(ts) AS us, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS nth,
              lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS following FROM events GROUP BY user_id, epoch_us(ts)),
           walk AS (SELECT user_id, nth, us, following, n AS waiting, us + {_QUIET}000 AS due, -{_FLOOR}000 AS ran FROM signals WHERE nth = 1
              UNION ALL SELECT user_id, nth, us, following, n + CASE WHEN us >= due THEN 0 ELSE waiting END,
                greatest(us + {_QUIET}000, CASE WHEN us >= due THEN due ELSE ran END + {_FLOOR}000), CASE WHEN us >= due THEN due ELSE ran END
              FROM (SELECT s.*, w.due, w.ran, w.waiting FROM walk w JOIN signals s ON s.user_id = w.user_id AND s.nth = w.nth + 1))""")
def w05(spark, sf):
    """The rule of passes at the pace of the events: three quiet hours, half a day between two passes."""
    out = paced_passes(I.table(spark, sf, "events"), "user_id", "ts", _QUIET, _FLOOR, chunk_seconds=86_400)
    as_text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return out.select(F.col("key").alias("user_id"), as_text("pass_at"), as_text("last_seen"), "signals")


@query("w06_seen_span",
       """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
          max_by(event_type, ts) FILTER (WHERE event_type <> 'view') AS outcome FROM events GROUP BY user_id""")
def w06(spark, sf):
    rows = I.table(spark, sf, "events").select("user_id", "ts", F.when(F.col("event_type") != "view", F.col("event_type")).alias("outcome"))
    out = T.seen_span(rows, "user_id", "ts", "outcome")
    as_text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", as_text("first_seen"), as_text("last_seen"), "outcome")


@query("w07_value_trend",
       """SELECT key, count(*) AS observations, coalesce(bool_and(v < b) FILTER (WHERE b IS NOT NULL), false) AS strictly_decreasing, count(*) FILTER (WHERE v <> b) AS changes FROM (
          SELECT key, v, lag(v) OVER (PARTITION BY key ORDER BY ts, v) AS b FROM (SELECT key, ts, try_cast(regexp_extract(text, '([0-9]+)', 1) AS BIGINT) AS v FROM observations) WHERE v IS NOT NULL) GROUP BY key""", OB)
def w07(spark, sf):
    return value_trend(I.observations(spark, sf), text="text", chunk_seconds=86_400)

