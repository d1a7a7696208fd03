"""Scan archive: validation, newest capture, index, search and reports.

A trace is one page scan: ``scan_id, url, page_score, entries`` and, once it is
stored, ``captured_at``.  ``findingLabels`` null (not known yet) and empty
(known to be benign) are different everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uipatterns.functions.text import archive_host, safe_segment, strip_fragment, trim_space, utc_day
from uipatterns.operators.scoring import score_band
from uipatterns.schema import MAX_TRACE_ENTRIES, TRACE, TRACE_ENTRY

TRACE_KEYS = [f.name for f in TRACE.fields]
ENTRY_KEYS = [f.name for f in TRACE_ENTRY.fields]


def validate_traces(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Uploaded JSON texts to traces, and the refused ones with a reason."""
    body = F.col(value)
    names = lambda keys: F.array(*[F.lit(k) for k in keys])
    entry_keys = F.array_distinct(F.flatten(F.transform(
        F.from_json(F.get_json_object(body, "$.entries"), "array<string>"), lambda e: F.json_object_keys(e))))
    parsed = raw.withColumn("_t", F.from_json(body, TRACE)).withColumns({
        "_keys": F.json_object_keys(body), "_entry_keys": entry_keys})
    t = F.col("_t")
    score = F.get_json_object(body, "$.page_score")
    reason = (
        F.when(F.col("_keys").isNull(), "not a JSON object")
        .when(F.size(F.array_except("_keys", names(TRACE_KEYS))) > 0, "unknown field")
        .when(~F.coalesce(F.length(t["scan_id"]).between(1, 100), F.lit(False)), "bad scan_id")
        .when(~F.coalesce(F.length(t["url"]).between(1, 2000), F.lit(False)), "bad url length")
        .when(~t["url"].rlike("^https?://"), "url must be http(s)")
        .when(score.isNotNull() & ~F.coalesce(score.try_cast("double").between(0, 100), F.lit(False)), "page_score out of range")
        .when(t["entries"].isNull(), "entries missing")
        .when(F.size(t["entries"]) > MAX_TRACE_ENTRIES, "too many entries")
        .when(F.size(F.array_except("_entry_keys", names(ENTRY_KEYS))) > 0, "unknown entry field")
        .when(F.exists(t["entries"], lambda e: e["id"].isNull() | e["text"].isNull()), "entry without id or text")
    )
    tagged = parsed.withColumn("reason", reason).drop("_keys", "_entry_keys")
    others = [c for c in raw.columns if c != value]
    good = tagged.filter("reason is null").select(*others, "_t.*").withColumn("page_score", F.coalesce("page_score", F.lit(0)))
    return good, tagged.filter("reason is not null").drop("_t")


def latest_per_scan(traces: DataFrame) -> DataFrame:
    """The newest capture of every scan."""
    rest = [c for c in traces.columns if c not in ("scan_id", "captured_at")]
    newest = F.max_by(F.struct(*rest), F.struct("captured_at", *[c for c in ("seq",) if c in rest]))
    return traces.groupBy("scan_id").agg(F.max("captured_at").alias("captured_at"), newest.alias("_t")).select(
        "scan_id", "captured_at", *[F.col(f"_t.{c}").alias(c) for c in rest])


def object_key(url: Column, scan_id: Column, captured_at: Column) -> Column:
    return F.concat(
        F.lit("traces/"), safe_segment(archive_host(url), "unknown-host"), F.lit("/"),
        F.date_format(utc_day(captured_at), "yyyy/MM/dd"), F.lit("/"), safe_segment(scan_id, "unknown-scan"), F.lit(".json"))


def trace_index(traces: DataFrame) -> DataFrame:
    """One searchable row per trace."""
    labels = F.array_sort(F.array_distinct(F.flatten(
        F.transform("entries", lambda e: F.coalesce(e["findingLabels"], F.array().cast("array<string>"))))))
    return traces.select(
        "scan_id", object_key(F.col("url"), F.col("scan_id"), F.col("captured_at")).alias("object_key"),
        archive_host(F.col("url")).alias("host"), "url", "captured_at", F.size("entries").alias("candidate_count"),
        F.size(F.filter("entries", lambda e: F.coalesce(F.size(e["findingLabels"]) > 0, F.lit(False)))).alias("flagged_count"),
        "page_score", labels.alias("labels"))


def find_traces(index: DataFrame, host: str | None = None, label: str | None = None, limit: int = 50,
                offset: int = 0, after: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """One result page, newest first, and the totals with and without the filter.

    Deep pages go on ``after`` the (captured_at, scan_id) of the last row seen,
    which costs the same as the first page; ``offset`` keeps all rows before it.
    """
    hit = F.lit(True)
    if host is not None:
        hit = hit & (F.col("host") == host)
    if label is not None:
        hit = hit & F.array_contains("labels", label)
    rest = F.lit(True)
    if after is not None:
        at, scan = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        rest = (F.col("captured_at") < at) | ((F.col("captured_at") == at) & (F.col("scan_id") > scan))
    page = index.filter(hit & rest).orderBy(F.col("captured_at").desc(), "scan_id").offset(offset).limit(limit)
    return page, index.agg(F.count(F.lit(1)).alias("total_indexed"), F.count_if(hit).alias("total_matching"))


def entry_status(labels: Column, sent: Column) -> Column:
    return (
        F.when(labels.isNull() & F.coalesce(sent, F.lit(False)), "pending").when(labels.isNull(), "not sent (duplicate)")
        .when(F.size(labels) > 0, "flagged").otherwise("benign")
    )


def report_summary(entries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Entry counts by status and the share that a rule corroborates."""
    status = entry_status(F.col("findingLabels"), F.col("sentToModel"))
    n, ruled = F.count(F.lit(1)), F.count_if(F.coalesce(F.size("ruleHits") > 0, F.lit(False)))
    tally = lambda s: F.count_if(status == s)
    return entries.groupBy(*by).agg(
        n.alias("candidates"), tally("benign").alias("benign"), tally("flagged").alias("flagged"),
        tally("pending").alias("pending"), tally("not sent (duplicate)").alias("not_sent"), ruled.alias("corroborated"),
        F.floor(ruled * 100 / F.greatest(n, F.lit(1))).cast("bigint").alias("corroborated_pct"))


def report_labels(entries: DataFrame) -> DataFrame:
    """Findings per label with the floored share of all findings."""
    per = entries.select(F.explode("findingLabels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))  # one row per label
    return per.withColumn("share_pct", F.floor(F.col("count") * 100 / total).cast("bigint"))


def report_roles(entries: DataFrame, k: int = 15) -> DataFrame:
    return entries.groupBy(F.coalesce("role", F.lit("none")).alias("role")).agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.col("count").desc(), "role").limit(k)


def trace_report(traces: DataFrame) -> dict[str, DataFrame]:
    entries = traces.select("scan_id", "url", F.inline("entries"))
    heads = traces.select("scan_id", "url", "page_score", score_band(F.col("page_score")).alias("band"))
    return {"pages": heads, "summary": report_summary(entries), "labels": report_labels(entries),
            "roles": report_roles(entries), "examples": label_examples(entries, 3)}


def label_examples(entries: DataFrame, k: int, order: str = "seq") -> DataFrame:
    """The first ``k`` examples per label with shortened text and what supports them."""
    order = order if order in entries.columns else "id"
    rows = entries.withColumn("label", F.explode("findingLabels"))
    first = Window.partitionBy("label").orderBy(order, "id")
    text = trim_space(F.translate(F.coalesce("text", F.lit("")), "\n", " "))
    shown = F.when(F.length(text) > 100, F.concat(F.substring(text, 1, 97), F.lit("..."))).otherwise(text)
    evidence = F.when(F.coalesce(F.size("ruleHits") > 0, F.lit(False)),
                      F.concat(F.lit("rule: "), F.array_join("ruleHits", ", "))).otherwise("model only")
    return rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select(
        "label", "rank", shown.alias("text"), "tag", "role", evidence.alias("evidence"))


def same_document_only(findings: DataFrame, documents: DataFrame, session: str = "session_id") -> DataFrame:
    """Keep findings of the document their session shows now; fragments do not count."""
    current = documents.select(session, strip_fragment(F.col("url")).alias("_doc")).distinct()
    return findings.withColumn("_doc", strip_fragment(F.col("url"))).join(current, [session, "_doc"], "left_semi").drop("_doc")


def to_fact_tables(captures: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scans and findings without raw text or full URLs.

    ``captures``: ``scan_id, url, lang, step, captured_at, page_score,
    model_version, entries``.  ``findings``: ``scan_id, label, score,
    confidence, source, tag, role, selector, text, captured_at``.
    """
    scans = captures.select(
        "scan_id", archive_host(F.col("url")).alias("host"), F.sha2("url", 256).alias("url_hash"), "lang", "step",
        F.col("captured_at").alias("started_at"), F.size("entries").alias("snippet_count"), "page_score", "model_version")
    facts = findings.select(
        "scan_id", "label", "score", "confidence", F.col("source").alias("sources"), "tag", "role", "selector",
        F.sha2("text", 256).alias("text_hash"), F.col("captured_at").alias("created_at"))
    return scans, facts


def seen_span(obs: DataFrame, key: str = "id", ts: str = "ts", labels: str = "findingLabels") -> DataFrame:
    """First and last sighting per candidate, with the last known outcome."""
    known = F.when(F.col(labels).isNotNull(), F.col(ts))
    return obs.groupBy(key).agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.max_by(labels, known).alias(labels))
