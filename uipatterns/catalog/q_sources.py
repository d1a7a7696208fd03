"""Registered queries: files written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from uipatterns.catalog import inputs as I
from uipatterns.catalog.q_data import _LABELLED, M, _overridden
from uipatterns.catalog.q_traces import CA, EN, _INDEX
from uipatterns.catalog.registry import query
from uipatterns.operators import dataset as D
from uipatterns.operators import gold as G
from uipatterns.operators import traces as T
from uipatterns.session import shared_folder
from uipatterns.sources import archive as A
from uipatterns.sources import tables as TB


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/uipatterns-{uuid.uuid4().hex}"


_PART = "CASE WHEN row_id % 10 < 2 THEN 'test' WHEN row_id % 10 < 4 THEN 'val' ELSE 'train' END"


def _parts(spark, sf):
    rows = _overridden(spark, sf)
    k = F.col("row_id") % 10
    part = F.when(k < 2, "test").when(k < 4, "val").otherwise("train")
    keyed = rows.withColumn("template_id", F.concat_ws(":", part, "template_id", F.col("row_id").cast("string")))
    out = D.dataset_rows(keyed, "synthetic_v1")
    return out.withColumn("part", F.substring_index("template_id", ":", 1))


@query("s01_read_split", f"SELECT text, labels, primary_label, list_contains(string_split(labels, '|'), 'scarcity')::INT AS y_scarcity FROM labelled WHERE {_PART} = 'val'", M, _LABELLED)
def s01(spark, sf):
    root = _scratch(spark)
    TB.write_parts(_parts(spark, sf), root, "split_a")
    return TB.read_split(spark, root, "split_a", "val").select("text", "labels", "primary_label", "y_scarcity")


@query("s02_read_parts", f"SELECT {_PART} AS part, text, '[TAG=' || tag || '] [ROLE=' || role || '] ' || text AS model_input FROM labelled", M, _LABELLED)
def s02(spark, sf):
    root = _scratch(spark)
    TB.write_parts(_parts(spark, sf), root, "split_a")
    return TB.read_parts(spark, root, "split_a").select("part", "text", "model_input")


@query("s03_read_traces", """SELECT 'scan-' || scan_no AS scan_id, 'shop' || (scan_no % 5) || '.example' AS host, id, text, "findingLabels" IS NULL AS unknown FROM entries""", EN)
def s03(spark, sf):
    root = _scratch(spark)
    docs = T.latest_per_scan(I.captures(spark, sf))
    body = F.to_json(F.struct("scan_id", "url", "entries"))
    docs.select(body.alias("value")).write.text(root)
    rows, _ = A.read_traces(spark, root, one_per_file=False)
    return rows.select("scan_id", "host", "id", "text", F.col("findingLabels").isNull().alias("unknown"))


@query("s06_write_archive", "SELECT scan_id, host, captured_s, candidate_count AS n FROM idx", CA, _INDEX)
def s06(spark, sf):
    root = _scratch(spark)
    caps = I.captures(spark, sf)
    # First captures a day early, then all: later captures replace earlier ones, also those of another day.
    early = caps.filter("minute(captured_at) = 1").withColumn("captured_at", F.col("captured_at") - F.expr("INTERVAL 1 DAY"))
    A.write_archive(early, root)
    A.write_archive(caps, root)
    return A.read_archive(spark, root).select("scan_id", "host", F.unix_seconds("captured_at").alias("captured_s"), F.size("entries").alias("n"))


@query("s08_read_archive", "SELECT scan_id, candidate_count AS n FROM idx WHERE host = 'shop3.example'", CA, _INDEX)
def s08(spark, sf):
    root = _scratch(spark)
    A.write_archive(I.captures(spark, sf), root)
    return A.read_archive(spark, root, "shop3.example").select("scan_id", F.size("entries").alias("n"))


@query("s09_write_per_class", "SELECT primary_label, count(*) AS n FROM labelled GROUP BY 1", M, _LABELLED)
def s09(spark, sf):
    root = _scratch(spark)
    TB.write_per_class(_parts(spark, sf), root)
    return spark.read.options(**TB.CSV).csv(root).groupBy("primary_label").agg(F.count(F.lit(1)).alias("n"))


def _sheet(spark, sf):
    rows = I.entries(spark, sf).withColumn("host", F.concat(F.lit("shop"), (F.col("scan_no") % 5).cast("string"), F.lit(".example")))
    return G.annotation_sheet(rows)


@query("s10_annotation_sheet",
       """SELECT id, text, role, 'shop' || (scan_no % 5) || '.example' AS host, coalesce(array_to_string("findingLabels", ' '), '') AS model_labels,
          coalesce(array_to_string("ruleHits", ' '), '') AS rule_hits, split_part(url, '?', 1) AS url FROM entries""", EN)
def s10(spark, sf):
    root = _scratch(spark)
    TB.write_annotation_sheet(_sheet(spark, sf), root)
    back = spark.read.options(**TB.CSV).csv(root)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return back.select("id", blank("text"), "role", "host", blank("model_labels"), blank("rule_hits"), "url")


@query("s11_read_gold", """SELECT id, 'scarcity' AS gold_labels FROM entries WHERE "sentToModel" """, EN)
def s11(spark, sf):
    root = _scratch(spark)
    sent = F.substring_index("id", "-", -1).cast("int") % 2 == 0
    TB.write_annotation_sheet(_sheet(spark, sf).withColumn("gold_labels", F.when(sent, "scarcity").otherwise(" ")), root)
    return TB.read_gold(spark, root).select("id", "gold_labels")


@query("s12_write_stats", "SELECT primary_label, lang, count(*) AS n_rows FROM labelled GROUP BY GROUPING SETS ((primary_label), (lang), (primary_label, lang), ())", M, _LABELLED)
def s12(spark, sf):
    root = _scratch(spark)
    TB.write_stats(D.dataset_stats(D.dataset_rows(_overridden(spark, sf), "synthetic_v1")), root)
    return spark.read.schema("primary_label string, lang string, n_rows long").json(root)
