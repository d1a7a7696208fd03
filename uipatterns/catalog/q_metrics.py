"""Registered queries: evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from uipatterns.catalog import inputs as I
from uipatterns.catalog.registry import SQL_WS, query
from uipatterns.operators import metrics as E

S, TEN = I.SQL_SCORES, I.SQL_TENFOLD
_HIT = "(count(*) FILTER (WHERE y = {0} AND p = {1}))"
TP, FP, FN = (_HIT.format(*yp) for yp in ((1, 1), (0, 1), (1, 0)))


def _class_sql(name, source, by="label"):
    """A CTE of per-label counts and rates."""
    return f"""{name} AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision,
      CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1
      FROM (SELECT {by}, {TP} AS tp, {FP} AS fp, {FN} AS fn, count(*) AS n FROM {source} GROUP BY {by}))"""


def _round(df, *keep):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if not keep or c in keep])


@query("e01_apply_thresholds", "SELECT row_id, label, (prob >= CASE label WHEN 'toxic' THEN 0.6 ELSE 0.5 END::DOUBLE)::INT AS p FROM scores", S)
def e01(spark, sf):
    cuts = spark.createDataFrame([("toxic", 0.6)], "label string, threshold double")
    return E.apply_thresholds(I.scores(spark, sf).drop("p"), cuts).select("row_id", "label", "p")


@query("e02_per_class", "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, tp + fn AS support, tp + fp AS predicted FROM k",
       TEN, _class_sql("k", "tenfold"))
def e02(spark, sf):
    return _round(E.per_class(I.tenfold(spark, sf)))


@query("e03_average_precision",
       """SELECT label, round(CASE WHEN max(tp) > 0 THEN sum(pos * tp / seen) / max(tp) END, 6) AS avg_precision FROM (
          SELECT label, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM (SELECT label, prob, sum(y)::DOUBLE AS pos, count(*) AS n FROM scores GROUP BY ALL)
          WINDOW w AS (PARTITION BY label ORDER BY prob DESC)) GROUP BY label""", S)
def e03(spark, sf):
    return _round(E.average_precision(I.scores(spark, sf)))


def _summary_sql(source, k, by=""):
    group, sel = (f"GROUP BY {by}", f"{by},") if by else ("", "")
    join = f"USING ({by})" if by else "ON true"
    return f"""SELECT a.*, exact_match, n_rows FROM (SELECT {sel} round(avg(f1) FILTER (WHERE label <> 'c9'), 6) AS macro_f1_dark, round(avg(f1), 6) AS macro_f1_all,
      round(2.0 * sum(tp) / sum(2 * tp + fp + fn), 6) AS micro_f1, round(avg(precision) FILTER (WHERE label <> 'c9'), 6) AS macro_precision_dark,
      round(avg(recall) FILTER (WHERE label <> 'c9'), 6) AS macro_recall_dark, round(1 - sum(fp + fn)::DOUBLE / sum(n), 6) AS hamming_accuracy FROM {k} {group}) a
      JOIN (SELECT {sel} round(avg(ok::INT), 6) AS exact_match, count(*) AS n_rows FROM (SELECT {sel} row_id, bool_and(y = p) AS ok FROM {source} GROUP BY ALL) {group}) b {join}"""


@query("e04_summary", _summary_sql("tenfold", "k"), TEN, _class_sql("k", "tenfold"))
def e04(spark, sf):
    return _round(E.summary(I.tenfold(spark, sf), "c9"))


_LANG_SQL = f"SELECT lang, n_rows AS n, macro_f1_dark, micro_f1 FROM ({_summary_sql('tenfold', 'k', 'lang')})"


@query("e05_per_language", _LANG_SQL, TEN, _class_sql("k", "tenfold", "lang, label"))
def e05(spark, sf):
    return _round(E.per_language(I.tenfold(spark, sf), "c9"))


@query("e05_spread", f"SELECT round(max(macro_f1_dark) - min(macro_f1_dark), 6) AS spread, min_by(lang, (macro_f1_dark, lang)) AS worst_lang, max(macro_f1_dark) - min(macro_f1_dark) > 0.10 AS lags FROM ({_LANG_SQL})",
       TEN, _class_sql("k", "tenfold", "lang, label"))
def e05s(spark, sf):
    return _round(E.spread(e05(spark, sf)))


@query("e06_macro_supported",
       "SELECT round(avg(f1), 6) AS macro_f1, round(avg(f1) FILTER (WHERE tp + fn > 0), 6) AS macro_f1_supported, count(*) FILTER (WHERE tp + fn > 0) AS n_supported FROM k WHERE label <> 'c9'",
       TEN, "t2 AS (SELECT row_id, label, CASE WHEN label = 'c3' THEN 0 ELSE y END AS y, p FROM tenfold)", _class_sql("k", "t2"))
def e06(spark, sf):
    rows = I.tenfold(spark, sf).withColumn("y", F.when(F.col("label") == "c3", 0).otherwise(F.col("y")))
    return _round(E.macro_supported(rows, "c9"))


_SETS = "sets AS (SELECT row_id, list_sort(list(label) FILTER (WHERE y = 1)) AS gold, list_sort(list(label) FILTER (WHERE p = 1)) AS pred FROM tenfold GROUP BY row_id)"


@query("e07_confusion_pairs",
       """SELECT a.label AS "true", b.label AS predicted_instead, count(*) AS count FROM tenfold a JOIN tenfold b ON a.row_id = b.row_id
          WHERE a.y = 1 AND a.p = 0 AND b.y = 0 AND b.p = 1 GROUP BY ALL ORDER BY count DESC, 1, 2 LIMIT 12""", TEN)
def e07(spark, sf):
    return E.confusion_pairs(I.tenfold(spark, sf), 12)


_ERR = """SELECT CASE WHEN y = 0 THEN 'false_positive' ELSE 'false_negative' END AS kind, label, t.row_id, array_to_string(gold, ' ') AS gold_labels,
  array_to_string(pred, ' ') AS predicted_labels FROM tenfold t JOIN sets s ON s.row_id = t.row_id WHERE y <> p"""


@query("e08_error_examples", f"SELECT kind, row_id, gold_labels, predicted_labels FROM (SELECT DISTINCT kind, row_id, gold_labels, predicted_labels FROM ({_ERR})) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY row_id) <= 20", TEN, _SETS)
def e08(spark, sf):
    return E.error_examples(I.tenfold(spark, sf), 20)


@query("e09_error_rows", _ERR, TEN, _SETS)
def e09(spark, sf):
    return E.error_rows(I.tenfold(spark, sf))


_GRID = "[" + ", ".join(repr(g) + "::DOUBLE" for g in E.GRID) + "]"


def _sweep_sql(name, floor="true"):
    return f"""{name} AS (SELECT label, coalesce(max(r) FILTER (WHERE {floor}), max(r)) AS best, max(r) FILTER (WHERE {floor}) IS NULL AS constraint_unmet FROM (
      SELECT *, {{'f1': f1, 'down': -i, 'threshold': thr, 'precision': precision, 'recall': recall}} AS r FROM swept) GROUP BY label)"""


_SWEPT = f"""grid AS (SELECT generate_subscripts({_GRID}, 1) AS i, unnest({_GRID}) AS thr),
cells AS (SELECT label, i, thr, y, (prob >= thr)::INT AS p FROM scores CROSS JOIN grid), """ + _class_sql("swept", "cells", "label, i, thr")


@query("e10_sweep", "SELECT label, round(best.threshold, 6) AS threshold, round(best.f1, 6) AS f1, round(best.precision, 6) AS precision, round(best.recall, 6) AS recall, constraint_unmet FROM b",
       S, _SWEPT, _sweep_sql("b"))
def e10(spark, sf):
    return _round(E.sweep(I.scores(spark, sf)))


def _profile(n):
    return f"""SELECT label, round_even(best.threshold, 3) AS threshold, round(best.f1, 6) AS f1, round(best.precision, 6) AS precision, round(best.recall, 6) AS recall, constraint_unmet,
      '{n}' AS profile, round_even(best.threshold, 3) <= 0.06 OR round_even(best.threshold, 3) >= 0.94 AS at_edge, best.precision < 0.5 AS weak FROM {n}"""


@query("e11_tune_profiles", " UNION ALL ".join(_profile(n) for n in ("precision_", "balanced", "recall_")).replace("'precision_'", "'precision'").replace("'recall_'", "'recall'"),
       S, _SWEPT, _sweep_sql("precision_", "precision >= 0.8"), _sweep_sql("balanced"), _sweep_sql("recall_", "recall >= 0.8"))
def e11(spark, sf):
    return _round(E.tune_profiles(I.scores(spark, sf)))


@query("e12_leakage_gap", """SELECT round(a, 6) AS "primary", round(b, 6) AS leaky, round(b - a, 6) AS gap FROM (SELECT avg(f1) AS a FROM k1 WHERE label <> 'c9') CROSS JOIN (SELECT avg(f1) AS b FROM k2 WHERE label <> 'c9')""",
       TEN, "t1 AS (SELECT * FROM tenfold WHERE lang = 'g1')", "t2 AS (SELECT * FROM tenfold WHERE lang <> 'g1')", _class_sql("k1", "t1"), _class_sql("k2", "t2"))
def e12(spark, sf):
    rows = I.tenfold(spark, sf)
    return _round(E.leakage_gap(rows.filter("lang = 'g1'"), rows.filter("lang <> 'g1'"), "c9"))


_BOTH = """both_ AS (SELECT row_id, label, prob AS pa, p AS a, pb, (pb >= 0.5::DOUBLE)::INT AS b FROM (
  SELECT *, CASE WHEN label = 'toxic' THEN prob * 0.5::DOUBLE ELSE prob + 0.001::DOUBLE END AS pb FROM scores))"""


def _two(spark, sf):
    a = I.scores(spark, sf)
    pb = F.when(F.col("label") == "toxic", F.col("prob") * 0.5).otherwise(F.col("prob") + 0.001)
    b = a.withColumn("prob", pb)
    return E.parity(a, b.withColumn("p", (F.col("prob") >= 0.5).cast("int")))


@query("e13_parity_labels",
       """SELECT label, sum(a)::BIGINT AS a_pos, sum(b)::BIGINT AS b_pos, round(avg((a = b)::INT), 6) AS agreement, round(avg(abs(pa - pb)), 6) AS drift,
          CASE WHEN sum(a) >= 5 AND sum(b) < sum(a) * 0.5 THEN 'COLLAPSED' WHEN avg((a = b)::INT) < 0.97 THEN 'DISAGREES' ELSE '' END AS flag FROM both_ GROUP BY label""", S, _BOTH)
def e13(spark, sf):
    return _round(_two(spark, sf)[0])


@query("e13_parity_total",
       """SELECT round(avg(abs(pa - pb)), 6) AS mean_abs, round(max(abs(pa - pb)), 6) AS max_abs, round(avg((a = b)::INT), 6) AS label_agreement,
          (SELECT count(*) FROM (SELECT label FROM both_ GROUP BY label HAVING avg((a = b)::INT) < 0.97)) AS disagreeing,
          (SELECT count(*) FROM (SELECT label FROM both_ GROUP BY label HAVING sum(a) >= 5 AND sum(b) < sum(a) * 0.5)) AS collapsed,
          (SELECT round(avg(ok::INT), 6) FROM (SELECT row_id, bool_and(a = b) AS ok FROM both_ GROUP BY row_id)) AS row_agreement,
          avg(abs(pa - pb)) < 0.02 AND avg((a = b)::INT) >= 0.99 AS passed FROM both_""", S, _BOTH)
def e13t(spark, sf):
    return _round(_two(spark, sf)[1])


def _tokenized(spark, sf):
    docs = I.documents(spark, sf)
    words, chars = F.split("text", " "), F.regexp_extract_all("text", F.lit("([a-z]{1,3}|[^a-z])"), F.lit(1))
    both = docs.select("lang", "text", F.explode(F.array(
        F.struct(F.lit("words").alias("model_key"), words.alias("tokens")), F.struct(F.lit("pieces").alias("model_key"), chars.alias("tokens")))).alias("m"))
    unk = F.transform("m.tokens", lambda t: F.when(t == "the", "[UNK]").otherwise(t))
    return both.select("m.model_key", "lang", "text", unk.alias("tokens"))


_TOK = f"""tok AS (SELECT model_key, lang, text, len(tokens) AS n, len(list_filter(tokens, lambda t: t = 'the')) AS unk,
  greatest(len(list_filter(regexp_split_to_array(text, '{SQL_WS}'), lambda w: w <> '')), 1) AS words
  FROM (SELECT 'words' AS model_key, lang, text, string_split(text, ' ') AS tokens FROM documents UNION ALL
  SELECT 'pieces', lang, text, regexp_extract_all(text, '([a-z]{{1,3}}|[^a-z])', 1, 's') FROM documents))""", """fert AS (SELECT model_key, lang, round(sum(n)::DOUBLE / sum(words), 3) AS fertility,
  round(avg(n), 1) AS tokens_per_snippet, floor(quantile_cont(n + 2, 0.95))::BIGINT AS p95_tokens, round(sum(unk)::DOUBLE / greatest(sum(n), 1), 5) AS unk_rate FROM tok GROUP BY ALL)"""


@query("e14_fertility", "SELECT * FROM fert", *_TOK)
def e14(spark, sf):
    return E.fertility(_tokenized(spark, sf))


@query("e14_sample_per_lang", "SELECT doc_id AS row_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('13' || doc_id), doc_id) <= 600")
def e14s(spark, sf):
    return E.sample_per_lang(I.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "lang"))


@query("e15_fertility_report",
       """SELECT *, round(de / en, 6) AS ratio, row_number() OVER (ORDER BY de NULLS LAST, model_key) = 1 AS is_best, worst_unk > 0.005 AS exclude, max_p95 > 64 AS too_long FROM (
          SELECT model_key, max(fertility) FILTER (WHERE lang = 'en') AS en, max(fertility) FILTER (WHERE lang = 'de') AS de, max(fertility) FILTER (WHERE lang = 'fr') AS fr,
          max(unk_rate) AS worst_unk, max(p95_tokens) AS max_p95 FROM fert GROUP BY model_key)""", *_TOK)
def e15(spark, sf):
    return E.fertility_report(e14(spark, sf), ["en", "de", "fr"], "de", "en").withColumn("ratio", F.round("ratio", 6))


@query("e16_parse_labels",
       """SELECT row_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(replace(cell, ',', ' '), ' +'), lambda x: x <> '' AND x <> 'benign'))), '|') AS labels
          FROM (SELECT row_id, label || CASE WHEN p_size % 2 = 0 THEN ', scarcity' ELSE '  ' || label || ' benign' END AS cell FROM microcopy)""", I.SQL_MICROCOPY)
def e16(spark, sf):
    cell = F.concat("label", F.when(F.col("p_size") % 2 == 0, ", scarcity").otherwise(F.concat(F.lit("  "), "label", F.lit(" benign"))))
    return I.microcopy(spark, sf).select("row_id", F.array_join(E.parse_labels(cell), "|").alias("labels"))


_ABL = """ab AS (SELECT row_id, label, y, p AS m, greatest(p, (row_id % 5 = 0 AND y = 1)::INT) AS x FROM tenfold WHERE label <> 'c9'),
  am AS (SELECT label, y, m AS p FROM ab), ax AS (SELECT label, y, x AS p FROM ab)"""


@query("e17_ablation",
       """SELECT round(a, 6) AS macro_model, round(b, 6) AS macro_merged, round(sa, 6) AS supported_model, round(sb, 6) AS supported_merged, round(b - a, 6) AS delta, round(sb - sa, 6) AS delta_supported
          FROM (SELECT avg(f1) AS a, avg(f1) FILTER (WHERE tp + fn > 0) AS sa FROM k1) CROSS JOIN (SELECT avg(f1) AS b, avg(f1) FILTER (WHERE tp + fn > 0) AS sb FROM k2)""",
       TEN, _ABL, _class_sql("k1", "am"), _class_sql("k2", "ax"))
def e17(spark, sf):
    t = I.tenfold(spark, sf)
    rules = t.filter((F.col("row_id") % 5 == 0) & (F.col("y") == 1)).select("row_id", "label")
    return _round(E.ablation(t.select("row_id", "label", "y"), t.filter("p = 1").select("row_id", "label"), rules, "c9"))


@query("e18_latency_report",
       """SELECT "case", min(ms) AS min, max(ms) AS max, min(ms) FILTER (WHERE rn = least(n, greatest(1, round_even(0.5 * n + 0.5, 0)::BIGINT))) AS p50,
          min(ms) FILTER (WHERE rn = least(n, greatest(1, round_even(0.95 * n + 0.5, 0)::BIGINT))) AS p95,
          CASE WHEN min(ms) FILTER (WHERE rn = least(n, greatest(1, round_even(0.95 * n + 0.5, 0)::BIGINT))) > 40 THEN 'OVER' ELSE 'ok' END AS verdict
          FROM (SELECT event_type AS "case", value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1""")
def e18(spark, sf):
    t = I.table(spark, sf, "events").select(F.col("event_type").alias("case"), F.col("value").alias("ms"))
    return E.latency_report(t, 40)
