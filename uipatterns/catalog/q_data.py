"""Registered queries: dataset building, splits, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from uipatterns.catalog import inputs as I
from uipatterns.catalog.registry import SQL_WS, bucket_sql, query
from uipatterns.operators import dataset as D
from uipatterns.operators import splits as P
from uipatterns.schema import LABELS

M, SPLIT = I.SQL_MICROCOPY, I.SQL_SPLIT


@query("d01_parse_templates",
       """SELECT p_partkey, p_name AS template, CASE WHEN p_size % 3 = 0 THEN 'scarcity|sneaking' ELSE '' END AS extra FROM part""")
def d01(spark, sf):
    raw = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, "||scarcity, ,sneaking ").otherwise(""))
    rows = D.parse_templates(I.table(spark, sf, "part").withColumn("raw", raw))
    return rows.select("p_partkey", "template", F.array_join("extra_labels", "|").alias("extra"))


def _templates(spark, sf):
    part = I.table(spark, sf, "part")
    text = F.concat(F.lit("Only {NUM} "), "p_name", F.when(F.col("p_size") % 2 == 0, " left at {SHOP} or {SHOP}").otherwise(" left"))
    return part.select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("template_id"), F.lit("en").alias("lang"), text.alias("template"))


def _slots(spark, sf):
    shops = I.table(spark, sf, "supplier").select(F.lit("SHOP").alias("slot"), F.col("s_suppkey").alias("value_no"), F.col("s_name").alias("value"))
    nums = I.table(spark, sf, "nation").select(F.lit("NUM").alias("slot"), F.col("n_nationkey").cast("bigint").alias("value_no"), F.col("n_nationkey").cast("string").alias("value"))
    return shops.unionByName(nums).withColumn("lang", F.lit("en"))


_TPL = """tpl AS (SELECT 't' || p_partkey AS template_id, p_name, p_size, k FROM part CROSS JOIN range(3) r(k)),
  ns AS (SELECT count(*) AS n FROM supplier), nn AS (SELECT count(*) AS n FROM nation),
  picks AS (SELECT *, {0} AS i0, {1} AS i1, {2} AS i2 FROM tpl CROSS JOIN ns CROSS JOIN (SELECT n AS m FROM nn)),
  filled AS (SELECT template_id, k AS variant, 'Only ' || i0 || ' ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' left at ' || a.s_name || ' or ' || b.s_name ELSE ' left' END AS text
  FROM picks JOIN supplier a ON a.s_suppkey = i1 JOIN supplier b ON b.s_suppkey = i2)""".format(
    bucket_sql("'13' || template_id || ':NUM/0:' || k", "m"), bucket_sql("'13' || template_id || ':SHOP/1:' || k", "n"),
    bucket_sql("'13' || template_id || ':SHOP/2:' || k", "n"))


@query("d02_fill_templates", "SELECT template_id, variant, text FROM filled", _TPL)
def d02(spark, sf):
    return D.fill_templates(_templates(spark, sf), _slots(spark, sf), 3).select("template_id", "variant", "text")


_ONE = "one AS (SELECT DISTINCT label, lang, text FROM microcopy), ranked AS (SELECT *, row_number() OVER (PARTITION BY label, lang ORDER BY md5('13' || text), lang, text) AS rn FROM one)"


def _taken(spark, sf):
    rows = I.microcopy(spark, sf).select("label", "lang", "text").distinct()
    targets = rows.select("label", "lang").distinct().withColumn("target", F.lit(60))
    return D.take_targets(rows, targets, ["label", "lang"], ["lang", "text", "label"])


@query("d03_take_targets", "SELECT label, lang, text FROM ranked WHERE rn <= 60", M, _ONE)
def d03(spark, sf):
    return _taken(spark, sf)[0].select("label", "lang", "text")


@query("d03_shortfalls", "SELECT label, lang, 60 AS target, count(*) AS got FROM one GROUP BY ALL HAVING count(*) < 60", M, _ONE)
def d03s(spark, sf):
    return _taken(spark, sf)[1]


def _ctx_sql(which):
    arms = []
    for label, pairs in D.CONTEXTS.items():
        values = "[" + ", ".join(f"'{p[which]}'" for p in pairs) + "]"
        arms.append(f"WHEN label = '{label}' THEN {values}[{bucket_sql(chr(39) + '13' + chr(39) + ' || text', str(len(pairs)))} + 1]")
    return "CASE " + " ".join(arms) + " END"


@query("d04_attach_context", f"SELECT row_id, {_ctx_sql(0)} AS tag, {_ctx_sql(1)} AS role FROM microcopy", M)
def d04(spark, sf):
    return D.attach_context(I.microcopy(spark, sf).select("row_id", "label", "text")).select("row_id", "tag", "role")


def _labelled(spark, sf):
    return I.microcopy(spark, sf).withColumns({
        "template_id": F.concat(F.lit("t"), F.col("template_id").cast("string")),
        "extra_labels": F.when(F.col("p_size") % 2 == 0, F.array(F.lit("scarcity"), F.col("label"))).otherwise(F.array().cast("array<string>"))})


def _overrides(spark):
    return spark.createDataFrame([("t8", "benign"), ("t13", "benign")], "template_id string, label string")


_LABELLED = """labelled AS (SELECT row_id, 't' || template_id AS template_id, text, lang, tag, role, CASE WHEN template_id IN (8, 13) THEN 'benign' ELSE label END AS primary_label,
  CASE WHEN template_id IN (8, 13) THEN 'benign' WHEN p_size % 2 = 0 AND label <> 'scarcity' THEN label || '|scarcity' ELSE label END AS labels FROM microcopy)"""


def _overridden(spark, sf):
    return D.apply_overrides(_labelled(spark, sf), _overrides(spark))


@query("d05_apply_overrides", "SELECT row_id, labels, primary_label FROM labelled", M, _LABELLED)
def d05(spark, sf):
    return _overridden(spark, sf).select("row_id", F.array_join("labels", "|").alias("labels"), "primary_label")


_Y = ", ".join(f"list_contains(string_split(labels, '|'), '{n}')::INT AS y_{n}" for n in LABELS)


@query("d06_one_hot", f"SELECT row_id, {_Y} FROM labelled", M, _LABELLED)
def d06(spark, sf):
    return D.one_hot(_overridden(spark, sf)).select("row_id", *[f"y_{n}" for n in LABELS])


@query("d06_labels_long", " UNION ALL ".join(f"SELECT row_id, '{n}' AS label, list_contains(string_split(labels, '|'), '{n}')::INT AS y FROM labelled" for n in LABELS), M, _LABELLED)
def d06l(spark, sf):
    return D.labels_long(d06(spark, sf), ["row_id"])


@query("d07_split_by_group",
       """SELECT doc_id, CASE max(r) WHEN 3 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS part FROM documents d JOIN (
          SELECT source, CASE WHEN rn <= greatest(2, round_even(n * 0.2, 0)) THEN 3 WHEN rn <= greatest(2, round_even(n * 0.2, 0)) + greatest(1, round_even(n * 0.15, 0)) THEN 2 ELSE 1 END AS r
          FROM (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY md5('14' || source), source) AS rn, count(*) OVER (PARTITION BY lang) AS n
          FROM (SELECT DISTINCT lang, source FROM documents))) a ON a.source = d.source GROUP BY doc_id""")
def d07(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return P.split_by_group(docs, ["lang"], "source", row_id=["doc_id"]).select("doc_id", "part")


@query("d08_split_random",
       """SELECT doc_id, CASE WHEN rn <= floor(n * 0.15) THEN 'test' WHEN rn <= 2 * floor(n * 0.15) THEN 'val' ELSE 'train' END AS part
          FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('15' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents)""")
def d08(spark, sf):
    return P.split_random(I.table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", "part")


def _hard(spark, sf):
    part = I.table(spark, sf, "part")
    return part.select(
        F.element_at(F.array(*[F.lit(n) for n in LABELS[:4]]), (F.col("p_partkey") % 4 + 1).cast("int")).alias("counterpart"), F.lit("en").alias("lang"),
        F.col("p_partkey").alias("idx"), F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" {NUM}"))).otherwise(F.col("p_name")).alias("template"),
        F.lit("button").alias("tag"), F.lower("p_type").alias("role"))


_HARD = """h0 AS (SELECT ['confirmshaming', 'false_urgency', 'forced_action', 'obstruction'][p_partkey % 4 + 1] AS counterpart, p_partkey, p_name, p_size, lower(p_type) AS role,
  'hardneg:' || ['confirmshaming', 'false_urgency', 'forced_action', 'obstruction'][p_partkey % 4 + 1] || ':en:' || CASE WHEN p_partkey < 10 THEN '0' || p_partkey ELSE p_partkey::VARCHAR END AS template_id FROM part),
h1 AS (SELECT counterpart, template_id, p_name || ' ' || ((('0x' || substr(md5('20' || template_id || ':NUM/0:' || k), 1, 8))::BIGINT) % (SELECT count(*) FROM nation)) AS text, 'button' AS tag, role
  FROM h0 CROSS JOIN range(4) r(k) WHERE p_size % 2 = 0
  UNION ALL SELECT counterpart, template_id, p_name, t, role FROM h0 CROSS JOIN (VALUES ('button'), ('a'), ('span'), ('div')) v(t) WHERE p_size % 2 = 1),
h2 AS (SELECT counterpart, text, tag, role, min(template_id) AS template_id FROM h1 GROUP BY ALL)"""


@query("d09_hard_negatives",
       "SELECT counterpart, text, tag, role, template_id, 'hard_negative_v2:' || counterpart AS source FROM h2 QUALIFY row_number() OVER (PARTITION BY counterpart ORDER BY md5('20' || text || tag), text, tag, role) <= 100", _HARD)
def d09(spark, sf):
    rows = D.hard_negatives(_hard(spark, sf), _slots(spark, sf), 100, 4)
    return rows.select("counterpart", "text", "tag", "role", "template_id", "source")


@query("d10_split_small_groups",
       """SELECT row_id, CASE WHEN rn <= nt THEN 'train' WHEN rn <= nt + nv THEN 'val' ELSE 'test' END AS part FROM microcopy m JOIN (
          SELECT template_id, rn, CASE WHEN n - v - t < 1 THEN greatest(1, n - 2) ELSE n - v - t END AS nt, CASE WHEN n - v - t < 1 THEN least(1, n - 1) ELSE v END AS nv FROM (
          SELECT *, greatest(1, round_even(n * 0.15, 0)) AS v, greatest(1, round_even(n * 0.25, 0)) AS t FROM (
          SELECT template_id, row_number() OVER (PARTITION BY label, lang ORDER BY md5('21' || template_id), template_id) AS rn, count(*) OVER (PARTITION BY label, lang) AS n
          FROM (SELECT DISTINCT label, lang, template_id FROM microcopy)))) a ON a.template_id = m.template_id""", M)
def d10(spark, sf):
    rows = I.microcopy(spark, sf).select("row_id", "label", "lang", "template_id")
    return P.split_small_groups(rows, ["label", "lang"], "template_id", row_id=["row_id"]).select("row_id", "part")


@query("d11_extend_split", "SELECT part, sum(n)::BIGINT AS n FROM (SELECT part, count(*) AS n FROM split_docs GROUP BY 1 UNION ALL SELECT 'train', count(*) FROM benchmark) GROUP BY 1", SPLIT)
def d11(spark, sf):
    old = I.split_docs(spark, sf).select(F.col("doc_id").alias("row_id"), "text", "part")
    new = I.table(spark, sf, "benchmark").select(F.col("item_id").alias("row_id"), "text", F.lit("train").alias("part"))
    return P.extend_split(old, new).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def _patched(spark, sf):
    rows = D.dataset_rows(_overridden(spark, sf), "synthetic_v1")
    patch = spark.createDataFrame([("t4", "benign"), ("t9", None), ("t25", "false_urgency")], "template_id string, new_label string")
    return D.patch_labels(rows, patch, "relabel_v2_1")


@query("d12_patch_labels",
       """SELECT template_id, text, CASE template_id WHEN 't4' THEN 'benign' WHEN 't25' THEN 'false_urgency' ELSE labels END AS labels,
          CASE template_id WHEN 't4' THEN 'benign' WHEN 't25' THEN 'false_urgency' ELSE primary_label END AS primary_label,
          CASE WHEN template_id IN ('t4', 't25') THEN 'synthetic_v1|relabel_v2_1' ELSE 'synthetic_v1' END AS source,
          CASE template_id WHEN 't4' THEN 1 WHEN 't25' THEN 0 ELSE list_contains(string_split(labels, '|'), 'benign')::INT END AS y_benign,
          CASE template_id WHEN 't4' THEN 0 WHEN 't25' THEN 0 ELSE list_contains(string_split(labels, '|'), 'scarcity')::INT END AS y_scarcity FROM labelled WHERE template_id <> 't9'""", M, _LABELLED)
def d12(spark, sf):
    return _patched(spark, sf)[0].select("template_id", "text", "labels", "primary_label", "source", "y_benign", "y_scarcity")


@query("d12_patch_counts", "SELECT template_id, count(*) FILTER (WHERE template_id <> 't9') AS relabelled, count(*) FILTER (WHERE template_id = 't9') AS dropped FROM labelled WHERE template_id IN ('t4', 't9', 't25') GROUP BY 1", M, _LABELLED)
def d12c(spark, sf):
    return _patched(spark, sf)[1]


def _pairs_sql(key):
    return f"""pairs AS (SELECT DISTINCT a.part AS part_a, b.part AS part_b, a.{key} AS k FROM split_docs a JOIN split_docs b ON a.{key} = b.{key}
      WHERE (a.part, b.part) IN (('train', 'val'), ('train', 'test'), ('val', 'test')))"""


@query("d13_shared_keys", "SELECT part_a, part_b, count(*) AS shared, min(k) AS example FROM pairs GROUP BY ALL", SPLIT, _pairs_sql("lang"))
def d13(spark, sf):
    return P.shared_keys(I.split_docs(spark, sf), "lang")


@query("d14_cross_part_duplicates", "SELECT part_a, part_b, md5(k) AS text_md5 FROM pairs", SPLIT, _pairs_sql("text"))
def d14(spark, sf):
    return P.cross_part_duplicates(I.split_docs(spark, sf)).select("part_a", "part_b", F.md5("text").alias("text_md5"))


_RANK = "CASE part WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END"


@query("d15_drop_cross_part", f"SELECT doc_id, part FROM split_docs QUALIFY {_RANK} = min({_RANK}) OVER (PARTITION BY text)", SPLIT)
def d15(spark, sf):
    return P.drop_cross_part(I.split_docs(spark, sf), ["doc_id"]).select("doc_id", "part")


@query("d16_describe_parts",
       """SELECT part, count(*) AS n_rows, count(DISTINCT template_id) AS templates, count(DISTINCT lang) AS langs, count(*) FILTER (WHERE y_quality + y_toxic > 1) AS multi_label,
          sum(y_quality)::BIGINT AS y_quality, sum(y_toxic)::BIGINT AS y_toxic FROM split_docs GROUP BY part""", SPLIT)
def d16(spark, sf):
    return P.describe_parts(I.split_docs(spark, sf))


@query("d17_pos_weights", "SELECT label, round(CASE WHEN sum(y) > 0 THEN (count(*) - sum(y))::DOUBLE / sum(y) ELSE 1 END, 6) AS pos_weight FROM scores GROUP BY label", I.SQL_SCORES)
def d17(spark, sf):
    return P.pos_weights(I.scores(spark, sf)).withColumn("pos_weight", F.round("pos_weight", 6))


_SUMS = ", ".join(f"sum(list_contains(string_split(labels, '|'), '{n}')::INT)::BIGINT AS y_{n}" for n in LABELS)


@query("d18_dataset_stats",
       f"""SELECT primary_label, lang, grouping(primary_label, lang) AS grouping, count(*) AS n_rows, count(*) FILTER (WHERE contains(labels, '|')) AS multi_label,
           count(DISTINCT template_id) AS templates, {_SUMS} FROM labelled GROUP BY GROUPING SETS ((primary_label), (lang), (primary_label, lang), ())""", M, _LABELLED)
def d18(spark, sf):
    return D.dataset_stats(D.dataset_rows(_overridden(spark, sf), "synthetic_v1"))


@query("d19_exclusive_vocab",
       f"""SELECT label, sum(n)::BIGINT AS occurrences, round(sum(CASE WHEN k = 1 THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS exclusive_mass FROM (
           SELECT word, label, n, count(*) OVER (PARTITION BY word) AS k FROM (SELECT word, label, count(*) AS n FROM (
           SELECT lang AS label, unnest(regexp_split_to_array(text, '{SQL_WS}')) AS word FROM documents) WHERE word <> '' GROUP BY ALL)) GROUP BY label""")
def d19(spark, sf):
    words = D.words_of(I.documents(spark, sf).select(F.col("lang").alias("label"), "text"), ["label"])
    return D.exclusive_vocab(words).withColumn("exclusive_mass", F.round("exclusive_mass", 6))


_CONCEPTS = {"sold": ["sold", "bought"], "fee": ["fee", "शुल्क"], "left": ["left", "stock"]}


@query("d20_concept_conflicts",
       "SELECT *, count(*) OVER (PARTITION BY concept) AS label_sets FROM (" + " UNION ALL ".join(
           f"SELECT '{c}' AS concept, labels AS label_set, count(*) AS n FROM (SELECT text, array_to_string(list_sort(string_split(labels, '|')), '|') AS labels FROM labelled) WHERE "
           + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + " GROUP BY ALL" for c, ws in _CONCEPTS.items())
       + ") QUALIFY count(*) OVER (PARTITION BY concept) > 1", M, _LABELLED)
def d20(spark, sf):
    return D.concept_conflicts(_overridden(spark, sf).select("text", "labels"), _CONCEPTS)


@query("d21_role_vocabulary", "SELECT DISTINCT trim(role) AS role FROM microcopy WHERE trim(role) <> ''", M)
def d21(spark, sf):
    return D.role_vocabulary(I.microcopy(spark, sf))
