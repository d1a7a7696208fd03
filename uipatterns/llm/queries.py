"""Registered queries of the operators, with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uipatterns.llm import ann, chat, divergence, mixing, neardup, packing, quality, ranked, substring, syncmers, tokens, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e, row_number() OVER () AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, e, min(n) AS n FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id, e),
p AS (SELECT q.n, q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS "rank", vec_id, score FROM p)
SELECT * FROM r WHERE "rank" <= 20"""


@query("op1_exact_top_k", TOPK_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
x AS (SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s FROM u),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS later FROM x WHERE p + 19 <= n),
c AS (SELECT x.doc_id, x.p, x.word, coalesce(bool_or(f.later) OVER (PARTITION BY x.doc_id ORDER BY x.p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM x LEFT JOIN f ON x.doc_id = f.doc_id AND x.p = f.p),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


@query("op2_substring_dedup", REPEATS_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS of_text FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([5.0::DOUBLE, 2.0, 1.0], 1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3) AS weight,
  row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
c AS (SELECT *, row_number() OVER o AS need,
  (1.5 * sum(source_size) OVER ()::DOUBLE - 2.0 * (sum(source_size) OVER o - source_size)::DOUBLE)
    / (sum(weight) OVER () - sum(weight) OVER o + weight) AS before
  FROM w WINDOW o AS (ORDER BY source_size / weight, place ROWS UNBOUNDED PRECEDING)),
l AS (SELECT min_by(before, need) AS level FROM c WHERE NOT 2.0 * source_size <= before * weight),
t AS (SELECT source, source_size, CASE WHEN 2.0 * source_size <= before * weight OR level IS NULL
  THEN 2.0 * source_size ELSE level * weight END::DOUBLE AS target FROM c, l),
r AS (SELECT doc_id, of_text, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END::DOUBLE AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT
  + (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || of_text), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate))::BIGINT) AS taken
FROM r"""


@query("op3_mixing", MIX_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The text's digest goes into the join with the sources, the text doesn't.
    docs = table(spark, sf_dir, "documents").withColumn("of_text", F.md5(F.coalesce("text", F.lit(""))))
    plan = mixing.repetition_plan(docs, also=F.col("of_text"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op4_token_output")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    read = tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=0, escape=False)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS learned,
  sum(23 + length(regexp_replace(role, '([\\<\[])', '\1\\', 'g')) + length(regexp_replace(text, '([\\<\[])', '\1\\', 'g'))) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars FROM g"""


@query("op6_chat_format", CHAT_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    out = chat.format_trees(chat.as_trees(given.unionByName(extra)))
    read = out.select("tree", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN t ON p.payload_digest = t.payload_digest AND payload_bytes >= 1000"""


@query("op7_warc", WARC_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_ann_search")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@query("op9_minhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


RANKED_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS c, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, 75 + (25 * len(w) * c) // l AS m FROM d, s WHERE len(w) > 0),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
e AS (SELECT term, floor(1000 * ln((2 * c + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM f, s GROUP BY term, c),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
x AS (SELECT item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM i JOIN f USING (term) JOIN e USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS "rank", doc_id, score FROM x WHERE score > 0)
SELECT * FROM o WHERE "rank" <= 20"""


@query("op11_ranked_search", RANKED_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM u GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM u SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(total)::BIGINT + count(*) AS whole FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p,
    1 + (1000000000 * (k.total + 1)) // v.whole AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS "rank" FROM x)
SELECT * FROM o WHERE part = 'pair' OR "rank" <= 200"""


@query("op12_source_divergence", DIVERGENCE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


@query("op13_document_fingerprints")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edits(table(spark, sf_dir, "documents"))
