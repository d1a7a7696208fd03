"""Inputs the registered queries derive from the given tables.

Each input exists twice: as a DataFrame and as SQL for the other engine.  Both
read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uipatterns.session import work_tasks
from uipatterns.sources.tables import read_spread

# Template bank: i, template, lang, tag, role, field, step, label.
BANK = [
    (0, "Only {N} left", "en", "span", "stock", "stock", "product", "scarcity"),
    (1, "{N} units in stock", "en", "span", "stock", "unknown", "product", "benign"),
    (2, "{N} sold", "en", "span", "body", "sold_count", "product", "benign"),
    (3, "केवल {N} बाँकी", "ne", "span", "stock", "unknown", "product", "scarcity"),
    (4, "{N} people are viewing this", "en", "span", "toast", "unknown", "product", "social_proof"),
    (5, "{N} verified reviews", "en", "p", "badge", "unknown", "product", "benign"),
    (6, "{N} जना हेरिरहेका छन्", "ne", "span", "toast", "unknown", "product", "social_proof"),
    (7, "{N} लोग देख रहे हैं", "hi", "span", "toast", "unknown", "product", "social_proof"),
    (8, "{N} people bought this in the last {N} hours", "en", "span", "toast", "unknown", "product", "social_proof"),
    (9, "Bestseller, {N} sold this week", "en", "p", "badge", "sold_count", "product", "benign"),
    (10, "पिछले {N} घंटों में {N} लोगों ने खरीदा", "hi", "span", "toast", "unknown", "product", "social_proof"),
    (11, "गत {N} घण्टामा {N} जनाले किने", "ne", "span", "toast", "unknown", "product", "social_proof"),
    (12, "-{N}%", "en", "span", "promo", "discount", "product", "false_urgency"),
    (13, "{N}% off today", "en", "span", "promo", "discount", "product", "false_urgency"),
    (14, "{N}% of customers agree", "en", "p", "body", "unknown", "product", "benign"),
    (15, "Service fee Rs. {P}", "en", "span", "line_item", "price", "payment", "sneaking"),
    (16, "Service fee Rs. {P}", "en", "span", "line_item", "price", "cart", "benign"),
    (17, "सेवा शुल्क {P}", "hi", "span", "line_item", "unknown", "payment", "sneaking"),
    (18, "You must register to continue", "en", "p", "modal_text", "unknown", "cart", "forced_action"),
    (19, "Register for news", "en", "p", "modal_text", "unknown", "cart", "benign"),
    (20, "जारी राख्न दर्ता गर्नुहोस्", "ne", "p", "form_gate", "unknown", "cart", "forced_action"),
    (21, "Noise Cancelling {T}", "en", "a", "body", "title", "product", "benign"),
    (22, "Cancel order", "en", "a", "decline", "unknown", "cart", "obstruction"),
    (23, "cancelé {T}", "en", "p", "body", "unknown", "product", "benign"),
    (24, "Hot {T} Limited Stock Offer", "en", "a", "body", "title", "product", "benign"),
    (25, "Limited stock", "en", "span", "stock", "stock", "product", "scarcity"),
    (26, "Order {N}, call 0123456789", "en", "p", "body", "personal", "product", "benign"),
    (27, "buyer{N}@example.com", "en", "p", "body", "personal", "product", "benign"),
    (28, "Rated 4.5 out of 5", "en", "span", "body", "rating", "product", "benign"),
    (29, "Selling fast", "en", "span", "badge", "unknown", "product", "social_proof"),
    (30, "Card 4000 1111 2222 3333", "en", "p", "body", "personal", "payment", "benign"),
    (31, "Save {N}% now", "en", "span", "promo", "unknown", "product", "false_urgency"),
]
BANK_COLUMNS = ["i", "template", "lang", "tag", "role", "field", "step", "label"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_spread(spark, f"{sf_dir}/pages.parquet", "page_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_spread(spark, f"{sf_dir}/documents.parquet", "doc_id")


def microcopy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` rows as short interface texts, one of 32 templates each."""
    bank = spark.createDataFrame(BANK, "i int, " + ", ".join(f"{c} string" for c in BANK_COLUMNS[1:]))
    part = table(spark, sf_dir, "part")
    text = F.replace("template", F.lit("{N}"), F.col("p_size").cast("string"))
    text = F.replace(text, F.lit("{P}"), F.floor("p_retailprice").cast("bigint").cast("string"))
    text = F.replace(text, F.lit("{T}"), F.col("p_name"))
    # The bank has 32 rows, whatever the size of ``part``.
    return part.withColumn("i", (F.col("p_partkey") % 32).cast("int")).join(F.broadcast(bank), "i").select(
        (F.col("p_partkey") * 100 + F.col("i")).alias("row_id"), F.col("i").alias("template_id"), "label", "lang", "tag",
        "role", "field", "step", text.alias("text"), "template", "p_partkey", "p_size", "p_retailprice", "p_name", "p_type")


_VALUES = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in BANK)
SQL_MICROCOPY = f"""bank AS (SELECT * FROM (VALUES {_VALUES}) AS t({', '.join(BANK_COLUMNS)})),
microcopy AS (SELECT p_partkey * 100 + i AS row_id, i AS template_id, label, lang, tag, role, field, step,
  replace(replace(replace(template, '{{N}}', CAST(p_size AS VARCHAR)), '{{P}}',
    CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR)), '{{T}}', p_name) AS text,
  template, p_partkey, p_size, p_retailprice, p_name, p_type
  FROM part JOIN bank ON p_partkey % 32 = i)"""


def _page_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Pages are few bytes and much work each, so the number of partitions is set instead of left to
    their size, and grows with ``part``: a task parses at most about 200 pages of 32 parts."""
    return max(work_tasks(spark), -(-table(spark, sf_dir, "part").count() // 6_400))


def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as product listings: one HTML page per 32 parts, one card per part."""
    rows = microcopy(spark, sf_dir)
    k = F.col("p_partkey").cast("string")
    clock = F.format_string("09:%02d", F.col("p_size") % 60)
    card = F.concat(
        F.lit('<li class="card item-'), k, F.lit('"><a href="/p/'), k, F.lit('"><b>'), "p_name", F.lit(" "), "p_type", F.lit(" no "), k,
        F.lit('</b></a><s>Rs. '), F.floor("p_retailprice").cast("string"), F.lit('</s><div class="'), F.translate("role", "_", "-"),
        F.lit('"><span>'), "text", F.lit("</span></div><time>Ends in<span>"), clock, F.lit("</span></time></li>"))
    page = F.floor(F.col("p_partkey") / 32)
    # At most 32 cards make a page.
    return rows.withColumn("page_id", page).repartition(_page_tasks(spark, sf_dir), "page_id").groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("card")))), lambda x: x["card"]), "")
        .alias("cards")
    ).select(
        "page_id", F.concat(F.lit("https://shop.example/checkout/"), F.col("page_id").cast("string")).alias("url"),
        F.concat(F.lit('<!DOCTYPE html><html lang="en"><head><title>Shop</title></head><body><h1>Our offers</h1><ul>'), "cards",
                 F.lit("</ul></body></html>")).alias("html"))


def part_pages(spark: SparkSession, sf_dir: str, forms: list[str], depth: int = 0) -> DataFrame:
    """One HTML page per 32 parts.  Part k is shown in form k % len(forms), where # stands for its name and number."""
    p = table(spark, sf_dir, "part")
    shape = F.get(F.array(*[F.lit(f) for f in forms]), (F.col("p_partkey") % len(forms)).cast("int"))
    item = F.concat(F.lit("<li>" + "<div>" * depth), F.replace(shape, F.lit("#"), F.concat("p_name", F.lit(" no "), F.col("p_partkey").cast("string"))), F.lit("</div>" * depth + "</li>"))
    return p.withColumn("page_id", F.floor(F.col("p_partkey") / 32)).repartition(_page_tasks(spark, sf_dir), "page_id").groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))), lambda x: x["item"]), "").alias("items")
    ).select("page_id", F.lit("https://shop.example/list").alias("url"),
             F.concat(F.lit('<html lang="en"><body><ul>'), "items", F.lit("</ul></body></html>")).alias("html"))


_CHUNK = "</?([a-zA-Z][a-zA-Z0-9]*)[^>]*>([^<]+)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text between two tags of ``pages``, whole, with the tag before it, in order of appearance."""
    found = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(_CHUNK), F.lit(g)).alias(n) for g, n in ((1, "tag"), (2, "text"))])
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("n", "c")).select(
        "page_id", (F.col("n") + 1).cast("bigint").alias("n"), "c.tag", "c.text")


SQL_CHUNKS = f"""chunks AS (SELECT page_id, generate_subscripts(t, 1) AS n, unnest(t) AS tag, unnest(x) AS text
  FROM (SELECT page_id, regexp_extract_all(html, '{_CHUNK}', 1) AS t, regexp_extract_all(html, '{_CHUNK}', 2) AS x FROM pages))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labels per labelled document with a score and a flat prediction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    long = table(spark, sf_dir, "labels").select("doc_id", F.inline(F.array(
        F.struct(F.lit("quality").alias("label"), F.col("quality").cast("int").alias("y")),
        F.struct(F.lit("toxic").alias("label"), F.col("toxic").cast("int").alias("y")))))
    noise = ((F.col("doc_id") * 37 + F.col("n_chars")) % 1000) / 1000.0 * 0.6
    prob = F.least(F.lit(0.999), noise + 0.35 * F.col("y").cast("double"))
    return long.join(docs, "doc_id").select(
        F.col("doc_id").alias("row_id"), "label", "y", prob.alias("prob"), (prob >= 0.5).cast("int").alias("p"), "lang", "source")


SQL_SCORES = """scores0 AS (SELECT d.doc_id AS row_id, label, y,
  least(0.999::DOUBLE, ((d.doc_id * 37 + n_chars) % 1000)::DOUBLE / 1000.0::DOUBLE * 0.6::DOUBLE + 0.35::DOUBLE * y::DOUBLE) AS prob,
  lang, source
  FROM (SELECT doc_id, 'quality' AS label, quality AS y FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) l
  JOIN documents d ON d.doc_id = l.doc_id),
scores AS (SELECT *, (prob >= 0.5::DOUBLE)::INT AS p FROM scores0)"""


def tenfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings.label`` one-hot over ten classes; every third row predicts another."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("truth"))
    pred = F.when(F.col("row_id") % 3 == 0, (F.col("row_id") * 7) % 10).otherwise(F.col("truth"))
    return e.withColumn("pred", pred).select("row_id", "truth", "pred", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("c")).select(
        "row_id", F.concat(F.lit("c"), "c").alias("label"), (F.col("truth") == F.col("c")).cast("int").alias("y"),
        (F.col("pred") == F.col("c")).cast("int").alias("p"), F.concat(F.lit("g"), (F.col("row_id") % 4).cast("string")).alias("lang"))


SQL_TENFOLD = """tenfold AS (SELECT vec_id AS row_id, 'c' || c AS label, (label = c)::INT AS y,
  ((CASE WHEN vec_id % 3 = 0 THEN (vec_id * 7) % 10 ELSE label END) = c)::INT AS p, 'g' || (vec_id % 4) AS lang
  FROM embeddings CROSS JOIN range(10) r(c))"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings of a changing text; errors show a text without digits."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("value").cast("string")).alias("text"))


SQL_OBSERVATIONS = """observations AS (SELECT user_id AS key, ts,
  CASE WHEN event_type = 'error' THEN event_type ELSE CAST(value AS VARCHAR) END AS text FROM events)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as trace entries."""
    c = table(spark, sf_dir, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 3
    names = F.when(kind == 1, F.array().cast("array<string>")).when(
        kind == 2, F.when(F.col("turn") % 2 == 0, F.array(F.lit("scarcity"))).otherwise(F.array(F.lit("scarcity"), F.lit("sneaking"))))
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.lit("span").alias("tag"), "role",
        F.when(F.col("turn") == 0, F.array(F.lit("stock_counter"))).otherwise(F.array().cast("array<string>")).alias("ruleHits"),
        (F.col("turn") % 2 == 0).alias("sentToModel"), names.alias("findingLabels"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("conv_id").alias("scan_no"),
        F.concat(F.lit("https://shop"), (F.col("conv_id") % 5).cast("string"), F.lit(".example/p/"), F.col("conv_id").cast("string"),
                 F.lit("?q=1")).alias("url"))


SQL_ENTRIES = """entries AS (SELECT conv_id || '-' || turn AS id, text, 'span' AS tag, role,
  CASE WHEN turn = 0 THEN ['stock_counter'] ELSE []::VARCHAR[] END AS "ruleHits", turn % 2 = 0 AS "sentToModel",
  CASE (conv_id + turn) % 3 WHEN 1 THEN []::VARCHAR[]
    WHEN 2 THEN CASE WHEN turn % 2 = 0 THEN ['scarcity'] ELSE ['scarcity', 'sneaking'] END END AS "findingLabels",
  conv_id * 1000 + turn AS seq, conv_id AS scan_no,
  'https://shop' || (conv_id % 5) || '.example/p/' || conv_id || '?q=1' AS url FROM conversations)"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a scan captured twice; the second capture has all entries."""
    e = entries(spark, sf_dir)
    version = F.explode(F.array(F.lit(1), F.lit(2)))
    rows = e.withColumn("version", version).filter((F.col("version") == 2) | F.col("sentToModel"))
    packed = F.struct("seq", "id", "text", "tag", "role", "ruleHits", "sentToModel", "findingLabels")
    return rows.groupBy("scan_no", "url", "version").agg(F.array_sort(F.collect_list(packed)).alias("entries")).select(
        F.concat(F.lit("scan-"), F.col("scan_no").cast("string")).alias("scan_id"), "url",
        (F.col("scan_no") % 101).cast("int").alias("page_score"), "entries",
        F.timestamp_seconds(F.lit(1704067200) + F.col("scan_no") * 3600 + F.col("version") * 60).alias("captured_at"))


SQL_CAPTURES = SQL_ENTRIES + """,
captures AS (SELECT 'scan-' || scan_no AS scan_id, url, (scan_no % 101)::INT AS page_score,
  list({'id': id, 'seq': seq, 'labels': "findingLabels"} ORDER BY seq) AS entries,
  1704067200 + scan_no * 3600 + version * 60 AS captured_s
  FROM entries CROSS JOIN (VALUES (1), (2)) v(version) WHERE version = 2 OR "sentToModel" GROUP BY scan_no, url, version)"""


def split_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a part and two label columns."""
    part = F.when(F.col("doc_id") % 20 < 3, "test").when(F.col("doc_id") % 20 < 6, "val").otherwise("train")
    marks = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "documents").join(marks, "doc_id", "left").select(
        "doc_id", "text", "lang", "source", part.alias("part"), F.coalesce("quality", F.lit(0)).alias("y_quality"),
        F.coalesce("toxic", F.lit(0)).alias("y_toxic"), F.col("source").alias("template_id"))


SQL_SPLIT = """split_docs AS (SELECT d.doc_id, text, lang, source,
  CASE WHEN d.doc_id % 20 < 3 THEN 'test' WHEN d.doc_id % 20 < 6 THEN 'val' ELSE 'train' END AS part,
  coalesce(quality, 0) AS y_quality, coalesce(toxic, 0) AS y_toxic, source AS template_id
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
