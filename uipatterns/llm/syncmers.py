"""Document fingerprints by closed syncmers, in DataFrame functions only.

A text's symbols are its words; a word of more than 32 bytes is cut, into
ideographs and kana by themselves and runs of others.  A k-mer of symbols is an anchor if the smallest of its inner
s-mers, by hash, is its first or its last.  That depends on nothing outside
the k-mer, so an edit touches only the anchors that overlap it.  The text is
padded, so its first and last words are in anchors too and a text of one word
has some.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uipatterns.llm.common import shared_folder, written

LONG_WORD = 32
#: What a long word is cut into: one ideograph or kana, or up to 32 other characters.
SYMBOL = r"[぀-ヿ㐀-鿿]|[^぀-ヿ㐀-鿿]{1,32}"
#: Hash of the padding: above all others, so an s-mer that holds it is the smallest of none.
PAD = 2 ** 63 - 1


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, also where lambdas use it."""
    return F.transform(F.array(value), then)[0]


def anchors(text: Column, k: int = 5, s: int = 2) -> Column:
    """The closed syncmers of a text: array of (hash of 48 bits, place of the first symbol)."""
    def cut(found: Column) -> Column:
        parts = F.flatten(F.transform(found, lambda w: F.when(
            F.octet_length(w) > LONG_WORD, F.regexp_extract_all(w, F.lit(SYMBOL), F.lit(0))).otherwise(F.array(w))))
        return F.when(F.exists(found, lambda w: F.octet_length(w) > LONG_WORD), parts).otherwise(found)

    # No word is empty but for white space at either end.
    found = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: F.octet_length(w) > 0)
    words = F.transform(let(found, cut), lambda w: F.xxhash64(w))
    pad = F.array_repeat(F.lit(PAD), k - 1)

    def inner(a: Column, i: Column) -> Column:
        part = [F.get(a, i + j) for j in range(s)]
        return F.when(F.greatest(*part) == PAD, F.lit(PAD)).otherwise(F.xxhash64(*part))

    def closed(b: Column, i: Column) -> Column:
        part = [F.get(b, i + j) for j in range(k - s + 1)]
        return F.least(part[0], part[-1]) <= F.least(*part[1:-1]) if len(part) > 3 else F.least(part[0], part[-1]) <= part[1]

    def named(a: Column, i: Column) -> Column:
        name = F.xxhash64(*[F.get(a, i + j) for j in range(k)]).bitwiseAND(F.lit(2 ** 48 - 1))
        return F.named_struct(F.lit("h"), name, F.lit("at"), i)

    def chosen(a: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(a) - k)
        return let(F.transform(a, lambda _, i: inner(a, i)),
                   lambda b: F.transform(F.filter(places, lambda i: closed(b, i)), lambda i: named(a, i)))

    none = F.array().cast("array<struct<h:bigint,at:int>>")
    return let(words, lambda w: F.when(F.size(w) > 0, let(F.concat(pad, w, pad), chosen)).otherwise(none))


def fingerprint(text: Column, size: int = 64, k: int = 5, s: int = 2) -> Column:
    """The ``size`` anchors of smallest hash, each once at its first place: "hash:place hash:place ...".

    A null text has the fingerprint of an empty one, the empty string.
    """
    found = let(F.array_sort(anchors(F.coalesce(text, F.lit("")), k, s)), lambda a: F.slice(
        F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["h"] != x["h"])), 1, size))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.lpad(F.lower(F.hex(x["h"])), 12, "0"), x["at"].cast("string"))), " ")


def likeness(one: Column, other: Column, size: int = 64) -> Column:
    """How alike two fingerprints are, 0 to 1: positional matching of their anchors.

    Of the ``size`` smallest hashes of both together, the share that both hold
    at places that agree: the shift between the two places is that of the
    matched anchor before or behind (if either has one anchor alone, its match
    counts).  Two empty fingerprints are alike.
    """
    def parsed(text: Column) -> Column:
        parts = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))
        return F.transform(parts, lambda p: F.named_struct(F.lit("h"), F.substring(p, 1, 12), F.lit("at"), F.substring(p, 14, 12).cast("int")))

    def hashes(a: Column) -> Column:
        return F.transform(a, lambda x: x["h"])

    def share(m: Column, alone: Column, u: Column) -> Column:
        agree = F.filter(m, lambda x, i: alone | F.coalesce(x["shift"] == F.get(m, i - 1)["shift"], F.lit(False))
                         | F.coalesce(x["shift"] == F.get(m, i + 1)["shift"], F.lit(False)))
        return F.size(agree).cast("double") / F.size(u)

    def matched(a: Column, b: Column, held: Column) -> Column:
        both = [F.filter(x, lambda y: F.array_contains(held, y["h"])) for x in (a, b)]  # each in order of hash
        return F.array_sort(F.zip_with(*both, lambda x, y: F.named_struct(F.lit("at"), x["at"], F.lit("shift"), x["at"] - y["at"])))

    def compare(a: Column, b: Column) -> Column:
        def of(ha: Column, hb: Column) -> Column:
            alone = F.least(F.size(a), F.size(b)) == 1
            smallest = F.slice(F.array_sort(F.array_union(ha, hb)), 1, size)
            return let(smallest, lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
                let(F.array_intersect(F.array_intersect(ha, hb), u), lambda held: let(
                    matched(a, b, held), lambda m: share(m, alone, u)))))

        return let(hashes(a), lambda ha: let(hashes(b), lambda hb: of(ha, hb)))

    return let(parsed(one), lambda a: let(parsed(other), lambda b: compare(a, b)))


def order_chain(rows: DataFrame, folder: str, chunk_rows: int = 1_000_000) -> DataFrame:
    """Of each row (key, mark, id, n) the row before it by descending id, and of the first the last: (key, mark, before).

    Range partitions are chunks, written so that they stay what they are.  A
    window follows the order within a chunk; across the edges goes one row per
    chunk.  Null ids come last, rows of one id in order of ``mark``.
    """
    spark = rows.sparkSession
    rows = written(rows, folder, "ids")
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // chunk_rows))
    order = [F.desc_nulls_last("id"), F.asc("mark"), F.asc("key")]
    placed = written(rows.repartitionByRange(chunks, *order).withColumn("chunk", F.spark_partition_id()), folder, "chunks")
    me = F.struct("key", "mark", "n")
    inside = Window.partitionBy("chunk").orderBy(*order)
    last = placed.withColumn("me", me).withColumn("p", F.row_number().over(inside)).groupBy("chunk").agg(F.max_by("me", "p").alias("tail"))
    # as many rows as chunks
    over = Window.orderBy("chunk")
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tails = last.select("chunk", F.coalesce(F.lag("tail").over(over), F.last("tail").over(whole)).alias("tail_before"))
    return placed.withColumn("before", F.lag(me).over(inside)).join(tails, "chunk").select(
        "key", "mark", F.coalesce("before", "tail_before").alias("before"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 64, k: int = 5, s: int = 2) -> DataFrame:
    """Fingerprint every whole text and an edited one, and compare.

    The edited text has its last third (n_chars // 3 code points) replaced by
    the first as many, or all, of the next document; next is by descending id,
    after the last the first.  Returns the id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited (likeness of the two) and
    near_next (likeness to the next document's).

    A text moves once, by its key; the beginning that the document before it
    needs, and its fingerprint, once more.  Order is found over ids alone.

    Null text: empty; its fingerprint is the empty string, as alike to other
    empty ones as can be.  Null id: after all others.  Rows that share an id:
    in order of a hash of the text.  Rows equal in id and text are one
    document, and each comes back.  A single document follows itself.  Empty
    table: empty result.  A text is held as a whole, with about a hundred
    bytes a word.
    """
    folder = shared_folder(docs.sparkSession, "syncmers")
    key = F.when(F.col(id_col).isNull(), "none").otherwise(F.concat(F.lit(":"), F.col(id_col).cast("string")))
    given = docs.select(key.alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    given = given.withColumn("mark", F.xxhash64("text"))
    chain = order_chain(given.groupBy("key", "mark").agg(F.max("id").alias("id"), F.max(F.length("text")).alias("n")), folder)
    chain = written(chain, folder, "chain")
    # One aggregate of all that both sides of the join below read: then they share its shuffle, and a text moves once.
    rows = given.groupBy("key", "mark").agg(F.max(F.struct("id", "text")).alias("row"), F.count(F.lit(1)).alias("copies")).filter("copies > 0")
    rows = rows.select("key", "mark", "copies", "row.id", "row.text").join(chain, ["key", "mark"])
    gives = rows.select(
        F.col("before.key").alias("key"), F.col("before.mark").alias("mark"),
        F.substring("text", F.lit(1), F.floor(F.col("before.n") / 3).cast("int")).alias("start"), fingerprint(F.col("text"), size, k, s).alias("next"))
    n = F.length("text")
    kept = F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int"))
    both = rows.join(gives, ["key", "mark"]).select(
        "id", "copies", n.cast("long").alias("n_chars"), fingerprint(F.col("text"), size, k, s).alias("fingerprint"),
        F.concat(kept, F.col("start")).alias("edited"), "next")
    both = both.withColumn("edited_fingerprint", fingerprint(F.col("edited"), size, k, s))
    out = both.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), size).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next"), size).alias("near_next"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")
