"""Near duplicates by min-max hashing of word shingles, confirmed on full sets."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uipatterns.llm.common import by_value, components, fresh, shared_folder, text_key, written

by_value(__name__)

_MIX, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SIGNED = "doc_id long, tk long, n_shingles long, sh binary, sig array<int>, bands array<long>"


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit names of the distinct word shingles; a shorter text is one shingle, no words give none."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z only, and just these spaces
    names = word_names(found)
    n = len(names)
    if not n:
        return names
    width = min(words, n)
    run = mix64(names[:n - width + 1])
    for j in range(1, width):
        run = mix64(run * _FOLD + names[j:n - width + 1 + j])
    return np.unique(run)


def multipliers(permutations: int) -> np.ndarray:
    return mix64(np.arange(1, permutations + 1, dtype=np.uint64) * _FOLD) | np.uint64(1)


def min_max(shingles: np.ndarray, factors: np.ndarray, chunk: int = 8_192) -> np.ndarray:
    """Smallest and largest value of every permutation, side by side: two signature values for one evaluation."""
    low = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    high = np.zeros(len(factors), np.uint32)
    for at in range(0, len(shingles), chunk):
        values = ((factors[:, None] * shingles[None, at:at + chunk]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def band_names(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit name per band of ``rows`` signature values; the band's number is part of it."""
    table = sig.reshape(-1, rows).astype(np.uint64)
    run = mix64(np.arange(1, len(table) + 1, dtype=np.uint64) * _FOLD)
    for j in range(rows):
        run = mix64(run * _FOLD + table[:, j])
    return run.view(np.int64)


def _sign(batches, words: int, permutations: int, rows: int, schema: pa.Schema):
    factors = multipliers(permutations)
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            part = batch.slice(at, 2_000)
            count, name, sig, bands = [], [], [], []
            for text in part.column("text"):
                s = shingle_set(text.as_py(), words)
                count.append(len(s))
                name.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    values = min_max(s, factors)
                    sig.append(values.view(np.int32))
                    bands.append(band_names(values, rows))
                else:
                    sig.append(np.empty(0, np.int32))
                    bands.append(np.empty(0, np.int64))
            cols = [part.column("doc_id"), part.column("tk"), pa.array(count, pa.int64()), pa.array(name, pa.binary()),
                    pa.array(sig, pa.list_(pa.int32())), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)


def signatures(docs: DataFrame, words: int, permutations: int, rows: int) -> DataFrame:
    """doc_id, tk, n_shingles, sh (name of the set), sig, bands of every row (doc_id, tk, text)."""
    def run(batches):

        yield from _sign(batches, words, permutations, rows, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("n_shingles", pa.int64()), ("sh", pa.binary()),
                        ("sig", pa.list_(pa.int32())), ("bands", pa.list_(pa.int64()))])
    return docs.mapInArrow(run, SIGNED)


def _sets(batches, words: int, schema: pa.Schema):
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            part = batch.slice(at, 2_000)
            made = [shingle_set(t.as_py(), words).tobytes() for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("sh").cast(pa.binary()), pa.array(made, pa.binary())], schema=schema)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """sh and the packed sorted shingle names of rows (sh, text)."""
    schema = pa.schema([("sh", pa.binary()), ("shingles", pa.binary())])
    return docs.mapInArrow(lambda batches: _sets(batches, words, schema), "sh binary, shingles binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """percent or more of the union is shared, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _find(up: dict, x):
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def _confirm_star(members: pd.DataFrame, centre: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Members of a chunk that are linked with the chunk's one centre."""
    out = {"u": [], "v": []}
    if len(members) and len(centre):
        s = np.frombuffer(centre["shingles"].iloc[0], np.uint64)
        for sh, raw in zip(members["sh"], members["shingles"]):
            if linked(np.frombuffer(raw, np.uint64), s, percent):
                out["u"].append(sh)
                out["v"].append(centre["p"].iloc[0])
    return pd.DataFrame(out, columns=["u", "v"])


def _alike(a: np.ndarray, b: np.ndarray, least: int, chunk: int = 64) -> np.ndarray:
    """Pairs of rows of two signature tables that agree in ``least`` values or more."""
    hits = [np.argwhere((a[at:at + chunk, None, :] == b[None, :, :]).sum(axis=2) >= least) + [at, 0] for at in range(0, len(a), chunk)]
    return np.concatenate(hits) if hits else np.empty((0, 2), np.int64)


def _sift_cell(left: pd.DataFrame, right: pd.DataFrame, least: int, percent: int) -> pd.DataFrame:
    """Rows of a cell that have a partner of another component which their signatures don't rule out."""
    out = pd.DataFrame({"bucket": [], "i": [], "j": [], "side": [], "sh": [], "comp": []})
    if not len(left) or not len(right):
        return out
    pairs = _alike(np.stack(left["sig"].to_numpy()), np.stack(right["sig"].to_numpy()), least)
    lc, rc = left["comp"].to_numpy(), right["comp"].to_numpy()
    ln, rn = left["n"].to_numpy(), right["n"].to_numpy()
    a, b = pairs[:, 0], pairs[:, 1]
    small, large = np.minimum(ln[a], rn[b]), np.maximum(ln[a], rn[b])
    pairs = pairs[(lc[a] != rc[b]) & (100 * small >= percent * large)]
    parts = []
    for side, frame, which in ((0, left, np.unique(pairs[:, 0])), (1, right, np.unique(pairs[:, 1]))):
        parts.append(frame.iloc[which][["bucket", "i", "j", "sh", "comp"]].assign(side=side))
    return pd.concat(parts)[list(out.columns)]


def _confirm_cell(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that join components within a cell, each confirmed on the full sets; what is joined already is skipped."""
    left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
    up = {c: c for c in rows["comp"]}
    sets = {sh: np.frombuffer(raw, np.uint64) for sh, raw in zip(rows["sh"], rows["shingles"])}
    out = {"u": [], "v": []}
    for a, ca in zip(left["sh"], left["comp"]):
        for b, cb in zip(right["sh"], right["comp"]):
            ra, rb = _find(up, ca), _find(up, cb)
            small, large = sorted((len(sets[a]), len(sets[b])))
            if ra != rb and 100 * small >= percent * large and linked(sets[a], sets[b], percent):
                up[max(ra, rb)] = min(ra, rb)
                out["u"].append(a)
                out["v"].append(b)
    return pd.DataFrame(out, columns=["u", "v"])


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
    permutations: int = 48, rows: int = 4, chunk: int = 256, folder: str | None = None,
) -> DataFrame:
    """(id, tk, n_shingles, component_id, kept, label): the near-duplicate class of every row.

    Rows are linked if their sets of ``words``-word shingles (A-Z in lower
    case) share ``percent`` % of their union or more; classes are the
    connected components, ``component_id`` the smallest id in them.  Unrelated
    classes whose rows share ids (or have none) can have one ``component_id``;
    ``label`` names the class itself.

    1. One pass signs every row: each of ``permutations`` hash functions gives
       its minimum and its maximum, so 48 evaluations make 96 values, in 24
       bands of 4.  A pair at 85 % misses all bands with probability 2e-8, at
       80 % with 3e-6.
    2. Rows of equal sets are one class; the rest works on classes.
    3. In each bucket every class meets the bucket's centre alone.  Pairs
       whose signatures agree less than 7 standard deviations below the
       threshold are left; the others are confirmed on full sets, a chunk of
       ``chunk`` members of one centre at a time.
    4. Components of the confirmed links.  Buckets that still hold several
       components are searched in blocks for links between them: members
       outside the bucket's largest component against all members, signatures
       first, full sets after; pairs within one component can't change the
       result and are skipped.  No pair is emitted that joins nothing new.

    Result for odd rows: no words or null text: n_shingles 0, a class of its
    own (component_id is its own id, kept, no label); null id: part of classes like
    other rows, null counts as the smallest id; repeated rows (same id and
    text) all come back with the same class; empty table: empty result.
    Extra columns are ignored.  ``tk`` tells apart texts that share an id.
    Links are confirmed on 64-bit shingle names.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "neardup")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("tk"), F.col(text_col).cast("string").alias("text"))
    signed = written(signatures(given, words, permutations, rows), folder, "signed")
    sets = written(signed.filter("n_shingles > 0").groupBy("sh").agg(
        F.min(F.struct(F.col("doc_id"), "tk", F.col("n_shingles").alias("n"), "sig", "bands")).alias("m")).select("sh", "m.*"), folder, "classes")

    member = sets.select("sh", F.explode("bands").alias("bucket"))
    centres = member.groupBy("bucket").agg(F.min("sh").alias("p"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    joined = written(member.join(centres, "bucket").select("bucket", "sh", "p", "m"), folder, "buckets")

    least = percent / 100 - 7 * math.sqrt(percent / 100 * (1 - percent / 100) / (2 * permutations))
    least = max(1, math.floor(least * 2 * permutations))
    sign = sets.select("sh", "n", "sig")
    agree = F.aggregate(F.zip_with("sig", "sig_p", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    star = (
        joined.filter("sh <> p").select("sh", "p").distinct()
        .join(sign, "sh").join(sign.toDF("p", "n_p", "sig_p"), "p")
        .filter(F.least("n", "n_p") * 100 >= F.greatest("n", "n_p") * percent).filter(agree >= least).select("sh", "p"))
    star = written(star, folder, "star")

    # Full sets of the classes that any check needs: the text is read again for one row of each.
    needed = joined.select("sh").distinct().join(sets.select("sh", "doc_id", "tk"), "sh")
    texts = given.join(needed.hint("shuffle_hash"), given["doc_id"].eqNullSafe(needed["doc_id"]) & (given["tk"] == needed["tk"])).select("sh", "text")
    full = written(shingle_sets(texts, words), folder, "sets").dropDuplicates(["sh"])

    count = star.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("chunks"))
    members = star.join(count, "p").select("p", F.pmod(F.xxhash64("sh"), F.col("chunks")).alias("c"), "sh").join(full, "sh")
    hubs = fresh(count.select("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("c")).join(
        fresh(full).withColumnRenamed("sh", "p"), "p"))
    links = members.groupBy("p", "c").cogroup(hubs.groupBy("p", "c")).applyInPandas(
        lambda a, b: _confirm_star(a, b, percent), "u binary, v binary")
    links = written(links, folder, "links")
    labels = components(links, folder, "first")

    # Buckets of three or more classes that the centres have not joined.
    named = joined.filter("m > 2").join(labels.toDF("sh", "label"), "sh", "left").select(
        "bucket", "sh", "p", F.coalesce("label", "sh").alias("comp"))
    open_ = written(
        named.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(
            F.max(F.struct("k", "comp"))["comp"].alias("main"), F.sum("k").alias("m"), F.count(F.lit(1)).alias("comps"),
            F.max("k").alias("most")).filter("comps > 1"), folder, "open")
    rest = named.join(open_, "bucket").filter("sh <> p").join(sign, "sh")
    left_n = F.ceil((F.col("m") - F.col("most")) / F.lit(chunk)).cast("int")
    right_n = F.ceil(F.col("m") / F.lit(4 * chunk)).cast("int")
    rest = written(rest.withColumn("ln", F.greatest(left_n, F.lit(1))).withColumn("rn", F.greatest(right_n, F.lit(1))).select(
        "bucket", "sh", "comp", "main", "n", "sig", "ln", "rn"), folder, "rest")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("sh"), F.col(n)).cast("int")
    key = ["bucket", "i", "j"]
    a = rest.filter("comp <> main").select("bucket", part("ln").alias("i"), spread("rn").alias("j"), "sh", "comp", "n", "sig")
    b = fresh(rest.select("bucket", spread("ln").alias("i"), part("rn").alias("j"), "sh", "comp", "n", "sig"))
    # Few bytes and much work: as many tasks as the session has shuffle partitions, whatever their size.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sifted = a.repartition(tasks, *key).groupBy(*key).cogroup(b.repartition(tasks, *key).groupBy(*key)).applyInPandas(
        lambda x, y: _sift_cell(x, y, least, percent), "bucket long, i int, j int, side int, sh binary, comp binary")
    sifted = written(sifted, folder, "sifted")
    more = sifted.join(full, "sh").groupBy(*key).applyInPandas(lambda x: _confirm_cell(x, percent), "u binary, v binary")
    more = written(more, folder, "more")
    if not more.isEmpty():
        labels = components(links.unionByName(more), folder, "second")

    classes = sets.select("sh", "doc_id").join(labels.toDF("sh", "label"), "sh", "left").select("sh", "doc_id", F.coalesce("label", "sh").alias("label"))
    least_id = classes.groupBy("label").agg(F.min(F.struct("doc_id"))["doc_id"].alias("component_id"))
    of = classes.select("sh", "label").join(least_id, "label").select("sh", "label", "component_id", F.lit(True).alias("classed"))
    out = signed.select("doc_id", "tk", "n_shingles", "sh").join(of, "sh", "left")
    return out.select(
        "doc_id", "tk", "n_shingles", F.when(F.col("classed"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.col("doc_id").eqNullSafe(F.when(F.col("classed"), F.col("component_id")).otherwise(F.col("doc_id"))).alias("kept"), "label")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, all columns as they were.

    The row of the smallest id stays; of rows of the class that share that id,
    the one of the smallest text key, and of wholly equal rows one.  Unrelated
    texts under one id, or without any, all stay.  Rows without words all stay.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    kept = found.filter("kept and n_shingles > 0").groupBy("label", "component_id", "tk").count()
    keep = kept.groupBy("label", "component_id").agg(F.min(F.struct("tk", "count")).alias("m")).select(
        F.col("component_id").alias("_id"), F.col("m.tk").alias("_tk"), F.col("m.count").alias("_rows"))
    keyed = docs.withColumn("_tk0", text_key(text_col)).withColumn("_empty", ~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    words = keyed.filter("not _empty").join(
        keep.hint("shuffle_hash"), F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.col("_tk0") == F.col("_tk")))
    repeated = words.filter("_rows > 1").dropDuplicates([id_col, "_tk0"])
    return reduce(DataFrame.unionByName, [x.select(docs.columns) for x in (words.filter("_rows = 1"), repeated, keyed.filter("_empty"))])
