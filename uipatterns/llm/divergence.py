"""How the sources of a language differ in their terms: pair sums by a frequent-pattern tree, top terms.

A term's row is its list of (source, count), sources in order, zero counts left
out.  Equal rows are one row with a multiplicity, and sorted rows that share a
beginning share a path of the tree.  For two sources the sum over all kept
terms starts from the value that two zero counts give, times the number of
terms; what nonzero counts change is added:

    sum f(p, q) = V f(p0, q0)
        + sum over rows with the group:  f(p, q0) - f(p0, q0)
        + sum over rows with the other:  f(p0, q) - f(p0, q0)
        + sum over rows with both:       f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

The first three need only how many terms a source holds how often.  The last
is what the tree is for: each node meets each of its ancestors once, times the
terms below it.  All in integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uipatterns.llm.common import by_value, shared_folder, written
from uipatterns.llm.terms import WORDS, terms_of, utf8

by_value(__name__)

#: p of a group counts in parts of this.
PARTS = 1_000_000_000
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
CORRECTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _flush(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        terms = sorted(n)
        for at in range(0, max(len(terms), 1), 50_000):
            part = terms[at:at + 50_000]
            names = pa.array(part, pa.binary()).cast(pa.string())
            if not at:  # one row without a term names the group
                names = pa.concat_arrays([pa.nulls(1, pa.string()), names])
            zero = [0] if not at else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()), names,
                 pa.array(zero + [n[t] for t in part], pa.int64()), pa.array(zero + [docs[t] for t in part], pa.int64())], schema=COUNTED)
    held.clear()


def count_terms(batches: Iterator[pa.RecordBatch], most: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by (lang, source), summed within a task; at most about ``most`` terms are held."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, utf8(batch, "text")):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for terms in terms_of(text, WORDS):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += len(n) - before + 1
            if size > most:
                yield from _flush(held)
                size = 0
    yield from _flush(held)


def parts_of(n: Column, whole: Column) -> Column:
    """p = 1 + floor(PARTS * (n + 1) / whole), exact for any count."""
    many = F.lit(PARTS).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.call_function("div", many, whole.cast("decimal(20,0)")) + 1


def distance(p: str | Column, q: str | Column) -> str:
    """SQL of f = floor((p - q)^2 / q); p and q are below 2^31, so it is exact."""
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def tree_corrections(item: np.ndarray, source: np.ndarray, p: np.ndarray, base: np.ndarray, times: np.ndarray, sources: int) -> np.ndarray:
    """Sums [group, other source] of the corrections of a block of sorted rows.

    All but ``times`` are matrices of a row per path and a column per step;
    ``item`` is -1 beyond a path's end.  Rows are inserted in their order: the
    steps that a row shares with the one before it are old nodes, the others
    new ones.  A node's multiplicity is the sum of ``times`` over the rows
    that pass through it.
    """
    out = np.zeros((sources, sources), np.int64)
    fresh = np.ones(item.shape, bool)
    fresh[1:] = np.logical_or.accumulate(item[1:] != item[:-1], axis=1)
    for d in range(1, item.shape[1]):
        starts = np.flatnonzero(fresh[:, d])
        many = np.add.reduceat(times, starts)
        real = item[starts, d] >= 0
        nodes, many = starts[real], many[real]
        if not len(nodes):
            break
        h, ph, bh = source[nodes, d, None], p[nodes, d, None], base[nodes, d, None]
        g, pg, bg = source[nodes, :d], p[nodes, :d], base[nodes, :d]
        ahead = _f(pg, ph) - _f(pg, bh) - _f(bg, ph) + _f(bg, bh)
        back = _f(ph, pg) - _f(ph, bg) - _f(bh, pg) + _f(bh, bg)
        np.add.at(out, (g, np.broadcast_to(h, g.shape)), ahead * many[:, None])
        np.add.at(out, (np.broadcast_to(h, g.shape), g), back * many[:, None])
    return out


def _trees(batches: Iterator[pa.RecordBatch], cells: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        langs, paths, times = batch.column(0), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        lengths = pc.list_value_length(paths).to_numpy(zero_copy_only=False)
        codes = langs.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        while at < len(times):
            widest = np.maximum.accumulate(lengths[at:])
            fits = (np.arange(1, len(widest) + 1) * widest <= cells) & (codes[at:] == codes[at])
            rows = max(1, int(np.argmin(fits)) if not fits.all() else len(fits))
            yield from _tree(langs[at].as_py(), paths.slice(at, rows), lengths[at:at + rows], times[at:at + rows])
            at += rows


def _tree(lang: str, paths: pa.ListArray, lengths: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    steps = paths.flatten()
    named = steps.field("source").dictionary_encode()
    names = named.dictionary
    within = np.arange(lengths.max())[None, :] < lengths[:, None]

    def matrix(values: pa.Array, empty: int) -> np.ndarray:
        full = np.full(within.shape, empty, np.int64)
        full[within] = values.to_numpy(zero_copy_only=False)
        return full

    source, n = matrix(named.indices, -1), matrix(steps.field("n"), -1)
    item = np.full(within.shape, -1, np.int64)
    item[within] = np.unique(np.stack([source[within], n[within]]), axis=1, return_inverse=True)[1].reshape(-1)
    sums = tree_corrections(item, source, matrix(steps.field("p"), 1), matrix(steps.field("base"), 1), times, len(names))
    g, h = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), names.take(pa.array(g)), names.take(pa.array(h)), pa.array(sums[g, h])], schema=CORRECTED)


def source_divergence(
    docs: DataFrame, least_docs: int = 3, top_terms: int = 200,
    lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """Compare the sources of each language with each other and with the language as a whole.

    A language keeps the terms that stand in ``least_docs`` or more of its
    documents.  With V of them and N occurrences, a term's p is 1 +
    floor(10^9 (count + 1) / (N + V)).  Rows of part ``pair``: each other
    source of the language, the value f = floor((p - q)^2 / q) summed over all
    kept terms.  Rows of part ``term``: the kept terms that the source holds
    and whose p is above the language's, the ``top_terms`` largest f.

    Terms are counted within tasks, summed by (lang, source, term), gathered
    by (lang, term) into rows, equal rows counted, and the rows sorted over
    all tasks; each task builds the trees of its range.  Only counts move, a
    frequent term is at most one row per task and source, and a row has at
    most one entry per source.

    Returns lang, source, part, item, value, rank.  Null lang, source or text:
    the empty string.  Every row of ``docs`` is a document, repeated ones too.
    A group without terms has its pair rows; a language without kept terms
    has pairs of value 0; a language of one source has no pairs.  Ties go to
    the smaller item in UTF-8 order.  Empty table: empty result.
    """
    folder = shared_folder(docs.sparkSession, "divergence")
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = docs.select(clean(lang_col).alias("lang"), clean(source_col).alias("source"), clean(text_col).alias("text"))
    counted = given.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    counts = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("row"))
    rows = written(rows.filter(f"term is null or docs >= {int(least_docs)}").drop("docs"), folder, "rows")
    kept = rows.filter("term is not null").select("lang", "term", "total", F.explode("row").alias("e")).select("lang", "term", "total", "e.source", "e.n")

    # one row per (lang, source) and per lang
    langs = rows.groupBy("lang").agg(F.count("term").alias("v"), F.sum(F.when(F.col("term").isNotNull(), F.col("total")).otherwise(0)).alias("n"))
    langs = written(langs.select("lang", "v", (F.col("n") + F.col("v")).alias("whole_lang")), folder, "langs")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = rows.filter("term is null").select("lang", F.explode("row").alias("e")).select("lang", "e.source").join(sums, ["lang", "source"], "left").join(langs, "lang")
    whole = F.coalesce("n", F.lit(0)) + F.col("v")
    groups = written(groups.select("lang", "source", "v", "whole_lang", whole.alias("whole"),
                                   F.when(whole > 0, parts_of(F.lit(0), whole)).alias("base")), folder, "groups")

    entries = kept.join(groups, ["lang", "source"]).withColumn("p", parts_of(F.col("n"), F.col("whole")))
    top = entries.withColumn("q", parts_of(F.col("total"), F.col("whole_lang"))).filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(distance("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = top.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)

    # what no count of zero is involved in: the trees
    paths = entries.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n", "p", "base"))).alias("path"))
    paths = written(paths.groupBy("lang", "path").agg(F.count("*").alias("times")), folder, "paths")
    shared = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").mapInArrow(
        _trees, "lang string, source string, item string, value long")

    # what one zero count is involved in: how many terms a source holds how often, against every other source's base
    others = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("b"))
    held = entries.groupBy("lang", "source", "p", "base").agg(F.count("*").cast("decimal(20,0)").alias("times")).join(others, "lang").filter("source <> item")
    change = lambda p, q, p0, q0: F.col("times") * F.expr(f"{distance(p, q)} - {distance(p0, q0)}").cast("decimal(18,0)")
    single = held.select("lang", F.explode(F.array(
        F.struct(F.col("source").alias("source"), F.col("item").alias("item"), change("p", "b", "base", "b").alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), change("b", "p", "b", "base").alias("value")))).alias("e")).select("lang", "e.*")
    zero = groups.join(others, "lang").filter("source <> item").select(
        "lang", "source", "item", F.when(F.col("v") > 0, F.col("v").cast("decimal(19,0)") * F.expr(distance("base", "b")).cast("decimal(19,0)")).otherwise(0).alias("value"))
    total = lambda df: df.select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value"))
    pairs = total(zero).unionByName(total(single)).unionByName(total(shared)).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pairs.unionByName(top)
