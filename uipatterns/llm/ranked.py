"""Ranked lexical search: the best documents for every item, by two trees.

Items and documents are vectors over the items' terms: an item's coordinate is
the term's weight times its repeats, a document's the saturated frequency of
the term.  Both lie in trees whose nodes hold the largest value of each
coordinate below them, so the product of two nodes bounds every score between
their members.  A pair of nodes whose bound is below the weakest k-th score of
its items is dropped whole; this loses nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from uipatterns.llm.common import by_value, hash_sample, shared_folder, written
from uipatterns.llm.terms import WORDS_AND_NUMBERS, terms_of, utf8

by_value(__name__)

#: What stands for a missing document id: after all others.
LAST = 2 ** 63 - 1
VECTOR = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])
FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def counts(batches: Iterator[pa.RecordBatch], known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Of each document with a term: its id, its number of terms and how often it holds the known ones."""
    for batch in batches:
        ids, n, term, tf = [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), utf8(batch, "text")):
            held, total = Counter(), 0
            for terms in terms_of(text, WORDS_AND_NUMBERS):
                held.update(map(known.get, terms))
                total += len(terms)
            if total:
                held.pop(None, None)
                ids.append(LAST if doc is None else doc)
                n.append(total)
                term.append(list(held))
                tf.append(list(held.values()))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, n, term, tf), VECTOR)], schema=VECTOR)


def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents that hold it) of a task."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        here = np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False))
        if len(here) > len(total):
            here[:len(total)] += total
            total = here
        else:
            total[:len(here)] += here
    term = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"term": pa.array(term, pa.int32()), "df": pa.array(total[term], pa.int64())})


@dataclass
class Tree:
    """Levels of nodes over rows in a fixed order, leaves' rows last: ``tops[l]`` is a matrix of coordinate maxima, each of ``fan`` below."""

    order: np.ndarray
    tops: list[np.ndarray]
    fan: int

    @staticmethod
    def over(rows: np.ndarray, leaf: int, fan: int) -> Tree:
        """Neighbours share their heaviest coordinate where they can."""
        order = np.lexsort((-rows.max(axis=1, initial=0), rows.argmax(axis=1))) if rows.shape[1] else np.arange(len(rows))
        tops = [rows[order]]
        step = leaf
        while len(tops[-1]) > 1:
            tops.append(np.maximum.reduceat(tops[-1], np.arange(0, len(tops[-1]), step), axis=0))
            step = fan
        return Tree(order, tops, fan)


class Search:
    """The best ``k`` documents of each item so far; documents come in batches."""

    def __init__(self, weights: np.ndarray, known: np.ndarray, k: int, leaf: int = 8, fan: int = 4):
        """``weights``: items by terms.  ``known``: a score that each item's k-th best is known to reach."""
        self.k, self.leaf, self.fan = k, leaf, fan
        self.items = Tree.over(weights, leaf, fan)
        self.columns = [[np.flatnonzero(r) for r in level] for level in self.items.tops]
        self.weakest = np.maximum(known[self.items.order], 1)  # a score of 0 is no hit
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(weights)
        self.pairs = self.scored = 0

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        docs = Tree.over(rows, 16, 8)
        at = len(self.items.tops) - 1
        self._visit(at, 0, ids[docs.order], docs, len(docs.tops) - 1, np.zeros(1, np.int64))

    def _members(self, level: int, node: int) -> slice:
        width = 1 if not level else self.leaf * self.fan ** (level - 1)
        return slice(node * width, (node + 1) * width)

    def _visit(self, level: int, node: int, ids: np.ndarray, docs: Tree, depth: int, nodes: np.ndarray) -> None:
        columns = self.columns[level][node]
        weights = self.items.tops[level][node][columns]
        bounds = docs.tops[depth][np.ix_(nodes, columns)] @ weights
        self.pairs += len(nodes)
        alive = bounds >= self.weakest[self._members(level, node)].min()
        nodes = nodes[alive]
        if not len(nodes):
            return
        if not level and not depth:
            self._keep(node, ids[nodes], bounds[alive].astype(np.int64))
            return
        if depth:
            step = 16 if depth == 1 else docs.fan
            below = (nodes[:, None] * step + np.arange(step)).ravel()
            nodes = below[below < len(docs.tops[depth - 1])]
        if not level:
            self._visit(0, node, ids, docs, depth - 1, nodes)
            return
        step = self.leaf if level == 1 else self.fan
        for child in range(node * step, min((node + 1) * step, len(self.items.tops[level - 1]))):
            self._visit(level - 1, child, ids, docs, max(depth - 1, 0), nodes)

    def _keep(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        self.scored += len(ids)
        ids, scores = np.concatenate([self.best[item][0], ids]), np.concatenate([self.best[item][1], scores])
        first = np.lexsort((ids, -scores))[:self.k]
        self.best[item] = ids[first], scores[first]
        if len(first) == self.k:
            self.weakest[item] = max(self.weakest[item], scores[first[-1]])

    def found(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for place, (ids, scores) in enumerate(self.best):
            yield int(self.items.order[place]), ids, scores


def _impacts(n: np.ndarray, lengths: np.ndarray, tf: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    spread = np.repeat([12 * (75 + 25 * int(x) * documents // occurrences) for x in n], lengths).astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + spread)


class Part:
    """A part of the items and the search for it; its columns are the terms that some item of it holds."""

    def __init__(self, at: int, weights: list[dict[int, int]], known: np.ndarray, k: int, cells: int):
        terms = np.array(sorted({t for held in weights for t in held}), np.int64)
        self.at, self.size = at, max(16, cells // max(1, len(terms)))
        self.place = np.full(int(terms.max(initial=-1)) + 2, -1)
        self.place[terms] = np.arange(len(terms))
        matrix = np.zeros((len(weights), len(terms)), np.int64)
        for i, held in enumerate(weights):
            matrix[i, self.place[list(held)]] = list(held.values())
        # sums below 2^52 are exact in doubles
        self.kind = np.float64 if float(matrix.sum(axis=1).max(initial=0)) * 1e6 < 2.0 ** 52 else np.int64
        self.columns, self.search = len(terms), Search(matrix.astype(self.kind), known, k)

    def add(self, ids: np.ndarray, lengths: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        ends = np.concatenate([[0], np.cumsum(lengths)])
        for at in range(0, len(ids), self.size):
            here = slice(ends[at], ends[min(at + self.size, len(ids))])
            column, own_lengths = self.place[np.minimum(term[here], len(self.place) - 1)], lengths[at:at + self.size]
            own = column >= 0
            rows = np.zeros((len(own_lengths), self.columns), self.kind)
            rows[np.repeat(np.arange(len(own_lengths)), own_lengths)[own], column[own]] = impact[here][own]
            self.search.add(ids[at:at + self.size], rows)


def search_batches(
    batches: Iterator[pa.RecordBatch], weights: list[dict[int, int]], known: np.ndarray,
    k: int, documents: int, occurrences: int, part_items: int = 1_024, cells: int = 4_000_000,
) -> Iterator[pa.RecordBatch]:
    """Search the documents of a task for all items of a block; one batch of documents is held at a time."""
    parts = [Part(at, weights[at:at + part_items], known[at:at + part_items], k, cells) for at in range(0, len(weights), part_items)]
    for batch in batches:
        lists, tf = batch.column(2), batch.column(3).flatten().to_numpy(zero_copy_only=False)
        lengths = np.diff(lists.offsets.to_numpy())
        impact = _impacts(batch.column(1).to_numpy(), lengths, tf, documents, occurrences)
        for part in parts:
            part.add(batch.column(0).to_numpy(), lengths, lists.flatten().to_numpy(zero_copy_only=False), impact)
    for part in parts:
        for item, ids, scores in part.search.found():
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part.at + item)), pa.array(ids), pa.array(scores)], schema=FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(spark: SparkSession, items: list[str], docs: DataFrame, k: int, folder: str, sample: int, part_items: int) -> DataFrame:
    """Search for a block of items of bounded size, given by their texts."""
    bags = [Counter(t for terms in terms_of(text.encode(), WORDS_AND_NUMBERS) for t in terms) for text in items]
    names = sorted(set().union(*bags))
    known = spark.sparkContext.broadcast({t: i for i, t in enumerate(names)})
    vectors = docs.mapInArrow(lambda b: counts(b, known.value), "doc_id long, n long, term array<int>, tf array<long>")
    vectors = written(vectors, folder, "vectors")
    size = vectors.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences")).first()
    documents, occurrences = size["documents"], size["occurrences"]
    held = vectors.select("term").mapInArrow(holders, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # at most the block's terms
    weight = {r["term"]: math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1))) for r in held}
    place = {t: i for i, t in enumerate(names)}
    vector = [{place[t]: n * weight[place[t]] for t, n in bag.items() if weight.get(place[t])} for bag in bags]

    def search(rows: DataFrame, least: np.ndarray) -> DataFrame:
        return rows.mapInArrow(
            lambda b: search_batches(b, vector, least, k, documents, occurrences, part_items), "item long, doc_id long, score long")

    # a k-th best score among some documents is one that the k-th best of all reaches
    least = np.zeros(len(vector), np.int64)
    for r in _best(search(hash_sample(vectors, sample, "doc_id", "n"), least), k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score")).collect():
        if r["n"] == k:
            least[r["item"]] = r["score"]
    return _best(search(vectors, least), k)


def ranked_search(
    items: DataFrame, docs: DataFrame, k: int = 20, item_id: str = "item_id", item_text: str = "text",
    doc_id: str = "doc_id", doc_text: str = "text", block_chars: int = 16_000_000, sample: int = 4_096, part_items: int = 1_024,
) -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank, doc_id, score.

    Terms are runs of letters, digits and non-ASCII characters, A-Z
    lower-cased.  Weights, lengths and scores are those of integer BM25 (see
    ``_block`` and ``_impacts``): a term weighs floor(1000 ln((2N + 2) / (2df
    + 1))), N and the average length count documents with a term.

    Items are searched in blocks of about ``block_chars`` characters.  For
    each block every whole text is read once and reduced to its counts of the
    block's terms; these vectors are stored, and all statistics and the search
    read them.  Each task holds one batch of documents and the trees over it.
    Before the search, ``sample`` documents give each item a score that its
    k-th best reaches; it only speeds up the pruning and spares the merge rows
    that can't come in.  The merge gets at most ``k`` rows per item and task.

    Ties go to the smaller doc_id, null last.  Fewer hits than ``k``: all.
    Scores of 0 are no hits.  Null text: no terms.  Rows of equal id and text
    in ``items`` are one item; rows that share an id only are ranked each by
    itself; a null id is an id.  Every row of ``docs`` is a document.  An
    empty table: an empty result.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).distinct()
    chars = asked.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(chars / block_chars))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    folder, out = shared_folder(spark, "ranked"), None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).withColumn("item", F.xxhash64("id", "text"))
        held = rows.orderBy("item").collect()  # about block_chars characters
        found = _block(spark, [r["text"] for r in held], texts, k, f"{folder}/{b}", sample, part_items)
        kind = asked.schema["id"].dataType.simpleString()
        names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(held)], f"item long, `{item_id}` {kind}")
        here = found.join(names, "item").select(item_id, "rank", F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "score")
        out = here if out is None else out.unionByName(here)
    return out
