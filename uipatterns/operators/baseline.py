"""Baseline classifier: character n-grams, TF-IDF and one logistic regression per label."""

from __future__ import annotations

import sys
from collections import Counter, defaultdict, deque
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uipatterns.functions.text import WS
from uipatterns.operators.scoring import sigmoid
from uipatterns.schema import LABELS
from uipatterns.session import cut_lineage, work_tasks


def char_ngrams(text: Column, low: int = 2, high: int = 5) -> Column:
    """Character n-grams that stay inside a word padded with one blank each side."""
    words = F.filter(F.split(text, WS), lambda w: w != "")

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)

        def of_length(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
            return F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))

        # A word not longer than n gives itself once, for the first such n only.
        per_n = [F.when((size >= n) | F.lit(n == low), of_length(n)).otherwise(F.array().cast("array<string>"))
                 for n in range(low, high + 1)]
        return F.flatten(F.array(*per_n))

    return F.flatten(F.transform(words, grams))


@dataclass
class Baseline:
    vocabulary: DataFrame  # gram, idx, idf, weights (one a label): at most ``max_features`` rows
    labels: list[str]
    offsets: list[float | None]  # None: one class only, nothing was fitted


def _grams_of(word: str, low: int = 2, high: int = 5) -> list[str]:
    """``char_ngrams`` of one word."""
    padded = f" {word} "
    size = len(padded)
    return [padded[i:i + n] for n in range(low, high + 1) if size >= n or n == low for i in range(max(size - n + 1, 1))]


def _gram_counts(batches):
    """``row_id`` and the counts of its grams, from batches in order of ``row_id`` with the ``words`` of a text each.

    Texts that share an id are one row.  What a task holds is the grams of one row.
    """
    known = lru_cache(100_000)(_grams_of)
    at, counts, begun = None, Counter(), False
    for batch in batches:
        for row_id, words in zip(batch.column("row_id").to_pylist(), batch.column("words").to_pylist()):
            if begun and row_id != at:
                yield at, counts
                counts = Counter()
            at, begun = row_id, True
            for word in words or ():
                counts.update(known(word))
    if begun:
        yield at, counts


_HELD = 500_000  # grams a task counts before it passes the counts on


def _sum_grams(batches):
    """``gram, df, cf`` of the rows of a task; a gram may come several times."""
    df, cf = defaultdict(int), defaultdict(int)

    def found():
        return pa.RecordBatch.from_arrays([pa.array(list(cf), pa.string()), pa.array([df[g] for g in cf], pa.int64()),
                                           pa.array(list(cf.values()), pa.int64())], names=["gram", "df", "cf"])

    for _, counts in _gram_counts(batches):
        for gram, n in counts.items():
            df[gram] += 1
            cf[gram] += n
        if len(cf) >= _HELD:
            yield found()
            df, cf = defaultdict(int), defaultdict(int)
    if cf:
        yield found()


def _words_by_row(df: DataFrame) -> DataFrame:
    """The words of every text, the texts of a row one after the other: texts are shuffled, not their grams."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    words = df.select("row_id", F.filter(F.split("model_input", WS), lambda w: w != "").alias("words"))
    return words.repartition(work_tasks(df.sparkSession), "row_id").sortWithinPartitions("row_id")


def fit_vocabulary(df: DataFrame, min_df: int = 2, max_features: int = 200_000) -> DataFrame:
    """``gram, idx, idf`` of the most frequent grams found in ``min_df`` rows or more."""
    total = df.agg(F.count(F.lit(1))).scalar()
    sums = _words_by_row(df).mapInArrow(_sum_grams, "gram string, df long, cf long")
    kept = (
        sums.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        .filter(F.col("df") >= min_df).orderBy(F.col("cf").desc(), "gram").limit(max_features)
    )
    # At most max_features rows are left, so one ordered numbering is bounded.
    numbered = kept.withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("gram")) - 1)
    idf = F.log((1 + F.col("n_rows")) / (1 + F.col("df"))) + 1
    return numbered.withColumn("n_rows", total).select("gram", "idx", idf.alias("idf"))


def _row_terms(df: DataFrame, vocabulary: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """One row per ``row_id`` with known grams: ``indices`` and ``values`` (tf-idf, not yet of unit length).

    With ``weights`` (a row per gram, in order of ``idx``) instead ``shares``: the unit vector times each column.
    The vocabulary has a fixed upper size, which is what makes its broadcast safe.
    """
    table = vocabulary.select("gram", "idx", "idf").toArrow()
    index = dict(zip(table["gram"].to_pylist(), zip(table["idx"].to_pylist(), table["idf"].to_pylist())))
    shared = df.sparkSession.sparkContext.broadcast((index, weights))
    kind = df.schema["row_id"].dataType.simpleString()

    def run(batches):
        index, weights = shared.value
        rows = ([], [], []) if weights is None else ([], [])
        types = (pa.list_(pa.int32()), pa.list_(pa.float64())) if weights is None else (pa.list_(pa.float64()),)
        names = ["row_id", "indices", "values"] if weights is None else ["row_id", "shares"]
        id_type = []

        def watched():
            for batch in batches:
                id_type[:] = [batch.schema.field("row_id").type]
                yield batch

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (id_type[0], *types))], names=names)

        for row_id, counts in _gram_counts(watched()):
            terms = [(*index[g], n) for g, n in counts.items() if g in index]
            if terms:
                at, idf, tf = zip(*terms)
                at, value = np.array(at, np.int32), (1 + np.log(tf)) * np.array(idf)
                rows[0].append(row_id)
                if weights is None:
                    rows[1].append(at)
                    rows[2].append(value)
                else:
                    rows[1].append(value @ weights[at] / np.sqrt(value @ value))
                if len(rows[0]) == 4096:
                    yield made()
                    for column in rows:
                        column.clear()
        if rows[0]:
            yield made()

    out = "indices array<int>, values array<double>" if weights is None else "shares array<double>"
    return _words_by_row(df).mapInArrow(run, f"row_id {kind}, {out}")


def term_weights(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``row_id``, the vocabulary's columns and ``tfidf``, for each known gram of a row; not yet of unit length."""
    terms = _row_terms(df, vocabulary).select("row_id", F.inline(F.arrays_zip(F.col("indices").alias("idx"), F.col("values").alias("tfidf"))))
    return terms.join(F.broadcast(vocabulary), "idx")


def _training_rows(train: DataFrame, vocabulary: DataFrame, labels: list[str]) -> DataFrame:
    """``y, indices, values``: the labels of a row and its terms, of unit length; rows without a known gram have none."""
    norm = F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x))
    terms = _row_terms(train, vocabulary).select("row_id", "indices", "values", norm.alias("norm"))
    # A row's terms take far more room than its text, whatever size the planner takes them for.
    return train.select("row_id", F.array(*[F.coalesce(F.col(f"y_{x}") == 1, F.lit(False)) for x in labels]).alias("y")).join(terms.hint("merge"), "row_id", "left").select(
        "y", F.coalesce("indices", F.array().cast("array<int>")).alias("indices"),
        F.coalesce(F.transform("values", lambda x: x / F.col("norm")), F.array().cast("array<double>")).alias("values"))


_BLOCK = 4096  # features summed as one vector


def _loss_and_gradient(rows: DataFrame, at: dict[int, np.ndarray], class_weights: np.ndarray) -> dict[int, np.ndarray]:
    """Per label in ``at``: the summed gradient, and as its last entry the summed loss, all from one pass over ``rows``.

    A task holds one vector per label; its blocks are summed on the map side and then by (label, block).
    """
    width = len(next(iter(at.values())))

    shared = rows.sparkSession.sparkContext.broadcast(at)

    def gathered(batches, least=1_000_000):
        """Batches joined until they hold so many terms, so that a pass over the features pays."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("indices").values)
            if size >= least:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held and any(b.num_rows for b in held):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def parts(batches):
        at = shared.value
        sums = {j: np.zeros(width + 1) for j in at}
        for batch in gathered(batches):
            n = batch.num_rows
            index, value = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("indices", "values"))
            row = np.repeat(np.arange(n), batch.column("indices").value_lengths().to_numpy(zero_copy_only=False))
            y = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            for j, w in at.items():
                sign, weight = np.where(y[:, j], 1.0, -1.0), class_weights[j][y[:, j].astype(int)]
                margin = sign * (np.bincount(row, value * w[index], n) + w[-1])
                pull = -sign * weight * 0.5 * (1 - np.tanh(margin / 2))
                sums[j][:-2] += np.bincount(index, value * pull[row], width - 1)
                sums[j][-2] += pull.sum()
                sums[j][-1] += (weight * np.logaddexp(0, -margin)).sum()
        for j, vector in sums.items():
            blocks = [(b, vector[b * _BLOCK:(b + 1) * _BLOCK]) for b in range(-(-len(vector) // _BLOCK))]
            blocks = [(b, part) for b, part in blocks if part.any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([j] * len(blocks), pa.int32()), pa.array([b for b, _ in blocks], pa.int32()),
                 pa.array([part for _, part in blocks], pa.list_(pa.float64()))], names=["label", "block", "part"])

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    summed = rows.mapInArrow(parts, "label int, block int, part array<double>").groupBy("label", "block").agg(
        vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))
    out = {j: np.zeros(width + 1) for j in at}
    for label, block, part in summed.collect():  # at most one row per label and block of features
        out[label][block * _BLOCK:block * _BLOCK + len(part)] = part
    shared.unpersist()
    return out


class _Descent:
    """L-BFGS for one label, its steps halved until they lower the loss.  ``told`` takes loss and gradient at ``trial``."""

    def __init__(self, width: int, memory: int = 5):
        self.trial, self.value, self.steps, self.done = np.zeros(width), None, 0, False
        self.pairs: deque = deque(maxlen=memory)

    def told(self, value: float, gradient: np.ndarray, tol: float) -> None:
        if self.value is not None and value > self.value + 1e-4 * self.step * self.slope:
            self.step /= 2
            self.done = self.step < 1e-9
        else:
            if self.value is not None:
                moved, turned = self.trial - self.at, gradient - self.gradient
                if moved @ turned > 1e-15:
                    self.pairs.append((moved, turned))
                self.steps += 1
                self.done = self.value - value <= tol * max(abs(value), 1e-8)
            self.at, self.value, self.gradient = self.trial, value, gradient
            self.way = -self._curved(gradient)
            self.slope = gradient @ self.way
            self.step = 1.0 if self.pairs else 1.0 / max(1.0, float(np.linalg.norm(gradient)))
        if not self.done:
            self.trial = self.at + self.step * self.way

    def _curved(self, gradient: np.ndarray) -> np.ndarray:
        """The gradient times the approximate inverse of the second derivatives."""
        out, shares = gradient.copy(), []
        for moved, turned in reversed(self.pairs):
            shares.append((moved @ out) / (moved @ turned))
            out -= shares[-1] * turned
        if self.pairs:
            moved, turned = self.pairs[-1]
            out *= (moved @ turned) / (turned @ turned)
        for (moved, turned), share in zip(self.pairs, reversed(shares)):
            out += (share - (turned @ out) / (moved @ turned)) * moved
        return out


def fit_baseline(train: DataFrame, labels: list[str] = LABELS, c: float = 4.0, min_df: int = 2,
                 max_features: int = 200_000, max_iter: int = 100, tol: float = 1e-6) -> Baseline:
    """One logistic regression per label, all fitted in the same passes over the rows.

    ``train``: ``row_id, model_input`` and one ``y_<label>`` column per label;
    a null label is 0.  Classes weigh the same; the penalty is ``1 / (c n)``.  A pass is
    one job that sums the gradients of all labels not yet done; the driver holds a dozen vectors
    of ``max_features`` per label.  A label with one class only isn't fitted.
    """
    vocabulary = cut_lineage(fit_vocabulary(train, min_df, max_features))
    size = vocabulary.count()
    sums = train.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"y_{x}") == 1).alias(x) for x in labels]).first()
    n, positive = sums["n"], [sums[x] for x in labels]
    class_weights = np.array([[n / (2.0 * max(n - p, 1)), n / (2.0 * max(p, 1))] for p in positive])
    runs = {j: _Descent(size + 1) for j, p in enumerate(positive) if 0 < p < n}
    rows = cut_lineage(_training_rows(train, vocabulary, labels)) if runs else None
    penalty = np.append(np.full(size, 1.0 / (c * max(n, 1))), 0.0)  # the offset pays none
    while open_ := {j: r.trial for j, r in runs.items() if not r.done and r.steps < max_iter}:
        for j, found in _loss_and_gradient(rows, open_, class_weights).items():
            w = open_[j]
            runs[j].told(found[-1] / n + 0.5 * float((penalty * w) @ w), found[:-1] / n + penalty * w, tol)
    wide = np.stack([runs[j].at[:-1] if j in runs else np.zeros(size) for j in range(len(labels))], axis=1)
    table = train.sparkSession.createDataFrame(pa.table({"idx": pa.array(np.arange(size), pa.int32()), "weights": pa.array(list(wide), pa.list_(pa.float64()))}))
    return Baseline(cut_lineage(vocabulary.join(table, "idx")), list(labels), [float(runs[j].at[-1]) if j in runs else None for j in range(len(labels))])


def score_baseline(model: Baseline, df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Add ``probs`` in the order of ``labels`` (the model's); a label that could not be fitted scores 0."""
    wanted = [model.labels.index(x) for x in labels or model.labels]
    weights = np.zeros((model.vocabulary.count(), len(model.labels)))
    for at, found in zip(*(model.vocabulary.select("idx", "weights").toArrow()[c].to_pylist() for c in ("idx", "weights"))):
        weights[at] = found
    shares = _row_terms(df, model.vocabulary, weights[:, wanted]).withColumnRenamed("shares", "_s").hint("merge")
    probs = [F.lit(0.0) if model.offsets[j] is None else sigmoid(F.coalesce(F.col("_s")[at], F.lit(0.0)) + model.offsets[j]) for at, j in enumerate(wanted)]
    return df.join(shares, "row_id", "left").withColumn("probs", F.array(*probs)).drop("_s")
