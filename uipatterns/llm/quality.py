"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uipatterns.llm.common import by_value, hash_sample, spare

by_value(__name__)

#: Kinds of bytes whose shares are features: capitals, letters (all of other scripts too), digits, and groups of signs.
_KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"0123456789", b".,;:", b"!?", b"|", b"%$&*#@^~+=<>{}[]\\_", b"\"'()-/`")
_TABLE = np.full(256, len(_KINDS), np.int64)
for _i, _k in enumerate(_KINDS):
    _TABLE[list(_k)] = _i
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
N_LINE = len(_KINDS) + 10


def lines_of(text: bytes) -> list[bytes]:
    """The lines that hold more than spaces; a text without any is one empty line."""
    return [x for x in text.split(b"\n") if x.strip()] or [b""]


def line_features(texts: list[bytes], limit: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length, first line of each text and the total), worked out ``limit`` bytes of text at a time."""
    parts, begin, size = [], 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            parts.append(_features(texts[begin:i]))
            begin, size = i, 0
        size += len(text)
    parts.append(_features(texts[begin:]))
    counts = np.concatenate([np.diff(p[2]) for p in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([[0], np.cumsum(counts)])


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = [lines_of(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
    lines = [x for c in cut for x in c]
    length = np.array([len(x) for x in lines], np.int64)
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    owner = np.repeat(np.arange(len(lines), dtype=np.int64), length + 1)
    kinds = np.bincount(owner * (len(_KINDS) + 1) + _TABLE[data], minlength=len(lines) * (len(_KINDS) + 1)).reshape(len(lines), -1)
    solid = np.bincount(owner, weights=~_SPACE[data], minlength=len(lines))
    n, distinct, again, seen_before, short = (np.zeros(len(lines)) for _ in range(5))
    row = 0
    for c in cut:
        known: set = set()
        for line in c:
            words = line.split()
            n[row], distinct[row] = len(words), len(set(words))
            again[row] = sum(map(bytes.__eq__, words[1:], words))
            seen_before[row] = line in known
            short[row] = sum(len(w) <= 3 for w in words)
            known.add(line)
            row += 1
    per_word, per_byte = np.maximum(n, 1), np.maximum(solid, 1)
    first = np.zeros(len(lines))
    first[starts[:-1]] = 1
    last = np.zeros(len(lines))
    last[starts[1:] - 1] = 1
    found = np.concatenate([
        kinds[:, :-1] / per_byte[:, None],
        np.stack([np.log1p(n), solid / per_word / 10, 1 - distinct / per_word, again / per_word, seen_before, short / per_word,
                  (n == 0).astype(float), first, last, kinds[:, 0] / np.maximum(kinds[:, 0] + kinds[:, 1], 1)], axis=1)], axis=1)
    return found, np.maximum(length, 1), starts


def with_neighbours(f: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after (0 beyond the text), and a constant."""
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    before[starts[:-1]] = 0
    after[starts[1:] - 1] = 0
    return np.concatenate([f, before, after, np.ones((len(f), 1))], axis=1)



def forward_backward(emit: np.ndarray, move: np.ndarray, starts: np.ndarray):
    """(marginals of state 1, expected moves summed over texts, log normaliser summed over texts).

    ``emit`` is the score of state 1 over state 0 of each line, ``move`` the
    2 x 2 transition scores.  All texts advance together, one line a step.
    """
    count = np.diff(starts)
    order = np.argsort(-count, kind="stable")
    begin, count = starts[:-1][order], count[order]
    alive = [int(np.searchsorted(-count, -t, side="left")) for t in range(int(count.max(initial=0)))]
    n = len(emit)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    e = np.stack([np.zeros(n), emit], axis=1)
    for t, m in enumerate(alive):
        at = begin[:m] + t
        if t == 0:
            a[at] = e[at]
        else:
            p = a[at - 1]
            a[at] = e[at] + np.logaddexp(p[:, :1] + move[0], p[:, 1:] + move[1])
    for t in range(len(alive) - 2, -1, -1):
        m = alive[t + 1]
        at = begin[:m] + t
        x = b[at + 1] + e[at + 1]
        b[at] = np.logaddexp(move[:, 0] + x[:, :1], move[:, 1] + x[:, 1:])
    norm = np.logaddexp(a[starts[1:] - 1, 0], a[starts[1:] - 1, 1])
    z = np.repeat(norm, np.diff(starts))
    p1 = np.exp(np.minimum(a[:, 1] + b[:, 1] - z, 0))
    inner = np.ones(n, bool)
    inner[starts[:-1]] = False
    at = np.flatnonzero(inner)
    pair = np.exp(np.minimum(a[at - 1][:, :, None] + move[None] + (e[at] + b[at])[:, None, :] - z[at][:, None, None], 0))
    return p1, pair.sum(axis=0), float(norm.sum())


@dataclass
class QualityModel:
    weights: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float
    offset: float

    def line_scores(self, texts: list[bytes]):
        f, length, starts = line_features(texts)
        x = with_neighbours((f - self.mean) / self.scale, starts)
        return forward_backward(x @ self.weights, self.move, starts)[0], length, starts

    def raw(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, as log odds."""
        p, length, starts = self.line_scores(texts)
        good = np.add.reduceat(p * length, starts[:-1]) / np.add.reduceat(length.astype(float), starts[:-1])
        good = np.clip(good, 1e-5, 1 - 1e-5)
        return np.log(good / (1 - good))

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(texts) + self.offset))) if texts else np.empty(0)


def train(texts: list[bytes], labels: np.ndarray, rounds: int = 150, rate: float = 0.15, ridge: float = 1e-3) -> QualityModel:
    """Maximum likelihood by Adam; every line carries its text's label, each text counts alike.

    A logistic curve over the texts' scores then makes them probabilities.
    With one label only, or no text, the score is that label's share.
    """
    labels = np.asarray(labels, float)
    f, length, starts = line_features(texts) if texts else (np.zeros((0, N_LINE)), np.zeros(0), np.zeros(1, np.int64))
    mean = f.mean(axis=0) if len(f) else np.zeros(N_LINE)
    scale = f.std(axis=0) + 1e-3 if len(f) else np.ones(N_LINE)
    share = (labels.sum() + 1) / (len(labels) + 2)
    if not 0 < labels.sum() < len(labels):
        return QualityModel(np.zeros(3 * N_LINE + 1), np.zeros((2, 2)), mean, scale, 0.0, float(np.log(share / (1 - share))))
    x = with_neighbours((f - mean) / scale, starts)
    count = np.diff(starts)
    y = np.repeat(labels, count)
    each = np.repeat(1.0 / count, count)  # a long text counts no more than a short one
    inner = np.ones(len(y), bool)
    inner[starts[:-1]] = False
    told = np.array([[np.sum(inner & (y == 0)), 0], [0, np.sum(inner & (y == 1))]], float) / max(len(y), 1)
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for t in range(1, rounds + 1):
        p, pairs, _ = forward_backward(x @ w, move, starts)
        grad = np.concatenate([x.T @ ((y - p) * each) / len(labels) - ridge * w, (told - pairs / max(len(y), 1)).ravel() - ridge * move.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, move = w + step[:-4], move + step[-4:].reshape(2, 2)
    model = QualityModel(w, move, mean, scale, 1.0, 0.0)
    raw = model.raw(texts)
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps of a two-parameter logistic fit
        p = 1 / (1 + np.exp(-np.clip(slope * raw + offset, -30, 30)))
        g = np.array([np.sum((labels - p) * raw) - 0.01 * slope, np.sum(labels - p)])
        h = p * (1 - p)
        hess = np.array([[np.sum(h * raw * raw) + 0.01, np.sum(h * raw)], [np.sum(h * raw), np.sum(h) + 1e-6]])
        d = np.linalg.solve(hess, g)
        slope, offset = slope + d[0], offset + d[1]
        if np.abs(d).max() < 1e-9:
            break
    model.slope, model.offset = float(slope), float(offset)
    return model


def held_out(id_col: str):
    """True for the fifth of ids that no label is learnt from: crc32 of the id's text mod 5 is 0 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(
    docs: DataFrame, labels: DataFrame, sample: int = 6_000, longest: int = 100_000, characters: int = 50_000_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """At most ``sample`` rows (_id, _text, _quality) with at most ``characters`` characters in all.

    Labelled ids outside the held-out fold, those of smallest hash, texts of
    up to ``longest`` characters.  Null labels are left out; an id labelled
    twice gets its larger label, and of an id's texts the one of smallest hash
    counts, however many rows share the id.  The ids (at most ``sample``) are
    broadcast, and only these texts are shuffled, one per id and task.
    """
    known = labels.filter("quality is not null").filter(f"`{id_col}` is not null").filter(~held_out(id_col)).groupBy(
        F.col(id_col).alias("_id")).agg(F.max(F.col("quality").cast("int")).alias("_quality"))
    chosen = hash_sample(known, sample, "_id").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.join(F.broadcast(chosen), docs[id_col] == chosen["_id"]).filter(F.length(text) <= longest)
    one_each = rows.groupBy("_id", "_quality").agg(F.min(F.struct(F.xxhash64(text).alias("h"), text.alias("_text"))).alias("t"))
    # One task sees the sample, which is bounded, in the order of its hashes.
    upto = F.sum(F.length("_text")).over(Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0))
    return one_each.select("_id", F.col("t._text").alias("_text"), "_quality").withColumn("_upto", upto).filter(F.col("_upto") <= characters).drop("_upto")


def fit_quality(
    docs: DataFrame, labels: DataFrame, sample: int = 6_000, longest: int = 100_000, characters: int = 50_000_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> QualityModel:
    """Train on ``training_sample``, which is all that the driver holds."""
    got = training_sample(docs, labels, sample, longest, characters, id_col, text_col).toPandas().sort_values(["_id", "_text"])
    return train([t.encode("utf-8", "surrogatepass") for t in got["_text"]], got["_quality"].to_numpy())


def _parts(batch, column: str, limit: int = 3_000_000):
    sizes = [len(x) if x is not None else 0 for x in batch.column(column).to_pylist()]
    begin, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if len(sizes) > begin:
        yield batch.slice(begin)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and quality_score, from 0 (bad) to 1 (good), of every whole text.

    Each row is scored alone, from its text only.  Null and empty texts score
    as one empty line.  Repeated rows score alike; an empty table gives none;
    a taken name gets an underscore.
    """
    keep = docs.columns if keep is None else keep
    name = spare(docs, "quality_score")[0]
    given = docs if text_col in keep else docs.select(*keep, text_col)
    out = T.StructType([*docs.select(*keep).schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for batch in batches:
            for part in _parts(batch, text_col):
                score = model.score([(t or "").encode("utf-8", "surrogatepass") for t in part.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(c).cast(schema.field(c).type) for c in keep], pa.array(score)], schema=schema)

    return given.mapInArrow(run, out)
