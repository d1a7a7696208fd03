"""Removal of repeated word passages, found by recompression."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uipatterns.llm.common import by_value, n_words, shared_folder, spare, text_key, written

by_value(__name__)

def rounds_for(window: int) -> int:
    """More rounds make rarer keys, but symbols near the window's length serve few windows: 2 below 30 words (0.15 keys a word at 20), else 3 (0.11 at 30)."""
    return 2 if window < 30 else 3


_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 2 ** 64))


class Ranges:
    """Names of word ranges: equal words give equal names, whatever stands around them."""

    def __init__(self, words: np.ndarray, which: int = 0):
        base, n = _BASES[which], len(words)
        powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
        self.back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _inverse(base), np.uint64)]))
        values = _mix(words + np.uint64(which)) if which else words
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:n], dtype=np.uint64)])

    def names(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        length = (stop - start).astype(np.uint64)
        return _mix((self.sums[stop] - self.sums[start]) * self.back[start] + length * np.uint64(0xA0761D6478BD642F))


def recompress(ranges: Ranges, edges: np.ndarray, rounds: int):
    """Rounds of naming runs and pairs; yields (starts, low, high) of the boundaries left after each.

    A symbol is a range of words, named by its words, so equal symbols have
    one name in every document of every task.  A round joins neighbours that
    are equal (runs) or of which the left symbol's coin is 0 and the right
    one's 1 (pairs); coins come from the names.  Boundaries at document edges
    stay.  ``low`` and ``high`` bound the words that a boundary depends on:
    wherever these words stand, the boundary is there too.
    """
    total = int(edges[-1])
    at = np.arange(total + 1, dtype=np.int64)
    low, high = at.copy(), at.copy()
    fixed = np.zeros(total + 1, bool)
    fixed[edges] = True
    for k in range(rounds):
        if len(at) < 3:
            return
        names = ranges.names(at[:-1], at[1:])
        coin = (_mix(names + np.uint64(k + 1)) & np.uint64(1)).astype(bool)
        keep = np.ones(len(at), bool)
        keep[1:-1] = (names[:-1] != names[1:]) & ~(~coin[:-1] & coin[1:])
        keep |= fixed[at]
        low = np.concatenate([[-1], low[:-1]])
        high = np.concatenate([high[1:], [total + 1]])
        edge = fixed[at]
        low[edge] = at[edge] - 1
        high[edge] = at[edge] + 1
        at, low, high = at[keep], low[keep], high[keep]
        yield at, low, high


def smallest(names: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where the smallest name of each range stands, the first of equals: two overlapping power-of-two ranges answer each."""
    out, size = np.empty(len(begin), np.int64), end - begin
    best, width = np.arange(len(names)), 1
    while len(begin):
        now = (size >= width) & (size < 2 * width)
        a, b = best[begin[now]], best[end[now] - width]
        out[now] = np.where(names[a] <= names[b], a, b)
        if not (size >= 2 * width).any():
            return out
        a, b = best[:-width], best[width:]
        best, width = np.where(names[a] <= names[b], a, b), 2 * width
    return out


def anchor_windows(ranges: Ranges, edges: np.ndarray, window: int, rounds: int):
    """(key, first window, last window + 1): the windows of the documents, in segments that share an anchor.

    A window's anchor is a boundary of the highest round that has one that
    depends on nothing outside the window, and of these the one of smallest
    name.  The name stands for the words on which the boundary depends, so
    equal windows have equal keys, and neighbouring windows mostly share one.
    A window without such a boundary is its own segment and key.
    """
    total = int(edges[-1])
    free = np.zeros(total + 1, bool)
    for a, b in zip(edges[:-1], edges[1:]):
        free[a:max(a, b - window + 1)] = True
    key = np.zeros(total + 1, np.uint64)
    owner = np.full(total + 1, -1, np.int64)
    levels = list(recompress(ranges, edges, rounds))
    for k in reversed(range(len(levels))):
        at, low, high = levels[k]
        fit = (high - low <= window) & (low >= 0) & (high <= total)
        at, low, high = at[fit], low[fit], high[fit]
        if not len(at):
            continue
        names = _mix(ranges.names(low, high) + np.uint64(1000 * (k + 1)) * np.uint64(window) + (at - low).astype(np.uint64))
        starts = np.flatnonzero(free)
        before, upto = np.cumsum(np.bincount(low, minlength=total + 1)), np.cumsum(np.bincount(high, minlength=total + 1))
        begin = np.where(starts > 0, before[starts - 1], 0)
        end = upto[np.minimum(starts + window, total)]
        ok = begin < end
        starts = starts[ok]
        chosen = smallest(names, begin[ok], end[ok])
        key[starts] = names[chosen]
        owner[starts] = at[chosen] * (rounds + 1) + k
        free[starts] = False
    alone = np.flatnonzero(free)
    key[alone] = ranges.names(alone, alone + window)
    owner[alone] = alone * (rounds + 1) + rounds
    starts = np.flatnonzero(owner >= 0)
    if not len(starts):
        return np.empty(0, np.uint64), starts, starts
    cut = np.concatenate([[True], (starts[1:] != starts[:-1] + 1) | (owner[starts[1:]] != owner[starts[:-1]])])
    a = starts[cut]
    return key[a], a, np.append(starts[np.flatnonzero(cut)[1:] - 1], starts[-1]) + 1


def _batch_words(texts: list[bytes]):
    parts = [t.split() for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
    words = np.fromiter((h for p in parts for h in map(xxhash.xxh3_64_intdigest, p)), np.uint64, int(edges[-1]))
    return words, edges


def _texts(column) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in column]


def _slices(batch, limit: int = 4_000_000):
    """Parts of a batch of at most ``limit`` bytes of text, or one row."""
    n = np.asarray(batch.column("bytes"))
    begin, size = 0, 0
    for i in range(batch.num_rows):
        if size and size + n[i] > limit:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += int(n[i])
    if batch.num_rows > begin:
        yield batch.slice(begin)


SEGMENTS = pa.schema([
    ("key", pa.int64()), ("name", pa.int64()), ("doc_id", pa.int64()), ("tk", pa.int64()), ("p0", pa.int32()), ("p1", pa.int32()), ("state", pa.int8())])
# What a batch knows of a segment.  Its words are the only ones under its key, or the first or the next of several, or they start earlier here.
ALONE, FIRST, NEXT, LATER = range(4)


def _rank(ids: list) -> np.ndarray:
    """Place of each id among the batch's ids, null first."""
    rank = {d: i for i, d in enumerate(sorted(set(ids), key=lambda d: (d is not None, d)))}
    return np.array([rank[d] for d in ids], np.int64)


def _emit_segments(batches, window: int, rounds: int):
    """Segments of a task's documents, with the name of all their words and what the batch knows of them.

    ALONE and FIRST, at most one row of a key and batch, have to meet those of
    other batches; of NEXT and LATER all is known here.
    """
    for batch in batches:
        for part in _slices(batch):
            ids, keys = part.column("doc_id").to_pylist(), part.column("tk").to_pylist()
            first: dict = {}
            for row, (d, t) in enumerate(zip(ids, keys)):
                best = first.get(t)
                if best is None or (ids[best] is not None and (d is None or d < ids[best])):
                    first[t] = row
            rows = np.array(sorted(first.values()), np.int64)
            words, edges = _batch_words(_texts(part.column("text").take(pa.array(rows))))
            key, a, b = anchor_windows(Ranges(words), edges, window, rounds) if edges[-1] else (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 2
            if not len(key):
                continue
            name = Ranges(words, 1).names(a, b + window - 1)
            doc = np.searchsorted(edges, a, side="right") - 1
            place, by_text = a - edges[doc], np.array(keys, np.int64)[rows][doc]
            order = np.lexsort((by_text, place, _rank(ids)[rows][doc], name, key))
            new_key = np.concatenate([[True], key[order][1:] != key[order][:-1]])
            new = new_key | np.concatenate([[True], name[order][1:] != name[order][:-1]])
            of_key = np.cumsum(new_key) - 1
            several = np.bincount(of_key, weights=new)[of_key] > 1
            state = np.empty(len(key), np.int8)
            state[order] = np.where(~new, LATER, np.where(~several, ALONE, np.where(new_key, FIRST, NEXT)))
            owner = pa.array(rows[doc])
            yield pa.RecordBatch.from_arrays([
                pa.array(key.view(np.int64)), pa.array(name.view(np.int64)), part.column("doc_id").take(owner).cast(pa.int64()),
                pa.array(by_text), pa.array(place.astype(np.int32)), pa.array((b - edges[doc]).astype(np.int32)), pa.array(state)], schema=SEGMENTS)


WINDOWS = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc_id", pa.int64()), ("tk", pa.int64()), ("p", pa.int32()), ("later", pa.bool_())])


def _emit_windows(batches, window: int):
    """128-bit names of the windows of the listed segments; those that start earlier within the batch are ``later`` and need no name."""
    for batch in batches:
        for part in _slices(batch):
            words, edges = _batch_words(_texts(part.column("text")))
            if not edges[-1]:
                continue
            take = np.zeros(int(edges[-1]) + 1, bool)
            for row, segments in enumerate(part.column("segments")):
                base, room = int(edges[row]), int(edges[row + 1] - edges[row]) - window + 1
                for s in segments.as_py():
                    take[base + s["p0"]:base + min(s["p1"], max(room, 0))] = True
            at = np.flatnonzero(take)
            if not len(at):
                continue
            w1, w2 = Ranges(words, 0).names(at, at + window), Ranges(words, 1).names(at, at + window)
            doc = np.searchsorted(edges, at, side="right") - 1
            place = at - edges[doc]
            by_id = _rank(part.column("doc_id").to_pylist())[doc]
            by_text = np.array(part.column("tk").to_pylist(), np.int64)[doc]
            order = np.lexsort((by_text, place, by_id, w2, w1))
            new = np.concatenate([[True], (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])])
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            later = np.empty(len(at), bool)
            later[order] = (by_id[order] != by_id[lead]) | (place[order] != place[lead]) | (by_text[order] != by_text[lead])
            owner = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(w1.view(np.int64), mask=later), pa.array(w2.view(np.int64), mask=later), part.column("doc_id").take(owner).cast(pa.int64()),
                part.column("tk").take(owner), pa.array(place.astype(np.int32)), pa.array(later)], schema=WINDOWS)


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans`` (sorted, word numbers) and the spaces that follow them."""
    found = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        begin = found[a][0]
        if b >= len(found):  # nothing follows: the spaces before go too
            begin, stop = (found[a - 1][1] if a else 0), len(text)
        else:
            stop = found[b][0]
        out.append(text[at:begin])
        at = stop
    out.append(text[at:])
    return b"".join(out)


def _spans(starts: list[dict], window: int) -> list[tuple[int, int]]:
    """Word ranges that the windows starting in [p0, p1) cover."""
    out: list[list[int]] = []
    for p0, p1 in sorted((s["p0"], s["p1"]) for s in starts):
        stop = p1 - 1 + window
        if out and p0 <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([p0, stop])
    return [(a, b) for a, b in out]


def _apply(batches, window: int, names: tuple[str, ...], schema: pa.Schema):
    """Replace the text of rows with removals; the others pass as they are."""
    text_col, copy, starts, count, removed, spans = names
    for batch in batches:
        texts, gone, cuts = [], [], []
        for t, whole, ps, n in zip(*(batch.column(c).to_pylist() for c in (text_col, copy, starts, count))):
            cut = [(0, n)] if whole and n >= window else _spans(ps or [], window)
            gone.append(sum(b - a for a, b in cut))
            cuts.append([{"start": a, "stop": b} for a, b in cut])
            texts.append(cut_words(t.encode("utf-8", "surrogatepass"), cut).decode("utf-8", "surrogatepass") if cut else t)
        made = {text_col: pa.array(texts, pa.string()), removed: pa.array(gone, pa.int64()), spans: pa.array(cuts, schema.field(spans).type)}
        yield pa.RecordBatch.from_arrays([made.get(f.name, batch.column(f.name) if f.name not in made else None).cast(f.type) for f in schema], schema=schema)


def remove_repeats(
    docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None, folder: str | None = None,
) -> DataFrame:
    """``docs`` without the words of passages that stand earlier too.

    A window is ``window`` consecutive words of one row.  Every word covered by
    a window whose words also start earlier (smaller id, or earlier in the same
    row) goes; windows are judged on the input.  Adds n_words, n_removed and
    removed_spans (word numbers [start, stop)).

    1. ``rounds`` rounds of recompression name the words, runs and pairs of all rows by what they
       hold, so names agree across tasks without a dictionary.  Each window is
       anchored at its highest symbol boundary that depends on nothing outside
       it; neighbouring windows share an anchor, which is one row.
    2. Segments of one key are brought together; keys seen once are done.  Of
       segments whose words are all equal, every one but the first goes whole,
       and no window of it is named.  Within a batch of rows that is known
       already: a key sends one row per batch.
    3. Only keys whose segments differ are left, as at the ends of a passage.
       The first segments of each wording get 128-bit names for their windows
       and the first of each name is found; the rest are removals.
    Rows of equal text are settled first: all but the smallest id go whole.

    Odd rows: null text: 0 words, stays null; fewer than ``window`` words: as
    they are; text that vanishes: empty; null id: counts as the smallest;
    repeated rows (same id and text): one document, all come back alike; texts
    that share an id start "earlier" by their place, then by their text key.  Empty table: empty
    result.  Clashing column names: the new ones get an underscore.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "substring")
    rounds = rounds or rounds_for(window)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("tk"), F.col(text_col).cast("string").alias("text"))
    sized = keyed.filter("text is not null").withColumn("bytes", F.octet_length("text"))
    same_row = lambda first: F.col("doc_id").eqNullSafe(F.col(f"{first}.doc_id")) & (F.col("tk") == F.col(f"{first}.tk"))

    # Rows of equal texts: text key, length and a second hash.
    narrow = keyed.filter("text is not null").select("doc_id", "tk", F.struct("tk", F.octet_length("text"), F.crc32(F.encode("text", "UTF-8"))).alias("same"))
    first = narrow.groupBy("same").agg(F.min(F.struct("doc_id")).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("same", F.col("m.doc_id").alias("first"))
    copies = written(narrow.join(first, "same").filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "tk").distinct(), folder, "copies")

    segments = written(sized.select("doc_id", "tk", "text", "bytes").mapInArrow(
        lambda b: _emit_segments(b, window, rounds), "key long, name long, doc_id long, tk long, p0 int, p1 int, state byte"), folder, "segments")
    of_key, of_words = Window.partitionBy("key"), Window.partitionBy("key", "name")
    seen = segments.filter(F.col("state") < NEXT).withColumns({
        "n": F.count(F.lit(1)).over(of_key),
        "several": (F.min("name").over(of_key) != F.max("name").over(of_key)) | (F.max("state").over(of_key) == FIRST),
    }).filter((F.col("n") > 1) | F.col("several")).withColumn("first", F.min(F.struct("doc_id", "p0", "tk")).over(of_words)).withColumn(
        "later", ~(same_row("first") & (F.col("p0") == F.col("first.p0")))).filter("later or several")
    place = ["doc_id", "tk", "p0", "p1"]
    met = seen.select(*place, "later").unionByName(segments.filter(F.col("state") >= NEXT).select(*place, (F.col("state") == LATER).alias("later")))
    met = written(met.join(copies, met["doc_id"].eqNullSafe(copies["doc_id"]) & (met["tk"] == copies["tk"]), "left_anti"), folder, "met")
    asked = met.filter("not later").groupBy(F.col("doc_id").alias("d"), F.col("tk").alias("k")).agg(F.collect_set(F.struct("p0", "p1")).alias("segments"))

    wanted = written(asked, folder, "wanted")
    found = sized.join(wanted.hint("shuffle_hash"), sized["doc_id"].eqNullSafe(wanted["d"]) & (sized["tk"] == wanted["k"]))
    named = written(found.select("doc_id", "tk", "text", "bytes", "segments").mapInArrow(
        lambda b: _emit_windows(b, window), "w1 long, w2 long, doc_id long, tk long, p int, later boolean"), folder, "windows")
    of_name = Window.partitionBy("w1", "w2")
    other = named.filter("not later").withColumn("first", F.min(F.struct("doc_id", "p", "tk")).over(of_name)).filter(
        ~(same_row("first") & (F.col("p") == F.col("first.p"))))
    one = ["doc_id", "tk", F.col("p").alias("p0"), (F.col("p") + 1).alias("p1")]
    gone = met.filter("later").select(place).unionByName(named.filter("later").select(one)).unionByName(other.select(one)).groupBy("doc_id", "tk").agg(
        F.collect_set(F.struct("p0", "p1")).alias("starts"), F.lit(False).alias("copy"))
    info = written(gone.unionByName(copies.select("doc_id", "tk", F.array().cast("array<struct<p0:int,p1:int>>").alias("starts"), F.lit(True).alias("copy"))), folder, "gone")

    count, removed, spans = spare(docs, "n_words", "n_removed", "removed_spans")
    ps, copy, i_id, i_tk, tk = spare(docs, "_starts", "_copy", "_i_id", "_i_tk", "_tk")
    mine = info.select(F.col("doc_id").alias(i_id), F.col("tk").alias(i_tk), F.col("starts").alias(ps), F.col("copy").alias(copy))
    joined = docs.withColumn(tk, text_key(text_col)).join(
        mine.hint("shuffle_hash"), F.col(id_col).cast("long").eqNullSafe(F.col(i_id)) & (F.col(tk) == F.col(i_tk)), "left")
    joined = joined.withColumn(count, n_words(text_col)).drop(tk, i_id, i_tk)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    out = T.StructType([*docs.schema.fields, T.StructField(count, T.LongType()), T.StructField(removed, T.LongType()), T.StructField(spans, span)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        return _apply(batches, window, (text_col, copy, ps, count, removed, spans), to_arrow_schema(out))

    return joined.mapInArrow(run, out)
