"""Approximate nearest neighbours (largest inner product) with balanced posting lists."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from uipatterns.llm.common import by_value, fresh, hash_sample, shared_folder, written

by_value(__name__)

FOUND = "query_id long, qk long, vec_id long, vk long, score double, copies long"


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1))


def lift(vectors: np.ndarray, most: float) -> np.ndarray:
    """One more component, so that the nearest of a query (lifted by 0) is the one of largest inner product."""
    rest = np.sqrt(np.maximum(0, most * most - (vectors * vectors).sum(axis=1)))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def balanced_centroids(sample: np.ndarray, starts: np.ndarray, rounds: int = 10, push: float = 0.05) -> np.ndarray:
    """Means, one for each start, whose lists are of like sizes: each round, a list above the mean size gets a handicap."""
    k = len(starts)
    centroids, handicap = starts.copy(), np.zeros(k)
    for _ in range(rounds):
        nearest, spread = [], 0.0
        for at in range(0, len(sample), 4_096):
            d = square_distances(sample[at:at + 4_096], centroids)
            spread = max(spread, float(d.std()))
            nearest.append((d + handicap).argmin(axis=1))
        own = np.concatenate(nearest)
        count = np.bincount(own, minlength=k)
        handicap += push * spread * (count / count.mean() - 1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    return centroids


def centroid_graph(centroids: np.ndarray, near: int = 12, far: int = 4) -> np.ndarray:
    """Neighbours of each centroid: its nearest ones and a few distant ones, as a table of numbers."""
    k = len(centroids)
    near, far = min(near, k - 1), min(far, max(k - 1, 0))
    out = np.empty((k, near + far), np.int64)
    for at in range(0, k, 1_024):
        d = square_distances(centroids[at:at + 1_024], centroids)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at:at + len(d), :near] = np.argsort(d, axis=1, kind="stable")[:, :near]
    for j in range(far):  # fixed strides make the graph connected and its paths short
        out[:, near + j] = (np.arange(k) + max(1, k // (2 ** (far - j)))) % k
    out[:, near + far - 1:] = ((np.arange(k) + 1) % k)[:, None] if far else out[:, near + far - 1:]
    return out


def graph_search(x: np.ndarray, centroids: np.ndarray, graph: np.ndarray, ratio: float, width: int = 24) -> np.ndarray:
    """Distances of each row to the centroids that the graph search reached; infinite elsewhere.

    From a common entry each row expands its nearest unexpanded centroid, until
    ``width`` are expanded and none that is left lies within ``ratio`` of the
    nearest found.
    """
    n, k = len(x), len(centroids)
    seen = np.full((n, k), np.inf)
    open_ = np.full((n, k), np.inf)
    norm = (centroids * centroids).sum(axis=1)
    own = (x * x).sum(axis=1)
    starts = np.unique(np.linspace(0, k - 1, num=min(k, 8)).astype(np.int64))
    first = np.sqrt(square_distances(x, centroids[starts]))
    seen[:, starts] = open_[:, starts] = first
    rows = np.arange(n)
    for turn in range(k):
        best = open_[rows].argmin(axis=1)
        reach = open_[rows, best]
        limit = seen[rows].min(axis=1) * (1 + ratio)
        go = np.isfinite(reach) & ((turn < width) | (reach <= limit))
        rows, best = rows[go], best[go]
        if not len(rows):
            break
        open_[rows, best] = np.inf
        to = graph[best]
        at = np.repeat(rows, to.shape[1]), to.ravel()
        new = ~np.isfinite(seen[at])
        r, c = at[0][new], at[1][new]
        if len(r):
            d = np.sqrt(np.maximum(0, own[r] - 2 * np.einsum("ij,ij->i", x[r], centroids[c]) + norm[c]))
            seen[r, c] = d
            open_[r, c] = d
    return seen


def chosen_lists(
    x: np.ndarray, centroids: np.ndarray, graph: np.ndarray, ratio: float, most: int | None = None, fewest: int = 1,
) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists within (1 + ``ratio``) of the nearest one; of them the nearest ``most``, but the nearest ``fewest`` at least."""
    rows, lists = [], []
    for at in range(0, len(x), 512):
        d = graph_search(x[at:at + 512], centroids, graph, ratio, max(24, fewest))
        take = d <= d.min(axis=1, keepdims=True) * (1 + ratio)
        place = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1, kind="stable")
        take = (take & (place < (most or d.shape[1]))) | (place < fewest)
        r, c = np.nonzero(take)
        rows.append(r + at)
        lists.append(c)
    return np.concatenate(rows), np.concatenate(lists)


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _assign(batches, centroids, graph, norm: float, query: bool, ratio: float, most, fewest: int, schema: pa.Schema):
    for batch in batches:
        if not batch.num_rows:
            continue
        v = _matrix(batch.column("v"))
        lifted = np.concatenate([v, np.zeros((len(v), 1))], axis=1) if query else lift(v, norm)
        rows, lists = chosen_lists(lifted, centroids, graph, ratio, most, fewest)
        for at in range(0, len(rows), 20_000):
            take = pa.array(rows[at:at + 20_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists[at:at + 20_000].astype(np.int32)), *[batch.column(c).take(take) for c in ("id", "vk", "copies", "v")]], schema=schema)


@dataclass
class Index:
    """Centroids and their graph (bounded by the sample), the posting lists (a DataFrame), and where each list lies."""

    centroids: np.ndarray
    graph: np.ndarray
    norm: float
    postings: DataFrame  # list, id, v
    groups: np.ndarray  # list -> group of lists that one task searches
    chunks: np.ndarray  # list -> number of chunks; over 1 for a list too large for one task
    counts: np.ndarray  # list -> rows
    copies: int  # lists that one row is in, at most
    ratio: float  # lists within (1 + ratio) of a query's nearest held the wanted share of neighbours in the sample
    folder: str


ASSIGNED = pa.schema([("list", pa.int32()), ("id", pa.int64()), ("vk", pa.int64()), ("copies", pa.int64()), ("v", pa.list_(pa.float64()))])
_ASSIGNED = "list int, id long, vk long, copies long, v array<double>"
_ROWS = "id long, vk long, copies long, v array<double>"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vk, copies, v) in double precision, without null, zero or non-finite vectors: distinct rows, a hash of the vector and how many rows are so."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    return rows.groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies")).select("id", F.xxhash64("v").alias("vk"), "copies", "v")


def fitted_ratio(points: np.ndarray, centroids: np.ndarray, graph: np.ndarray, k: int, recall: float, replicate: float, copies: int, queries: int = 500) -> float:
    """The ratio at which the lists of a query held ``recall`` of its ``k`` best among the sample.

    ``points`` are lifted rows in order of a hash.  The last ``queries`` of
    them ask: centroids start at the first ones, and lie too near to those.
    Neighbours in a sample lie further away than those among all
    rows, so for a larger table the ratio is on the safe side.
    """
    first = max(0, len(points) - queries)
    asked = np.concatenate([points[first:, :-1], np.zeros((len(points) - first, 1))], axis=1)
    k = min(k, len(points) - 1)
    if k < 1:
        return 0.0
    rows, lists = chosen_lists(points, centroids, graph, replicate, copies)
    start = np.searchsorted(rows, np.arange(len(points) + 1))
    far = np.sqrt(square_distances(asked, centroids))
    far = far / np.maximum(far.min(axis=1, keepdims=True), 1e-300) - 1
    needed = []
    for i, q in enumerate(asked):
        score = points @ q
        score[first + i] = -np.inf
        best = np.argpartition(-score, k - 1)[:k]
        needed += [far[i, lists[start[b]:start[b + 1]]].min() for b in best]
    return float(np.quantile(needed, recall, method="higher"))


def build_index(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 20_000, sample_bytes: int = 32 << 20, most_lists: int = 4_096,
    replicate: float = 0.05, copies: int = 2, group_rows: int = 16_384, recall: float = 0.94, k: int = 20, folder: str | None = None,
) -> Index | None:
    """Posting lists over all usable rows.

    Centroids are fitted on about ``sample`` rows of smallest hash, at most
    ``sample_bytes`` of them at any size; there are about 2 sqrt(rows) lists,
    at most ``most_lists``.  The same sample gives the ratio at which a search
    for ``k`` finds ``recall`` of the neighbours.  Every row goes to its nearest list and, near a boundary,
    to up to ``copies`` lists within (1 + ``replicate``) of the nearest.
    Lists are searched in groups of about ``group_rows`` rows; a list larger
    than that is dealt into chunks by a hash of the row, so equal vectors that
    fill a third of the table load no single task.  None if no row is usable.

    All vectors must have one length; others are an error.
    """
    folder = folder or shared_folder(vectors.sparkSession, "ann")
    rows = written(usable(vectors, id_col, vector_col), folder, "rows")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b"),
                     F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    if not facts["n"]:
        return None
    if facts["a"] != facts["b"]:
        raise ValueError(f"vectors have {facts['a']} to {facts['b']} components")
    norm = math.sqrt(facts["m"])
    sample = max(1, min(sample, sample_bytes // (8 * facts["a"])))
    few = hash_sample(rows, sample, "id", "vk").orderBy(F.xxhash64("id", "vk"), "id").limit(sample).toPandas()
    points = lift(np.stack(few["v"].to_numpy()).astype(np.float64), norm)
    lists = max(1, min(most_lists, round(2 * math.sqrt(facts["n"])), len(points) // 4))
    lists = len(starts := np.unique(points[:lists], axis=0))
    centroids = balanced_centroids(points, starts)
    graph = centroid_graph(centroids)
    postings = written(rows.mapInArrow(lambda b: _assign(b, centroids, graph, norm, False, replicate, copies, 1, ASSIGNED), _ASSIGNED), folder, "postings")
    count = np.zeros(lists, np.int64)
    for r in postings.groupBy("list").count().collect():  # at most most_lists rows
        count[r["list"]] = r["count"]
    # Neighbouring lists share a group: order them along the main axis of the centroids.
    axis = np.linalg.svd(centroids - centroids.mean(axis=0), full_matrices=False)[2][0]
    groups, chunks, group, filled = np.zeros(lists, np.int64), np.maximum(1, -(-count // group_rows)), 0, 0
    for j in np.argsort(centroids @ axis, kind="stable"):
        if filled and filled + count[j] > group_rows:
            group, filled = group + 1, 0
        groups[j] = group
        filled += int(count[j])
    ratio = fitted_ratio(points, centroids, graph, k, recall, replicate, copies)
    return Index(centroids, graph, norm, postings, groups, chunks, count, copies, ratio, folder)


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components whatever stands around them."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * v[:, j]
    return out


def _best(qi, vi, approx, q, v, row, ids, k: int, copies: int):
    """The ``k`` best candidates of each query by exact score, then id; each row once, though it may lie in ``copies`` lists."""
    order = np.lexsort((-approx, qi))
    qi, vi, approx = qi[order], vi[order], approx[order]
    start = np.searchsorted(qi, qi, side="left")
    kth = np.minimum(start + copies * k - 1, np.searchsorted(qi, qi, side="right") - 1)
    near = approx >= approx[kth] - 1e-9 * (1 + np.abs(approx[kth]))
    qi, vi = qi[near], vi[near]
    score = exact_scores(q[qi], v[vi])
    order = np.lexsort((row[vi], ids[vi], -score, qi))
    qi, vi, score = qi[order], vi[order], score[order]
    again = np.concatenate([[False], (qi[1:] == qi[:-1]) & (row[vi][1:] == row[vi][:-1])])
    qi, vi, score = qi[~again], vi[~again], score[~again]
    take = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
    return qi[take], vi[take], score[take]


def _search_cell(queries: pd.DataFrame, rows: pd.DataFrame, k: int, copies: int, most: int = 2_000_000) -> pd.DataFrame:
    """The best ``k`` rows of a group of lists for each query; a query sees the lists it chose.

    Each list is scored once for the queries that chose it.  A list's own k-th
    best is a bound for its queries; what reaches the bound waits, and is put
    in order once per block of queries (or when ``most`` of it wait).
    """
    names = ("query_id", "qk", "vec_id", "vk", "score", "copies")
    if not len(queries) or not len(rows):
        return pd.DataFrame({n: [] for n in names}).astype({n: "float64" if n == "score" else "int64" for n in names})
    rows = rows.sort_values(["list", "id", "vk"], kind="stable")
    ids, vk, many, v, lists = rows["id"].to_numpy(), rows["vk"].to_numpy(), rows["copies"].to_numpy(), np.stack(rows["v"].to_numpy()), rows["list"].to_numpy()
    row = np.unique(np.stack([ids, vk]), axis=1, return_inverse=True)[1].reshape(-1)  # a row has one number in all its lists
    out: dict = {n: [] for n in names}
    for at in range(0, len(queries), 1_024):
        block = queries.iloc[at:at + 1_024]
        q_ids, qk, q = block["id"].to_numpy(), block["qk"].to_numpy(), np.stack(block["v"].to_numpy())
        wants = np.repeat(np.arange(len(block)), [len(x) for x in block["lists"]])
        wanted = np.concatenate(block["lists"].to_numpy())
        floor, hold, waiting = np.full(len(block), -np.inf), [], 0
        for name in np.unique(lists):
            a, b = np.searchsorted(lists, name, "left"), np.searchsorted(lists, name, "right")
            who = wants[wanted == name]
            for cut in range(a, b if len(who) else a, 2_048):
                stop = min(b, cut + 2_048)
                s = q[who] @ v[cut:stop].T
                s[q_ids[who][:, None] == ids[None, cut:stop]] = -np.inf
                if stop - cut >= k:  # rows of a list differ, so its k-th best bounds the k-th best of all
                    floor[who] = np.maximum(floor[who], np.partition(s, stop - cut - k, axis=1)[:, stop - cut - k])
                f = floor[who]
                least = f - 1e-9 * (1 + np.abs(np.where(np.isfinite(f), f, 0)))
                r, c = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                hold.append((who[r], c + cut, s[r, c]))
                waiting += len(r)
                if waiting > most:
                    hold = [_best(*map(np.concatenate, zip(*hold)), q, v, row, ids, k, copies)]
                    waiting = len(hold[0][0])
        if not hold:
            continue
        qi, vi, score = _best(*map(np.concatenate, zip(*hold)), q, v, row, ids, k, copies)
        for n, x in zip(names, (q_ids[qi], qk[qi], ids[vi], vk[vi], score, np.minimum(many[vi], k))):
            out[n].append(x)
    return pd.DataFrame({n: np.concatenate(x) if x else np.empty(0, "float64" if n == "score" else "int64") for n, x in out.items()})


def search(index: Index, is_query: str, k: int = 20, id_col: str = "vec_id", ratio: float | None = None, query_block: int = 8_192) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each indexed row that ``is_query`` (SQL on the id) selects.

    A query searches the lists whose centroids lie within (1 + ``ratio``, by
    default the index's) of its nearest one, found by walking the centroid graph, and always as many
    lists as surely hold ``k`` other rows.  Queries of a group
    of lists come in blocks; a group and a block are one bounded task group
    that returns ``k`` rows per query.
    """
    centroids, graph, groups, chunks, norm = index.centroids, index.graph, index.groups, index.chunks, index.norm
    spark, ratio, copies = index.postings.sparkSession, index.ratio if ratio is None else ratio, index.copies
    enough = np.searchsorted(np.cumsum(np.sort(index.counts)), (k + 1) * copies) + 1
    fewest = int(min(len(groups), enough))
    places = spark.createDataFrame([(j, int(groups[j]), int(chunks[j])) for j in range(len(groups))], "list int, g int, chunks int")
    rows = spark.read.schema(_ROWS).parquet(f"{index.folder}/rows")
    asked = rows.withColumnRenamed("id", id_col).filter(F.expr(is_query)).withColumnRenamed(id_col, "id")
    probes = asked.mapInArrow(lambda b: _assign(b, centroids, graph, norm, True, ratio, None, fewest, ASSIGNED), _ASSIGNED)
    # One row per query and group, with the lists it chose there.
    probes = written(probes.join(F.broadcast(places), "list").groupBy("g", "id", F.col("vk").alias("qk")).agg(
        F.collect_list("list").alias("lists"), F.first("v").alias("v"), F.max("chunks").alias("chunks")), index.folder, "probes")
    blocks = written(probes.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(query_block)).cast("int").alias("blocks")), index.folder, "blocks")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n, key: F.pmod(F.xxhash64("id", key), F.col(n)).cast("int")
    most = F.broadcast(places.groupBy("g").agg(F.max("chunks").alias("most")))
    left = probes.drop("chunks").join(most, "g").join(blocks, "g").select("g", part("blocks", "qk").alias("b"), upto("most").alias("c"), "id", "qk", "v", "lists")
    right = fresh(index.postings.join(F.broadcast(places), "list").join(blocks, "g").select(
        "g", upto("blocks").alias("b"), part("chunks", "vk").alias("c"), "list", "id", "vk", "copies", "v"))
    key = ["g", "b", "c"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda a, b: _search_cell(a, b, k, copies), FOUND)
    once = found.groupBy("query_id", "qk", "vec_id", "vk").agg(F.max("score").alias("score"), F.max("copies").alias("copies"))
    once = once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    order = Window.partitionBy("query_id", "qk").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", ratio: float | None = None, **options) -> DataFrame:
    """Index all rows, then search.  No usable row: an empty result.

    Null ids, null or zero vectors, and vectors with null or non-finite
    components take no part.  Rows that repeat an id are candidates each; as
    queries, each different vector of an id has its own ranks.  Ties go to the
    smaller id.  Fewer than ``k`` others: all of them.  Extra columns are ignored.
    """
    index = build_index(vectors, id_col, vector_col, k=k, **options)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, is_query, k, id_col, ratio)
