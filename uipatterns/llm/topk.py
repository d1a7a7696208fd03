"""Exact top-k search by columnar branch and bound."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from uipatterns.llm.common import by_value

by_value(__name__)

OUT = "query_id long, qk long, vec_id long, score long, copies long"


def search_block(
    q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, width: int = 16, batch: int = 64,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of a block for each query: (query index, id, score)."""
    qi, row, score = search_rows(q_ids, q, ids, v, k, width, batch)
    return qi, ids[row], score


def search_rows(
    q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, width: int = 16, batch: int = 64,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of a block for each query: (query index, row, score); rows of the query's id are its own.

    The block lies in vertical layout: one contiguous array for each block of
    ``width`` dimensions, those of most mass first.  Scores accumulate block
    by block.  What is left of a score is at most |rest of q| * |rest of v|
    (Cauchy-Schwarz); a row whose partial score plus that bound is below the
    k-th best known lower bound can't come in, and the survivors are
    compacted before the next block.  Products stay exact: floats where all
    partial sums are below 2^53, else 64-bit integers.
    """
    n, d = v.shape
    if not n or not len(q):
        none = np.empty(0, np.int64)
        return none, none, none
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    vf, qf = v.astype(np.float64), q.astype(np.float64)
    exact = float(np.abs(vf).max(initial=0)) * float(np.abs(qf).max(initial=0)) * max(d, 1) < 2.0 ** 52
    dims = np.argsort(-(vf * vf).sum(axis=0), kind="stable")
    cuts = [dims[a:a + width] for a in range(0, d, width)]
    kind = np.float64 if exact else np.int64
    columns = [np.ascontiguousarray(v[:, c].T.astype(kind)) for c in cuts]
    parts = [np.ascontiguousarray(q[:, c].astype(kind)) for c in cuts]
    rest_v = [np.sqrt(sum((np.square(vf[:, c]).sum(axis=1) for c in cuts[j + 1:]), np.zeros(n))) for j in range(len(cuts))]
    rest_q = [np.sqrt(sum((np.square(qf[:, c]).sum(axis=1) for c in cuts[j + 1:]), np.zeros(len(q)))) for j in range(len(cuts))]
    out_q, out_id, out_s = [], [], []
    for at in range(0, len(q), batch):
        first = parts[0][at:at + batch] @ columns[0] if cuts else np.zeros((min(batch, len(q) - at), n), kind)
        for i in range(len(first)):
            qi, partial, alive = at + i, first[i], np.flatnonzero(ids != q_ids[at + i])
            partial = partial[alive]
            for j in range(len(cuts)):
                if j:
                    partial = partial + parts[j][qi] @ columns[j][:, alive]
                if j + 1 < len(cuts) and len(alive) > k:
                    slack = rest_q[j][qi] * rest_v[j][alive] * (1 + 1e-9) + 1e-6
                    floor = np.partition(partial - slack, len(alive) - k)[len(alive) - k]
                    keep = partial + slack >= floor
                    alive, partial = alive[keep], partial[keep]
            if len(alive) > k:
                least = np.partition(partial, len(alive) - k)[len(alive) - k]
                keep = partial >= least
                alive, partial = alive[keep], partial[keep]
                keep = np.lexsort((alive, -partial))[:k]
                alive, partial = alive[keep], partial[keep]
            out_q.append(np.full(len(alive), qi))
            out_id.append(order[alive])
            out_s.append(partial.astype(np.int64))
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


def _cell(queries: pd.DataFrame, rows: pd.DataFrame, k: int, width: int) -> pd.DataFrame:
    if not len(queries) or not len(rows):
        return pd.DataFrame({c: [] for c in ("query_id", "qk", "vec_id", "score", "copies")}, dtype="int64")
    q_ids, ids = queries["id"].to_numpy("int64"), rows["id"].to_numpy("int64")
    qi, row, score = search_rows(q_ids, np.stack(queries["v"].to_numpy()), ids, np.stack(rows["v"].to_numpy()), k, width)
    return pd.DataFrame({"query_id": q_ids[qi], "qk": queries["qk"].to_numpy()[qi], "vec_id": ids[row], "score": score,
                         "copies": np.minimum(rows["copies"].to_numpy()[row], k)})


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v, copies): floor(scale * x) of each component, in double precision, and how many rows are so; vectors with a null or non-finite component are left out."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad).groupBy(
        F.col(id_col).cast("long").alias("id"), whole.alias("v")).agg(F.count(F.lit(1)).alias("copies"))


def exact_top_k(
    vectors: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0,
    query_block: int = 16_384, row_block: int = 8_192, width: int = 16,
) -> DataFrame:
    """The ``k`` rows of largest integer inner product for every query, exactly.

    ``is_query`` is an SQL condition on the id.  Components become
    floor(``scale`` * x).  Queries and rows are cut into blocks by a hash of
    the id; each pair of blocks is one task group of bounded size, which keeps
    ``k`` rows per query.  A window with a group limit merges them.  The data
    moved is rows * query blocks + queries * row blocks; larger blocks move
    less and need more memory.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id.
    A query with fewer than ``k`` others gets all of them.  Null vectors, null
    ids, null or non-finite components: no part.  Vectors of different lengths
    aren't compared.  Rows that repeat an id are candidates each; as queries,
    each different vector of an id has its own ranks.  Zero vectors take part.  Empty table: empty result.
    """
    ints = integer_vectors(vectors, id_col, vector_col, scale)
    n_rows = vectors.count()
    n_queries = vectors.filter(f"`{id_col}` is not null").filter(F.expr(is_query)).count()
    slices, groups = max(1, math.ceil(n_rows / row_block)), max(1, math.ceil(n_queries / query_block))
    part = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    length = F.size("v").alias("d")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    named = ints.withColumnRenamed("id", id_col).filter(F.expr(is_query)).withColumnRenamed(id_col, "id")
    queries = named.select(length, part(groups).alias("g"), spread(slices).alias("s"), "id", "v", F.xxhash64("v").alias("qk"))
    rows = ints.select(length, part(slices).alias("s"), spread(groups).alias("g"), "id", "v", "copies")
    key = ["d", "g", "s"]
    found = queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(lambda a, b: _cell(a, b, k, width), OUT)
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    order = Window.partitionBy("query_id", "qk").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
