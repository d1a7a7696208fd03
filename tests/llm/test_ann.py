import numpy as np
import pytest

from uipatterns.llm import ann


def brute(rows, k):
    out = {}
    for a, v in rows:
        if a % 5 == 0:
            out[a] = [b for _, b in sorted((-float(np.dot(v, w)), b) for b, w in rows if b != a)[:k]]
    return out


def test_recall_ties_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(700, 12))
    v[300:500] = v[7]  # a vector that many rows share
    rows = [(i, [float(x) for x in r], 1.0) for i, r in enumerate(v)]
    odd = [(900, None, 1.0), (905, [0.0] * 12, 1.0), (910, [float("inf")] * 12, 1.0), (915, [None] * 12, 1.0), (None, [1.0] * 12, 1.0), (3, rows[3][1], 2.0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score double")
    got = {}
    for r in ann.nearest(df, "vec_id % 5 = 0", k=10, group_rows=120).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute([*((i, np.array(r)) for i, r, _ in rows), (3, np.array(rows[3][1]))], 10)  # the repeated row counts twice
    assert set(got) == set(want) and all(sorted(x) == list(range(1, 11)) for x in got.values())
    found = np.mean([b in {x[0] for x in got[a].values()} for a, w in want.items() for b in w])
    assert found >= 0.9
    for a, x in got.items():
        ranked = [x[i] for i in sorted(x)]
        assert ranked == sorted(ranked, key=lambda y: (-y[1], y[0]))
        assert all(s == pytest.approx(float(np.dot(v[a], v[b])), abs=1e-9) for b, s in ranked)
    assert [b for b, _ in (got[300][i] for i in range(1, 11))] == want[300]


def test_fewer_than_k_and_empty(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(8)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, "vec_id % 5 = 0", k=20).collect()
    assert len(got) == 14 and {r["query_id"] for r in got} == {0, 5}
    assert ann.nearest(df.limit(0), "vec_id % 5 = 0").count() == 0


def test_the_graph_search_finds_the_nearest_centroid():
    rng = np.random.default_rng(0)
    c, x = rng.normal(size=(200, 8)), rng.normal(size=(50, 8))
    d = ann.graph_search(x, c, ann.centroid_graph(c), 0.1)
    true = np.sqrt(ann.square_distances(x, c)).argmin(axis=1)
    assert np.mean(d.argmin(axis=1) == true) > 0.9


def test_rows_that_share_an_id_all_count(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (5, [1.0, 2.0]), (5, [3.0, 1.0]), (3, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, "vec_id % 5 = 0", k=3).collect())
    one, two = [(3, 6.0), (1, 2.0), (1, 2.0)], [(3, 8.0), (1, 3.0), (1, 1.0)]  # of [1, 2] and of [3, 1]
    assert got == sorted((5, i + 1, *x) for found in (one, two) for i, x in enumerate(found))


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, size):
    import os

    path = f"/root/testdata/{size}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    df = spark.read.parquet(path)
    rows = df.toPandas()
    v, ids = np.stack(rows["embedding"].to_numpy()).astype(float), rows["vec_id"].to_numpy()
    got = {}
    for r in ann.nearest(df, "vec_id % 20 = 0").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        s[i] = -np.inf
        hits.append(len(set(ids[np.lexsort((ids, -s))[:20]]) & got[ids[i]]) / 20)
    assert np.mean(hits) >= 0.9
