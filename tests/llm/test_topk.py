import numpy as np

from uipatterns.llm.topk import exact_top_k, search_block


def brute(rows, k):
    best, rows = {}, list(rows.items()) if isinstance(rows, dict) else rows
    for a, v in rows:
        if a % 2 == 0:
            found = sorted((-sum(x * y for x, y in zip(v, w)), b) for b, w in rows if b != a and len(w) == len(v))[:k]
            best[a] = [(b, -s) for s, b in found]
    return best


def test_block_search_equals_all_products_with_ties_and_large_numbers():
    rng = np.random.default_rng(3)
    for top in (3, 40, 2 ** 29):
        v = rng.integers(-top, top, (300, 20))
        v[100:180] = v[5]
        ids = rng.permutation(1000)[:300]
        qi, vec, score = search_block(ids[:40], v[:40], ids, v, 7, width=4, batch=16)
        want = brute({int(i): [int(x) for x in r] for i, r in zip(ids, v)}, 7)
        for i in range(40):
            if ids[i] % 2 == 0:
                got = sorted(((int(a), int(s)) for a, s in zip(vec[qi == i], score[qi == i])), key=lambda x: (-x[1], x[0]))
                assert got == want[int(ids[i])]


def test_odd_rows_and_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "x") for i in range(120)]
    rows += [(500, None, None), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (504, [float("nan")] * 6, "x"), (None, [1.0] * 6, "x"),
             (506, [0.0] * 6, "x"), (508, [1.0, 2.0], "x"), (509, [1.0, 2.0], "x"), (3, rows[3][1], "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in exact_top_k(df, "vec_id % 2 = 0", k=5, query_block=40, row_block=30, width=2).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    plain = [(i, [int(np.floor(64 * x)) for x in v]) for i, v, _ in rows[:120] + rows[-1:]]  # the repeated row counts twice
    want = brute([*plain, (506, [0] * 6), (508, [64, 128]), (509, [64, 128])], 5)
    assert {q: [x[r] for r in sorted(x)] for q, x in got.items()} == {q: w for q, w in want.items() if w}
    assert exact_top_k(df.limit(0), "vec_id % 2 = 0").count() == 0


def test_rows_that_share_an_id_all_count(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 2.0]), (2, [3.0, 0.0]), (3, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"] // 4096) for r in exact_top_k(df, "vec_id % 2 = 0", k=3).collect())
    one, two = [(3, 6), (1, 2), (1, 2)], [(3, 6), (1, 3), (1, 0)]  # of [1, 2] and of [3, 0]
    assert got == sorted((2, i + 1, *x) for found in (one, two) for i, x in enumerate(found))
