import math
import re
from collections import Counter

import numpy as np

from uipatterns.llm.ranked import Search, ranked_search


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(items, docs, k=20):
    bags = [(d, words(t)) for d, t in docs]
    bags = [(d, Counter(w), len(w)) for d, w in bags if w]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in set(items):
        hits = []
        for d, bag, size in bags:
            m = 75 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in words(text) if t in bag)
            if score > 0:
                hits.append((-score, 2 ** 63 if d is None else d))
        for rank, (score, d) in enumerate(sorted(hits)[:k], 1):
            out.append((item, rank, None if d == 2 ** 63 else d, -score))
    return sorted(out, key=repr)


def got(spark, items, docs, **how):
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS score")
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS n", "'x' AS term")
    return sorted((tuple(r) for r in ranked_search(i, d, **how).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def random_rows(seed, n_items=30, n_docs=400):
    rng = np.random.default_rng(seed)
    names = np.array([f"{a}{b}" for a in "abcdefgé" for b in "ABCstu9"])
    weight = 1 / np.arange(1, len(names) + 1)
    text = lambda most: " ".join(rng.choice(names, rng.integers(0, most), p=weight / weight.sum()).tolist())
    return [(i, text(12)) for i in range(n_items)], [(i, text(60)) for i in range(n_docs)]


def test_random_rows_equal_brute_force(spark):
    items, docs = random_rows(1)
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # many equal scores
    want = brute(items, docs)
    assert got(spark, items, docs) == want
    assert got(spark, items, docs, sample=5, part_items=7) == want
    assert got(spark, items, docs, block_chars=300) == want  # several blocks
    assert got(spark, items, docs, k=3) == brute(items, docs, 3)


def test_odd_rows(spark):
    items, docs = random_rows(2, 3, 30)
    assert got(spark, items, []) == [] and got(spark, [], docs) == [] and got(spark, [(1, "-")], docs) == []
    docs += [(None, "aA bB cC"), (None, "aA bB"), (3, "aA aA"), (3, "aA aA"), (50, None), (51, "!?"), (52, "aA " * 2_000_000)]
    items += [(None, "aA bB aA"), (7, "aA"), (7, "bB"), (7, "aA"), (8, None), (9, ""), (10, "unheard of")]
    assert got(spark, items, docs) == brute(items, docs)


def test_bounds_prune_whole_batches():
    rng = np.random.default_rng(3)
    weights = (rng.random((40, 60)) * (rng.random((40, 60)) < 0.1) * 100).astype(np.int64).astype(float)
    search = Search(weights, np.zeros(40, np.int64), 5)
    all_rows = []
    for b in range(30):
        rows = (rng.random((200, 60)) ** 8 * (rng.random((200, 60)) < 0.2) * 1000).astype(np.int64).astype(float)
        search.add(np.arange(b * 200, b * 200 + 200), rows)
        all_rows.append(rows)
    scores = np.vstack(all_rows) @ weights.T
    for item, ids, found in search.found():
        order = np.lexsort((np.arange(len(scores)), -scores[:, item]))[:5]
        order = order[scores[order, item] > 0]
        assert ids.tolist() == order.tolist() and found.tolist() == scores[order, item].tolist()
    assert search.scored < scores.size / 3
