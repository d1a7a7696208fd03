
import numpy as np

from uipatterns.llm.neardup import drop_near_duplicates, min_max, multipliers, near_duplicates, shingle_set


def sets_of(docs, k):
    out = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        out[d] = frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def brute(docs, k, percent):
    sets = sets_of(docs, k)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus():
    """Copies of one text with more and more edits: most are linked only through others."""
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 900, 120)]
    docs = []
    for i in range(160):
        w = list(base)
        for j in rng.integers(0, 120, int(rng.integers(0, 9))):
            w[j] = f"e{rng.integers(0, 40)}"
        docs.append((i * 3, " ".join(w).upper() if i % 9 == 0 else " ".join(w)))
    docs += [(1000 + i, " ".join(f"v{x}" for x in rng.integers(0, 300, 60))) for i in range(60)]
    docs += [(2000 + i, docs[170][1]) for i in range(30)]
    return docs + [(3000, None), (3001, ""), (3002, " \n"), (3003, "two words"), (3004, "Two  WORDS"), (3005, "É x y z"), (3006, "é x y z")]


def test_classes_equal_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_shingles int")
    got = near_duplicates(df, words=3, percent=85, chunk=16).collect()
    want = brute(docs, 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len({c for _, c in want.values()}) < len(docs) - 60  # there is something to find


def test_one_of_each_class_stays(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, "s") for d in docs + docs[:3]] + [(None, "only one of its kind here", "s")], "doc_id long, text string, tk string")
    out = drop_near_duplicates(df, words=5, percent=80)
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    want = {d for d, (_, c) in brute(docs, 5, 80).items() if d == c}
    assert out.columns == df.columns and len(kept) == len(set(kept)) and {d for d, _ in kept} == want | {None}
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_unrelated_texts_under_one_id_all_stay(spark):
    alone = [(None, " ".join(f"n{i}x{j}" for j in range(20))) for i in range(30)] + [(7, " ".join(f"s{i}x{j}" for j in range(20))) for i in range(5)]
    near = [(d, alone[i][1] + " more") for d, i in ((None, 0), (7, 1), (9, 31), (7, 32))]
    df = spark.createDataFrame(alone + near + alone[3:5], "doc_id long, text string")
    classes = near_duplicates(df, words=5, percent=80).select("label", "tk").distinct()
    assert classes.count() == 39 and classes.select("label").distinct().count() == 35
    kept = [(r["text"], r["doc_id"]) for r in drop_near_duplicates(df, words=5, percent=80).collect()]
    assert len(kept) == 35 and all(len([k for k in kept if k[0].removesuffix(" more") == t]) == 1 for _, t in alone)
    of = {t.removesuffix(" more"): d for t, d in kept}
    assert [of[t] for _, t in alone] == [None] * 30 + [7] * 5


def test_signature_values_agree_as_often_as_the_sets():
    factors, rng = multipliers(400), np.random.default_rng(1)
    x = rng.integers(0, 2 ** 63, 1000).astype(np.uint64)
    a, b = min_max(x[:800], factors, chunk=100), min_max(x[100:900], factors)
    assert abs((a == b).mean() - 700 / 900) < 0.05
    assert (min_max(x[:800], factors) == a).all() and len(a) == 800


def test_shingles_lower_only_ascii():
    assert (shingle_set("A b C", 3) == shingle_set("a B c", 3)).all()
    assert (shingle_set("É", 3) != shingle_set("é", 3)).all()
    assert len(shingle_set("a b c", 3)) == 1 and not len(shingle_set(None, 3))
