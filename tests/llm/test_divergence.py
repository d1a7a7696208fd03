import re
from collections import Counter

import numpy as np

from uipatterns.llm.divergence import source_divergence, tree_corrections


def brute(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
            for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = sorted((t for t in held if held[t] >= least), key=lambda t: t.encode())

        def p_of(texts):
            n = Counter(t for d in texts for t in d[2])
            whole = sum(n[t] for t in kept) + len(kept)
            return {t: 1 + 10 ** 9 * (n[t] + 1) // whole for t in kept}, n

        q, _ = p_of(mine)
        groups = {s: p_of([d for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        for s, (p, n) in groups.items():
            pair = [(-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), x) for x, (o, _) in groups.items() if x != s]
            term = [(-((p[t] - q[t]) ** 2 // q[t]), t) for t in kept if n[t] and p[t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                for i, (value, name) in enumerate(found if part == "pair" else found[:top], 1):
                    out.append((lang, s, part, name, -value, i))
    return sorted(out)


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS n", "2 AS total", "'x' AS term", "3 AS p")
    return sorted(tuple(r) for r in source_divergence(df, **how).collect())


def test_random_rows_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in "abcdé" for b in "xyzÄ"] + ["The", "a"]
    rows = [(["en", "fr", None][rng.integers(3)], ["s", "t", None, "ü", "S"][rng.integers(5)],
             " ".join(rng.choice(words, rng.integers(0, 30)).tolist()) + "-1x_") for _ in range(150)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, least_docs=20, top_terms=2) == brute(rows, 20, 2)


def test_odd_rows(spark):
    assert got(spark, []) == []
    rows = [("en", "a", None), ("en", "b", ""), ("en", "c", "one two"), ("xx", "a", "alone " * 4), (None, None, "9 !")]
    assert got(spark, rows) == brute(rows)
    same = [("en", s, "w " * 5 + "v") for s in "aab"] * 3 + [("en", "empty", None)]
    assert got(spark, same) == brute(same)
    long = "word " * 1_000_000 + "x" * 5_000_000
    rows = [("en", s, t) for s in "ab" for t in (long, "word x", "x y")] + [("en", "c", "y")] * 3
    assert got(spark, rows) == brute(rows)


def test_corrections_of_a_tree_equal_those_of_all_rows():
    rng = np.random.default_rng(5)
    rows = sorted({tuple((s, int(rng.integers(1, 3))) for s in range(5) if rng.random() < 0.6) for _ in range(200)} - {()})
    times = rng.integers(1, 9, len(rows))
    base = rng.integers(5, 50, 5)
    width = max(map(len, rows))
    grid = lambda f, empty: np.array([[f(*e) for e in r] + [empty] * (width - len(r)) for r in rows])
    p = lambda s, n: int(base[s]) + 40 * n
    f = lambda a, b: (a - b) ** 2 // b
    want = np.zeros((5, 5), np.int64)
    for r, m in zip(rows, times):
        for s, n in r:
            for t, k in r:
                if s != t:
                    a, b, c, d = p(s, n), p(t, k), int(base[s]), int(base[t])
                    want[s, t] += m * (f(a, b) - f(a, d) - f(c, b) + f(c, d))
    out = tree_corrections(grid(lambda s, n: 10 * s + n, -1), grid(lambda s, n: s, -1), grid(p, 1), grid(lambda s, n: int(base[s]), 1), times, 5)
    assert (out == want).all()
