import hashlib
import re
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from uipatterns.llm.syncmers import PAD, fingerprint, fingerprint_edits, likeness

K, S, SIZE = 5, 2, 64


def hash_of(*values):
    """Spark's xxhash64 of strings and longs."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed - 2 ** 64 if seed >= 2 ** 63 else seed


def sketch(text):
    words = [hash_of(s) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")
             for s in ([w] if len(w.encode()) <= 32 else re.findall(r"[぀-ヿ㐀-鿿]|[^぀-ヿ㐀-鿿]{1,32}", w))]
    if not words:
        return []
    a = [PAD] * (K - 1) + words + [PAD] * (K - 1)
    found = {}
    for i in range(len(a) - K + 1):
        inner = [PAD if PAD in a[j:j + S] else hash_of(*a[j:j + S]) for j in range(i, i + K - S + 1)]
        if min(inner[0], inner[-1]) == min(inner):
            found.setdefault(hash_of(*a[i:i + K]) & (2 ** 48 - 1), i)
    return sorted(found.items())[:SIZE]


def alike(a, b):
    union = sorted({h for h, _ in a} | {h for h, _ in b})[:SIZE]
    if not union:
        return 1.0
    there = dict(b)
    m = sorted((i, i - there[h]) for h, i in a if h in there and h in union)
    agree = [j for j, (_, d) in enumerate(m) if min(len(a), len(b)) == 1 or (j and m[j - 1][1] == d) or (j + 1 < len(m) and m[j + 1][1] == d)]
    return len(agree) / len(union)


def shown(sk):
    return " ".join(f"{h:012x}:{i}" for h, i in sk)


def brute(rows):
    order = sorted({(d is None, -(d or 0), hash_of(t or ""), t or "", d) for d, t in rows}, key=lambda r: r[:3])
    out = {}
    for i, (_, _, _, text, d) in enumerate(order):
        after = order[(i + 1) % len(order)][3]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        a, b = sketch(text), sketch(edited)
        out[d, text] = (d, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), round(alike(a, b), 9), round(alike(a, sketch(after)), 9))
    return sorted((out[d, t or ""] for d, t in rows), key=repr)


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS mark", "3 AS n", "'x' AS edited", "4 AS id", "5 AS chunk")
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in fingerprint_edits(df).collect()), key=repr)


def test_random_rows_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    names = np.array([f"w{i}" for i in range(300)] + ["é", "😀a", "漢字かな"])
    text = lambda most: " ".join(rng.choice(names, rng.integers(0, most)).tolist())
    rows = [(int(i) * 3, text(200)) for i in rng.permutation(40)]
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    assert got(spark, []) == []
    one = [(1, "a b c d e f")]
    assert got(spark, one) == brute(one)
    rows = [(1, None), (2, ""), (3, "x"), (4, "two words"), (5, "same words " * 200), (5, "same words " * 200), (5, "other"), (None, "no id"),
            (None, "no id either"), (6, "漢" * 100), (7, "x" * 1000), (8, " \n\t "), (9, "long text " * 100_000), (10, "😀" * 10)]
    assert got(spark, rows) == brute(rows)


def test_an_edit_leaves_the_anchors_elsewhere(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in rng.integers(0, 5000, 900)]
    changed = ["new", "beginning", *words[:300], *words[310:]]
    other = [f"w{i}" for i in rng.integers(0, 5000, 900)]
    rows = [(" ".join(words), " ".join(words)), (" ".join(words), " ".join(changed)), (" ".join(words), " ".join(other)), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string").select(likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("l"))
    same, near, far, empty = [r["l"] for r in df.collect()]
    assert same == empty == 1.0 and near > 0.8 and far < 0.05


def test_no_python_in_the_plan(spark):
    df = fingerprint_edits(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
