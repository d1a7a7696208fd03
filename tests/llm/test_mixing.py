import pytest

from uipatterns.llm.mixing import mix, repetition_plan


def shares(sizes, weights, total, most=2.0):
    """Give out by weight, cap, and share the excess again until none is above."""
    got, free, left = {}, set(sizes), total
    while free:
        unit = left / sum(weights[s] for s in free)
        over = {s for s in free if unit * weights[s] >= most * sizes[s]}
        if not over:
            return got | {s: unit * weights[s] for s in free}
        for s in over:
            got[s] = most * sizes[s]
            left -= got[s]
        free -= over
    return got


def test_targets_copies_and_odd_rows(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}") for i in range(400)] + [(900 + i, "big " * 50, "s1") for i in range(40)]
    rows += [(1000, None, "s2"), (1001, "", "s3"), (1002, "x y", None), (None, "x y z", "s4"), (1003, "", "empty"), (5, rows[5][1], "s0")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, source string, size string")
    plan = repetition_plan(df).collect()
    sizes, taken = {}, {}
    for r in plan:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size_"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size_"] * r["copies"]
        assert 0 <= r["copies"] <= 2 and r["size"] == "q"
    order = sorted(s for s in sizes if s is not None) + [None]
    want = shares(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for r in plan:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in ("s0", "s1", "s2", "s4"):
        assert abs(taken[s] - want[s]) <= 0.25 * want[s] + 60
    again = {(r["doc_id"], r["text"], r["copies"]) for r in repetition_plan(df.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["text"], r["copies"]) for r in plan}
    out = mix(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in plan)
    assert mix(df.limit(0)).count() == 0


def test_rows_without_id_have_coins_of_their_own(spark):
    import corpus_pipeline

    rows = [(None, f"a{i} " * 10, "en", s, 1) for s in ("s0", "s1", "s2") for i in range(300)] + [(7, f"b{i} " * 10, "en", "s1", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    target = {r["source"]: r["target"] for r in repetition_plan(df).collect()}
    taken = {}
    for r in corpus_pipeline.mix_sources(spark, df, "").collect():
        taken[r["source"]] = taken.get(r["source"], 0) + 10
    assert all(abs(taken.get(s, 0) - t) <= 0.1 * t for s, t in target.items()) and any(t % 3000 for t in target.values())


def test_the_query_meets_its_targets_without_ids(spark, tmp_path):
    from uipatterns.llm.queries import QUERIES

    rows = [(None, f"a{i} " * 100, "en", "s0", 1) for i in range(3000)] + [(i, f"b{i} " * 100, "en", f"s{1 + i % 2}", 1) for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    taken, target = {}, {}
    for r in QUERIES["op3_mixing"](spark, str(tmp_path)).collect():
        key = r["source_size"] if r["doc_id"] is None else -1
        taken[key], target[key] = taken.get(key, 0) + r["taken"], r["target"]
    assert abs(taken[300_000] - target[300_000]) < 0.02 * target[300_000] and target[300_000] % 300_000
