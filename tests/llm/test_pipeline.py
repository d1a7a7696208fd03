"""Each stage of the pipeline against a brute-force version on its own input."""

import os

import pytest
from test_neardup import brute as classes
from test_substring import brute as cut

import corpus_pipeline as pipeline

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages(spark, tmp_path):
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "near duplicates", "substring dedup", "mixing sources", "best-fit packing"]
    given = spark.read.parquet(f"{DATA}/documents.parquet").select(pipeline.COLUMNS)
    seen = [given]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, seen[-1], DATA).write.parquet(f"{tmp_path}/{i}")
        seen.append(spark.read.parquet(f"{tmp_path}/{i}"))
        assert i == 4 or seen[-1].columns == pipeline.COLUMNS
    rows = [[tuple(r) for r in x.collect()] for x in seen]
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r[0] for r in rows[1]}
    assert set(rows[1]) <= set(rows[0])
    wrong = [d for d, q in truth.items() if (d in kept) != (q == 1)]
    assert len(wrong) <= 0.05 * len(truth)
    of = classes([(r[0], r[1]) for r in rows[1]], 5, 80)
    assert {r[0] for r in rows[2]} == {d for d, (_, c) in of.items() if d == c} and set(rows[2]) <= set(rows[1])
    left = cut([(r[0], r[1]) for r in rows[2]], pipeline.PASSAGE)
    assert {r[0]: (r[1] or "").split() for r in rows[3]} == left
    assert all(r[4] == len(r[1]) for r in rows[3])
    n = {r: rows[4].count(r) for r in set(rows[4])}
    assert set(n) <= set(rows[3]) and max(n.values()) <= 2
    words = sum(len(r[1].encode().split()) for r in rows[4])
    assert words == sum(r[3] for r in rows[5]) and abs(words - 1.5 * sum(map(len, left.values()))) < 0.15 * words


def test_run_and_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels"):
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    assert pipeline.run(spark, DATA).count() > 0
