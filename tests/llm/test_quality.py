import itertools
import os

import numpy as np
import pytest

from uipatterns.llm import quality

DATA = "/root/testdata/sf0.01"


def test_marginals_equal_the_sum_over_all_labellings():
    rng = np.random.default_rng(2)
    starts, emit, move = np.array([0, 1, 4, 9]), rng.normal(size=9), rng.normal(size=(2, 2))
    got, pairs, norm = quality.forward_backward(emit, move, starts)
    want, moved, total = np.zeros(9), np.zeros((2, 2)), 0.0
    for a, b in zip(starts[:-1], starts[1:]):
        weights = {y: np.exp(sum(e for e, s in zip(emit[a:b], y) if s) + sum(move[p, q] for p, q in zip(y, y[1:])))
                   for y in itertools.product((0, 1), repeat=b - a)}
        z = sum(weights.values())
        total += np.log(z)
        for y, w in weights.items():
            want[a:b] += w / z * np.array(y)
            for p, q in zip(y, y[1:]):
                moved[p, q] += w / z
    assert np.allclose(got, want) and np.allclose(pairs, moved) and norm == pytest.approx(total)


def test_training_raises_the_likelihood_and_odd_texts_score():
    good = [b"The cat sat on the mat, and slept.\nIt was warm there." for _ in range(40)]
    bad = [b"BUY!! NOW!! | | |\n$$$ %%% WIN!!" for _ in range(40)]
    model = quality.train(good + bad, np.array([1] * 40 + [0] * 40), rounds=60)
    s = model.score([good[0], bad[0], b"", b" \n ", good[0] * 500])
    assert s[0] > 0.9 and s[1] < 0.1 and ((0 <= s) & (s <= 1)).all() and s[2] == s[3]
    assert (quality.train([], np.array([])).score([b"x"]) == 0.5).all()
    assert quality.train(good, np.ones(40)).score([b"x"])[0] > 0.9
    assert not len(model.score([]))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-1, "", "en", "s", 0), (-2, "word " * 60_000, "en", "s", 1)], docs.schema)
    from pyspark.sql import functions as F
    got = quality.score_quality(docs.unionByName(odd).withColumn("quality_score", F.lit("x")), model).withColumn("out", quality.held_out("doc_id")).collect()
    assert len(got) == docs.count() + 4 and all(0 <= r["quality_score_"] <= 1 for r in got)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    tested = [(r["quality_score_"] >= 0.3) == truth[r["doc_id"]] for r in got if r["out"] and r["doc_id"] in truth]
    assert len(tested) > 50 and np.mean(tested) > 0.95
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_the_training_sample_is_bounded_in_rows_and_characters(spark):
    ids = [i for i in range(200)]
    docs = spark.createDataFrame(
        [(i, f"text {i} " + "x" * 100, "n") for i in ids] + [(7, f"another {k}", "n") for k in range(300)] + [(3, None, "n"), (5, "y" * 5000, "n"), (None, "z", "n")],
        "doc_id long, text string, _text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(2, 1), (4, None), (None, 1)], "doc_id long, quality int")
    fold = {r["doc_id"] for r in docs.filter(~quality.held_out("doc_id")).collect()} - {None}
    got = quality.training_sample(docs, labels, longest=1000).collect()
    assert sorted(r["_id"] for r in got) == sorted(fold) and {r["_id"]: r["_quality"] for r in got} == {i: 1 if i == 2 else i % 2 for i in fold}
    assert max(len(r["_text"]) for r in got) < 1000
    some = quality.training_sample(docs, labels, sample=40, characters=2500).collect()
    assert 10 < len(some) < 40 and sum(len(r["_text"]) for r in some) <= 2500 and {r["_id"] for r in some} <= fold
    assert quality.training_sample(docs.limit(0), labels).count() == quality.training_sample(docs, labels.limit(0)).count() == 0
