import datetime

import pytest
from pyspark.sql import functions as F

from uipatterns.operators import scoring as S
from uipatterns.operators.baseline import char_ngrams, fit_baseline, score_baseline
from uipatterns.schema import DARK_LABELS, LABELS

NOW = datetime.datetime(2024, 6, 1)


def thresholds(value=0.5):
    return dict.fromkeys(LABELS, value)


def test_decide_edges(spark):
    base = [0.0] * 8
    rows = []
    for i, (at, value) in enumerate([(4, 0.5), (4, 0.499), (7, 0.99)]):
        p = list(base)
        p[at] = value
        rows.append((i, p))
    rows.append((3, [0.6, 0.9, 0.0, 0.0, 0.0, 0.0, 0.9, 0.99]))
    out = S.decide(spark.createDataFrame(rows, "i int, probs array<double>"), thresholds()).orderBy("i").collect()
    assert [[f.label for f in r.findings] for r in out] == [["scarcity"], [], [], ["false_urgency", "social_proof", "confirmshaming"]]
    assert [r.benign for r in out] == [False, True, True, False] and out[3].benign_score == 0.99


def test_decide_refuses_a_wrong_label_count(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2])], "i int, probs array<double>")
    with pytest.raises(Exception, match="expected 8 scores"):
        S.decide(df, thresholds()).collect()


def test_thresholds_are_checked(spark):
    good = spark.createDataFrame([("p", x, 0.4) for x in LABELS], "profile string, label string, threshold double")
    assert S.load_thresholds(good, "p") == thresholds(0.4)
    for bad in (good.filter("label <> 'sneaking'"), good.withColumn("threshold", F.when(F.col("label") == "scarcity", 1.0).otherwise(0.4))):
        with pytest.raises(ValueError):
            S.load_thresholds(bad, "p")
    with pytest.raises(ValueError):
        S.load_thresholds(good, "other")
    with pytest.raises(ValueError, match="more than once"):
        S.load_thresholds(good.unionByName(good.filter("label = 'scarcity'").withColumn("threshold", F.lit(0.7))), "p")
    with pytest.raises(ValueError):
        S.check_label_order(LABELS[::-1])


def test_merge_policy(spark):
    rules = spark.createDataFrame([(1, "stock_counter", "scarcity"), (3, "late_fee", "sneaking"), (3, "hidden_optout", "sneaking")], "k int, rule string, label string")
    model = spark.createDataFrame([(2, "scarcity", 0.7, 0.5), (3, "sneaking", 0.8, 0.4)], "k int, label string, score double, threshold double")
    got = {r.k: r for r in S.merge_findings(rules, model, ["k"]).collect()}
    assert (got[1].confidence, got[1].score, got[1].threshold, got[1].source) == ("likely", 1.0, 0.0, ["rule"])
    assert (got[2].confidence, got[2].score, got[2].source) == ("possible", 0.7, ["model"])
    assert (got[3].confidence, got[3].score, got[3].threshold, sorted(got[3].source)) == ("likely", 0.8, 0.4, ["model", "rule"])


def test_page_score(spark):
    rows = [(1, "likely")] * 7 + [(1, "possible")] * 6 + [(3, "possible")]
    f = spark.createDataFrame(rows, "page_id int, confidence string")
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page_id int")
    assert {r.page_id: (r.page_score, r.band) for r in S.page_score(f, pages).collect()} == {1: (100, "high"), 2: (0, "low"), 3: (5, "low")}


def test_withhold(spark):
    rows = [("obstruction", "unknown", "support_link", "call us"), ("obstruction", "unknown", "support_link", "call us to cancel"), ("scarcity", "title", "body", "x"),
            ("scarcity", "title", "heading", "x"), ("scarcity", "unknown", "support_link", "call us")]
    shown, kept = S.withhold(spark.createDataFrame(rows, "label string, field string, role string, text string"))
    assert shown.count() == 3 and sorted(r.text for r in kept.collect()) == ["call us", "x"]


@pytest.mark.parametrize("hot_rows", [1_000_000, 7])
def test_each_input_is_scored_once_and_no_row_is_lost(spark, hot_rows):
    # One text holds most rows; the small limit sends it through the salted way.
    df = spark.range(200).select("id", F.when(F.col("id") < 150, "Add to cart").otherwise(F.concat(F.lit("t"), (F.col("id") % 20).cast("string"))).alias("model_input"))
    calls = spark.sparkContext.accumulator(0)
    asked = []

    def scorer(d):
        asked.append(d.count())
        return d.withColumn("probs", F.length("model_input"))

    out = S.score_distinct(df, scorer, row_id=["id"], hot_rows=hot_rows)
    assert asked == [21] and out.count() == 200 and out.select("id").distinct().count() == 200
    assert out.filter("probs <> length(model_input)").count() == 0 and calls.value == 0


def test_incremental_scoring_reuses_only_valid_answers(spark):
    df = spark.createDataFrame([("en", "p", "body", t) for t in ("a", "b", "c", "a")], "lang string, tag string, role string, text string")
    empty = spark.createDataFrame([], "cache_key string, model_version string, profile string, decided_at timestamp, decision string")
    scorer = lambda d: d.withColumn("decision", F.concat(F.lit("d-"), "text"))
    run = lambda table, version="1", now=NOW: S.score_incremental(df, table, scorer, version, "precision", F.lit(now), 600)
    cold, store = run(empty)
    stored = spark.createDataFrame(store.collect(), store.schema)
    warm, fresh = run(stored)
    pick = lambda d: sorted((r.text, r.decision) for r in d.collect())
    assert pick(cold) == pick(warm) == [("a", "d-a"), ("b", "d-b"), ("c", "d-c")]
    assert fresh.count() == 0 and warm.filter("cached").count() == 3
    assert run(stored, "2")[1].count() == 3
    assert run(stored, now=NOW + datetime.timedelta(seconds=601))[1].count() == 3


def test_bring_your_own_scorer_sees_every_row_in_order(spark):
    def load():
        return lambda texts: [[len(t), float(t.endswith("7"))] for t in texts]

    df = spark.range(1000).select(F.col("id").cast("string").alias("model_input"))
    out = S.score_with(df, load)
    assert out.filter("probs[0] <> length(model_input) or (probs[1] = 1.0) <> endswith(model_input, '7')").count() == 0


def test_sigmoid_is_stable(spark):
    got = spark.createDataFrame([(-1000.0,), (0.0,), (1000.0,)], "x double").select(S.sigmoid(F.col("x"))).collect()
    assert [r[0] for r in got] == [0.0, 0.5, 1.0]


def test_char_ngrams_stay_in_words(spark):
    got = spark.range(1).select(char_ngrams(F.lit("ab  c"), 2, 4)).first()[0]
    assert got == [" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "]


def test_baseline_separates_two_classes(spark):
    rows = [(i, f"Only {i} left in stock" if i % 2 else f"Read about our {i} stores", i % 2, 1 - i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, model_input string, y_scarcity int, y_benign int")
    model = fit_baseline(df, ["scarcity", "benign"], max_iter=20)
    new = spark.createDataFrame([(1, "Only 99 left in stock"), (2, "Read about our 98 stores"), (3, "ξξξ")], "row_id long, model_input string")
    got = {r.row_id: r.probs for r in score_baseline(model, new, ["scarcity", "benign"]).collect()}
    assert got[1][0] > 0.8 > 0.2 > got[2][0] and len(got) == 3


def test_baseline_reaches_the_optimum_of_each_label(spark):
    """At the optimum of a convex loss its slope is zero; both from a dense table of the terms."""
    import numpy as np

    from uipatterns.operators import baseline as B

    words = ["only", "left", "stock", "read", "about", "stores", "now", "sale"]
    rows = [(i, " ".join(words[(i * k) % 8] for k in range(1, 5)), int(i % 8 < 3), int(i % 8 in (1, 6) or i % 5 == 0), 0) for i in range(80)] + [(99, "", 1, None, 0)]
    df = spark.createDataFrame(rows, "row_id long, model_input string, y_a int, y_b int, y_none int")
    model = B.fit_baseline(df, ["a", "b", "none"], max_iter=60, tol=1e-9)
    assert model.offsets[2] is None
    table = {r.gram: r for r in model.vocabulary.collect()}
    dense = np.zeros((len(rows), len(table)))
    for r in B.term_weights(df, model.vocabulary).select("row_id", "idx", "tfidf").collect():
        dense[[x[0] for x in rows].index(r.row_id), r.idx] = r.tfidf
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)
    got = {r.row_id: r.probs for r in B.score_baseline(model, df).collect()}
    assert len(got) == len(rows) and {p[2] for p in got.values()} == {0.0}
    for j in (0, 1):
        w = np.zeros(len(table))
        for r in table.values():
            w[r.idx] = r.weights[j]
        p = 1 / (1 + np.exp(-(dense @ w + model.offsets[j])))
        assert max(abs(p[i] - got[r[0]][j]) for i, r in enumerate(rows)) < 1e-9
        y = np.array([r[2 + j] or 0 for r in rows])
        weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        slope = dense.T @ (weight * (p - y)) / len(y) + w / (4 * len(y))
        start = np.abs(dense.T @ (weight * (0.5 - y)) / len(y)).max()
        assert start > 1e-3 and np.abs(slope).max() < 0.01 * start and abs((weight * (p - y)).mean()) < 0.01 * start


def test_labels_are_frozen():
    assert LABELS == ["confirmshaming", "false_urgency", "forced_action", "obstruction", "scarcity", "sneaking", "social_proof", "benign"]
    assert DARK_LABELS == LABELS[:7]
