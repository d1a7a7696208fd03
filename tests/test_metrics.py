import numpy as np
import pytest
from pyspark.sql import functions as F

from uipatterns.operators import metrics as E


def brute_ap(y, p):
    total, area, last = sum(y), 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = [a for a, b in zip(y, p) if b >= t]
        recall = sum(hit) / total
        area += (recall - last) * sum(hit) / len(hit)
        last = recall
    return area


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        for label in ("a", "b"):
            y = int(rng.random() < 0.3)
            prob = float(np.clip(np.round(0.3 * y + rng.random() * 0.7, 2), 0, 1))
            rows.append((i, label, y, prob))
    return rows, spark.createDataFrame(rows, "row_id long, label string, y int, prob double")


def test_average_precision_equals_brute_force(scored):
    rows, df = scored
    for chunks in (1, 16, 4096):
        got = {r.label: r.avg_precision for r in E.average_precision(df, chunks).collect()}
        for label in "ab":
            mine = [(y, p) for _, n, y, p in rows if n == label]
            assert got[label] == pytest.approx(brute_ap(*zip(*mine)))


def test_average_precision_without_positives_is_null(spark):
    df = spark.createDataFrame([("a", 0, 0.5)], "label string, y int, prob double")
    assert E.average_precision(df).first().avg_precision is None


def brute_sweep(rows, min_p=None, min_r=None):
    best, any_best = None, None
    for t in np.arange(0.05, 0.96, 0.01):
        tp = sum(1 for y, p in rows if y and p >= t)
        fp = sum(1 for y, p in rows if not y and p >= t)
        fn = sum(1 for y, p in rows if y and p < t)
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        precision = tp / (tp + fp) if tp + fp else 0.0
        recall = tp / (tp + fn) if tp + fn else 0.0
        if any_best is None or f1 > any_best[1]:
            any_best = (t, f1)
        if (min_p is None or precision >= min_p) and (min_r is None or recall >= min_r) and (best is None or f1 > best[1]):
            best = (t, f1)
    return (*(best or any_best), best is None)


@pytest.mark.parametrize("floors", [(None, None), (0.8, None), (None, 0.8), (1.01, None)])
def test_sweep_equals_brute_force(scored, floors):
    rows, df = scored
    got = {r.label: r for r in E.sweep(df, E.GRID, *floors).collect()}
    for label in "ab":
        want = brute_sweep([(y, p) for _, n, y, p in rows if n == label], *floors)
        assert (got[label].threshold, got[label].f1, got[label].constraint_unmet) == (want[0], pytest.approx(want[1]), want[2])


def test_grid_is_the_accumulated_one():
    assert [float(x) for x in np.arange(0.05, 0.96, 0.01)] == E.GRID


def test_nearest_rank_percentiles(spark):
    def brute(values, p):
        ordered = sorted(values)
        return ordered[min(len(ordered) - 1, max(0, int(round(p / 100.0 * len(ordered) + 0.5)) - 1))]

    rng = np.random.default_rng(3)
    cases = {"one": [5.0], "few": [1.0, 2.0, 3.0, 4.0], "many": [float(x) for x in rng.integers(0, 40, 333)]}
    df = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "case string, ms double")
    for r in E.latency_report(df, 20.0).collect():
        assert (r.p50, r.p95) == (brute(cases[r["case"]], 50), brute(cases[r["case"]], 95))
        assert r.verdict == ("OVER" if r.p95 > 20 else "ok")


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([(1, "a", 0, 0), (1, "b", 1, 0)], "row_id int, label string, y int, p int")
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in E.per_class(df).collect()}
    assert got == {"a": (0.0, 0.0, 0.0, 0), "b": (0.0, 0.0, 0.0, 1)}


def test_missing_threshold(spark):
    scores = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.49)], "row_id int, label string, prob double")
    cut = spark.createDataFrame([("b", 0.4)], "label string, threshold double")
    assert {r.label: r.p for r in E.apply_thresholds(scores, cut).collect()} == {"a": 1, "b": 1}
    assert [r.p for r in E.apply_thresholds(scores, 0.5).orderBy("label").collect()] == [1, 0]
    with pytest.raises(Exception, match="no threshold for a"):
        E.apply_thresholds(scores, cut, None).collect()


def test_parse_labels(spark):
    cells = spark.createDataFrame([("scarcity, sneaking",), ("benign",), (" scarcity  scarcity",), ("",)], "c string")
    assert [r[0] for r in cells.select(E.parse_labels(F.col("c"))).collect()] == [["scarcity", "sneaking"], [], ["scarcity"], []]
