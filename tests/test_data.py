import pytest
from pyspark.sql import functions as F

from uipatterns.operators import dataset as D
from uipatterns.operators import splits as P
from uipatterns.operators.gold import dedupe_entries, stratified_sample
from uipatterns.operators.ordered import hash_chunk, previous_row, row_numbers, running_sums
from uipatterns.operators.skew import join_by_key


def test_running_sums_equal_a_plain_window(spark):
    # Key 0 holds most of the rows.
    df = spark.range(600).select("id", F.when(F.col("id") < 500, 0).otherwise(F.col("id") % 5).alias("k"), (F.col("id") * 7 % 31).alias("v"))
    plain = df.selectExpr("id", "sum(v) over (partition by k order by id) as s").collect()
    for size in (1, 17, 10_000):
        got = running_sums(df, ["k"], [F.col("id")], {"s": F.col("v")}, F.floor(F.col("id") / size))
        assert {(r.id, r.s) for r in got.collect()} == {(r.id, r.s) for r in plain}


def test_running_sums_keep_rows_without_a_group(spark):
    df = spark.range(60).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"))
    plain = {(r.id, r.s) for r in df.selectExpr("id", "sum(id) over (partition by k order by id) as s").collect()}
    got = running_sums(df, ["k"], [F.col("id")], {"s": F.col("id")}, F.floor(F.col("id") / 7))
    assert {(r.id, r.s) for r in got.collect()} == plain


def test_previous_row_equals_lag(spark):
    df = spark.range(300).select("id", (F.col("id") % 2).alias("k"), (F.col("id") * 13 % 301).alias("t"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"))
    plain = {(r.id, r.p) for r in df.selectExpr("id", "lag(v) over (partition by k order by t) as p").collect()}
    for size in (1, 20, 1000):
        got = previous_row(df, ["k"], ["t"], {"p": "v"}, F.floor(F.col("t") / size))
        assert {(r.id, r.p) for r in got.collect()} == plain


def test_row_numbers_over_everything(spark):
    df = spark.range(500).withColumn("h", F.md5(F.col("id").cast("string")))
    got = row_numbers(df, [], [F.col("h")], hash_chunk("h")).collect()
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == [r.id for r in df.orderBy("h").collect()]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_key_join_equals_a_plain_join(spark, how):
    rows = spark.range(300).select("id", F.when(F.col("id") < 200, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 30).cast("string"))).alias("k"))
    lookup = rows.filter("k <> 'k7'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("v"))
    want = {(r.id, r.v) for r in rows.join(lookup, "k", how).collect()}
    for hot in (3, 1000):
        got = join_by_key(rows, lookup, "k", "n", ["id"], how, hot)
        assert {(r.id, r.v) for r in got.collect()} == want and got.count() == len(want)


def docs(spark):
    rows = []
    for i in range(400):
        part = ("train", "train", "val", "test")[i % 4]
        text = "everywhere" if i % 3 == 0 else f"text {i // 8}" if i % 5 == 0 else f"own {i}"
        rows.append((i, text, part, f"tpl{i % 23}", ("en", "hi")[i % 2], ("scarcity", "benign")[i % 2]))
    return spark.createDataFrame(rows, "row_id int, text string, part string, template_id string, lang string, primary_label string")


def test_drop_cross_part(spark):
    df = docs(spark)
    for hot in (5, 10_000):
        out = P.drop_cross_part(df, ["row_id"], hot)
        assert P.cross_part_duplicates(out).count() == 0
        first = {}
        for r in df.collect():
            first[r.text] = min(first.get(r.text, 9), P.PARTS.index(r.part))
        want = {r.row_id for r in df.collect() if P.PARTS.index(r.part) == first[r.text]}
        assert {r.row_id for r in out.collect()} == want
        assert P.drop_cross_part(out, ["row_id"]).count() == out.count()


def test_group_split_keeps_templates_whole_and_sizes(spark):
    df = docs(spark).drop("part")
    out = P.split_by_group(df, ["primary_label", "lang"], "template_id", row_id=["row_id"], hot_rows=10)
    assert out.count() == 400 and P.shared_keys(out, "template_id").count() == 0
    P.assert_disjoint(out, "template_id")
    with pytest.raises(AssertionError, match="shared"):
        P.assert_disjoint(docs(spark), "template_id")


def test_small_groups(spark):
    def sizes(n):
        df = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("t"))
        out = P.split_small_groups(df, ["g"], "t", row_id=["t"])
        got = {r.part: r["count"] for r in out.groupBy("part").count().collect()}
        return tuple(got.get(p, 0) for p in P.PARTS)

    assert [sizes(n) for n in (1, 2, 3, 4, 10, 20)] == [(1, 0, 0), (1, 1, 0), (1, 1, 1), (2, 1, 1), (6, 2, 2), (12, 3, 5)]


def test_random_split_sizes(spark):
    out = P.split_random(spark.range(101), "id")
    assert {r.part: r["count"] for r in out.groupBy("part").count().collect()} == {"train": 71, "val": 15, "test": 15}


def test_unknown_slot_is_an_error(spark):
    t = spark.createDataFrame([("a", "en", "Only {N} left"), ("b", "en", "no slots"), ("c", "en", "{N} and {N}")], "template_id string, lang string, template string")
    s = spark.createDataFrame([("en", "N", 0, "five"), ("en", "N", 1, "six")], "lang string, slot string, value_no long, value string")
    got = {(r.template_id, r.text) for r in D.fill_templates(t, s, 30).collect()}
    assert ("b", "no slots") in got and ("a", "Only five left") in got and ("a", "Only six left") in got
    assert {x for k, x in got if k == "c"} == {f"{a} and {b}" for a in ("five", "six") for b in ("five", "six")}
    bad = t.withColumn("template", F.lit("{MISSING}"))
    assert D.unknown_slots(bad, s).collect() == [("en", "MISSING")]
    with pytest.raises(Exception, match="unknown slot MISSING"):
        D.fill_templates(bad, s, 1).collect()


def test_targets_and_shortfall(spark):
    df = spark.range(50).select(F.lit("x").alias("label"), F.lit("en").alias("lang"), F.concat(F.lit("t"), (F.col("id") % 30).cast("string")).alias("text"))
    targets = spark.createDataFrame([("x", "en", 20), ("y", "en", 5)], "label string, lang string, target int")
    taken, short = D.take_targets(df, targets, ["label", "lang"], ["lang", "text", "label"])
    assert taken.count() == 20 == taken.select("text").distinct().count() and short.collect() == [("y", "en", 5, 0)]


def test_patch_is_marked_once(spark):
    df = spark.createDataFrame([("t1", "scarcity", "scarcity", "s", 1, 0), ("t2", "scarcity", "scarcity", "s", 1, 0)],
                               "template_id string, labels string, primary_label string, source string, y_scarcity int, y_benign int")
    patch = spark.createDataFrame([("t1", "benign"), ("t2", None)], "template_id string, new_label string")
    once, counts = D.patch_labels(df, patch, "fix")
    twice, _ = D.patch_labels(once, patch, "fix")
    assert once.collect() == twice.collect() == [("t1", "benign", "benign", "s|fix", 0, 1)]
    assert {(r.template_id, r.relabelled, r.dropped) for r in counts.collect()} == {("t1", 1, 0), ("t2", 0, 1)}


def test_concept_conflicts(spark):
    df = spark.createDataFrame([("50 sold", ["benign"]), ("60 SOLD", ["social_proof"]), ("fee", ["sneaking"])], "text string, labels array<string>")
    assert {r.label_set for r in D.concept_conflicts(df, {"sold": ["sold"], "fee": ["fee"]}).collect()} == {"benign", "social_proof"}


def entries(spark):
    rows = []
    for i in range(240):
        labels = None if i % 6 == 0 else [] if i % 2 else (["scarcity"] if i % 4 else ["scarcity", "sneaking"])
        rows.append((f"e{i}", f"text {i}" if i % 10 else f"पाठ {i}", "body", labels, i))
    return spark.createDataFrame(rows, "id string, text string, role string, findingLabels array<string>, seq int")


def test_stratified_sample(spark):
    out = stratified_sample(entries(spark), 60).collect()
    assert len(out) == 60 == len({r.id for r in out})
    assert sum(1 for r in out if r.findingLabels) == 30 and all(r.findingLabels is not None for r in out)
    assert {r.id for r in stratified_sample(entries(spark).repartition(3), 60).collect()} == {r.id for r in out}
    assert stratified_sample(entries(spark), 10_000).count() == 200


def test_dedupe_entries_keeps_the_first(spark):
    df = spark.createDataFrame([("b", " x ", "cta", 2), ("a", "x", "cta", 1), ("c", "x", "body", 3), ("d", "  ", "cta", 0)], "id string, text string, role string, seq int")
    assert sorted(r.id for r in dedupe_entries(df).collect()) == ["a", "c"]
