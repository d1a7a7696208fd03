"""Building labelled rows: templates, slots, targets, overrides, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uipatterns.functions.ids import hash_fraction_bucket
from uipatterns.functions.text import WS
from uipatterns.operators.ordered import hash_chunk, row_numbers
from uipatterns.operators.scoring import model_input
from uipatterns.schema import BENIGN, LABELS

# --- fixed values: tag and role choices per label ------------------------------------
CONTEXTS = {
    "confirmshaming": [("button", "decline"), ("a", "decline"), ("span", "modal_text")],
    "false_urgency": [("span", "timer"), ("div", "banner"), ("p", "promo")],
    "forced_action": [("button", "cta"), ("label", "form_gate"), ("p", "modal_text")],
    "obstruction": [("p", "help_text"), ("a", "support_link"), ("div", "modal_text")],
    "scarcity": [("span", "stock"), ("div", "badge"), ("p", "promo")],
    "sneaking": [("label", "checkbox"), ("span", "line_item"), ("p", "fine_print")],
    "social_proof": [("span", "toast"), ("div", "badge"), ("p", "promo")],
    "benign": [
        ("button", "cta"), ("a", "nav"), ("span", "label"), ("p", "body"), ("h2", "heading"), ("li", "nav"),
        ("label", "form"),
    ],
}
VARIANT_TAGS = ["button", "a", "span", "div"]
# --- end of fixed values ---------------------------------------------------------------

SLOT = r"\{([A-Z_]+)\}"


def parse_templates(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``text||extra,labels`` to ``template`` and ``extra_labels``."""
    at = F.locate("||", F.col(raw))
    extra = F.when(at > 0, F.expr(f"substring({raw}, locate('||', {raw}) + 2)")).otherwise("")
    names = F.filter(F.transform(F.split(extra, ","), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumns({"template": F.when(at > 0, F.substring_index(raw, "||", 1)).otherwise(F.col(raw)),
                           "extra_labels": names})


def slot_choice(seed: str, template_id: Column, slot: Column, variant: Column, n: Column) -> Column:
    """Which of ``n`` values a slot takes: repeatable, and even over variants."""
    return hash_fraction_bucket(seed, F.concat_ws(":", template_id, slot, variant.cast("string")), n)


def unknown_slots(templates: DataFrame, slots: DataFrame) -> DataFrame:
    used = templates.select("lang", F.explode(F.array_distinct(F.regexp_extract_all("template", F.lit(SLOT), F.lit(1))))
                            .alias("slot")).distinct()
    return used.join(slots.select("lang", "slot").distinct(), ["lang", "slot"], "left_anti")


def fill_templates(templates: DataFrame, slots: DataFrame, variants: Column | int, seed: str = "13") -> DataFrame:
    """Fill every template ``variants`` times.

    ``templates``: ``template_id, lang, template``.  ``slots``: ``lang, slot,
    value_no`` (from 0), ``value``.  Slots the language lacks are an error: the
    row raises instead of being lost.
    """
    sizes = slots.groupBy("lang", "slot").agg(F.count(F.lit(1)).alias("n_values"))
    count = variants if isinstance(variants, Column) else F.lit(variants)
    base = templates.withColumn("variant", F.explode(F.sequence(F.lit(0), count - 1))).withColumns({
        "_names": F.regexp_extract_all("template", F.lit(SLOT), F.lit(1)), "_texts": F.split("template", SLOT, -1),
    })
    wanted = base.select("template_id", "lang", "variant", F.posexplode("_names").alias("pos", "slot"))
    sized = wanted.join(sizes, ["lang", "slot"], "left").withColumn(
        "value_no", F.when(F.col("n_values").isNull(), F.raise_error(F.concat(F.lit("unknown slot "), F.col("slot"))).cast("bigint"))
        .otherwise(slot_choice(seed, F.col("template_id"), F.concat_ws("/", "slot", F.col("pos").cast("string")),
                               F.col("variant"), F.col("n_values"))))
    chosen = sized.join(slots, ["lang", "slot", "value_no"]).groupBy("template_id", "variant").agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_values"))
    values = F.coalesce(F.transform("_values", lambda v: v["value"]), F.array().cast("array<string>"))
    text = F.array_join(F.flatten(F.zip_with("_texts", F.col("_filled"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return (
        base.join(chosen, ["template_id", "variant"], "left").withColumn("_filled", values)
        .withColumn("text", F.trim(text)).drop("_names", "_texts", "_values", "_filled")
    )


def take_targets(df: DataFrame, targets: DataFrame, group: list[str], unique: list[str], seed: str = "13",
                 order: str = "text") -> tuple[DataFrame, DataFrame]:
    """Unique rows, at most ``target`` per group in hash order, and the shortfalls."""
    one = df.groupBy(*unique).agg(F.min(F.struct(*[c for c in df.columns if c not in unique])).alias("_r"))
    rows = one.select(*unique, "_r.*").withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(order))))
    ranked = row_numbers(rows, group, [F.col("_h"), *[F.col(c) for c in unique]], hash_chunk("_h"), "_rank")
    taken = ranked.join(targets, group).filter(F.col("_rank") <= F.col("target")).drop("_rank", "_h", "target")
    got = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("available"))
    short = targets.join(got, group, "left").withColumn("got", F.least(F.coalesce("available", F.lit(0)), F.col("target")))
    return taken, short.filter(F.col("got") < F.col("target")).select(*group, "target", "got")


def attach_context(df: DataFrame, contexts: dict[str, list[tuple[str, str]]] = CONTEXTS, seed: str = "13",
                   label: str = "label") -> DataFrame:
    """Add ``tag`` and ``role``: one of the label's choices, picked by hash of the text."""
    choices = F.create_map(*[
        x for name, pairs in contexts.items()
        for x in (F.lit(name), F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(r).alias("role")) for t, r in pairs]))
    ])
    mine = choices[F.col(label)]
    pick = F.get(mine, hash_fraction_bucket(seed, F.col("text"), F.size(mine)).cast("int"))
    return df.withColumn("_c", pick).withColumns({"tag": F.col("_c.tag"), "role": F.col("_c.role")}).drop("_c")


def apply_overrides(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Set ``labels`` and ``primary_label`` from the template's override or its own label."""
    rows = df.join(overrides.select("template_id", F.col("label").alias("_over")), "template_id", "left")
    own = F.concat(F.array("label"), F.filter("extra_labels", lambda x: x != F.col("label")))
    return rows.withColumns({
        "labels": F.when(F.col("_over").isNotNull(), F.array("_over")).otherwise(own),
        "primary_label": F.coalesce("_over", "label"),
    }).drop("_over")


def one_hot(df: DataFrame, labels: str = "labels", names: list[str] = LABELS) -> DataFrame:
    return df.withColumns({f"y_{n}": F.array_contains(labels, n).cast("int") for n in names})


def labels_long(df: DataFrame, keys: list[str], names: list[str] = LABELS) -> DataFrame:
    """``y_*`` columns to one row per label."""
    long = df.unpivot(keys, [f"y_{n}" for n in names], "label", "y")
    return long.withColumn("label", F.expr("substring(label, 3)"))


def dataset_rows(df: DataFrame, source: str) -> DataFrame:
    """The columns of a dataset file from labelled, filled rows."""
    rows = one_hot(df).withColumn("model_input", model_input(F.col("text"), F.col("tag"), F.col("role")))
    return rows.select(
        "text", F.array_join("labels", "|").alias("labels"), "primary_label", "lang", "tag", "role", "model_input",
        "template_id", F.lit(source).alias("source"), *[f"y_{n}" for n in LABELS])


def hard_negatives(templates: DataFrame, slots: DataFrame, per_group: int = 100, variants: int = 100,
                   seed: str = "20") -> DataFrame:
    """Benign look-alikes.  ``templates``: ``counterpart, lang, idx, template, tag, role``.

    Templates with slots are filled; fixed ones vary by tag instead.
    """
    named = templates.withColumn("template_id", F.concat_ws(
        ":", F.lit("hardneg"), "counterpart", "lang", F.when(F.col("idx") < 10, F.concat(F.lit("0"), F.col("idx").cast("string"))).otherwise(F.col("idx").cast("string"))))
    has_slot = F.col("template").contains("{")
    filled = fill_templates(named.filter(has_slot), slots, variants, seed)
    fixed = named.filter(~has_slot).withColumns({"variant": F.lit(0), "text": F.trim("template")}).withColumn(
        "tag", F.explode(F.array(*[F.lit(t) for t in VARIANT_TAGS])))
    keep = ["counterpart", "lang", "template_id", "text", "tag", "role"]
    rows = filled.select(keep).unionByName(fixed.select(keep))
    one = rows.groupBy("counterpart", "lang", "text", "tag", "role").agg(F.min("template_id").alias("template_id"))
    order = Window.partitionBy("counterpart", "lang").orderBy(
        F.md5(F.concat(F.lit(seed), F.col("text"), F.col("tag"))), "text", "tag", "role")
    return one.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= per_group).drop("_rn").withColumns({
        "labels": F.array(F.lit(BENIGN)), "primary_label": F.lit(BENIGN),
        "source": F.concat(F.lit("hard_negative_v2:"), F.col("counterpart")),
    })


def patch_labels(df: DataFrame, patch: DataFrame, mark: str) -> tuple[DataFrame, DataFrame]:
    """Relabel or drop rows by template.  ``patch``: ``template_id, new_label`` (null
    drops).  Returns the patched rows and the counts per template."""
    rows = df.join(patch.select("template_id", "new_label", F.lit(True).alias("_hit")), "template_id", "left")
    touched = rows.filter("_hit").groupBy("template_id").agg(
        F.count_if(F.col("new_label").isNotNull()).alias("relabelled"), F.count_if(F.col("new_label").isNull()).alias("dropped"))
    change = F.col("_hit") & F.col("new_label").isNotNull()
    y_cols = [c for c in df.columns if c.startswith("y_")]
    updates = {
        "labels": F.when(change, F.col("new_label")).otherwise(F.col("labels")),
        "primary_label": F.when(change, F.col("new_label")).otherwise(F.col("primary_label")),
        "source": F.when(change & ~F.col("source").contains(mark), F.concat("source", F.lit(f"|{mark}")))
        .otherwise(F.col("source")),
        **{c: F.when(change, (F.col("new_label") == c[2:]).cast("int")).otherwise(F.col(c)) for c in y_cols},
    }
    out = rows.filter(~(F.coalesce("_hit", F.lit(False)) & F.col("new_label").isNull())).withColumns(updates)
    return out.select(df.columns), touched


def dataset_stats(df: DataFrame) -> DataFrame:
    """Counts by label, language, both, and in total, in one pass."""
    multi = F.count_if(F.size(F.split("labels", r"\|")) > 1)
    sets = [["primary_label"], ["lang"], ["primary_label", "lang"], []]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], "primary_label", "lang").agg(
        F.grouping_id().alias("grouping"), F.count(F.lit(1)).alias("n_rows"), multi.alias("multi_label"),
        F.countDistinct("template_id").alias("templates"),
        *[F.sum(c).alias(c) for c in df.columns if c.startswith("y_")])


def exclusive_vocab(df: DataFrame) -> DataFrame:
    """Per ``label``: the share of word occurrences whose word no other label uses.

    ``df``: ``label, word``.  Words are counted per label first, so a frequent
    word is a handful of rows when labels are compared.
    """
    per = df.groupBy("word", "label").agg(F.count(F.lit(1)).alias("n"))
    only = F.count(F.lit(1)).over(Window.partitionBy("word")) == 1
    return per.withColumn("_only", only).groupBy("label").agg(
        F.sum("n").alias("occurrences"),
        (F.sum(F.when(F.col("_only"), F.col("n")).otherwise(0)) / F.sum("n")).alias("exclusive_mass"))


def words_of(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return df.select(*keys, F.explode(F.filter(F.split(text, WS), lambda w: w != "")).alias("word"))


def concept_conflicts(df: DataFrame, concepts: dict[str, list[str]]) -> DataFrame:
    """Concepts whose rows carry more than one label set, with a count per set.

    ``df``: ``text, labels`` (array).
    """
    text = F.lower("text")
    hits = F.array_compact(F.array(*[
        F.when(F.greatest(*[text.contains(w.lower()) for w in words], F.lit(False)), F.lit(name))
        for name, words in concepts.items()]))
    per = df.select(F.explode(hits).alias("concept"), F.array_join(F.array_sort("labels"), "|").alias("label_set")).groupBy(
        "concept", "label_set").agg(F.count(F.lit(1)).alias("n"))
    sets = F.count(F.lit(1)).over(Window.partitionBy("concept"))  # one row per label set by now
    return per.withColumn("label_sets", sets).filter("label_sets > 1")


def role_vocabulary(df: DataFrame) -> DataFrame:
    role = F.trim("role")
    return df.filter(role != "").select(role.alias("role")).distinct().orderBy("role")
