"""A training corpus from ``documents``: filter, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` writes each stage's rows as
Parquet in the shared folder and gives them to the next stage, so every stage
starts from stored rows and none is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uipatterns.llm import mixing, neardup, packing, quality, substring
from uipatterns.llm.common import shared_folder, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Documents below this quality score go.
LEAST_QUALITY = 0.3
#: Passages of so many words or more are kept where they stand first.
PASSAGE = 30


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the line classifier, trained on ``labels``, rejects."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model).filter(F.col("quality_score") >= LEAST_QUALITY).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.drop_near_duplicates(docs, words=5, percent=80).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document, or earlier in the same one, are cut out of the text."""
    out = substring.remove_repeats(docs, window=PASSAGE)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or thin out the documents of each source to its target."""
    return mixing.mix(docs, by_text=True).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each document (each copy of it) its place in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", filter_quality),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    folder = shared_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), folder, f"stage{i}")
    return docs
