"""A training corpus in five stages: toxic texts out, one of each near-duplicate group, personal data replaced, sources mixed, packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kmerloom.cluster import fresh_folder, remove
from kmerloom.llm import likeness, mixing, packing, pii, toxicity
from kmerloom.llm.common import spread
from kmerloom.llm.queries import KEY, TOKENIZER, WEIGHTS, levels

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    return toxicity.keep_clean(spread(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more the document of the smallest id stays: SimHash links first, bands for what lies beyond their radius, all checked exactly."""
    return likeness.one_of_each(spread(docs)).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced; every document stays."""
    return pii.replace_pii(spread(docs), KEY).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, dealt by the tree's weights; no document twice."""
    return mixing.mix(spread(docs), levels(), WEIGHTS, 0.9, max_epochs=1).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, with their ids."""
    return packing.pack(spread(docs), TOKENIZER, with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL has no conditional random field, XXH64 or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written as Parquet below spark.checkpoint.dir and read again by the next; a stage's table goes
    when its successor's is written, so personal data isn't kept."""
    folder = fresh_folder(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
