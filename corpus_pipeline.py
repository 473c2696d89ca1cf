"""A training-data pipeline of five stages over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the columns
of ``documents``; what a stage decides takes effect for all that follow.

Odd input gives the same in every stage: null texts count as empty, and empty and very long
ones are rows like any other; of ties the one with the smallest id stays; repeated rows are
rows of their own until exact dedup leaves one of them; an empty table gives an empty table;
further columns, whatever their names, go along untouched up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from diskloom.llm import exact_dedup, mixing, packing, quality, scratch, simhash
from diskloom.llm.entries import CAPACITY, VOCABULARY


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; null and empty texts are scored like others, ids may repeat or be null."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest id (null last), one row of those."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id; texts without words are one class."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (none, once or twice); null sources are one source, texts without words are left out."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences; a document taken twice is packed twice, an empty one is its end id."""
    return packing.pack(packing.token_pieces(docs, VOCABULARY, CAPACITY), CAPACITY)


STAGES = [
    ("quality_classifier", classify),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Learned scores, fingerprints and token ids have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        start = scratch.mark()
        done = scratch.table(stage(spark, docs, sf_dir), f"stage-{name}")
        # The stage's own tables are read no more; its result is the last one written.
        scratch.release(spark, start, scratch.mark() - 1)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
