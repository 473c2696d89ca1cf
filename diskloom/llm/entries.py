"""Contract queries of the subpackage: thin projections of the operators over whole tables.

Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns give
what the docstrings of the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_text, language_model, media, mixing, packing, quality, repeats, scratch, simhash, token_counts

#: The vocabulary file; a parameter of the operators, never part of this repository.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048
#: The vocabulary's end-of-document id.
END_ID = 50256


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all ``documents`` in sequences of at most 2048 (see :mod:`.packing`)."""
    return packing.pack(packing.token_pieces(_table(spark, sf_dir, "documents"), VOCABULARY, CAPACITY), CAPACITY)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical Pitman-Yor and unigram scores of all ``documents`` (see :mod:`.language_model`)."""
    return language_model.score(_table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 200 bytes take from each of ``documents`` (see :mod:`.repeats`)."""
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages`` (see :mod:`.html_text`)."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of each group of equal texts stays (see :mod:`.exact_dedup`)."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).drop("n_points")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all ``documents``, learned from ``labels`` (see :mod:`.quality`)."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each of ``documents`` (see :mod:`.mixing`)."""
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("copies")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate classes of all ``documents`` (see :mod:`.simhash`)."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of all ``documents`` stored as WAV, written and read back (see :mod:`.media`)."""
    return media.describe(scratch.table(media.store(_table(spark, sf_dir, "documents")), "media")).drop("landmarks")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents`` from flat token files (see :mod:`.token_counts`)."""
    flat = scratch.table(token_counts.write_flat(_table(spark, sf_dir, "documents"), VOCABULARY, END_ID), "flat")
    return token_counts.count_tokens(flat, END_ID).select("doc_id", "n_tokens")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_OP5_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": _OP5_SQL}
