"""Exact deduplication in three combining stages, native expressions only.

1. *Local*: the partial aggregation folds equal texts of one run of input rows before
   anything is shuffled.
2. *Salted*: digest groups are merged per salt (a run of rows of one input partition), so
   a text that makes up a third of all rows is spread over as many groups as there are runs.
3. *Global*: the salt winners of each text (at most one row per salt) are combined.

Wherever groups are formed, the key holds the whole normalised text beside its digest, so
two texts are joined only if they are equal, never because their digests are.  What comes
after refers to a salted group by its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import scratch

_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def normalised(text: Column) -> Column:
    """The text (null: empty) without the characters of ``[\\x20\\x09-\\x0D]``."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _WHITE, "")


def _members(rows: DataFrame, salt_rows: int) -> DataFrame:
    """All of ``rows`` (id, text, rid) with their group's winner: ``id, rid, keep_id, group_size, kept, sha, n``."""
    salt = F.floor(F.monotonically_increasing_id() / salt_rows)
    keyed = rows.select("id", "rid", F.char_length("text").alias("n"), normalised(F.col("text")).alias("norm"), salt.alias("salt")).withColumn("sha", F.sha2(F.encode("norm", "UTF-8"), 256))
    rank = F.struct((-F.col("n")).alias("less"), F.isnull("id").alias("none"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    salted = (
        keyed.groupBy("sha", "norm", "salt")
        .agg(F.min(rank).alias("win"), F.count(F.lit(1)).alias("n_rows"), F.collect_list(rank).alias("members"))
        .select(F.monotonically_increasing_id().alias("group"), "sha", "norm", "win", "n_rows", "members")
    )
    salted = scratch.table(salted, "dedup-salted")  # written: the numbers must not change
    same = Window.partitionBy("sha", "norm")
    winners = salted.select("group", "sha", "norm", "win", "n_rows").select("group", F.min(F.struct("win", "group")).over(same).alias("best"), F.sum("n_rows").over(same).alias("group_size"))
    # The members that a salted group stands for; sorting puts its winner first.
    return salted.select("group", "sha", "members").join(winners, "group").select(
        F.posexplode(F.array_sort("members")).alias("place", "member"), "sha", "best", "group", "group_size"
    ).select(
        "member.id", "member.rid", F.col("best.win.id").alias("keep_id"), "group_size", ((F.col("place") == 0) & (F.col("group") == F.col("best.group"))).alias("kept"), "sha", (-F.col("member.less")).cast("long").alias("n")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt_rows: int = 1 << 16) -> DataFrame:
    """One row per input row: which row of its group of equal texts stays.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256, n_points``.  The row with the
    most code points in the original text stays, then the smallest id (null ids last).
    Null texts count as empty; empty texts form a group like any other; texts of any length
    are compared whole; of rows repeated with the same id exactly one is kept; an empty table
    gives an empty table; further columns of ``docs`` are neither read nor returned, whatever
    their names.  A salted group lists ``salt_rows`` members at most.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.lit(0).cast("long").alias("rid"))
    return _members(rows, salt_rows).select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("sha").alias("text_sha256"), F.col("n").alias("n_points"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt_rows: int = 1 << 16) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Nulls, empty and long texts, ties, repeats and empty tables are treated as there; columns
    may have any names, as rows travel as one struct beside a row number.
    """
    numbered = scratch.table(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "dedup-rows")
    own = F.col("row")
    rows = numbered.select(own[id_col].alias("id"), F.coalesce(own[text_col].cast("string"), F.lit("")).alias("text"), "rid")
    return numbered.join(_members(rows, salt_rows).where("kept").select("rid"), "rid", "left_semi").select("row.*")
