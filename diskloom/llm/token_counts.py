"""Token counts of documents in flat token files without an index.

A flat file is nothing but ids, each document followed by an end-of-document id.  It is
read in blocks of any size: a vectorised comparison finds the separators of a block, and
an exclusive prefix scan over the blocks of a file (tokens before, separators before,
last separator before) stitches the documents that cross block boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import textops
from .tokens import encoder


def write_flat(docs: DataFrame, vocabulary: str, end_id: int, block_tokens: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as flat files of 16-bit ids (one file for each input partition), in blocks.

    Returns ``file, block, content, doc_ids``: blocks are cut regardless of documents, and
    ``doc_ids`` names the documents whose separator lies in the block, in order.  Null and
    empty texts are a separator alone; long texts fill as many blocks as they need; a special
    token's string in a text is ordinary text, never a separator; null ids stay null;
    repeated rows are written each; an empty table gives an empty table; further columns are
    ignored, whatever their names.  Ids above 16 bits are an error.
    """
    if end_id > 0xFFFF:
        raise ValueError("the end id does not fit 16 bits")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = encoder(vocabulary), TaskContext.get().partitionId()
        held, ids, stops, block, size = [], [], [], 0, 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, ids, stops, block, size
            if not size:
                return
            flat, names, at = np.concatenate(held), np.concatenate(ids), np.concatenate(stops)
            names = names.tolist()
            whole = len(flat) if last else len(flat) // block_tokens * block_tokens
            done = 0
            for lo in range(0, whole, block_tokens):
                hi = min(lo + block_tokens, whole)
                upto = int(np.searchsorted(at, hi))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([flat[lo:hi].tobytes()], pa.binary()), pa.array([names[done:upto]], pa.list_(pa.int64()))],
                    ["file", "block", "content", "doc_ids"],
                )
                done, block = upto, block + 1
            held, ids, stops, size = [flat[whole:]], [np.array(names[done:], object)], [at[done:] - whole], len(flat) - whole

        for batch in batches:
            for part in textops.pieces(batch, "text"):
                data, off = textops.utf8(part.column("text"))
                found, at = encode(data, off)
                if len(found) and int(found.max()) > 0xFFFF:
                    raise ValueError("an id does not fit 16 bits")
                counts = np.diff(at)
                ends = np.cumsum(counts + 1) - 1
                flat = np.full(int(counts.sum() + len(counts)), end_id, dtype="<u2")
                flat[textops.ragged(ends - counts, counts)] = found
                stops.append(ends + size)
                held.append(flat)
                ids.append(np.array(part.column("doc_id").to_pylist(), object))
                size += len(flat)
                if size >= block_tokens:
                    yield from cut(False)
        yield from cut(True)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(write, "file int, block int, content binary, doc_ids array<long>")


def read_flat(spark: SparkSession, path: str, block_bytes: int = 1 << 20) -> DataFrame:
    """Blocks ``file, block, content`` of flat files below 2 GB each, found under ``path``."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    return files.select(
        F.col("path").alias("file"), F.posexplode(F.expr(f"sequence(0L, length - 1, {block_bytes}L)")).alias("block", "at"), F.col("content")
    ).select("file", "block", F.expr(f"substring(content, cast(at + 1 as int), {block_bytes})").alias("content"))


def count_tokens(blocks: DataFrame, end_id: int, id_bytes: int = 2) -> DataFrame:
    """``file, ordinal, n_tokens, ended, doc_id`` of every document in flat files.

    ``blocks`` has ``file, block, content`` (whole little-endian ids of ``id_bytes``) and may
    have ``doc_ids``; ``n_tokens`` leaves the separator out.  Documents without tokens count
    0; ids after the last separator are a document that has not ended; an empty block or
    table adds nothing.
    """
    named = "doc_ids" in blocks.columns
    source = blocks.select("file", "block", "content", (F.col("doc_ids") if named else F.lit(None).cast("array<long>")).alias("doc_ids"))
    kind = f"<u{id_bytes}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, stops = [], []
            for content in batch.column("content").to_pylist():
                ids = np.frombuffer(content or b"", dtype=kind)
                sizes.append(len(ids))
                stops.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array(stops, pa.list_(pa.int64())), batch.column("doc_ids")],
                ["file", "block", "n", "stops", "doc_ids"],
            )

    name = dict(blocks.dtypes)["file"]
    scanned = source.mapInArrow(scan, f"file {name}, block int, n long, stops array<long>, doc_ids array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stitched = (
        scanned.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("ordinals", F.coalesce(F.sum(F.size("stops")).over(before), F.lit(0)))
        .withColumn("last", F.when(F.size("stops") > 0, F.col("base") + F.array_max("stops")))
        .withColumn("from", F.coalesce(F.max("last").over(before), F.lit(-1)))
        .withColumn("end", F.sum("n").over(whole))
        .withColumn("final", F.coalesce(F.max("last").over(whole), F.lit(-1)))
        .withColumn("total", F.sum(F.size("stops")).over(whole))
        .withColumn("newest", F.row_number().over(Window.partitionBy("file").orderBy("block")) == F.count(F.lit(1)).over(whole))
    )
    ended = stitched.select("file", "base", "ordinals", "from", "stops", "doc_ids", F.posexplode("stops").alias("k", "stop")).select(
        "file",
        (F.col("ordinals") + F.col("k")).cast("long").alias("ordinal"),
        (F.col("base") + F.col("stop") - F.when(F.col("k") > 0, F.col("base") + F.try_element_at("stops", F.greatest(F.col("k"), F.lit(1)))).otherwise(F.col("from")) - 1).cast("long").alias("n_tokens"),
        F.lit(True).alias("ended"),
        F.try_element_at("doc_ids", F.col("k") + 1).alias("doc_id"),
    )
    rest = stitched.where("newest and end - final > 1").select("file", F.col("total").cast("long").alias("ordinal"), (F.col("end") - F.col("final") - 1).cast("long").alias("n_tokens"), F.lit(False).alias("ended"), F.lit(None).cast("long").alias("doc_id"))
    return ended.unionByName(rest) if not named else ended
