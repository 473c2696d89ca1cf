"""Best-fit packing of token pieces into sequences of a fixed capacity.

The packing depends on lengths alone, and there are at most ``capacity`` of them.  So it
is solved on the histogram of lengths (a few thousand numbers however large the corpus):
pieces above a third of the capacity are matched greedily, the largest with the largest
that still fits, at most two to a sequence; smaller ones go, the largest first, into the
tightest remaining gaps.  The solution is a short list of slots (a range of ranks within
one length -> sequences and offsets), and every piece looks its place up by its rank.
Ranks come from salted counts, so a length that a third of all pieces share is spread.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import scratch, textops
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, special: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as ids and one end id, cut into pieces of ``capacity`` only where longer.

    The first piece of a long text takes the remainder, the others are full.  A null or
    empty text is one piece that holds the end id alone; null ids stay null; repeated rows
    are cut each; an empty table gives an empty table; further columns are ignored, whatever
    their names.  ``special`` says whether a special token's string in a text is its id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, special)
        for batch in batches:
            for part in textops.pieces(batch, "text"):
                data, off = textops.utf8(part.column("text"))
                ids, at = encode(data, off)
                counts = np.diff(at) + 1
                full = np.full(int(counts.sum()), end_id, dtype="<u4")
                starts = np.cumsum(counts) - counts
                full[textops.ragged(starts, counts - 1)] = ids
                n = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), n)
                piece = textops.ragged(np.zeros(len(n), np.int64), n)
                first = counts - (n - 1) * capacity
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                a = starts[row] + start
                raw = memoryview(full).cast("B")
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(a.tolist(), (a + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


class _Gaps:
    """Open sequences by gap; sequences with equal contents are one run of numbers."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int, int]]] = {}  # gap -> (first sequence, how many, used)
        self.sizes: list[int] = []  # gaps that have a run, ascending

    def add(self, gap: int, first: int, many: int, used: int) -> None:
        if gap > 0 and many > 0:
            if not self.runs.get(gap):
                bisect.insort(self.sizes, gap)
            self.runs.setdefault(gap, []).append((first, many, used))

    def tightest(self, length: int) -> tuple[int, int, int, int] | None:
        """Take out a run of the smallest gap that holds ``length``: gap, first, how many, used."""
        at = bisect.bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        run = self.runs[gap].pop()
        if not self.runs[gap]:
            self.sizes.pop(at)
        return gap, *run


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots ``(length, first rank, first sequence, pieces per sequence, first offset)``.

    The pieces of one length with ranks from a slot's first rank up to the next slot's fill
    its sequences one after another.  Work follows the number of distinct lengths.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(n > capacity or n < 1 for n in left):
        raise ValueError("a piece is empty or longer than a sequence")
    slots: list[tuple[int, int, int, int, int]] = []
    rank = dict.fromkeys(left, 0)
    free, gaps = 0, _Gaps()

    def place(n: int, many: int, first: int, per: int, offset: int) -> None:
        slots.append((n, rank[n], first, per, offset))
        rank[n] += many
        left[n] -= many

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= n and m + n <= capacity and left[m] > (m == n)), None)
            if mate is None:
                gaps.add(capacity - n, free, left[n], n)
                many = left[n]
                place(n, many, free, 1, 0)
            elif mate == n:
                many = left[n] // 2
                gaps.add(capacity - 2 * n, free, many, 2 * n)
                place(n, 2 * many, free, 2, 0)
            else:
                many = min(left[n], left[mate])
                gaps.add(capacity - n - mate, free, many, n + mate)
                place(n, many, free, 1, 0)
                place(mate, many, free, 1, n)
            free += many

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            found = gaps.tightest(n)
            if found is None:
                new = -(-left[n] // (capacity // n))
                gaps.add(capacity, free, new, 0)
                free += new
                continue
            gap, first, many, used = found
            per = gap // n
            whole = min(many, left[n] // per)
            if whole:
                place(n, whole * per, first, per, used)
                gaps.add(gap - per * n, first, whole, used + per * n)
                first, many = first + whole, many - whole
            else:
                rest = left[n]
                place(n, rest, first, rest, used)
                gaps.add(gap - rest * n, first, 1, used + rest * n)
                first, many = first + 1, many - 1
            gaps.add(gap, first, many, used)
    return slots


def pack(pieces: DataFrame, capacity: int = 2048, salts: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, packed into as few sequences as best fit finds.

    Rows that repeat an id are packed each for itself, null ids like others; an empty table
    gives an empty table; further columns are dropped.  What reaches the driver is one count per length, ``capacity`` at most.
    """
    spark = pieces.sparkSession
    salts = salts or scratch.width(spark)
    pieces = scratch.table(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(salts)).cast("int")), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = np.array(sorted(solve(histogram, capacity)), dtype=np.int64).reshape(-1, 5)
    # One number orders slots by length, then rank; ranks stay below 2**47.
    keys = (slots[:, 0] << 47) + slots[:, 1]

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("rank"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            own = slots[np.searchsorted(keys, (length << 47) + rank, side="right") - 1]
            nth = rank - own[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(own[:, 2] + nth // own[:, 3]), pa.array(own[:, 4] + nth % own[:, 3] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(look_up, PIECES + ", sequence_id long, offset long")
