"""Removal of every byte that a repeated string of 200 bytes covers, by sorted suffixes.

Sorting all suffixes of a corpus would move it 200 times over, so suffixes are sampled
without loss: of the 48-byte strings within a 200-byte string the one with the least hash
is its anchor, and equal strings have equal anchors.  Only anchors whose 48 bytes may occur
again (by a hash, which can let too many through but none too few) are followed up.

1. The surroundings of the anchors are folded within an input partition, as a combiner
   would, so a passage that a third of all documents share is a row a partition.
2. The suffixes that start at the anchors are range-partitioned by their bytes, then by the
   bytes before them, at splitters that Spark samples; ranges follow the number of suffixes.
3. Each bucket sorts its suffixes by multikey quicksort over tokens of 8 bytes, and the
   bytes left of the anchors likewise; common prefixes of neighbours tell which strings
   occur twice.
4. Runs of suffixes that reach a bucket's first or last row are compared across bucket
   boundaries by their strings.

Strings are equal only if their bytes are; every one is judged on the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, textops

LENGTH, GRAM = 200, 48
_REACH = LENGTH - GRAM  # an anchor lies at most this far behind its string's start
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring strings from their hashes."""
    z = a[: len(b)] * _B
    z ^= z >> np.uint64(31)
    z += b
    z *= _C
    z ^= z >> np.uint64(30)
    return z


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``GRAM`` neighbouring bytes."""
    now = data.astype(np.uint64) * _A + _C
    now ^= now >> np.uint64(29)
    size = 1
    while 2 * size <= GRAM:
        now = _join(now, now[size:])
        size *= 2
    return _join(now, now[GRAM - size :]) if size < GRAM else now


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, position in the row, hash, least and most distance to its strings' starts, of every anchor."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(data) < LENGTH:
        return none
    value = gram_hashes(data)
    least, place = value, np.arange(len(value), dtype=np.int32)
    span, width = 1, _REACH + 1
    while span < width:
        step = min(span, width - span)
        left = least[:-step] <= least[step:]
        place = np.where(left, place[:-step], place[step:])
        least = np.where(left, least[:-step], least[step:])
        span += step
    sizes = np.diff(off)
    many = np.maximum(sizes - LENGTH + 1, 0)
    start = textops.ragged(off[:-1], many)
    if not len(start):
        return none
    row = np.repeat(np.arange(len(sizes)), many)
    at = place[start].astype(np.int64)
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    a = at[first]
    return row[first], a - off[row[first]], value[a].view(np.int64), a - start[last], a - start[first]


def _slices(data: np.ndarray, off: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The rows a few at a time, very long ones in parts that overlap by a string less a byte: bytes, ends, rows, places."""
    sizes = np.diff(off)
    many = np.maximum(1, -(-(sizes - LENGTH + 1) // most))
    row = np.repeat(np.arange(len(sizes)), many)
    place = textops.ragged(np.zeros(len(many), np.int64), many) * most
    size = np.minimum(sizes[row] - place, most + LENGTH - 1)
    upto, at = np.cumsum(size), 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        pick = slice(at, to)
        ends = np.concatenate(([0], np.cumsum(size[pick])))
        yield data[textops.ragged((off[row] + place)[pick], size[pick])], ends, row[pick], place[pick]
        at = to


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textops.pieces(batch, "text", 1 << 20):
            for data, ends, rows, places in _slices(*textops.utf8(part.column("text")), 1 << 20):
                row, at, value, near, far = anchors(data, ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value), part.column("rid").take(pa.array(rows[row])), pa.array(at + places[row]), pa.array(near.astype(np.int16)), pa.array(far.astype(np.int16))],
                    ["h", "rid", "at", "near", "far"],
                )


_CONTEXTS = "id long, rid long, begin long, context binary, near short, far short, n long"
#: Surroundings that a task folds before it passes them on.
_FOLDED = 1 << 16


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each anchor (``rid, begin, far``), and one for each of the surroundings with how many there are (``n``)."""
    names = [x.split()[0] for x in _CONTEXTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int16(), pa.int16(), pa.int64()]
    base = TaskContext.get().partitionId() << 40
    seen: dict[tuple[int, bytes], int] = {}
    counts: list[int] = []

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal base, seen, counts
        shapes = np.array([x[0] for x in seen], np.int64)
        own = list(seen)
        for lo in range(0, len(own), 8192):
            pick = slice(lo, lo + 8192)
            n = len(own[pick])
            columns = [np.arange(base + lo, base + lo + n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), [x[1] for x in own[pick]], (shapes[pick] & 0xFFFF).astype(np.int16), (shapes[pick] >> 16).astype(np.int16), counts[pick]]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds)], names)
        base, seen, counts = base + len(own), {}, []

    for batch in batches:
        for part in textops.pieces(batch, "text", 1 << 20):
            data, off = textops.utf8(part.column("text"))
            lists = part.column("marks")
            each = lists.flatten()
            count = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(count)), count)
            at, near, far = (each.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            begin = at - far
            for lo in range(0, len(row), 8192):
                pick = slice(lo, lo + 8192)
                sizes = (LENGTH + far - near)[pick]
                raw = data[textops.ragged(off[row[pick]] + begin[pick], sizes)].tobytes()
                ends = [0, *np.cumsum(sizes).tolist()]
                shapes = ((far[pick] << 16) | near[pick]).tolist()
                ids = np.empty(len(shapes), np.int64)
                for i, key in enumerate((s, raw[a:b]) for s, a, b in zip(shapes, ends, ends[1:])):
                    ids[i] = own = seen.setdefault(key, len(seen))
                    if own == len(counts):
                        counts.append(1)
                    else:
                        counts[own] += 1
                n = len(ids)
                columns = [ids + base, part.column("rid").take(pa.array(row[pick])), begin[pick], pa.nulls(n, pa.binary()), pa.nulls(n, pa.int16()), far[pick].astype(np.int16), pa.nulls(n, pa.int64())]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds)], names)
                if len(seen) >= _FOLDED:
                    yield from close()
    yield from close()


def multikey_order(tokens: np.ndarray, few: int = 48) -> np.ndarray:
    """Row order of a matrix of big-endian tokens, by multikey quicksort.

    Rows are parted at one token in smaller, equal and greater ones than a pivot; equal ones
    go on with the next token.  Parts of a few rows are finished by comparing what is left.
    """
    n, depths = tokens.shape
    plain = np.ascontiguousarray(tokens.astype(">u8"))
    order = np.arange(n)
    stack = [(0, n, 0)]
    while stack:
        a, b, depth = stack.pop()
        if b - a < 2 or depth == depths:
            continue
        rows = order[a:b]
        if b - a <= few:
            rest = plain[rows, depth:].tobytes()
            width = 8 * (depths - depth)
            keys = [rest[i * width : (i + 1) * width] for i in range(b - a)]
            order[a:b] = rows[sorted(range(b - a), key=keys.__getitem__)]
            continue
        token = tokens[rows, depth]
        pivot = sorted((token[0], token[(b - a) // 2], token[-1]))[1]
        low, high = token < pivot, token > pivot
        less, more = int(low.sum()), int(high.sum())
        order[a:b] = np.concatenate([rows[low], rows[~(low | high)], rows[high]])
        stack += [(a, a + less, depth), (a + less, b - more, depth + 1), (b - more, b, depth)]
    return order


def _common(m: np.ndarray) -> np.ndarray:
    """Bytes that each row and the next one begin with alike."""
    out = np.zeros(max(0, len(m) - 1), np.int64)
    for lo in range(0, len(out), 4096):
        hi = min(lo + 4096, len(out))
        differ = m[lo:hi] != m[lo + 1 : hi + 1]
        out[lo:hi] = np.where(differ.any(1), differ.argmax(1), m.shape[1])
    return out


def compare(lefts: list[bytes], rights: list[bytes], near: np.ndarray, far: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, list[tuple[bytes, int, int, bool]]]:
    """What one bucket finds: covered strings, and strings to compare across its boundaries.

    Returns a matrix (row, distance of the string's start to the anchor) of strings that
    occur in another row too, or in a row that stands for ``many``; and for runs at the edges
    of the bucket tuples ``(string, row, distance, open)``, where ``open`` strings have no
    partner here.
    """
    n = len(rights)
    right = np.zeros((n, LENGTH), np.uint8)
    left = np.zeros((n, _REACH), np.uint8)  # column 0 is next to the anchor
    flat = np.frombuffer(b"".join(rights), np.uint8)
    sizes = np.fromiter(map(len, rights), np.int64, n)
    right[np.repeat(np.arange(n), sizes), textops.ragged(np.zeros(n, np.int64), sizes)] = flat
    flat = np.frombuffer(b"".join(lefts), np.uint8)
    left[np.repeat(np.arange(n), far), np.repeat(far, far) - 1 - textops.ragged(np.zeros(n, np.int64), far)] = flat
    order = multikey_order(right.view(">u8").astype(np.uint64))
    right, left, near, far, many = right[order], left[order], near[order], far[order], many[order]
    lcp = _common(right)
    # Ranks of the bytes before the anchors: rows share d of them if no seam between is below d.
    turn = multikey_order(left.view(">u8").astype(np.uint64))
    seam = _common(left[turn])
    rank = np.empty(n, np.int64)
    rank[turn] = np.arange(n)

    covered = np.zeros((n, _REACH + 1), dtype=bool)
    edges: list[tuple[bytes, int, int, bool]] = []
    for distance in range(_REACH + 1):
        fit = np.flatnonzero((near <= distance) & (distance <= far))
        if not len(fit):
            continue
        run = np.concatenate(([0], np.cumsum(lcp < LENGTH - distance)))
        side = np.concatenate(([0], np.cumsum(seam < distance)))[rank[fit]]
        key = run[fit] * n + side
        turned = np.argsort(key)
        sorted_ = key[turned]
        first = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
        group = np.cumsum(first) - 1
        twice = np.bincount(group, many[fit][turned])[group] > 1
        rows = fit[turned]
        covered[rows[twice], distance] = True
        # One row of each string in a run that reaches an edge; it is open if it is alone.
        edge = first & ((run[rows] == 0) | (run[rows] == run[-1]))
        for i in np.flatnonzero(edge).tolist():
            r = int(rows[i])
            edges.append((left[r, :distance][::-1].tobytes() + right[r, : LENGTH - distance].tobytes(), int(order[r]), distance, not twice[i]))
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return covered[back], edges


_FOUND = "id long, first short, last short, string binary, bucket int, open boolean"


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if len(b)]  # a range holds a bounded number of suffixes, see remove_repeats()
    if not held:
        return
    ids, near, far, many = (np.concatenate([b.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for b in held]) for x in ("id", "near", "far", "n"))
    lefts, rights = ([x for b in held for x in b.column(name).to_pylist()] for name in ("left", "right"))
    del held
    covered, edges = compare(lefts, rights, near, far, many)
    padded = np.zeros((len(ids), _REACH + 3), np.int8)
    padded[:, 1:-1] = covered
    turns = np.diff(padded, axis=1)
    row, first = np.nonzero(turns == 1)
    _, stop = np.nonzero(turns == -1)
    bucket = TaskContext.get().partitionId()

    def rows(own: np.ndarray, a, b, string: list, open_: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int64()), pa.array(a, pa.int16()), pa.array(b, pa.int16()), pa.array(string, pa.binary()), pa.array([bucket] * len(own), pa.int32()), pa.array(open_, pa.bool_())],
            [x.split()[0] for x in _FOUND.split(", ")],
        )

    for lo in range(0, len(row), 65536):
        pick = slice(lo, lo + 65536)
        none = [None] * len(row[pick])
        yield rows(ids[row[pick]], first[pick].astype(np.int16), (stop[pick] - 1).astype(np.int16), none, none)
    for lo in range(0, len(edges), 16384):
        part = edges[lo : lo + 16384]
        at = ids[[x[1] for x in part]]
        yield rows(at, [x[2] for x in part], [x[2] for x in part], [x[0] for x in part], [x[3] for x in part])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textops.pieces(batch, "text"):
            data, off = textops.utf8(part.column("text"))
            spans, kept = [], []
            for i, found in enumerate(part.column("found").to_pylist()):
                raw = data[off[i] : off[i + 1]]
                merged: list[list[int]] = []
                for x in sorted((x["a"], x["b"]) for x in found or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                at, left = 0, []
                for a, b in merged:
                    left.append(raw[at:a])
                    at = b
                kept.append(b"".join(x.tobytes() for x in [*left, raw[at:]]))
                spans.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )


@contextmanager
def _sampled(spark: SparkSession, rows: int) -> Iterator[None]:
    """Splitters come from so many rows a range; Spark sends them to the driver, a million at most."""
    name = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 1 << 15) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every row's whole text as UTF-8.

    ``spans`` are the maximal removed runs (start, end in bytes), ``kept`` the other bytes.
    A byte goes if a 200-byte string that covers it starts anywhere else too, in the same
    text or another; repeated rows are two occurrences.  Null and empty texts, and texts
    below 200 bytes, keep all they have; very long ones are read in parts that overlap; null
    ids stay null; an empty table gives an empty table; further columns are ignored, whatever
    their names.  A range of suffixes holds about ``range_rows``.
    """
    # Written once: row numbers must not change between the passes, even if executors do.
    rows = scratch.table(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "rows")
    marks = rows.select("rid", "text").mapInArrow(_find, "h long, rid long, at long, near short, far short")
    # Written, so that both sides of the next join are plain exchanges whose skew can be split.
    again = scratch.table(marks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "grams")
    by_row = scratch.table(
        marks.join(again, "h", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("at", "near", "far")).alias("marks")), "anchors"
    )
    contexts = scratch.table(rows.select("rid", "text").join(by_row, "rid").select("rid", "text", "marks").mapInArrow(_surroundings, _CONTEXTS), "contexts")
    folded = contexts.where("context is not null")
    suffixes = folded.select("id", F.expr("substring(context, 1, far)").alias("left"), F.expr("substring(context, far + 1, 200)").alias("right"), "near", "far", "n")
    ranges = max(16, -(-folded.count() // range_rows))
    with _sampled(docs.sparkSession, 20):
        found = scratch.table(suffixes.repartitionByRange(ranges, "right", "left").mapInArrow(_bucket, _FOUND), "found")

    edge = found.where("string is not null")
    across = edge.groupBy("string").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a <> b").select("string")
    late = edge.where("open").join(across, "string", "left_semi")
    covered = found.where("string is null").select("id", "first", "last").union(late.select("id", "first", "last"))
    covered = scratch.table(covered.groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "ranges")
    spans = (
        contexts.where("context is null").select("id", "rid", "begin", "far").join(covered, "id")
        .select("rid", "begin", "far", F.explode("ranges").alias("r"))
        .select("rid", F.struct((F.col("begin") + F.col("far") - F.col("r.last")).alias("a"), (F.col("begin") + F.col("far") - F.col("r.first") + LENGTH).alias("b")).alias("x"))
        .groupBy("rid").agg(F.collect_list("x").alias("found"))
    )
    return rows.join(spans, "rid", "left").select("doc_id", "text", "found").mapInArrow(_remove, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
