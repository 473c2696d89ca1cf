"""SimHash fingerprints and near-duplicate classes by meet-in-the-middle ball hashing.

Two fingerprints at distance 4 or less share a variant at distance 2 or less from both.
Every distinct fingerprint therefore emits all variants within half the radius, variants
are dealt out by value, and equal ones collide.  To keep the shuffle small, a fingerprint
travels once to every bucket (leading bits) that holds some of its variants, and the
variants of that bucket are written out there.  All owners of one variant lie within the
radius of each other; after verification each is linked to the smallest of them only, so
no group is expanded to pairs and the connected classes are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textops

_SEED = 42


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (64 bits as a long) of every whole text.

    Shingles of ``shingle`` lower-cased words joined by one space, repeats included; a
    shorter text is one shingle; a text without words (null, empty) has fingerprint 0.
    Rows are marked each for itself, whole texts of any length; null ids stay null.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for part in textops.pieces(batch, "text", 2 << 20):
                data, off = textops.utf8(part.column("text"))
                starts, ends, at = textops.words(data, off)
                counts = np.diff(at)
                # The words again, lower-cased, with one space after each.
                sizes = ends - starts
                begin = np.cumsum(sizes + 1) - (sizes + 1)
                stop = begin + sizes
                line, ink = np.full(int((sizes + 1).sum()), 32, np.uint8), np.ones(int((sizes + 1).sum()), bool)
                ink[stop] = False
                line[ink] = textops.LOWER[data[~textops.SPACE[data]]]  # words are all that is no white space
                text = line.tobytes()
                grams = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
                first = textops.ragged(at[:-1], grams)
                last = first + np.repeat(np.minimum(counts, shingle), grams) - 1
                marks = np.zeros(len(counts), np.uint64)
                edges = np.concatenate(([0], np.cumsum(grams)))
                hashes = np.empty(len(first), np.uint64)
                for lo in range(0, len(first), 1 << 18):  # a bounded number of Python numbers at once
                    a, b = begin[first[lo : lo + (1 << 18)]].tolist(), stop[last[lo : lo + (1 << 18)]].tolist()
                    hashes[lo : lo + len(a)] = [digest(text[i:j], _SEED) for i, j in zip(a, b)]
                for lo in range(0, len(counts), 256):  # bits of a few rows at a time
                    hi = min(lo + 256, len(counts))
                    if edges[hi] == edges[lo]:
                        continue
                    marks[lo:hi] = _majority(hashes[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(marks.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(sketch, "doc_id long, fingerprint long")


def _majority(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bits set in over half the hashes of each row; rows are ``edges[i]:edges[i+1]``."""
    some = np.flatnonzero(np.diff(edges))
    sums = np.zeros((len(some), 64), np.int64)
    step = 1 << 16
    for lo in range(0, len(hashes), step):  # a bounded number of unpacked bits at once
        hi = min(lo + step, len(hashes))
        bits = np.unpackbits(hashes[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        a = np.searchsorted(edges[some], lo, side="right") - 1
        b = np.searchsorted(edges[some], hi, side="left")
        cuts = np.maximum(edges[some[a:b]], lo) - lo
        sums[a:b] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    rows = np.zeros(len(edges) - 1, np.uint64)
    set_ = 2 * sums > np.diff(edges)[some][:, None]
    rows[some] = np.packbits(set_, axis=1).view(">u8").ravel().astype(np.uint64)
    return rows


@lru_cache(maxsize=64)
def _flips(bits: int) -> list[np.ndarray]:
    """Masks that flip none, one and two of the lowest ``bits`` bits."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    i, j = np.triu_indices(bits, 1)
    return [np.zeros(1, np.uint64), one, one[i] | one[j]]


def links(marks: DataFrame, bits: int) -> DataFrame:
    """Verified links ``a < b`` between distinct fingerprints at distance 4 or less.

    ``marks`` has distinct longs in ``fingerprint``; ``bits`` leading bits name a bucket.
    """
    low = 64 - bits
    top = np.concatenate(_flips(bits)) if bits else np.zeros(1, np.uint64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(own), 4096):
                x = own[lo : lo + 4096]
                bucket = (x >> np.uint64(low))[:, None] ^ top[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().astype(np.int64)), pa.array(np.repeat(x, len(top)).view(np.int64))], ["bucket", "fingerprint"])

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            a, b = _stars(np.concatenate(held), now, low)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:  # sorted by bucket
            bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
            own = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(bucket):
                continue
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
            for i, j in zip(cuts[:-1], cuts[1:]):
                if now is not None and bucket[i] != now:
                    yield from close()
                    held = []
                now = int(bucket[i])
                held.append(own[i:j].copy())
        if held:
            yield from close()

    dealt = marks.select("fingerprint").mapInArrow(spread, "bucket long, fingerprint long").repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(collide, "a long, b long").distinct()


#: Variants of a bucket that are written out at once.
_VARIANTS = 4_000_000


def _stars(own: np.ndarray, bucket: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the owners of equal variants of one bucket (the bits above ``low``), each to the smallest owner.

    A crowded bucket is dealt out again by a few more bits, so every variant is still
    written once and memory is bounded.
    """
    away = np.bitwise_count((own >> np.uint64(low)) ^ np.uint64(bucket)) if low < 64 else np.zeros(len(own), np.uint8)
    flips = _flips(low)
    total = sum(int((away == k).sum()) * sum(len(f) for f in flips[: 3 - k]) for k in range(3))
    if total > _VARIANTS and low:
        more = min(low, 8, int(np.ceil(np.log2(total / _VARIANTS))) + 1)
        part = (own >> np.uint64(low - more)) & np.uint64((1 << more) - 1)
        found = []
        for child in range(1 << more):
            who = away + np.bitwise_count(part ^ np.uint64(child)) <= 2
            if np.count_nonzero(who) > 1:
                found.append(_stars(own[who], bucket << more | child, low - more))
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return _folded(*(np.concatenate(x) for x in zip(*found)))

    head = np.uint64(bucket << low) if low < 64 else np.uint64(0)
    rest = (own & np.uint64((1 << low) - 1)) | head
    values, owners = [], []
    for k in range(3):
        who = np.flatnonzero(away == k)
        for flip in flips[: 3 - k]:
            values.append((rest[who][:, None] ^ flip[None, :]).ravel())
            owners.append(np.repeat(who, len(flip)).astype(np.int32))
    v, o = np.concatenate(values), np.concatenate(owners)
    ordered = np.sort(v)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sieve = np.zeros(1 << 20, dtype=bool)
    mix = lambda z: ((z * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
    sieve[mix(twice)] = True
    near = np.flatnonzero(sieve[mix(v)])
    twice = np.unique(twice)
    at = np.searchsorted(twice, v[near])
    hit = twice[np.minimum(at, len(twice) - 1)] == v[near]
    v, x = v[near][hit], own[o[near][hit]]
    order = np.lexsort((x, v))
    v, x = v[order], x[order]
    lead = np.concatenate(([True], v[1:] != v[:-1]))
    least = x[np.flatnonzero(lead)][np.cumsum(lead) - 1]
    real = (least != x) & (np.bitwise_count(least ^ x) <= 4)
    pairs = np.unique(np.stack([least[real], x[real]], axis=1), axis=0)
    return _folded(pairs[:, 0], pairs[:, 1])


def _folded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same classes with one link a member: from the least member to each other one."""
    nodes, turned = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = turned[: len(a)], turned[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[one], label[two])
        np.minimum.at(label, one, low)
        np.minimum.at(label, two, low)
        np.minimum.at(label, before, label)  # a former root follows its members
        label = label[label]
        if (label == before).all():
            break
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node that each node of ``edges`` (a, b) can reach.

    Alternating large-star and small-star steps; every round is written to the shared
    folder, and aggregation before each join keeps hubs from gathering in one task.
    """
    edges = scratch.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("u", "v")
        # The least neighbours are written, so that a hub's rows can be split in the join.
        least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        # Small star: every node to the least of its smaller neighbours.
        least = scratch.table(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        small = large.join(least, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        small = small.union(least.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()
        edges = scratch.table(small, "stars")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Fingerprints at 4 or fewer differing bits are linked; ``component_id`` is the smallest
    id reachable.  Null and empty texts have fingerprint 0, linked like any other; long
    texts count whole; null ids are never a component's id unless it has no other; repeated
    rows share a class; an empty table gives an empty table; further columns are ignored,
    whatever their names.
    """
    marks = scratch.table(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    own = scratch.table(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    # About four million variants to a bucket, at any number of fingerprints.
    bits = int(min(63, max(4, np.ceil(np.log2(max(1, own.count()) * 2081 / 2e6)))))
    roots = components(links(own, bits))
    classed = own.join(roots, own["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    # A giant class is named in two steps, and its name goes to as many salts as it has.
    salts = scratch.width(docs.sparkSession)
    classed = scratch.table(classed.withColumn("salt", F.pmod(F.xxhash64("fingerprint"), F.lit(salts))), "classed")
    partly = classed.groupBy("root", "salt").agg(F.min("least").alias("least"))
    named = partly.groupBy("root").agg(F.min("least").alias("component_id"), F.collect_list("salt").alias("own"))
    by_mark = classed.join(named.select("root", "component_id", F.explode("own").alias("salt")), ["root", "salt"]).select("fingerprint", "component_id")
    return marks.join(by_mark, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id names their class.

    Nulls, empty and long texts and empty tables are treated as by :func:`near_duplicates`;
    rows that repeat the id are equal in class and all stay, so deduplicate exactly first;
    columns may have any names, as rows travel as one struct.
    """
    kept = near_duplicates(docs, shingle, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    rows = docs.select(F.col(id_col).alias("at"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(kept, F.col("at").eqNullSafe(F.col("doc_id")), "left_semi").select("row.*")
