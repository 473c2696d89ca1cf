"""Mixing sources to target weights by nested hash-threshold histograms.

Every document has a 30-bit hash of its id, read as three digits of ten bits.  Words are
summed by source and first digit; the digit at which the running sum passes the budget is
the boundary; only the documents of that one bucket are summed again by the next digit,
and so on.  The documents below the threshold found in this way take one more copy, by a
plain filter, and those at the threshold the part that is left: documents are never sorted
and never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import scratch

#: Relative weights of the sources in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
_DIGITS, _BITS = 3, 10
#: Tables with one row per source are broadcast up to this many sources, shuffled beyond.
_BROADCAST_SOURCES = 100_000


def shares(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Targets of the sources: ``total`` times all sizes shared by weight, none above ``most`` times its size.

    Sources are taken in code-point order, null last.  What a source cannot take is
    shared again among the others by weight until none is above its limit.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, free, target = total * sum(size.values()), set(size), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > most * size[s]}
        if not over:
            return target | {s: unit * weight[s] for s in free}
        for s in over:
            target[s] = most * size[s]
            left -= target[s]
        free -= over
    return target


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """Words that a weighted mix takes of each document.

    Returns ``doc_id, size, source_size, target, taken, copies``, one row per input row.  A
    source's taken words come within a word of its target for each row at its threshold
    (one, but for repeated ids); ``copies`` is the same in whole documents.  Null or empty
    texts have size 0 and take nothing; long ones are counted whole; null sources are one
    source, the last; null ids hash like a value of their own; rows that repeat an id share
    its hash and are taken alike; an empty table gives an empty table; further columns are
    ignored, whatever their names.  What reaches the driver is one row per source, as the
    targets depend on all of them; thresholds stay in tables.
    """
    spark = docs.sparkSession
    digits = F.pmod(F.xxhash64(F.lit("mix"), F.col(id_col)), F.lit(1 << (_DIGITS * _BITS)))
    sized = scratch.table(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
            digits.alias("hash"),
        ),
        "mix-sizes",
    )
    per_source = [(r["source"], int(r["size"])) for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    size, target = dict(per_source), shares(per_source, weights, total, most)
    plan = []
    for s in size:
        whole = int(target[s] // size[s]) if size[s] else 0
        plan.append((s, size[s], float(target[s]), whole, float(target[s] - whole * size[s])))
    small = F.broadcast if len(plan) <= _BROADCAST_SOURCES else (lambda df: df)
    plan = spark.createDataFrame(plan, "source string, source_size long, target double, whole int, rest double")

    # prefix: the hash digits fixed so far; below: words of the buckets before it.
    bounds = plan.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("words"))
    for level in range(1, _DIGITS + 1):
        shift = (_DIGITS - level) * _BITS
        inside = (
            sized.alias("d")
            .join(small(bounds).alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.shiftright("d.hash", shift + _BITS) == F.col("b.prefix")))
            .groupBy("b.source", F.shiftright("d.hash", shift).alias("bucket"))
            .agg(F.sum("d.size").alias("words"), F.first("b.rest").alias("rest"), F.first("b.below").alias("below"))
        )
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        steps = inside.withColumn("below", F.col("below") + F.coalesce(F.sum("words").over(running), F.lit(0))).where("below <= rest")
        last = steps.groupBy("source").agg(F.max_by(F.struct("rest", F.col("bucket").alias("prefix"), "below", "words"), "bucket").alias("x"))
        bounds = scratch.table(last.select("source", "x.*"), "mix-bounds")
    limit = plan.alias("p").join(small(bounds).alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")), "left").select(
        "p.source", "p.source_size", "p.target", "p.whole", "t.prefix", F.least(F.lit(1.0), (F.col("t.rest") - F.col("t.below")) / F.nullif("t.words", F.lit(0))).alias("part")
    )
    # The last bucket is one hash value: its documents take the same part of themselves.
    more = F.when(F.col("whole") >= F.lit(most), 0.0).when(F.col("hash") < F.col("prefix"), 1.0).when(F.col("hash") == F.col("prefix"), F.coalesce("part", F.lit(0.0))).otherwise(0.0)
    return (
        sized.alias("d")
        .join(small(limit).alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("whole") + F.round(F.col("size") * more)).cast("long").alias("taken"), (F.col("whole") + F.round(more)).cast("int").alias("copies"))
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as :func:`mix` takes it as a whole.

    A document taken in part stays out or comes once more, whichever is nearer.  Rows that
    repeat an id are taken alike, so the decision is looked up once per id.  Nulls, empty
    texts and empty tables are treated as there; columns may have any names, as rows travel
    as one struct.
    """
    taken = mix(docs, id_col, text_col, source_col).groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies > 0")
    rows = docs.select(F.col(id_col).alias("at"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(taken, F.col("at").eqNullSafe(F.col("doc_id"))).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
