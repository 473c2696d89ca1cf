"""Cluster chains of tables that are DataFrames, and relational integrity rules over them.

A table has at most 4,096 entries, so the entries of one volume are one small group:
chains are followed inside it by arrays.  Volumes spread over the cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .kernel import BAD, CHAIN_FIRST, CHAIN_LAST, FREE


def follow(table: DataFrame, starts: DataFrame, volume: str = "volume") -> DataFrame:
    """``volume, id, pos, cluster, circular`` of the chains from ``starts`` (``volume, id, start``).

    ``table`` has ``volume, cluster, next``.  A chain goes on while its cluster lies in 002
    to FEF and ends silently at any other value; clusters without a row count as free.  One
    that meets itself is cut there and marked circular.  A start below 2 gives no row.  Table
    rows above FEF, which no volume of the format has, are an error.
    """
    kind = dict(table.dtypes)[volume]
    key = dict(starts.dtypes)["id"]
    schema = f"{volume} {kind}, id {key}, pos int, cluster int, circular boolean"

    def run(own: pa.Table, heads: pa.Table) -> pa.Table:
        following = np.zeros(CHAIN_LAST + 1, np.int64)
        cluster = own.column("cluster").to_numpy()
        if len(cluster) and int(cluster.max()) > CHAIN_LAST + 1:
            raise ValueError(f"a volume has cluster {int(cluster.max())}, the format ends at {CHAIN_LAST}")
        held = (cluster >= 0) & (cluster <= CHAIN_LAST)
        following[cluster[held]] = own.column("next").to_numpy()[held]
        ids, pos, clusters, circular = [], [], [], []
        names, starts_ = heads.column("id").to_pylist(), heads.column("start").to_pylist()
        for name, at in zip(names, starts_):
            seen: dict[int, None] = {}
            at = at or 0
            while CHAIN_FIRST <= at <= CHAIN_LAST and at not in seen:
                seen[at] = None
                at = int(following[at])
            ids += [name] * len(seen)
            pos += range(len(seen))
            clusters += seen
            circular += [at in seen] * len(seen)
        where = heads.column("of")[0].as_py() if heads.num_rows else own.column(volume)[0].as_py()
        field = heads.schema.field("id").type
        return pa.table({volume: pa.array([where] * len(ids), own.schema.field(volume).type), "id": pa.array(ids, field), "pos": pa.array(pos, pa.int32()), "cluster": pa.array(clusters, pa.int32()), "circular": pa.array(circular, pa.bool_())})

    left = table.select(volume, F.col("cluster").cast("int"), F.col("next").cast("int")).groupBy(volume)
    # New names, as both sides may come from one table.
    right = starts.select(F.col(volume).alias("of"), F.col("id").alias("id"), F.col("start").cast("int").alias("start")).groupBy("of")
    return left.cogroup(right).applyInArrow(run, schema)


def usage(table: DataFrame, volume: str = "volume") -> DataFrame:
    """Free, bad and used clusters of each volume."""
    count = lambda x, name: F.count_if(x).alias(name)
    rows = table.where("cluster >= 2")
    return rows.groupBy(volume).agg(count(F.col("next") == FREE, "free"), count(F.col("next") == BAD, "bad"), count(~F.col("next").isin(FREE, BAD), "used"))


def cross_linked(owned: DataFrame, volume: str = "volume") -> DataFrame:
    """Clusters with two owners or more: ``volume, cluster, owners`` (in order of id)."""
    return owned.groupBy(volume, "cluster").agg(F.array_sort(F.collect_list("id")).alias("owners")).where(F.size("owners") > 1)


def lost(table: DataFrame, owned: DataFrame, volume: str = "volume") -> DataFrame:
    """Allocated clusters that no owner reaches."""
    rows = table.where((F.col("cluster") >= 2) & ~F.col("next").isin(FREE, BAD))
    return rows.join(owned.select(volume, "cluster"), [volume, "cluster"], "left_anti")


def allocate(free: DataFrame, count: int, volume: str = "volume") -> DataFrame:
    """The lowest ``count`` free clusters of each volume linked to a chain; none if too few."""
    order = Window.partitionBy(volume).orderBy("cluster")
    ranked = free.withColumns({"pos": F.row_number().over(order) - 1, "total": F.count(F.lit(1)).over(Window.partitionBy(volume))}).where((F.col("pos") < count) & (F.col("total") >= count))
    return ranked.select(volume, "pos", "cluster", F.lead("cluster", 1, 4095).over(order).alias("next"))
