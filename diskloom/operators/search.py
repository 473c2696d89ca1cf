"""Listings, path look-ups and wildcard searches over the table of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import display, names, stamps
from .kernel import parts_of


def listing(entries: DataFrame, path: str | None = None, recursive: bool = False) -> DataFrame:
    """Entries of a directory (None: the root), or of all below it; a file lists itself."""
    wanted = "\\".join(parts_of(path))
    live = entries.where("full_name is not null")
    if recursive:
        return live if not wanted else live.where((F.upper("path") == wanted) & ~F.col("is_directory") | F.upper("parent").startswith(wanted + "\\") | (F.upper("parent") == wanted))
    return live.where((F.upper("parent") == wanted) | ((F.upper("path") == wanted) & ~F.col("is_directory")) if wanted else F.col("depth") == 0)


def resolve(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """The first entry of each volume that each path names: ``paths`` has ``image_id, volume_idx, path``."""
    wanted = paths.select("image_id", "volume_idx", F.col("path").alias("asked"), F.array_join(names.path_parts(F.col("path")), "\\").alias("key"))
    found = entries.where("full_name is not null").withColumn("key", F.upper("path"))
    first = Window.partitionBy("image_id", "volume_idx", "key").orderBy("visit")
    return wanted.join(found.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth"), ["image_id", "volume_idx", "key"], "left").drop("key")


def find(entries: DataFrame, path: str, recursive: bool = False) -> DataFrame:
    """Entries that a path with wildcards in its last component names, with ``relative``.

    Without recursion: files of the directory that match.  With it: matching files at any
    depth below the directory, and every directory there.  A path without wildcards names a
    file; recursively, everything below it.  CP/M volumes have one directory and no depth.
    """
    parts = parts_of(path)
    live = entries.where("full_name is not null")
    if not parts:
        return live.where(F.lit(False)).withColumn("relative", F.col("full_name"))
    wild = any(c in parts[-1] for c in "*?")
    cpm = F.col("user").isNotNull()
    match = names.matches(F.col("full_name"), parts[-1])
    if not wild and not recursive:
        fat = (F.upper("path") == "\\".join(parts)) & ~F.col("is_directory")
        return live.where(F.when(cpm, match).otherwise(fat)).withColumn("relative", F.col("full_name"))
    base, pattern = (parts[:-1], parts[-1]) if wild else (parts, "*.*")
    prefix = "\\".join(base)
    hit = names.glob(F.col("full_name"), pattern)
    if recursive:
        below = F.upper("path").startswith(prefix + "\\") if prefix else F.lit(True)
        fat, relative = below & (F.col("is_directory") | hit), F.expr(f"substring(path, {len(prefix) + 2 if prefix else 1})")
    else:
        fat, relative = (F.upper(F.coalesce("parent", F.lit(""))) == prefix) & ~F.col("is_directory") & hit, F.col("full_name")
    return live.where(F.when(cpm, match).otherwise(fat)).withColumn("relative", F.when(cpm, F.col("full_name")).otherwise(relative))


def ordered(entries: DataFrame, column: str = "name", ascending: bool = True) -> DataFrame:
    """Directories first, then by name, extension, size, date or attributes; ties as stored."""
    key = {
        "name": F.lower(names.strip_right(F.col("name"))), "extension": F.lower(names.strip_right(F.col("extension"))),
        "size": F.when(F.col("is_directory"), F.lit(-1)).otherwise(F.col("file_size")), "date": stamps.sort_key(F.col("modify_date"), F.col("modify_time")), "attributes": F.col("attributes"),
    }[column]
    return entries.orderBy(F.col("is_directory").desc(), key.asc() if ascending else key.desc(), F.col("visit").asc())


def totals(entries: DataFrame) -> DataFrame:
    """Entries (directories too) and bytes (of files only) of every volume."""
    return entries.where("full_name is not null").groupBy("image_id", "volume_idx").agg(
        F.count(F.lit(1)).alias("n_entries"), F.sum(F.when(F.col("is_directory"), F.lit(0)).otherwise(F.col("file_size"))).cast("long").alias("n_bytes")
    )


def selection(entries: DataFrame, chosen: DataFrame) -> DataFrame:
    """What a selection in a listing amounts to: ``n_selected, n_bytes, n_entries, summary`` of every volume.

    ``chosen`` has ``image_id, volume_idx, path``; directories count with their stored size.
    """
    rows = entries.where("full_name is not null").select("image_id", "volume_idx", F.upper("path").alias("key"), "file_size")
    keys = chosen.select("image_id", "volume_idx", F.array_join(names.path_parts(F.col("path")), "\\").alias("key"), F.lit(True).alias("picked")).distinct()
    sums = rows.join(keys, ["image_id", "volume_idx", "key"], "left").groupBy("image_id", "volume_idx").agg(
        F.count_if("picked").alias("n_selected"), F.coalesce(F.sum(F.when(F.col("picked"), F.col("file_size"))), F.lit(0)).cast("long").alias("n_bytes"), F.count(F.lit(1)).alias("n_entries")
    )
    size = F.when(F.col("n_bytes") > 0, F.concat(F.lit(" ("), display.size_text(F.col("n_bytes"), "status"), F.lit(")"))).otherwise("")
    picked = F.when(F.col("n_selected") > 0, F.concat(F.col("n_selected").cast("string"), F.lit(" selected"), size, F.lit(" | "))).otherwise("")
    return sums.withColumn("summary", F.concat(picked, F.col("n_entries").cast("string"), F.lit(" items")))


def lookup(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """:func:`resolve` for one entry each, where the root, which has no entry, is a directory without a name."""
    found = resolve(entries, paths)
    root = F.size(names.path_parts(F.col("asked"))) == 0
    return found.withColumns({"is_directory": F.when(root, True).otherwise(F.col("is_directory")), "full_name": F.when(root, "").otherwise(F.col("full_name")), "path": F.when(root, "").otherwise(F.col("path"))})


def first_rows(rows: DataFrame, most: int, by: list[str], order: list[str]) -> DataFrame:
    """The first ``most`` rows of each group, with the number of rows left out as ``more``."""
    window = Window.partitionBy(*by)
    return rows.withColumn("__n", F.row_number().over(window.orderBy(*order))).withColumn("more", F.greatest(F.count(F.lit(1)).over(window) - most, F.lit(0))).where(F.col("__n") <= most).drop("__n")


def existing(entries: DataFrame, incoming: DataFrame) -> DataFrame:
    """Names of ``incoming`` (``image_id, volume_idx, path``) that are there already."""
    have = entries.select("image_id", "volume_idx", F.upper("path").alias("__key"))
    rows = incoming.withColumn("__key", F.array_join(names.path_parts(F.col("path")), "\\"))
    return rows.join(have, ["image_id", "volume_idx", "__key"], "left_semi").drop("__key")
