"""JSON documents of the verbs, one a volume or image, built by native expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display, names
from ..operators import tables

_OK = F.lit("success")


def _gather(rows: DataFrame, keys: list[str], item) -> DataFrame:
    """Items of each group in the order of visits; a volume's entries are one bounded group."""
    ordered = F.array_sort(F.collect_list(F.struct("visit", item.alias("item"))))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda x: x["item"]).alias("files"))


def listing(entries: DataFrame) -> DataFrame:
    """``{status, path, files: [{name, size, attr, cluster, is_directory}]}`` of every directory."""
    rows = entries.where("full_name is not null and user is null")
    item = F.struct(F.col("full_name").alias("name"), F.col("file_size").alias("size"), names.attribute_string(F.col("attributes")).alias("attr"), F.col("first_cluster").alias("cluster"), "is_directory")
    found = _gather(rows, ["image_id", "volume_idx", "parent"], item)
    return found.select("image_id", "volume_idx", F.to_json(F.struct(_OK.alias("status"), F.col("parent").alias("path"), "files")).alias("value"))


def cpm_listing(entries: DataFrame) -> DataFrame:
    """``{status, path, files: [{user, name, size, is_read_only, is_system}]}`` of every CP/M volume."""
    rows = entries.where("user is not null")
    item = F.struct("user", F.col("full_name").alias("name"), F.col("file_size").alias("size"), (F.col("attributes").bitwiseAND(F.lit(1)) != 0).alias("is_read_only"), (F.col("attributes").bitwiseAND(F.lit(4)) != 0).alias("is_system"))
    found = _gather(rows, ["image_id", "volume_idx"], item)
    return found.select("image_id", "volume_idx", F.to_json(F.struct(_OK.alias("status"), F.lit("").alias("path"), "files")).alias("value"))


def partitions(images: DataFrame) -> DataFrame:
    """``{status, image, partitions: [{index, name, capacity, capacity_bytes, cluster_size, assignments}]}``."""
    item = F.struct("index", "name", "capacity", "capacity_bytes", "cluster_size", "assignments")
    found = tables.partitions(images).where("error_code is null").groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias("partitions"))
    return found.select("image_id", F.to_json(F.struct(_OK.alias("status"), F.col("image_id").alias("image"), "partitions")).alias("value"))


def verification(images: DataFrame) -> DataFrame:
    """``{status, valid, errors, warnings, files_checked, ...}`` of every image."""
    found = tables.findings(images)
    text = F.when(F.col("image_type") == "harddisk", F.concat(F.lit("Partition "), F.col("volume_idx").cast("string"), F.lit(": "), F.col("message"))).otherwise(F.col("message"))
    own = found.join(images.select("image_id", "image_type"), "image_id").withColumn("text", text)
    pick = lambda kind: F.transform(F.array_sort(F.filter(F.collect_list(F.when(F.col("severity") == kind, F.struct("volume_idx", "seq", "text"))), lambda x: x.isNotNull())), lambda x: x["text"])
    lists = own.groupBy("image_id").agg(pick("error").alias("errors"), pick("warning").alias("warnings"))
    counts = tables.verify_summary(images, by_image=True).drop("errors", "warnings")
    none = F.array().cast("array<string>")
    rows = counts.join(lists, "image_id", "left")
    return rows.select("image_id", F.to_json(F.struct(_OK.alias("status"), "valid", F.coalesce("errors", none).alias("errors"), F.coalesce("warnings", none).alias("warnings"), "files_checked", "directories_checked", "lost_clusters", "bad_clusters")).alias("value"))


def information(images: DataFrame) -> DataFrame:
    """Space and counts of every volume as a document, sizes in words too."""
    rows = tables.stats(images).where("error_code is null")
    words = [display.size_text(F.col(f"{x}_bytes")).alias(f"{x}_formatted") for x in ("total", "free", "used")]
    kind = F.when(F.col("kind") == "harddisk", "Victor 9000 Hard Disk Partition").otherwise(display.type_label(F.col("kind")))
    columns = ["cluster_size", "total_clusters", "free_clusters", "used_clusters", "bad_clusters", "total_bytes", "free_bytes", "used_bytes"]
    return rows.select("image_id", "volume_idx", F.to_json(F.struct(kind.alias("type"), F.col("fs").alias("filesystem"), *columns, *words, display.percent(F.col("used_clusters"), F.col("total_clusters")).alias("percent_used"), F.col("files").alias("file_count"), F.col("directories").alias("directory_count"), "file_bytes")).alias("value"))
