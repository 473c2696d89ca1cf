"""The corpus interface: every verb over all images of a folder at once, and SQL views."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, stamps
from ..operators import edits, search, tables
from ..sources import images as source
from ..sources.sinks import write_files


class Corpus:
    """Images and the tables decoded from them; all of them lazy."""

    def __init__(self, images: DataFrame):
        self.images = images

    @classmethod
    def scan(cls, spark: SparkSession, folder: str) -> "Corpus":
        return cls(source.scan(spark, folder))

    volumes = property(lambda self: tables.volumes(self.images))
    entries = property(lambda self: tables.entries(self.images))
    partitions = property(lambda self: tables.partitions(self.images))
    contents = property(lambda self: tables.contents(self.images))

    def register(self) -> None:
        """Temporary views ``images, volumes, entries, fat_entries, findings, stats`` for SQL."""
        views = {"images": self.images, "volumes": self.volumes, "entries": self.entries, "fat_entries": tables.fat_entries(self.images), "findings": tables.findings(self.images), "stats": tables.stats(self.images)}
        for name, table in views.items():
            table.createOrReplaceTempView(name)

    def list(self, path: str | None = None, recursive: bool = False, order: str = "name") -> DataFrame:
        """Name, size, attributes, cluster and date of a directory's entries, in every volume."""
        rows = search.ordered(search.listing(self.entries, path, recursive), order)
        return rows.select(
            "image_id", "volume_idx", "path", "user", F.col("full_name").alias("name"), F.col("file_size").alias("size"), names.attribute_string(F.col("attributes")).alias("attr"),
            F.col("first_cluster").alias("cluster"), "is_directory", stamps.stamp_text(F.coalesce("modify_date", F.lit(0)), F.coalesce("modify_time", F.lit(0))).alias("modified"),
        )

    def find(self, path: str, recursive: bool = False) -> DataFrame:
        return search.find(self.entries, path, recursive)

    def info(self, rollup: bool = False) -> DataFrame:
        if rollup:
            return tables.stats_rollup(self.images)
        return tables.stats(self.images).withColumn("used_share", F.when(F.col("total_clusters") > 0, F.col("used_clusters") / F.col("total_clusters")))

    def verify(self) -> DataFrame:
        """Findings of all volumes; see :meth:`valid` for a verdict an image."""
        return tables.findings(self.images)

    def valid(self) -> DataFrame:
        return tables.verify_summary(self.images, by_image=True)

    def extract(self, path: str, folder: str, recursive: bool = False) -> DataFrame:
        """Write the files that a path names below ``folder/image/volume``; one result a file."""
        wanted = self.find(path, recursive).where(~F.col("is_directory")).select("image_id", "volume_idx", "path", F.coalesce("user", F.lit(-1)).alias("u"))
        held = self.contents.where("error_code is null").withColumn("u", F.coalesce("user", F.lit(-1)))
        rows = held.join(wanted.distinct(), ["image_id", "volume_idx", "path", "u"])
        place = F.concat_ws("/", "image_id", F.col("volume_idx").cast("string"), F.when(F.col("u") >= 0, F.concat(F.lit("user"), F.col("u").cast("string"))), F.replace("path", F.lit("\\"), F.lit("/")))
        return write_files(rows.select(place.alias("relative"), "content"), folder)

    def edit(self, changes: DataFrame, now: datetime.datetime | None = None) -> DataFrame:
        """New contents of the images that a change-set names (see :func:`edits.apply`)."""
        return edits.apply(self.images, changes, now)

    def write(self, name: str, path: str, content: bytes, volume: int = 0) -> DataFrame:
        return self._one(name, volume, "write", path, None, content)

    def delete(self, name: str, path: str, volume: int = 0) -> DataFrame:
        return self._one(name, volume, "delete", path)

    def mkdir(self, name: str, path: str, volume: int = 0) -> DataFrame:
        return self._one(name, volume, "mkdir", path)

    def rmdir(self, name: str, path: str, recursive: bool = False, volume: int = 0) -> DataFrame:
        return self._one(name, volume, "rmdir", path, "recursive" if recursive else None)

    def attr(self, name: str, path: str, changes: list[str], volume: int = 0) -> DataFrame:
        return self._one(name, volume, "attr", path, " ".join(changes))

    def rename(self, name: str, path: str, new: str, volume: int = 0) -> DataFrame:
        return self._one(name, volume, "rename", path, new)

    def _one(self, name: str, volume: int, op: str, path: str, argument: str | None = None, content: bytes | None = None) -> DataFrame:
        schema = "image_id string, volume_idx int, seq int, op string, path string, argument string, content binary"
        change = self.images.sparkSession.createDataFrame([(name, volume, 0, op, path, argument, None if content is None else bytearray(content))], schema)
        return self.edit(change)


def import_changes(files: DataFrame, image_id: str, volume: int = 0, target: str = "") -> DataFrame:
    """The change-set that copies host files (:func:`..sources.images.host_files`) into a volume.

    Folders are made first, names are cut to 8.3 by the rule for trees.
    """
    base = "\\".join(x for x in target.upper().replace("/", "\\").split("\\") if x)
    cut = F.transform(F.split("relative", "/"), lambda x: names.truncated_name(x, "tree"))
    rows = files.select(F.concat(F.array(F.lit(base)) if base else F.array().cast("array<string>"), cut).alias("parts"), "content")
    none = F.lit(None)
    common = lambda seq, op, path, content: [F.lit(image_id).alias("image_id"), F.lit(volume).alias("volume_idx"), seq.cast("int").alias("seq"), F.lit(op).alias("op"), path.alias("path"), none.cast("string").alias("argument"), content.alias("content")]
    folders = rows.where(F.size("parts") > 1).select(F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("d"), "parts").select("d", F.array_join(F.slice("parts", F.lit(1), F.col("d")), "\\").alias("path")).distinct()
    made = folders.select(*common(F.col("d"), "mkdir", F.col("path"), none.cast("binary")))
    return made.unionByName(rows.select(*common(F.lit(1 << 20), "write", F.array_join("parts", "\\"), F.col("content"))))


def paste_changes(contents: DataFrame, image_id: str, volume: int = 0, target: str = "") -> DataFrame:
    """The change-set that copies files of images (rows of ``contents``) into a directory of a volume."""
    base = "\\".join([x for x in target.upper().replace("/", "\\").split("\\") if x] + [""])
    name = F.element_at(F.split("path", r"\\"), -1)
    rows = contents.where("content is not null")
    return rows.select(
        F.lit(image_id).alias("image_id"), F.lit(volume).alias("volume_idx"), F.lit(0).alias("seq"), F.lit("write").alias("op"), F.concat(F.lit(base), name).alias("path"),
        F.lit(None).cast("string").alias("argument"), "content",
    )


def reports(rows: DataFrame) -> DataFrame:
    """Rows as JSON documents, one a line, as the text sink writes them."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))
