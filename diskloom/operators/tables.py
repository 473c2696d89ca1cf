"""Tables over a corpus of images: volumes, entries, chains, contents, findings.

Each is one pass over the images without a shuffle: an image is a row, decoded by
:mod:`.kernel`.  A damaged image becomes rows with ``error_code`` and ``error_message``
and never fails the job.  Null contents count as images of no bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import binary, names
from . import kernel
from .kernel import Problem

_ROWS = 2048
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<struct<device_unit:int,volume_index:int>>": pa.list_(pa.struct([("device_unit", pa.int32()), ("volume_index", pa.int32())]))}


def _per_volume(images: DataFrame, schema: str, decode: Callable[[object], Iterator[dict]]) -> DataFrame:
    """Rows that ``decode`` makes of each volume, with ``image_id`` and ``volume_idx``."""
    schema = f"image_id string, volume_idx int, {schema}, error_code string, error_message string"
    fields = [x.strip().split(" ", 1) for x in schema.split(", ")]
    arrow = pa.schema([(name, _KINDS[kind]) for name, kind in fields])

    def rows(image: dict) -> Iterator[dict]:
        own = {"image_id": image["image_id"], "volume_idx": 0}
        try:
            found = kernel.volumes(image["content"] or b"", image["image_type"])
        except Problem as problem:
            yield own | {"error_code": problem.code, "error_message": str(problem)}
            return
        for own["volume_idx"], volume in enumerate(found):
            try:
                for row in decode(volume):
                    yield own | row
            except Problem as problem:
                yield own | {"error_code": problem.code, "error_message": str(problem)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for image in batch.to_pylist():
                for row in rows(image):
                    held.append({name: row.get(name) for name, _ in fields})
                    size += len(row.get("content") or b"")
                    if len(held) >= _ROWS or size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return images.select("image_id", "image_type", "content").mapInArrow(run, schema)


def volumes(images: DataFrame) -> DataFrame:
    """One row a volume: geometry, label, drive assignments."""

    def decode(v: object) -> Iterator[dict]:
        row = {"fs": v.filesystem, "kind": v.kind, "name": v.name}
        if isinstance(v, kernel.FatVolume):
            row |= {x: getattr(v, x) for x in ("fat_start", "fat_sectors", "fat_copies", "dir_start", "dir_sectors", "data_start", "sectors_per_cluster", "cluster_size", "total_clusters", "label_index", "capacity")}
            row |= {"label": v.label(), "assignments": [{"device_unit": a, "volume_index": b} for a, b in v.assignments]}
        else:
            row |= {"dir_start": v.directory_sector, "dir_sectors": kernel.CPM_DIRECTORY_SECTORS, "data_start": kernel.CPM_DATA, "cluster_size": kernel.CPM_BLOCK, "total_clusters": kernel.CPM_BLOCKS}
        yield row

    schema = "fs string, kind string, name string, label string, label_index int, capacity long, fat_start long, fat_sectors int, fat_copies int, dir_start long, dir_sectors int, data_start long, sectors_per_cluster int, cluster_size int, total_clusters int, assignments array<struct<device_unit:int,volume_index:int>>"
    return _per_volume(images, schema, decode)


_ENTRY = "user int, path string, parent string, depth int, visit int, ordinal int, name string, extension string, full_name string, attributes int, is_directory boolean, first_cluster int, file_size long, create_date int, create_time int, modify_date int, modify_time int"


def _entry_rows(v: object) -> Iterator[tuple[dict, object]]:
    if isinstance(v, kernel.CpmVolume):
        for visit, f in enumerate(v.files()):
            first = f.extents[0]
            attributes = kernel.READ_ONLY * first.flags[0] | kernel.SYSTEM * first.flags[1] | kernel.ARCHIVE * first.flags[2]
            yield {"user": f.user, "path": f.full_name, "parent": "", "depth": 0, "visit": visit, "ordinal": visit, "name": f.name, "extension": f.extension, "full_name": f.full_name, "attributes": attributes, "is_directory": False, "file_size": f.file_size}, f
        return
    for visit, (path, parent, depth, e, problem) in enumerate(v.walk()):
        row = {"path": path, "parent": parent, "depth": depth, "visit": visit}
        if problem is not None:
            row |= {"error_code": problem.code, "error_message": str(problem)}
        if e is not None:
            row |= {x: getattr(e, x) for x in ("ordinal", "name", "extension", "full_name", "attributes", "is_directory", "first_cluster", "file_size", "create_date", "create_time", "modify_date", "modify_time")}
        yield row, e


def entries(images: DataFrame) -> DataFrame:
    """The directory tree: one row an entry, in the order of visits; cycles are reported once."""
    return _per_volume(images, _ENTRY, lambda v: (row for row, _ in _entry_rows(v)))


def contents(images: DataFrame) -> DataFrame:
    """``path, user, file_size, content`` of every file, read back through its chain or extents."""

    def decode(v: object) -> Iterator[dict]:
        for row, e in _entry_rows(v):
            if e is not None and not row["is_directory"]:
                out = {x: row.get(x) for x in ("path", "user", "file_size")}
                try:
                    out["content"] = v.read(e)
                except Problem as problem:
                    out |= {"error_code": problem.code, "error_message": str(problem)}
                yield out

    return _per_volume(images, "path string, user int, file_size long, content binary", decode)


def fat_entries(images: DataFrame) -> DataFrame:
    """``cluster, next`` of every cluster of FAT volumes, numbers 0 and 1 included."""

    def decode(v: object) -> Iterator[dict]:
        if isinstance(v, kernel.FatVolume):
            yield from ({"cluster": c, "next": v.entry(c)} for c in range(v.total_clusters + 2))

    return _per_volume(images, "cluster int, next int", decode)


def stats(images: DataFrame) -> DataFrame:
    """Space and counts of every volume; bytes are clusters times their size."""

    def decode(v: object) -> Iterator[dict]:
        rows = [row for row, e in _entry_rows(v) if e is not None]
        files = [r for r in rows if not r["is_directory"]]
        row = {"fs": v.filesystem, "kind": v.kind, "name": v.name, "files": len(files), "directories": len(rows) - len(files), "file_bytes": sum(r["file_size"] for r in files)}
        if isinstance(v, kernel.FatVolume):
            free, bad, used = v.usage()
            row |= {"cluster_size": v.cluster_size, "total_clusters": v.total_clusters, "physical_clusters": max(0, min(v.total_clusters, (len(v.data) // kernel.SECTOR - v.data_start) // v.sectors_per_cluster)), "free_clusters": free, "bad_clusters": bad, "used_clusters": used}
        yield row

    found = _per_volume(images, "fs string, kind string, name string, files int, directories int, file_bytes long, cluster_size int, total_clusters int, physical_clusters int, free_clusters int, bad_clusters int, used_clusters int", decode)
    size = F.col("cluster_size").cast("long")
    return found.withColumns({x: F.col(f"{x}_clusters") * size for x in ("total", "free", "used")}).withColumnsRenamed({x: f"{x}_bytes" for x in ("total", "free", "used")})


def stats_rollup(images: DataFrame) -> DataFrame:
    """:func:`stats` summed by volume and by image (``volume_idx`` null)."""
    sums = ("files", "directories", "total_clusters", "free_clusters", "used_clusters", "bad_clusters", "total_bytes", "free_bytes", "used_bytes")
    return (
        stats(images).where("error_code is null").groupBy("image_id", F.col("volume_idx"))
        .agg(*(F.sum(c).cast("long").alias(c) for c in sums))
        .rollup("image_id", "volume_idx").agg(*(F.sum(c).alias(c) for c in sums)).where("image_id is not null")
    )


def findings(images: DataFrame) -> DataFrame:
    """Integrity findings in the order they are made: ``seq, severity, code, path, cluster, message``."""

    def decode(v: object) -> Iterator[dict]:
        for seq, x in enumerate(v.verify()[0]):
            yield dict(zip(("severity", "code", "path", "cluster", "message"), x)) | {"seq": seq}

    found = _per_volume(images, "seq int, severity string, code string, path string, cluster int, message string", decode)
    bad = F.col("error_code").isNotNull()
    return found.withColumns({"severity": F.when(bad, "error").otherwise(F.col("severity")), "code": F.when(bad, F.when(F.col("error_code") == "unknown_type", "V14").otherwise("V3")).otherwise(F.col("code")), "message": F.coalesce("message", "error_message")})


def verify_summary(images: DataFrame, by_image: bool = False) -> DataFrame:
    """Counters and validity of every volume, or of every image."""

    def decode(v: object) -> Iterator[dict]:
        found, counts = v.verify()
        yield counts | {"errors": sum(x[0] == "error" for x in found), "warnings": sum(x[0] == "warning" for x in found)}

    names_ = ("files_checked", "directories_checked", "clusters_in_use", "lost_clusters", "bad_clusters", "cross_linked", "errors", "warnings")
    found = _per_volume(images, ", ".join(f"{x} int" for x in names_), decode)
    found = found.withColumn("errors", F.when(F.col("error_code").isNotNull(), 1).otherwise(F.col("errors")))
    if by_image:
        found = found.groupBy("image_id").agg(*(F.sum(x).cast("long").alias(x) for x in names_))
    return found.withColumn("valid", F.coalesce(F.col("errors"), F.lit(0)) == 0)


def cpm_extents(images: DataFrame) -> DataFrame:
    """CP/M directory entries: ``user, name, extension, extent, records, blocks`` and flags."""

    def decode(v: object) -> Iterator[dict]:
        if isinstance(v, kernel.CpmVolume):
            for x in v.extents():
                yield {"user": x.user, "name": x.name, "extension": x.extension, "extent": x.number, "records": x.records, "blocks": x.blocks, "read_only": x.flags[0], "system": x.flags[1], "archive": x.flags[2]}

    return _per_volume(images, "user int, name string, extension string, extent int, records int, blocks array<int>, read_only boolean, system boolean, archive boolean", decode)


def partitions(images: DataFrame) -> DataFrame:
    """Partitions of hard disks with their drive letters in order of assignment."""
    found = volumes(images.where("image_type = 'harddisk'"))
    return found.select("image_id", F.col("volume_idx").alias("index"), "label_index", "name", "capacity", (F.col("capacity") * 512).alias("capacity_bytes"), "cluster_size", "assignments", drive_letters(F.col("assignments")).alias("letters"), "error_code", "error_message")


def drive_letters(assignments: Column) -> Column:
    """Letters of a list of assignments: floppies by unit, hard disks C:, D:, ... in order."""
    start = F.struct(F.array().cast("array<string>").alias("letters"), F.lit(0).alias("hard"))

    def step(now: Column, x: Column) -> Column:
        floppy = F.shiftright(x["device_unit"], 8).bitwiseAND(F.lit(255)) == 255
        low = x["device_unit"].bitwiseAND(F.lit(255))
        letter = F.when(floppy, F.when(low < 26, F.char(low + 65)).otherwise(F.concat(F.lit("Floppy"), low.cast("string")))).otherwise(F.char(now["hard"] + 67))
        return F.struct(F.concat(now["letters"], F.array(F.concat(letter, F.lit(":")))).alias("letters"), (now["hard"] + F.when(floppy, 0).otherwise(1)).alias("hard"))

    return F.aggregate(assignments, start, step, lambda x: x["letters"])


# ---- the same tables by native expressions, for root directories and tables ---------------


def native_fat_entries(images: DataFrame, geometry: DataFrame) -> DataFrame:
    """``cluster, next`` decoded on the JVM from the images' bytes and their geometry."""
    own = geometry.where("fs = 'FAT12'").select("image_id", "volume_idx", "fat_start", "fat_sectors", "total_clusters")
    table = F.substring("content", (F.col("fat_start") * 512 + 1).cast("int"), (F.col("fat_sectors") * 512).cast("int"))
    return (
        images.join(own, "image_id").select("image_id", "volume_idx", table.alias("fat"), F.explode(F.sequence(F.lit(0), F.col("total_clusters") + 1)).alias("cluster"))
        .select("image_id", "volume_idx", "cluster", binary.fat12(F.col("fat"), F.col("cluster")).cast("int").alias("next"))
    )


def root_slots(images: DataFrame, geometry: DataFrame) -> DataFrame:
    """Live entries of root directories, decoded on the JVM: slots before the first end mark."""
    own = geometry.where("fs = 'FAT12'").select("image_id", "volume_idx", "dir_start", "dir_sectors")
    at = (F.col("dir_start") * 512 + F.col("slot") * 32 + 1).cast("int")
    slots = images.join(own, "image_id").select("image_id", "volume_idx", "content", "dir_start", F.explode(F.sequence(F.lit(0), F.col("dir_sectors") * 16 - 1)).alias("slot"))
    raw = slots.select("image_id", "volume_idx", "slot", F.rpad(F.substring("content", at, F.lit(32)), 32, F.lit(bytearray(1))).alias("raw"))
    raw = raw.withColumn("mark", binary.u8(F.col("raw"), 0)).withColumn("attributes", binary.u8(F.col("raw"), 11))
    before = Window.partitionBy("image_id", "volume_idx").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    live = raw.withColumn("ends", F.sum(F.when(F.col("mark") == 0, 1).otherwise(0)).over(before)).where("ends = 0 and mark <> 229 and attributes & 8 = 0")
    text = lambda a, n: binary.latin1(F.substring("raw", a, F.lit(n)))
    return live.select(
        "image_id", "volume_idx", F.col("slot").alias("ordinal"), text(1, 8).alias("name"), text(9, 3).alias("extension"), names.full_name(text(1, 8), text(9, 3)).alias("full_name"),
        "attributes", binary.u16(F.col("raw"), 26).alias("first_cluster"), binary.u32(F.col("raw"), 28).alias("file_size"), binary.u16(F.col("raw"), 24).alias("modify_date"), binary.u16(F.col("raw"), 22).alias("modify_time"),
    )
