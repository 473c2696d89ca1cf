"""Edits as change-sets: a table of operations makes new images, old ones never change.

Operations of one image run in the order of ``seq``.  Each is checked before it changes a
byte; one that fails leaves the image as the ones before it made it, and is reported.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .kernel import Problem

#: Operations: what ``path``, ``argument`` and ``content`` mean is said at :func:`apply`.
OPERATIONS = ("write", "delete", "mkdir", "rmdir", "attr", "rename")
_RESULT = "array<struct<seq:int,op:string,path:string,error_code:string,error_message:string>>"


def packed_now(now: datetime.datetime) -> tuple[int, int]:
    """Date and time as directory entries store them."""
    return (now.year - 1980) << 9 | now.month << 5 | now.day, now.hour << 11 | now.minute << 5 | now.second // 2


def one(volume: object, edit: dict, date: int, time: int) -> None:
    """Apply one operation to a volume."""
    op, path = edit["op"], kernel.parts_of(edit["path"])
    if isinstance(volume, kernel.CpmVolume):
        if not path:
            raise Problem("invalid_filename", "No path given")
        if op == "write":
            return volume.write_file(path[-1], edit["content"] or b"", int(edit["argument"] or 0))
        if op == "delete":
            return volume.delete_file(path[-1], int(edit["argument"]) if edit["argument"] else None)
        raise Problem("unsupported", f"CP/M volumes have no {op}")
    if op == "write":
        return volume.write_file(path, edit["content"] or b"", date, time)
    if op == "delete":
        return volume.delete_file(path)
    if op == "mkdir":
        return volume.make_directory(path, date, time)
    if op == "rmdir":
        return volume.remove_directory(path, (edit["argument"] or "").lower() == "recursive")
    if op == "attr":
        return volume.change_attributes(path, (edit["argument"] or "").split())
    if op == "rename":
        return volume.rename(path, edit["argument"] or "")
    raise Problem("unsupported", f"Unknown operation: {op}")


def apply(images: DataFrame, edits: DataFrame, now: datetime.datetime | None = None) -> DataFrame:
    """New contents of the images that ``edits`` names: ``image_id, image_type, content, results``.

    ``edits`` has ``image_id, volume_idx, seq, op, path, argument, content``: ``write`` puts
    ``content`` (argument: the CP/M user), ``attr`` takes changes parted by spaces, ``rename``
    a new name, ``rmdir`` the word ``recursive``.  ``results`` has a row an operation.
    """
    date, time = packed_now(now or datetime.datetime.now())
    fields = F.struct("seq", "volume_idx", "op", "path", "argument", F.col("content").alias("data"))
    grouped = edits.groupBy("image_id").agg(F.array_sort(F.collect_list(fields)).alias("edits"))
    schema = f"image_id string, image_type string, content binary, results {_RESULT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, done, found = bytearray(row["content"] or b""), [], None
                for edit in row["edits"]:
                    error = None
                    before = bytes(data) if edit["op"] == "rmdir" else None  # the one step that can fail half done
                    try:
                        # Opened once; again only after a step that failed, as the others check before
                        # they change a byte, but what they were about to link is not kept.
                        found = found or kernel.volumes(data, row["image_type"])
                        index = edit["volume_idx"] or 0
                        if not 0 <= index < len(found):
                            raise Problem("invalid_partition", f"No partition {index}")
                        one(found[index], edit | {"content": edit["data"]}, date, time)
                    except Problem as problem:
                        error, found = problem, None
                        if before is not None:
                            data[:] = before
                    done.append({"seq": edit["seq"], "op": edit["op"], "path": edit["path"], "error_code": getattr(error, "code", None), "error_message": str(error) if error else None})
                yield pa.RecordBatch.from_pylist([{"image_id": row["image_id"], "image_type": row["image_type"], "content": bytes(data), "results": done}], schema=_ARROW)

    return images.join(grouped, "image_id").select("image_id", "image_type", "content", "edits").mapInArrow(run, schema)


_ARROW = pa.schema([
    ("image_id", pa.string()), ("image_type", pa.string()), ("content", pa.binary()),
    ("results", pa.list_(pa.struct([("seq", pa.int32()), ("op", pa.string()), ("path", pa.string()), ("error_code", pa.string()), ("error_message", pa.string())]))),
])


def blank_images(spark: SparkSession, wanted: list[tuple[str, str, str, str | None]]) -> DataFrame:
    """New empty images: ``(image_id, family, variant, label)`` each."""
    rows = [(name, bytearray(kernel.blank(family, variant, label))) for name, family, variant, label in wanted]
    return spark.createDataFrame(rows, "image_id string, content binary")


def formats(spark: SparkSession) -> DataFrame:
    """The formats that can be created."""
    return spark.createDataFrame(kernel.FORMATS, "family string, variant string, description string, capacity string, clusters int")
