"""Writing extracted files and images to a folder that all executors share."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``relative, content`` below a mounted folder; returns ``relative, n_bytes, error``.

    The folder must be one that every executor sees.  Each file is written beside its
    place and renamed, so a lost task leaves no half file and its repeat is the same.
    Paths that lead out of the folder are refused.
    """
    root = os.path.abspath(folder.removeprefix("file://"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                place = os.path.normpath(os.path.join(root, row["relative"].replace("\\", "/").lstrip("/")))
                error = None
                if not place.startswith(root + os.sep):
                    error = "path leads out of the folder"
                else:
                    try:
                        os.makedirs(os.path.dirname(place), exist_ok=True)
                        part = f"{place}.{os.getpid()}.part"
                        with open(part, "wb") as file:
                            file.write(row["content"] or b"")
                        os.replace(part, place)
                    except OSError as failure:
                        error = str(failure)
                done.append({"relative": row["relative"], "n_bytes": len(row["content"] or b""), "error": error})
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("relative", pa.string()), ("n_bytes", pa.int64()), ("error", pa.string())]))

    return rows.select(F.col("relative"), F.col("content")).mapInArrow(run, "relative string, n_bytes long, error string")
