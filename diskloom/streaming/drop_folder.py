"""Tables over a folder that images keep arriving in.

An extension: images are typed, unpacked and decoded as they come, by the operators of the
batch side.  Each image is one row of one batch, so no state or watermark is needed; the
checkpoint of the query keeps track of files already seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.chd import unpack
from ..sources.images import typed

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def images(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of typed images; whole files only, so move them into the folder."""
    files = spark.readStream.format("binaryFile").schema(_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return unpack(typed(files.where(r"lower(path) rlike '\\.(img|ima|dsk|chd)$'").select("path", "length", "content")))


def keep(stream: DataFrame, table: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write a table (such as ``tables.findings``) of all images that arrive to Parquet."""
    writer = table(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
