"""Tables written to the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it back, so
a lost executor never loses an intermediate result.  Only where that setting is absent
*and* the session is local (tests) is a temporary folder taken instead.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="diskloom-")
    return _LOCAL_FALLBACK[app]


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the list of written tables, for :func:`release`."""
    return len(_WRITTEN)


def release(spark: SparkSession, start: int, end: int) -> None:
    """Delete the tables written from mark ``start`` up to mark ``end``.

    Call it only once everything that reads them lazily has been written elsewhere.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _WRITTEN[start:end]
    del _WRITTEN[start:end]
    for path in gone:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def width(spark: SparkSession, least: int = 16) -> int:
    """Number of salts or buckets that follows the session's shuffle width."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
