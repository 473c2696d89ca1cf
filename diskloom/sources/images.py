"""Reading disk images: one row an image, its type found from its bytes by native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import sector, u8, u16

#: Files above this many bytes are hard disks.
FLOPPY_LIMIT = 2 * 1024 * 1024
CHD_MAGIC = b"MComprHD"
_PATTERNS = ("*.img", "*.ima", "*.dsk", "*.chd")


def is_chd(content: Column) -> Column:
    return F.substring(content, 1, 8) == F.lit(bytearray(CHD_MAGIC))


def _cpm_at(content: Column, place: int) -> Column:
    """At least two of the first four slots look like CP/M entries."""

    def fits(i: Column) -> Column:
        at = i * 32 + place * 512
        user = u8(content, at)
        name = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: u8(content, at + j).bitwiseAND(F.lit(127)))
        return ((user <= 15) | (user == 0xE5)) & F.forall(name, lambda b: (b >= 32) & (b < 127))

    whole = F.octet_length(content) >= (place + 1) * 512
    return whole & (F.size(F.filter(F.sequence(F.lit(0), F.lit(3)), fits)) >= 2)


def cpm_directory_sector(content: Column) -> Column:
    """Where a CP/M directory begins (sector 76, 94 or 1), null if nowhere."""
    return F.coalesce(*(F.when(_cpm_at(content, place), place) for place in (76, 94, 1)))


def is_ibm(boot: Column) -> Column:
    """Boot signature, jump and a plausible parameter block of an IBM floppy."""
    return (
        (u16(boot, 0x1FE) == 0xAA55) & u8(boot, 0).isin(0xEB, 0xE9) & (u16(boot, 0x0B) == 512) & u8(boot, 0x0D).isin(1, 2, 4, 8)
        & (u16(boot, 0x0E) >= 1) & u8(boot, 0x10).isin(1, 2) & (u8(boot, 0x15) >= 0xF0)
    )


def image_type(content: Column, length: Column) -> Column:
    """``harddisk``, ``floppy``, ``ibmpc`` or ``cpm``, by the first rule that holds."""
    boot = sector(content, 0)
    return (
        F.when(content.isNull(), "floppy")
        .when(is_chd(content) | (length > FLOPPY_LIMIT), "harddisk")
        .when(length < 512, "floppy")
        .when(is_ibm(boot), "ibmpc")
        .when((u16(boot, 0) == 1) & (u16(boot, 2) == 1), "harddisk")
        .when(u8(boot, 0).isin(0xFF, 0xE5, 0x00) & cpm_directory_sector(content).isNotNull(), "cpm")
        .otherwise("floppy")
    )


def typed(files: DataFrame) -> DataFrame:
    """``image_id, path, length, image_type, content`` of rows with ``path, length, content``."""
    return files.select(
        F.regexp_extract("path", r"([^/\\]+)$", 1).alias("image_id"), "path", F.col("length").cast("long").alias("length"),
        image_type(F.col("content"), F.col("length")).alias("image_type"), "content",
    )


def scan(spark: SparkSession, folder: str, patterns: tuple[str, ...] = _PATTERNS) -> DataFrame:
    """All images below a folder, containers unpacked (see :mod:`.chd`)."""
    from .chd import unpack

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    wanted = "|".join(p.lstrip("*").replace(".", r"\.") for p in patterns)
    return unpack(typed(files.where(F.lower("path").rlike(f"(?:{wanted})$")).select("path", "length", "content")))


def host_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, relative, length, content`` of all files below a host folder, for import.

    Spark's reader passes over empty files, so their names come from the file system.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    listed, empty = at.getFileSystem(conf).listFiles(at, True), []
    while listed.hasNext():
        status = listed.next()
        if status.getLen() == 0 and status.getPath().getName()[0] not in "._":  # hidden, as for the reader
            empty.append((status.getPath().toString(), 0, bytearray()))
    root = folder.rstrip("/").split("/")[-1]
    whole = files.unionByName(spark.createDataFrame(empty, "path string, length long, content binary")) if empty else files
    return whole.select("path", F.regexp_extract("path", rf"/{root}/(.*)$", 1).alias("relative"), "length", "content")
