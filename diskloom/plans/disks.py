"""Queries over images proper: floppies, hard disks, containers and CP/M volumes.

Images are made by change-sets from documents, nations and regions, read back, edited and
damaged; every query calls the operators it is named after and has DuckDB SQL with the
same rows.
"""

from __future__ import annotations

import datetime
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import display, names, stamps
from ..operators import chains, edits, kernel, search, tables
from ..sources import chd, headers, images
from .carriers import QUERIES, SQL, _before, _parts, _table, query

_WHEN = datetime.datetime(1991, 2, 3, 4, 5, 6)

# ---- floppies of documents -----------------------------------------------------------------

#: An image takes the files that begin within so many clusters (of 713), a file counting as
#: four at least, so neither the disk nor its root directory (112 slots) can be full.
_REACH, _LEAST, _UNIT = 340, 4, 1024


def _placed(spark: SparkSession, sf_dir: str, reach: int, least: int, unit: int) -> DataFrame:
    """Documents dealt out to images in order of id: ``image, nth`` (from 1), and the bytes of each."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("whole"))
    each = _parts(docs.select("id", F.octet_length("whole").cast("long").alias("bytes")), reach * unit).withColumn("weight", F.greatest(F.lit(least), F.ceil(F.col("file_size") / unit)).cast("long"))
    dealt = _before(each, [], "weight").withColumn("image", F.floor(F.col("s") / reach))
    nth = F.row_number().over(Window.partitionBy("image").orderBy("id", "part"))
    content = F.expr(f"substring(whole, cast(part * {reach * unit} + 1 as int), {reach * unit})")
    return dealt.select("image", "id", "part", "file_size", nth.alias("nth")).join(docs, "id").select("image", "id", "nth", "file_size", content.alias("content"))


def _placed_sql(reach: int, least: int, unit: int) -> str:
    size = reach * unit
    return f"""placed AS (
  SELECT s // {reach} AS image, id, file_size, CAST(row_number() OVER (PARTITION BY s // {reach} ORDER BY id, part) AS INTEGER) AS nth, md5(whole[part * {size} + 1 : part * {size} + {size}]) AS digest FROM (
    SELECT *, CAST(coalesce(sum(greatest({least}, ceil(file_size / {unit}.0))) OVER (ORDER BY id, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM (
      SELECT *, CAST(least(octet_length(whole) - part * {size}, {size}) AS BIGINT) AS file_size FROM (
        SELECT *, unnest(range(0, greatest(1, CAST(ceil(octet_length(whole) / {size}.0) AS BIGINT)))) AS part FROM (SELECT doc_id AS id, encode(coalesce(text, '')) AS whole FROM documents)))))"""


def _named(image: Column, letter: str) -> Column:
    return F.concat(F.lit(letter), image.cast("string"), F.lit(".img"))


def _done(made: DataFrame) -> DataFrame:
    """Images whose change-set went through; a step that failed fails the query."""
    failed = F.exists("results", lambda r: r["error_code"].isNotNull())
    return made.withColumn("content", F.when(failed, F.raise_error(F.to_json("results")).cast("binary")).otherwise(F.col("content")))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.when(F.col("id") % 2 == 0, "SUB\\").otherwise(""), F.lit("D"), F.col("nth").cast("string"), F.lit(".TXT"))
    return _placed(spark, sf_dir, _REACH, _LEAST, _UNIT).select(_named(F.col("image"), "d").alias("image_id"), "id", "nth", path.alias("path"), "content")


def _change(rows: DataFrame, seq: Column, op: str | Column, path: Column, argument: Column | None = None, content: Column | None = None, volume: Column | None = None) -> DataFrame:
    """Rows of a change-set."""
    return rows.select(
        "image_id", (volume if volume is not None else F.lit(0)).cast("int").alias("volume_idx"), seq.cast("int").alias("seq"), (F.lit(op) if isinstance(op, str) else op).alias("op"), path.alias("path"),
        (argument if argument is not None else F.lit(None)).cast("string").alias("argument"), (content if content is not None else F.lit(None)).cast("binary").alias("content"),
    )


def built_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IBM floppies that hold all documents, those of even id in a directory."""
    docs = _files(spark, sf_dir)
    made = docs.select("image_id").distinct()
    changes = _change(docs, F.col("nth"), "write", F.col("path"), content=F.col("content")).unionByName(_change(made, F.lit(0), "mkdir", F.lit("SUB")))
    empty = made.select("image_id", F.lit("ibmpc").alias("image_type"), F.lit(kernel.blank("ibm_floppy", "720K", "DOCS")).alias("content"))
    return _done(edits.apply(empty, changes, _WHEN))


_PATHS = f"""{_placed_sql(_REACH, _LEAST, _UNIT)}, docs AS (
  SELECT 'd' || image || '.img' AS image_id, CASE WHEN id % 2 = 0 THEN 'SUB\\' ELSE '' END || 'D' || nth || '.TXT' AS path, 'D' || nth || '.TXT' AS name, file_size, digest, id AS doc_id, nth FROM placed)"""
_USED = "CAST(sum(ceil(file_size / 1024.0)) + greatest(1, ceil((2 + count(*) FILTER (doc_id % 2 = 0)) / 32.0)) AS BIGINT)"


@query(f"WITH {_PATHS} SELECT image_id, path, file_size, digest FROM docs")
def image_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written into images and read back through their chains."""
    return tables.contents(built_images(spark, sf_dir)).select("image_id", "path", "file_size", F.md5("content").alias("digest"))


@query(f"""WITH {_PATHS} SELECT image_id, path, file_size, FALSE AS is_directory, 'A' AS attributes, '1991-02-03 04:05' AS modified FROM docs
  UNION ALL SELECT DISTINCT image_id, 'SUB', 0, TRUE, 'D', '1991-02-03 04:05' FROM docs""")
def image_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory trees of images."""
    rows = tables.entries(built_images(spark, sf_dir))
    return rows.select("image_id", "path", "file_size", "is_directory", names.attribute_string(F.col("attributes")).alias("attributes"), stamps.stamp_text(F.col("modify_date"), F.col("modify_time")).alias("modified"))


@query(f"""WITH {_PATHS}, i AS (SELECT image_id, count(*) AS files, {_USED} AS used_clusters, CAST(sum(file_size) AS BIGINT) AS file_bytes FROM docs GROUP BY image_id)
  SELECT image_id, files, 1 AS directories, used_clusters, 713 AS total_clusters, file_bytes, (used_clusters * 1000 // 713 + CASE WHEN used_clusters * 1000 % 713 * 2 > 713 THEN 1 ELSE 0 END) / 10.0 AS percent_used FROM i""")
def image_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Space and counts of images."""
    rows = tables.stats(built_images(spark, sf_dir))
    share = display.percent(F.col("used_clusters"), F.col("total_clusters")).cast("double")
    return rows.select("image_id", F.col("files").cast("long").alias("files"), "directories", F.col("used_clusters").cast("long").alias("used_clusters"), "total_clusters", "file_bytes", share.alias("percent_used"))


@query(f"WITH {_PATHS} SELECT DISTINCT image_id, TRUE AS valid, 0 AS lost_clusters, 0 AS warnings FROM docs")
def image_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity of images: these are sound."""
    return tables.verify_summary(built_images(spark, sf_dir)).select("image_id", "valid", "lost_clusters", "warnings")


@query(f"WITH {_PATHS} SELECT image_id, path, CAST(row_number() OVER (PARTITION BY image_id ORDER BY path) AS INTEGER) AS n FROM docs WHERE regexp_matches(path, '^SUB\\\\D.*8\\.TXT$')")
def image_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a directory that match a pattern, over all images at once."""
    found = search.find(tables.entries(built_images(spark, sf_dir)), "\\SUB\\*8.TXT")
    return found.select("image_id", "path", F.row_number().over(Window.partitionBy("image_id").orderBy("path")).alias("n"))


@query(f"""WITH {_PATHS} SELECT 'root' AS asked, image_id, path FROM docs WHERE doc_id % 2 = 1 UNION ALL SELECT DISTINCT 'root', image_id, 'SUB' FROM docs
  UNION ALL SELECT 'SUB', image_id, path FROM docs WHERE doc_id % 2 = 0 UNION ALL SELECT 'all', image_id, path FROM docs UNION ALL SELECT DISTINCT 'all', image_id, 'SUB' FROM docs
  UNION ALL SELECT 'below', image_id, path FROM docs WHERE doc_id % 2 = 0 UNION ALL SELECT 'file', image_id, path FROM docs WHERE path = 'D1.TXT'""")
def image_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of the root, of a directory, of a file, and of all below either."""
    rows = tables.entries(built_images(spark, sf_dir))
    asked = {"root": (None, False), "SUB": ("\\sub", False), "all": (None, True), "below": ("SUB", True), "file": ("d1.txt", False)}
    out = [search.listing(rows, path, deep).select(F.lit(k).alias("asked"), "image_id", "path") for k, (path, deep) in asked.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


@query(f"""WITH {_PATHS}, e AS (SELECT 0 AS kind, 'SUB' AS path, -1 AS size, -1 AS visit UNION ALL SELECT 1, path, file_size, nth FROM docs WHERE image_id = 'd0.img' AND doc_id % 2 = 1)
  SELECT 'size' AS "by", CAST(row_number() OVER (ORDER BY kind, size DESC, visit) AS INTEGER) AS place, path FROM e UNION ALL SELECT 'name', CAST(row_number() OVER (ORDER BY kind, lower(path)) AS INTEGER), path FROM (SELECT kind, path FROM e)""")
def image_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One directory's listing by size and by name, directories first."""
    rows = search.listing(tables.entries(built_images(spark, sf_dir).where("image_id = 'd0.img'")))
    place = F.row_number().over(Window.orderBy("at"))
    by = lambda column, up: search.ordered(rows, column, up).select(F.monotonically_increasing_id().alias("at"), "path").select(F.lit(column).alias("by"), place.alias("place"), "path")
    return by("size", False).unionByName(by("name", True))


@query(f"""WITH {_PATHS}, e AS (SELECT image_id, path, file_size, doc_id % 3 = 0 AS picked FROM docs UNION ALL SELECT DISTINCT image_id, 'SUB', 0, TRUE FROM docs)
  SELECT image_id, count(*) FILTER (picked) AS n_selected, CAST(sum(file_size) FILTER (picked) AS BIGINT) AS n_bytes, count(*) AS n_entries FROM e GROUP BY image_id""")
def image_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and bytes of files selected in listings, a directory among them."""
    chosen = _files(spark, sf_dir).where("id % 3 = 0").select("image_id", F.lit(0).alias("volume_idx"), "path")
    chosen = chosen.unionByName(_files(spark, sf_dir).select("image_id", F.lit(0).alias("volume_idx"), F.lit("\\sub").alias("path")).distinct())
    return search.selection(tables.entries(built_images(spark, sf_dir)), chosen).select("image_id", "n_selected", "n_bytes", "n_entries")


@query(f"""WITH {_PATHS}, i AS (SELECT DISTINCT image_id FROM docs)
  SELECT image_id, 'sub' AS asked, 'SUB' AS full_name, TRUE AS is_directory FROM i UNION ALL SELECT image_id, '\\', '', TRUE FROM i UNION ALL SELECT image_id, 'none.txt', NULL, NULL FROM i
  UNION ALL SELECT image_id, 'asked', name, FALSE FROM docs WHERE nth = 2""")
def image_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single entries looked up: a directory, the root, a file, and one that is not there."""
    docs = _files(spark, sf_dir)
    fixed = docs.select("image_id").distinct().select("image_id", F.explode(F.array(F.lit("sub"), F.lit("\\"), F.lit("none.txt"))).alias("path"))
    asked = fixed.unionByName(docs.where("nth = 2").select("image_id", "path")).select("image_id", F.lit(0).alias("volume_idx"), "path")
    found = search.lookup(tables.entries(built_images(spark, sf_dir)), asked)
    return found.select("image_id", F.when(F.col("asked").contains(".TXT"), "asked").otherwise(F.col("asked")).alias("asked"), "full_name", "is_directory")


@query(f"""WITH {_PATHS} SELECT image_id, name AS full_name, file_size, 32 AS attributes FROM docs WHERE doc_id % 2 = 1
  UNION ALL SELECT DISTINCT image_id, 'SUB', 0, 16 FROM docs""")
def image_root_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root directories decoded by native expressions alone."""
    made = built_images(spark, sf_dir)
    return tables.root_slots(made, tables.volumes(made)).select("image_id", "full_name", "file_size", "attributes")


@query(f"""WITH {_PATHS} SELECT image_id, {_USED} AS used FROM docs GROUP BY image_id""")
def image_fat_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allocation tables unpacked by native expressions alone."""
    made = built_images(spark, sf_dir)
    return chains.usage(tables.native_fat_entries(made, tables.volumes(made)), "image_id").select("image_id", "used")


@query(f"""WITH {_PATHS}, i AS (SELECT image_id, count(*) AS files, {_USED} AS used FROM docs GROUP BY image_id)
  SELECT CASE WHEN v = 0 THEN 0 END AS volume_idx, image_id, CAST(files AS BIGINT) AS files, used AS used_clusters, CAST(713 - used AS BIGINT) AS free_clusters, CAST(used * 1024 AS BIGINT) AS used_bytes FROM i, range(0, 2) AS r(v)""")
def image_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Space of volumes, and summed over the volumes of an image."""
    return tables.stats_rollup(built_images(spark, sf_dir)).select("volume_idx", "image_id", "files", "used_clusters", "free_clusters", "used_bytes")


@query(f"""WITH {_PATHS}, f AS (SELECT image_id, file_size FROM docs WHERE path LIKE 'SUB%' AND regexp_matches(name, '^.*7\\.TXT$'))
  SELECT image_id, 0 AS volume_idx, count(*) AS n_entries, CAST(sum(file_size) AS BIGINT) AS n_bytes FROM f GROUP BY image_id""")
def image_copy_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes that a copy with a pattern would move."""
    return search.totals(search.find(tables.entries(built_images(spark, sf_dir)), "SUB\\*7.txt"))


@query(f"""WITH {_PATHS} SELECT image_id, CASE WHEN doc_id % 7 = 0 THEN regexp_replace(path, 'D([0-9]+)', 'R\\1') ELSE path END AS path, CASE WHEN doc_id % 3 = 0 THEN 'RA' ELSE 'A' END AS attributes, file_size, digest FROM docs WHERE doc_id % 5 <> 0""")
def image_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files deleted, made read-only and renamed by a change-set, then read back."""
    built = built_images(spark, sf_dir).select("image_id", "image_type", "content")
    key = F.col("id")
    steps = F.array(
        F.struct(F.when(key % 3 == 0, "attr").alias("op"), F.lit("+R").alias("argument")),
        F.struct(F.when(key % 5 == 0, "delete").when(key % 7 == 0, "rename").alias("op"), F.concat(F.lit("R"), F.col("nth").cast("string"), F.lit(".TXT")).alias("argument")),
    )
    each = _files(spark, sf_dir).select("image_id", "nth", "path", F.posexplode(steps).alias("k", "s")).where("s.op is not null")
    made = _done(edits.apply(built, _change(each, F.col("nth") * 2 + F.col("k"), F.col("s.op"), F.col("path"), F.col("s.argument")), _WHEN))
    listed = tables.entries(made).where("not is_directory").select("image_id", "path", names.attribute_string(F.col("attributes")).alias("attributes"))
    read = tables.contents(made).select("image_id", "path", "file_size", F.md5("content").alias("digest"))
    return listed.join(read, ["image_id", "path"])


@query(f"""WITH {_PATHS}, i AS (SELECT image_id, count(*) FILTER (doc_id % 2 = 1) AS files, CAST(coalesce(sum(ceil(file_size / 1024.0)) FILTER (doc_id % 2 = 1), 0) AS INTEGER) AS used_clusters FROM docs GROUP BY image_id)
  SELECT image_id, CAST(files AS INTEGER) AS files, 0 AS directories, used_clusters, TRUE AS valid FROM i""")
def image_rmdir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory removed with all in it; what is left is sound."""
    built = built_images(spark, sf_dir).select("image_id", "image_type", "content")
    made = _done(edits.apply(built, _change(built, F.lit(1), "rmdir", F.lit("SUB"), F.lit("recursive")), _WHEN))
    rows = tables.stats(made).select("image_id", "files", "directories", "used_clusters")
    return rows.join(tables.verify_summary(made).select("image_id", "valid"), "image_id")


# ---- damage --------------------------------------------------------------------------------

# A 720K floppy after _START: SUB owns cluster 2, A.TXT 3 to 5, B.TXT 6 and 7, SUB\C.TXT 8;
# slots of the root, 32 bytes each from byte 3584: label, SUB, A.TXT, B.TXT, E.TXT.
_START = [("mkdir", "SUB", 0), ("write", "A.TXT", 3000), ("write", "B.TXT", 2000), ("write", "SUB\\C.TXT", 9), ("write", "E.TXT", 0)]
_SLOT = {"SUB": 3616, "A.TXT": 3648, "B.TXT": 3680, "E.TXT": 3712}


def _pair(cluster: int, even: int, odd: int) -> tuple[int, bytes]:
    """Place and bytes of two table entries."""
    return 512 + cluster // 2 * 3, bytes((even & 255, even >> 8 | (odd & 15) << 4, odd >> 4))


#: What is changed in the bytes of an image, and the findings that follow from it.
DAMAGE: dict[str, tuple[list[tuple[int, bytes]], list[tuple[str, str, int | None]]]] = {
    "sound": ([], []),
    "mark0": ([_pair(0, 0x0F9, 0xFFF)], [("V1", "", 0)]),
    "mark1": ([_pair(0, 0xFF9, 0xFF7)], [("V2", "", 1)]),
    "folder1": ([(_SLOT["SUB"] + 26, b"\1\0")], [("V4", "SUB", 1), ("V11", "", None), ("V11", "", 2), ("V11", "", 8)]),
    "owned": ([(_SLOT["B.TXT"] + 11, b"\x10"), (_SLOT["B.TXT"] + 26, b"\3\0")], [("V5", "B.TXT", 3), ("V11", "", None), ("V11", "", 6)]),
    "loop": ([_pair(4, 5, 3)], [("V6", "A.TXT", 3)]),
    "loopdir": ([_pair(2, 2, 4)], [("V6", "SUB", 2), ("V11", "", None), ("V11", "", 8)]),
    "empty": ([(_SLOT["E.TXT"] + 26, b"\x09\0")], [("V7", "E.TXT", 9)]),
    "file1": ([(_SLOT["A.TXT"] + 26, b"\1\0")], [("V8", "A.TXT", 1), ("V11", "", None), ("V11", "", 3)]),
    "size": ([(_SLOT["A.TXT"] + 28, struct.pack("<I", 9999))], [("V9", "A.TXT", 3)]),
    "crossed": ([(_SLOT["B.TXT"] + 26, b"\4\0")], [("V10", "A.TXT", 4), ("V10", "A.TXT", 5), ("V11", "", None), ("V11", "", 6)]),
    "lost": ([(_SLOT["B.TXT"], b"\xe5")], [("V11", "", None), ("V11", "", 6)]),
    "bad": ([_pair(8, 0xFFF, 0xFF7)], [("V12", "", None)]),
    "boot": ([(0x0D, b"\3")], [("V3", "", None)]),
    "type": ([], [("V14", "", None)]),
}


def damaged_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each kind of damage and each nation."""
    kinds = F.explode(F.array(*(F.lit(k) for k in DAMAGE))).alias("kind")
    own = _table(spark, sf_dir, "nation").select(kinds, F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("n"))
    own = own.select(F.concat("n", F.lit("-"), "kind").alias("image_id"), "kind")
    empty = own.select("image_id", F.lit("ibmpc").alias("image_type"), F.lit(kernel.blank("ibm_floppy", "720K", "HURT")).alias("content"))
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(op).alias("op"), F.lit(path).alias("path"), F.lit(bytearray(b"x" * size)).alias("raw")) for i, (op, path, size) in enumerate(_START)))).alias("x")
    each = own.select("image_id", steps)
    made = _done(edits.apply(empty, _change(each, F.col("x.i"), F.col("x.op"), F.col("x.path"), content=F.col("x.raw")), _WHEN))
    content, kind = F.col("content"), F.regexp_extract("image_id", "-(.*)$", 1)
    for name, (changes, _) in DAMAGE.items():
        hurt = F.col("content")
        for at, raw in changes:
            hurt = F.concat(F.substring(hurt, 1, F.lit(at)), F.lit(bytearray(raw)), F.substring(hurt, F.lit(at + len(raw) + 1), F.lit(1 << 30)))
        if changes:
            content = F.when(kind == name, hurt).otherwise(content)
    return made.select("image_id", F.when(kind == "type", "tape").otherwise(F.col("image_type")).alias("image_type"), content.alias("content"))


_FINDINGS = ", ".join(f"('{kind}', '{code}', '{path}', {'NULL' if at is None else at})" for kind, (_, found) in DAMAGE.items() for code, path, at in found)


@query(f"""SELECT 'n' || n_nationkey || '-' || kind AS image_id, code, path, CAST(cluster AS INTEGER) AS cluster, CASE WHEN code IN ('V3', 'V4', 'V5', 'V6', 'V8', 'V10', 'V14') THEN 'error' ELSE 'warning' END AS severity
  FROM nation, (VALUES {_FINDINGS}) AS f(kind, code, path, cluster)""")
def verify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every integrity rule on images damaged for it."""
    return tables.findings(damaged_images(spark, sf_dir)).select("image_id", "code", F.coalesce("path", F.lit("")).alias("path"), "cluster", "severity")


_COUNTS = ", ".join(f"('{kind}', {sum(c in ('V3', 'V4', 'V5', 'V6', 'V8', 'V10', 'V14') for c, _, _ in found)}, {sum(c not in ('V3', 'V4', 'V5', 'V6', 'V8', 'V10', 'V14') for c, _, _ in found)})" for kind, (_, found) in DAMAGE.items())


@query(f"""SELECT 'n' || n_nationkey || '-' || kind AS image_id, CAST(errors AS BIGINT) AS errors, CAST(CASE WHEN kind IN ('boot', 'type') THEN NULL ELSE warnings END AS BIGINT) AS warnings, errors = 0 AS valid FROM nation, (VALUES {_COUNTS}) AS f(kind, errors, warnings)""")
def verify_by_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, warnings and validity of damaged images."""
    return tables.verify_summary(damaged_images(spark, sf_dir), by_image=True).select("image_id", "errors", "warnings", "valid")


#: Steps that cannot be taken on such an image, with the codes they give.
_WRONG = [("delete", "NONE.TXT", "", "not_found"), ("rmdir", "SUB", "", "not_empty"), ("rmdir", "A.TXT", "", "not_directory"), ("delete", "SUB", "", "is_directory"), ("mkdir", "A.TXT", "", "exists"), ("rename", "A.TXT", "B.TXT", "exists"), ("write", "BAD*.TXT", "", "invalid_filename"), ("write", "NODIR\\X.TXT", "", "not_found"), ("copy", "A.TXT", "", "unsupported"), ("attr", "B.TXT", "+H +S", "")]


@query(f"""SELECT 'n' || n_nationkey || '-sound' AS image_id, op, path, nullif(code, '') AS error_code FROM nation, (VALUES {", ".join(str(x[:2] + x[3:]) for x in _WRONG).replace(chr(92) * 2, chr(92))}) AS f(op, path, code)""")
def edit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that fail are reported by code and leave the image as it was."""
    own = damaged_images(spark, sf_dir).where("image_id like '%-sound'")
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), *(F.lit(v).alias(k) for k, v in zip(("op", "path", "argument"), x))) for i, x in enumerate(_WRONG)))).alias("x")
    changes = _change(own.select("image_id", steps), F.col("x.i"), F.col("x.op"), F.col("x.path"), F.col("x.argument"))
    done = edits.apply(own, changes, _WHEN).select("image_id", F.explode("results").alias("r"))
    return done.select("image_id", "r.op", "r.path", "r.error_code")


# ---- hard disks and containers -------------------------------------------------------------


def _hard_disk(nations: list[tuple[int, str]]) -> bytes:
    """A disk with a volume a nation; every fourth label is of no known type."""
    head = bytearray(512)
    struct.pack_into("<HH", head, 0, 1, 1)
    head[4:20] = b"SERIAL".ljust(16, b"\0")
    at = 52
    for _ in range(2):
        head[at] = 1
        at += 9
    head[at] = len(nations)
    starts = [8 + 200 * i for i in range(len(nations))]
    struct.pack_into(f"<{len(nations)}I", head, at + 1, *starts)
    data = bytearray(head.ljust((8 + 200 * len(nations)) * 512, b"\0"))
    for i, ((key, name), start) in enumerate(zip(nations, starts)):
        base = start * 512
        struct.pack_into("<H", data, base, 7 if key % 4 == 1 else key % 4 % 3)
        data[base + 2 : base + 18] = name.encode()[:16].ljust(16, b"\0")
        struct.pack_into("<IIHHH", data, base + 30, 200, 0, 512, 4, 64)
        data[base + 60] = 1
        struct.pack_into("<HH", data, base + 61, key % 26 + 0xFF00 if key % 3 == 0 else key, i)
        data[base + 512 : base + 515] = data[base + 1024 : base + 1027] = b"\xf8\xff\xff"
        data[base + 1536 : base + 1568] = kernel.Entry(f"N{key}".ljust(8), "   ", kernel.VOLUME).write()
    return bytes(data)


def hard_disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hard disk for each region, with a file on each of its volumes."""
    rows = _table(spark, sf_dir, "region").join(_table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    own = rows.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = _hard_disk([(x["n_nationkey"], x["n_name"]) for x in row["v"]])
                yield pa.RecordBatch.from_arrays([pa.array([row["r_name"]]), pa.array(["harddisk"]), pa.array([raw], pa.binary())], ["image_id", "image_type", "content"])

    empty = own.mapInArrow(run, "image_id string, image_type string, content binary")
    each = own.select(F.col("r_name").alias("image_id"), F.posexplode(F.filter("v", lambda x: x["n_nationkey"] % 4 != 1)).alias("i", "x"))
    body = F.encode(F.repeat("x.n_name", 200), "UTF-8")
    return _done(edits.apply(empty, _change(each, F.lit(0), "write", F.concat(F.lit("N"), F.col("x.n_nationkey").cast("string"), F.lit(".TXT")), content=body, volume=F.col("i")), _WHEN))


_VOLUMES = """v AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY key) - 1 AS INTEGER) AS "index" FROM (
  SELECT r_name AS image_id, n_nationkey AS key, n_name AS name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS label_index FROM nation JOIN region ON r_regionkey = n_regionkey) WHERE key % 4 <> 1)"""


@query(f"""WITH {_VOLUMES} SELECT image_id, "index", label_index, name, CAST(200 AS BIGINT) AS capacity, CAST(102400 AS BIGINT) AS capacity_bytes, 2048 AS cluster_size, [CASE WHEN key % 3 = 0 THEN chr(CAST(65 + key % 26 AS INTEGER)) || ':' ELSE 'C:' END] AS letters FROM v""")
def hd_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions of hard disks, numbered anew beside their place in the label."""
    return tables.partitions(hard_disks(spark, sf_dir)).select("image_id", "index", "label_index", "name", "capacity", "capacity_bytes", "cluster_size", "letters")


@query("""SELECT r_name AS image_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS label_index, n_name AS name, CAST(200 AS BIGINT) AS capacity, n_nationkey % 4 <> 1 AS kept, CASE WHEN n_nationkey % 3 = 0 THEN 65280 + n_nationkey % 26 ELSE n_nationkey END AS device_unit
  FROM nation JOIN region ON r_regionkey = n_regionkey""")
def hd_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of hard disks and their volumes, decoded by native expressions."""
    rows = headers.volume_labels(hard_disks(spark, sf_dir))
    return rows.select("image_id", "label_index", "label.name", "label.capacity", "label.kept", F.col("label.assignments")[0]["device_unit"].alias("device_unit"))


@query(f"""WITH {_VOLUMES} SELECT image_id, "index" AS volume_idx, 'N' || key || '.TXT' AS path, CAST(length(name) * 200 AS BIGINT) AS file_size, md5(repeat(name, 200)) AS digest FROM v""")
def hd_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on the partitions of hard disks."""
    return tables.contents(hard_disks(spark, sf_dir)).select("image_id", "volume_idx", "path", "file_size", F.md5("content").alias("digest"))


@query(f"""WITH {_VOLUMES} SELECT image_id, CAST(count(*) AS BIGINT) AS files, CAST(sum(48) AS BIGINT) AS total_clusters, CAST(sum(ceil(length(name) * 200 / 2048.0)) AS BIGINT) AS used_clusters, TRUE AS valid FROM v GROUP BY image_id""")
def hd_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Space of hard disks summed over their partitions, and whether all of them are sound."""
    made = hard_disks(spark, sf_dir)
    rows = tables.stats_rollup(made).where("volume_idx is null").select("image_id", "files", "total_clusters", "used_clusters")
    return rows.join(tables.verify_summary(made, by_image=True).select("image_id", "valid"), "image_id")


_HUNK = 4096


def _container(content: bytes, packed: bool) -> bytes:
    """A container of a disk, its hunks stored as they are or compressed in places of a hunk's size; one tag of metadata."""
    count = -(-len(content) // _HUNK)
    padded = content.ljust(count * _HUNK, b"\0")
    first = 1 + (124 + 4 * count + 64) // _HUNK
    meta = 124 + (16 if packed else 4 * count)
    head = b"MComprHD" + struct.pack(">II", 124, 5) + (b"zlib" if packed else bytes(4)) + bytes(12) + struct.pack(">QQQII", len(content), 124, meta, _HUNK, 512) + bytes(60)
    table = struct.pack(">I", 0) + (first * _HUNK).to_bytes(6, "big") + bytes(6) if packed else struct.pack(f">{count}I", *range(first, first + count))
    note = b"CYLS,HEADS\0"
    raw = head + table + b"GDDD" + b"\1" + len(note).to_bytes(3, "big") + bytes(8) + note
    hunks = [padded[i : i + _HUNK] for i in range(0, len(padded), _HUNK)]
    return raw.ljust(first * _HUNK, b"\0") + b"".join(zlib.compress(x).ljust(_HUNK, b"\0") if packed else x for x in hunks)


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files ``path, length, content``: hard disks in containers, those of longer names compressed, and the bare disks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = [(f"/in/{row['image_id']}.chd", _container(row["content"], len(row["image_id"]) > 4)), (f"/in/{row['image_id']}.img", row["content"])]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in raw]), pa.array([len(x[1]) for x in raw], pa.int64()), pa.array([x[1] for x in raw], pa.binary())], ["path", "length", "content"])

    return hard_disks(spark, sf_dir).select("image_id", "content").mapInArrow(run, "path string, length long, content binary")


@query(f"""WITH {_VOLUMES} SELECT image_id || k AS image_id, 'harddisk' AS image_type, "index" AS volume_idx, 'N' || key || '.TXT' AS path, md5(repeat(name, 200)) AS digest FROM v, (VALUES ('.chd'), ('.img')) AS e(k)""")
def chd_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on hard disks that lie in containers, read through their hunks, beside those of bare disks."""
    found = chd.unpack(images.typed(containers(spark, sf_dir)))
    read = tables.contents(found).select("image_id", "volume_idx", "path", F.md5("content").alias("digest"))
    return read.join(found.select("image_id", "image_type"), "image_id").select("image_id", "image_type", "volume_idx", "path", "digest")


@query("SELECT '/in/' || r_name || '.chd' AS path, 'GDDD' AS tag, 'CYLS,HEADS' AS value FROM region")
def chd_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of containers."""
    return chd.metadata(containers(spark, sf_dir)).select("path", "tag", F.rtrim(F.decode("value", "UTF-8"), F.lit("\0")).alias("value"))


@query(f"""SELECT '/in/' || r_name || '.chd' AS path, count(*) AS hunks, CAST(sum(CASE WHEN length(r_name) > 4 THEN 1 ELSE 0 END) AS BIGINT) AS packed FROM (SELECT r_name, (8 + 200 * count(*)) * 512 AS size FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name), range(0, 1000) AS r(h) WHERE h < ceil(size / {_HUNK}.0) GROUP BY r_name""")
def chd_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks of containers, and how many of them are compressed."""
    return chd.hunks(containers(spark, sf_dir)).groupBy("path").agg(F.count(F.lit(1)).alias("hunks"), F.count_if(F.col("kind") == 0).alias("packed"))


# ---- new images ----------------------------------------------------------------------------

_FORMATS = "('victor_floppy', 'single', 'floppy', 1214, 11), ('victor_floppy', 'double', 'floppy', 2378, 13), ('ibm_floppy', '360K', 'ibmpc', 354, 12), ('ibm_floppy', '720K', 'ibmpc', 713, 14), ('ibm_floppy', '1.2M', 'ibmpc', 2371, 29), ('ibm_floppy', '1.44M', 'ibmpc', 2847, 33)"


@query(f"SELECT family || variant AS image_id, kind AS image_type, CAST(clusters AS INTEGER) AS free_clusters, CAST(start AS BIGINT) AS data_start, 'NEW' AS label, TRUE AS valid FROM (VALUES {_FORMATS}) AS f(family, variant, kind, clusters, start)")
def format_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank image of every format of the catalogue: its type as detected, geometry, label and soundness."""
    wanted = [(r["family"] + r["variant"], r["family"], r["variant"], "new") for r in edits.formats(spark).select("family", "variant").collect()]  # six rows
    made = images.typed(edits.blank_images(spark, wanted).select(F.concat(F.lit("/"), "image_id").alias("path"), F.octet_length("content").cast("long").alias("length"), "content"))
    rows = made.select("image_id", "image_type").join(tables.stats(made).select("image_id", "free_clusters"), "image_id")
    return rows.join(tables.volumes(made).select("image_id", "data_start", "label"), "image_id").join(tables.verify_summary(made).select("image_id", "valid"), "image_id")


# ---- CP/M ----------------------------------------------------------------------------------

#: As for floppies above: blocks of 2 KiB, 555 of them, and 288 directory slots.
_CPM = (250, 2, 2048)
_CPM_NAMES = f"""{_placed_sql(*_CPM)}, docs AS (SELECT 'c' || image || '.img' AS image_id, CAST(id % 16 AS INTEGER) AS "user", 'D' || nth || '.TXT' AS path, id, CAST(greatest(1, ceil(file_size / 128.0)) * 128 AS BIGINT) AS file_size, file_size AS bytes, digest FROM placed)"""


def cpm_disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CP/M floppies that hold all documents, in files of one extent and more; every fifth is deleted again."""
    docs = _placed(spark, sf_dir, *_CPM).select(_named(F.col("image"), "c").alias("image_id"), "id", "nth", F.concat(F.lit("D"), F.col("nth").cast("string"), F.lit(".TXT")).alias("path"), (F.col("id") % 16).cast("string").alias("user"), "content")
    blank = docs.select("image_id").distinct().select("image_id", F.lit("cpm").alias("image_type"), F.lit(bytearray(b"\xe5" * (1224 * 512))).alias("content"))
    changes = _change(docs, F.col("nth"), "write", F.col("path"), F.col("user"), F.col("content")).unionByName(_change(docs.where("id % 5 = 0"), F.col("nth") + 1000, "delete", F.col("path"), F.col("user")))
    return _done(edits.apply(blank, changes, _WHEN))


@query(f"""WITH {_CPM_NAMES} SELECT image_id, "user", path, file_size, digest FROM docs WHERE id % 5 <> 0""")
def cpm_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CP/M files written, some deleted, the others read back through their extents."""
    plain = F.regexp_replace(F.decode("content", "UTF-8"), "\\x1a+$", "")
    return tables.contents(cpm_disks(spark, sf_dir)).select("image_id", "user", "path", "file_size", F.md5(F.encode(plain, "UTF-8")).alias("digest"))


@query(f"""WITH {_CPM_NAMES} SELECT image_id, "user", path, CAST(greatest(1, ceil(bytes / 16384.0)) AS BIGINT) AS extents, CAST(greatest(1, ceil(bytes / 2048.0)) AS BIGINT) AS blocks, CAST(greatest(1, ceil(bytes / 16384.0)) - 1 AS INTEGER) AS last_extent FROM docs WHERE id % 5 <> 0""")
def cpm_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents and blocks of CP/M files."""
    rows = tables.cpm_extents(cpm_disks(spark, sf_dir)).select("image_id", "user", names.full_name(F.col("name"), F.col("extension")).alias("path"), "extent", F.size("blocks").alias("n"))
    return rows.groupBy("image_id", "user", "path").agg(F.count(F.lit(1)).alias("extents"), F.sum("n").alias("blocks"), F.max("extent").alias("last_extent"))


@query(f"""WITH {_CPM_NAMES} SELECT image_id, path, "user", CAST(row_number() OVER (PARTITION BY image_id ORDER BY "user", path) - 1 AS INTEGER) AS visit FROM docs WHERE id % 5 <> 0""")
def cpm_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of CP/M volumes by user and name, all of them through a search for everything."""
    return search.find(tables.entries(cpm_disks(spark, sf_dir)), "*.*").select("image_id", "path", "user", "visit")


@query(f"""WITH {_CPM_NAMES} SELECT image_id, CAST(count(*) FILTER (id % 5 <> 0) AS INTEGER) AS files, CAST(coalesce(sum(file_size) FILTER (id % 5 <> 0), 0) AS BIGINT) AS file_bytes FROM docs GROUP BY image_id""")
def cpm_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of CP/M volumes."""
    return tables.stats(cpm_disks(spark, sf_dir)).select("image_id", "files", "file_bytes")


@query("""SELECT 'c' || n_nationkey AS image_id, 'warning' AS severity, 'V13' AS code, '3:A.B' AS path FROM nation""")
def cpm_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CP/M entries whose names are spelled alike: a dot in the name, and one before the extension."""
    raw = bytearray(b"\xe5" * (1224 * 512))
    for i, name in enumerate((b"A.B        ", b"A       B  ", b"C          ")):
        raw[76 * 512 + 32 * i : 76 * 512 + 32 * i + 32] = bytes((3,)) + name + bytes((0, 0, 0, 1)) + struct.pack("<8H", i + 1, *[0] * 7)
    made = _table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("image_id"), F.lit("cpm").alias("image_type"), F.lit(raw).alias("content"))
    return tables.findings(made).select("image_id", "severity", "code", "path")
