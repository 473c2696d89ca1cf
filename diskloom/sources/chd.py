"""CHD version 5 containers: header, hunk map, hunks, metadata."""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import u32_big, u64_big
from ..operators.kernel import Problem

# Fixed values of the format.
MAGIC, HEADER = b"MComprHD", 124
CODECS = {0: "none", 0x7A6C6962: "zlib", 0x6C7A6D61: "lzma"}
FOREIGN = {0x68756666: "huff", 0x666C6163: "flac"}
STORED, SAME, PARENT = 4, 5, 6


def header(content: Column) -> Column:
    """The header's fields as a struct, by native expressions."""
    sha = lambda at: F.lower(F.hex(F.substring(content, at + 1, F.lit(20))))
    return F.struct(
        u32_big(content, 12).alias("version"), F.array(*(u32_big(content, 16 + 4 * i) for i in range(4))).alias("codecs"),
        u64_big(content, 32).alias("logical_bytes"), u64_big(content, 40).alias("map_offset"), u64_big(content, 48).alias("meta_offset"),
        u32_big(content, 56).alias("hunk_bytes"), u32_big(content, 60).alias("unit_bytes"),
        sha(64).alias("raw_sha1"), sha(84).alias("sha1"), sha(104).alias("parent_sha1"),
        F.ceil(u64_big(content, 32) / u32_big(content, 56)).cast("long").alias("hunk_count"),
        (F.array_max(F.array(*(u32_big(content, 16 + 4 * i) for i in range(4)))) > 0).alias("is_compressed"),
        (sha(104) != "00" * 20).alias("has_parent"),
    )


@dataclass
class Container:
    """An opened container; problems of the format are raised when it is opened."""

    data: bytes

    def __post_init__(self) -> None:
        data = self.data
        if len(data) < HEADER:
            raise Problem("chd_error", "File too small for CHD header")
        if data[:8] != MAGIC:
            raise Problem("chd_error", f"Invalid CHD signature: {data[:8]!r}")
        length, version, *codecs = struct.unpack_from(">6I", data, 8)
        if version != 5:
            raise Problem("chd_error", f"Unsupported CHD version: {version} (only v5 supported)")
        if length != HEADER:
            raise Problem("chd_error", f"Invalid v5 header length: {length}")
        self.codecs = codecs
        self.logical, self.map_at, self.meta_at, self.hunk, self.unit = struct.unpack_from(">QQQII", data, 32)
        foreign = [FOREIGN.get(c) or c.to_bytes(4, "big").decode("ascii", "replace") for c in codecs if c not in CODECS]
        if foreign:
            raise Problem("chd_error", f"CHD uses unsupported codec(s): {', '.join(foreign)}")
        if any(data[104:124]):
            raise Problem("chd_error", "CHD requires a parent file (delta CHD)")
        if not self.hunk:
            raise Problem("chd_error", "Hunk size is zero")
        self.count = -(-self.logical // self.hunk)

    def map(self) -> list[tuple[int, int, int]]:
        """``(kind, offset, stored bytes)`` of every hunk.

        Compressed containers are taken to hold their hunks one after another in places of
        a hunk's size; those that do not fail when a hunk is read.
        """
        if not any(self.codecs):
            raw = self.data[self.map_at : self.map_at + 4 * self.count]
            if len(raw) < 4 * self.count:
                raise Problem("chd_error", "Hunk map is cut off")
            return [(STORED, n * self.hunk, self.hunk if n else 0) for n in struct.unpack(f">{self.count}I", raw)]
        head = self.data[self.map_at : self.map_at + 16]
        if len(head) < 16:
            raise Problem("chd_error", "Compressed map header too small")
        first = int.from_bytes(head[4:10], "big")
        return [(0, first + i * self.hunk, self.hunk) for i in range(self.count)]

    def read_hunk(self, entry: tuple[int, int, int], entries: list[tuple[int, int, int]], depth: int = 0) -> bytes:
        kind, at, size = entry
        if kind == STORED or not size:
            raw = self.data[at : at + self.hunk] if at else b""
            return raw.ljust(self.hunk, b"\0")
        if kind == SAME:
            if depth > 64 or at >= len(entries):
                raise Problem("chd_error", "Hunk refers to itself")
            return self.read_hunk(entries[at], entries, depth + 1)
        if kind > 3:
            raise Problem("chd_error", f"Unknown compression type: {kind}")
        return self.expand(self.data[at : at + size], self.codecs[kind])

    def expand(self, raw: bytes, codec: int) -> bytes:
        try:
            if CODECS[codec] == "zlib":
                for bits in (-15, 15):  # without a header first
                    try:
                        return zlib.decompressobj(bits).decompress(raw, self.hunk)
                    except zlib.error:
                        if bits > 0:
                            raise
            if CODECS[codec] == "lzma":
                if len(raw) < 5:
                    raise Problem("chd_error", "LZMA data too small")
                rest, lc = divmod(raw[0], 9)
                pb, lp = divmod(rest, 5)
                chain = [{"id": lzma.FILTER_LZMA1, "lc": lc, "lp": lp, "pb": pb}]
                return lzma.LZMADecompressor(format=lzma.FORMAT_RAW, filters=chain).decompress(raw[5:], self.hunk)
        except (zlib.error, lzma.LZMAError) as error:
            raise Problem("chd_error", f"Hunk cannot be decompressed: {error}") from error
        return raw

    def logical_content(self) -> bytes:
        entries = self.map()
        whole = b"".join(self.read_hunk(e, entries) for e in entries)
        if len(whole) < self.logical:
            raise Problem("chd_error", "Hunks are shorter than the header says; compressed maps of this kind are unsupported")
        return whole[: self.logical]

    def metadata(self) -> Iterator[tuple[str, bytes]]:
        """Tags and values of the metadata list; a list that bends back ends."""
        at, seen = self.meta_at, set()
        while at and at not in seen and len(self.data) >= at + 16:
            seen.add(at)
            tag, length, following = self.data[at : at + 4], int.from_bytes(self.data[at + 5 : at + 8], "big"), int.from_bytes(self.data[at + 8 : at + 16], "big")
            yield tag.decode("latin-1"), self.data[at + 16 : at + 16 + length]
            at = following


def unpack(images: DataFrame) -> DataFrame:
    """Images with container rows replaced by their logical content.

    Adds ``error_code, error_message``; a container that cannot be read keeps no content.
    Rows that are no container pass by without Python.
    """
    plain = images.where(~F.coalesce(F.substring("content", 1, 8) == F.lit(bytearray(MAGIC)), F.lit(False)))
    boxed = images.where(F.substring("content", 1, 8) == F.lit(bytearray(MAGIC)))
    none = [F.lit(None).cast("string").alias(c) for c in ("error_code", "error_message")]
    schema = "image_id string, path string, length long, image_type string, content binary, error_code string, error_message string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                row |= {"error_code": None, "error_message": None}
                try:
                    row["content"] = Container(row["content"]).logical_content()
                    row["length"] = len(row["content"])
                except Problem as problem:
                    row |= {"content": None, "error_code": problem.code, "error_message": str(problem)}
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    return plain.select("*", *none).unionByName(boxed.mapInArrow(run, schema))


_ARROW = pa.schema([("image_id", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("image_type", pa.string()), ("content", pa.binary()), ("error_code", pa.string()), ("error_message", pa.string())])


def hunks(images: DataFrame) -> DataFrame:
    """``path, hunk, kind, offset, stored`` of every hunk of the containers among ``images``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    entries = Container(row["content"]).map()
                except Problem:
                    continue
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "hunk": i, "kind": k, "offset": o, "stored": n} for i, (k, o, n) in enumerate(entries)])

    return images.where(F.substring("content", 1, 8) == F.lit(bytearray(MAGIC))).select("path", "content").mapInArrow(run, "path string, hunk long, kind long, offset long, stored long")


def metadata(images: DataFrame) -> DataFrame:
    """``path, tag, value`` of the metadata of the containers among ``images``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    found = [{"path": row["path"], "tag": tag, "value": value} for tag, value in Container(row["content"]).metadata()]
                except Problem:
                    continue
                if found:
                    yield pa.RecordBatch.from_pylist(found)

    return images.where(F.substring("content", 1, 8) == F.lit(bytearray(MAGIC))).select("path", "content").mapInArrow(run, "path string, tag string, value binary")
