"""Fixed-layout binary fields as native column expressions.

Offsets count from 0.  Reads past the end see zero bytes, as sectors are zero-padded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECTOR = 512


def _hex(data: Column, offset: int | Column, size: int, little: bool) -> Column:
    at = F.lit(offset) if isinstance(offset, int) else offset
    zero = F.lit(bytearray(size))
    whole = F.substring(F.concat(F.substring(data, at + 1, F.lit(size)), zero), F.lit(1), F.lit(size))
    digits = F.hex(whole)
    order = range(size - 1, -1, -1) if little else range(size)
    return F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in order))


def number(data: Column, offset: int | Column, size: int, little: bool = True) -> Column:
    """An unsigned number of ``size`` bytes (up to 7, or 8 below 2**63) as a long."""
    return F.conv(_hex(data, offset, size, little), 16, 10).cast("long")


def u8(data: Column, offset: int | Column) -> Column:
    return number(data, offset, 1).cast("int")


def u16(data: Column, offset: int | Column) -> Column:
    return number(data, offset, 2).cast("int")


def u32(data: Column, offset: int | Column) -> Column:
    return number(data, offset, 4)


def u32_big(data: Column, offset: int | Column) -> Column:
    return number(data, offset, 4, little=False)


def u64_big(data: Column, offset: int | Column) -> Column:
    return F.conv(_hex(data, offset, 8, False), 16, 10).cast("decimal(20,0)")


def sector(data: Column, index: int | Column) -> Column:
    """One sector of an image, zero-padded at its end."""
    at = F.lit(index) if isinstance(index, int) else index
    return F.rpad(F.substring(data, at * SECTOR + 1, F.lit(SECTOR)), SECTOR, F.lit(bytearray(1)))


def latin1(data: Column) -> Column:
    """Bytes as text, one character a byte."""
    return F.decode(data, "ISO-8859-1")


def ascii_replaced(data: Column) -> Column:
    """Bytes as ASCII text, any other byte as the replacement character."""
    return F.regexp_replace(latin1(data), "[\\x{80}-\\x{FF}]", "�")


def fat12_entry(low: Column, middle: Column, high: Column, cluster: Column) -> Column:
    """A 12-bit entry from the bytes of its pair: even clusters in the low bits, odd ones in the high."""
    even = low.bitwiseAND(F.lit(255)) + F.shiftleft(middle.bitwiseAND(F.lit(15)), 8)
    odd = F.shiftright(middle, 4) + F.shiftleft(high, 4)
    return F.when(cluster % 2 == 0, even).otherwise(odd)


def fat12(table: Column, cluster: Column) -> Column:
    """The 12-bit entry of a cluster in a packed table; 0 beyond its end."""
    word = u16(table, (cluster + F.floor(cluster / 2)).cast("int"))
    return F.when(cluster % 2 == 0, word.bitwiseAND(F.lit(0xFFF))).otherwise(F.shiftright(word, 4))
