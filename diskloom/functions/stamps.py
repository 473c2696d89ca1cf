"""Packed dates and times of directory entries as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def packed_date(stamp: Column) -> Column:
    """Year since 1980, month and day in 7, 4 and 5 bits."""
    return (F.shiftleft(F.year(stamp) - 1980, 9) + F.shiftleft(F.month(stamp), 5) + F.dayofmonth(stamp)).cast("int")


def packed_time(stamp: Column) -> Column:
    """Hour, minute and half the second in 5, 6 and 5 bits."""
    return (F.shiftleft(F.hour(stamp), 11) + F.shiftleft(F.minute(stamp), 5) + F.floor(F.second(stamp) / 2)).cast("int")


def _fields(date: Column, time: Column) -> list[Column]:
    bits = lambda x, shift, mask: F.shiftright(x, shift).bitwiseAND(F.lit(mask)).cast("int")
    return [bits(date, 9, 0x7F) + 1980, bits(date, 5, 0x0F), bits(date, 0, 0x1F), bits(time, 11, 0x1F), bits(time, 5, 0x3F), bits(time, 0, 0x1F) * 2]


def stamp_text(date: Column, time: Column, seconds: bool = False, unset: str = "") -> Column:
    """``YYYY-MM-DD HH:MM`` as stored, never checked; ``unset`` for date 0."""
    fields = _fields(date, time)
    text = F.format_string("%04d-%02d-%02d %02d:%02d" + ":%02d" * seconds, *fields[: 6 if seconds else 5])
    return F.when(date == 0, unset).otherwise(text)


def stamp(date: Column, time: Column) -> Column:
    """The point in time, null where the stored fields name none."""
    y, m, d, h, i, s = _fields(date, time)
    return F.when(date != 0, F.try_make_timestamp_ntz(y, m, d, h, i, s.cast("decimal(16,6)")))


def sort_key(date: Column, time: Column) -> Column:
    return F.shiftleft(date.cast("long"), 16).bitwiseOR(time.cast("long"))
