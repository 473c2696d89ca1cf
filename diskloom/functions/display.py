"""Display strings as native column expressions, exact to the last digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tenths(size: Column, unit: int) -> Column:
    """``size / unit`` with one decimal, ties to even; ``unit`` is a power of two."""
    size = size.cast("long")
    whole = F.floor(size * 10 / F.lit(unit).cast("decimal(20,0)")).cast("long")
    rest = size * 10 - whole * unit
    whole = whole + F.when((rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(whole / 10).cast("long").cast("string"), F.lit("."), (whole % 10).cast("string"))


def size_text(size: Column, style: str = "report") -> Column:
    """A size in words: ``report`` (B to GB), ``short`` (B, KB, MB), ``status`` (bytes, KB, MB) or ``list`` (plain, KB, MB)."""
    kb, mb, gb = 1 << 10, 1 << 20, 1 << 30
    small = F.concat(size.cast("string"), F.lit(" B"))
    plain = {"report": small, "short": small, "status": F.concat(F.format_number(size, 0), F.lit(" bytes")), "list": F.format_number(size, 0)}[style]
    text = F.when(size < kb, plain).when(size < mb, F.concat(_tenths(size, kb), F.lit(" KB")))
    if style == "report":
        return text.when(size < gb, F.concat(_tenths(size, mb), F.lit(" MB"))).otherwise(F.concat(_tenths(size, gb), F.lit(" GB")))
    return text.otherwise(F.concat(_tenths(size, mb), F.lit(" MB")))


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent with one decimal, 0 for nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.bround(part / whole * 100, 1))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def device_unit(unit: Column) -> Column:
    """A drive unit number in words: FFxx floppies, 00xx hard disks."""
    high, low = F.shiftright(unit, 8).bitwiseAND(F.lit(255)), unit.bitwiseAND(F.lit(255))
    return (
        F.when((high == 255) & (low < 26), F.concat(F.lit("Floppy "), F.char(low + 65), F.lit(":")))
        .when(high == 255, F.concat(F.lit("Floppy unit "), low.cast("string")))
        .when(high == 0, F.concat(F.lit("HD unit "), low.cast("string")))
        .otherwise(F.format_string("Device 0x%04X", unit))
    )


def volume_letter(index: Column) -> Column:
    """Volumes 0 to 23 as C: to Z:, others by number."""
    return F.when(index < 24, F.concat(F.char(index + 67), F.lit(":"))).otherwise(F.concat(F.lit("Volume "), index.cast("string")))


#: Fixed texts of the image types.
TYPE_LABELS = {"floppy": "Victor 9000 Floppy", "ibmpc": "IBM PC Floppy", "harddisk": "Victor 9000 Hard Disk", "cpm": "Victor 9000 CP/M"}


def type_label(kind: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in TYPE_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(labels, kind), F.lit("Unknown"))
