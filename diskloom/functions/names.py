"""8.3 names, paths, wildcards and attributes as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attribute bits, and the characters a name may hold.
READ_ONLY, HIDDEN, SYSTEM, VOLUME, DIRECTORY, ARCHIVE = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20
NAME_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&'()-@^_`{}~ "
IMAGE_SUFFIXES = (".img", ".ima", ".dsk", ".chd")

_SPACES = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}]+"


def strip_right(text: Column) -> Column:
    """Text without white space (of any kind) at its end."""
    return F.regexp_replace(text, _SPACES + "$", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(strip_right(text), "^" + _SPACES, "")


def full_name(name: Column, extension: Column) -> Column:
    """Name and extension without padding, joined by a dot only if there is an extension."""
    ext = strip_right(extension)
    return F.when(ext != "", F.concat(strip_right(name), F.lit("."), ext)).otherwise(strip_right(name))


def _has(attributes: Column, bit: int) -> Column:
    return attributes.bitwiseAND(F.lit(bit)) != 0


def _letters(attributes: Column, letters: str, none: str) -> Column:
    bits = {"R": READ_ONLY, "H": HIDDEN, "S": SYSTEM, "D": DIRECTORY, "A": ARCHIVE}
    return F.concat(*(F.when(_has(attributes, bits[c]), c).otherwise(none) for c in letters))


def attribute_string(attributes: Column) -> Column:
    """Set attributes as letters RHSDA, ``-`` if there is none; volume labels are not shown."""
    text = _letters(attributes, "RHSDA", "")
    return F.when(text == "", "-").otherwise(text)


def attribute_mask(attributes: Column) -> Column:
    """Four places RHSA, each its letter or ``-``."""
    return _letters(attributes, "RHSA", "-")


def attribute_words(attributes: Column) -> Column:
    """Set attributes in words, ``None`` if there is none."""
    words = (("Read-Only", READ_ONLY), ("Hidden", HIDDEN), ("System", SYSTEM), ("Volume Label", VOLUME), ("Directory", DIRECTORY), ("Archive", ARCHIVE))
    text = F.concat_ws(", ", *(F.when(_has(attributes, bit), word) for word, bit in words))
    return F.when(text == "", "None").otherwise(text)


def apply_attributes(attributes: Column, changes: Column) -> Column:
    """Attributes after an array of changes such as ``+R`` and ``-A``, in order.

    Changes of one character, of another letter or without a sign do nothing.
    """

    def step(now: Column, change: Column) -> Column:
        letter, sign = F.upper(F.substring(change, 2, 1)), F.substring(change, 1, 1)
        bit = F.when(letter == "R", READ_ONLY).when(letter == "H", HIDDEN).when(letter == "S", SYSTEM).when(letter == "A", ARCHIVE).otherwise(0)
        return F.when(sign == "+", now.bitwiseOR(bit)).when(sign == "-", now.bitwiseAND(F.bitwise_not(bit))).otherwise(now)

    return F.aggregate(changes, attributes, step)


def is_valid_name(text: Column) -> Column:
    """Whether text is an 8.3 name: at most 8 and 3 allowed characters around the last dot."""
    kept = "[" + re.escape(NAME_CHARACTERS.replace("-", "")).replace("\\ ", " ") + "\\-]"
    return F.upper(strip(text)).rlike(f"^(?:{kept}{{1,8}}\\.{kept}{{0,3}}|{kept}{{1,8}})$")


def padded_name(text: Column) -> Column:
    """``struct(name, extension)`` padded with spaces to 8 and 3, null if not an 8.3 name."""
    whole = F.upper(strip(text))
    name = F.regexp_extract(whole, r"^([^.]*)", 1)
    extension = F.regexp_extract(whole, r"\.([^.]*)$", 1)
    return F.when(is_valid_name(text), F.struct(F.rpad(name, 8, " ").alias("name"), F.rpad(extension, 3, " ").alias("extension")))


def truncated_name(text: Column, rule: str = "copy") -> Column:
    """A host name cut to 8.3, by one of three rules.

    ``copy``: 8 and 3 characters around the last dot; ``tree``: the same, but only for names
    over 12 characters; ``paste``: the first 12 characters (``paste_dir``: the first 8).
    """
    upper = F.upper(text)
    around = F.when(
        F.contains(upper, F.lit(".")), F.concat(F.left(F.regexp_extract(upper, r"(?s)^(.*)\.([^.]*)$", 1), F.lit(8)), F.lit("."), F.left(F.regexp_extract(upper, r"(?s)^(.*)\.([^.]*)$", 2), F.lit(3)))
    ).otherwise(F.left(upper, F.lit(8)))
    if rule == "copy":
        return around
    if rule == "tree":
        return F.when(F.char_length(upper) > 12, around).otherwise(upper)
    return F.left(upper, F.lit(8 if rule == "paste_dir" else 12))


def path_parts(path: Column) -> Column:
    """Components of an internal path, upper case; both slashes part, empty ones go."""
    return F.filter(F.split(F.upper(F.coalesce(path, F.lit(""))), r"[\\/]"), lambda x: x != "")


def has_wildcards(pattern: Column) -> Column:
    return pattern.rlike(r"[*?]")


def glob_regex(pattern: str) -> str:
    """The anchored regular expression of a pattern with ``*`` and ``?``, upper case."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern.upper()) + "$"


def glob(name: Column, pattern: str) -> Column:
    """Whether a name matches a pattern, case-insensitively and as a whole."""
    return F.upper(name).rlike(glob_regex(pattern))


def matches(name: Column, pattern: str) -> Column:
    """A pattern with wildcards matches as one, any other by equality."""
    return glob(name, pattern) if re.search(r"[*?]", pattern) else F.upper(name) == pattern.upper()


def list_filter(name: Column, text: str) -> Column:
    """A list filter: a wildcard pattern, else any part of the name; an empty one keeps all."""
    if not text:
        return F.lit(True)
    return glob(name, text) if re.search(r"[*?]", text) else F.contains(F.upper(name), F.lit(text.upper()))


def path_spec(spec: Column) -> Column:
    """``struct(image, partition, path)`` of ``image[:partition][:path]``.

    The image ends at the first suffix .img, else .ima, .dsk or .chd in the last component
    that has one.  ``image:12x`` is no image; a spec without suffix is a host path.
    """
    lower = F.lower(spec)
    ends = [F.when(F.instr(lower, s) > 0, F.instr(lower, s) + len(s) - 1) for s in IMAGE_SUFFIXES]
    end = F.coalesce(*ends)
    image = F.left(spec, end)
    rest = F.substring(spec, end + 1, F.char_length(spec))
    after = F.regexp_extract(rest, r"(?s)^:(.*)$", 1)
    digits = F.regexp_extract(after, r"^(\d+)", 1)
    behind = F.regexp_extract(after, r"(?s)^\d+(.*)$", 1)
    wrong = (digits != "") & (behind != "") & ~behind.rlike(r"^[:\\/]")
    path = F.when(digits != "", F.regexp_replace(behind, r"^(?::[\\/]?|[\\/])", "")).otherwise(F.regexp_replace(after, r"^[\\/]", ""))
    none = F.lit(None)
    return (
        F.when(end.isNull() | (rest.startswith(":") & wrong), F.struct(none.cast("string").alias("image"), none.cast("int").alias("partition"), spec.alias("path")))
        .when(~rest.startswith(":"), F.struct(image.alias("image"), none.cast("int").alias("partition"), none.cast("string").alias("path")))
        .otherwise(F.struct(image.alias("image"), F.when(digits != "", digits.try_cast("int")).alias("partition"), F.when(path != "", path).alias("path")))
    )


def image_reference(spec: Column) -> Column:
    """``struct(image, partition)`` of an image path that may end in a colon and digits."""
    digits = F.regexp_extract(spec, r"(?s)^.+:(\d+)$", 1)
    return F.struct(F.when(digits != "", F.left(spec, F.char_length(spec) - F.char_length(digits) - 1)).otherwise(spec).alias("image"), F.when(digits != "", digits.try_cast("int")).alias("partition"))
