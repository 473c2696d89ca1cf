"""Column functions, value by value."""

import pytest
from pyspark.sql import functions as F

from diskloom.functions import binary, display, names, stamps


def values(spark, kind, items, make):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


@pytest.mark.parametrize("pattern,name,expected", [("*.COM", "command.com", True), ("*.*", "README", False), ("*.*", "A.B", True), ("?.TXT", "AB.TXT", False), ("*", "X", True), ("A(B)*", "A(B).C", True), ("*.", "A", False), ("F?LE.*", "FILE.C", True)])
def test_glob(spark, pattern, name, expected):
    assert values(spark, "string", [name], lambda x: names.glob(x, pattern)) == [expected]


def test_filters(spark):
    assert values(spark, "string", ["ABC", "XBX"], lambda x: names.list_filter(x, "bc")) == [True, False]
    assert values(spark, "string", ["ABC", "XBX"], lambda x: names.list_filter(x, "a*")) == [True, False]
    assert values(spark, "string", ["A*", "AB"], names.has_wildcards) == [True, False]


def test_names(spark):
    assert values(spark, "string", ["a.b", "FILE.", ".", "A.B.C", "TOOLONGNAME", "x y", "É", " pad "], names.is_valid_name) == [True, True, False, False, False, True, False, True]
    assert [tuple(x) if x else None for x in values(spark, "string", ["a.b", "FILE.", "A.B.C"], names.padded_name)] == [("A       ", "B  "), ("FILE    ", "   "), None]
    long = ["a.long.name.text", "verylongname", "short.txt", "averylongname.c"]
    assert values(spark, "string", long, lambda x: names.truncated_name(x, "copy")) == ["A.LONG.N.TEX", "VERYLONG", "SHORT.TXT", "AVERYLON.C"]
    assert values(spark, "string", long, lambda x: names.truncated_name(x, "tree")) == ["A.LONG.N.TEX", "VERYLONGNAME", "SHORT.TXT", "AVERYLON.C"]
    assert values(spark, "string", ["\\a/b\\\\C", "", None], names.path_parts) == [["A", "B", "C"], [], []]
    assert values(spark, "string", ["A \t", "B\x1c", "C\xa0"], names.strip_right) == ["A", "B", "C"]


@pytest.mark.parametrize("spec,expected", [
    ("disk.img:\\FILE.COM", ("disk.img", None, "FILE.COM")), ("hd.img:0:\\FILE.COM", ("hd.img", 0, "FILE.COM")), ("hd.img:1:\\D\\F", ("hd.img", 1, "D\\F")), ("hd.img:0:", ("hd.img", 0, None)), ("hd.img", ("hd.img", None, None)),
    ("d.chd:0:\\F", ("d.chd", 0, "F")), ("img:0", (None, None, "img:0")), ("d.img:0x", (None, None, "d.img:0x")), ("d.img:0\\p", ("d.img", 0, "p")), ("d.img:", ("d.img", None, None)), ("d.img:\\", ("d.img", None, None)),
    ("d.img:F.TXT", ("d.img", None, "F.TXT")), ("/home/x.txt", (None, None, "/home/x.txt")), ("D.IMA:\\A", ("D.IMA", None, "A")), ("d.img:12:F", ("d.img", 12, "F")),
])
def test_path_spec(spark, spec, expected):
    assert [tuple(x) for x in values(spark, "string", [spec], names.path_spec)] == [expected]


def test_attributes(spark):
    assert values(spark, "int", [0, 0x08, 0x3F, 0x21], names.attribute_string) == ["-", "-", "RHSDA", "RA"]
    assert values(spark, "int", [0, 0x27], names.attribute_mask) == ["----", "RHSA"]
    assert values(spark, "int", [0, 0x18], names.attribute_words) == ["None", "Volume Label, Directory"]
    assert values(spark, "int", [0x20], lambda x: names.apply_attributes(x, F.array(F.lit("+R"), F.lit("-a"), F.lit("?S"), F.lit("+")))) == [1]


def test_stamps(spark):
    day, time = 11 << 9 | 2 << 5 | 3, 4 << 11 | 5 << 5 | 3
    assert values(spark, "int", [day, 0, 11 << 9], lambda x: stamps.stamp_text(x, F.lit(time))) == ["1991-02-03 04:05", "", "1991-00-00 04:05"]
    assert [str(x) for x in values(spark, "int", [day, 0, 11 << 9], lambda x: stamps.stamp(x, F.lit(time)))] == ["1991-02-03 04:05:06", "None", "None"]


def test_sizes(spark):
    items = [0, 1023, 1024, 1280, 1331, 1 << 20, 1310720, (1 << 30) * 3]
    wanted = lambda n: f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB" if n < 1 << 30 else f"{n / (1 << 30):.1f} GB"
    assert values(spark, "long", items, display.size_text) == [wanted(n) for n in items]
    assert values(spark, "long", [1000, 1023], lambda x: display.size_text(x, "status")) == ["1,000 bytes", "1,023 bytes"]
    assert values(spark, "int", [0xFF00, 0xFF1F, 0x0002, 0x1234], display.device_unit) == ["Floppy A:", "Floppy unit 31", "HD unit 2", "Device 0x1234"]
    assert values(spark, "int", [0, 23, 24], display.volume_letter) == ["C:", "Z:", "Volume 24"]
    assert values(spark, "string", ["floppy", "x"], display.type_label) == ["Victor 9000 Floppy", "Unknown"]


def test_numbers(spark):
    data = [bytearray(b"\x01\x02\x03\x04\xff\xff\xff\xff"), bytearray(b"\x05")]
    assert values(spark, "binary", data, lambda x: binary.u16(x, 0)) == [0x0201, 5]
    assert values(spark, "binary", data, lambda x: binary.u32(x, 4)) == [0xFFFFFFFF, 0]
    assert values(spark, "binary", data, lambda x: binary.u32_big(x, 0)) == [0x01020304, 0x05000000]
    assert values(spark, "binary", [bytearray(b"A\xe9")], binary.ascii_replaced) == ["A�"]
    table = [bytearray(b"\xf8\xff\xff\x03\x40\x00")]
    assert [values(spark, "binary", table, lambda x: binary.fat12(x, F.lit(c)))[0] for c in (0, 1, 2, 3, 9)] == [0xFF8, 0xFFF, 0x003, 0x004, 0]
