"""Images for tests, made by the kernel; damaged ones by changing their bytes."""

import struct
import zlib

from diskloom.operators import kernel

DATE, TIME = 11 << 9 | 2 << 5 | 3, 4 << 11 | 5 << 5 | 3
FILES = {"COMMAND.COM": 5000, "MSDOS.SYS": 2048, "CONFIG.SYS": 500, "EMPTY.TXT": 0, "README": 2049}


def body(name: str, size: int) -> bytes:
    return (f"TEST_DATA_PATTERN_{name}_".encode() * (size // 10 + 1))[:size]


def floppy(family="victor_floppy", variant="double", label=None) -> bytearray:
    data = kernel.blank(family, variant, label)
    volume = kernel.volumes(data, "floppy" if family == "victor_floppy" else "ibmpc")[0]
    for name, size in FILES.items():
        volume.write_file([name], body(name, size), DATE, TIME)
    for depth in range(1, 4):
        volume.make_directory([f"D{i}" for i in range(1, depth + 1)], DATE, TIME)
        volume.write_file([*(f"D{i}" for i in range(1, depth + 1)), "DEEP.TXT"], body("DEEP", 700 * depth), DATE, TIME)
    return data


def hard_disk() -> bytearray:
    """Two volumes and one whose label is of no known type; more than 2 MiB."""
    data = bytearray(5000 * 512)
    struct.pack_into("<HH", data, 0, 1, 1)
    data[4:20] = b"SERIAL".ljust(16, b"\0")
    at = 52
    for count in (1, 1):
        data[at] = count
        at += 1 + 8 * count
    starts = [8, 1500, 3000]
    data[at] = len(starts)
    struct.pack_into("<3I", data, at + 1, *starts)
    for i, (start, kind) in enumerate(zip(starts, (1, 7, 2))):
        base = start * 512
        struct.pack_into("<H", data, base, kind)
        data[base + 2 : base + 18] = f"VOL{i}".encode().ljust(16, b"\0")
        struct.pack_into("<IIHHH", data, base + 30, 1400, 0, 512, 4, 64)
        data[base + 60] = 2
        struct.pack_into("<4H", data, base + 61, 0xFF00, 0, 0x0001, 1)
        fat = 1  # a first entry lets the scan find the directory behind two table copies
        root = base + (1 + 2 * fat) * 512
        data[base + 512 : base + 515] = data[base + 1024 : base + 1027] = b"\xf8\xff\xff"
        data[root : root + 32] = kernel.Entry(f"VOL{i}".ljust(8), "   ", kernel.VOLUME).write()
    for volume in kernel.volumes(data, "harddisk"):
        volume.write_file(["BOOT.SYS"], body("BOOT", 3000), DATE, TIME)
    return data


def cpm() -> bytearray:
    data = bytearray(b"\xe5" * (1224 * 512))
    data[0] = 0xFF
    volume = kernel.CpmVolume(data)
    volume.write_file("HELLO.CMD", body("HELLO", 300))
    volume.write_file("BIG.DAT", body("BIG", 40000), 5)
    volume.write_file("NONE.TXT", b"", 5)
    return data


def chd(content: bytes, codec: bytes = b"", hunk: int = 4096) -> bytes:
    """A container of stored hunks, or of hunks compressed one after another."""
    count = -(-len(content) // hunk)
    codecs = (codec or b"\0\0\0\0") + bytes(12)
    head = b"MComprHD" + struct.pack(">II", 124, 5) + codecs + struct.pack(">QQQII", len(content), 124 if not codec else 124, 0, hunk, 512) + bytes(60)
    padded = content.ljust(count * hunk, b"\0")
    if not codec:
        first = 1 + (124 + 4 * count) // hunk
        table = struct.pack(f">{count}I", *(first + i for i in range(count)))
        return (head + table).ljust(first * hunk, b"\0") + padded
    first = hunk
    body_ = b"".join(zlib.compress(padded[i : i + hunk]).ljust(hunk, b"\0") for i in range(0, len(padded), hunk))
    return (head + struct.pack(">I", 0) + first.to_bytes(6, "big") + bytes(6)).ljust(first, b"\0") + body_
