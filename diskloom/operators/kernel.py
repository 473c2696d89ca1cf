"""Decoding and editing of one image in memory, for use inside Arrow map functions.

An image is a few hundred kilobytes to some tens of megabytes, and what happens within it
depends on the order of visits (directory walks, first-fit allocation, ownership of
clusters).  So one image is one row, and this module works on its bytes alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from .integrity import Audit

SECTOR, SLOT = 512, 32
# Fixed values of the format: table entries and directory bytes.
FREE, BAD, LAST, DELETED, END = 0x000, 0xFF7, 0xFFF, 0xE5, 0x00
CHAIN_FIRST, CHAIN_LAST = 0x002, 0xFEF
READ_ONLY, HIDDEN, SYSTEM, VOLUME, DIRECTORY, ARCHIVE = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20
ALLOWED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&'()-@^_`{}~ ")
# Fixed layout of CP/M floppies.
CPM_BLOCKS, CPM_BLOCK, CPM_DATA, CPM_DIRECTORY_SECTORS, CPM_STEP = 556, 2048, 112, 18, 2
CPM_PLACES, CPM_DEFAULT, CPM_RECORD, CPM_EXTENT = (76, 94, 1), 76, 128, 16384
#: What can be wrong with a parameter block, in the order it is looked for.
BLOCK_FAULTS = ("The boot sector ends in %04X", "Sectors of %d bytes are not handled", "Clusters of %d sectors are not handled", "The number of tables is %d", "Tables have %d sectors")
_ENTRY = struct.Struct("<8s3sB2xHH4xHHHI")


class Problem(Exception):
    """Something about one image that cannot be done; it becomes an error row."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Entry:
    """A directory entry and where it is stored."""

    name: str
    extension: str
    attributes: int = 0
    create_time: int = 0
    create_date: int = 0
    modify_time: int = 0
    modify_date: int = 0
    first_cluster: int = 0
    file_size: int = 0
    at: int = -1  # byte offset of its slot in the image
    ordinal: int = 0

    @property
    def full_name(self) -> str:
        name, extension = self.name.rstrip(), self.extension.rstrip()
        return f"{name}.{extension}" if extension else name

    is_directory = property(lambda self: bool(self.attributes & DIRECTORY))
    is_dot = property(lambda self: self.name.startswith("."))

    @classmethod
    def read(cls, raw: bytes, at: int, ordinal: int) -> "Entry":
        name, extension, *rest = _ENTRY.unpack(raw)
        return cls(name.decode("latin-1"), extension.decode("latin-1"), *rest, at=at, ordinal=ordinal)

    def write(self) -> bytes:
        names = [x.encode("latin-1").ljust(n)[:n] for x, n in ((self.name, 8), (self.extension, 3))]
        return _ENTRY.pack(*names, self.attributes, self.create_time, self.create_date, self.modify_time, self.modify_date, self.first_cluster, self.file_size)


def name83(text: str) -> tuple[str, str]:
    """Name and extension padded to 8 and 3, or a problem."""
    whole = text.upper().strip()
    name, dot, extension = whole.rpartition(".") if "." in whole else (whole, "", "")
    if not name:
        raise Problem("invalid_filename", "Filename cannot be empty")
    if len(name) > 8 or len(extension) > 3:
        raise Problem("invalid_filename", f"{whole!r} exceeds 8.3 characters")
    if not ALLOWED.issuperset(name + extension):
        raise Problem("invalid_filename", f"Invalid character in {whole!r}")
    return name.ljust(8), extension.ljust(3)


def parts_of(path: str | None) -> list[str]:
    return [x.upper() for x in (path or "").replace("/", "\\").split("\\") if x]


@dataclass
class FatVolume:
    """A FAT12 volume: a floppy or one partition of a hard disk."""

    data: bytearray | bytes
    kind: str
    fat_start: int
    fat_sectors: int
    fat_copies: int
    dir_start: int
    dir_sectors: int
    data_start: int
    total_clusters: int
    sectors_per_cluster: int
    name: str = ""
    label_index: int = 0
    capacity: int = 0
    assignments: list[tuple[int, int]] = field(default_factory=list)

    filesystem = "FAT12"
    cluster_size = property(lambda self: self.sectors_per_cluster * SECTOR)

    # -- reading --

    def sectors(self, first: int, count: int) -> bytes:
        raw = bytes(self.data[first * SECTOR : (first + count) * SECTOR])
        return raw.ljust(count * SECTOR, b"\0")

    def __post_init__(self) -> None:
        self._table = bytearray(self.sectors(self.fat_start, self.fat_sectors))

    def entry(self, cluster: int) -> int:
        """The table's 12 bits of a cluster; 0 beyond the table."""
        at = cluster + cluster // 2
        if at + 1 >= len(self._table):
            return FREE
        word = self._table[at] | self._table[at + 1] << 8
        return word >> 4 if cluster & 1 else word & 0xFFF

    def chain(self, start: int) -> list[int]:
        """Clusters from ``start`` on; any value that names no cluster ends them."""
        found: list[int] = []
        seen: set[int] = set()
        while CHAIN_FIRST <= start <= CHAIN_LAST:
            if start in seen:
                raise Problem("corrupted", f"Circular cluster chain at {start}")
            seen.add(start)
            found.append(start)
            start = self.entry(start)
        return found

    def cluster_at(self, cluster: int) -> int:
        return (self.data_start + (cluster - 2) * self.sectors_per_cluster) * SECTOR

    def cluster(self, cluster: int) -> bytes:
        at = self.cluster_at(cluster)
        return bytes(self.data[at : at + self.cluster_size]).ljust(self.cluster_size, b"\0")

    def _areas(self, cluster: int | None) -> list[tuple[int, int]]:
        """Offset and size of the areas that hold a directory's slots."""
        if not cluster:
            return [(self.dir_start * SECTOR, self.dir_sectors * SECTOR)]
        return [(self.cluster_at(c), self.cluster_size) for c in self.chain(cluster)]

    def slots(self, cluster: int | None) -> Iterator[tuple[int, bytes]]:
        """Offset and bytes of every slot of a directory (None or 0: the root)."""
        for at, size in self._areas(cluster):
            raw = bytes(self.data[at : at + size]).ljust(size, b"\0")
            for i in range(0, size, SLOT):
                yield at + i, raw[i : i + SLOT]

    def directory(self, cluster: int | None) -> list[Entry]:
        """Live entries up to the first end mark, without deleted ones and volume labels."""
        found = []
        for ordinal, (at, raw) in enumerate(self.slots(cluster)):
            if raw[0] == END:
                break
            if raw[0] != DELETED and not raw[11] & VOLUME:
                found.append(Entry.read(raw, at, ordinal))
        return found

    def label(self) -> str:
        for _, raw in self.slots(None):
            if raw[0] == END:
                break
            if raw[0] != DELETED and raw[11] & VOLUME:
                return raw[:11].decode("latin-1").rstrip()
        return ""

    def resolve(self, parts: list[str]) -> tuple[int | None, Entry | None]:
        """Cluster of the directory and the entry that a path names (no entry: a directory)."""
        cluster: int | None = None
        for i, part in enumerate(parts):
            name, extension = name83(part)
            entry = next((e for e in self.directory(cluster) if (e.name, e.extension) == (name, extension)), None)
            if entry is None:
                raise Problem("not_found", f"Not found: {part}")
            if entry.is_directory:
                cluster = entry.first_cluster
            elif i + 1 < len(parts):
                raise Problem("not_found", f"Not a directory: {part}")
            else:
                return cluster, entry
        return cluster, None

    def read(self, entry: Entry) -> bytes:
        """A file's bytes; those of a chain that ends early are short."""
        if not entry.file_size or not entry.first_cluster:
            return b""
        return b"".join(self.cluster(c) for c in self.chain(entry.first_cluster))[: entry.file_size]

    def walk(self) -> Iterator[tuple[str, str, int, Entry | None, Problem | None]]:
        """``(path, parent, depth, entry, problem)`` in the order of visits, every directory once."""
        seen: set[int] = set()

        def visit(cluster: int | None, parent: str, depth: int) -> Iterator:
            try:
                entries = self.directory(cluster)
            except Problem as problem:
                yield parent, parent, depth, None, problem
                return
            for entry in entries:
                if entry.is_dot:
                    continue
                path = f"{parent}\\{entry.full_name}" if parent else entry.full_name
                again = entry.is_directory and entry.first_cluster in seen
                yield path, parent, depth, entry, Problem("corrupted", f"Circular directory {path}") if again else None
                if entry.is_directory and entry.first_cluster >= 2 and not again:
                    seen.add(entry.first_cluster)
                    yield from visit(entry.first_cluster, path, depth + 1)

        yield from visit(None, "", 0)

    def usage(self) -> tuple[int, int, int]:
        """Free, bad and used clusters."""
        values = [self.entry(c) for c in range(2, self.total_clusters + 2)]
        free, bad = values.count(FREE), values.count(BAD)
        return free, bad, len(values) - free - bad

    # -- integrity --

    def verify(self) -> tuple[list[tuple[str, str, str, int | None, str]], dict[str, int]]:
        """Findings in order, and counters (see :mod:`.integrity`)."""
        return Audit(self).run()

    # -- editing: every step checks before it changes anything --

    def _set(self, cluster: int, value: int) -> None:
        at = cluster + cluster // 2
        word = self._table[at] | self._table[at + 1] << 8
        word = (word & 0x000F) | value << 4 if cluster & 1 else (word & 0xF000) | value
        self._table[at : at + 2] = bytes((word & 255, word >> 8))

    def flush(self) -> None:
        """Write the table to all its copies."""
        for copy in range(self.fat_copies):
            self._put((self.fat_start + copy * self.fat_sectors) * SECTOR, self._table)

    def _put(self, at: int, raw: bytes) -> None:
        if at + len(raw) > len(self.data):
            self.data.extend(bytes(at + len(raw) - len(self.data)))
        self.data[at : at + len(raw)] = raw

    def _free(self, count: int, also: set[int] = frozenset()) -> list[int]:
        """The lowest ``count`` free clusters that the table can hold (``also``: about to be freed)."""
        last = min(self.total_clusters + 1, CHAIN_LAST, (len(self._table) - 2) * 2 // 3)
        found = [c for c in range(2, last + 1) if c in also or self.entry(c) == FREE][:count]
        if len(found) < count:
            raise Problem("disk_full", f"Need {count} clusters, only {len(found)} available")
        return found

    def _link(self, clusters: list[int]) -> None:
        for c, following in zip(clusters, [*clusters[1:], LAST]):
            self._set(c, following)

    def _slot(self, cluster: int | None) -> int | None:
        return next((at for at, raw in self.slots(cluster) if raw[0] in (END, DELETED)), None)

    def _parent(self, parts: list[str]) -> tuple[int | None, str, str]:
        if not parts:
            raise Problem("invalid_filename", "No path given")
        cluster, entry = self.resolve(parts[:-1])
        if entry is not None:
            raise Problem("not_found", f"Not a directory: {parts[-2]}")
        return cluster, *name83(parts[-1])

    def _find(self, parts: list[str]) -> Entry:
        cluster, name, extension = self._parent(parts)
        entry = next((e for e in self.directory(cluster) if (e.name, e.extension) == (name, extension)), None)
        if entry is None:
            raise Problem("not_found", f"Not found: {parts[-1]}")
        return entry

    def _place(self, cluster: int | None, also: set[int], count: int) -> tuple[int | None, list[int]]:
        """A slot for a new entry (None: in a new cluster, the first of those found) and ``count`` clusters."""
        slot = self._slot(cluster)
        if slot is None and not cluster:
            raise Problem("directory_full", "Root directory is full")
        return slot, self._free(count + (slot is None), also)

    def _grow(self, cluster: int, extra: int) -> int:
        last = self.chain(cluster)[-1]
        self._set(last, extra)
        self._set(extra, LAST)
        self._put(self.cluster_at(extra), bytes(self.cluster_size))
        return self.cluster_at(extra)

    def write_file(self, parts: list[str], content: bytes, date: int, time: int) -> None:
        """Write a file anew or over the one that is there; full disks change nothing."""
        cluster, name, extension = self._parent(parts)
        old = next((e for e in self.directory(cluster) if (e.name, e.extension) == (name, extension)), None)
        if old is not None and old.is_directory:
            raise Problem("is_directory", f"Is a directory: {parts[-1]}")
        freed = set(self.chain(old.first_cluster)) if old is not None else set()
        count = -(-len(content) // self.cluster_size)
        slot, clusters = (old.at, self._free(count, freed)) if old is not None else self._place(cluster, set(), count)
        for c in freed:
            self._set(c, FREE)
        if slot is None:
            slot = self._grow(cluster, clusters.pop(0))
        self._link(clusters)
        for i, c in enumerate(clusters):
            self._put(self.cluster_at(c), content[i * self.cluster_size : (i + 1) * self.cluster_size].ljust(self.cluster_size, b"\0"))
        self._put(slot, Entry(name, extension, ARCHIVE, time, date, time, date, clusters[0] if clusters else 0, len(content)).write())
        self.flush()

    def delete_file(self, parts: list[str]) -> None:
        entry = self._find(parts)
        if entry.is_directory:
            raise Problem("is_directory", f"Is a directory: {parts[-1]}")
        self._drop(entry)
        self.flush()

    def _drop(self, entry: Entry) -> None:
        for c in self.chain(entry.first_cluster):
            self._set(c, FREE)
        self.data[entry.at] = DELETED

    def make_directory(self, parts: list[str], date: int, time: int) -> None:
        """Make a directory; one that is there already stays as it is."""
        cluster, name, extension = self._parent(parts)
        old = next((e for e in self.directory(cluster) if (e.name, e.extension) == (name, extension)), None)
        if old is not None:
            if old.is_directory:
                return
            raise Problem("exists", f"A file is in the way: {parts[-1]}")
        slot, clusters = self._place(cluster, set(), 1)
        if slot is None:
            slot = self._grow(cluster, clusters.pop(0))
        own = clusters[0]
        self._set(own, LAST)
        first = [Entry(n, "   ", DIRECTORY, time, date, time, date, c).write() for n, c in ((".       ", own), ("..      ", cluster or 0))]
        self._put(self.cluster_at(own), b"".join(first).ljust(self.cluster_size, b"\0"))
        self._put(slot, Entry(name, extension, DIRECTORY, time, date, time, date, own).write())
        self.flush()

    def remove_directory(self, parts: list[str], recursive: bool = False) -> None:
        entry = self._find(parts)
        if not entry.is_directory:
            raise Problem("not_directory", f"Not a directory: {parts[-1]}")
        if not recursive and any(not e.is_dot for e in self.directory(entry.first_cluster)):
            raise Problem("not_empty", f"Directory is not empty: {parts[-1]}")

        def drop(e: Entry, above: frozenset[int]) -> None:
            if e.is_directory and e.first_cluster in above:
                raise Problem("corrupted", "Circular directory")
            if e.is_directory:
                for child in self.directory(e.first_cluster):
                    if not child.is_dot:
                        drop(child, above | {e.first_cluster})
            self._drop(e)

        drop(entry, frozenset())
        self.flush()

    def change_attributes(self, parts: list[str], changes: list[str]) -> None:
        """Apply changes such as ``+R`` and ``-A`` in order; the directory bit stays."""
        entry = self._find(parts)
        now = entry.attributes
        for change in changes:
            bit = {"R": READ_ONLY, "H": HIDDEN, "S": SYSTEM, "A": ARCHIVE}.get(change[1:2].upper(), 0)
            now = now | bit if change[:1] == "+" else now & ~bit if change[:1] == "-" else now
        self.data[entry.at + 11] = (now & ~DIRECTORY) | (entry.attributes & DIRECTORY)

    def rename(self, parts: list[str], new: str) -> None:
        entry, cluster = self._find(parts), self._parent(parts)[0]
        name, extension = name83(new)
        if any((e.name, e.extension) == (name, extension) and e.at != entry.at for e in self.directory(cluster)):
            raise Problem("exists", f"Already exists: {new}")
        self._put(entry.at, (name + extension).encode("latin-1"))


@dataclass
class Extent:
    """A CP/M directory entry."""

    user: int
    name: str
    extension: str
    flags: tuple[bool, bool, bool]  # read-only, system, archive
    number: int
    records: int
    blocks: list[int]
    at: int


@dataclass
class CpmFile:
    user: int
    name: str
    extension: str
    extents: list[Extent]

    full_name = property(lambda self: f"{self.name}.{self.extension}" if self.extension else self.name)
    file_size = property(lambda self: (len(self.extents) - 1) * CPM_EXTENT + self.extents[-1].records * CPM_RECORD)


@dataclass
class CpmVolume:
    """A CP/M floppy: one flat directory, files in extents of blocks."""

    data: bytearray | bytes
    kind: str = "cpm"
    name: str = ""

    filesystem = "CP/M"

    def __post_init__(self) -> None:
        self.directory_sector = cpm_directory(self.data) or CPM_DEFAULT

    def slots(self) -> Iterator[tuple[int, bytes]]:
        for i in range(CPM_DIRECTORY_SECTORS):
            at = (self.directory_sector + i * CPM_STEP) * SECTOR
            raw = bytes(self.data[at : at + SECTOR])
            if len(raw) == SECTOR:  # sectors beyond the image are skipped
                for j in range(0, SECTOR, SLOT):
                    yield at + j, raw[j : j + SLOT]

    def extents(self) -> list[Extent]:
        found = []
        for at, raw in self.slots():
            plain = bytes(b & 0x7F for b in raw[1:12]).decode("ascii")
            if raw[0] > 15 or not plain[:8].strip() or not all(" " <= c < "\x7f" for c in plain):
                continue
            flags = tuple(bool(b & 0x80) for b in raw[9:12])
            blocks = [b for b in struct.unpack("<8H", raw[16:]) if b]
            found.append(Extent(raw[0], plain[:8], plain[8:], flags, raw[14] * 32 + raw[12], raw[15], blocks, at))
        return found

    def files(self) -> list[CpmFile]:
        """Files by user and name; the last extent gives the size, the first the attributes."""
        groups: dict[tuple[int, str, str], list[Extent]] = {}
        for x in self.extents():
            groups.setdefault((x.user, x.name.upper(), x.extension.upper()), []).append(x)
        files = [CpmFile(u, n.rstrip(), e.rstrip(), sorted(x, key=lambda y: y.number)) for (u, n, e), x in groups.items()]
        return sorted(files, key=lambda f: (f.user, f.full_name))

    def find(self, name: str, user: int | None = None) -> CpmFile:
        wanted = tuple(x.rstrip() for x in name83(name))
        for f in self.files():
            if (f.name, f.extension) == wanted and user in (None, f.user):
                return f
        raise Problem("not_found", f"File not found: {name}")

    def read(self, file: CpmFile) -> bytes:
        out = bytearray()
        for block in (b for x in file.extents for b in x.blocks):
            at = CPM_DATA * SECTOR + block * CPM_BLOCK
            raw = bytes(self.data[at : at + CPM_BLOCK])
            if len(raw) < CPM_BLOCK:
                raise Problem("disk_error", f"Failed to read block {block}")
            out += raw
        return bytes(out[: file.file_size])

    def free_blocks(self) -> list[int]:
        """Blocks that no extent names; block 0 is never given out, as pointer 0 means none."""
        used = {b for x in self.extents() for b in x.blocks}
        return [b for b in range(1, CPM_BLOCKS) if b not in used]

    def verify(self) -> tuple[list, dict[str, int]]:
        names = [f"{f.user}:{f.full_name}" for f in self.files()]
        again = sorted({n for n in names if names.count(n) > 1})
        return [("warning", "V13", n, None, f"Listed more than once: {n}") for n in again], {"files_checked": len(names)}

    def write_file(self, name: str, content: bytes, user: int = 0) -> None:
        """Write a file, over one of that name and user if there is one; full disks change nothing."""
        padded = name83(name)
        try:
            old = self.find(name, user).extents
        except Problem:
            old = []
        free = sorted(set(self.free_blocks()) | {b for x in old for b in x.blocks})
        many = max(1, -(-len(content) // CPM_BLOCK))
        blocks = free[:many]
        slots = [at for at, raw in self.slots() if raw[0] == DELETED or not any(raw) or at in {x.at for x in old}]
        groups = [blocks[i : i + 8] for i in range(0, many, 8)]
        if len(blocks) < many:
            raise Problem("disk_full", f"Need {many} blocks, only {len(free)} available")
        if len(slots) < len(groups):
            raise Problem("directory_full", "No free directory entries")
        for x in old:
            self.data[x.at] = DELETED
        for i, b in enumerate(blocks):
            at = CPM_DATA * SECTOR + b * CPM_BLOCK
            self.data[at : at + CPM_BLOCK] = content[i * CPM_BLOCK : (i + 1) * CPM_BLOCK].ljust(CPM_BLOCK, b"\x1a")
        records = max(1, -(-len(content) // CPM_RECORD))
        for i, group in enumerate(groups):
            held = min(128, records - 128 * i)
            raw = bytes((user,)) + "".join(padded).encode("ascii") + bytes((i % 32, 0, i // 32, held)) + struct.pack("<8H", *group, *[0] * (8 - len(group)))
            self.data[slots[i] : slots[i] + SLOT] = raw

    def delete_file(self, name: str, user: int | None = None) -> None:
        for x in self.find(name, user).extents:
            self.data[x.at] = DELETED

    def flush(self) -> None:
        """Nothing is held back."""


# ---- opening -----------------------------------------------------------------------------


def cpm_directory(data: bytes) -> int | None:
    """The sector where a CP/M directory begins, if one is found."""
    for sector in CPM_PLACES:
        raw = bytes(data[sector * SECTOR : (sector + 1) * SECTOR])
        if len(raw) == SECTOR:
            slots = [raw[i : i + SLOT] for i in range(0, 4 * SLOT, SLOT)]
            if sum((s[0] <= 15 or s[0] == DELETED) and all(32 <= b & 0x7F < 127 for b in s[1:9]) for s in slots) >= 2:
                return sector
    return None


def _u16(raw: bytes, at: int) -> int:
    return int.from_bytes(raw[at : at + 2], "little")


def _u32(raw: bytes, at: int) -> int:
    return int.from_bytes(raw[at : at + 4], "little")


def volumes(data: bytes | bytearray, kind: str) -> list[FatVolume | CpmVolume]:
    """The volumes of an image of a type: one, or the partitions of a hard disk."""
    boot = bytes(data[:SECTOR]).ljust(SECTOR, b"\0")
    if kind == "cpm":
        return [CpmVolume(data)]
    if kind == "floppy":
        double = _u16(boot, 32) & 1
        fat, root, start, clusters = (2, 5, 13, 2378) if double else (1, 3, 11, 1214)
        return [FatVolume(data, kind, 1, fat, 2, root, 8, _u16(boot, 28) or start, clusters, 4)]
    if kind == "ibmpc":
        return [_ibm(data, boot)]
    if kind == "harddisk":
        return _partitions(data)
    raise Problem("unknown_type", f"Unknown disk type: {kind}")


def _ibm(data: bytes, boot: bytes) -> FatVolume:
    per, reserved, copies, roots, fat = boot[0x0D], _u16(boot, 0x0E), boot[0x10], _u16(boot, 0x11), _u16(boot, 0x16)
    total = _u16(boot, 0x13) or _u32(boot, 0x20)
    wrong = (_u16(boot, 0x1FE) != 0xAA55, _u16(boot, 0x1FE)), (_u16(boot, 0x0B) != SECTOR, _u16(boot, 0x0B)), (per not in (1, 2, 4, 8), per), (not copies, copies), (not fat, fat)
    for (fault, value), text in zip(wrong, BLOCK_FAULTS):
        if fault:
            raise Problem("disk_error", text % value)
    root = reserved + copies * fat
    size = -(-roots * SLOT // SECTOR)
    name = "".join(chr(b) if b < 128 else "�" for b in boot[3:11]).strip()
    return FatVolume(data, "ibmpc", reserved, fat, copies, root, size, root + size, (total - root - size) // per, per, name, capacity=total)


def _partitions(data: bytes) -> list[FatVolume]:
    if len(data) < SECTOR:
        raise Problem("label_error", "Insufficient data for physical disk label")
    head = bytes(data[: 2 * SECTOR]).ljust(2 * SECTOR, b"\0")
    at = 52
    for _ in range(2):  # two lists of regions of eight bytes are passed over
        at += 1 + head[at] * 8
        if at >= len(head):
            raise Problem("label_error", "Physical disk label is cut off")
    if at + 1 + head[at] * 4 > len(head):
        raise Problem("label_error", "Physical disk label is cut off")
    starts = [_u32(head, at + 1 + 4 * i) for i in range(head[at])]
    found = []
    for index, start in enumerate(starts):
        raw = bytes(data[start * SECTOR : (start + 1) * SECTOR]).ljust(SECTOR, b"\0")
        if _u16(raw, 0) in (0x0000, 0x0001, 0x0002, 0xFFFF):  # others are not set up
            found.append(_partition(data, raw, start, index))
    return found


def _partition(data: bytes, raw: bytes, start: int, index: int) -> FatVolume:
    name = "".join(chr(b) if b < 128 else "�" for b in raw[2:18]).strip("\0").strip()
    boot_at, boot_size, capacity = _u32(raw, 18), _u16(raw, 24), _u32(raw, 30)
    per, entries = _u16(raw, 40) or 16, _u16(raw, 42) or 312
    assigned = [(_u16(raw, 61 + 4 * i), _u16(raw, 63 + 4 * i)) for i in range(min(raw[60], 16))]
    size = -(-entries // (SECTOR // SLOT))
    fat = _table_sectors(data, start, capacity, per)
    head = 1 + 2 * fat + size
    clusters = (capacity - head) // per
    if boot_at and boot_size:  # boot code at the end of the volume must stay
        clusters = min(clusters, (boot_at - head) // per)
    return FatVolume(data, "harddisk", start + 1, fat, 2, start + 1 + 2 * fat, size, start + head, clusters, per, name, index, capacity, assigned)


def _table_sectors(data: bytes, start: int, capacity: int, per: int) -> int:
    """Sectors of one table copy: the directory is looked for behind two copies."""
    most = max(1, -(-((capacity // per * 3 + 1) // 2) // SECTOR))
    for offset in range(1, min(most * 2 + 10, 100) + 1):
        at = (start + offset) * SECTOR
        if _like_directory(bytes(data[at : at + SLOT]).ljust(SLOT, b"\0")):
            return max(1, (offset - 1) // 2)
    return most


_NAME_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 !#$%&'()-@^_`{}~")


def _like_directory(raw: bytes) -> bool:
    if raw[0] in (0xF8, END) or raw[11] > 0x3F or raw[11] == 0x0F:
        return False
    return raw[0] == DELETED or (_NAME_BYTES | {0x2E}).issuperset(raw[:8]) and _NAME_BYTES.issuperset(raw[8:11])


# ---- new images --------------------------------------------------------------------------

# Fixed parameters of the formats: sectors, table sectors, root slots (or sectors), and for
# IBM floppies sectors a track, sectors a cluster and the media byte.
VICTOR_FORMATS = {"single": (1224, 1, 11, 0), "double": (2448, 2, 13, 1)}
IBM_FORMATS = {"360K": (720, 2, 112, 9, 2, 0xFD), "720K": (1440, 3, 112, 9, 2, 0xF9), "1.2M": (2400, 7, 224, 15, 1, 0xF9), "1.44M": (2880, 9, 224, 18, 1, 0xF0)}
FORMATS = [
    ("victor_floppy", "single", "Victor 9000, one side", "612 KiB", 1214),
    ("victor_floppy", "double", "Victor 9000, two sides", "1,224 KiB", 2378),
    ("ibm_floppy", "360K", "5.25 inch, double density", "360 KiB", None),
    ("ibm_floppy", "720K", "3.5 inch, double density", "720 KiB", None),
    ("ibm_floppy", "1.2M", "5.25 inch, high density", "1,200 KiB", None),
    ("ibm_floppy", "1.44M", "3.5 inch, high density", "1,440 KiB", None),
]


def blank(family: str, variant: str, label: str | None = None) -> bytearray:
    """A new empty image of a format."""
    boot = bytearray(SECTOR)
    boot[:3] = b"\xeb\x3c\x90"
    if family == "victor_floppy" and variant in VICTOR_FORMATS:
        sectors, fat, start, flags = VICTOR_FORMATS[variant]
        struct.pack_into("<HH", boot, 26, SECTOR, start)
        struct.pack_into("<HB", boot, 32, flags, 1)
        image, media, root = bytearray(sectors * SECTOR), 0xF8, 1 + 2 * fat
    elif family == "ibm_floppy" and variant in IBM_FORMATS:
        sectors, fat, slots, track, per, media = IBM_FORMATS[variant]
        boot[3:11] = b"MSDOS5.0"
        struct.pack_into("<HBHBHHBHHH", boot, 0x0B, SECTOR, per, 1, 2, slots, sectors, media, fat, track, 2)
        struct.pack_into("<BBBI", boot, 0x24, 0, 0, 0x29, 0x12345678)
        boot[0x2B:0x3E] = b"NO NAME    FAT12   "
        struct.pack_into("<H", boot, 0x1FE, 0xAA55)
        image, root = bytearray(sectors * SECTOR), 1 + 2 * fat
    else:
        raise Problem("unknown_format", f"Unknown format: {family} {variant}")
    image[:SECTOR] = boot
    for copy in range(2):
        image[(1 + copy * fat) * SECTOR : (1 + copy * fat) * SECTOR + 3] = bytes((media, 0xFF, 0xFF))
    if label:
        image[root * SECTOR : root * SECTOR + 12] = label.upper()[:11].ljust(11).encode("ascii") + bytes((VOLUME,))
    return image
