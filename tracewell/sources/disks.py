"""File systems inside raw disk images: partitions, FAT, exFAT and NTFS records, live and deleted.

An image is a bytes object; each function reads what it needs of it. Damaged structures end a walk.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

RECORD = 1024
MAX_DEPTH = 64
MEDIA = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp", ".heic", ".heif", ".avif", ".cr2", ".nef", ".arw", ".dng", ".orf", ".rw2", ".raf", ".mp4", ".mov", ".avi", ".3gp", ".mkv")


def partitions(image: bytes) -> list[tuple[int, int]]:
    """(start, length) by GPT, else MBR, else the whole image."""
    if len(image) >= 1024 and image[512:520] == b"EFI PART":
        table, n, size = struct.unpack_from("<QII", image, 512 + 72)
        found = []
        for i in range(min(n, (len(image) - table * 512) // max(size, 128))):
            entry = image[table * 512 + i * size :][:size]
            if len(entry) >= 48 and any(entry[:16]):
                first, last = struct.unpack_from("<QQ", entry, 32)
                found.append((first * 512, (last - first + 1) * 512))
        if found:
            return found
    if image[510:512] == b"\x55\xaa" and image[3:11] not in (b"EXFAT   ", b"NTFS    ") and image[54:57] != b"FAT" and image[82:85] != b"FAT":
        rows = [struct.unpack_from("<B3xB3xII", image, 446 + 16 * i) for i in range(4)]
        found = [(start * 512, n * 512) for boot, kind, start, n in rows if kind and n and boot in (0, 0x80) and start * 512 < len(image)]
        if found:
            return found
    return [(0, len(image))]


class Fat:
    """A FAT12, FAT16 or FAT32 volume."""

    def __init__(self, volume: bytes):
        self.volume = volume
        self.bps, self.spc, self.reserved, self.fats, self.roots, small, _, per16 = struct.unpack_from("<HBHBHHBH", volume, 11)
        total32, per32 = struct.unpack_from("<II", volume, 32)
        self.root = struct.unpack_from("<I", volume, 44)[0]
        per, total = per16 or per32, small or total32
        if not (self.bps and self.spc and self.fats and per and total) or self.bps & (self.bps - 1) or volume[510:512] != b"\x55\xaa":
            raise ValueError("no FAT")
        self.fat_at, self.root_at = self.reserved * self.bps, (self.reserved + self.fats * per) * self.bps
        first = self.reserved + self.fats * per + -(-self.roots * 32 // self.bps)
        self.data_at, clusters = first * self.bps, (total - first) // self.spc
        if clusters <= 0:
            raise ValueError("no FAT")
        self.kind = 12 if clusters < 4085 else 16 if clusters < 65525 else 32
        self.size = self.bps * self.spc

    def place(self, cluster: int) -> int:
        return self.data_at + (cluster - 2) * self.size

    def following(self, cluster: int) -> int:
        if self.kind == 12:
            (x,) = struct.unpack_from("<H", self.volume, self.fat_at + cluster * 3 // 2)
            return x >> 4 if cluster & 1 else x & 0xFFF
        if self.kind == 16:
            return struct.unpack_from("<H", self.volume, self.fat_at + cluster * 2)[0]
        return struct.unpack_from("<I", self.volume, self.fat_at + cluster * 4)[0] & 0x0FFFFFFF

    def chain(self, cluster: int) -> bytes:
        parts, seen = [], set()
        while 2 <= cluster < {12: 0xFF0, 16: 0xFFF0, 32: 0x0FFFFFF0}[self.kind] and cluster not in seen:
            seen.add(cluster)
            parts.append(self.volume[self.place(cluster) :][: self.size])
            cluster = self.following(cluster)
        return b"".join(parts)

    def files(self, directory: bytes | None = None, path: str = "", depth: int = 0, seen: set[int] | None = None) -> Iterator[tuple]:
        """(path, size, deleted, cluster) of all files but deleted ones of size 0; a directory that a damaged volume names again is walked once."""
        seen = set() if seen is None else seen
        if directory is None:
            directory = self.chain(self.root) if self.kind == 32 else self.volume[self.root_at :][: self.roots * 32]
        if depth > MAX_DEPTH:
            return
        long: list[tuple[int, str]] = []
        for at in range(0, len(directory) - 31, 32):
            entry = directory[at : at + 32]
            if entry[0] == 0:
                return
            attributes = entry[11]
            if attributes == 0x0F:
                if entry[0] != 0xE5:
                    long.append((entry[0] & 0x1F, (entry[1:11] + entry[14:26] + entry[28:32]).decode("utf-16-le", "replace").split("\0")[0].rstrip("￿")))
                continue
            name, long = "".join(p for _, p in sorted(long)), []
            if attributes & 0x08:
                continue
            deleted = entry[0] == 0xE5
            if deleted or not name:
                base = (b"_" + entry[1:8] if deleted else entry[:8]).decode("latin-1").rstrip()
                tail = entry[8:11].decode("latin-1").rstrip()
                name = f"{base}.{tail}" if tail else base
            high, low, size = *struct.unpack_from("<H", entry, 20), *struct.unpack_from("<HI", entry, 26)
            cluster = high << 16 | low
            if attributes & 0x10:
                if not deleted and entry[0] != 0x2E and cluster not in seen:
                    seen.add(cluster)
                    yield from self.files(self.chain(cluster), f"{path}{name}/", depth + 1, seen)
            elif size or not deleted:
                yield f"{path}{name}", size, deleted, cluster

    def read(self, cluster: int, size: int, deleted: bool) -> bytes | None:
        """A live file along its chain, a deleted one from adjacent clusters; null if cut short."""
        found = self.volume[self.place(cluster) :][:size] if deleted else self.chain(cluster)[:size]
        return found if cluster >= 2 and len(found) == size > 0 else None


class ExFat:
    """An exFAT volume; only deleted files are listed."""

    def __init__(self, volume: bytes):
        if volume[3:11] != b"EXFAT   ":
            raise ValueError("no exFAT")
        self.volume = volume
        self.bps = 1 << volume[0x6C]
        self.size = self.bps << volume[0x6D]
        fat, _, heap, _, self.root = struct.unpack_from("<IIIII", volume, 0x50)
        self.fat_at, self.heap_at = fat * self.bps, heap * self.bps

    def place(self, cluster: int) -> int:
        return self.heap_at + (cluster - 2) * self.size

    def chain(self, cluster: int) -> bytes:
        parts, seen = [], set()
        while 2 <= cluster < 0xFFFFFFF7 and cluster not in seen and self.place(cluster) < len(self.volume):
            seen.add(cluster)
            parts.append(self.volume[self.place(cluster) :][: self.size])
            (cluster,) = struct.unpack_from("<I", self.volume, self.fat_at + cluster * 4)
        return b"".join(parts)

    def files(self, cluster: int | None = None, path: str = "", depth: int = 0, seen: set[int] | None = None) -> Iterator[tuple]:
        seen = set() if seen is None else seen
        directory = self.chain(self.root if cluster is None else cluster)
        at = 0
        while at + 32 <= len(directory) and depth <= MAX_DEPTH:
            kind = directory[at]
            if kind == 0:
                return
            if kind & 0x7F != 0x05:
                at += 32
                continue
            n = directory[at + 1]
            parts = [directory[at + 32 * (i + 1) :][:32] for i in range(n)]
            stream = next((p for p in parts if len(p) == 32 and p[0] & 0x7F == 0x40), None)
            raw = b"".join(p[2:32] for p in parts if len(p) == 32 and p[0] & 0x7F == 0x41)
            if stream:
                name = raw.decode("utf-16-le", "replace")[: stream[3]]
                start, size = struct.unpack_from("<IQ", stream, 20)
                if struct.unpack_from("<H", directory, at + 4)[0] & 0x10:
                    if kind & 0x80 and start not in seen:
                        seen.add(start)
                        yield from self.files(start, f"{path}{name}/", depth + 1, seen)
                elif not kind & 0x80 and size:
                    yield f"{path}{name}", size, True, start
            at += 32 * (n + 1)

    def read(self, cluster: int, size: int, deleted: bool = True) -> bytes | None:
        found = self.volume[self.place(cluster) :][:size]
        return found if cluster >= 2 and len(found) == size > 0 else None


def fixed_up(record: bytes) -> bytes | None:
    """An NTFS record with its sector ends restored; null if they don't hold the update number."""
    at, n = struct.unpack_from("<HH", record, 4)
    out, mark = bytearray(record), record[at : at + 2]
    for i in range(1, n):
        end = i * 512
        if end > len(out) or out[end - 2 : end] != mark:
            return None
        out[end - 2 : end] = record[at + 2 * i : at + 2 * i + 2]
    return bytes(out)


def attributes(record: bytes) -> Iterator[tuple[int, bytes, bool, str]]:
    """(type, attribute, resident, name)."""
    (at,) = struct.unpack_from("<H", record, 0x14)
    while at + 16 <= len(record):
        kind, size = struct.unpack_from("<II", record, at)
        if kind == 0xFFFFFFFF or size < 16 or at + size > len(record):
            return
        a = record[at : at + size]
        name = a[struct.unpack_from("<H", a, 10)[0] :][: a[9] * 2].decode("utf-16-le", "replace")
        yield kind, a, not a[8], name
        at += size


def file_name(record: bytes) -> str | None:
    """The name that isn't a DOS alias."""
    for kind, a, resident, _ in attributes(record):
        if kind == 0x30 and resident:
            start = struct.unpack_from("<H", a, 20)[0]
            if a[start + 65] != 2:
                return a[start + 66 :][: a[start + 64] * 2].decode("utf-16-le", "replace")
    return None


def runs(raw: bytes) -> Iterator[tuple[int | None, int]]:
    """(first cluster, clusters) of a run list; None for a sparse run."""
    at = cluster = 0
    while at < len(raw) and raw[at]:
        n, m = raw[at] & 15, raw[at] >> 4
        length = int.from_bytes(raw[at + 1 : at + 1 + n], "little")
        if m:
            cluster += int.from_bytes(raw[at + 1 + n : at + 1 + n + m], "little", signed=True)
        yield cluster if m else None, length
        at += 1 + n + m


def ntfs_data(volume: bytes, record: bytes, cluster_size: int) -> bytes | None:
    """The unnamed data of a record, deleted or not; null if compressed, encrypted or cut short."""
    whole = fixed_up(record)
    if whole is None or whole[:4] != b"FILE":
        return None
    for kind, a, resident, name in attributes(whole):
        if kind != 0x80 or name:
            continue
        if struct.unpack_from("<H", a, 12)[0] & 0x4001:
            return None
        if resident:
            size, start = struct.unpack_from("<IH", a, 16)
            return a[start : start + size]
        start, size = struct.unpack_from("<H", a, 32)[0], struct.unpack_from("<Q", a, 48)[0]
        out = bytearray()
        for cluster, n in runs(a[start:]):
            part = bytes(n * cluster_size) if cluster is None else volume[cluster * cluster_size :][: n * cluster_size]
            if len(part) < min(n * cluster_size, size - len(out)):
                return None
            out += part
        return bytes(out[:size]) if len(out) >= size else None
    return None


def ntfs_files(volume: bytes) -> Iterator[tuple]:
    """(name, size, deleted, record number) of the file records of an NTFS volume."""
    if volume[3:11] != b"NTFS    ":
        return
    bps, spc = struct.unpack_from("<HB", volume, 11)
    cluster_size = bps * spc
    mft = struct.unpack_from("<Q", volume, 48)[0] * cluster_size
    first = fixed_up(volume[mft : mft + RECORD])
    table = volume[mft:] if first is None else (ntfs_data(volume, volume[mft : mft + RECORD], cluster_size) or volume[mft:])
    for number in range(len(table) // RECORD):
        record = table[number * RECORD : (number + 1) * RECORD]
        if record[:4] != b"FILE" or (whole := fixed_up(record)) is None:
            continue
        flags = struct.unpack_from("<H", whole, 0x16)[0]
        name = file_name(whole)
        if flags & 2 or name is None or name.startswith("$"):
            continue
        size = next((struct.unpack_from("<I", a, 16)[0] if r else struct.unpack_from("<Q", a, 48)[0] for k, a, r, n in attributes(whole) if k == 0x80 and not n), 0)
        yield name, size, not flags & 1, number


def media_files(image: bytes, extensions: tuple[str, ...] = MEDIA) -> list[tuple]:
    """(partition, filesystem, path, size, deleted, reference) over all partitions; the reference is a record number or first cluster.

    Deleted NTFS names that are live in this or an earlier partition are left out.
    """
    out, live = [], set()
    for number, (start, length) in enumerate(partitions(image)):
        volume = image[start : start + length]
        if volume[3:11] == b"NTFS    ":
            kind, found = "NTFS", list(ntfs_files(volume))
            live |= {p.lower() for p, _, deleted, _ in found if not deleted}
            found = [f for f in found if not (f[2] and f[0].lower() in live)]
        else:
            found = None
            for kind, reader in (("exFAT", ExFat), ("FAT", Fat)):
                try:
                    found = list(reader(volume).files())
                    break
                except (ValueError, struct.error, IndexError):
                    continue
        out += [(number, kind, *f) for f in found or () if f[0].lower().endswith(extensions)]
    return out
