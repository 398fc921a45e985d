"""FAT12, FAT16 and FAT32: chains of clusters, long names, deleted entries."""

from __future__ import annotations

import calendar
import struct
from collections.abc import Iterator

from .records import Record, driver

ROOT = 2


class Volume:
    def __init__(self, d: memoryview) -> None:
        b = bytes(d[:512])
        if len(b) < 512:
            raise ValueError("no boot sector")
        self.d = d
        self.sector, self.per_cluster, reserved, tables, self.root_entries, total16 = struct.unpack_from("<HBHBHH", b, 11)
        fat16 = struct.unpack_from("<H", b, 22)[0]
        total = total16 or struct.unpack_from("<I", b, 32)[0]
        fat = fat16 or struct.unpack_from("<I", b, 36)[0]
        if self.sector not in (512, 1024, 2048, 4096) or not self.per_cluster or not 0 < tables <= 4 or not fat or not total or not reserved:
            raise ValueError("no FAT volume")
        self.fat_at = reserved * self.sector
        self.root_at = self.fat_at + tables * fat * self.sector
        self.data_at = self.root_at + -(-self.root_entries * 32 // self.sector) * self.sector
        self.cluster = self.sector * self.per_cluster
        self.clusters = max(0, (total * self.sector - self.data_at) // self.cluster)
        self.bits = 12 if self.clusters < 4085 else 16 if self.clusters < 65525 else 32
        self.root_cluster = struct.unpack_from("<I", b, 44)[0] if self.bits == 32 else 0

    def next(self, c: int) -> int:
        """The cluster after this one; 0 at the end of the chain or where it breaks."""
        at = self.fat_at + (c * 3 // 2 if self.bits == 12 else c * self.bits // 8)
        raw = int.from_bytes(self.d[at : at + (2 if self.bits < 32 else 4)], "little")
        if self.bits == 12:
            raw = raw >> 4 if c & 1 else raw & 0xFFF
        raw &= 0x0FFFFFFF
        return raw if 2 <= raw < self.clusters + 2 else 0

    def chain(self, c: int, most: int) -> list[tuple[int | None, int]]:
        """Extents of a chain of at most ``most`` clusters, neighbours joined."""
        out: list[tuple[int | None, int]] = []
        seen: set[int] = set()
        while 2 <= c < self.clusters + 2 and c not in seen and len(seen) < most:
            seen.add(c)
            at = self.data_at + (c - 2) * self.cluster
            if out and out[-1][0] + out[-1][1] == at:
                out[-1] = out[-1][0], out[-1][1] + self.cluster
            else:
                out.append((at, self.cluster))
            c = self.next(c)
        return out


def seconds(date: int, time: int) -> float | None:
    """Of the packed date and time, taken as UTC."""
    year, month, day = 1980 + (date >> 9), date >> 5 & 15, date & 31
    if not 1 <= month <= 12 or not 1 <= day <= 31:
        return None
    return float(calendar.timegm((year, month, day, time >> 11, time >> 5 & 63, (time & 31) * 2)))


def short_name(e: bytes) -> str:
    base, ext = e[:8], e[8:11]
    base = b"\xe5" + base[1:] if base[:1] == b"\x05" else b"_" + base[1:] if base[:1] == b"\xe5" else base
    base, ext = (p.decode("cp437").rstrip(" ") for p in (base, ext))
    if e[12] & 0x08:
        base = base.lower()
    if e[12] & 0x10:
        ext = ext.lower()
    return f"{base}.{ext}" if ext else base


def entries(v: Volume, spans: list[tuple[int | None, int]]) -> Iterator[tuple[int, bytes, str]]:
    """(place, entry, name) of a directory; long names stand before their entry, also before a deleted one."""
    long: list[str] = []
    for start, length in spans:
        for at in range(start, start + length, 32):
            e = bytes(v.d[at : at + 32])
            if len(e) < 32 or not e[0]:
                return
            if e[11] & 0x3F == 0x0F:
                if e[0] != 0xE5 and e[0] & 0x40:
                    long = []
                long.append((e[1:11] + e[14:26] + e[28:32]).decode("utf-16-le", "replace").split("\0")[0].rstrip("￿"))
                continue
            if not e[11] & 0x08:
                yield at, e, "".join(reversed(long)) or short_name(e)
            long = []


@driver("fat12", "fat16", "fat32", "vfat")
def fat(d: memoryview) -> Iterator[Record]:
    """Files below the root; the id of a record is the byte of its entry. A deleted file is taken to lie in one piece."""
    try:
        v = Volume(d)
    except (ValueError, struct.error):
        return
    root = v.chain(v.root_cluster, v.clusters) if v.bits == 32 else [(v.root_at, v.root_entries * 32)]
    yield Record(ROOT, None, "", "dir")
    stack, seen = [(ROOT, root, False)], {v.root_cluster}
    while stack:
        parent, spans, gone_above = stack.pop()
        for at, e, name in entries(v, spans):
            if e[:2] in (b". ", b".."):
                continue
            gone = gone_above or e[0] == 0xE5
            first = struct.unpack_from("<H", e, 26)[0] | (struct.unpack_from("<H", e, 20)[0] << 16 if v.bits == 32 else 0)
            size, time, date = struct.unpack_from("<I", e, 28)[0], *struct.unpack_from("<HH", e, 22)
            folder = bool(e[11] & 0x10)
            if gone:
                extents = [(v.data_at + (first - 2) * v.cluster, size if not folder else v.cluster)] if 2 <= first < v.clusters + 2 else []
            else:
                extents = v.chain(first, v.clusters if folder else -(-size // v.cluster))
            yield Record(at, parent, name, "dir" if folder else "file", gone, 0 if folder else size, e[11], seconds(date, time), extents)
            if folder and extents and first not in seen:
                seen.add(first)
                stack.append((at, extents, gone))
