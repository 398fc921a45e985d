"""Partition tables (MBR with its extended chain, GPT) and file system detection, from images as rows."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validate import u

SECTOR = 512
COLUMNS = "image_id string, table string, entry int, type string, guid string, name string, start long, length long, bootable boolean, status string"


def gpt(d: memoryview, at: int) -> list[tuple] | None:
    """Entries of the GPT whose header is at this byte, or None when its checksums fail."""
    n = u(d, at + 12, 4)
    head = bytes(d[at : at + n])
    if head[:8] != b"EFI PART" or n < 92 or zlib.crc32(head[:16] + b"\0" * 4 + head[20:]) != u(d, at + 16, 4):
        return None
    first, count, size = u(d, at + 72, 8) * SECTOR, u(d, at + 80, 4), u(d, at + 84, 4)
    if count > 4096 or size < 128 or zlib.crc32(d[first : first + count * size]) != u(d, at + 88, 4):
        return None
    rows = []
    for k in range(count):
        e = d[first + k * size : first + (k + 1) * size]
        if any(e[:16]):
            a, b = u(e, 32, 8), u(e, 40, 8)
            name = bytes(e[56:128]).decode("utf-16-le", "replace").split("\0")[0]
            rows.append(("gpt", k + 1, str(uuid.UUID(bytes_le=bytes(e[:16]))), str(uuid.UUID(bytes_le=bytes(e[16:32]))), name, a * SECTOR, (b - a + 1) * SECTOR, False, "active"))
    return rows


def mbr(d: memoryview, size: int) -> list[tuple]:
    """Primary entries, and the logical ones of the extended chain (at most 128)."""
    if bytes(d[510:512]) != b"\x55\xaa":
        return []
    rows, logical = [], 5
    for k in range(4):
        e = d[446 + 16 * k : 462 + 16 * k]
        kind, start, length = e[4], u(e, 8, 4) * SECTOR, u(e, 12, 4) * SECTOR
        if not kind or not length or e[0] not in (0, 0x80):
            continue
        rows.append(("mbr", k + 1, f"0x{kind:02x}", "", "", start, length, e[0] == 0x80, "active" if start + length <= size else "damaged"))
        if kind in (0x05, 0x0F, 0x85):
            at, seen = start, set()
            while at not in seen and len(seen) < 128 and bytes(d[at + 510 : at + 512]) == b"\x55\xaa":
                seen.add(at)
                one, two = d[at + 446 : at + 462], d[at + 462 : at + 478]
                if one[4] and u(one, 12, 4):
                    rows.append(("mbr", logical, f"0x{one[4]:02x}", "", "", at + u(one, 8, 4) * SECTOR, u(one, 12, 4) * SECTOR, False, "logical"))
                    logical += 1
                if not two[4] or not u(two, 8, 4):
                    break
                at = start + u(two, 8, 4) * SECTOR
    return rows


def partitions(images: DataFrame, id_col: str = "image_id", data_col: str = "data") -> DataFrame:
    """Rows of the partition table of each image: GPT (main, else backup copy) before MBR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 3, pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for batch in batches:
            for image, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                d = memoryview(data or b"")
                rows = gpt(d, SECTOR)
                if rows is None:
                    rows = gpt(d, len(d) - SECTOR) if len(d) > 2 * SECTOR else None
                    rows = [(*r[:-1], "recovered") for r in rows] if rows is not None else mbr(d, len(d))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(image, *r) for r in rows], strict=True), types, strict=True)], names=names)

    return images.select(F.col(id_col).cast("string"), F.col(data_col)).mapInArrow(run, COLUMNS)


# Place and bytes of file system signatures; the first that matches wins.
FILESYSTEMS = (
    ("ntfs", 3, b"NTFS    "),
    ("exfat", 3, b"EXFAT   "),
    ("fat32", 82, b"FAT32   "),
    ("fat16", 54, b"FAT16   "),
    ("fat12", 54, b"FAT12   "),
    ("xfs", 0, b"XFSB"),
    ("btrfs", 65600, b"_BHRfS_M"),
    ("f2fs", 1024, b"\x10\x20\xf5\xf2"),
    ("hfsplus", 1024, b"H+"),
    ("hfsx", 1024, b"HX"),
    ("hfs", 1024, b"BD"),
    ("apfs", 32, b"NXSB"),
    ("squashfs", 0, b"hsqs"),
    ("cramfs", 0, b"E=\xcd("),
    ("romfs", 0, b"-rom1fs-"),
    ("iso9660", 32769, b"CD001"),
    ("reiserfs", 65588, b"ReIsEr"),
    ("jfs", 32768, b"JFS1"),
    ("ufs2", 65536 + 1372, b"\x19\x01\x54\x19"),
    ("ufs", 8192 + 1372, b"\x54\x19\x01\x00"),
)


def detected(data: Column) -> Column:
    """File system of an image by its signatures; ext by its feature bits."""
    at = lambda offset, magic: F.substring(data, offset + 1, len(magic)) == F.lit(magic)
    word = lambda offset: F.conv(F.hex(F.reverse(F.substring(data, offset + 1, 4))), 16, 10).cast("long")
    out = F.when(F.lit(False), "")
    for name, offset, magic in FILESYSTEMS:
        out = out.when(at(offset, magic), name)
    ext = at(1080, b"\x53\xef")
    out = out.when(ext & ((word(1024 + 96).bitwiseAND(0x2C0) != 0) | (word(1024 + 100).bitwiseAND(0xD8) != 0)), "ext4")
    return out.when(ext & (word(1024 + 92).bitwiseAND(4) != 0), "ext3").when(ext, "ext2").otherwise("unknown")
