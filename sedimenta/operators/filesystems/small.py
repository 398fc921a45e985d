"""Read-only file systems with simple trees: cramfs, romfs, ISO 9660."""

from __future__ import annotations

import calendar
import struct
from collections.abc import Iterator

from .records import Record, driver

KINDS = {0x4000: "dir", 0x8000: "file", 0xA000: "link"}


@driver("cramfs")
def cramfs(d: memoryview) -> Iterator[Record]:
    """Inodes of 12 bytes with the name behind; files are zlib blocks of 4096 bytes (codec cramfs: extents hold the block table)."""
    base = next((a for a in (0, 512) if bytes(d[a : a + 4]) == b"\x45\x3d\xcd\x28"), None)
    if base is None:
        return

    def inode(at: int) -> tuple[int, int, int, int]:
        mode, _, size_gid, rest = struct.unpack_from("<HHII", d, at)
        return mode, size_gid & 0xFFFFFF, rest & 63, (rest >> 6) * 4

    stack, seen = [(base + 64, None, "")], set()
    while stack:
        at, parent, name = stack.pop()
        if at in seen or at + 12 > len(d):
            continue
        seen.add(at)
        mode, size, _, offset = inode(at)
        kind = KINDS.get(mode & 0xF000, "other")
        extents, table = [], base + offset
        if kind in ("file", "link") and size and offset:
            blocks = -(-size // 4096)
            if table + 4 * blocks <= len(d):
                extents = [(table, struct.unpack_from("<I", d, table + 4 * (blocks - 1))[0] + base - table)]
        yield Record(at, parent, name, kind, False, size, mode, None, extents, None, "cramfs" if extents else None)
        if kind == "dir" and offset:
            child, end = base + offset, base + offset + size
            while child + 12 <= min(end, len(d)):
                n = inode(child)[2] * 4
                stack.append((child, at, bytes(d[child + 12 : child + 12 + n]).rstrip(b"\0").decode("utf-8", "replace")))
                child += 12 + n


def cramfs_data(d: memoryview, table: int, size: int, base: int = 0) -> bytes:
    """A cramfs file: each pointer is the end of its block, an empty block is zeros."""
    import zlib

    blocks, out = -(-size // 4096), []
    at = table + 4 * blocks
    for k in range(blocks):
        end, n = base + struct.unpack_from("<I", d, table + 4 * k)[0], min(4096, size - 4096 * k)
        out.append(zlib.decompress(d[at:end]) if end > at else bytes(n))
        at = end
    return b"".join(out)


@driver("romfs")
def romfs(d: memoryview) -> Iterator[Record]:
    """Headers of 16 bytes on 16-byte bounds: next and type, info, size, checksum; then the name and the data."""
    if bytes(d[:8]) != b"-rom1fs-":
        return

    def after_name(at: int) -> int:
        end = bytes(d[at : at + 4096]).find(b"\0")
        return at + (end // 16 + 1) * 16 if end >= 0 else len(d)

    kinds = {1: "dir", 2: "file", 3: "link"}
    root = after_name(16)
    yield Record(root, None, "", "dir")
    stack, seen = [(root, root)], set()
    while stack:
        at, parent = stack.pop()
        while at and at + 16 <= len(d) and at not in seen:
            seen.add(at)
            following, info, size, _ = struct.unpack_from(">4I", d, at)
            name = bytes(d[at + 16 : at + 4112]).split(b"\0")[0].decode("utf-8", "replace")
            kind = kinds.get(following & 7, "other")
            if name not in (".", "..") and following & 7:
                start = after_name(at + 16)
                yield Record(at, parent, name, kind, False, size, following & 8, None, [(start, size)] if size and kind in ("file", "link") else [])
            if kind == "dir" and name not in (".", "..") and info:
                stack.append((info & ~15, at))
            at = following & ~15


@driver("iso9660")
def iso9660(d: memoryview) -> Iterator[Record]:
    """The Joliet tree where there is one, else the primary one with Rock Ridge names; the id is the byte of the entry."""
    volumes = []
    for k in range(16, 64):
        v = bytes(d[k * 2048 : k * 2048 + 2048])
        if v[1:6] != b"CD001" or v[0] == 255:
            break
        if v[0] in (1, 2):
            volumes.append((v[0] == 2 and v[88:91] in (b"%/@", b"%/C", b"%/E"), v))
    if not volumes:
        return
    joliet, v = max(volumes, key=lambda x: x[0])
    block = struct.unpack_from("<H", v, 128)[0] or 2048
    extent, size = struct.unpack_from("<I", v, 158)[0], struct.unpack_from("<I", v, 166)[0]
    yield Record(0, None, "", "dir")
    stack, seen = [(0, extent * block, size)], set()
    while stack:
        parent, start, length = stack.pop()
        if start in seen:
            continue
        seen.add(start)
        at, end, extents, whole = start, min(start + length, len(d)), [], 0
        while at < end:
            n = d[at]
            if n < 34:
                at = start + ((at - start) // 2048 + 1) * 2048  # entries do not reach over sectors
                continue
            e = bytes(d[at : at + n])
            first, bytes_, flags, m = struct.unpack_from("<I", e, 2)[0], struct.unpack_from("<I", e, 10)[0], e[25], e[32]
            raw = e[33 : 33 + m]
            if raw not in (b"\0", b"\1"):
                name = raw.decode("utf-16-be", "replace") if joliet else rock_ridge(e[33 + m + (m + 1) % 2 :]) or raw.decode("latin-1")
                if not joliet or ";" in name:
                    name = name.split(";")[0].rstrip(".") if ";" in name else name
                extents.append((first * block, bytes_))
                whole += bytes_
                if not flags & 0x80:  # else the file goes on in the next entry
                    folder, t = bool(flags & 2), e[18:25]
                    mtime = float(calendar.timegm((1900 + t[0], t[1], t[2], t[3], t[4], t[5])) - 900 * struct.unpack("b", t[6:7])[0]) if 1 <= t[1] <= 12 and t[2] else None
                    yield Record(at, parent, name, "dir" if folder else "file", False, 0 if folder else whole, flags, mtime, extents)
                    if folder:
                        stack.append((at, first * block, bytes_))
                    extents, whole = [], 0
            at += n


def rock_ridge(area: bytes) -> str:
    """The name in NM fields, if any."""
    out, at = b"", 0
    while at + 4 <= len(area) and area[at + 2] >= 4:
        if area[at : at + 2] == b"NM":
            out += area[at + 5 : at + area[at + 2]]
        at += area[at + 2]
    return out.decode("utf-8", "replace")
