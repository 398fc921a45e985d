"""ext2, ext3 and ext4: inodes of all groups, names from all directories, deleted ones too."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from .records import Record, driver

EXTENTS, INLINE, HASHED = 0x80000, 0x10000000, 0x1000
KINDS = {0x4000: "dir", 0x8000: "file", 0xA000: "link"}


class Volume:
    """Geometry of a volume from its superblock."""

    def __init__(self, d: memoryview) -> None:
        self.d = d
        sb = bytes(d[1024:2048])
        if len(sb) < 1024 or sb[56:58] != b"\x53\xef":
            raise ValueError("no ext superblock")
        self.inodes, blocks, _, _, _, self.first_block, log = struct.unpack_from("<7I", sb)
        self.block = 1024 << min(log, 6)
        per_group, _, self.per_group = struct.unpack_from("<3I", sb, 32)
        dynamic = struct.unpack_from("<I", sb, 76)[0] > 0
        self.inode_size = struct.unpack_from("<H", sb, 88)[0] if dynamic else 128
        incompat = struct.unpack_from("<I", sb, 96)[0]
        self.wide = bool(incompat & 0x80)
        self.descriptor = max(32, struct.unpack_from("<H", sb, 254)[0]) if self.wide else 32
        blocks |= struct.unpack_from("<I", sb, 336)[0] << 32 if self.wide else 0
        blocks = min(blocks, len(d) // self.block + 1)
        self.groups = -(-(blocks - self.first_block) // max(1, per_group))
        if not self.per_group or self.inode_size < 128:
            raise ValueError("damaged ext superblock")

    def at(self, block: int) -> memoryview:
        return self.d[block * self.block : (block + 1) * self.block]

    def table(self, group: int) -> int:
        """Byte of the inode table of a group."""
        g = bytes(self.d[(self.first_block + 1) * self.block + group * self.descriptor :][: self.descriptor])
        if len(g) < self.descriptor:
            return -1
        low = struct.unpack_from("<I", g, 8)[0]
        return (low | (struct.unpack_from("<I", g, 40)[0] << 32 if self.wide and self.descriptor >= 64 else 0)) * self.block

    def inode_rows(self) -> Iterator[tuple[int, bytes]]:
        for group in range(self.groups):
            start = self.table(group)
            if start <= 0:
                continue
            for k in range(self.per_group):
                raw = bytes(self.d[start + k * self.inode_size : start + (k + 1) * self.inode_size])
                if len(raw) < 128:
                    break
                if raw[:2] != b"\0\0":
                    yield group * self.per_group + k + 1, raw

    def extent_blocks(self, node: bytes, depth_left: int = 6) -> Iterator[tuple[int, int, int | None]]:
        """(logical block, blocks, physical block) of an extent tree; None where nothing was written."""
        if len(node) < 12 or node[:2] != b"\x0a\xf3" or not depth_left:
            return
        entries, _, depth = struct.unpack_from("<3H", node, 2)
        for k in range(entries):
            e = node[12 + 12 * k : 24 + 12 * k]
            if len(e) < 12:
                return
            if depth:
                _, low, high = struct.unpack_from("<IIH", e)
                yield from self.extent_blocks(bytes(self.at(low | high << 32)), depth_left - 1)
            else:
                first, n, high, low = struct.unpack_from("<IHHI", e)
                yield (first, n - 32768, None) if n > 32768 else (first, n, low | high << 32)

    def mapped_blocks(self, pointers: bytes, most: int) -> Iterator[tuple[int, int, int | None]]:
        """The same from 12 direct blocks and three of indirect ones."""
        n = self.block // 4

        def under(block: int, level: int, first: int) -> Iterator[tuple[int, int, int | None]]:
            if first >= most or not block:
                return
            if not level:
                yield first, 1, block
                return
            inner = bytes(self.at(block))
            for k in range(len(inner) // 4):
                yield from under(struct.unpack_from("<I", inner, 4 * k)[0], level - 1, first + k * n ** (level - 1))

        own = struct.unpack("<15I", pointers)
        for k in range(12):
            yield from under(own[k], 0, k)
        first = 12
        for level in (1, 2, 3):
            yield from under(own[11 + level], level, first)
            first += n**level

    def extents(self, raw: bytes, size: int) -> list[tuple[int | None, int]]:
        """(start, length) in order, holes with a start of None, neighbours joined."""
        flags, most = struct.unpack_from("<I", raw, 32)[0], -(-size // self.block)
        rows = self.extent_blocks(raw[40:100]) if flags & EXTENTS else self.mapped_blocks(raw[40:100], most)
        out: list[tuple[int | None, int]] = []
        at = 0
        for first, n, physical in sorted(rows, key=lambda r: r[0]):
            if first >= most or first < at:
                continue
            if first > at:
                out.append((None, (first - at) * self.block))
            n = min(n, most - first)
            if physical is not None and out and out[-1][0] is not None and out[-1][0] + out[-1][1] == physical * self.block:
                out[-1] = out[-1][0], out[-1][1] + n * self.block
            else:
                out.append((None if physical is None else physical * self.block, n * self.block))
            at = first + n
        if at < most:
            out.append((None, (most - at) * self.block))
        return out


def names_in(block: bytes, inodes: int, hashed: bool) -> Iterator[tuple[int, str, bool]]:
    """(inode, name, deleted) of a directory block; names in the gaps behind others were deleted."""
    at = 0
    while at + 8 <= len(block):
        inode, length, n = struct.unpack_from("<IHB", block, at)
        if length < 8 or length % 4 or at + length > len(block):
            return
        if inode and n and inode <= inodes:
            yield inode, block[at + 8 : at + 8 + n].decode("utf-8", "replace"), False
        gap, end = at + 8 + (-(-n // 4) * 4 if inode else 0), at + length
        if not inode and n and not hashed:
            gap = at  # the first name of the block was deleted
        while gap + 8 < end and not hashed:
            inode, length_, n = struct.unpack_from("<IHB", block, gap)
            name = block[gap + 8 : gap + 8 + n]
            if inode and inode <= inodes and n and gap + 8 + n <= end and length_ >= 8 + n and not length_ % 4 and not any(c < 32 or c == 47 for c in name):
                yield inode, name.decode("utf-8", "replace"), True
                gap += 8 + -(-n // 4) * 4
            else:
                gap += 4
        at += length


@driver("ext2", "ext3", "ext4")
def ext(d: memoryview) -> Iterator[Record]:
    """Every name of every inode; deleted inodes without a name are called inode_N."""
    try:
        v = Volume(d)
    except (ValueError, struct.error):
        return
    named: dict[int, list[tuple[int, str, bool]]] = {}
    for number, raw in v.inode_rows():
        mode, size = struct.unpack_from("<H", raw)[0], struct.unpack_from("<I", raw, 4)[0]
        if mode & 0xF000 != 0x4000:
            continue
        flags, block_no = struct.unpack_from("<I", raw, 32)[0], 0
        gone_folder = struct.unpack_from("<H", raw, 26)[0] == 0
        if flags & INLINE:
            blocks = [b"\0" * 4 + raw[44:100]]
        else:
            blocks = [bytes(d[a + k : a + k + v.block]) for a, n in v.extents(raw, size) if a is not None for k in range(0, n, v.block)]
        for block in blocks:
            for inode, name, gone in names_in(block[4:] if flags & INLINE else block, v.inodes, bool(flags & HASHED) and not block_no):
                if name not in (".", ".."):
                    named.setdefault(inode, []).append((number, name, gone or gone_folder))
            block_no += 1
    for number, raw in v.inode_rows():
        mode, links = struct.unpack_from("<H", raw)[0], struct.unpack_from("<H", raw, 26)[0]
        if number < 11 and number != 2:
            continue  # reserved for the file system itself
        size = struct.unpack_from("<I", raw, 4)[0] | (struct.unpack_from("<I", raw, 108)[0] << 32 if mode & 0xF000 == 0x8000 else 0)
        if size > 1 << 44:
            continue
        flags, kind = struct.unpack_from("<I", raw, 32)[0], KINDS.get(mode & 0xF000, "other")
        gone, inline, extents = links == 0, None, []
        if flags & INLINE or kind == "link" and size < 60 and not flags & EXTENTS:
            inline = raw[40 : 40 + min(size, 60)]
        elif kind in ("file", "dir", "link"):
            extents = v.extents(raw, size)
        mtime = float(struct.unpack_from("<I", raw, 16)[0])
        if number == 2:
            own = [(None, "", False)]
        else:
            own = named.get(number, [])
            live = [x for x in own if not x[2]]
            own = (own if gone else live) or [(None, f"inode_{number}", True)]
        for parent, name, _ in dict.fromkeys(own):
            yield Record(number, parent, name, kind, gone, size, mode, mtime, extents, inline)
