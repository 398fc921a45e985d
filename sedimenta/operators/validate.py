"""Validators: from the bytes at a signature to the object's size.

A positive result is the exact size, 0 means plausible but of unknown size, -1
rejects. Layouts are those that the formats' specifications give.
"""

from __future__ import annotations

import bz2
import lzma
import re
import struct
import zlib
from collections.abc import Callable

REGISTRY: dict[str, Callable[[memoryview], int]] = {}


def validator(f: Callable[[memoryview], int]) -> Callable[[memoryview], int]:
    REGISTRY[f.__name__] = f
    return f


def u(data: memoryview, at: int, n: int, order: str = "little") -> int:
    """An unsigned number, 0 beyond the end."""
    return int.from_bytes(data[at : at + n], order) if at >= 0 and at + n <= len(data) else 0


@validator
def png(d: memoryview) -> int:
    at = 8
    while at + 12 <= len(d):
        n, kind = u(d, at, 4, "big"), bytes(d[at + 4 : at + 8])
        if n > 1 << 30 or not kind.isalpha() or (at == 8) != (kind == b"IHDR"):
            return -1
        at += 12 + n
        if kind == b"IEND":
            return at
    return -1


@validator
def gif(d: memoryview) -> int:
    if len(d) < 13 or not u(d, 6, 2) or not u(d, 8, 2):
        return -1
    at = 13 + (3 * (2 << (d[10] & 7)) if d[10] & 0x80 else 0)

    def blocks(at: int) -> int:
        while at < len(d) and d[at]:
            at += d[at] + 1
        return at + 1

    while at < len(d):
        if d[at] == 0x3B:
            return at + 1
        if d[at] == 0x21:
            at = blocks(at + 2)
        elif d[at] == 0x2C and at + 10 <= len(d):
            at = blocks(at + 11 + (3 * (2 << (d[at + 9] & 7)) if d[at + 9] & 0x80 else 0))
        else:
            return -1
    return -1


@validator
def jpeg(d: memoryview) -> int:
    at = 2
    while at + 4 <= len(d):
        if d[at] != 0xFF:
            return -1
        m = d[at + 1]
        if m == 0xFF:
            at += 1
        elif m == 0xDA:  # entropy-coded data, up to a marker that is not a restart
            at += 2 + u(d, at + 2, 2, "big")
            rest = bytes(d[at:])
            k = 0
            while (k := rest.find(b"\xff", k)) >= 0 and k + 1 < len(rest) and (rest[k + 1] == 0 or 0xD0 <= rest[k + 1] <= 0xD7 or rest[k + 1] == 0xFF):
                k += 1 if rest[k + 1] == 0xFF else 2
            if k < 0 or k + 1 >= len(rest):
                return -1
            at += k
        elif m == 0xD9:
            return at + 2
        elif 0xC0 <= m <= 0xFE and m != 0xD8:
            at += 2 + u(d, at + 2, 2, "big")
        else:
            return -1
    return -1


@validator
def riff(d: memoryview) -> int:
    n = u(d, 4, 4) + 8
    return n + n % 2 if 12 < n <= len(d) else -1


@validator
def bmp(d: memoryview) -> int:
    n, start, head = u(d, 2, 4), u(d, 10, 4), u(d, 14, 4)
    return n if head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= start < n <= len(d) and not u(d, 6, 4) and u(d, 26, 2) == 1 else -1


@validator
def zip(d: memoryview) -> int:  # noqa: A001
    raw = bytes(d)
    at = 0
    while (at := raw.find(b"PK\x05\x06", at)) >= 0 and at + 22 <= len(raw):
        size, start = u(d, at + 12, 4), u(d, at + 16, 4)
        if start + size == at:
            return at + 22 + u(d, at + 20, 2)
        at += 4
    return -1


def _streams(d: memoryview, new: Callable, more: bytes) -> int:
    """Size of concatenated compressed streams, each decoded to its end."""
    at = 0
    while bytes(d[at : at + len(more)]) == more:
        tool, k = new(), at
        try:
            while not tool.eof and k < len(d):
                tool.decompress(bytes(d[k : k + (1 << 18)]))
                k += 1 << 18
        except (OSError, zlib.error, lzma.LZMAError, EOFError, ValueError):
            break
        if not tool.eof:
            break
        at = min(k, len(d)) - len(tool.unused_data)
    return at or -1


@validator
def gzip(d: memoryview) -> int:
    return _streams(d, lambda: zlib.decompressobj(31), b"\x1f\x8b\x08") if not d[3] & 0xE0 else -1


@validator
def bzip2(d: memoryview) -> int:
    return _streams(d, bz2.BZ2Decompressor, b"BZh") if len(d) > 10 and bytes(d[4:10]) in (b"1AY&SY", b"\x17rE8P\x90") else -1


@validator
def xz(d: memoryview) -> int:
    return _streams(d, lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ), b"\xfd7zXZ\x00")


@validator
def sevenzip(d: memoryview) -> int:
    if len(d) < 32 or zlib.crc32(d[12:32]) != u(d, 8, 4):
        return -1
    n = 32 + u(d, 12, 8) + u(d, 20, 8)
    return n if n <= len(d) else -1


@validator
def tar(d: memoryview) -> int:
    at, zeros = 0, 0
    while at + 512 <= len(d):
        block = bytes(d[at : at + 512])
        if not any(block):
            zeros, at = zeros + 1, at + 512
            if zeros == 2:
                return at
            continue
        if zeros or block[257:262] != b"ustar":
            break
        try:
            n, total = int(block[124:136].strip(b" \0") or b"0", 8), int(block[148:156].strip(b" \0"), 8)
        except ValueError:
            break
        if sum(block[:148]) + 256 + sum(block[156:]) != total:
            break
        at += 512 + -(-n // 512) * 512
    return at if at else -1


@validator
def ar(d: memoryview) -> int:
    at = 8
    while at + 60 <= len(d) and bytes(d[at + 58 : at + 60]) == b"`\n":
        try:
            n = int(bytes(d[at + 48 : at + 58]))
        except ValueError:
            break
        at += 60 + n + n % 2
    return at if 8 < at <= len(d) else -1


@validator
def cab(d: memoryview) -> int:
    n = u(d, 8, 4)
    return n if d[24:26] == b"\x03\x01" and 36 <= n <= len(d) and 36 <= u(d, 16, 4) < n else -1


@validator
def midi(d: memoryview) -> int:
    if u(d, 4, 4, "big") != 6 or u(d, 8, 2, "big") > 2:
        return -1
    at = 14
    for _ in range(u(d, 10, 2, "big")):
        if bytes(d[at : at + 4]) != b"MTrk":
            return -1
        at += 8 + u(d, at + 4, 4, "big")
    return at if 14 < at <= len(d) else -1


@validator
def sqlite(d: memoryview) -> int:
    page = u(d, 16, 2, "big")
    page = 65536 if page == 1 else page
    n = page * u(d, 28, 4, "big")
    return n if page >= 512 and not page & (page - 1) and d[21:24] == b"\x40\x20\x20" and 0 < n <= len(d) else -1


RTF_SIGN = re.compile(rb"\\bin(\d+) ?|\\.|[{}\0]", re.S)


@validator
def rtf(d: memoryview) -> int:
    """Up to the brace that closes the first; escaped braces, and the bytes that \\binN announces, are none."""
    depth, at, data = 0, 0, bytes(d)
    while m := RTF_SIGN.search(data, at):
        at = m.end()
        if m[1]:
            at += int(m[1][:10])
        elif m[0] == b"{":
            depth += 1
        elif m[0] == b"}":
            depth -= 1
            if depth <= 0:
                return at
        elif m[0] == b"\0":
            return -1
    return -1


@validator
def elf(d: memoryview) -> int:
    if len(d) < 52 or d[4] not in (1, 2) or d[5] not in (1, 2) or d[6] != 1:
        return -1
    order, wide = "<>"[d[5] - 1], d[4] == 2
    try:
        if wide:
            ph, sh, _, _, pe, pn, se, sn = struct.unpack_from(order + "QQIHHHHH", d, 32)
            segments = [struct.unpack_from(order + "IIQQQQ", d, ph + k * pe) for k in range(pn)]
            ends = [s[2] + s[5] for s in segments]
            sections = [struct.unpack_from(order + "IIQQQQ", d, sh + k * se) for k in range(sn)]
        else:
            ph, sh, _, _, pe, pn, se, sn = struct.unpack_from(order + "IIIHHHHH", d, 28)
            segments = [struct.unpack_from(order + "IIIIII", d, ph + k * pe) for k in range(pn)]
            ends = [s[1] + s[4] for s in segments]
            sections = [struct.unpack_from(order + "IIIIII", d, sh + k * se) for k in range(sn)]
    except struct.error:
        return -1
    n = max([0, sh + sn * se, ph + pn * pe, *ends, *(s[4] + s[5] for s in sections if s[1] != 8)])
    return n if 52 <= n <= len(d) else -1


@validator
def wasm(d: memoryview) -> int:
    if u(d, 4, 4) != 1:
        return -1
    at = 8
    while at < len(d) and d[at] <= 13:
        k, n, shift = at + 1, 0, 0
        while k < len(d) and shift < 35:
            n |= (d[k] & 0x7F) << shift
            shift, k = shift + 7, k + 1
            if not d[k - 1] & 0x80:
                break
        if not n or k + n > len(d):
            break
        at = k + n
    return at if at > 8 else -1


@validator
def iso(d: memoryview) -> int:
    if len(d) < 32768 + 132 or d[32768] != 1 or bytes(d[32769:32774]) != b"CD001":
        return -1
    n = u(d, 32768 + 80, 4) * u(d, 32768 + 128, 2)
    return n if 0 < n <= len(d) else -1
