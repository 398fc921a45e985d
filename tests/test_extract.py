"""Extraction, codecs and superblocks on bytes made here."""

import random
import struct
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from sedimenta.operators import extract
from sedimenta.sources import images


def squeezed(data):
    """A plain LZNT1 writer: the longest match in the chunk, else a literal."""
    out = b""
    for a in range(0, len(data), 4096):
        chunk, body, at, items = data[a : a + 4096], b"", 0, []
        while at < len(chunk):
            width = 12
            while at and (at - 1) >> (16 - width):
                width -= 1
            best = (0, 0)
            for back in range(1, min(at, 1 << (16 - width)) + 1):
                n = 0
                while n < (1 << width) + 2 and at + n < len(chunk) and chunk[at + n] == chunk[at + n - back]:
                    n += 1
                best = max(best, (n, -back))
            if best[0] >= 3:
                items.append((1, struct.pack("<H", (-best[1] - 1) << width | best[0] - 3)))
                at += best[0]
            else:
                items.append((0, chunk[at : at + 1]))
                at += 1
        for k in range(0, len(items), 8):
            body += bytes([sum(f << i for i, (f, _) in enumerate(items[k : k + 8]))]) + b"".join(b for _, b in items[k : k + 8])
        out += struct.pack("<H", 0xB000 | len(body) - 1) + body if len(body) < 4096 else struct.pack("<H", 0x3000 | len(chunk) - 1) + chunk
    return out


@pytest.mark.parametrize("data", [b"", b"abc", b"ab" * 900, bytes(5000), random.Random(1).randbytes(4500), b"".join(b"line %d of text\n" % (k % 37) for k in range(120))])
def test_lznt1_round_trip(data):
    assert extract.lznt1(squeezed(data)) == data


def test_codecs(spark):
    body = b"some text " * 50
    raw = zlib.compressobj(wbits=-15)
    rows = [(1, "zlib", zlib.compress(body) + b"\0" * 9), (2, "deflate", raw.compress(body) + raw.flush()), (3, "zstd", zstandard.compress(body)), (4, "lznt1", squeezed(body)), (5, None, body), (6, "lzma", body), (7, "zlib", b"damaged"), (8, "zlib", None)]
    got = {r.k: r.decoded for r in extract.decoded(spark.createDataFrame(rows, "k int, codec string, data binary")).collect()}
    assert {k: v and bytes(v) for k, v in got.items()} == {k: body for k in range(1, 6)} | {6: None, 7: None, 8: None}


def test_objects_from_extents(spark):
    data = random.Random(5).randbytes(1000)
    chunks = images.chunks(spark.createDataFrame([("i", bytearray(data))], "image_id string, data binary"), 64, 8)
    rows = [("i", 1, 0, 100, 300, False, 420), ("i", 1, 1, 0, 50, True, 420), ("i", 1, 2, 10, 100, False, 420), ("i", 2, 0, 64, 64, False, 64), ("i", 3, 0, 990, 30, False, 30), ("i", 4, 0, 0, 0, False, 0), ("none", 5, 0, 0, 4, False, 4)]
    extents = spark.createDataFrame(rows, "image_id string, object_id int, ordinal int, start long, length long, sparse boolean, logical_size long")
    got = {r.object_id: bytes(r.data) for r in extract.materialised(extents, chunks, 64).collect()}
    assert got == {1: (data[100:400] + bytes(50) + data[10:110])[:420], 2: data[64:128], 3: data[990:] + bytes(20), 4: b"", 5: bytes(4)}


def test_superblock(spark):
    block = bytearray(512)
    struct.pack_into("<II", block, 0, 0xA92B4EFC, 1)
    block[16:32] = bytes(range(16))
    struct.pack_into("<iIQII", block, 72, 5, 2, 9999, 128, 4)
    struct.pack_into("<Q", block, 128, 2048)
    struct.pack_into("<I", block, 160, 3)
    struct.pack_into("<4H", block, 256, 0, 1, 0xFFFF, 2)
    rows = spark.createDataFrame([(1, bytearray(4096) + block), (2, block), (3, bytearray(9000)), (4, bytearray(b"")), (5, None)], "k int, d binary")
    got = [r[0] for r in rows.orderBy("k").select(extract.superblock(F.col("d"))).collect()]
    assert got[0] == got[1] == (5, 65536, 4, 2, 1 << 20, bytes(range(16)).hex()) and got[2:] == [None] * 3


def test_paths_of_any_depth_with_cycles_and_orphans(spark):
    from sedimenta.operators import graph

    rows = [(k, k - 1 if k else None, f"n{k}") for k in range(300)] + [(1000, 1001, "a"), (1001, 1000, "b"), (1002, 1001, "c"), (2000, 9999, "o"), (2001, 2000, "p"), (3000, 3000, "self")]
    got = dict(map(tuple, graph.path_closure(spark.createDataFrame(rows, "id long, parent_id long, name string"), []).collect()))
    assert got[299] == "/".join(f"n{k}" for k in range(300)) and len(got) == len(rows)
    assert (got[1000], got[1001], got[1002]) == ("$cycles/a", "$cycles/b", "$cycles/c")
    assert (got[2000], got[2001], got[3000]) == ("$orphans/o", "o/p", "self")
    rooted = dict(map(tuple, graph.path_closure(spark.createDataFrame(rows, "id long, parent_id long, name string"), [1001, 150]).collect()))
    assert rooted[1002] == "b/c" and rooted[152] == "n150/n151/n152"


def test_cut_off_chunks_are_damaged():
    from sedimenta.operators import extract

    assert extract.decode("lznt1", b"\x05\x30ab") is None and extract.decode("lznt1", b"\x01\x30ab") == b"ab"


def test_superblocks_at_the_end(spark):
    import struct

    one, old = bytearray(300_000), bytearray(300_000)
    at = (300_000 - 8192) // 4096 * 4096
    struct.pack_into("<II", one, at, 0xA92B4EFC, 1)
    one[at + 16 : at + 32] = bytes(range(16))
    struct.pack_into("<I", one, at + 72, 5)
    struct.pack_into("<II", one, at + 88, 128, 4)
    struct.pack_into("<I", one, at + 160, 2)
    struct.pack_into("<H", one, at + 256 + 4, 3)
    at = 300_000 // 65536 * 65536 - 65536
    struct.pack_into("<3I", old, at, 0xA92B4EFC, 0, 90)
    for k, v in ((5, 0x11223344), (7, 0), (10, 2), (13, 1), (14, 2), (15, 3), (65, 65536), (995, 1)):
        struct.pack_into("<I", old, at + 4 * k, v)
    rows = spark.createDataFrame([(1, bytes(one)), (2, bytes(old)), (3, b"short")], "k int, d binary")
    got = [r[0] and tuple(r[0]) for r in rows.orderBy("k").select(extract.superblock(F.col("d"))).collect()]
    assert got == [(5, 65536, 4, 3, 0, bytes(range(16)).hex()), (0, 65536, 2, 1, 0, "11223344000000010000000200000003"), None]


def test_guid_and_utf16(spark):
    import uuid

    from sedimenta.functions import scalar

    g = uuid.UUID("e3c9e316-0b5c-4db8-817d-f92df00215ae")
    r = spark.createDataFrame([(g.bytes_le, "né\0x".encode("utf-16-le"))], "a binary, b binary").select(scalar.guid(F.col("a")), scalar.utf16(F.col("b"))).first()
    assert r[0].lower() == str(g) and r[1] == "né"
