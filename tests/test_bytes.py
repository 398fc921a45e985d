"""Byte operators on images made here."""

import bz2
import gzip
import hashlib
import io
import lzma
import random
import struct
import tarfile
import uuid
import zipfile
import zlib

from pyspark.sql import functions as F

from sedimenta.functions import scalar
from sedimenta.operators import carve, catalog, intervals, partitions, raid


def png(rng):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rng.randbytes(200))) + chunk(b"IEND", b"")


def files():
    rng = random.Random(4)
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("a.txt", "hello " * 90)
        f.writestr("b.bin", rng.randbytes(300))
    with tarfile.open(fileobj=t, mode="w", format=tarfile.USTAR_FORMAT) as f:
        info = tarfile.TarInfo("x")
        info.size = 700
        f.addfile(info, io.BytesIO(rng.randbytes(700)))
    body = rng.randbytes(512)
    return {
        "png": png(rng),
        "gz": gzip.compress(rng.randbytes(500)) + gzip.compress(b"second member" * 20),
        "bz2": bz2.compress(rng.randbytes(500)),
        "xz": lzma.compress(rng.randbytes(500)),
        "zip": z.getvalue(),
        "tar": t.getvalue()[:2560],
        "wav": b"RIFF" + struct.pack("<I", 36 + 512) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 512) + body,
        "pdf": b"%PDF-1.4\n" + b"1 0 obj <<>> endobj\n" * 8 + b"%%EOF\n",
        "gif": b"GIF89a\x04\0\x04\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x04\0\x04\0\0\x02\x04\x84\x8f\x09\x05\0;",
        "rtf": b"{\\rtf1 " + b"some text \\{ and more " * 6 + b"}",
    }


def test_carved_objects_are_whole(spark):
    rng = random.Random(9)
    own = files()
    image = b"".join(b"\0" * 64 + bytes(rng.choice(b"qwertz") for _ in range(rng.randrange(512, 1024))) + b"\0" * 64 + f for f in own.values()) + b"\0" * 4096
    rows = carve.carve(spark.createDataFrame([("i", bytearray(image)), ("none", bytearray(b"")), ("null", None)], "image_id string, data binary")).collect()
    got = {r.md5: r for r in rows}
    for kind, body in own.items():
        assert hashlib.md5(body).hexdigest() in got, kind
    valid = sorted((r.offset, r.offset + r.size) for r in rows if r.confidence == 1.0)
    assert all(a[1] <= b[0] for a, b in zip(valid, valid[1:], strict=False))


def test_equal_objects_count_once_and_still_mask(spark):
    body = png(random.Random(1))
    image = body + b"\0" * 100 + body + b"\0" * 100
    rows = carve.carve(spark.createDataFrame([("i", bytearray(image))], "image_id string, data binary"), catalog.selected(extensions=["png"])).collect()
    assert [(r.offset, r.size) for r in rows] == [(0, len(body))]


def test_noise_gives_next_to_nothing(spark):
    rows = carve.carve(spark.createDataFrame([("n", bytearray(random.Random(2).randbytes(1 << 20)))], "image_id string, data binary")).where("validated").collect()
    assert len(rows) <= 1


def test_loose_text(spark):
    image = b"\0" * 10 + b"a line of text\n" * 40 + b"\0" * 10
    rows = carve.carve(spark.createDataFrame([("t", bytearray(image))], "image_id string, data binary"), loose_text=True).collect()
    assert [(r.format, r.offset, r.size, r.confidence) for r in rows] == [("TEXT_RUN", 10, 600, 0.3)]


def disk(wipe=False):
    size, kind = 1 << 20, uuid.uuid4().bytes_le
    entry = lambda a, b, n: kind + uuid.uuid4().bytes_le + struct.pack("<QQQ", a, b, 0) + n.encode("utf-16-le").ljust(72, b"\0")
    table = (entry(64, 127, "one") + entry(128, 255, "two")).ljust(128 * 128, b"\0")

    def head(own, first):
        h = bytearray(struct.pack("<8sIIIIQQQQ16sQIII", b"EFI PART", 0x10000, 92, 0, 0, own, 0, 34, 2000, b"\0" * 16, first, 128, 128, zlib.crc32(table)))
        h[16:20] = struct.pack("<I", zlib.crc32(bytes(h)))
        return bytes(h)

    d = bytearray(size)
    last = size // 512 - 1
    d[last * 512 : last * 512 + 92] = head(last, last - 32)
    d[(last - 32) * 512 : last * 512] = table
    if not wipe:
        d[512:604], d[1024 : 1024 + len(table)] = head(1, 2), table
    return d


def test_partition_tables(spark):
    mbr = bytearray(1 << 20)
    mbr[446:478] = struct.pack("<B3sB3sII", 0x80, b"", 0x83, b"", 64, 128) + struct.pack("<B3sB3sII", 0, b"", 5, b"", 512, 1024)
    mbr[510:512] = mbr[512 * 513 - 2 : 512 * 513] = b"\x55\xaa"
    mbr[512 * 512 + 446 : 512 * 512 + 462] = struct.pack("<B3sB3sII", 0, b"", 0x83, b"", 64, 100)
    rows = partitions.partitions(spark.createDataFrame([("g", disk()), ("w", disk(True)), ("m", mbr), ("x", bytearray(10))], "image_id string, data binary")).collect()
    assert sorted((r.image_id, r.entry, r.start, r.length, r.status) for r in rows) == [
        ("g", 1, 64 * 512, 64 * 512, "active"), ("g", 2, 128 * 512, 128 * 512, "active"),
        ("m", 1, 64 * 512, 128 * 512, "active"), ("m", 2, 512 * 512, 1024 * 512, "active"), ("m", 5, 576 * 512, 100 * 512, "logical"),
        ("w", 1, 64 * 512, 64 * 512, "recovered"), ("w", 2, 128 * 512, 128 * 512, "recovered"),
    ]


def test_detection(spark):
    ext = bytearray(4096)
    ext[1080:1082], ext[1024 + 92] = b"\x53\xef", 4
    rows = spark.createDataFrame([(1, ext), (2, bytearray(b"XFSB" + b"\0" * 99)), (3, bytearray(b"\0\0\0NTFS    ")), (4, bytearray(b""))], "k int, d binary")
    assert [r[0] for r in rows.orderBy("k").select(partitions.detected(F.col("d"))).collect()] == ["ext3", "xfs", "ntfs", "unknown"]


def test_raid5_parity_rebuilds_and_every_byte_has_one_place(spark):
    at = raid.address(5, F.col("id") * 4096, 8192, 4)
    rows = spark.range(240).select("id", *[at[k].alias(k) for k in ("member", "member_offset", "parity")])
    assert rows.where("member = parity").count() == 0
    assert rows.select("member", "member_offset").distinct().count() == 240
    words = spark.createDataFrame([(s, 0, m, (s * 77 + m * 1001) if m < 3 else (s * 77) ^ (s * 77 + 1001) ^ (s * 77 + 2002)) for s in range(5) for m in range(4)], "stripe long, at int, member int, word long")
    got = {r.stripe: r.rebuilt for r in raid.rebuild(words, "stripe", "at", "word", F.col("member") == 1).collect()}
    assert got == {s: s * 77 + 1001 for s in range(5)}


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(scalar.human_size(F.lit(n).cast("long"))) for n in (0, 1023, 1536, 3 << 20, 5 << 30)] == ["0 B", "1023 B", "1.5 KB", "3.00 MB", "5.00 GB"]
    assert [value(scalar.extension(F.lit(p))) for p in ("a/b.TXT", "a/.x", "a/x.", "x", "a.b/c")] == ["txt", "", "", "", ""]
    assert value(scalar.from_fat(F.lit((40 << 9) | (2 << 5) | 31), F.lit(0))) == 0
    assert value(scalar.sanitize(F.lit("a<b>\x01. "))) == "a_b_"
    assert value(scalar.le(F.lit(bytearray(b"\1\2\3")), 1, 2)) == 0x302 and value(scalar.le(F.lit(bytearray(b"\1")), 0, 2)) == 0


def test_filetime_is_exact(spark):
    unix = 116_444_736_000_000_000
    ticks = [0, unix - 1, unix, unix + 9_999_999, unix + 10_000_000, 132_000_000_000_000_000 - 1, (1 << 63) - 1]
    got = spark.createDataFrame([(t,) for t in ticks], "t long").select("t", scalar.from_filetime(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == {t: max(t - unix, 0) // 10_000_000 for t in ticks}


def test_islands_and_gaps(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 20, 30), ("a", 22, 25)], "k string, start long, end long")
    merged = intervals.islands(rows, ["k"])
    assert sorted((r.start, r.end, r.n) for r in merged.collect()) == [(0, 7, 2), (20, 30, 2)]
    assert [(r.gap_start, r.gap_end) for r in intervals.gaps(merged, ["k"], 10).collect()] == [(7, 20)]


def test_boundaries_extend_their_cover_without_being_bounds():
    from sedimenta.operators import carve, catalog

    specs = (catalog.Spec("A", "a", "x", b"A", validator="zip"), catalog.Spec("B", "b", "x", b"B", priority=5))
    judged = [(0, 0, (10, False, False)), (5, 0, (20, False, False)), (12, 0, (3, False, False)), (25, 0, (5, False, False)), (25, 1, (50, False, False)), (27, 1, (3, False, False))]
    # the object at 5 begins nothing but covers up to 25, so 12 begins nothing either; 27 reaches the cover's end with a higher priority
    assert carve.boundaries(judged, specs, 1000) == [0, 25, 27]


def test_all_magics_are_met_in_one_pass():
    from sedimenta.operators import carve, catalog

    specs = (catalog.Spec("A", "a", "x", b"ab"), catalog.Spec("B", "b", "x", b"b", magic_offset=1), catalog.Spec("C", "c", "x", b"abab", priority=3), catalog.Spec("D", "d", "x", b"\xff\x00"))
    data = b"xabab\xff\x00b"
    want = sorted(((at - s.magic_offset, k) for k, s in enumerate(specs) for at in range(len(data)) if data.startswith(s.magic, at) and at >= s.magic_offset), key=lambda c: (c[0], -specs[c[1]].priority, c[1]))
    assert carve.candidates(data, specs) == want


def test_rtf_skips_announced_bytes():
    from sedimenta.operators import validate

    body = b"{\\rtf1 \\{ {a} \\bin4 }}\0} b}"
    assert validate.REGISTRY["rtf"](memoryview(body + b"tail}")) == len(body)
    assert validate.REGISTRY["rtf"](memoryview(b"{\\rtf1 {")) == -1


def test_private_keys_end_at_their_footer(spark):
    from sedimenta.operators import carve, catalog

    key = b"-----BEGIN RSA PRIVATE KEY-----\n" + b"QUJD" * 30 + b"\n-----END RSA PRIVATE KEY-----\n"
    rows = carve.carve(spark.createDataFrame([("i", b"\0" * 50 + key + b"\0" * 500)], "image_id string, data binary"), catalog.selected(categories=["crypto"])).collect()
    assert [(r.format, r.offset, r.size) for r in rows] == [("PEM_RSA", 50, len(key))]
