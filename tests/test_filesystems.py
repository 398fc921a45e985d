"""Drivers against images made here, or by the system's tools where they are installed."""

import hashlib
import os
import random
import shutil
import struct
import subprocess
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sedimenta.operators import filesystems
from sedimenta.operators.filesystems import small


def corpus(rng):
    return {
        "readme.txt": b"hello\n",
        "empty.bin": b"",
        "docs/A long name with spaces é.txt": bytes(rng.randrange(256) for _ in range(3000)),
        "docs/deep/er/large.bin": rng.randbytes(300_000),
        "docs/deep/zeros.bin": b"\0" * 70_000 + b"end",
        **{f"many/file{k:03}.txt": b"%d" % k * k for k in range(120)},
    }


def tree(folder, files):
    for name, body in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)


def read_all(spark, data, fs, roots, chunk=4096):
    """{path: md5} of live and of deleted files, by the records, their paths and their objects."""
    with tempfile.TemporaryDirectory() as folder:  # a file of its own: large literals make slow plans
        pq.write_table(pa.table({"image_id": ["i"], "data": [data]}), f"{folder}/images")
        blocks = [data[a : a + chunk] for a in range(0, len(data), chunk)]
        pq.write_table(pa.table({"image_id": ["i"] * len(blocks), "chunk_no": list(range(len(blocks))), "data": blocks}), f"{folder}/chunks")
        return read_tables(spark.read.parquet(f"{folder}/images"), spark.read.parquet(f"{folder}/chunks"), fs, roots, chunk)


def read_tables(images, chunks, fs, roots, chunk):
    records = filesystems.scan(images, fs).cache()
    bodies = {(r.id, r.deleted): bytes(r.data) for r in filesystems.objects(records, chunks, chunk).collect()}
    out = {False: {}, True: {}}
    for r in filesystems.paths(records, roots).where("kind = 'file'").collect():
        out[r.deleted][r.path] = hashlib.md5(bodies[r.id, r.deleted]).hexdigest()
    return out[False], out[True]


def sums(files):
    return {f"/{k}": hashlib.md5(v).hexdigest() for k, v in files.items()}


@pytest.mark.skipif(not shutil.which("mke2fs", path="/usr/sbin:/sbin:/usr/bin"), reason="no mke2fs")
@pytest.mark.parametrize(("kind", "block"), [("ext4", 4096), ("ext2", 1024), ("ext3", 2048)])
def test_ext(spark, tmp_path, kind, block):
    files = corpus(random.Random(1))
    tree(tmp_path / "in", files)
    os.link(tmp_path / "in/readme.txt", tmp_path / "in/docs/hard")
    os.symlink("readme.txt", tmp_path / "in/soft")
    image = tmp_path / "image"
    subprocess.run(["/usr/sbin/mke2fs", "-q", "-t", kind, "-b", str(block), "-d", str(tmp_path / "in"), str(image), "12M"], check=True)
    files["docs/hard"] = files["readme.txt"]
    live, _ = read_all(spark, image.read_bytes(), kind, [2])
    assert live == sums(files)
    records = filesystems.scan(spark.createDataFrame([("i", image.read_bytes())], "image_id string, data binary"), kind)
    assert [bytes(r.inline) for r in records.where("kind = 'link'").collect()] == [b"readme.txt"]


@pytest.mark.skipif(not shutil.which("debugfs", path="/usr/sbin:/sbin"), reason="no debugfs")
def test_ext_deleted(spark, tmp_path):
    files = corpus(random.Random(2))
    tree(tmp_path / "in", files)
    image = tmp_path / "image"
    subprocess.run(["/usr/sbin/mke2fs", "-q", "-t", "ext2", "-b", "1024", "-d", str(tmp_path / "in"), str(image), "12M"], check=True)
    gone = ["readme.txt", "many/file007.txt", "docs/deep/er/large.bin"]
    for name in gone:
        subprocess.run(["/usr/sbin/debugfs", "-w", "-R", f"rm /{name}", str(image)], check=True, capture_output=True)
    live, deleted = read_all(spark, image.read_bytes(), "ext2", [2])
    assert live == sums({k: v for k, v in files.items() if k not in gone})
    assert deleted == sums({k: files[k] for k in gone})


def fat_image(files, bits, deleted=()):
    """A volume with the files; clusters of odd files are taken from the end, so chains are not in one piece."""
    sector, per = 512, 1
    total = {12: 3000, 16: 9000, 32: 70_000}[bits]
    reserved, tables, root_entries = (32, 2, 0) if bits == 32 else (1, 2, 512)
    fat_size = -(-(total + 2) * bits // 8 // sector) + 1
    root_at = (reserved + tables * fat_size) * sector
    data_at = root_at + root_entries * 32
    image = bytearray(total * sector)
    image[0:3] = b"\xeb\x3c\x90"
    struct.pack_into("<HBHBHHBH", image, 11, sector, per, reserved, tables, root_entries, total if total < 65536 else 0, 0xF8, 0 if bits == 32 else fat_size)
    struct.pack_into("<I", image, 32, total if total >= 65536 else 0)
    if bits == 32:
        struct.pack_into("<I", image, 36, fat_size)
        struct.pack_into("<I", image, 44, 2)
    clusters = (len(image) - data_at) // sector
    free, table = list(range(3 if bits == 32 else 2, clusters + 2)), {}

    def store(body, scattered=False):
        n = -(-len(body) // sector)
        own = [free.pop(-2 if scattered and k % 2 else 0) for k in range(n)]
        for k, c in enumerate(own):
            at = data_at + (c - 2) * sector
            image[at : at + sector] = body[k * sector : (k + 1) * sector].ljust(sector, b"\0")
            table[c] = own[k + 1] if k + 1 < n else 0x0FFFFFFF
        return own

    def entry(name, first, size, folder, gone, k):
        short = b"%-8s%-3s" % (b"N%05d~1" % k, b"TXT")
        checksum = 0
        for c in short:
            checksum = ((checksum & 1) << 7 | checksum >> 1) + c & 0xFF
        text = name.encode("utf-16-le") + b"\0\0"
        text += b"\xff" * (-len(text) % 26)
        parts = [text[a : a + 26] for a in range(0, len(text), 26)]
        out = b""
        for i in range(len(parts), 0, -1):
            p = parts[i - 1]
            out += bytes([0xE5 if gone else i | (0x40 if i == len(parts) else 0)]) + p[:10] + b"\x0f\0" + bytes([checksum]) + p[10:22] + b"\0\0" + p[22:]
        short = b"\xe5" + short[1:] if gone else short
        return out + short + bytes([0x10 if folder else 0x20]) + b"\0" * 8 + struct.pack("<HHHHI", first >> 16, 0x6000, 0x5A21, first & 0xFFFF, size)

    def folder(prefix):
        rows, here = b"", {}
        for path, body in files.items():
            if path.startswith(prefix):
                here.setdefault(path[len(prefix) :].split("/")[0], []).append(path)
        for k, (name, own) in enumerate(here.items()):
            if own == [prefix + name]:
                gone = own[0] in deleted
                c = store(files[own[0]], not gone)
                rows += entry(name, c[0] if c else 0, len(files[own[0]]), False, gone, k)
                if gone:
                    for x in c:
                        table[x] = 0
            else:
                inner = folder(prefix + name + "/")
                c = store(b".".ljust(11) + b"\x10" + b"\0" * 20 + b"..".ljust(11) + b"\x10" + b"\0" * 20 + inner)
                rows += entry(name, c[0], 0, True, False, k)
        return rows

    rows = folder("")
    if bits == 32:
        first, *rest = [rows[a : a + sector] for a in range(0, len(rows), sector)]
        image[data_at : data_at + len(first)] = first
        table[2] = 0x0FFFFFFF
        if rest:
            table[2] = store(b"".join(rest))[0]
    else:
        image[root_at : root_at + len(rows)] = rows
    for c, value in table.items():
        for t in range(tables):
            at = (reserved + t * fat_size) * sector
            if bits == 12:
                at += c * 3 // 2
                old = struct.unpack_from("<H", image, at)[0]
                struct.pack_into("<H", image, at, old & 0x000F | (value & 0xFFF) << 4 if c & 1 else old & 0xF000 | value & 0xFFF)
            else:
                struct.pack_into("<H" if bits == 16 else "<I", image, at + c * bits // 8, value & (0xFFFF if bits == 16 else 0x0FFFFFFF))
    return bytes(image)


@pytest.mark.parametrize("bits", [12, 16, 32])
def test_fat(spark, bits):
    files = corpus(random.Random(3))
    gone = ["readme.txt", "many/file007.txt", "docs/deep/zeros.bin"]
    live, deleted = read_all(spark, fat_image(files, bits, gone), f"fat{bits}", [2], 1 << 16)
    assert live == sums({k: v for k, v in files.items() if k not in gone})
    # of a deleted name the long one stays
    assert deleted == sums({k: files[k] for k in gone})


@pytest.mark.skipif(not shutil.which("mkfs.cramfs", path="/usr/sbin:/sbin"), reason="no mkfs.cramfs")
def test_cramfs(spark, tmp_path):
    files = corpus(random.Random(4))
    tree(tmp_path / "in", files)
    subprocess.run(["/usr/sbin/mkfs.cramfs", str(tmp_path / "in"), str(tmp_path / "image")], check=True, capture_output=True)
    data = (tmp_path / "image").read_bytes()
    records = filesystems.paths(filesystems.scan(spark.createDataFrame([("i", data)], "image_id string, data binary"), "cramfs"), [64]).where("kind = 'file'").collect()
    got = {r.path: hashlib.md5(small.cramfs_data(memoryview(data), r.extents[0].start, r.size) if r.extents else b"").hexdigest() for r in records}
    assert got == sums(files)


def test_romfs(spark):
    files = {"a.txt": b"first", "d/b.bin": b"x" * 1000, "d/e/c": b"", "z": b"last" * 9}
    image = bytearray(b"-rom1fs-" + b"\0" * 8 + b"vol".ljust(16, b"\0"))

    def header(kind, info, body, name):
        at = len(image)
        raw = struct.pack(">4I", kind, info, len(body), 0) + name.encode() + b"\0"
        image.extend(raw + b"\0" * (-len(raw) % 16) + body + b"\0" * (-len(body) % 16))
        return at

    def chain(prefix):
        first = before = 0
        here = dict.fromkeys(k[len(prefix) :].split("/")[0] for k in files if k.startswith(prefix))
        for name in here:
            if prefix + name in files:
                at = header(2, 0, files[prefix + name], name)
            else:
                at = header(1, 0, b"", name)
                struct.pack_into(">I", image, at + 4, chain(prefix + name + "/"))
            if before:
                struct.pack_into(">I", image, before, at | struct.unpack_from(">I", image, before)[0] & 15)
            first, before = first or at, at
        return first

    chain("")
    live, _ = read_all(spark, bytes(image), "romfs", [32])
    assert live == sums(files)


def test_iso9660(spark):
    image = bytearray(30 * 2048)

    def entry_of(name, block, size, flags, extra=b""):
        both = lambda n: struct.pack("<I", n) + struct.pack(">I", n)
        raw = b"\0" + both(block) + both(size) + bytes([126, 1, 2, 3, 4, 5, 0, flags, 0, 0, 1, 0, 0, 1, len(name)]) + name + b"\0" * (len(name) % 2 == 0) + extra
        raw += b"\0" * (len(raw) % 2 == 0)
        return bytes([len(raw) + 1]) + raw

    root = entry_of(b"\0", 20, 2048, 2) + entry_of(b"\1", 20, 2048, 2) + entry_of(b"README.TXT;1", 22, 5, 0) + entry_of(b"DIR", 21, 2048, 2, b"NM\x0a\x01\0dir-x")
    folder = entry_of(b"\0", 21, 2048, 2) + entry_of(b"\1", 20, 2048, 2) + entry_of(b"A.BIN;1", 23, 3000, 0)
    volume = bytearray(2048)
    volume[:7] = b"\1CD001\1"
    struct.pack_into("<H", volume, 128, 2048)
    volume[156:190] = entry_of(b"\0", 20, 2048, 2)[:34]
    image[16 * 2048 : 17 * 2048], image[17 * 2048 : 17 * 2048 + 7] = volume, b"\xffCD001\1"
    image[20 * 2048 : 20 * 2048 + len(root)], image[21 * 2048 : 21 * 2048 + len(folder)] = root, folder
    body = bytes(range(250)) * 12
    image[22 * 2048 : 22 * 2048 + 5], image[23 * 2048 : 23 * 2048 + 3000] = b"hello", body
    images = spark.createDataFrame([("i", bytes(image))], "image_id string, data binary")
    records = filesystems.scan(images, "iso9660")
    rows = {r.name: r for r in records.collect()}
    assert rows["README.TXT"].size == 5 and rows["A.BIN"].size == 3000 and rows["README.TXT"].mtime == 1767323045.0
    live, _ = read_all(spark, bytes(image), "iso9660", [0], 2048)
    assert live == sums({"README.TXT": b"hello", "dir-x/A.BIN": body})


@pytest.mark.parametrize("fs", sorted(filesystems.DRIVERS))
def test_damaged_images_give_what_can_be_read(spark, fs):
    rng = random.Random(fs)
    bodies = [None, b"", b"\0" * 5000, rng.randbytes(70_000)]
    base = bytearray(fat_image({"a": b"x" * 2000, "d/b": b"y"}, 12))
    bodies += [bytes(base[:n]) for n in (100, 600, 9000)]
    for _ in range(10):
        for _ in range(40):
            base[rng.randrange(20_000)] = rng.randrange(256)
        bodies.append(bytes(base))
    for _ in range(5):
        wild = bytearray(rng.randbytes(70_000))
        wild[1024 + 56 : 1024 + 58] = b"\x53\xef"
        wild[:8] = b"-rom1fs-" if rng.random() < 0.5 else b"\x45\x3d\xcd\x28" + bytes(4)
        wild[32768:32774] = b"\1CD001"
        bodies.append(bytes(wild))
    images = spark.createDataFrame([(str(k), b) for k, b in enumerate(bodies)], "image_id string, data binary")
    assert filesystems.scan(images, fs).where(F.col("size") < 0).count() == 0
