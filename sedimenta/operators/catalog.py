"""Signature catalog: formats whose layouts the validators know, and formats known by signature or footer alone.

Further rows can be given to the carve operator; the list is a parameter.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30


@dataclass(frozen=True)
class Spec:
    name: str
    ext: str
    category: str
    magic: bytes
    max_size: int = GB
    min_size: int = 32
    magic_offset: int = 0
    priority: int = 0
    confirm: bytes = b""
    confirm_offset: int = -1  # -1: anywhere in the first confirm_window bytes
    confirm_window: int = 4096
    footer: bytes = b""
    footer_extra: int = 0
    validator: str = ""
    min_entropy: float = 0.0
    bound_to_next: bool = False
    text: bool = False


# Published magic numbers; limits, least sizes and priorities are those results must agree with.
SPECS = (
    Spec("ZIP", "zip", "archive", b"PK\x03\x04", 8 * GB, 100, validator="zip"),
    Spec("JAR", "jar", "archive", b"PK\x03\x04", 2 * GB, priority=25, confirm=b"META-INF/MANIFEST", confirm_window=8192, validator="zip"),
    Spec("GZIP", "gz", "archive", b"\x1f\x8b\x08", 8 * GB, 20, validator="gzip"),
    Spec("BZIP2", "bz2", "archive", b"BZh", 8 * GB, 20, validator="bzip2"),
    Spec("XZ", "xz", "archive", b"\xfd7zXZ\x00", 8 * GB, validator="xz"),
    Spec("7Z", "7z", "archive", b"7z\xbc\xaf'\x1c", 8 * GB, validator="sevenzip"),
    Spec("TAR", "tar", "archive", b"ustar", 8 * GB, 1024, 257, validator="tar"),
    Spec("AR", "a", "archive", b"!<arch>\n", 2 * GB, 68, validator="ar"),
    Spec("CAB", "cab", "archive", b"MSCF", 2 * GB, 36, validator="cab"),
    Spec("PNG", "png", "image", b"\x89PNG\r\n\x1a\n", 512 * MB, validator="png"),
    Spec("GIF87", "gif", "image", b"GIF87a", 256 * MB, validator="gif"),
    Spec("GIF89", "gif", "image", b"GIF89a", 256 * MB, validator="gif"),
    Spec("JPEG", "jpg", "image", b"\xff\xd8\xff", 256 * MB, 64, validator="jpeg"),
    Spec("BMP", "bmp", "image", b"BM", 512 * MB, 54, validator="bmp"),
    Spec("WEBP", "webp", "image", b"RIFF", 256 * MB, priority=20, confirm=b"WEBP", confirm_offset=8, validator="riff"),
    Spec("WAV", "wav", "audio", b"RIFF", 4 * GB, 44, priority=20, confirm=b"WAVE", confirm_offset=8, validator="riff"),
    Spec("AVI", "avi", "video", b"RIFF", 16 * GB, 64, priority=20, confirm=b"AVI ", confirm_offset=8, validator="riff"),
    Spec("MIDI", "mid", "audio", b"MThd", 16 * MB, 22, validator="midi"),
    Spec("SQLITE", "sqlite", "database", b"SQLite format 3\x00", 8 * GB, 512, validator="sqlite"),
    Spec("PDF", "pdf", "document", b"%PDF-", 2 * GB, 64, footer=b"%%EOF", footer_extra=1),
    Spec("RTF", "rtf", "document", b"{\\rtf", 128 * MB, 64, validator="rtf"),
    Spec("ELF", "elf", "executable", b"\x7fELF", GB, 52, validator="elf"),
    Spec("WASM", "wasm", "executable", b"\x00asm", 256 * MB, 8, validator="wasm"),
    Spec("CLASS", "class", "executable", b"\xca\xfe\xba\xbe\x00\x00\x00", 16 * MB, bound_to_next=True),
    Spec("XML", "xml", "document", b"<?xml", 64 * MB, 32, text=True),
    Spec("HTML", "html", "document", b"<!DOCTYPE html", 64 * MB, 32, footer=b"</html>", text=True),
    Spec("ISO9660", "iso", "archive", b"CD001", 16 * GB, 40 * KB, 32769, validator="iso"),
    Spec("LZ4", "lz4", "archive", b"\x04\"M\x18", 8 * GB),
    Spec("LZH", "lzh", "archive", b"-lh", 512 * MB),
    Spec("ACE", "ace", "archive", b"**ACE**", 512 * MB),
    Spec("WIM", "wim", "archive", b"MSWIM", 8 * GB),
    Spec("MOD_IT", "it", "audio", b"IMPM", 128 * MB),
    Spec("PEM_CERT", "pem", "crypto", b"-----BEGIN CERTIFICATE-----", 4 * MB, 64, footer=b"-----END CERTIFICATE-----", footer_extra=1),
    Spec("PEM_RSA", "pem", "crypto", b"-----BEGIN RSA PRIVATE KEY-----", 4 * MB, footer=b"-----END RSA PRIVATE KEY-----", footer_extra=1),
    Spec("PEM_EC", "pem", "crypto", b"-----BEGIN EC PRIVATE KEY-----", 4 * MB, footer=b"-----END EC PRIVATE KEY-----", footer_extra=1),
    Spec("PEM_DSA", "pem", "crypto", b"-----BEGIN DSA PRIVATE KEY-----", 4 * MB, footer=b"-----END DSA PRIVATE KEY-----", footer_extra=1),
    Spec("PEM_OPENSSH", "pem", "crypto", b"-----BEGIN OPENSSH PRIVATE KEY-----", 4 * MB, footer=b"-----END OPENSSH PRIVATE KEY-----", footer_extra=1),
    Spec("PEM_PRIVATE", "pem", "crypto", b"-----BEGIN PRIVATE KEY-----", 4 * MB, footer=b"-----END PRIVATE KEY-----", footer_extra=1),
    Spec("PGP_PRIVATE", "asc", "crypto", b"-----BEGIN PGP PRIVATE KEY BLOCK-----", 8 * MB, footer=b"-----END PGP PRIVATE KEY BLOCK-----", footer_extra=1),
    Spec("PGP_MESSAGE", "asc", "crypto", b"-----BEGIN PGP MESSAGE-----", 64 * MB, footer=b"-----END PGP MESSAGE-----", footer_extra=1),
    Spec("BerkeleyDB", "db", "database", b"\x00\x051b", 2 * GB),
    Spec("Firebird", "fdb", "database", b"\x01\x0090", 4 * GB),
    Spec("MSSQL_MDF", "mdf", "database", b"\x01\x0F\x00\x00", 16 * GB),
    Spec("ORC", "orc", "database", b"ORC", 8 * GB),
    Spec("LNK", "lnk", "forensic", b"L\x00\x00\x00\x01\x14\x02\x00", 16 * MB),
    Spec("PREFETCH_C", "pf", "forensic", b"MAM\x04", 16 * MB),
    Spec("DDS", "dds", "image", b"DDS ", 512 * MB),
    Spec("WMF", "wmf", "image", b"\xD7\xCD\xC6\x9A", 64 * MB),
    Spec("DXF", "dxf", "misc", b"  0\x0D\x0ASECTION", 512 * MB),
    Spec("TORRENT", "torrent", "misc", b"d8:announce", 16 * MB, 64),
    Spec("OPENVPN", "ovpn", "misc", b"client\x0Adev tun", 1 * MB),
    Spec("VMDK_DESC", "vmdk", "vm", b"# Disk DescriptorFile", 1 * MB),
    Spec("AFF", "aff", "forensic", b"AFF1", 4 * GB),
    Spec("ALZ", "alz", "archive", b"ALZ\x01\x01", 4 * GB),
    Spec("BPG", "bpg", "image", b"BPG\xFB", 512 * MB),
    Spec("DVI", "dvi", "document", b"\xF7\x02", 256 * MB),
    Spec("ESEDB", "edb", "database", b"EFile", 4 * GB),
    Spec("FLIF", "flif", "image", b"FLIF", 512 * MB),
    Spec("KGB", "kgb", "archive", b"KGB", 8 * GB),
    Spec("MRW", "mrw", "image", b"\x00MRM", 128 * MB),
    Spec("OFR", "ofr", "audio", b"OFR ", GB),
    Spec("PCF", "pcf", "font", b"\x01fcp", 64 * MB),
    Spec("PICT", "pct", "image", b"\x00\x11\x02\xFF\x0C\x00\x00\x00", 64 * MB),
    Spec("QXP", "qxp", "document", b"MXXN", 256 * MB),
    Spec("RA", "ra", "audio", b".ra\xFD", GB),
    Spec("RZIP", "rzip", "archive", b"RZIP", 4 * GB),
    Spec("SQX", "sqx", "archive", b"SQX ", 4 * GB),
    Spec("TTA", "tta", "audio", b"TTA1", GB),
    Spec("UHARC", "uha", "archive", b"UHARC", 4 * GB),
    Spec("VQF", "vqf", "audio", b"TWIN", 512 * MB),
    Spec("XAR", "xar", "archive", b"xar!", 4 * GB),
    Spec("ZOO", "zoo", "archive", b"ZOO ", 4 * GB),
    Spec("ZPAQ", "zpaq", "archive", b"7kBa", 8 * GB),
)


def signatures(spark: SparkSession, specs: tuple[Spec, ...] = SPECS) -> DataFrame:
    """The catalog as rows, greatest priority first, then in order of registration."""
    rows = [(k, *[bytes(v) if isinstance(v, bytes) else v for v in asdict(s).values()]) for k, s in enumerate(specs)]
    kinds = {bytes: "binary", str: "string", bool: "boolean", int: "long", float: "double"}
    schema = "reg_order int, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in asdict(specs[0]).items())
    return spark.createDataFrame(sorted(rows, key=lambda r: -r[8]), schema)


def categories(specs: tuple[Spec, ...] = SPECS) -> list[str]:
    """The distinct categories, sorted."""
    return sorted({s.category for s in specs})


def selected(specs: tuple[Spec, ...] = SPECS, categories: list[str] | None = None, extensions: list[str] | None = None) -> tuple[Spec, ...]:
    """The subset of some categories and extensions, before a matcher is built; none left is an error."""
    kept = tuple(s for s in specs if (not categories or s.category in categories) and (not extensions or s.ext in extensions))
    if not kept:
        raise ValueError("no signature matches the categories and extensions")
    return kept
