"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: MIME types by extension.
MIME = {"html": "text/html", "txt": "text/plain", "png": "image/png", "jpg": "image/jpeg", "gif": "image/gif", "pdf": "application/pdf", "json": "application/json", "zip": "application/zip", "mp3": "audio/mpeg", "mp4": "video/mp4"}
#: Seconds between 1601 and 1970, 1904 and 1970.
FILETIME_OFFSET, HFS_OFFSET = 11_644_473_600, 2_082_844_800


def seconds(column: str) -> Column:
    """Whole seconds since 1970 of a timestamp without a zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension of the last part; '' without a dot, for a leading or a trailing one."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))


def human_size(n: Column) -> Column:
    """B without, KB with one, MB to TB with two decimals."""
    out = F.format_string("%.2f TB", F.bround(n / float(1 << 40), 2))
    for limit, name, digits in ((1 << 40, "GB", 2), (1 << 30, "MB", 2), (1 << 20, "KB", 1)):
        out = F.when(n < limit, F.format_string(f"%.{digits}f {name}", F.bround(n / float(limit >> 10), digits))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def iso_time(seconds: Column) -> Column:
    return F.when(seconds > 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("")


def from_filetime(ticks: Column) -> Column:
    """Seconds since 1970 of whole 100 ns ticks since 1601, a long or a decimal of scale 0; earlier than 1970 is 0. No step goes through a double."""
    return F.greatest(F.call_function("div", ticks, F.lit(10_000_000)) - FILETIME_OFFSET, F.lit(0))


def from_fat(date: Column, time: Column) -> Column:
    """Seconds of a packed date and time (two-second steps); invalid ones are 0."""
    year, month, day = F.shiftright(date, 9) + 1980, F.shiftright(date, 5).bitwiseAND(15), date.bitwiseAND(31)
    hour, minute, second = F.shiftright(time, 11), F.shiftright(time, 5).bitwiseAND(63), time.bitwiseAND(31) * 2
    days = F.unix_date(F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day)))
    clock = F.when((hour < 24) & (minute < 60) & (second < 60), hour * 3600 + minute * 60 + second)
    return F.coalesce(days.cast("long") * 86_400 + clock, F.lit(0))


def from_hfs(seconds: Column) -> Column:
    return F.greatest(seconds - HFS_OFFSET, F.lit(0))


def sanitize(name: Column) -> Column:
    """A safe file name: no control characters, reserved ones replaced, no dots or spaces at the end, never empty."""
    name = F.regexp_replace(name, r"[\x00-\x1F\x7F]", "")
    name = F.regexp_replace(name, r"""[<>:"/\\|?*]""", "_")
    name = F.substr(F.regexp_replace(name, r"[. ]+$", ""), F.lit(1), F.lit(200))
    return F.when(name == "", "unnamed").otherwise(name)


def sanitize_path(path: Column) -> Column:
    """Each part sanitised; empty, . and .. dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))
    return F.array_join(F.transform(parts, sanitize), "/")


def mime(path: Column) -> Column:
    out = F.lit("application/octet-stream")
    for k, v in MIME.items():
        out = F.when(extension(path) == k, v).otherwise(out)
    return out


def le(data: Column, at: int | Column, n: int) -> Column:
    """Little-endian unsigned number of up to 7 bytes; 0 when the data is too short."""
    at = at if isinstance(at, Column) else F.lit(at)
    part = F.reverse(F.substr(data, (at + 1).cast("int"), F.lit(n)))
    return F.when((F.octet_length(data) >= at + n) & (at >= 0), F.conv(F.hex(part), 16, 10).cast("long")).otherwise(F.lit(0))


def guid(data: Column, at: int = 0) -> Column:
    """Text of a GUID of 16 bytes, its first three fields little-endian; null when the data is too short."""
    part = lambda a, n, turn: F.hex(F.reverse(F.substring(data, at + a + 1, n)) if turn else F.substring(data, at + a + 1, n))
    text = F.concat_ws("-", part(0, 4, True), part(4, 2, True), part(6, 2, True), part(8, 2, False), part(10, 6, False))
    return F.when(F.octet_length(data) >= at + 16, text)


def utf16(data: Column, big: bool = False) -> Column:
    """Text of UTF-16 bytes up to the first NUL."""
    return F.substring_index(F.decode(data, "UTF-16BE" if big else "UTF-16LE"), "\0", 1)


def be(data: Column, at: int, n: int) -> Column:
    return F.when(F.octet_length(data) >= at + n, F.conv(F.hex(F.substring(data, at + 1, n)), 16, 10).cast("long")).otherwise(F.lit(0))


def is_pow2(x: Column) -> Column:
    return (x > 0) & (F.bit_count(x) == 1)


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    return F.aggregate(counts, F.lit(0.0), lambda a, c: a - F.when(c > 0, c / total * F.log2(c / total)).otherwise(0.0))
