"""Result queries: filter, stable sort, page, facets, counts, ordering rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar

SORTS = {"size": "size", "mtime": "mtime", "confidence": "confidence"}


def matching(rows: DataFrame, q: str = "", ext: str = "", only: str = "") -> Column:
    """deleted or live only; exact extension ((none) for none); substring of the path, ignoring case."""
    keep = F.lit(True)
    if only:
        keep &= F.col("deleted") == (only == "deleted")
    if ext:
        keep &= scalar.extension(F.col("path")) == ("" if ext == "(none)" else ext.lower())
    if q:
        keep &= F.contains(F.lower(F.coalesce(F.nullif(F.col("path"), F.lit("")), F.col("name"))), F.lit(q.lower()))
    return keep


def page(rows: DataFrame, q: str = "", ext: str = "", only: str = "", sort: str = "", offset: int = 0, limit: int = 200) -> DataFrame:
    """One page; ties keep the stored order (column index). Top-k, never a full sort in one task."""
    offset, limit = max(0, offset), min(max(1, limit), 5000)
    order = [F.col(SORTS[sort]).desc(), F.col("index")] if sort in SORTS else [F.col("path"), F.col("index")] if sort else [F.col("index")]
    return rows.where(matching(rows, q, ext, only)).orderBy(*order).limit(offset + limit).offset(offset)


def extension_histogram(rows: DataFrame) -> DataFrame:
    """Over all rows, filtered or not."""
    ext = scalar.extension(F.col("path"))
    return rows.groupBy(F.when(ext == "", "(none)").otherwise(ext).alias("ext")).agg(F.count("*").alias("n"))


def totals(rows: DataFrame, q: str = "", ext: str = "", only: str = "") -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(matching(rows, q, ext, only)).alias("matched"))


def latest_version(rows: DataFrame, key: str, version: str, tie: str) -> DataFrame:
    """Per key the row of the greatest version; ties go to the greater ``tie``. Aggregated before it is shuffled."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(version, tie)).alias("r"))
    return best.select(key, "r.*")


def first_non_empty(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return rows.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(key).agg(F.min_by(value, order).alias(value))


def first_per_content(rows: DataFrame, content: Column, order: str) -> DataFrame:
    """The first row of each content (digest and length), and how many there are."""
    keyed = rows.withColumns({"_md5": F.md5(content.cast("binary")), "_len": F.octet_length(content)})
    return keyed.groupBy(F.col("_md5").alias("md5"), F.col("_len").alias("size")).agg(F.min(order).alias("first"), F.count("*").alias("copies"))


def rank_with_margin(rows: DataFrame, key: str, name: str, score: str) -> DataFrame:
    """Best and runner-up of each key, and a confidence from how clear the lead is."""
    line = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(name).desc())
    top = rows.withColumn("_place", F.row_number().over(line)).where("_place <= 2")  # a window limit: each task keeps two rows a key before the shuffle
    top = top.groupBy(key).agg(*[F.max(F.when(F.col("_place") == k, F.struct(score, name))).alias(f"_{k}") for k in (1, 2)])
    best, second = F.col("_1"), F.col("_2")
    confidence = F.when(second.isNull() | (second[score] * 2 <= best[score]), 1.0).when(second[score] < best[score], 0.7).otherwise(0.35)
    return top.select(key, best[name].alias("best"), best[score].alias("score"), second[score].alias("runner_up"), confidence.alias("confidence"))


def next_start(rows: DataFrame, key: str, at: str, cap: int) -> DataFrame:
    """Each distinct start with the next one, and the size that guess gives."""
    line = Window.partitionBy(key).orderBy(at)
    return rows.select(key, at).distinct().withColumn("next", F.lead(at).over(line)).withColumn("size", F.least(F.coalesce(F.col("next") - F.col(at), F.lit(cap)), F.lit(cap)))


def furthest_extent(rows: DataFrame, key: str, offset: str, size: str) -> DataFrame:
    """Per key where its last extent ends: max(offset + size)."""
    return rows.groupBy(key).agg(F.max(F.col(offset) + F.col(size)).alias("end"))


def label_summary(rows: DataFrame, key: str, valid: Column, counter: str) -> DataFrame:
    """Per key the number of valid labels and the highest counter (such as a transaction number) among them."""
    return rows.groupBy(key).agg(F.count_if(valid).alias("valid"), F.max(F.when(valid, F.col(counter))).alias("highest"))


# Partition types that never hold a file system (reserved by Microsoft; BIOS boot).
RESERVED_TYPES = ("E3C9E316-0B5C-4DB8-817D-F92DF00215AE", "21686148-6449-6E6F-744E-656564454649")


def health(file_system: Column, size: Column, type_guid: Column, allocated: Column) -> Column:
    """Label of an area: a volume is healthy when its file system is recognised, and damaged when it should have one."""
    small = size < 65536
    return F.when(~allocated, "unallocated").when(small, "unknown").when(F.coalesce(file_system, F.lit("")) != "", "healthy").when(F.upper(type_guid).isin(*RESERVED_TYPES), "unknown").otherwise("damaged")


def fat_clusters(sectors: Column, reserved: Column, tables: Column, table_size: Column, root_entries: Column, bytes_per_sector: Column, sectors_per_cluster: Column) -> Column:
    """Data clusters of a FAT volume from the fields of its boot sector; null when the tables leave no room."""
    root = F.ceil(root_entries * 32 / bytes_per_sector)
    data = sectors - reserved - tables * table_size - root
    return F.when(data > 0, F.floor(data / sectors_per_cluster))


def fat_flavour(clusters: Column, long_names: Column) -> Column:
    """FAT type by the number of clusters (fat16 where it is unknown); vfat where the root directory holds long names."""
    width = F.when(clusters.isNull(), "fat16").when(clusters < 4085, "fat12").when(clusters < 65525, "fat16").otherwise("fat32")
    return F.when(F.coalesce(long_names, F.lit(False)), "vfat").otherwise(width)
