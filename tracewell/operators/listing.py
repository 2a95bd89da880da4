"""Listings: media filters, orders, positions, unions of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import contains_ignore_case, extension

#: Extensions that each kind of source lists (fixed values).
MEDIA = {
    "folder": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp", ".heic", ".heif", ".avif", ".mp4", ".mov", ".avi", ".mkv"),
    "images": (
        ".jpg", ".jpeg", ".jpe", ".jfif", ".png", ".gif", ".bmp", ".dib", ".tif", ".tiff", ".webp", ".heic", ".heif", ".avif",
        ".cr2", ".cr3", ".nef", ".nrw", ".arw", ".srf", ".sr2", ".orf", ".rw2", ".pef", ".dng", ".raf", ".raw",
    ),
}


def media_only(df: DataFrame, path: str, source: str = "folder") -> DataFrame:
    return df.where(extension(F.col(path)).isin(*MEDIA[source]))


def search(df: DataFrame, name: str, text: str, is_directory: Column | None = None) -> DataFrame:
    """Directories and, of the rest, names that contain the text, case aside; an empty text lists all."""
    if not text:
        return df
    keep = contains_ignore_case(F.col(name), F.lit(text))
    return df.where(keep if is_directory is None else is_directory | keep)


def union_all(sources: list[DataFrame]) -> DataFrame:
    """All rows with the source's place in the order as source_rank."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)))


def positions(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with position from 1 in a total order, without one task that holds all rows.

    Spark's range partitioning sorts the rows over all tasks; a row's place is its place in its
    partition and the number of rows in the partitions before (one number for each partition).
    """
    from ..storage import stash

    placed = stash(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.join(F.broadcast(offsets), "__part").withColumn("position", F.col("__before") + inner).drop("__part", "__before")
