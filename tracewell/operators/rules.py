"""Rule analyzers: one item to its findings, as expressions over the row.

A rule gives an array of finding structs; :func:`findings` explodes them. Priorities are ordinals
(0 none, 1 low, 2 medium, 3 high, 4 critical); an interpretation confidence of -1 is unset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import micros

#: Names of editing programs (fixed values).
EDITORS = (
    "photoshop", "lightroom", "gimp", "snapseed", "facetune", "instagram", "whatsapp", "picsart", "vsco", "afterlight", "fotor", "pixlr", "canva", "lens studio", "retouch", "meitu", "beauty",
    "adobe camera raw", "capture one", "on1", "darktable", "rawtherapee", "paintshop", "affinity photo",
)

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


def finding(identifier: str, priority: int, observed: int, interpreted: int = -1) -> Column:
    return F.struct(F.lit(identifier).alias("id"), F.lit(priority).alias("priority"), F.lit(observed).alias("observed"), F.lit(interpreted).alias("interpreted"))


NONE = "struct<id:string,priority:int,observed:int,interpreted:int>"


def findings(df: DataFrame, item: str, *rules: Column) -> DataFrame:
    """item, id, priority, observed, interpreted: one row for each finding of the rules."""
    found = F.filter(F.array(*rules), lambda f: f.isNotNull())
    return df.select(F.col(item).alias("item"), F.explode(found).alias("f")).select("item", "f.*")


def software(name: Column) -> Column:
    """An editing tool's name, or any software name at all; blank gives nothing."""
    low, known = F.lower(name), F.lit(False)
    for k in EDITORS:
        known = known | F.contains(low, F.lit(k))
    return F.when(F.trim(name) == "", None).when(name.isNull(), None).when(known, finding("software-editing-tool", 2, 95, 75)).otherwise(finding("software-field-present", 0, 99))


def thumbnail_size(width: Column, height: Column, thumb_width: Column, thumb_height: Column) -> Column:
    """Absolute rule: larger than the main image; else aspect ratios more than 0.05 apart, transposed or not."""
    usable = (width > 0) & (height > 0) & (thumb_width > 0) & (thumb_height > 0)
    main, thumb = width / height, thumb_width / thumb_height
    return F.when(
        usable,
        F.when((thumb_width > width) | (thumb_height > height), finding("thumb-larger-than-main", 3, 97, 75))
        .when((F.abs(main - thumb) > 0.05) & (F.abs(1 / main - thumb) < 0.05), finding("thumb-orientation-mismatch", 1, 90, 65))
        .when(F.abs(main - thumb) > 0.05, finding("thumb-aspect-ratio-mismatch", 2, 93, 65))
        .otherwise(finding("thumb-dimensions-consistent", 0, 92)),
    )


def thumbnail_aspect(width: Column, height: Column, thumb_width: Column, thumb_height: Column) -> Column:
    """Relative rule: aspect ratios more than 2 percent apart; absent without a thumbnail."""
    main, thumb = width / height, thumb_width / thumb_height
    known = (width > 0) & (height > 0)
    shown = (thumb_width > 0) & (thumb_height > 0)
    return F.when(known & shown, F.when(F.abs(main - thumb) / main > 0.02, finding("thumb-aspect-ratio-mismatch", 2, 99, 75)).otherwise(finding("thumb-aspect-ratio-match", 0, 95))).when(known, finding("thumb-absent", 0, 99))


def file_time(capture: Column, written: Column) -> Column:
    """A file's own time against the capture: within 24 hours of it, later, or before."""
    diff = micros(written) - micros(capture)
    return F.when(diff.isNull(), None).when(F.abs(diff) <= DAY, finding("ts-fs-consistent", 0, 80)).when(diff > DAY, finding("ts-fs-later", 1, 90, 65)).otherwise(finding("ts-fs-precedes-exif", 2, 85, 55))


def header_time(capture: Column, modified: Column) -> Column:
    diff = F.abs(micros(modified) - micros(capture))
    return F.when(diff.isNull(), None).when(diff <= 2 * MINUTE, finding("ts-ifd0-consistent", 0, 95)).otherwise(finding("ts-ifd0-differs", 2, 95, 80))


def digitized_time(capture: Column, digitized: Column) -> Column:
    return F.when(F.abs(micros(digitized) - micros(capture)) > 2 * MINUTE, finding("ts-digitized-differs", 1, 95, 60))


def gps_time(capture: Column, gps: Column) -> Column:
    """Within 26 hours (any zone) is consistent, beyond a mismatch; a third case can't occur."""
    diff = F.abs(micros(gps) - micros(capture))
    return F.when(diff.isNull(), None).when(diff <= 26 * HOUR, finding("gps-ts-consistent", 0, 85)).otherwise(finding("gps-ts-date-mismatch", 3, 90, 65))


def solar_offset(longitude: Column) -> Column:
    """Hours of the zone that a longitude suggests, in halves, halves rounded to even."""
    return F.bround(longitude / 15 * 2) / 2


def zone(capture: Column, gps: Column, longitude: Column) -> Column:
    off = F.abs((micros(capture) - micros(gps)) / HOUR - solar_offset(longitude))
    return F.when(off.isNull(), None).when(off <= 3, finding("timezone-inference-consistent", 0, 70, 60)).otherwise(finding("timezone-inference-offset-mismatch", 2, 70, 50))


def format_match(found: Column, expected: Column) -> Column:
    return F.when(found.isNull() | expected.isNull(), None).when(found == expected, finding("format-match", 0, 99)).otherwise(finding("format-mismatch", 3, 95, 80))


def frame_distance(distance: Column) -> Column:
    return F.when(distance.isNull(), None).when(distance <= 5, finding("thumb-content-consistent", 0, 88, 80)).when(distance <= 10, finding("thumb-content-minor-diff", 1, 80, 60)).when(distance <= 20, finding("thumb-content-significant-diff", 2, 82, 55)).otherwise(finding("thumb-content-differs", 3, 83, 60))


def pixel_difference(mad: Column) -> Column:
    return F.when(mad.isNull(), None).when(mad < 12, finding("thumb-pixel-consistent", 0, 75, 70)).when(mad < 35, finding("thumb-pixel-mild-diff", 1, 82, 60)).otherwise(finding("thumb-pixel-significant-diff", 2, 88, 65))


def cache_time(written: Column, cached: Column) -> Column:
    diff = F.abs(micros(written) - micros(cached))
    return F.when(diff.isNull(), None).when(diff < 2_000_000, finding("thumbsdb-date-match", 0, 95)).otherwise(finding("thumbsdb-date-mismatch", 2, 90, 70))


def ghost(present: Column) -> Column:
    return F.when(~present, finding("ghost-no-live-file", 2, 99, 75))


def file_hash(content: Column) -> Column:
    """SHA-256 in upper-case hex."""
    return F.upper(F.sha2(content, 256))


def png_integrity(content: Column) -> Column:
    """Size, signature, and the last IEND chunk in the last 256 bytes."""
    n = F.octet_length(content)
    tail = F.hex(F.substring(content, F.greatest(F.lit(1), n - 255), F.lit(256)))
    after = F.octet_length(F.substring_index(tail, "49454E44AE426082", -1)) / 2
    has = F.instr(tail, "49454E44AE426082") > 0
    return (
        F.when(content.isNull(), finding("png-read-error", 3, 90))
        .when(n < 20, finding("png-too-small", 4, 95, 80))
        .when(F.substring(content, F.lit(1), F.lit(8)) != F.unhex(F.lit("89504E470D0A1A0A")), finding("png-invalid-signature", 3, 99, 75))
        .when(~has, finding("png-missing-iend", 2, 99, 70))
        .when(after > 0, finding("png-appended-data", 2, 90, 60))
        .otherwise(finding("png-structure-ok", 0, 99))
    )


#: Leading bytes (hex, offset from 1) and the format they mean (fixed values).
MAGIC = (("FFD8FF", 1, "JPEG"), ("89504E470D0A1A0A", 1, "PNG"), ("474946", 1, "GIF"), ("424D", 1, "BMP"), ("49492A00", 1, "TIFF"), ("4D4D002A", 1, "TIFF"))
#: Extensions and the format they promise (fixed values).
EXTENSIONS = {".jpg": "JPEG", ".jpeg": "JPEG", ".jpe": "JPEG", ".jfif": "JPEG", ".png": "PNG", ".gif": "GIF", ".bmp": "BMP", ".dib": "BMP", ".tif": "TIFF", ".tiff": "TIFF", ".webp": "WebP", ".heic": "HEIF", ".heif": "HEIF", ".avif": "AVIF"}


def detect_format(content: Column) -> Column:
    """Format of the first 12 bytes; null for under 4 bytes or none known."""
    out = F.lit(None).cast("string")
    brand = F.decode(F.substring(content, F.lit(9), F.lit(4)), "ISO-8859-1")
    out = F.when((F.octet_length(content) >= 12) & (F.substring(content, F.lit(5), F.lit(4)) == F.lit(b"ftyp")), F.when(brand.isin("heic", "heix", "mif1"), "HEIF").when(brand.isin("avif", "avis"), "AVIF").otherwise("IsoBmff")).otherwise(out)
    out = F.when((F.substring(content, F.lit(1), F.lit(4)) == F.lit(b"RIFF")) & (F.substring(content, F.lit(9), F.lit(4)) == F.lit(b"WEBP")), "WebP").otherwise(out)
    for mark, at, name in reversed(MAGIC):
        out = F.when(F.substring(content, F.lit(at), F.lit(len(mark) // 2)) == F.unhex(F.lit(mark)), name).otherwise(out)
    return F.when(F.octet_length(content) >= 4, out)


def expected_format(ext: Column) -> Column:
    out = F.lit(None).cast("string")
    for e, name in EXTENSIONS.items():
        out = F.when(F.lower(ext) == e, name).otherwise(out)
    return out
