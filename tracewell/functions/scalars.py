"""Scalar functions: names, labels, dates, bits, formats. All are built-in expressions, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """With its dot, in lower case; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def contains_ignore_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def id_prefix(identifier: Column) -> Column:
    """What stands before the first dot; all of it where there is none or it comes first."""
    return F.when(F.instr(identifier, ".") > 1, F.substring_index(identifier, ".", 1)).otherwise(identifier)


def after_first_dash(domain: Column) -> Column:
    return F.when(F.instr(domain, "-") > 0, F.regexp_replace(domain, r"^[^-]*-", "")).otherwise(domain)


def xml_value(text: Column, tag: str) -> Column:
    """Content of the first element of that name, null without one."""
    return F.nullif(F.regexp_extract(text, rf"<{tag}[^>]*>([^<]*)</{tag}>", 1), F.lit(""))


def xml_attribute(text: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf'\b{name}="([^"]*)"', 1), F.lit(""))


def size_text(size: Column) -> Column:
    """Bytes as B, KB or MB by 1024; empty for null."""
    n = size.cast("double")
    return (
        F.when(size.isNull(), F.lit(""))
        .when(size < 1024, F.format_string("%d B", size.cast("long")))
        .when(size < 1024 * 1024, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))
    )


IMAGES = (".jpg", ".jpeg", ".png", ".tiff", ".tif", ".bmp", ".gif", ".webp", ".heic", ".heif", ".avif")
VIDEOS = (".mp4", ".mov", ".avi", ".mkv")


def item_icon(path: Column) -> Column:
    """A picture, a clapper board or a page, by extension."""
    ext = extension(path)
    return F.when(ext.isin(*IMAGES), "\U0001f5bc").when(ext.isin(*VIDEOS), "\U0001f3ac").otherwise("\U0001f4c4")


def backup_label(domain: Column) -> Column:
    """What a phone backup's domain stands for."""
    low = F.lower(domain)
    app = F.when(F.instr(domain, "-") > 0, F.concat(F.lit("iPhone App ("), after_first_dash(domain), F.lit(")"))).otherwise("iPhone App")
    return F.when(F.startswith(low, F.lit("camerarolldomain")), "iPhone Camera Roll").when(F.startswith(low, F.lit("mediadomain")), "iPhone Media").when(F.startswith(low, F.lit("appdomain")), app).otherwise(F.concat(F.lit("iPhone Backup ("), domain, F.lit(")")))


def looked_up(key: Column, table: dict, default: str | None = None) -> Column:
    """The entry of a fixed table, else the default."""
    found = F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    return F.coalesce(found, F.lit(default))


def confidence_label(score: Column) -> Column:
    """Fixed labels of a 0 to 100 score; below 0 is unknown."""
    return F.when(score < 0, "Unknown").when(score <= 19, "Very low").when(score <= 39, "Low").when(score <= 59, "Moderate").when(score <= 79, "High").otherwise("Very high")


#: Catalog version of a thumbnail database to the systems that wrote it (fixed values).
OS_HINTS = {4: "Windows 98/ME/2000", 5: "Windows XP", 6: "Windows XP SP1", 7: "Windows XP SP2+"}


def os_hint(version: Column) -> Column:
    out = F.lit(None).cast("string")
    for number, name in OS_HINTS.items():
        out = F.when(version == number, name).otherwise(out)
    return out


def camera_name(make: Column, model: Column) -> Column:
    """Make and model, the make once where the model starts with it."""
    m, k = F.trim(model), F.trim(make)
    return F.when(m.isNull() | (m == ""), k).when(k.isNull() | (k == "") | F.startswith(F.lower(m), F.lower(k)), m).otherwise(F.concat_ws(" ", k, m))


def gps_text(latitude: Column, longitude: Column) -> Column:
    return F.format_string("%.5f\u00b0%s, %.5f\u00b0%s", F.abs(latitude), F.when(latitude >= 0, "N").otherwise("S"), F.abs(longitude), F.when(longitude >= 0, "E").otherwise("W"))


def exif_time(text: Column) -> Column:
    """'yyyy:MM:dd HH:mm:ss' as a timestamp without zone; null if it isn't one."""
    return F.to_timestamp_ntz(F.when(text.rlike(r"^\d{4}:\d\d:\d\d \d\d:\d\d:\d\d$") & ~F.startswith(text, F.lit("0000")), text), F.lit("yyyy:MM:dd HH:mm:ss"))


def filetime(ticks: Column) -> Column:
    """100 ns since 1601 as a timestamp; null for 0 or less."""
    return F.when(ticks > 0, F.timestamp_micros((ticks / 10).cast("long") - F.lit(11_644_473_600_000_000).cast("long")))


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (taken as UTC)."""
    return F.unix_micros(time.cast("timestamp"))


def span_text(seconds: Column) -> Column:
    """Days, hours or minutes, whichever fits first."""
    s = seconds.cast("double")
    return F.when(s >= 86400, F.format_string("%.1f d", s / 86400)).when(s >= 3600, F.format_string("%.1f h", s / 3600)).otherwise(F.format_string("%.0f min", s / 60))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dhash(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """64-bit difference hash of row-major grey values: bit (row * 8 + column) where a pixel is darker than its right neighbour."""
    bits = [F.when(F.get(pixels, F.lit(r * width + c)) < F.get(pixels, F.lit(r * width + c + 1)), F.shiftleft(F.lit(1).cast("long"), r * (width - 1) + c)).otherwise(F.lit(0).cast("long")) for r in range(height) for c in range(width - 1)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return F.when(F.size(pixels) >= width * height, out)


def mean_difference(one: Column, two: Column) -> Column:
    """Mean absolute difference of two pixel arrays over the shorter one's length; null without pixels."""
    n = F.least(F.size(one), F.size(two))
    total = F.aggregate(F.zip_with(F.slice(one, F.lit(1), n), F.slice(two, F.lit(1), n), lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(n > 0, total / n)


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Grey value by BT.601, cut to a whole number."""
    return F.floor(0.299 * red + 0.587 * green + 0.114 * blue).cast("int")


def iso_time(text: Column) -> Column:
    """An ISO 8601 date of XMP as a timestamp; null if it isn't one."""
    return F.try_to_timestamp(text)


def round_half_even(x: Column) -> Column:
    return F.bround(x)


def quartile(x: Column, p: float) -> Column:
    """Linear interpolation at p * (n - 1)."""
    return F.percentile(x, p)
