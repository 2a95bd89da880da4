"""The relation of a source's items: live, ghost, carved and backed-up rows, their orders, contributors and field candidates.

A row is (name, path, sort_order, icon, size_text, size_bytes, presence, source); :func:`item_rows`
makes it of whatever table lists the items, and sources are united by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Orders that a listing's columns may be sorted by.
SORTABLE = ("name", "size_bytes", "presence", "source", "dimensions", "date", "camera", "format", "duplicate_count", "workflow", "findings")


def item_rows(df: DataFrame, name: Column, path: Column, size: Column, presence: str | Column, source: str | Column, sort_order: int = 2, *more: Column) -> DataFrame:
    """Rows of the item relation; ghosts have the ghost's icon."""
    there = presence if isinstance(presence, Column) else F.lit(presence)
    icon = F.when(there == "Ghost", "\U0001f47b").otherwise(S.item_icon(name))
    kind = source if isinstance(source, Column) else F.lit(source)
    return df.select(name.alias("name"), path.alias("path"), F.lit(sort_order).alias("sort_order"), icon.alias("icon"), S.size_text(size).alias("size_text"), F.coalesce(size.cast("long"), F.lit(0)).alias("size_bytes"), there.alias("presence"), kind.alias("source"), *more)


def live_rows(df: DataFrame, name: str, path: str, size: str) -> DataFrame:
    return item_rows(df, F.col(name), F.col(path), F.col(size), "Present", "Live file")


def ghost_rows(df: DataFrame, name: str = "key", source: str = "source") -> DataFrame:
    """Of (key, source) as :func:`.evidence.ghosts` gives them: no path and no size."""
    return item_rows(df, F.col(name).cast("string"), F.lit(""), F.lit(None).cast("long"), "Ghost", F.col(source), 3)


def carved_rows(df: DataFrame, offset: str, length: str, extension: str) -> DataFrame:
    name = F.concat(F.lit("carved_"), F.lower(F.hex(F.col(offset).cast("long"))), F.col(extension))
    return item_rows(df, name, F.lit(""), F.col(length), "Carved", "Carved (signature)", 3)


def united(*sources: DataFrame) -> DataFrame:
    """All rows of all sources, repeated ones too."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def physical_paths(manifest: DataFrame, files: DataFrame, file_id: str, path: str, root: str) -> DataFrame:
    """manifest with physical_path: the file in the folder of its id's first two digits, else beside the manifest, else null.

    Two joins on paths; a path that several rows list counts once.
    """
    known = files.select(F.col(path).alias("physical")).distinct()
    nested = F.concat(F.lit(f"{root}/"), F.substring(F.col(file_id), F.lit(1), F.lit(2)), F.lit("/"), F.col(file_id))
    flat = F.concat(F.lit(f"{root}/"), F.col(file_id))
    out = manifest.withColumn("nested_path", nested).withColumn("flat_path", flat)
    out = out.join(known.withColumnRenamed("physical", "nested_found"), F.col("nested_path") == F.col("nested_found"), "left")
    out = out.join(known.withColumnRenamed("physical", "flat_found"), F.col("flat_path") == F.col("flat_found"), "left")
    return out.withColumn("physical_path", F.coalesce("nested_found", "flat_found")).drop("nested_path", "flat_path", "nested_found", "flat_found")


def backup_rows(resolved: DataFrame, domain: str, relative: str, size: str) -> DataFrame:
    """Item rows of a resolved manifest: in the backup, or a ghost where no file is."""
    there = F.when(F.col("physical_path").isNotNull(), "Backup").otherwise("Ghost")
    name = S.basename(F.col(relative))
    known = F.when(F.col("physical_path").isNotNull(), F.col(size))
    return item_rows(resolved, name, F.coalesce("physical_path", F.lit("")), known, there, S.backup_label(F.col(domain)), 2, F.col(domain).alias("domain"), F.col(relative).alias("relative"))


def backup_order(domain: str = "domain", relative: str = "relative") -> list[Column]:
    """The camera roll first, then by path, case aside."""
    return [F.when(F.startswith(F.lower(domain), F.lit("camerarolldomain")), 0).otherwise(1).asc(), F.lower(relative).asc(), F.col(relative).asc()]


def directory_order(path: str, is_directory: str) -> list[Column]:
    """Directories first, then by path, case aside."""
    return [F.col(is_directory).cast("int").desc(), F.lower(path).asc(), F.col(path).asc()]


def gap_order(path: str = "item_before") -> list[Column]:
    return [F.lower(F.col(path).cast("string")).asc(), F.col(path).asc()]


def sort_by(column: str, descending: bool = False, tie: str = "name") -> list[Column]:
    """The order of a listing by one of its sortable columns."""
    if column not in SORTABLE:
        raise ValueError(f"{column} can't be sorted by")
    return [F.col("sort_order").asc(), F.col(column).desc() if descending else F.col(column).asc(), F.col(tie).asc()]


def visible(df: DataFrame, hidden: list[str]) -> DataFrame:
    """df without the columns that are hidden."""
    return df.select(*[c for c in df.columns if c not in hidden])


def backups(files: DataFrame, path: str, info: DataFrame, info_path: str, info_text: str) -> DataFrame:
    """root, udid, device_name, last_backup of each folder that holds a Manifest.db; names and dates from the Info.plist beside it."""
    folder = lambda c: F.regexp_replace(F.col(c), r"[/\\][^/\\]*$", "")
    value = lambda key, tag: F.nullif(F.regexp_extract(F.col(info_text), rf"(?s)<key>{key}</key>.*?<{tag}>(.*?)</{tag}>", 1), F.lit(""))
    roots = files.where(S.basename(F.col(path)) == "Manifest.db").select(folder(path).alias("root")).distinct()
    told = info.where(S.basename(F.col(info_path)) == "Info.plist").groupBy(folder(info_path).alias("root")).agg(F.min(F.struct(value("Device Name", "string").alias("name"), value("Last Backup Date", "date").alias("date"))).alias("i"))
    udid = S.basename(F.col("root"))
    return roots.join(told, "root", "left").select("root", udid.alias("udid"), F.coalesce("i.name", udid).alias("device_name"), F.to_timestamp(F.col("i.date")).alias("last_backup"))


def android_thumbnails(df: DataFrame, path: str, description: str, header_time: str, original_time: str, modified: str) -> DataFrame:
    """path, original_name, taken of an Android thumbnail folder's JPEG files, of their Exif values.

    The name is the description's, if that has a dot, else the file's own unless it is a number; the
    time is the header's, else the original's, else the file's.
    """
    name, own = F.trim(F.col(description)), S.stem(F.col(path))
    told = F.when((name != "") & (F.instr(name, ".") > 0), S.basename(name))
    inferred = F.when((own != "") & own.try_cast("long").isNull(), F.concat(own, F.lit(".jpg")))
    return df.where(S.extension(F.col(path)) == ".jpg").select(F.col(path).alias("path"), F.coalesce(told, inferred).alias("original_name"), F.coalesce(header_time, original_time, modified).alias("taken"))


def extractable(data: Column, offset: Column, length: Column) -> Column:
    """Whether an embedded artifact's bytes are at hand or can be found."""
    return F.coalesce(F.octet_length(data) > 0, F.lit(False)) | (offset.isNotNull() & F.coalesce(length > 0, F.lit(False)))


def has_bytes(*sources: Column) -> Column:
    """Whether any source of an item's bytes is there."""
    return reduce(lambda a, b: a | b, (F.coalesce(s.cast("string"), F.lit("")) != "" for s in sources))


#: Type of an embedded artifact to the priority of its finding and the confidence of its reading (fixed values).
ARTIFACTS = {"DepthMap": (1, 70), "GainMap": (0, 70), "MotionPhotoVideo": (1, 70), "SecondaryImage": (1, 70), "Unknown": (2, 50)}


def located_only(declared: DataFrame, located: DataFrame, keys: tuple[str, ...] = ("item", "type")) -> DataFrame:
    """Declared artifacts of which none of that type was located in the file, with those that were."""
    return located.unionByName(declared.join(located.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def artifact_findings(df: DataFrame, item: str = "item", kind: str = "type", name: str = "name", length: str = "length", confidence: str = "confidence") -> DataFrame:
    """A finding for each embedded artifact."""
    priority = F.coalesce(*[F.when(F.col(kind) == k, p) for k, (p, _) in ARTIFACTS.items()], F.lit(0))
    read = F.coalesce(*[F.when(F.col(kind) == k, c) for k, (_, c) in ARTIFACTS.items()], F.lit(70))
    hint = F.when(F.col(length) > 0, F.concat(F.lit(" ("), F.format_number(F.col(length), 0), F.lit(" bytes)"))).otherwise("")
    return df.select(F.col(item).alias("item"), F.concat(F.lit("embedded-"), F.lower(kind)).alias("id"), F.lit("Embedded Artifact").alias("category"), priority.alias("priority"), F.col(confidence).alias("observed"), read.alias("interpreted"), F.concat(F.col(name), hint, F.lit(" detected.")).alias("observation"))


POLICIES = ("CoreOnly", "CoreAndOpenSource", "CoreAndSigned", "Full")


def permitted(policy: Column, open_source: Column, signature: Column) -> Column:
    """Whether a plugin may run under a policy; an unknown policy permits none."""
    return F.coalesce(F.when(policy == "CoreAndOpenSource", open_source).when(policy == "CoreAndSigned", signature.isNotNull()).when(policy == "Full", True), F.lit(False))


def contributors(df: DataFrame, item: str, c: dict[str, str]) -> DataFrame:
    """item, place, kind, description, confidence of what each item's row rests on.

    ``c`` names df's columns for presence, path, size_text, resolution, camera, date, gps, thumbs_path,
    thumbs_date, thumbcache_path, thumbcache_hash, zb_path and format; columns may be null.
    """
    v = {k: F.coalesce(F.col(n).cast("string"), F.lit("")) for k, n in c.items()}
    has = {k: x != "" for k, x in v.items()}
    ghost = v["presence"] == "Ghost"
    kind = F.when(has["thumbs_path"], "Thumbs.db").when(has["zb_path"], "ZbThumbnail.info").when(has["thumbcache_path"], "Thumbcache").otherwise("Cache")
    cached = F.when(kind == "Thumbcache", "Windows thumbcache").when(kind == "ZbThumbnail.info", "Zoner Photo Studio cache").otherwise("Windows Explorer")
    hashed = F.upper(F.lpad(F.hex(F.col(c["thumbcache_hash"]).cast("long")), 16, "0"))

    def entry(place: int, shown: Column, name: Column | str, text: Column, confidence: float | Column) -> Column:
        return F.when(shown, F.struct(F.lit(place).alias("place"), (name if isinstance(name, Column) else F.lit(name)).alias("kind"), text.alias("description"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence")))

    exif = F.concat_ws("  ·  ", *[F.when(has[k], v[k]) for k in ("resolution", "camera", "date")])
    mismatch = F.when(F.instr(v["format"], "⚠") > 0, " — extension mismatch").otherwise("")
    entries = F.array(
        entry(0, ghost, kind, F.concat(F.lit("Cached thumbnail from "), cached, F.lit(" — original file not found on disk.")), 0.85),
        entry(0, ~ghost, "Live file", F.when(has["size_text"], F.concat(v["size_text"], F.lit(" on disk"))).otherwise("File present on disk"), 1.0),
        entry(1, has["resolution"], "EXIF metadata", exif, 0.95),
        entry(2, has["gps"], "GPS coordinates", v["gps"], 0.9),
        entry(3, ~ghost & has["thumbs_path"], "Thumbs.db", F.when(has["thumbs_date"], F.concat(F.lit("Cached thumbnail dated "), v["thumbs_date"])).otherwise("Cached thumbnail present"), 0.85),
        entry(4, ~ghost & has["thumbcache_path"], "Thumbcache", F.concat(F.lit("Windows Explorer thumbnail cache (hash: "), hashed, F.lit(")")), 0.8),
        entry(5, ~ghost & has["zb_path"], "ZbThumbnail.info", F.lit("Zoner Photo Studio thumbnail cache"), 0.8),
        entry(6, has["format"], "Format detection", F.concat(F.lit("Detected: "), v["format"], mismatch), 0.95),
    )
    return df.select(F.col(item).alias("item"), F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("item", "e.*")


#: Column of a summary, field, source, confidence (fixed values); dates are written to the second.
CANDIDATES = (
    ("original_time", "Date", "EXIF DateTimeOriginal", 95), ("digitized_time", "Date", "EXIF DateTimeDigitized", 85), ("header_time", "Date", "EXIF DateTime (IFD0)", 70),
    ("written_time", "Date", "Filesystem last-write", 50), ("created_time", "Date", "Filesystem creation", 40), ("thumbs_time", "Date", "Thumbs.db cache date", 30),
    ("xmp_created", "Date", "XMP CreateDate", 80), ("xmp_modified", "Date", "XMP ModifyDate", 60),
    ("camera", "Camera", "EXIF", 95), ("software", "Software", "EXIF", 90), ("xmp_tool", "Software", "XMP CreatorTool", 90), ("dimensions", "Dimensions", "EXIF", 99),
    ("lens", "Lens", "EXIF", 90), ("focal_length", "Focal length", "EXIF", 95), ("aperture", "Aperture", "EXIF", 95), ("exposure", "Exposure", "EXIF", 95), ("iso", "ISO", "EXIF", 95),
    ("color_space", "Color space", "EXIF", 90), ("orientation", "Orientation", "EXIF", 99), ("copyright", "Copyright", "EXIF", 85), ("artist", "Artist", "EXIF", 85),
)


def field_candidates(df: DataFrame, item: str) -> DataFrame:
    """item, field, source, raw, normalized (null), confidence of what a metadata summary says, for :func:`.evidence.reconcile`.

    Columns that df hasn't give nothing. The XMP's tool counts where it differs, case aside, from the
    software tag, which then has a confidence of 85; XMP dates count beside other dates, and the
    modification only beside the creation.
    """
    there = {c for c, *_ in CANDIDATES} & set(df.columns)
    col = lambda c: F.col(c) if c in there else F.lit(None)
    dated = F.coalesce(*[col(c).cast("string") for c, f, s, _ in CANDIDATES if f == "Date" and not s.startswith("XMP")]).isNotNull()
    two_tools = F.lower(col("xmp_tool").cast("string")) != F.lower(col("software").cast("string"))
    rules = {"xmp_tool": F.coalesce(two_tools, F.lit(False)), "xmp_created": dated, "xmp_modified": dated & col("xmp_created").isNotNull()}
    parts = []
    for c, field, source, confidence in CANDIDATES:
        if c not in there:
            continue
        raw = F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss") if field == "Date" else F.concat(F.lit({"iso": "ISO ", "orientation": "EXIF "}.get(c, "")), F.col(c).cast("string"))
        sure = F.when(rules["xmp_tool"], 85).otherwise(confidence) if c == "software" else F.lit(confidence)
        origin = F.when(rules["xmp_tool"], "EXIF IFD0").otherwise(source) if c == "software" else F.lit(source)
        shown = raw.isNotNull() & (raw != "") & rules.get(c, F.lit(True))
        parts.append(F.when(shown, F.struct(F.lit(field).alias("field"), origin.alias("source"), raw.alias("raw"), F.lit(None).cast("string").alias("normalized"), sure.alias("confidence"))))
    return df.select(F.col(item).alias("item"), F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("x")).select("item", "x.*")


def report_widths(df: DataFrame, caps: dict[str, int]) -> DataFrame:
    """One row: the greatest length of each column's text, capped."""
    return df.agg(*[F.least(F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)), F.lit(n)).alias(c) for c, n in caps.items()])
