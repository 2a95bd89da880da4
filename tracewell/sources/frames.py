"""Table functions: binary payloads to rows, listings, and SQLite files."""

from __future__ import annotations

import sqlite3
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import containers, disks, embedded

PARSERS: dict[str, tuple[Callable[[bytes], list[tuple]], str]] = {
    "thumbcache": (containers.thumbcache, "offset long, hash long, data_size int, header_size int, name string"),
    "zb_thumbnails": (containers.zb_thumbnails, "name string, width int, height int, original_size long, filetime long, offset long, size long"),
    "thumbs_db": (containers.thumbs_db, "stream string, name string, filetime long, width int, height int, version int, payload_offset long, size long"),
    "carve": (containers.carve, "offset long, length long, format string, extension string"),
    "jpeg_segments": (containers.jpeg_segments, "offset long, marker int, length int, app string"),
    "jpeg_findings": (containers.jpeg_findings, "id string, priority int, observed int, interpreted int"),
    "heic": (containers.heic, "kind string, item long, type string, target long"),
    "exif": (containers.exif, "directory string, tag int, value string"),
    "xmp": (containers.xmp, "property string, directory string, value string"),
    "metadata_summary": (containers.metadata_summary, "name string, value string"),
    "embedded": (embedded.embedded, "type string, name string, offset long, length long, media_type string, confidence int, payload binary"),
    "disk_files": (disks.media_files, "partition int, filesystem string, file string, size long, deleted boolean, reference long"),
}


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of all files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)


def parse(df: DataFrame, parser: str, path: str = "path", content: str = "content") -> DataFrame:
    """path and the columns of the named parser, one row for each record; a payload that can't be read gives none."""
    function, ddl = PARSERS[parser]
    fields = T.StructType.fromDDL(ddl)
    schema = T.StructType([T.StructField("path", T.StringType()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):  # a payload at a time: they can be large
                name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                try:
                    rows = function(data) if data is not None or parser == "jpeg_findings" else []
                except Exception:  # a damaged file must not end the job
                    rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string())] + [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[1:], strict=True)], schema=arrow)

    return df.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, schema)


#: Queries that find media names in application databases; of each list the first that runs counts (fixed values).
APP_QUERIES = {
    "whatsapp": ("SELECT file_path FROM message_media WHERE file_path IS NOT NULL", "SELECT local_path FROM message_media WHERE local_path IS NOT NULL", "SELECT media_name FROM message_media WHERE media_name IS NOT NULL"),
    "telegram": ("SELECT file_name FROM documents WHERE file_name IS NOT NULL", "SELECT path FROM media WHERE path IS NOT NULL"),
    "signal": ("SELECT file_name FROM attachment WHERE file_name IS NOT NULL", "SELECT _data FROM part WHERE _data IS NOT NULL", "SELECT file_name FROM part WHERE file_name IS NOT NULL"),
}
MANIFEST_QUERY = "SELECT fileID, domain, relativePath FROM Files WHERE flags = 1"


def sqlite_rows(data: bytes, queries: tuple[str, ...]) -> list[tuple]:
    """Rows of the first query that runs on a SQLite file given as bytes."""
    with tempfile.NamedTemporaryFile(suffix=".db") as file:  # a task's own copy, gone when it is read
        file.write(data)
        file.flush()
        con = sqlite3.connect(f"file:{file.name}?mode=ro", uri=True)
        try:
            for q in queries:
                try:
                    return con.execute(q).fetchall()
                except sqlite3.Error:
                    continue
        finally:
            con.close()
    return []


def backup_manifest(df: DataFrame, extensions: tuple[str, ...] = disks.MEDIA, path: str = "path", content: str = "content") -> DataFrame:
    """path, file_id, domain, relative_path of a phone backup's media files."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(name, *r) for r in sqlite_rows(data or b"", (MANIFEST_QUERY,)) if r[2] and r[2].lower().endswith(extensions)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["path", "file_id", "domain", "relative_path"])

    return df.select(path, content).mapInArrow(run, "path string, file_id string, domain string, relative_path string")


def app_references(df: DataFrame, app: str, path: str = "path", content: str = "content") -> DataFrame:
    """path, app, name: base names of media that an application's database refers to."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {str(r[0]).replace("\\", "/").rsplit("/", 1)[-1] for r in sqlite_rows(data or b"", APP_QUERIES[app]) if r[0]}
                rows += [(name, n) for n in sorted(found) if n]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["path", "name"])

    return df.select(path, content).mapInArrow(run, "path string, name string").select("path", F.lit(app).alias("app"), "name")


def payload(content: Column, offset: Column, length: Column) -> Column:
    """Bytes of a range; null where the content ends before it does."""
    part = F.substring(content, offset + 1, length)
    return F.when(F.octet_length(part) == length, part)


def embedded_files(found: DataFrame, sources: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, file, bytes of the artifacts that :func:`parse` with ``embedded`` found and that can be had exactly.

    A file is named after its source and type; of several of one type the later ones have a number.
    """
    from pyspark.sql import Window

    from ..functions import scalars

    base = scalars.stem(F.col("path"))
    suffix = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in embedded.SUFFIXES.items()], F.lit("unknown_trailer"))
    extension = F.coalesce(*[F.when(F.col("media_type") == k, v) for k, v in embedded.EXTENSIONS.items()], F.lit(".bin"))
    nth = F.row_number().over(Window.partitionBy("path", "type").orderBy("offset", "length", "name"))
    named = found.where("payload IS NOT NULL OR offset IS NOT NULL").withColumn("file", F.concat(base, F.lit("__artifact__"), suffix, F.when(nth > 1, F.concat(F.lit("_"), nth.cast("string"))).otherwise(""), extension))
    joined = named.join(sources.select(F.col(path).alias("path"), F.col(content).alias("content")), "path")
    return joined.select("path", "file", F.coalesce("payload", payload(F.col("content"), F.col("offset"), F.col("length"))).alias("bytes")).where("octet_length(bytes) > 0")
