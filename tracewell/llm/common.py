"""What the operators of this subpackage share: inputs, Arrow maps, and tables in the shared folder."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import bucketed_stash, drop_stash, stash  # noqa: F401  the operators take them from here

#: White space that separates words everywhere here: blank and \t to \r, as bytes.split() has it.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that other columns can have any name."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def raw_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def arrow_map(df: DataFrame, compute: Callable[[pa.RecordBatch], dict], fields: list[T.StructField], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """df's ``keep`` columns and those that ``compute`` makes of each Arrow batch, row by row.

    ``compute`` returns a list or Arrow array for each field. Batches are cut to 512 rows at
    most, which bounds what lists of Python objects take.
    """
    schema = T.StructType([df.schema[k] for k in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = compute(part)
                columns = [part.column(k) for k in keep] + [made[f.name] for f in fields]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == f.type else (c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
