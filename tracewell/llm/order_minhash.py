"""Order MinHash fingerprints, which follow edit distance, and a document's likeness to its neighbours.

For each of ``sketches`` hash functions the two least of a text's occurrence-numbered k-mers are
taken, put in the order of the text, and hashed as a tuple. Two texts share a tuple only if they
share both k-mers in the same order. The square root of the share of equal tuples puts the
likeness on the scale of single k-mers: 0 without any, 1 for equal texts.

Three of four functions take k-mers of words, every fourth those of characters, in all texts alike:
words tell long texts apart, and characters texts of a few words, of which an edit spares few.

Defined cases: a null text is empty; an empty text (or one of white space) has an empty
fingerprint, alike (1) to another empty one only; a text shorter than a k-mer is one k-mer; equal
ids are ordered by their text; nulls among the ids come first; a lone document is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import keyed

#: Words and characters of a k-mer.
K, K_CHARS = 2, 5
#: What stands before and after a text, so that its k-mers of characters are more than one: no code point.
BEYOND = 0x110000
#: Every so manieth function takes k-mers of characters.
CHARS_EVERY = 4
SKETCHES = 64
_STEP = 32_768
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _ODD)
    return seeds[:n] | np.uint64(1), seeds[n:]


def _numbered(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the occurrence-numbered k-mers of a sequence, in its order."""
    n = max(1, len(units) - k + 1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(units))):
        h = _mix(h + _ODD) ^ (units[j : j + n] * np.uint64(2 * j + 0x5851F42D4C957F2D))
    order = np.argsort(h, kind="stable")
    first = np.empty(n, dtype=bool)
    first[0] = True
    first[1:] = h[order][1:] != h[order][:-1]
    at = np.arange(n)
    number = np.empty(n, dtype=np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return _mix(h + number * np.uint64(0xD6E8FEB86659FD93))


def kmers(text: str, k: int = K, k_chars: int = K_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-numbered k-mers of words and of characters, in text order; none without words."""
    split = text.encode("utf-8", "surrogatepass").split()
    if not split:
        return (np.empty(0, dtype=np.uint64),) * 2
    edge = [BEYOND] * (k_chars - 1)
    chars = np.concatenate([edge, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), edge]).astype(np.uint64) * _ODD
    return _numbered(np.array([xxhash.xxh3_64_intdigest(w) for w in split], dtype=np.uint64), k), _numbered(chars, k_chars)


def _pairs(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each function ``a * x + b`` a 32-bit hash of its two least k-mers in text order."""
    rows = np.arange(len(a))
    value = np.full((len(a), 2), np.iinfo(np.uint64).max, dtype=np.uint64)
    place = np.full((len(a), 2), -1, dtype=np.int64)
    for at in range(0, len(x), _STEP):  # long texts in steps, so that memory doesn't follow their length
        h = a[:, None] * x[None, at : at + _STEP] + b[:, None]
        for _ in range(2):
            i = h.argmin(axis=1)
            v = h[rows, i]
            value, place = np.column_stack([value, v]), np.column_stack([place, at + i])
            h[rows, i] = np.iinfo(np.uint64).max
            if h.shape[1] == 1:
                break
        two = np.argsort(value, axis=1, kind="stable")[:, :2]
        value, place = np.take_along_axis(value, two, 1), np.take_along_axis(place, two, 1)
    place = np.sort(place, axis=1)
    one = np.where(place[:, 0] < 0, np.uint64(0), x[np.maximum(place[:, 0], 0)])
    return (_mix(_mix(one + _ODD) + x[place[:, 1]]) >> np.uint64(32)).astype(np.uint32)


def sketch(text: str, k: int = K, sketches: int = SKETCHES) -> np.ndarray:
    """A 32-bit hash for each function; none for a text without words."""
    by_words, by_chars = kmers(text, k)
    if not len(by_words):
        return np.empty(0, dtype=np.uint32)
    a, b = _multipliers(sketches)
    of_chars = np.arange(sketches) % CHARS_EVERY == CHARS_EVERY - 1
    out = np.empty(sketches, dtype=np.uint32)
    for x, mine in ((by_words, ~of_chars), (by_chars, of_chars)):
        out[mine] = _pairs(x, a[mine], b[mine])
    return out


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    if not len(one) or not len(two):
        return float(len(one) == len(two))
    return float(np.sqrt((one == two).mean()))


def as_text(one: np.ndarray) -> str:
    return one.astype(">u4").tobytes().hex()


FIELDS = [
    T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType()),
]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, sketches: int = SKETCHES) -> DataFrame:
    """doc_id and the sketch as hex, of each whole text. No shuffle."""
    from .common import arrow_map

    return arrow_map(keyed(df, id_col, text_col), lambda b: {"fingerprint": [as_text(sketch(t or "", k, sketches)) for t in b.column("text").to_pylist()]}, [T.StructField("fingerprint", T.StringType())])


def neighbour_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, sketches: int = SKETCHES, ranges: int | None = None) -> DataFrame:
    """Each document against its edited text and against the next document by ascending integer id.

    Ids are cut into ranges at their quantiles. Each range goes to one task, sorted, with the first
    document of the next range (of the first, after the last) as a guest; so one shuffle of the
    texts is enough, and no task sees more than a range.
    """
    spark = df.sparkSession
    src = keyed(df, id_col, text_col)
    low = F.lit(-(2**63)).cast("long")
    src = src.withColumn("at", F.coalesce(F.col("doc_id").cast("long"), low))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = src.agg(F.percentile_approx("at", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    bounds = np.unique(np.array(cuts, dtype=np.int64))  # as many as there are partitions

    @F.pandas_udf("int")
    def range_of(at):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, at.to_numpy(dtype=np.int64), side="left"), dtype="int32")

    src = src.withColumn("range", range_of("at"))
    firsts = sorted((r["range"], r["first"]) for r in src.groupBy("range").agg(F.min("at").alias("first")).collect())  # a row for each range
    schema = T.StructType([src.schema["doc_id"], *FIELDS])
    if not firsts:
        return spark.createDataFrame([], schema)
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}  # that of the first range is the last
    guests = src.where(F.col("at").isin([first for _, first in firsts])).withColumn("range", F.element_at(F.create_map(*[x for f, r in before.items() for x in (F.lit(f).cast("long"), F.lit(r).cast("int"))]), F.col("at")))
    both = src.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    # Range i is partition i: dealt by hash, some tasks would get several ranges and some none.
    dealt = both.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "guest", "at", F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        held: tuple | None = None
        closed = None  # the range whose guest has come
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, text, where, guest in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "range", "guest")), strict=True):
                    if closed == where:
                        continue
                    text = text or ""
                    own = sketch(text, k, sketches)
                    if held is not None:
                        rows.append(_compare(*held, text, own, k, sketches))
                    held = None if guest else (doc, text, own)
                    closed = where if guest else None
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return dealt.select("doc_id", "text", "range", "guest").mapInArrow(run, schema)


def _compare(doc, text: str, own: np.ndarray, following: str, next_sketch: np.ndarray, k: int, sketches: int) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    other = sketch(edited, k, sketches)
    return doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(other), likeness(own, other), likeness(own, next_sketch)
