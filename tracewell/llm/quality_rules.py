"""Quality rules: counts of words, symbols and repeats, and bands of zstandard ratios.

A text that repeats itself compresses far better than prose of its length, and noise hardly at
all. The ratio (compressed bytes / bytes) is held against a band that depends on the length, for
the whole text and for each fixed chunk of it.

Defined cases: a null or empty text has no words, fails the base rule and has ratio null; one row
comes out for each row that goes in, repeated ids included; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map, keyed, raw_bytes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: (bytes below, least ratio, largest ratio) of a whole text at level 3. Ratios fall with length,
#: since zstandard learns as it goes; below 100 bytes the frame itself outweighs the text.
BANDS = (
    (100, 0.00, 9.00),
    (200, 0.45, 1.20),
    (400, 0.50, 0.95),
    (800, 0.475, 0.85),
    (1_600, 0.455, 0.76),
    (3_200, 0.44, 0.70),
    (6_400, 0.415, 0.66),
    (12_800, 0.395, 0.64),
    (float("inf"), 0.33, 0.62),
)
#: Chunks of so many bytes, each held against its own band; more bad ones than this share reject.
CHUNK = 4_096
CHUNK_BAND = (0.36, 0.72)
MAX_BAD_CHUNKS = 0.5


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.uint64)
    if len(seen) == len(words):
        return 0
    hashes = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return 0
    flagged = np.zeros(n, dtype=bool)
    flagged[order[1:][same]] = flagged[order[:-1][same]] = True
    at = np.flatnonzero(flagged)
    windows = np.lib.stride_tricks.sliding_window_view(ids, width)[at]  # compared in full: a hash alone decides nothing
    _, inverse, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    at = at[counts[inverse.ravel()] > 1]
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


_DROP_WORD = bytes(range(0x80, 0xC0)) + b" \t\n\r\x0b\x0c"


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text's UTF-8."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(raw.translate(None, _DROP_WORD)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def compression(raw: bytes, zstd: zstandard.ZstdCompressor, bands=BANDS, chunk: int = CHUNK) -> tuple[float | None, int, int, bool]:
    """Whole ratio, number of chunks, of those out of band, and whether the text is in its bands.

    The tail of a text counts as a chunk from half a chunk's length on.
    """
    if not raw:
        return None, 0, 0, False
    ratio = len(zstd.compress(raw)) / len(raw)
    least, most = next((lo, hi) for below, lo, hi in bands if len(raw) < below)
    parts = [raw[i : i + chunk] for i in range(0, len(raw), chunk)] if len(raw) > chunk else []
    if parts and len(parts[-1]) < chunk // 2:
        parts.pop()
    bad = sum(not CHUNK_BAND[0] <= len(zstd.compress(p)) / len(p) <= CHUNK_BAND[1] for p in parts)
    return ratio, len(parts), bad, least <= ratio <= most and bad <= MAX_BAD_CHUNKS * len(parts)


FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("ratio", T.DoubleType()),
    T.StructField("n_chunks", T.LongType()),
    T.StructField("n_bad_chunks", T.LongType()),
]


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> DataFrame:
    """doc_id with the counts, base_failed, kept, and the ratios behind the verdict. No shuffle."""

    def compute(batch: pa.RecordBatch) -> dict:
        zstd = zstandard.ZstdCompressor(level=level, write_checksum=False)
        rows = []
        for raw in raw_bytes(batch.column("text")):
            counts = base_counts(raw)
            failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
            ratio, chunks, bad, fine = compression(raw, zstd)
            rows.append((*counts, failed, fine and not failed, ratio, chunks, bad))
        return {f.name: list(c) for f, c in zip(FIELDS, zip(*rows, strict=True), strict=True)} if rows else {f.name: [] for f in FIELDS}

    return arrow_map(keyed(df, id_col, text_col), compute, FIELDS)
