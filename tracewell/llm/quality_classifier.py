"""Quality classifier: logistic regression over hashed word n-grams, fitted by FTRL-proximal.

Tokens are runs of word characters and runs of other visible characters; single tokens and pairs
of neighbours are hashed into ``2 ** BITS`` weights. A document's features are log counts scaled
to unit length; its score is the sigmoid of their sparse dot product with the weights.

The fit sees at most ``SAMPLE`` labelled rows, those of least hash, none of them held out
(crc32 of the id as text, mod 5, is 0). It runs in one task over hashed features; the weights, of
fixed size, are all that comes to the driver. Scoring covers every row, without a shuffle.

Defined cases: a null or empty text has the bias alone; labels other than 0 and 1 and ids without
a document teach nothing; without labels every score is 0.5; repeated rows score alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, held_out, keyed

BITS = 18
SAMPLE = 8_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.8, 1.0, 1e-3, 1e-3
THRESHOLD = 0.3

_TOKENS = re.compile(r"\w+|[^\w\s]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        self[token] = h = zlib.crc32(token.encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        return h


_MEMO: list[_Hashes] = [_Hashes()]


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values; index 0 is the bias."""
    if len(_MEMO[0]) > 300_000:
        _MEMO[0] = _Hashes()
    memo = _MEMO[0]
    one = np.array([memo[t] for t in _TOKENS.findall(text)], dtype=np.uint64)
    if not len(one):
        return np.zeros(1, dtype=np.int64), np.ones(1)
    two = (one[:-1] * np.uint64(0xD6E8FEB86659FD93)) ^ (one[1:] + _MULTIPLIER)
    both = np.concatenate([one ^ (one >> np.uint64(29)), two ^ (two >> np.uint64(31))]) * _MULTIPLIER
    index, counts = np.unique((both >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    values = np.log1p(counts)
    values /= np.sqrt((values * values).sum())
    inner = index > 0
    return np.concatenate([[0], index[inner]]), np.concatenate([[1.0], values[inner]])


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """FTRL-proximal with a learning rate for each weight, rows in the order given."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for index, value, label in rows:
            w = weights(index)
            g = (sigmoid(w @ value) - label) * value
            step = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha
            z[index] += g - step * w
            n[index] += g * g
    return weights(slice(None)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, bits: int = BITS) -> np.ndarray:
    """Weights learnt from the labelled rows that aren't held out."""
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    known = keyed(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers

    def hashed(batch: pa.RecordBatch) -> dict:
        made = [features(t or "", bits) for t in batch.column("text").to_pylist()]
        return {"index": [i.astype("<i4").tobytes() for i, _ in made], "value": [v.astype("<f4").tobytes() for _, v in made]}

    rows = arrow_map(known, hashed, [T.StructField("index", T.BinaryType()), T.StructField("value", T.BinaryType())], keep=("doc_id", "label"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((zlib.crc32(str(r["doc_id"]).encode()), str(r["doc_id"]), r["label"], r["index"], r["value"]) for b in batches for r in b.to_pylist())
        w = fit([(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float), y) for _, _, y, i, v in got], bits)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["weights"])

    return np.frombuffer(rows.repartition(1).mapInArrow(learn, "weights binary").first()["weights"], dtype=np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** bits floats

    def compute(batch: pa.RecordBatch) -> dict:
        w = shared.value
        scores = [sigmoid(w[i] @ v) for i, v in (features(t or "", bits) for t in batch.column("text").to_pylist())]
        return {"score": scores, "predicted": [int(s >= threshold) for s in scores]}

    out = arrow_map(keyed(docs, id_col, text_col), compute, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least the threshold. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            mask = [sigmoid(w[i] @ v) >= threshold for i, v in (features(str(t) if t is not None else "", bits) for t in batch.column(at).to_pylist())]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
