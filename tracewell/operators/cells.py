"""All pairs of hashes, compared in cells: rows are dealt to blocks by hash, and each two blocks (or one with itself) are a cell.

Any two rows meet in exactly one cell, so nothing is missed and nothing found twice. A row is
copied to one cell for each block; the pairs themselves are never rows, only what is found of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a block: so few if that makes SPREAD blocks or fewer, and at most MOST.
FEW, SPREAD, MOST = 8_192, 16, 65_536
#: Hashes compared at once (what they take stays in a core's cache), and pairs found that go on together.
HIGH, WIDE, TOGETHER = 16, 4_096, 65_536


def block_count(n: int) -> int:
    return max(1, min(math.ceil(n / FEW), SPREAD), math.ceil(n / MOST))


def _deal(df: DataFrame, blocks: int) -> DataFrame:
    """df with its block and a row for each cell of it; ``bits`` is what rows are dealt by."""
    block = F.pmod(F.xxhash64("bits"), F.lit(blocks)).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.least("block", j) * blocks + F.greatest("block", j))
    placed = df.withColumn("block", block).withColumn("cell", F.explode(cells))
    return placed.repartition(blocks * (blocks + 1) // 2, "cell")


def _sides(key: tuple, batches: Iterator[pa.RecordBatch], blocks: int) -> tuple[pa.Table, pa.Table, bool]:
    table = pa.Table.from_batches(list(batches))
    i, j = divmod(key[0].as_py(), blocks)
    block = table.column("block").to_numpy()
    one = table.take(pa.array(np.flatnonzero(block == i)))
    return one, one if i == j else table.take(pa.array(np.flatnonzero(block == j))), i == j


def _bits(table: pa.Table) -> np.ndarray:
    return table.column("bits").to_numpy().view(np.uint64)


def _near(x: np.ndarray, y: np.ndarray, same: bool, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x, places in y and distances of pairs within the threshold, some TOGETHER at a time; of one block each pair once."""
    held, n = [], 0
    for i in range(0, len(x), HIGH):
        for j in range(i if same else 0, len(y), WIDE):
            part = y[j : j + WIDE]
            far = np.bitwise_count(x[i : i + HIGH, None] ^ part[None, :]).ravel()
            hit = np.flatnonzero(far <= threshold)
            u, v = hit // len(part) + i, hit % len(part) + j
            if same:
                hit, u, v = (a[v > u] for a in (hit, u, v))
            if len(hit):
                held.append((u, v, far[hit]))
                n += len(hit)
            if n >= TOGETHER:
                yield tuple(np.concatenate(a) for a in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(a) for a in zip(*held, strict=True))


def _forest(found: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of links between n nodes those that tie together what was not yet tied: as many components, fewer links than nodes."""
    root = np.arange(n)
    for u, v in found:
        apart = np.flatnonzero(root[u] != root[v])
        kept = []
        for k in apart.tolist():
            a, b = u[k], v[k]
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                kept.append(k)
        if kept:
            while (further := root[root]).tobytes() != root.tobytes():
                root = further
            yield u[kept], v[kept]


def _in_cells(df: DataFrame, blocks: int, compute, schema: T.StructType) -> DataFrame:
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in compute(*_sides(key, batches, blocks)):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    arrow = to_arrow_schema(schema)
    return _deal(df, blocks).groupBy("cell").applyInArrow(run, schema)


def _taken(table: pa.Table, name: str, places: np.ndarray) -> pa.Array:
    return table.column(name).take(pa.array(places)).combine_chunks()


def pairs(df: DataFrame, threshold: int, blocks: int) -> DataFrame:
    """u, v, distance of all pairs of rows (item, bits) at most ``threshold`` bits apart, each once, in no order."""
    kind = df.schema["item"].dataType
    schema = T.StructType([T.StructField("u", kind), T.StructField("v", kind), T.StructField("distance", T.IntegerType())])

    def compute(one: pa.Table, two: pa.Table, same: bool) -> Iterator[list[pa.Array]]:
        for u, v, far in _near(_bits(one), _bits(two), same, threshold):
            yield [_taken(one, "item", u), _taken(two, "item", v), pa.array(far)]

    return _in_cells(df.select("item", "bits"), blocks, compute, schema)


def links(df: DataFrame, threshold: int, blocks: int) -> DataFrame:
    """u, v: of all such pairs so many that the same rows (item, bits) are connected, fewer than a cell has rows."""
    kind = df.schema["item"].dataType
    schema = T.StructType([T.StructField("u", kind), T.StructField("v", kind)])

    def compute(one: pa.Table, two: pa.Table, same: bool) -> Iterator[list[pa.Array]]:
        after = 0 if same else len(one)
        found = ((u, v + after) for u, v, _ in _near(_bits(one), _bits(two), same, threshold))
        for u, v in _forest(found, after + len(two)):
            yield [_taken(one, "item", u), _taken(two, "item", v - after)]

    return _in_cells(df.select("item", "bits"), blocks, compute, schema)


def widest(df: DataFrame, blocks: int) -> DataFrame:
    """group_id, max_distance of the rows (group_id, bits): a row for each cell that a group has rows on both sides of."""
    schema = T.StructType([df.schema["group_id"], T.StructField("max_distance", T.IntegerType())])

    def compute(one: pa.Table, two: pa.Table, same: bool) -> Iterator[list[pa.Array]]:
        both = pa.concat_tables([one, two]).column("group_id").combine_chunks().dictionary_encode()
        code = both.indices.to_numpy()
        (cx, x), (cy, y) = ((c[o], b[o]) for c, b in ((code[: len(one)], _bits(one)), (code[len(one) :], _bits(two))) for o in [np.argsort(c, kind="stable")])
        shared = np.intersect1d(cx, cy)
        if not len(shared):
            return
        edges = [np.searchsorted(c, shared, side).tolist() for c in (cx, cy) for side in ("left", "right")]
        most = []
        for a, b, c, d in zip(*edges, strict=True):
            far = 0
            for i in range(a, b, HIGH):
                for j in range(c + (i - a if same else 0), d, WIDE):
                    far = max(far, int(np.bitwise_count(x[i : min(i + HIGH, b), None] ^ y[None, j : min(j + WIDE, d)]).max()))
            most.append(far)
        yield [both.dictionary.take(pa.array(shared)), pa.array(most, pa.int32())]

    return _in_cells(df.select("group_id", "bits"), blocks, compute, schema)
