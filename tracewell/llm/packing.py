"""Packing documents into sequences of a fixed token capacity, balanced by estimated cost.

The cost of a piece of L tokens is ``linear * L + quadratic * L * L``: attention within a piece is
quadratic. Pieces are dealt longest first to the sequence of least cost that has room; when none
has, a piece is cut to fill the roomiest one. Documents longer than a sequence first give off full
sequences. Work is split into blocks by a hash of the document, of some thousand documents and some
megabytes each, so that a block fits in a task and its padding is less than one sequence. Very long
documents are dealt to blocks in parts of ``PART`` tokens, and repeated rows of a batch to one block each.

Defined cases: a null or empty text is the end token alone; rows with equal ids, or without an id, are
documents of their own; ties in length go by id and place; an empty table gives no pieces; other
columns are not read.
"""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import keyed
from .pretokens import PUBLIC, pieces

CAPACITY = 1024
#: Documents and bytes of text in a block, on average; at most one part of a document's tokens comes on top.
BLOCK, BLOCK_BYTES = 4096, 8 << 20
#: Tokens in a part of a very long document: whole sequences.
PART = 64 * CAPACITY
#: Characters that are encoded at once, at least: a list of their ids takes some 36 bytes for each.
SLICE = 1 << 20
_CUT = re.compile(r"[A-Za-z0-9](?=[ \n])")


def deal(lengths: list[int], capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset) for pieces of 1 to ``capacity`` tokens each.

    As few sequences as the tokens need are opened, so less than one sequence's room stays unused.
    """
    n_seq = math.ceil(sum(lengths) / capacity)
    # Sequences by the room they have left, each list a heap by cost; best[r] is the least cost at room r.
    by_room: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    by_room[capacity] = [(0.0, s) for s in range(n_seq)]
    best = np.full(capacity + 1, np.inf)
    best[capacity] = 0.0 if n_seq else np.inf
    best[0] = np.inf
    out = []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[piece]
        while left:
            room = left + int(np.argmin(best[left:]))
            if not np.isfinite(best[room]):
                room = int(np.flatnonzero(np.isfinite(best))[-1])
            take = min(left, room)
            cost, seq = heappop(by_room[room])
            best[room] = by_room[room][0][0] if by_room[room] else np.inf
            out.append((piece, start, take, seq, capacity - room))
            if rest := room - take:
                heappush(by_room[rest], (cost + linear * take + quadratic * take * take, seq))
                best[rest] = by_room[rest][0][0]
            start, left = start + take, left - take
    return out


def _slices(text: str, pattern: str) -> Iterator[str]:
    """Parts of a long text, cut where the pattern always ends a match: after a letter or digit, before a blank or line end."""
    at = 0
    while pattern == PUBLIC and len(text) - at > SLICE and (cut := _CUT.search(text, at + SLICE)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def ids_of(text: str, encoding, pattern: str) -> bytes:
    """Little-endian 16-bit ids of a whole text.

    The library's matcher has a stack that runs of some 1,000,000 blanks overflow; such parts are split here, and each match merged as it is.
    """
    out = []
    for part in _slices(text, pattern):
        try:
            ids = encoding.encode_ordinary(part)
        except BaseException as failed:
            if type(failed).__name__ != "PanicException":  # of no module that can be imported, and no Exception
                raise
            ids = [i for piece in pieces(part, pattern) for i in encoding._encode_single_piece(piece)]
        out.append(np.array(array("H", ids), dtype="<u2").tobytes())
    return b"".join(out)


def _byte_of() -> dict[str, int]:
    """The printable characters that stand for bytes in vocabulary files, each with its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(vocabulary: str) -> dict[bytes, int]:
    """Token bytes to id, without special tokens, of a byte-level BPE file (.json) or a rank file."""
    with open(vocabulary, "rb") as file:
        content = file.read()
    if not vocabulary.endswith(".json"):
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    told = json.loads(content)
    special = {x["content"] for x in told["added_tokens"]}
    byte = _byte_of()
    return {bytes(byte[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}


def tokenised(df: DataFrame, vocabulary: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """doc_id, key (what deals to blocks), start, doc_tokens, and ids (16 bit, end token included): a row for each ``part`` tokens of each whole text.

    The vocabulary's merges run in the rank order of its ids, which equals the order of its merge
    list; a test holds this against the tokenizers library. Texts are encoded whole.
    """
    spark = df.sparkSession
    table = ranks_of(vocabulary)  # 50,000 entries, of fixed size
    if max(end_id, *table.values()) >= 1 << 16:
        raise ValueError("ids must fit 16 bits")
    ranks = spark.sparkContext.broadcast(table)
    end = np.array([end_id], dtype="<u2").tobytes()
    src = keyed(df, id_col, text_col).withColumn("key", F.xxhash64("doc_id", "text"))
    schema = T.StructType([src.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("key", "start", "doc_tokens")], T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        arrow = to_arrow_schema(schema)
        encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})  # some 20 ms a task
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            met, rows = {}, []
            for d, (key, text) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                ids = ids_of(text or "", encoding, pattern) + end
                for at in range(0, len(ids), 2 * part):
                    met[key] = n = met.get(key, -1) + 1  # parts and repeated rows go to a block each
                    rows.append((d, (key + n + 2**63) % 2**64 - 2**63, at // 2, len(ids) // 2, ids[at : at + 2 * part]))
            if rows:
                docs, *columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(docs)).cast(arrow.field(0).type), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    return src.mapInArrow(run, schema)


PIECES = [
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
]


def pack_documents(df: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, block: int = BLOCK, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    One shuffle, of the ids at two bytes each.
    """
    n_docs, n_bytes = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()
    blocks = max(1, math.ceil(n_docs / block), math.ceil(n_bytes / BLOCK_BYTES))
    src = tokenised(df, vocabulary, pattern, 0, id_col, text_col, part)
    id_field = src.schema["doc_id"]
    fields = [id_field, *PIECES] + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    schema = T.StructType(fields)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        base = key[0].as_py() << 32
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])  # the order of arrival decides nothing
        owner: list[int] = []
        starts: list[int] = []
        lengths: list[int] = []
        docs = [np.frombuffer(x, dtype="<u2") for x in table.column("ids").to_pylist()]
        first, whole = table.column("start").to_pylist(), table.column("doc_tokens").to_pylist()
        for d, ids in enumerate(docs):
            for at in range(0, len(ids), capacity):
                owner.append(d)
                starts.append(at)
                lengths.append(min(capacity, len(ids) - at))
        rows: dict[str, list] = {f.name: [] for f in fields[1:]}
        taken = []
        for piece, inner, length, seq, offset in deal(lengths, capacity, linear, quadratic):
            d, at = owner[piece], starts[piece] + inner
            cut = docs[d][at : at + length]
            taken.append(d)
            for name, value in (("start", first[d] + at), ("length", length), ("ids_crc32", zlib.crc32(cut.astype("<u4").tobytes())), ("doc_tokens", whole[d]), ("sequence_id", base + seq), ("offset", offset)):
                rows[name].append(value)
            if with_ids:
                rows["ids"].append(cut.tobytes())
        arrow = to_arrow_schema(schema)
        ids = table.column("doc_id").take(pa.array(taken, pa.int64())).combine_chunks()
        return pa.Table.from_arrays([ids.cast(arrow.field(0).type)] + [pa.array(rows[f.name], f.type) for f in list(arrow)[1:]], schema=arrow)

    kept = ["doc_id", "start", "doc_tokens", "ids"]
    return src.select(*kept, F.pmod("key", F.lit(blocks)).alias("block")).groupBy("block").applyInArrow(lambda key, rows: pack(key, rows.select(kept)), schema)
