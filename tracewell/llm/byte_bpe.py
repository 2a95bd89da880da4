"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding by concatenation.

Two forms share the rank table, which is read once from a vocabulary file and is of fixed size:

* :func:`encode_by_words` folds each distinct word of a table once, with Spark's higher-order
  functions over its byte array, the ranks being a literal map (dealt over small maps by hash,
  since a map is searched from its start). Documents stay in blocks, as numbers of words; the
  folded words go to the blocks that hold them. :func:`fold_words` and :func:`join_pieces` encode
  and decode a table of words.
* :func:`encode_documents` applies merges to whole documents: each task folds a word once and
  remembers it, so that nothing is exploded or shuffled. The registered query uses it; README.md
  has the check tool's figures of both.

Words of over 128 bytes are folded by a heap where they are met: the higher-order fold copies its
state at each step, which is quadratic.

Defined cases: a null text is empty; an empty text has no tokens and its digests are those of
nothing; rows are independent, so repeated ids and ties change nothing.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, bucketed_stash, keyed
from .pretokens import pieces

#: Words a task remembers; then it starts anew, which bounds its memory.
MEMO = 400_000
#: Words of more bytes are folded by a heap.
LONG = 128
#: A block of documents ends with the one that reaches this many characters or distinct words.
BLOCK_CHARS, BLOCK_WORDS = 8 << 20, 250_000


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank, of a file with a base64 token and a rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x.strip())}


def fold_merges(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one word: the adjacent pair of least rank (leftmost of equals) merges until none has one."""
    if (whole := ranks.get(word)) is not None:
        return (whole,)
    if len(word) > 100:
        return _fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    none = 1 << 40
    scores = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while scores and (best := min(scores)) < none:
        at = scores.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del scores[at]
        if at > 0:
            scores[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        if at < len(scores):
            scores[at] = ranks.get(parts[at] + parts[at + 1], none)
    return tuple(ranks[p] for p in parts)


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same by a heap over linked parts: n log n, for words of any length."""
    n = len(word)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != stop:
            continue  # one of the two parts has merged meanwhile
        alive[mid] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if prev[i] >= 0 and (r := ranks.get(word[prev[i] : stop])) is not None:
            heapq.heappush(heap, (r, prev[i], i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return tuple(out)


def decode(ids: Iterable[int], tokens: dict[int, bytes] | list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


_TABLES: dict[str, tuple] = {}


def tables(content: bytes) -> tuple[dict[int, bytes], _Memo]:
    """Token bytes by rank, and the memo, which a Python worker keeps from task to task."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _TABLES:
        ranks = read_ranks(content)
        _TABLES[key] = ({v: k for k, v in ranks.items()}, _Memo(ranks))
    tokens, memo = _TABLES[key]
    if len(memo) > MEMO:
        memo.clear()
    return tokens, memo


class _Memo(dict):
    """Ids of each word met, as a joined string and a tuple."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, word: str) -> tuple[str, tuple[int, ...]]:
        ids = fold_merges(word.encode(), self.ranks)
        self[word] = out = (",".join(map(str, ids)), ids)
        return out


def encode_documents(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text (and ids, if asked for). No shuffle.

    ``vocabulary`` is the path of a rank file on the driver; its content (under 1 MB) is broadcast.
    """
    spark = df.sparkSession
    with open(vocabulary, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    def compute(batch: pa.RecordBatch) -> dict:
        tokens, memo = tables(content.value)
        out: dict[str, list] = {f.name: [] for f in fields}
        for text in batch.column("text").to_pylist():
            found = [memo[w] for w in pieces(text or "", pattern)]
            ids = list(chain.from_iterable(x[1] for x in found))
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join([x[0] for x in found]).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decode(ids, tokens)).hexdigest())
            if with_ids:
                out["ids"].append(ids)
        return out

    return arrow_map(keyed(df, id_col, text_col), compute, fields)


def rank_literal(ranks: dict[bytes, int], shards: int = 16_384) -> Column:
    """The ranks as a literal: an array of small maps by crc32, keyed by hexadecimal bytes.

    One JSON constant, which the optimizer folds; a map literal of 50,000 columns takes minutes to plan.
    """
    maps: list[dict[str, int]] = [{} for _ in range(shards)]
    for token, rank in ranks.items():
        key = token.hex().upper()
        maps[zlib.crc32(key.encode()) % shards][key] = rank
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,int>>")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def merge_column(word: Column, ranks: Column, shards: int = 16_384) -> Column:
    """:func:`_merges` with the literal bound to a variable, so that the plan holds it once."""
    return _let(ranks, lambda held: _merges(word, held, shards))


def _merges(word: Column, ranks: Column, shards: int) -> Column:
    """Ids of a word's UTF-8 by higher-order functions alone: array<int>.

    The word's bytes are an array, each in hexadecimal, which maps can be keyed by. A fold runs once
    for each byte but the first (no more merges can happen); its state is the parts and the ranks of
    the pairs of neighbours. A step merges the leftmost pair of least rank and looks up the two
    pairs beside it anew; without such a pair it returns the state.
    """
    none, nothing = 2**31 - 1, F.array().cast("array<int>")

    def rank(part: Column) -> Column:
        return F.element_at(F.get(ranks, (F.crc32(part) % F.lit(shards)).cast("int")), part)

    def of_pair(one: Column, two: Column) -> Column:
        return F.coalesce(rank(F.concat(one, two)), F.lit(none))

    def merged(state: Column, at: Column) -> Column:
        parts, known, n = state["parts"], state["ranks"], F.size(state["parts"])

        def around(part: Column) -> Column:
            left = F.when(at > 1, F.array(of_pair(F.get(parts, at - 2), part))).otherwise(nothing)
            right = F.when(at + 1 < n, F.array(of_pair(part, F.get(parts, at + 1)))).otherwise(nothing)
            return F.struct(
                F.concat(F.slice(parts, F.lit(1), at - 1), F.array(part), F.slice(parts, at + 2, n)).alias("parts"),
                F.concat(F.slice(known, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(known, at + 2, n)).alias("ranks"),
            )

        return _let(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1)), around)

    def step(state: Column, _: Column) -> Column:
        def least(best: Column) -> Column:
            return F.when(best < none, _let(F.array_position(state["ranks"], best).cast("int"), lambda at: merged(state, at))).otherwise(state)

        return _let(F.coalesce(F.array_min(state["ranks"]), F.lit(none)), least)

    def folded(raw: Column) -> Column:
        n = (F.length(raw) / 2).cast("int")
        start = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(raw, i * 2 - 1, F.lit(2)))
        pairs = _let(start, lambda p: F.struct(p.alias("parts"), F.transform(F.slice(p, 1, F.size(p) - 1), lambda x, i: of_pair(x, F.get(p, i + 1))).alias("ranks")))
        done = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), pairs, step)
        return F.when(n == 0, nothing).when(rank(raw).isNotNull(), F.array(rank(raw))).otherwise(F.transform(done["parts"], rank))

    return _let(F.hex(word.cast("binary")), folded)


def fold_words(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word") -> DataFrame:
    """word, ids: each distinct word folded once, by higher-order functions."""
    return words.select(F.col(word_col).alias("word")).where("word is not null").distinct().select("word", merge_column(F.col("word"), rank_literal(ranks)).alias("ids"))


def join_pieces(ids: Column, tokens: Column) -> Column:
    """The bytes of ids, whose hexadecimal pieces are in the array ``tokens`` by id."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(tokens, i)), ""))


class _Places(dict):
    """Number of each word met in a block: a token's id, else the size of the vocabulary plus its place; long words below 0."""

    def __init__(self, tokens: dict[str, int], ranks: dict[bytes, int], size: int):
        super().__init__(tokens)
        self.ranks, self.size = ranks, size
        self.words: list[str] = []
        self.long: list[tuple[int, ...]] = []

    def __missing__(self, word: str) -> int:
        if len(word) > LONG or len(raw := word.encode()) > LONG:
            self.long.append(fold_merges(word.encode(), self.ranks))
            out = -len(self.long)
        elif (rank := self.ranks.get(raw)) is not None:
            out = rank
        else:
            self.words.append(word)
            out = self.size + len(self.words) - 1
        self[word] = out
        return out

    def codes(self, words: list[str]) -> array:
        out = array("q", map(self.__getitem__, words))
        if self.long and min(out, default=0) < 0:
            return array("q", chain.from_iterable(self.long[-c - 1] if c < 0 else (c,) for c in out))
        return out


_SPLIT: dict[str, tuple] = {}


def _vocabulary(content: bytes) -> tuple[dict[bytes, int], dict[str, int], list[bytes], list[str]]:
    """Ranks, those of tokens that are text, token bytes by id, and decimal ids; a Python worker keeps them."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _SPLIT:
        ranks = read_ranks(content)
        spelled: dict[str, int] = {}
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
            try:
                spelled[token.decode()] = rank
            except UnicodeDecodeError:
                pass
        _SPLIT[key] = (ranks, spelled, by_id, [str(i) for i in range(len(by_id))])
    return _SPLIT[key]


def encode_by_words(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, each distinct word being folded once.

    Texts become numbers of tokens and of a block's other words, in a table bucketed by block. One
    shuffle of (block, place, word) meets equal words (its partitions are few bytes but long folds,
    so their number is given): the first of them is folded, the others take its ids. A second brings the ids to their block's bucket; documents aren't shuffled. A block is
    bounded by ``block_chars`` and ``block_words`` but for its last document. ``vocabulary`` is the
    path of a rank file on the driver; its content (under 1 MB) is broadcast.
    """
    spark = df.sparkSession
    with open(vocabulary, "rb") as file:
        raw = file.read()
    content = spark.sparkContext.broadcast(raw)
    table = keyed(df, id_col, text_col)
    id_field = table.schema["doc_id"]
    split_schema = T.StructType().add("block", T.LongType()).add("doc_ids", T.ArrayType(id_field.dataType)).add("sizes", T.ArrayType(T.LongType())).add("codes", T.BinaryType()).add("words", T.ArrayType(T.StringType()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, spelled, by_id, _ = _vocabulary(content.value)
        task, made = TaskContext.get().partitionId(), 0
        types = [pa.int64(), None, pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string())]
        names = split_schema.names

        def start() -> tuple:
            return [], array("q"), [], 0, _Places(spelled, ranks, len(by_id))

        ids, sizes, codes, chars, places = start()

        def block() -> pa.RecordBatch:
            held = pa.concat_arrays(ids)
            values = [task << 24 | made, None, list(sizes), b"".join(codes), places.words]
            columns = [pa.ListArray.from_arrays([0, len(held)], held) if t is None else pa.array([v], t) for v, t in zip(values, types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for at, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                numbers = places.codes(pieces(text, pattern))
                ids.append(batch.column("doc_id").slice(at, 1))
                sizes.append(len(numbers))
                codes.append(np.asarray(numbers, "<u4").tobytes())
                chars += len(text)
                if chars >= block_chars or len(places.words) >= block_words or len(ids) >= 1 << 16:
                    yield block()
                    made += 1
                    ids, sizes, codes, chars, places = start()
        if ids:
            yield block()

    blocks = bucketed_stash(table.mapInArrow(split, split_schema), "bpe", "block", 2 * table.rdd.getNumPartitions())
    same = Window.partitionBy("word").orderBy("block")
    first = F.row_number().over(same) == 1
    met = blocks.select("block", F.posexplode("words").alias("place", "word")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")
    folded = met.withColumn("first", first).withColumn("ids", F.when(F.col("first"), merge_column(F.col("word"), rank_literal(read_ranks(raw)))))
    ids = folded.select("block", "place", F.last("ids", ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, 0)).alias("ids"))

    def assemble(docs: pa.Table, found: pa.Table) -> pa.Table:
        _, _, by_id, decimals = _vocabulary(content.value)
        lists = found.sort_by("place").column("ids").to_pylist()
        spelled = decimals + [",".join(map(decimals.__getitem__, x)) for x in lists]
        decoded = by_id + [decode(x, by_id) for x in lists]
        counts = np.concatenate([np.ones(len(by_id), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))])
        out: list[list] = [[], [], []]
        for sizes, codes in zip(docs.column("sizes").to_pylist(), docs.column("codes"), strict=True):
            numbers, end = np.frombuffer(codes.as_buffer(), "<u4"), 0
            for size in sizes:
                here = numbers[end : end + size]
                end += size
                each = here.tolist()
                out[0].append(int(counts[here].sum()))
                out[1].append(hashlib.sha256(",".join(map(spelled.__getitem__, each)).encode()).hexdigest())
                out[2].append(hashlib.sha256(decode(each, decoded)).hexdigest())
        held = pa.chunked_array([x.values.slice(x.offsets[0].as_py(), x.offsets[-1].as_py() - x.offsets[0].as_py()) for x in docs.column("doc_ids").chunks], docs.schema.field("doc_ids").type.value_type)
        return pa.table([held, pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField("doc_id", id_field.dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return blocks.select("block", "doc_ids", "sizes", "codes").groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(assemble, schema)
