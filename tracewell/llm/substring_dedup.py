"""Substring dedup by seed and extend: winnowed anchors, matches extended both ways, maximal repeats cut.

A text's 7-word grams are hashed and winnowed: of each 20-word window the least gram is its anchor,
so two texts that share 20 words share an anchor at the same place of the passage.

1. Seeds: documents meet on their anchors (:func:`seeds`, :func:`shared`); anchors met once go no further.
2. Extension: an anchor that others share is extended on the document's words, both ways, as far as
   its windows reach (13 words at most), and these words are sent to where the anchor's matches meet
   (:func:`extended`). There windows are compared word for word (:func:`repeats`): one that stood
   earlier, by doc_id and start, is a repeat. Hashes only bring candidates together.
3. Adjacent repeated windows merge into maximal repeats, whose words are removed.

Every occurrence is held against what came earlier, in a sorted stream, so copies make no pairs. Hot
anchors don't meet in one task: each batch sends one of its seeds to the anchor and spreads the others,
equal extensions of a batch are settled on the spot, and the extensions of an anchor of more than
``HOT`` places (a common phrase with unlike surroundings) meet by single windows, not by the anchor.

Defined cases: a null text has no words; texts under 20 words lose nothing; documents of equal id are
ordered by their text's hash, and rows equal in id and text are one document; a null id comes first;
very long texts are hashed in segments; an empty table gives an empty one; other columns pass through,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import raw_bytes, stash
from .minhash_dedup import word_hashes

WINDOW, GRAM = 20, 7
#: Places from which on an anchor's extensions meet by window.
HOT = 1000
SALTS = 64
#: Documents whose seeds or extensions a task holds at once.
_SLICE = 1024
_SEGMENT = 1 << 22
_M = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(0xFFFFFF)


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * _M + h[j : n + j]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    done, out = 1, x
    while 2 * done <= w:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(out) - (w - done)], out[w - done :]) if done < w else out


def anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first window and number of windows of each anchor."""
    grams = _rolled(words, gram)
    ranked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equals is the least
    place = (_window_min(ranked, window - gram + 1) & _PLACE).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return grams[place[start]], start, np.diff(np.append(start, len(place)))


#: Low bits of a seed's place: whether its batch has the anchor elsewhere too, whether another seed of it goes to the anchor.
_SURE, _SPREAD = 1, 2
_FIRST, _COUNT = 10, 2  # bits below the first window and below the number of windows


def seeds(src: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """A row for each anchor of (ref, text): anchor, ref, and place (first window, number of windows, flags)."""
    if window - gram + 1 >= 1 << (_FIRST - _COUNT):
        raise ValueError("windows are too long")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "ref", "place")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, _SLICE) for whole in batches for at in range(0, whole.num_rows, _SLICE)):
            refs, keys, places, seen = [], [], [], set()
            for ref, raw in zip(batch.column("ref").to_pylist(), raw_bytes(batch.column("text")), strict=True):
                if ref in seen:
                    continue
                seen.add(ref)
                words = raw.split()
                for at in range(0, max(1, len(words) - window + 1), _SEGMENT):
                    part = words[at : at + _SEGMENT + window - 1]
                    if len(part) >= window:
                        hashes, start, count = anchors(word_hashes(part), window, gram)
                        keys.append(hashes)
                        places.append((start + at) << _FIRST | count << _COUNT)
                        refs.append(np.full(len(hashes), ref, dtype=np.int64))
            if not keys:
                continue
            anchor, place = np.concatenate(keys).view(np.int64), np.concatenate(places)
            order = np.argsort(anchor, kind="stable")
            like = anchor[order][1:] == anchor[order][:-1]
            place[order[1:][like]] |= _SURE | _SPREAD
            place[order[:-1][like]] |= _SURE
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, np.concatenate(refs), place)], ["anchor", "ref", "place"])

    return src.select("ref", "text").mapInArrow(run, schema)


def shared(seeded: DataFrame) -> DataFrame:
    """The seeds whose anchor stands elsewhere too, each with its place and whether the anchor is hot."""
    route = F.when(F.col("place").bitwiseAND(_SPREAD) != 0, F.xxhash64("ref", "place")).otherwise(F.col("anchor"))
    met = seeded.withColumn("route", route).withColumn("n", F.count("*").over(Window.partitionBy("route")))
    met = stash(met.where((F.col("n") > 1) | (F.col("place").bitwiseAND(_SURE) != 0)).select("anchor", "ref", "place"), "shared")
    hot = met.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor", F.lit(True).alias("hot"))
    # A hot anchor has many rows: they are salted, and the few anchors repeated for each salt.
    hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return met.withColumn("salt", F.pmod("ref", F.lit(SALTS))).join(hot, ["anchor", "salt"], "left").drop("salt").withColumn("hot", F.coalesce("hot", F.lit(False)))


def extended(src: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, doc_id, ref, start, words, windows) of the shared seeds: the words of all windows about the anchor.

    Rows without words are repeats already, of so many windows; their key only spreads them. src has
    the columns doc_id, ref and text and maybe others, which are read along so that its shuffle by
    ref is the one that the cutting uses.
    """
    schema = T.StructType([T.StructField("key", T.LongType()), src.schema["doc_id"], T.StructField("ref", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("windows", T.IntegerType())])
    both = src.join(found.groupBy("ref").agg(F.collect_list(F.struct("anchor", "place", "hot")).alias("at_places")), "ref")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in (whole.slice(at, _SLICE) for whole in batches for at in range(0, whole.num_rows, _SLICE)):
            ids, refs, raws = batch.column("doc_id").to_pylist(), batch.column("ref").to_pylist(), raw_bytes(batch.column("text"))
            lists = batch.column("at_places")
            edges, flat = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist(), lists.flatten()
            anchor, place, hot = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("anchor", "place", "hot"))
            first: dict[tuple, tuple] = {}
            rows: list[tuple] = []
            for d in sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, refs[i])):
                words, me = raws[d].split(), (ids[d], refs[d])
                at = np.arange(edges[d], edges[d + 1])
                at = at[np.argsort(place[at], kind="stable")]
                for key, where, is_hot in zip(anchor[at].tolist(), place[at].tolist(), hot[at].tolist(), strict=True):
                    start, count = where >> _FIRST, where >> _COUNT & (1 << (_FIRST - _COUNT)) - 1
                    part = b" ".join(words[start : start + count + window - 1])
                    if first.setdefault((key, part), (me, start)) != (me, start):
                        rows.append((xxhash.xxh3_64_intdigest(b"%d %d" % (me[1], start)) - 2**63, d, start, None, count))
                    elif not is_hot:
                        rows.append((key, d, start, part, count))
                    else:
                        for j in range(start, start + count):
                            part = b" ".join(words[j : j + window])
                            if first.setdefault((None, part), (me, j)) != (me, j):
                                rows.append((xxhash.xxh3_64_intdigest(b"%d %d" % (me[1], j)) - 2**63, d, j, None, 1))
                            else:
                                rows.append((xxhash.xxh3_64_intdigest(part) - 2**63, d, j, part, 1))
            if rows:
                keys, docs, starts, parts, counts = zip(*rows, strict=True)
                taken = pa.array(docs, pa.int64())
                columns = [keys, batch.column("doc_id").take(taken), batch.column("ref").take(taken), starts, parts, counts]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return both.mapInArrow(run, schema)


def repeats(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, ref, start, stop): word spans of repeated windows; rows of a key come sorted by doc_id, ref and start."""
    schema = T.StructType([found.schema["doc_id"], found.schema["ref"], T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        held_key, held = None, {}  # of the key whose rows may go on in the next batch
        for batch in batches:
            key = batch.column("key").to_numpy()
            settled = batch.column("words").is_null().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            alone = np.zeros(len(key), dtype=bool)  # a key met once repeats nothing
            alone[edges[np.diff(np.append(edges, len(key))) == 1]] = True
            alone[[0, -1]] = False
            look = np.flatnonzero(~alone | settled)
            taken, begin, end = [], [], []
            columns = (batch.column(c).take(pa.array(look)).to_pylist() for c in ("doc_id", "ref", "start", "words", "windows"))
            for i, doc, ref, s, part, n in zip(look.tolist(), *columns, strict=True):
                if part is None:
                    taken.append(i)
                    begin.append(s)
                    end.append(s + n + window - 1)
                    continue
                if key[i] != held_key:
                    held_key, held = key[i], {}
                words, me, open_at = part.split(b" "), (doc, ref), None
                for j in range(n + 1):
                    again = j < n and held.setdefault(tuple(words[j : j + window]), (me, s + j)) != (me, s + j)
                    if again and open_at is None:
                        open_at = j
                    elif not again and open_at is not None:
                        taken.append(i)
                        begin.append(s + open_at)
                        end.append(s + j + window - 1)
                        open_at = None
            rows = pa.array(taken, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("ref").take(rows), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], schema=arrow)

    # One task a hash range of keys; equal keys of a partition follow each other.
    return found.repartition(F.col("key")).sortWithinPartitions("key", "doc_id", "ref", "start").mapInArrow(run, schema)


def repeated_spans(src: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """ref, span_id, spans (word intervals to remove, array of structs start, stop); of src with doc_id, ref and text."""
    found = repeats(extended(src, shared(seeds(src, window, gram)), window), window)
    return found.groupBy("ref", F.col("doc_id").alias("span_id")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _removed(n: int, spans: list[dict] | None) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    for s in spans or ():
        edge[s["start"]] += 1
        edge[s["stop"]] -= 1
    return np.cumsum(edge[:-1]) > 0


DIGEST = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
_PIECE = re.compile(rb"[^ \t-\r]+[ \t-\r]*")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """df with the words of repeats cut from its text, what stands between words left as it is; with ``digest``, instead doc_id, n_words, n_removed, kept_sha256."""
    at, id_at = df.columns.index(text_col), df.columns.index(id_col)
    own = ["doc_id" if i == id_at else "text" if i == at else f"c{i}" for i in range(len(df.columns))]  # names of others can't clash
    base = df.toDF(*own).withColumn("text", F.col("text").cast("string"))
    if digest:
        base = base.select("doc_id", "text")
    base = base.withColumn("ref", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(base, window, gram)
    # By ref alone, as in extended(), so that both read one shuffle; unlike ids of one ref are told apart.
    both = base.join(spans, (base["ref"] == spans["ref"]) & ~F.coalesce(F.col("doc_id") != F.col("span_id"), F.lit(False)), "left").drop("ref", "span_id")
    if digest:
        schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), *DIGEST])
    else:
        schema = df.schema
    names = ["doc_id"] if digest else own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for whole in batches:
            for piece in range(0, whole.num_rows, 512):
                batch = whole.slice(piece, 512)
                raws, lists = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()
                columns = [batch.column(c) for c in names]
                if digest:
                    rows = []
                    for raw, cut in zip(raws, lists, strict=True):
                        words = (raw or b"").split()
                        gone = _removed(len(words), cut)
                        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if cut else words
                        rows.append((len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
                    columns += [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[1:], strict=True)] if rows else [pa.array([], f.type) for f in list(arrow)[1:]]
                else:
                    texts = []
                    for raw, cut in zip(raws, lists, strict=True):
                        if raw is None or not cut:
                            texts.append(None if raw is None else raw.decode())
                            continue
                        words = _PIECE.findall(raw)
                        gone = _removed(len(words), cut).tolist()
                        texts.append(b"".join(w for w, g in zip(words, gone, strict=True) if not g).strip().decode())
                    columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return both.mapInArrow(run, schema)
