"""MinHash near-dedup: universal hash minima, banding, signature and full-set verification, components.

1. A map gives each text the digest of its shingle set and its signature of ``BANDS * ROWS`` minima.
2. Texts of equal sets are one class, a node that the digest names; copies go no further.
3. Nodes that share a band share a bucket. In each bucket all members are paired with its
   centre alone: the member whose buckets are fullest, which is most often the original that the
   others vary. Pairs of likely signatures are confirmed on the full sets.
4. The links' components are found. Where buckets of a centre still hold several components, the
   centre's members are described by their differences from the set S of the shingles that most of
   them have. Let e be the size of a member's difference, n that of its set, h = (1 - t) / (1 + t) for
   the threshold t, f = e - h n, and m the member of the least f. If x and y link and x doesn't link
   with m, then e(x) + e(m) > h (n(x) + n(m)), and x and y share more than (f(y) - f(m)) / 2 elements of
   their differences. So all are paired with m, and otherwise only where prefixes of differences
   meet, the rarest elements first (:func:`_unresolved`): no link within a bucket is lost, and never
   are all paired with all.

A pair at the threshold 0.85 shares no band with probability (1 - 0.85^5)^26, about 2e-7.

Defined cases: a null text or one without words has no shingles, links with nothing, and is kept;
a text of fewer words than a shingle is one shingle; rows with equal ids are one document with the
links of all their texts; null ids stay null and link with nothing; other columns are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from .common import arrow_map, drop_stash, keyed, raw_bytes, stash

BANDS, ROWS = 26, 5
SHINGLE = 3
PERCENT = 85
#: Signatures estimate the likeness with a deviation of about 0.03 at the threshold; pairs six deviations below it can't be links.
SIGMAS = 6.0
_P = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_MEMO: list[_Words] = [_Words()]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_MEMO[0]) > 400_000:
        _MEMO[0] = _Words()
    memo = _MEMO[0]
    return np.array([memo[w] for w in words], dtype=np.uint64)


def shingle_set(raw: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles, A-Z lower-cased."""
    h = word_hashes(raw.lower().split())
    if not len(h):
        return h
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out = _mix(out * _P + h[j : len(h) - width + 1 + j])
    return np.unique(out)


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _P)
    return seeds[:n] | np.uint64(1), seeds[n:]


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of n multiply-shift hash functions, 32 bits each."""
    a, b = _family(n)
    out = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(out, (a[:, None] * shingles[None, at : at + 4096] + b[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(df: DataFrame, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, body, n_shingles, digest of the set, signature; of (doc_id, body, text)."""

    def compute(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(x, k) for x in raw_bytes(batch.column("text"))]
        return {
            "n_shingles": [len(s) for s in sets],
            "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            "signature": [signature(s, bands * rows) if len(s) else None for s in sets],
        }

    return arrow_map(df, compute, [T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.ArrayType(T.IntegerType()))], ("doc_id", "body"))


class _Sets:
    """The last sets built, by node: a centre comes with many pairs."""

    def __init__(self, k: int, most: int = 256):
        self.k, self.most, self.held = k, most, OrderedDict()

    def __call__(self, node, raw: bytes) -> np.ndarray:
        found = self.held.pop(node, None)
        if found is None:
            found = shingle_set(raw, self.k)
            if len(self.held) >= self.most:
                self.held.popitem(last=False)
        self.held[node] = found
        return found


def verified(pairs: DataFrame, signatures: DataFrame, texts: DataFrame, k: int, percent: int, n: int) -> DataFrame:
    """(u, v) of the pairs (a, b) that reach the threshold: first by signature, then on full sets."""
    t = percent / 100
    floor = t - SIGMAS * (t * (1 - t) / n) ** 0.5
    one = signatures.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    two = signatures.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    alike = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    likely = stash(pairs.join(one, "a").join(two, "b").where(alike >= F.lit(floor * n)).select("a", "b"), "likely")
    both = likely.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                good = []
                for i, (x, y, tx, ty) in enumerate(zip(a, b, raw_bytes(part.column("ta")), raw_bytes(part.column("tb")), strict=True)):
                    sx, sy = sets(x, tx), sets(y, ty)
                    common = len(np.intersect1d(sx, sy, assume_unique=True))
                    if 100 * common >= percent * (len(sx) + len(sy) - common):
                        good.append(i)
                kept = part.take(pa.array(good, pa.int64()))
                yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["u", "v"])

    schema = T.StructType([T.StructField(n, likely.schema["a"].dataType) for n in ("u", "v")])
    links = stash(both.select("a", "b", "ta", "tb").mapInArrow(confirm, schema), "links")
    drop_stash(likely)
    return links


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable), kept (is that id), one row for each row of df."""
    src = keyed(df, id_col, text_col).withColumn("body", F.xxhash64("text"))  # tells the texts of an id apart
    made = stash(sketches(src, k, bands, rows), "sketches")
    named = made.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # Nodes are the distinct sets; each has the text of its least (doc_id, body).
    classes = stash(named.groupBy(F.col("digest").alias("node")).agg(F.min(F.struct("doc_id", "body")).alias("of")).select("node", "of.*"), "classes")
    reps = named.join(classes.withColumnRenamed("node", "digest"), ["digest", "doc_id", "body"]).select(F.col("digest").alias("node"), "signature").dropDuplicates(["node"])
    reps = stash(reps, "signatures")
    buckets = reps.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows + 1, rows)))).alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stash(buckets.join(shared, "bucket"), "members")
    weight = stash(members.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    texts = stash(src.join(classes.join(weight, "node").select("node", "doc_id", "body"), ["doc_id", "body"]).select("node", "text").dropDuplicates(["node"]), "texts")
    centres = stash(members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("centre")), "centres")
    pairs = members.join(centres, "bucket").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    tried = stash(pairs, "pairs")
    links = verified(tried, reps, texts, k, percent, bands * rows)
    # The nodes of one id are one document.
    several = named.groupBy("doc_id").agg(F.min("digest").alias("u"), F.max("digest").alias("v")).where("u <> v")
    links = links.unionByName(named.join(several.select("doc_id", "u"), "doc_id").where("digest <> u").select("u", F.col("digest").alias("v")))
    same = stash(components(links), "components")
    more = stash(_unresolved(members, centres, same, tried, texts, k, percent), "pairs")
    if not more.isEmpty():
        links = stash(links.unionByName(verified(more, reps, texts, k, percent, bands * rows)), "links")
        same = stash(components(links), "components")
    placed = stash(classes.join(same, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("least"))
    roots = stash(placed.join(least, "component").select(F.col("node").alias("digest"), "least"), "roots")
    out = made.select("doc_id", "n_shingles", "digest").join(roots, "digest", "left")
    found = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("least")), F.col("doc_id"))
    for done in (members, weight, texts, centres, tried, more, same, placed):
        drop_stash(done)
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def differences(spokes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """centre, node, component, n (set size) and the shingles in which the set differs from the centre's."""
    both = spokes.join(texts, "node").join(texts.select(F.col("node").alias("centre"), F.col("text").alias("tc")), "centre")

    def compute(batch: pa.RecordBatch) -> dict:
        sets, made = _Sets(k, 64), {"n": [], "unlike": []}
        for centre, tc, text in zip(batch.column("centre").to_pylist(), raw_bytes(batch.column("tc")), raw_bytes(batch.column("text")), strict=True):
            x = shingle_set(text, k)
            made["n"].append(len(x))
            made["unlike"].append(np.setxor1d(x, sets(centre, tc), assume_unique=True).view(np.int64))
        return made

    fields = [T.StructField("n", T.LongType()), T.StructField("unlike", T.ArrayType(T.LongType()))]
    return arrow_map(both.select("centre", "node", "component", "tc", "text"), compute, fields, ("centre", "node", "component"))


def _unresolved(members: DataFrame, centres: DataFrame, same: DataFrame, tried: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Untried pairs (a, b) that may link components, from the buckets that hold several.

    Differences from S are ordered alike for all members of a centre: the elements of fewest members
    first. If two share o elements, the first e - o + 1 of each meet. A link needs
    o = (f(x) + f(y)) / 2, so members are dealt into classes by f, and each brings to each class it can
    link with the prefix that this class asks for. Elements of one member come first and meet
    nothing: they fill prefixes without a row.
    """
    placed = members.join(same, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").join(centres, "bucket").select("bucket", "centre")
    spokes = stash(placed.join(mixed, "bucket").select("centre", "node", "component").distinct(), "spokes")
    made = stash(differences(spokes, texts, k), "differences")

    # S is the centre's set but for the shingles in which more than half of the members differ from it.
    size = made.groupBy("centre").agg(F.count("*").alias("size"))
    times = made.select("centre", F.explode("unlike").alias("shingle")).groupBy("centre", "shingle").agg(F.count("*").alias("times")).where("times > 1")
    times = stash(times.join(size, "centre").withColumn("flips", F.expr("2 * times > size")).withColumn("times", F.expr("if(flips, size - times, times)")), "times")
    flips = times.where("flips").groupBy("centre").agg(F.collect_list("shingle").alias("flipped"))
    turned = made.join(flips, "centre", "left").withColumn("flipped", F.coalesce("flipped", F.array().cast("array<bigint>")))
    less, more = 100 - percent, 100 + percent  # h = less / more; f is kept as the whole number more * f
    told = turned.select("centre", "node", "component", "n", F.concat(F.array_except("unlike", "flipped"), F.array_except("flipped", "unlike")).alias("diff"))
    told = stash(told.withColumn("e", F.size("diff")).withColumn("f", more * F.col("e") - less * F.col("n")), "told")
    nearest = told.groupBy("centre").agg(F.min(F.struct("f", "node")).alias("m"), F.max("n").alias("most")).select("centre", F.col("m.f").alias("fm"), F.col("m.node").alias("m"), F.expr(f"greatest(1, {less} * most div 2)").alias("width"))

    # What several members have of each difference, rarest first; what one has is only counted.
    met = told.select("centre", "node", F.explode("diff").alias("shingle")).join(times.where("times > 1").select("centre", "shingle", "times"), ["centre", "shingle"])
    met = met.groupBy("centre", "node").agg(F.array_sort(F.collect_list(F.struct("times", "shingle")))["shingle"].alias("common"))
    members = told.drop("diff").join(met, ["centre", "node"]).join(nearest, "centre").withColumn("own", F.col("e") - F.size("common"))
    members = stash(members, "prefixes")

    # x is the one of greater f. Linked, f(x) - f(y) is at most 2 h times the larger set, which has n / t at most.
    reach = f"{200 * less} * n div {percent} + 1"
    level = "(f - fm) div width"
    lowest = f"greatest(0, f - ({reach}) - fm) div width"
    highest = f"(f + ({reach}) - fm) div width"
    # A partner of class c has an f of fm + c * width at least, which says how much the two must share.
    overlap = lambda f: F.greatest(F.lit(1), F.expr(f"(f + {f} + {2 * more - 1}) div {2 * more}"))
    prefix = lambda o: F.slice("common", F.lit(1), F.greatest(F.lit(0), F.col("e") - o + 1 - F.col("own")).cast("int"))

    def dealt(rows: DataFrame, first: str, last: str, key: tuple[str, ...], names: dict) -> DataFrame:
        """A row for each class of partners and each shingle of the prefix that holds for the class; a hash keys it, since a collision only adds a pair to verify."""
        each = rows.withColumn("level", F.expr(level)).withColumn("class", F.explode(F.sequence(F.expr(first), F.expr(last))))
        each = each.select("*", F.posexplode(prefix(overlap("fm + class * width"))).alias("at", "shingle")).withColumn("at", F.col("at") + F.col("own"))
        return each.select(F.xxhash64("centre", "shingle", *key).alias("key"), *[F.col(c).alias(n) for c, n in names.items()])

    seek = dealt(members.where("f + fm > 0"), lowest, level, ("level", "class"), {"node": "x", "component": "cx", "e": "ex", "n": "nx", "f": "fx", "at": "at_x"})
    found = dealt(members.where(f"({highest}) >= greatest(0, -2 * fm) div width"), f"greatest({level}, greatest(0, -2 * fm) div width)", highest, ("class", "level"), {"node": "y", "component": "cy", "e": "ey", "n": "ny", "f": "fy", "at": "at_y"})
    needed = f"((fx + fy + {2 * more - 1}) div {2 * more})"
    # Sets differ by |e(x) - e(y)| at least, and the first common element leaves room for the others in both.
    room = f"at_x + {needed} <= ex and at_y + {needed} <= ey"
    pairs = seek.join(found, "key").where(f"cx <> cy and fx >= fy and {more} * abs(ex - ey) <= {less} * (nx + ny) and {room}").select("x", "y")
    pairs = pairs.unionByName(told.join(nearest, "centre").where("m <> node").select(F.col("m").alias("x"), F.col("node").alias("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")


def keep_one_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """The rows of df, all columns, that represent their group. Rows without an id stay."""
    found = near_duplicates(df, id_col, text_col, k, percent, bands, rows).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    own = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names of others can't clash
    return own.join(found, F.col(own.columns[df.columns.index(id_col)]).eqNullSafe(F.col("kept_id")), "left_semi").toDF(*df.columns)
