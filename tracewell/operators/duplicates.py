"""Exact duplicates by hash, near duplicates by Hamming distance, and what relates to one item."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hamming
from ..storage import stash
from . import cells
from .graph import components


def exact_groups(df: DataFrame, path: str, digest: str) -> DataFrame:
    """digest (least spelling), n, first (least member), member: a row for each member of each hash that two rows or more share, case aside.

    Null and empty hashes are left out. A hot hash is never one row: sizes are aggregated partially
    and joined back to the members.
    """
    usable = df.where(F.col(digest).isNotNull() & (F.col(digest) != "")).select(F.lower(digest).alias("key"), F.col(digest).alias("spelled"), F.col(path).alias("member"))
    sizes = usable.groupBy("key").agg(F.min("spelled").alias("digest"), F.count("*").alias("n"), F.min("member").alias("first")).where("n >= 2")
    return usable.select("key", "member").join(sizes, "key").select("digest", "n", "first", "member")


def exact_sizes(df: DataFrame, digest: str) -> DataFrame:
    """Like :func:`exact_groups` without the members: nothing grows with a group, so a hot hash costs nothing."""
    usable = df.where(F.col(digest).isNotNull() & (F.col(digest) != ""))
    return usable.groupBy(F.lower(digest).alias("digest")).agg(F.count("*").alias("n")).where("n >= 2")


def annotate_duplicates(df: DataFrame, digest: str, alias: str = "duplicate_count") -> DataFrame:
    """df with the number of other rows of the same hash, 0 for none.

    Counts come from a partially aggregated group-by and a join, which splits a hot hash; a window would not.
    """
    sizes = exact_sizes(df, digest).withColumnRenamed("digest", "__digest")
    joined = df.join(sizes, F.lower(digest) == F.col("__digest"), "left")
    return joined.withColumn(alias, F.coalesce(F.col("n") - 1, F.lit(0)).cast("long")).drop("__digest", "n")


def band_plan(threshold: int, width: int, n: int, most: int = 1000) -> tuple[int, int] | None:
    """Number of bands m and radius r: two hashes within ``threshold`` bits are at most r = threshold // m bits apart in one of m bands.

    The plan with the fewest rows and candidates expected for each of n hashes, of those that probe ``most`` values or
    fewer; none if to compare all pairs, 2,000 in the time of one such row, is expected to take less.
    """
    plans = []
    for m in range(1, threshold + 2):
        bits, r = width // m, threshold // m
        probes = sum(comb(-(-width // m), i) for i in range(r + 1))
        if bits > r and m * probes <= most:
            plans.append((m * probes + n * m * probes / 2**bits, m, r))
    return min(plans)[1:] if plans and min(plans)[0] < n / 2000 else None


def band_values(bits: Column, m: int, radius: int, width: int) -> Column:
    """array of (band, value): each band's value and all values up to ``radius`` bits from it."""
    edges = [i * width // m for i in range(m + 1)]
    signed = lambda x: F.lit(x - (x >> 63 << 64)).cast("long")  # noqa: E731  a band of 64 bits has the sign's

    def near(band: int, start: int, size: int) -> Column:
        masks = [sum(1 << x for x in flips) for r in range(radius + 1) for flips in combinations(range(size), r)]
        value = F.shiftrightunsigned(bits, start).bitwiseAND(signed((1 << size) - 1))
        return F.transform(F.array(*[signed(x) for x in masks]), lambda x: F.struct(F.lit(band).alias("band"), value.bitwiseXOR(x).alias("value")))

    return F.flatten(F.array(*[near(i, a, b - a) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]))


def _classes(df: DataFrame, item: str, bits: str) -> DataFrame:
    """item (the least), bits of each distinct hash, kept in the shared folder; a hash of 0 means none and is left out."""
    usable = df.where(F.col(bits).isNotNull() & (F.col(bits) != 0) & F.col(item).isNotNull())
    return stash(usable.groupBy(F.col(bits).cast("long").alias("bits")).agg(F.min(item).alias("item")), "hashes")


def banded_pairs(classes: DataFrame, threshold: int, width: int, m: int, radius: int) -> DataFrame:
    """u, v, distance of all pairs of (item, bits) within the threshold: an equi-join of bands with the near values of each.

    Spark's estimate of a side leaves out that its rows are multiplied, so the join is told not to broadcast one.
    """
    one = classes.select(F.col("item").alias("u"), F.col("bits").alias("bu"), F.explode(band_values(F.col("bits"), m, 0, width)).alias("k")).select("u", "bu", "k.band", "k.value")
    two = classes.select(F.col("item").alias("v"), F.col("bits").alias("bv"), F.explode(band_values(F.col("bits"), m, radius, width)).alias("k")).select("v", "bv", "k.band", "k.value")
    distance = hamming(F.col("bu"), F.col("bv"))
    found = one.hint("merge").join(two, ["band", "value"]).where((F.col("u") < F.col("v")) & (distance <= threshold))
    return found.select("u", "v", distance.alias("distance")).distinct()


def near_pairs(df: DataFrame, item: str, bits: str, threshold: int = 10, width: int = 64) -> DataFrame:
    """a, b, distance of all pairs of distinct hashes at most ``threshold`` apart: equal hashes meet once, as (least item) representatives.

    All pairs are compared, in cells, except where bands (:func:`band_plan`) leave few enough of them.
    """
    classes = _classes(df, item, bits)
    n = classes.count()
    plan = band_plan(threshold, width, n)
    found = banded_pairs(classes, threshold, width, *plan) if plan else cells.pairs(classes, threshold, cells.block_count(n))
    return found.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "distance")


def near_groups(df: DataFrame, item: str, bits: str, threshold: int = 10, width: int = 64) -> DataFrame:
    """item, group_id (least item of the connected group) of every row in a group of two or more.

    Of the near pairs only those are kept that connect what is not yet connected: their number grows with the rows.
    """
    usable = df.where(F.col(bits).isNotNull() & (F.col(bits) != 0)).select(F.col(item).alias("item"), F.col(bits).cast("long").alias("bits"))
    reps = _classes(usable, "item", "bits")
    n = reps.count()
    plan = band_plan(threshold, width, n)
    found = components(banded_pairs(reps, threshold, width, *plan) if plan else cells.links(reps, threshold, cells.block_count(n)))
    placed = usable.join(reps.withColumnRenamed("item", "rep"), "bits").join(found, F.col("rep") == F.col("node"), "left").select("item", F.coalesce("component", "rep").alias("group_id"))
    sizes = placed.groupBy("group_id").agg(F.count("*").alias("n")).where("n >= 2").select("group_id")
    return placed.join(sizes, "group_id").select("item", "group_id")


def group_diameters(groups: DataFrame, df: DataFrame, item: str, bits: str) -> DataFrame:
    """group_id, n, max_distance over all member pairs; hashes are compared once for each distinct value, in cells, so that a large group is many tasks."""
    tagged = groups.join(df.select(F.col(item).alias("item"), F.col(bits).cast("long").alias("bits")), "item")
    values = stash(tagged.groupBy("group_id", "bits").agg(F.count("*").alias("n")), "values")
    sizes = values.groupBy("group_id").agg(F.sum("n").alias("n"))
    widest = cells.widest(values.where("bits is not null"), cells.block_count(values.count())).groupBy("group_id").agg(F.max("max_distance").alias("max_distance"))
    return sizes.join(widest, "group_id", "left")


def related_items(df: DataFrame, selected: DataFrame, item: str, digest: str, bits: str, burst: str, name: str, threshold: int = 10) -> DataFrame:
    """item, relation, position of what relates to the one selected row: exact duplicates, near duplicates, else siblings of its burst.

    ``selected`` is one row, so it is broadcast.
    """
    one = F.broadcast(selected.limit(1).select(F.col(item).alias("__i"), F.col(digest).alias("__d"), F.col(bits).alias("__b"), F.col(burst).alias("__u")))
    distance = hamming(F.col(bits), F.col("__b"))
    relation = (
        F.when((F.col(digest) != "") & (F.lower(digest) == F.lower("__d")), "Exact Duplicate")
        .when((F.col(bits) != 0) & (F.col("__b") != 0) & (distance <= threshold), F.concat(F.lit("Near Duplicate (dHash \u0394"), distance.cast("string"), F.lit(")")))
        .when((F.col(burst) > 0) & (F.col(burst) == F.col("__u")), "Burst Sibling")
    )
    from .listing import positions

    rank = F.when(F.col("relation") == "Exact Duplicate", 0).when(F.startswith("relation", F.lit("Near")), 1).otherwise(2)
    found = df.crossJoin(one).where(F.col(item) != F.col("__i")).withColumn("relation", relation).where(F.col("relation").isNotNull())
    found = found.select(F.col(item).alias("item"), "relation", rank.alias("rank"), F.lower(F.col(name).cast("string")).alias("by_name"))
    return positions(found, [F.col(c).asc() for c in ("rank", "by_name", "item")]).select("item", "relation", "position")
