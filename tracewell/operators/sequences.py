"""Bursts and sessions, gaps in numbered names, and outliers of time and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import micros, stem
from ..storage import stash
from .listing import positions

SESSION_GAP_SECONDS = 30 * 60
BURST_GAP_SECONDS = 5
MISSING_CAP = 99


def burst_sessions(df: DataFrame, item: str, time: str, partition: list[str] | None = None, session_gap: float = SESSION_GAP_SECONDS, burst_gap: float = BURST_GAP_SECONDS) -> DataFrame:
    """df with session_id and burst_id, from 1 by time within each partition; 0 for rows without a time.

    A gap longer than ``session_gap`` starts a session and a burst, one longer than ``burst_gap`` a
    burst. Without partition columns the order is global: then ids are summed over ranges of time
    (:func:`_global_ids`), since a window over everything would be one task.
    """
    timed, rest = df.where(F.col(time).isNotNull()), df.where(F.col(time).isNull())
    zero = F.lit(0).cast("long")
    rest = rest.withColumn("session_id", zero).withColumn("burst_id", zero)
    if partition:
        w = Window.partitionBy(*partition).orderBy(F.col(time), F.col(item))
        gap = micros(F.col(time)) - F.lag(micros(F.col(time))).over(w)
        running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        marked = timed.withColumn("__gap", gap)
        ids = marked.withColumn("session_id", F.sum(_starts(F.col("__gap"), session_gap)).over(running)).withColumn("burst_id", F.sum(_starts(F.col("__gap"), burst_gap)).over(running))
        return ids.drop("__gap").unionByName(rest)
    return _global_ids(timed, item, time, session_gap, burst_gap).unionByName(rest)


def _starts(gap: Column, limit: float) -> Column:
    return F.when(gap.isNull() | (gap > F.lit(int(limit * 1_000_000))), 1).otherwise(0).cast("long")


def _global_ids(df: DataFrame, item: str, time: str, session_gap: float, burst_gap: float, ranges: int | None = None) -> DataFrame:
    """Windows inside ranges of time, then offsets: the sums of the ranges before, one row for each range."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = micros(F.col(time))
    cuts = df.agg(F.percentile_approx(at, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < at)) if cuts else F.lit(0)
    placed = df.withColumn("__at", at).withColumn("__range", bucket)
    w = Window.partitionBy("__range").orderBy("__at", item)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.col("__at") - F.lag("__at").over(w)
    marked = placed.withColumn("__gap", gap)
    inner = marked.withColumn("__s", F.sum(F.when(F.col("__gap").isNull(), 0).otherwise(_starts(F.col("__gap"), session_gap))).over(running)).withColumn("__b", F.sum(F.when(F.col("__gap").isNull(), 0).otherwise(_starts(F.col("__gap"), burst_gap))).over(running))
    edges = inner.groupBy("__range").agg(F.min("__at").alias("first"), F.max("__at").alias("last"), F.max("__s").alias("s"), F.max("__b").alias("b"))
    order = Window.orderBy("__range")  # one row for each range
    jump = F.col("first") - F.lag("last").over(order)
    opened = edges.withColumn("os", _starts(jump, session_gap)).withColumn("ob", _starts(jump, burst_gap))
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = opened.select("__range", (F.sum(F.col("s") + F.col("os")).over(before) - F.col("s")).alias("__os"), (F.sum(F.col("b") + F.col("ob")).over(before) - F.col("b")).alias("__ob"))
    joined = inner.join(F.broadcast(offsets), "__range")  # n rows
    return joined.withColumn("session_id", F.col("__s") + F.col("__os")).withColumn("burst_id", F.col("__b") + F.col("__ob")).select(*df.columns, "session_id", "burst_id")


def storyboard(clustered: DataFrame, name: str, time: str, session: list[str] | str = "session_id") -> DataFrame:
    """Members of sessions (the last of the columns; 0 is none) of two or more with their position, by time text and name."""
    keys = [session] if isinstance(session, str) else session
    sizes = clustered.where(F.col(keys[-1]) > 0).groupBy(*keys).agg(F.count("*").alias("members")).where("members >= 2")
    w = Window.partitionBy(*keys).orderBy(F.col(time).cast("string"), F.col(name))
    return clustered.join(sizes, keys).withColumn("position", F.row_number().over(w))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with prefix, width and number of names whose stem ends in digits that fit an integer; others are dropped."""
    digits = F.regexp_extract(stem(F.col(name)), r"(\d+)$", 1)
    prefix = F.regexp_extract(stem(F.col(name)), r"^(.*?)(\d+)$", 1)
    return df.withColumn("prefix", prefix).withColumn("width", F.length(digits)).withColumn("number", digits.try_cast("int")).where("number is not null")


def sequence_gaps(df: DataFrame, item: str, keys: list[str], number: str, least: int = 2, cap: int = MISSING_CAP) -> DataFrame:
    """keys, number_before, number_after, item_before, item_after, missing (capped) wherever ``least`` numbers or more are left out."""
    w = Window.partitionBy(*keys).orderBy(number, item)
    following = df.withColumn("number_after", F.lead(number).over(w)).withColumn("item_after", F.lead(item).over(w))
    missing = F.col("number_after") - F.col(number) - 1
    return following.where(missing >= least).select(*keys, F.col(number).alias("number_before"), "number_after", F.col(item).alias("item_before"), "item_after", F.least(missing, F.lit(cap)).cast("long").alias("missing"))


def global_gaps(df: DataFrame, number: str, least: int = 2, cap: int = MISSING_CAP) -> DataFrame:
    """number_before, number_after, missing over all numbers: windows inside ranges of numbers, which are then tied end to end, a row for each."""
    distinct = df.select(F.col(number).cast("long").alias("number")).where("number is not null").distinct()
    placed = stash(distinct.repartitionByRange("number").withColumn("part", F.spark_partition_id()), "numbers")
    inner = placed.withColumn("number_after", F.lead("number").over(Window.partitionBy("part").orderBy("number")))
    edges = placed.groupBy("part").agg(F.min("number").alias("first"), F.max("number").alias("last"))
    ties = edges.select(F.col("last").alias("number"), F.lead("first").over(Window.orderBy("part")).alias("number_after"))  # one row for each range
    both = inner.select("number", "number_after").where("number_after is not null").unionByName(ties.where("number_after is not null"))
    missing = F.col("number_after") - F.col("number") - 1
    return both.where(missing >= least).select(F.col("number").alias("number_before"), "number_after", F.least(missing, F.lit(cap)).cast("long").alias("missing"))


def name_gaps(df: DataFrame, item: str, name: str, least: int = 2, cap: int = MISSING_CAP) -> DataFrame:
    """Gaps in camera-style names; numbers of another prefix or digit width are a sequence of their own."""
    return sequence_gaps(numbered(df, name), item, ["prefix", "width"], "number", least, cap)


def quartiles(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, n, q1, q3 by linear interpolation at p (n - 1): values at their places in a range-partitioned order, so a group of any size is spread over tasks."""
    v = F.col(value).cast("double")
    placed = positions(df.where(v.isNotNull()).select(*keys, v.alias("value_of")), [*[F.col(k).asc() for k in keys], F.col("value_of").asc()])
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("n"), F.min("position").alias("from_position"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    both = placed.alias("p").join(F.broadcast(sizes).alias("s") if not keys else sizes.alias("s"), same if keys else F.lit(True))
    rank, out = F.col("position") - F.col("from_position"), []
    for p, name in ((0.25, "q1"), (0.75, "q3")):
        at = F.lit(p) * (F.col("n") - 1)
        low, high = (F.max(F.when(rank == edge, F.col("value_of"))) for edge in (F.floor(at), F.ceil(at)))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(name))
    wanted = rank.isin([0]) | F.lit(False)
    for p in (0.25, 0.75):
        at = F.lit(p) * (F.col("n") - 1)
        wanted = wanted | (rank == F.floor(at)) | (rank == F.ceil(at))
    return both.where(wanted).groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("n")).agg(*out)


def tukey_outliers(df: DataFrame, item: str, value: str, keys: list[str], floor: float = 0.0, least: int = 4, factor: float = 1.5) -> DataFrame:
    """Rows beyond the quartiles by more than max(factor * IQR, floor), in groups of ``least`` values or more, with their distance."""
    v = F.col(value).cast("double")
    stats = quartiles(df, value, keys).where(F.col("n") >= least)
    reach = F.greatest(F.lit(factor) * (F.col("q3") - F.col("q1")), F.lit(float(floor)))
    distance = F.when(v < F.col("q1") - reach, F.col("q1") - v).when(v > F.col("q3") + reach, v - F.col("q3"))
    joined = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))
    return joined.withColumn("distance", distance).where("distance is not null").select(*keys, F.col(item).alias("item"), v.alias("value"), "distance")


def majority_outliers(df: DataFrame, item: str, category: str, keys: list[str], ratio: float = 0.70, least: int = 3) -> DataFrame:
    """Rows that differ (case aside, trimmed) from a category that holds ``ratio`` of their group's ``least`` rows or more."""
    named = df.where(F.col(category).isNotNull() & (F.trim(category) != "")).withColumn("__c", F.lower(F.trim(category)))
    counts = named.groupBy(*keys, "__c").agg(F.count("*").alias("n"))
    top = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.max(F.struct("n", "__c")).alias("top"))
    ruled = top.where((F.col("total") >= least) & (F.col("top.n") >= F.lit(ratio) * F.col("total"))).select(*keys, F.col("top.__c").alias("majority"))
    return named.join(ruled, keys).where(F.col("__c") != F.col("majority")).select(*keys, F.col(item).alias("item"), F.col("__c").alias("category"), "majority")


def outlier_reasons(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """item, reasons: the names of the checks that flagged it, in the order given."""
    parts = [df.select("item", F.lit(i).alias("rank"), F.lit(name).alias("reason")) for i, (name, df) in enumerate(checks)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    gathered = F.array_sort(F.collect_set(F.struct("rank", "reason")))
    return union.groupBy("item").agg(F.array_join(F.transform(gathered, lambda x: x["reason"]), "; ").alias("reasons"))
