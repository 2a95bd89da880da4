"""Finding rows of the passes over a whole folder, of content hashes, of HEIC structure and of signatures.

A finding is (item, id, category, priority, observed, interpreted, observation); priorities and
confidences are as in :mod:`.rules`. What a finding refers to (the other members of a group) is a
relation of its own, since a group has no bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import duplicates, sequences

COLUMNS = ("item", "id", "category", "priority", "observed", "interpreted", "observation")


def _rows(df: DataFrame, item: Column, identifier: str | Column, category: str, priority: int | Column, observed: int | Column, interpreted: int, observation: Column) -> DataFrame:
    made = (item, identifier, category, priority, observed, interpreted, observation)
    return df.select(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(COLUMNS, made, strict=True)])


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def exact_duplicates(df: DataFrame, item: str, digest: str) -> DataFrame:
    """One finding for each row whose hash others have."""
    found = duplicates.annotate_duplicates(df, digest).where("duplicate_count > 0")
    return _rows(found, F.col(item), "file-exact-duplicate", "Provenance", 2, 99, 75, _text("Exact duplicate — ", F.col("duplicate_count"), " other file(s) in this folder share the same SHA-256 hash."))


def near_duplicates(df: DataFrame, item: str, bits: str, digest: str, threshold: int = 10, width: int = 64) -> DataFrame:
    """One finding for each member of a group of similar images that has no exact duplicate."""
    groups = duplicates.near_groups(df, item, bits, threshold, width)
    sizes = groups.groupBy("group_id").agg((F.count("*") - 1).alias("others"))
    alone = duplicates.annotate_duplicates(df.select(F.col(item).alias("item"), F.col(digest).alias("digest")), "digest").where("duplicate_count = 0").select("item")
    found = groups.join(sizes, "group_id").join(alone, "item", "left_semi")
    return _rows(found, F.col("item"), "file-near-duplicate", "Provenance", 1, 70, 55, _text("Visually similar to ", F.col("others"), f" other file(s) in this folder (dHash distance ≤ {threshold})."))


def sequence_gaps(df: DataFrame, item: str, name: str) -> DataFrame:
    """One finding for the item after each gap."""
    gaps = sequences.name_gaps(df, item, name)
    return _rows(gaps, F.col("item_after"), "sequence-gap-after", "Provenance", 3, 80, 60, _text("Camera sequence gap: ", F.col("missing"), " frame(s) missing between ", F.col("prefix"), F.col("number_before"), " and ", F.col("prefix"), F.col("number_after"), "."))


def gap_total(gaps: DataFrame) -> DataFrame:
    """n_gaps, n_missing of the gaps of a folder."""
    return gaps.agg(F.count("*").alias("n_gaps"), F.coalesce(F.sum("missing"), F.lit(0)).cast("long").alias("n_missing"))


def session_outliers(reasons: DataFrame) -> DataFrame:
    """One finding for each row of :func:`.sequences.outlier_reasons`."""
    return _rows(reasons, F.col("item"), "session-outlier", "Session Context", 1, 70, 45, F.col("reasons"))


def app_correlations(matches: DataFrame) -> DataFrame:
    """One finding for each (name, app) of :func:`.evidence.correlate`, a match by name being of high confidence."""
    return _rows(matches, F.col("name"), _text("app-db-correlation-", F.lower("app")), "App DB Correlation", 1, 75, 65, _text("File is referenced in a ", F.col("app"), " database."))


def content_hashes(df: DataFrame, item: str, content: str) -> DataFrame:
    """SHA-256 in blocks of eight digits; an error finding where there is no content to read."""
    hexed = F.upper(F.sha2(F.col(content), 256))
    blocks = F.concat_ws(" ", *[F.substring(hexed, F.lit(8 * i + 1), F.lit(8)) for i in range(8)])
    lost = F.col(content).isNull()
    pick = lambda a, b: F.when(lost, F.lit(a)).otherwise(F.lit(b))
    return _rows(df, F.col(item), pick("file-hash-error", "file-hash-sha256"), "Provenance", pick(1, 0), pick(90, 99), -1, F.when(lost, "Could not compute SHA-256").otherwise(_text("SHA-256:  ", blocks)))


#: Reference types of HEIC items (fixed values).
AUXILIARY, THUMBNAIL = "auxl", "thmb"


def heic_structure(items: DataFrame, references: DataFrame, item: str = "item", kind: str = "item_type", reference: str = "ref_type") -> DataFrame:
    """Auxiliary images, thumbnail items and the inventory of item types of each container.

    ``items`` has a row for each item with its type in file order (``place``), ``references`` one for each reference.
    """
    found = references.groupBy(F.col(item).alias("item")).agg(F.count_if(F.col(reference) == AUXILIARY).alias("aux"), F.count_if(F.col(reference) == THUMBNAIL).alias("thumbs"))
    aux = found.where("aux > 0")
    text = F.when(F.col("aux") == 1, "1 auxiliary image item found in HEIC container").otherwise(_text(F.col("aux"), " auxiliary image items found in HEIC container"))
    one = _rows(aux, F.col("item"), "heic-auxiliary-images", "embedded-artifacts", 0, 90, 35, text)
    two = _rows(found.where("thumbs > 0"), F.col("item"), "heic-thumbnail-item", "embedded-artifacts", 0, 90, 85, F.lit("Embedded thumbnail item found in HEIC container"))
    kinds = items.groupBy(F.col(item).alias("item"), F.rtrim(F.translate(F.col(kind), "\0", "")).alias("kind")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    parts = F.array_sort(F.collect_list(F.struct("first", "n", "kind")))  # a row for each type of a container
    told = kinds.groupBy("item").agg(F.array_join(F.transform(parts, lambda x: F.concat(x["n"].cast("string"), F.lit("×"), x["kind"])), ", ").alias("types"))
    three = _rows(told, F.col("item"), "heic-item-inventory", "structure", 0, 90, -1, _text("HEIC item types: ", F.col("types")))
    return reduce(lambda a, b: a.unionByName(b), (one, two, three))


def signature_findings(matches: DataFrame) -> DataFrame:
    """For each item and category one finding: the conflict of several matches of moderate strength or more, else the strongest match."""
    from ..functions.scalars import id_prefix

    strong = F.when(F.col("strength") >= 2, F.struct((-F.col("strength")).alias("r"), F.col("profile_id").alias("p")))
    found = matches.where("strength > 0").withColumn("category", id_prefix(F.col("profile_id"))).groupBy("item", "category")
    found = found.agg(F.min(F.struct((-F.col("strength")).alias("r"), F.col("profile_id").alias("p"))).alias("top"), F.count(strong).alias("n"), F.array_sort(F.collect_set(strong)).alias("strong"))
    conflict = F.col("n") > 1
    rank = -F.col("top.r")
    pick = lambda a, b: F.when(conflict, a).otherwise(b)
    names = F.array_join(F.transform("strong", lambda x: x["p"]), " vs ")
    return _rows(
        found,
        F.col("item"),
        pick(_text("sig-conflict.", F.col("category")), _text("sig-match.", F.col("top.p"))),
        "Workflow Recognition",
        pick(F.lit(2), F.lit(0)),
        pick(F.lit(90), F.when(rank == 3, 85).when(rank == 2, 65).otherwise(40)),
        -1,
        pick(_text("Conflicting ", F.col("category"), " signatures: ", names, "."), _text("Consistent with ", F.col("top.p"), ".")),
    ).withColumn("interpreted", F.when(F.startswith("id", F.lit("sig-conflict.")), 55).otherwise(F.col("interpreted")))


def load_counters(rows: DataFrame, presence: str, priority: str) -> DataFrame:
    """n_items, n_deleted, n_warned of a listing's rows."""
    return rows.agg(F.count("*").alias("n_items"), F.count_if(F.col(presence) == "Deleted").alias("n_deleted"), F.count_if(F.col(priority) >= 2).alias("n_warned"))


