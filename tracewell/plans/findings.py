"""Queries of the finding passes, the item relation and what is told of an item, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evidence, items, passes
from . import queries as Q
from .registry import query, table


def _finding_sql(source: str, item: str, identifier: str, category: str, priority: int, observed: int, interpreted: int, text: str) -> str:
    return f"SELECT {item} AS item, {identifier} AS id, '{category}' AS category, {priority} AS priority, {observed} AS observed, {interpreted} AS interpreted, {text} AS observation FROM ({source})"


@query(_finding_sql("SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) - 1 AS n FROM documents WHERE text IS NOT NULL", "doc_id", "'file-exact-duplicate'", "Provenance", 2, 99, 75, "'Exact duplicate — ' || n || ' other file(s) in this folder share the same SHA-256 hash.'") + " WHERE n > 0")
def exact_dup_findings(spark, d):
    return passes.exact_duplicates(Q.hashed(spark, d), "doc_id", "hash")


_LABELLED = f"SELECT h.vec_id, h.bits, e.label FROM ({Q._BITS_SQL}) h JOIN embeddings e ON h.vec_id = e.vec_id"


@query(
    f"WITH g AS ({Q._GROUPS_SQL}), n AS (SELECT *, count(*) OVER (PARTITION BY group_id) - 1 AS others FROM g), first AS (SELECT CAST(round_even(CAST(embedding[1] AS DOUBLE) * 200, 0) AS INTEGER) AS digest, min(vec_id) AS vec_id FROM embeddings GROUP BY 1 HAVING count(*) = 1) "
    + _finding_sql("SELECT n.* FROM n JOIN first ON n.item = first.vec_id", "item", "'file-near-duplicate'", "Provenance", 1, 70, 55, "'Visually similar to ' || others || ' other file(s) in this folder (dHash distance ≤ 16).'")
)
def near_dup_findings(spark, d):
    """Vectors whose rounded first component others have count as exact duplicates and are left out."""
    e = table(spark, d, "embeddings").select("vec_id", F.bround(F.get("embedding", F.lit(0)).cast("double") * 200).cast("int").cast("string").alias("digest"))
    return passes.near_duplicates(e.join(Q.vector_bits(spark, d), "vec_id"), "vec_id", "bits", "digest", 16, 63)


def _named(spark, d):
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("item"), "c_name")


@query(_finding_sql(Q.SQL_GAPS, "item_after", "'sequence-gap-after'", "Provenance", 3, 80, 60, "'Camera sequence gap: ' || missing || ' frame(s) missing between ' || prefix || number_before || ' and ' || prefix || number_after || '.'"))
def gap_findings(spark, d):
    return passes.sequence_gaps(_named(spark, d), "item", "c_name")


@query(f"SELECT count(*) AS n_gaps, CAST(sum(missing) AS BIGINT) AS n_missing FROM ({Q.SQL_GAPS})")
def gap_totals(spark, d):
    from ..operators import sequences

    return passes.gap_total(sequences.name_gaps(_named(spark, d), "item", "c_name"))


@query(_finding_sql(Q.SQL_REASONS, "item", "'session-outlier'", "Session Context", 1, 70, 45, "reasons"))
def outlier_findings(spark, d):
    return passes.session_outliers(Q.outlier_reasons(spark, d))


@query(_finding_sql(Q.SQL_CORRELATED, "name", "'app-db-correlation-' || lower(app)", "App DB Correlation", 1, 75, 65, "'File is referenced in a ' || app || ' database.'"))
def app_findings(spark, d):
    return passes.app_correlations(Q.correlation_semi(spark, d))


_BLOCKS = " || ' ' || ".join(f"substring(h, {8 * i + 1}, 8)" for i in range(8))


@query("SELECT doc_id AS item, CASE WHEN h IS NULL THEN 'file-hash-error' ELSE 'file-hash-sha256' END AS id, 'Provenance' AS category, CASE WHEN h IS NULL THEN 1 ELSE 0 END AS priority, CASE WHEN h IS NULL THEN 90 ELSE 99 END AS observed, -1 AS interpreted, CASE WHEN h IS NULL THEN 'Could not compute SHA-256' ELSE 'SHA-256:  ' || " + _BLOCKS + " END AS observation FROM (SELECT doc_id, upper(sha256(text)) AS h FROM documents)")
def content_hash_findings(spark, d):
    return passes.content_hashes(table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content")), "doc_id", "content")


_REFS = "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS aux, count(*) FILTER (event_type = 'click') AS thumbs FROM events GROUP BY 1"


@query(
    " UNION ALL ".join(
        [
            _finding_sql(f"SELECT * FROM ({_REFS}) WHERE aux > 0", "user_id", "'heic-auxiliary-images'", "embedded-artifacts", 0, 90, 35, "CASE WHEN aux = 1 THEN '1 auxiliary image item found in HEIC container' ELSE aux || ' auxiliary image items found in HEIC container' END"),
            _finding_sql(f"SELECT * FROM ({_REFS}) WHERE thumbs > 0", "user_id", "'heic-thumbnail-item'", "embedded-artifacts", 0, 90, 85, "'Embedded thumbnail item found in HEIC container'"),
            _finding_sql("SELECT user_id, string_agg(n || '×' || event_type, ', ' ORDER BY first) AS types FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1", "user_id", "'heic-item-inventory'", "structure", 0, 90, -1, "'HEIC item types: ' || types"),
        ]
    )
)
def heic_findings(spark, d):
    """Events as a container's items: their types in order, purchases as auxiliary and clicks as thumbnail references."""
    e = table(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("item_type"), F.col("event_id").alias("place"))
    refs = e.select("item", F.when(F.col("item_type") == "purchase", passes.AUXILIARY).when(F.col("item_type") == "click", passes.THUMBNAIL).otherwise("cdsc").alias("ref_type"))
    return passes.heic_structure(e, refs)


@query(
    f"SELECT item, CASE WHEN n > 1 THEN 'sig-conflict.workflow' ELSE 'sig-match.' || p END AS id, 'Workflow Recognition' AS category, CASE WHEN n > 1 THEN 2 ELSE 0 END AS priority, CASE WHEN n > 1 THEN 90 ELSE 85 END AS observed, CASE WHEN n > 1 THEN 55 ELSE -1 END AS interpreted, CASE WHEN n > 1 THEN 'Conflicting workflow signatures: ' || names || '.' ELSE 'Consistent with ' || p || '.' END AS observation FROM (SELECT item, count(*) AS n, min(profile_id) AS p, string_agg(profile_id, ' vs ' ORDER BY profile_id) AS names FROM ({Q._MATCHES}) GROUP BY item)"
)
def signature_finding_rows(spark, d):
    return passes.signature_findings(Q._matches(spark, d))


_SIZE = "CASE WHEN {0} IS NULL THEN '' WHEN {0} < 1024 THEN {0} || ' B' WHEN {0} < 1048576 THEN printf('%.1f KB', floor({0} * 10 / 1024.0 + 0.5) / 10) ELSE printf('%.1f MB', floor({0} * 10 / 1048576.0 + 0.5) / 10) END"


def _item_sql(source: str, name: str, path: str, size: str, presence: str, kind: str, order: int, icon: str, more: str = "") -> str:
    return f"SELECT {name} AS name, {path} AS path, {order} AS sort_order, {icon} AS icon, {_SIZE.format(size)} AS size_text, CAST(coalesce({size}, 0) AS BIGINT) AS size_bytes, {presence} AS presence, {kind} AS source{more} FROM {source}"


_ITEMS = " UNION ALL ".join(
    [
        _item_sql("documents", "CAST(doc_id AS VARCHAR) || '.jpg'", "'/live/' || doc_id || '.jpg'", "n_chars", "'Present'", "'Live file'", 2, "'🖼'"),
        _item_sql(f"({Q._GHOSTS})", "CAST(key AS VARCHAR)", "''", "CAST(NULL AS BIGINT)", "'Ghost'", "source", 3, "'👻'"),
        _item_sql("part", "'carved_' || lower(to_hex(p_partkey)) || '.mp4'", "''", "CAST(p_size AS BIGINT)", "'Carved'", "'Carved (signature)'", 3, "'🎬'"),
    ]
)


def _items(spark, d):
    live = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("n"), F.concat(F.lit("/live/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("p"), F.col("n_chars").alias("s"))
    carved = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("s"), F.lit(".mp4").alias("e"))
    return items.united(items.live_rows(live, "n", "p", "s"), items.ghost_rows(Q.ghost_overlay(spark, d)), items.carved_rows(carved, "p_partkey", "s", "e"))


@query(_ITEMS)
def item_relation(spark, d):
    """Live, ghost and carved items in one relation."""
    return _items(spark, d)


@query(f"SELECT name, source, row_number() OVER (ORDER BY sort_order, size_bytes DESC, name, source) AS position FROM ({_ITEMS})")
def items_by_size(spark, d):
    from ..operators.listing import positions

    return positions(_items(spark, d), [*items.sort_by("size_bytes", True), F.col("source").asc()]).select("name", "source", "position")


@query(f"SELECT count(*) AS n_items, count(*) FILTER (presence = 'Deleted') AS n_deleted, count(*) FILTER (size_bytes > 20000) AS n_warned FROM ({_ITEMS})")
def item_counters(spark, d):
    x = _items(spark, d)
    return passes.load_counters(x.withColumn("priority", F.when(F.col("size_bytes") > 20000, 3).otherwise(0)), "presence", "priority")


@query(f"SELECT CAST(least(max(length(name)), 30) AS INTEGER) AS name, CAST(least(max(length(source)), 35) AS INTEGER) AS source FROM ({_ITEMS})")
def report_column_widths(spark, d):
    return items.report_widths(_items(spark, d), {"name": 30, "source": 35})


_MANIFEST = "SELECT c_custkey, md5(c_name) AS file_id, c_acctbal, c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'CameraRollDomain' WHEN 'MACHINERY' THEN 'MediaDomain' WHEN 'FURNITURE' THEN 'AppDomain-com.example.app' WHEN 'HOUSEHOLD' THEN 'AppDomain' ELSE 'HomeDomain' END AS domain, 'DCIM/' || c_name || '.JPG' AS relative FROM customer"
_BACKUP = (
    f"SELECT *, CASE WHEN c_acctbal >= 5000 THEN '/b/' || substring(file_id, 1, 2) || '/' || file_id WHEN c_nationkey < 10 THEN '/b/' || file_id END AS p FROM ({_MANIFEST})"
)
_BACKUP_ITEMS = _item_sql(f"({_BACKUP})", "regexp_extract(relative, '([^/]*)$', 1)", "coalesce(p, '')", "CASE WHEN p IS NOT NULL THEN c_custkey END", "CASE WHEN p IS NULL THEN 'Ghost' ELSE 'Backup' END", "CASE domain WHEN 'CameraRollDomain' THEN 'iPhone Camera Roll' WHEN 'MediaDomain' THEN 'iPhone Media' WHEN 'AppDomain-com.example.app' THEN 'iPhone App (com.example.app)' WHEN 'AppDomain' THEN 'iPhone App' ELSE 'iPhone Backup (HomeDomain)' END", 2, "CASE WHEN p IS NULL THEN '👻' ELSE '🖼' END", ", domain, relative")


@query(f"SELECT *, row_number() OVER (ORDER BY CASE WHEN domain = 'CameraRollDomain' THEN 0 ELSE 1 END, lower(relative), relative) AS position FROM ({_BACKUP_ITEMS})")
def backup_listing(spark, d):
    """A phone backup's manifest against the files that are there, some in folders, some flat, some missing."""
    from ..operators.listing import positions

    c = table(spark, d, "customer")
    domain = F.coalesce(*[F.when(F.col("c_mktsegment") == k, v) for k, v in (("BUILDING", "CameraRollDomain"), ("MACHINERY", "MediaDomain"), ("FURNITURE", "AppDomain-com.example.app"), ("HOUSEHOLD", "AppDomain"))], F.lit("HomeDomain"))
    manifest = c.select("c_custkey", "c_acctbal", "c_nationkey", F.md5("c_name").alias("file_id"), domain.alias("domain"), F.concat(F.lit("DCIM/"), F.col("c_name"), F.lit(".JPG")).alias("relative"))
    nested = manifest.where("c_acctbal >= 5000").select(F.concat(F.lit("/b/"), F.substring("file_id", 1, 2), F.lit("/"), F.col("file_id")).alias("path"))
    flat = manifest.where("c_acctbal < 5000 and c_nationkey < 10").select(F.concat(F.lit("/b/"), F.col("file_id")).alias("path"))
    found = items.physical_paths(manifest, nested.unionByName(flat), "file_id", "path", "/b")
    return positions(items.backup_rows(found, "domain", "relative", "c_custkey"), items.backup_order())


_ROWS = "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'Ghost' ELSE 'Present' END AS presence, CASE WHEN c_nationkey < 20 THEN c_nationkey || ' B' ELSE '' END AS size_text, CASE WHEN c_mktsegment = 'BUILDING' THEN '40×30' ELSE '' END AS resolution, CASE WHEN c_nationkey < 12 THEN c_mktsegment ELSE '' END AS camera, CASE WHEN c_nationkey > 6 THEN '2024-01-01' ELSE '' END AS date, CASE WHEN c_nationkey = 3 THEN '1.00000°N' ELSE '' END AS gps, CASE WHEN c_nationkey < 8 THEN 't' ELSE '' END AS thumbs_path, CASE WHEN c_nationkey < 4 THEN '2024-02-03 04:05:06' END AS thumbs_date, CASE WHEN c_nationkey > 15 THEN 'c' ELSE '' END AS thumbcache_path, c_custkey AS thumbcache_hash, CASE WHEN c_nationkey > 10 AND c_nationkey < 18 THEN 'z' ELSE '' END AS zb_path, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'PNG ⚠' WHEN c_mktsegment = 'BUILDING' THEN 'JPEG' ELSE '' END AS format FROM customer"
_KIND = "CASE WHEN thumbs_path <> '' THEN 'Thumbs.db' WHEN zb_path <> '' THEN 'ZbThumbnail.info' WHEN thumbcache_path <> '' THEN 'Thumbcache' ELSE 'Cache' END"


@query(
    f"WITH r AS ({_ROWS}) SELECT c_custkey AS item, 0 AS place, {_KIND} AS kind, 'Cached thumbnail from ' || CASE {_KIND} WHEN 'Thumbcache' THEN 'Windows thumbcache' WHEN 'ZbThumbnail.info' THEN 'Zoner Photo Studio cache' ELSE 'Windows Explorer' END || ' — original file not found on disk.' AS description, CAST(0.85 AS DOUBLE) AS confidence FROM r WHERE presence = 'Ghost' "
    "UNION ALL SELECT c_custkey, 0, 'Live file', CASE WHEN size_text <> '' THEN size_text || ' on disk' ELSE 'File present on disk' END, 1.0 FROM r WHERE presence <> 'Ghost' "
    "UNION ALL SELECT c_custkey, 1, 'EXIF metadata', concat_ws('  ·  ', resolution, CASE WHEN camera <> '' THEN camera END, CASE WHEN date <> '' THEN date END), 0.95 FROM r WHERE resolution <> '' "
    "UNION ALL SELECT c_custkey, 2, 'GPS coordinates', gps, 0.9 FROM r WHERE gps <> '' "
    "UNION ALL SELECT c_custkey, 3, 'Thumbs.db', CASE WHEN thumbs_date IS NOT NULL THEN 'Cached thumbnail dated ' || thumbs_date ELSE 'Cached thumbnail present' END, 0.85 FROM r WHERE presence <> 'Ghost' AND thumbs_path <> '' "
    "UNION ALL SELECT c_custkey, 4, 'Thumbcache', 'Windows Explorer thumbnail cache (hash: ' || lpad(upper(to_hex(thumbcache_hash)), 16, '0') || ')', 0.8 FROM r WHERE presence <> 'Ghost' AND thumbcache_path <> '' "
    "UNION ALL SELECT c_custkey, 5, 'ZbThumbnail.info', 'Zoner Photo Studio thumbnail cache', 0.8 FROM r WHERE presence <> 'Ghost' AND zb_path <> '' "
    "UNION ALL SELECT c_custkey, 6, 'Format detection', 'Detected: ' || format || CASE WHEN contains(format, '⚠') THEN ' — extension mismatch' ELSE '' END, 0.95 FROM r WHERE format <> ''"
)
def evidence_contributors(spark, d):
    n, seg = F.col("c_nationkey"), F.col("c_mktsegment")
    pick = lambda rule, value: F.when(rule, value).otherwise("")
    made = {
        "presence": F.when(F.col("c_acctbal") < 0, "Ghost").otherwise("Present"), "size_text": pick(n < 20, F.concat(n.cast("string"), F.lit(" B"))), "resolution": pick(seg == "BUILDING", F.lit("40×30")), "camera": pick(n < 12, seg), "date": pick(n > 6, F.lit("2024-01-01")), "gps": pick(n == 3, F.lit("1.00000°N")),
        "thumbs_path": pick(n < 8, F.lit("t")), "thumbs_date": F.when(n < 4, "2024-02-03 04:05:06"), "thumbcache_path": pick(n > 15, F.lit("c")), "thumbcache_hash": F.col("c_custkey"), "zb_path": pick((n > 10) & (n < 18), F.lit("z")), "format": F.when(seg == "MACHINERY", "PNG ⚠").when(seg == "BUILDING", "JPEG").otherwise(""),
    }
    rows = table(spark, d, "customer").select("c_custkey", *[v.alias(k) for k, v in made.items()])
    return items.contributors(rows, "c_custkey", {k: k for k in made})


_CAND = "SELECT o_orderkey AS item, 'Date' AS field, 'EXIF DateTimeOriginal' AS source, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS raw, 95 AS confidence FROM orders UNION ALL SELECT o_orderkey, 'Date', 'XMP CreateDate', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 80 FROM orders UNION ALL SELECT o_orderkey, 'Software', CASE WHEN o_orderstatus = 'P' THEN 'EXIF' ELSE 'EXIF IFD0' END, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 90 ELSE 85 END FROM orders UNION ALL SELECT o_orderkey, 'Software', 'XMP CreatorTool', 'p', 90 FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'ISO', 'EXIF', 'ISO ' || o_custkey, 95 FROM orders"


def _candidates(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("original_time"), F.col("o_orderdate").alias("xmp_created"), F.col("o_orderstatus").alias("software"), F.lit("p").alias("xmp_tool"), F.col("o_custkey").alias("iso"))
    return items.field_candidates(o, "o_orderkey")


@query(_CAND)
def field_candidates(spark, d):
    return _candidates(spark, d).drop("normalized")


@query(f"WITH c AS ({_CAND}), g AS (SELECT item, field, count(*) AS n, count(DISTINCT raw) AS vals FROM c GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY item, field ORDER BY confidence DESC, source, raw) AS rn FROM c) SELECT g.item, g.field, b.raw AS preferred, b.source AS source_used, CASE WHEN n = 1 THEN 'Resolved' WHEN vals <= 1 THEN 'Merged' ELSE 'Conflicted' END AS status, b.confidence, g.n FROM g JOIN b ON g.item = b.item AND g.field = b.field AND rn = 1")
def reconciled_fields(spark, d):
    return evidence.reconcile(_candidates(spark, d), ["item", "field"], "source", "raw", "normalized", "confidence")


_TYPES = "CASE p_type WHEN 'SMALL' THEN 'DepthMap' WHEN 'LARGE' THEN 'GainMap' WHEN 'PROMO' THEN 'MotionPhotoVideo' WHEN 'ECONOMY' THEN 'SecondaryImage' WHEN 'MEDIUM' THEN 'Unknown' ELSE 'Primary' END"


@query(
    f"WITH p AS (SELECT p_partkey AS item, {_TYPES} AS type, CAST(p_size AS BIGINT) * 1000 AS length, p_brand FROM part), l AS (SELECT item, type, length FROM p WHERE length > 25000), a AS (SELECT * FROM l UNION ALL SELECT item, type, CAST(NULL AS BIGINT) FROM p WHERE (item, type) NOT IN (SELECT (item, type) FROM l)) "
    "SELECT item, 'embedded-' || lower(type) AS id, 'Embedded Artifact' AS category, CASE type WHEN 'DepthMap' THEN 1 WHEN 'MotionPhotoVideo' THEN 1 WHEN 'SecondaryImage' THEN 1 WHEN 'Unknown' THEN 2 ELSE 0 END AS priority, 80 AS observed, CASE WHEN type = 'Unknown' THEN 50 ELSE 70 END AS interpreted, type || CASE WHEN length > 0 THEN ' (' || format('{:,}', length) || ' bytes)' ELSE '' END || ' detected.' AS observation FROM a"
)
def embedded_findings(spark, d):
    """Every part as a declared artifact of its type, the large ones as located: a declared one counts only where none was located."""
    kind = F.coalesce(*[F.when(F.col("p_type") == k, v) for k, v in (("SMALL", "DepthMap"), ("LARGE", "GainMap"), ("PROMO", "MotionPhotoVideo"), ("ECONOMY", "SecondaryImage"), ("MEDIUM", "Unknown"))], F.lit("Primary"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("item"), kind.alias("type"), (F.col("p_size").cast("long") * 1000).alias("length"))
    found = items.located_only(p.withColumn("length", F.lit(None).cast("long")), p.where("length > 25000"))
    return items.artifact_findings(found.withColumn("name", F.col("type")).withColumn("confidence", F.lit(80)))


@query("SELECT doc_id, CASE WHEN source LIKE '%1' THEN '🖼' WHEN source LIKE '%2' THEN '🎬' ELSE '📄' END AS icon FROM documents")
def item_icons(spark, d):
    name = F.concat(F.col("source"), F.when(F.endswith("source", F.lit("1")), ".JPG").when(F.endswith("source", F.lit("2")), ".mov").otherwise(".txt"))
    return table(spark, d, "documents").select("doc_id", S.item_icon(name).alias("icon"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN false WHEN 'MACHINERY' THEN c_nationkey < 5 WHEN 'FURNITURE' THEN c_acctbal >= 0 WHEN 'HOUSEHOLD' THEN true ELSE false END AS permitted FROM customer")
def plugin_policy(spark, d):
    policy = F.coalesce(*[F.when(F.col("c_mktsegment") == k, v) for k, v in (("BUILDING", "CoreOnly"), ("MACHINERY", "CoreAndOpenSource"), ("FURNITURE", "CoreAndSigned"), ("HOUSEHOLD", "Full"))], F.lit("other"))
    return table(spark, d, "customer").select("c_custkey", items.permitted(policy, F.col("c_nationkey") < 5, F.when(F.col("c_acctbal") >= 0, "signature")).alias("permitted"))
