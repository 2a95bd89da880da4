"""One query for each operator over whole tables, with its SQL for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import duplicates, evidence, listing, rules, sequences
from .registry import query, table


def hashed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("SELECT digest, n, first, doc_id AS member FROM (SELECT doc_id, sha256(text) AS digest, count(*) OVER w AS n, min(doc_id) OVER w AS first FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY sha256(text))) WHERE n >= 2")
def exact_dup_groups(spark, d):
    return duplicates.exact_groups(hashed(spark, d), "doc_id", "hash")


@query("SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) - 1 AS duplicate_count FROM documents WHERE text IS NOT NULL")
def exact_dup_annotate(spark, d):
    return duplicates.annotate_duplicates(hashed(spark, d), "hash").where("hash is not null").select("doc_id", "duplicate_count")


def vector_bits(spark, d):
    """63 bits: whether each component is under the next; a stand-in for an image's difference hash."""
    e = table(spark, d, "embeddings")
    parts = [F.when(F.get("embedding", F.lit(i)) < F.get("embedding", F.lit(i + 1)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(63)]
    bits = parts[0]
    for p in parts[1:]:
        bits = bits + p
    return e.select("vec_id", bits.alias("bits"))


_BITS_SQL = "SELECT vec_id, CAST(list_sum(list_transform(range(63), lambda i: CASE WHEN embedding[i+1] < embedding[i+2] THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT) AS bits FROM embeddings"
_PAIRS_SQL = f"WITH h AS (SELECT bits, min(vec_id) AS vec_id FROM ({_BITS_SQL}) WHERE bits <> 0 GROUP BY bits) SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.bits, y.bits)) AS INTEGER) AS distance FROM h x JOIN h y ON x.vec_id < y.vec_id AND bit_count(xor(x.bits, y.bits)) <= 16"


@query("SELECT vec_id, CAST(list_sum(list_transform(range(56), lambda i: CASE WHEN embedding[i // 8 * 9 + i % 8 + 1] < embedding[i // 8 * 9 + i % 8 + 2] THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT) AS bits FROM embeddings")
def dhash_bits(spark, d):
    """The difference hash of 7 rows of 9 grey values."""
    return table(spark, d, "embeddings").select("vec_id", S.dhash(F.col("embedding"), 9, 7).alias("bits"))


@query(_PAIRS_SQL)
def near_dup_pairs(spark, d):
    return duplicates.near_pairs(vector_bits(spark, d), "vec_id", "bits", 16, 63)


_GROUPS_SQL = (
    f"WITH RECURSIVE p AS ({_PAIRS_SQL}), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT DISTINCT a AS item, a AS low FROM e UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.item), "
    f"reps AS (SELECT item, min(low) AS g FROM r GROUP BY item), h AS ({_BITS_SQL}), c AS (SELECT bits, min(vec_id) AS rep FROM h WHERE bits <> 0 GROUP BY bits), placed AS (SELECT h.vec_id AS item, coalesce(reps.g, c.rep) AS group_id FROM h JOIN c USING (bits) LEFT JOIN reps ON reps.item = c.rep) "
    "SELECT item, group_id FROM placed WHERE group_id IN (SELECT group_id FROM placed GROUP BY 1 HAVING count(*) >= 2)"
)


@query(_GROUPS_SQL)
def near_dup_groups(spark, d):
    return duplicates.near_groups(vector_bits(spark, d), "vec_id", "bits", 16, 63)


@query(f"WITH g AS ({_GROUPS_SQL}), h AS ({_BITS_SQL}), j AS (SELECT group_id, bits FROM g JOIN h ON item = vec_id), n AS (SELECT group_id, count(*) AS n FROM j GROUP BY 1) SELECT group_id, n, max(CAST(bit_count(xor(x.bits, y.bits)) AS INTEGER)) AS max_distance FROM n JOIN j x USING (group_id) JOIN j y USING (group_id) GROUP BY 1, 2")
def near_dup_diameters(spark, d):
    bits = vector_bits(spark, d)
    return duplicates.group_diameters(duplicates.near_groups(bits, "vec_id", "bits", 16, 63), bits, "vec_id", "bits")


@query("SELECT p_brand, p_partkey AS number_before, nxt AS number_after, p_partkey AS item_before, nxt AS item_after, least(nxt - p_partkey - 1, 99) AS missing FROM (SELECT p_brand, p_partkey, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nxt FROM part) WHERE nxt - p_partkey - 1 >= 2")
def sequence_gaps(spark, d):
    return sequences.sequence_gaps(table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_partkey").alias("item")), "item", ["p_brand"], "p_partkey")


SQL_GAPS = "WITH n AS (SELECT c_name, regexp_extract(c_name, '^(.*?)(\\d+)$', 1) AS prefix, length(regexp_extract(c_name, '(\\d+)$', 1)) AS width, CAST(regexp_extract(c_name, '(\\d+)$', 1) AS INTEGER) AS num FROM customer WHERE c_mktsegment = 'BUILDING'), g AS (SELECT *, lead(num) OVER (PARTITION BY prefix, width ORDER BY num, c_name) AS nxt, lead(c_name) OVER (PARTITION BY prefix, width ORDER BY num, c_name) AS after FROM n) SELECT prefix, CAST(width AS INTEGER) AS width, num AS number_before, nxt AS number_after, c_name AS item_before, after AS item_after, CAST(least(nxt - num - 1, 99) AS BIGINT) AS missing FROM g WHERE nxt - num - 1 >= 2"


@query(SQL_GAPS)
def sequence_gaps_name(spark, d):
    """Of one market segment, whose names leave gaps."""
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("item"), "c_name")
    return sequences.name_gaps(c, "item", "c_name")


@query("SELECT l_orderkey AS number_before, nxt AS number_after, least(nxt - l_orderkey - 1, 99) AS missing FROM (SELECT l_orderkey, lead(l_orderkey) OVER (ORDER BY l_orderkey) AS nxt FROM (SELECT DISTINCT l_orderkey FROM lineitem)) WHERE nxt - l_orderkey - 1 >= 2")
def order_gaps(spark, d):
    return sequences.global_gaps(table(spark, d, "lineitem"), "l_orderkey")


def _clusters(part: str) -> str:
    over = f"OVER ({part} ORDER BY ts, event_id)"
    return f"SELECT event_id, user_id, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) {over.replace(')', ' ROWS UNBOUNDED PRECEDING)')} AS session_id, sum(CASE WHEN gap IS NULL OR gap > 5000000 THEN 1 ELSE 0 END) {over.replace(')', ' ROWS UNBOUNDED PRECEDING)')} AS burst_id FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) {over} AS gap FROM events)"


@query(f"SELECT event_id, CAST(session_id AS BIGINT) AS session_id, CAST(burst_id AS BIGINT) AS burst_id FROM ({_clusters('')})")
def burst_session(spark, d):
    return sequences.burst_sessions(table(spark, d, "events").select("event_id", "ts"), "event_id", "ts").select("event_id", "session_id", "burst_id")


@query(f"SELECT event_id, user_id, CAST(session_id AS BIGINT) AS session_id, CAST(burst_id AS BIGINT) AS burst_id FROM ({_clusters('PARTITION BY user_id')})")
def burst_session_user(spark, d):
    return sequences.burst_sessions(table(spark, d, "events").select("event_id", "user_id", "ts"), "event_id", "ts", ["user_id"]).select("event_id", "user_id", "session_id", "burst_id")


@query(f"WITH s AS ({_clusters('PARTITION BY user_id')}), j AS (SELECT s.user_id, s.session_id, s.event_id, e.ts, count(*) OVER (PARTITION BY s.user_id, s.session_id) AS members FROM s JOIN events e USING (event_id)) SELECT user_id, CAST(session_id AS BIGINT) AS session_id, event_id, members, CAST(row_number() OVER (PARTITION BY user_id, session_id ORDER BY ts, event_id) AS INTEGER) AS position FROM j WHERE members >= 2")
def session_storyboard(spark, d):
    c = sequences.burst_sessions(table(spark, d, "events").select("event_id", "user_id", "ts"), "event_id", "ts", ["user_id"]).where("session_id > 0")
    return sequences.storyboard(c, "event_id", "ts", ["user_id", "session_id"]).select("user_id", "session_id", "event_id", "members", "position")


@query(f"WITH s AS ({_clusters('PARTITION BY user_id')}) SELECT s.user_id, count(*) AS n, min(epoch_us(e.ts)) AS first_us, max(epoch_us(e.ts)) + 1800000000 AS end_us FROM s JOIN events e USING (event_id) GROUP BY s.user_id, s.session_id")
def session_window_events(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", "n", F.unix_micros("w.start").alias("first_us"), F.unix_micros("w.end").alias("end_us"))


_TUKEY = "WITH q AS (SELECT event_type, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1), x AS (SELECT e.event_type, e.event_id AS item, e.value, CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN q1 - value WHEN value > q3 + 1.5 * (q3 - q1) THEN value - q3 END AS distance FROM events e JOIN q USING (event_type) WHERE n >= 4)"


@query(f"{_TUKEY} SELECT event_type, item, round(value, 6) AS value, round(distance, 6) AS distance FROM x WHERE distance IS NOT NULL")
def tukey_outliers(spark, d):
    return sequences.tukey_outliers(table(spark, d, "events"), "event_id", "value", ["event_type"]).withColumn("value", F.round("value", 6)).withColumn("distance", F.round("distance", 6))


_MAJORITY = "WITH c AS (SELECT source, lower(trim(lang)) AS k, count(*) AS n FROM documents WHERE trim(lang) <> '' GROUP BY 1, 2), t AS (SELECT source, sum(n) AS total, max(n) AS best FROM c GROUP BY 1), m AS (SELECT c.source, max(c.k) AS majority FROM c JOIN t ON c.source = t.source AND c.n = t.best WHERE t.total >= 3 AND t.best >= 0.6 * t.total GROUP BY 1)"


@query(f"{_MAJORITY} SELECT d.source, d.doc_id AS item, lower(trim(d.lang)) AS category, m.majority FROM documents d JOIN m USING (source) WHERE lower(trim(d.lang)) <> m.majority")
def majority_outliers(spark, d):
    return sequences.majority_outliers(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", "lang", ["source"], 0.6)


SQL_REASONS = f"{_TUKEY}, a AS (SELECT item, 0 AS r, 'value' AS reason FROM x WHERE distance IS NOT NULL UNION ALL SELECT event_id, 1, 'type' FROM events WHERE event_type = (SELECT min(event_type) FROM events)) SELECT item, string_agg(reason, '; ' ORDER BY r) AS reasons FROM a GROUP BY item"


@query(SQL_REASONS)
def outlier_reasons(spark, d):
    e = table(spark, d, "events")
    least = e.agg(F.min("event_type").alias("t"))
    typed = e.join(F.broadcast(least), F.col("event_type") == F.col("t")).select(F.col("event_id").alias("item"))
    return sequences.outlier_reasons([("value", sequences.tukey_outliers(e, "event_id", "value", ["event_type"])), ("type", typed)])


_CANDIDATES = "SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS source, l_returnflag AS raw, CASE WHEN l_returnflag = 'R' THEN NULL ELSE lower(l_returnflag) END AS normalized, CAST(l_partkey % 100 AS INTEGER) AS confidence FROM lineitem"
_RECONCILED = f"WITH c AS ({_CANDIDATES}), v AS (SELECT *, coalesce(normalized, raw) AS value FROM c), g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT CASE WHEN raw IS NOT NULL THEN value END) AS vals FROM v GROUP BY 1), b AS (SELECT l_orderkey, value AS preferred, source AS source_used, confidence, row_number() OVER (PARTITION BY l_orderkey ORDER BY confidence DESC, source, value) AS rn FROM v) SELECT g.l_orderkey, b.preferred, b.source_used, CASE WHEN n = 1 THEN 'Resolved' WHEN vals <= 1 THEN 'Merged' ELSE 'Conflicted' END AS status, b.confidence, g.n FROM g JOIN b ON g.l_orderkey = b.l_orderkey AND b.rn = 1"


def _reconciled(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("source"), F.col("l_returnflag").alias("raw"), F.when(F.col("l_returnflag") != "R", F.lower("l_returnflag")).alias("normalized"), (F.col("l_partkey") % 100).cast("int").alias("confidence"))
    return evidence.reconcile(li, ["l_orderkey"], "source", "raw", "normalized", "confidence")


@query(_RECONCILED)
def reconcile_orders(spark, d):
    return _reconciled(spark, d)


@query(f"SELECT status, count(*) AS n FROM ({_RECONCILED}) GROUP BY status")
def reconcile_status(spark, d):
    return _reconciled(spark, d).groupBy("status").agg(F.count("*").alias("n"))


_CACHES = "live AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'), t1 AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'), t2 AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 3000), t3 AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey < 10)"
_GHOSTS = f"WITH {_CACHES} SELECT k AS key, 'thumbs' AS source FROM t1 WHERE k NOT IN (SELECT k FROM live) UNION ALL SELECT k, 'cache' FROM t2 WHERE k NOT IN (SELECT k FROM live) AND k NOT IN (SELECT k FROM t1) UNION ALL SELECT k, 'zb' FROM t3 WHERE k NOT IN (SELECT k FROM live) AND k NOT IN (SELECT k FROM t1) AND k NOT IN (SELECT k FROM t2)"


@query(_GHOSTS)
def ghost_overlay(spark, d):
    c = table(spark, d, "customer")
    live = table(spark, d, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    sources = [("thumbs", c.where("c_mktsegment = 'BUILDING'"), True), ("cache", c.where("c_acctbal < 3000"), True), ("zb", c.where("c_nationkey < 10"), True)]
    return evidence.ghosts(sources, live, "o_custkey", "c_custkey")


@query("SELECT o_orderkey AS key, 'orders' AS source FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def ghost_anti(spark, d):
    return evidence.ghosts([("orders", table(spark, d, "orders").select("o_orderkey"), False)], table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey", "o_orderkey")


@query("WITH f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS rn FROM lineitem) SELECT o_orderkey, l_linenumber AS cache_l_linenumber, l_suppkey AS cache_l_suppkey, l_partkey AS cache_l_partkey, l_extendedprice AS cache_l_extendedprice FROM orders LEFT JOIN f ON o_orderkey = l_orderkey AND rn = 1")
def enrich_left_first(spark, d):
    order = ["l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"]
    return evidence.enrich(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey", *order), "o_orderkey", "l_orderkey", order)


SQL_CORRELATED = "SELECT c_custkey AS name, 'orders' AS app FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT c_custkey, 'events' FROM customer WHERE c_custkey IN (SELECT user_id FROM events)"


@query(SQL_CORRELATED)
def correlation_semi(spark, d):
    return evidence.correlate(table(spark, d, "customer"), "c_custkey", [("orders", table(spark, d, "orders").where("o_orderstatus = 'F'"), "o_custkey"), ("events", table(spark, d, "events"), "user_id")])


_SOFTWARE = "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'Instagram 300' WHEN 'BUILDING' THEN 'Adobe Photoshop Lightroom' WHEN 'FURNITURE' THEN 'WhatsApp' WHEN 'AUTOMOBILE' THEN 'Camera 1.0' ELSE '' END || CASE WHEN c_nationkey < 5 THEN ' Snapseed' WHEN c_nationkey < 10 THEN ' darktable 4' ELSE '' END AS software FROM customer"


def _software(spark, d):
    """What wrote an image, as its market segment and nation stand for."""
    written = F.coalesce(*[F.when(F.col("c_mktsegment") == k, v) for k, v in (("MACHINERY", "Instagram 300"), ("BUILDING", "Adobe Photoshop Lightroom"), ("FURNITURE", "WhatsApp"), ("AUTOMOBILE", "Camera 1.0"))], F.lit(""))
    edited = F.when(F.col("c_nationkey") < 5, " Snapseed").when(F.col("c_nationkey") < 10, " darktable 4").otherwise("")
    return table(spark, d, "customer").select("c_custkey", F.concat(written, edited).alias("software"))


def _chain(family: str) -> str:
    found = [p for p in evidence.PROFILES if p[0] == family]
    return f"SELECT c_custkey AS item, '{family}' AS family, CASE " + " ".join(f"WHEN contains(t, '{k}') THEN '{p}'" for _, _, k, p, _ in found) + " END AS profile_id, 3 AS strength FROM (SELECT c_custkey, lower(software) AS t FROM (" + _SOFTWARE + "))"


_MATCHES = "SELECT * FROM (" + " UNION ALL ".join(map(_chain, ("social", "editing"))) + ") WHERE profile_id IS NOT NULL"


def _matches(spark, d):
    return evidence.keyword_matches(_software(spark, d), "c_custkey", "software")


@query(_MATCHES)
def signature_matches(spark, d):
    return _matches(spark, d)


@query(f"SELECT c_custkey AS item, CASE WHEN regexp_matches(lower(software), 'photoshop|instagram|whatsapp|snapseed|darktable') THEN 'software-editing-tool' ELSE 'software-field-present' END AS id, CASE WHEN regexp_matches(lower(software), 'photoshop|instagram|whatsapp|snapseed|darktable') THEN 2 ELSE 0 END AS priority, CASE WHEN regexp_matches(lower(software), 'photoshop|instagram|whatsapp|snapseed|darktable') THEN 95 ELSE 99 END AS observed, CASE WHEN regexp_matches(lower(software), 'photoshop|instagram|whatsapp|snapseed|darktable') THEN 75 ELSE -1 END AS interpreted FROM ({_SOFTWARE}) WHERE trim(software) <> ''")
def software_findings(spark, d):
    return rules.findings(_software(spark, d), "c_custkey", rules.software(F.col("software")))


@query(f"SELECT item, split_part(profile_id, '.', 1) AS category, count(*) AS n, string_agg(DISTINCT profile_id, ', ' ORDER BY profile_id) AS profiles FROM ({_MATCHES}) WHERE strength >= 2 GROUP BY 1, 2 HAVING count(*) > 1")
def signature_conflicts(spark, d):
    return evidence.signature_conflicts(_matches(spark, d))


@query(f"SELECT item, profile_id, strength FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY strength DESC, profile_id) AS rn FROM ({_MATCHES})) WHERE rn = 1")
def top_match(spark, d):
    return evidence.top_match(_matches(spark, d))


@query(
    "WITH f AS (SELECT doc_id AS item, CASE WHEN quality = 0 THEN 2 ELSE 0 END AS p FROM labels UNION ALL SELECT doc_id, CASE WHEN toxic = 1 THEN 3 ELSE 0 END FROM labels UNION ALL SELECT doc_id, 4 FROM labels WHERE toxic = 1 AND quality = 0), "
    "r AS (SELECT item, max(p) AS top_priority, count(*) FILTER (p = 4) AS n_critical, count(*) FILTER (p = 3) AS n_high, count(*) FILTER (p = 2) AS n_medium FROM f GROUP BY item) "
    "SELECT *, CASE WHEN n_critical + n_high + n_medium = 0 THEN 'All clear' ELSE concat_ws(' · ', CASE WHEN n_critical > 0 THEN n_critical || ' critical' END, CASE WHEN n_high > 0 THEN n_high || ' high' END, CASE WHEN n_medium > 0 THEN n_medium || ' medium' END) END AS summary, CASE WHEN n_critical + n_high + n_medium > 0 THEN (n_critical + n_high + n_medium) || ' ⚠' ELSE '✓' END AS badge FROM r"
)
def finding_rollup(spark, d):
    x = table(spark, d, "labels")
    p = F.explode(F.filter(F.array(F.when(F.col("quality") == 0, 2).otherwise(0), F.when(F.col("toxic") == 1, 3).otherwise(0), F.when((F.col("toxic") == 1) & (F.col("quality") == 0), 4)), lambda v: v.isNotNull()))
    return evidence.rollup(x.select("doc_id", p.alias("p")), "doc_id", "p")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def date_groups(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT string_agg(n || '×' || event_type, ', ' ORDER BY event_type) AS inventory FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def inventory_counts(spark, d):
    counted = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct("event_type", "n")))  # a row for each type
    return counted.agg(F.array_join(F.transform(parts, lambda x: F.concat(x["n"].cast("string"), F.lit("×"), x["event_type"])), ", ").alias("inventory"))


def _rule_sql(source: str, item: str, cases: list[str]) -> str:
    return f"SELECT item, f.id AS id, CAST(f.priority AS INTEGER) AS priority, CAST(f.observed AS INTEGER) AS observed, CAST(f.interpreted AS INTEGER) AS interpreted FROM (SELECT {item} AS item, unnest(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)) AS f FROM {source})"


def _f(i, p, o, n=-1):
    return f"{{'id': '{i}', 'priority': {p}, 'observed': {o}, 'interpreted': {n}}}"


_TIMES = "(SELECT o_orderkey, l_linenumber, min(epoch_us(l_shipdate)) AS s, min(epoch_us(o_orderdate)) AS o FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"


@query(_rule_sql(_TIMES, "o_orderkey * 10 + l_linenumber", [f"CASE WHEN abs(s - o) <= 86400000000 THEN {_f('ts-fs-consistent', 0, 80)} WHEN s > o THEN {_f('ts-fs-later', 1, 90, 65)} ELSE {_f('ts-fs-precedes-exif', 2, 85, 55)} END", f"CASE WHEN abs(s - o) <= 120000000 THEN {_f('ts-ifd0-consistent', 0, 95)} ELSE {_f('ts-ifd0-differs', 2, 95, 80)} END", f"CASE WHEN abs(s - o) > 120000000 THEN {_f('ts-digitized-differs', 1, 95, 60)} END"]))
def timestamp_consistency(spark, d):
    o, li = table(spark, d, "orders").select("o_orderkey", "o_orderdate"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    x = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("s")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("item", F.col("o_orderkey") * 10 + F.col("l_linenumber"))
    return rules.findings(x, "item", rules.file_time(F.col("o_orderdate"), F.col("s")), rules.header_time(F.col("o_orderdate"), F.col("s")), rules.digitized_time(F.col("o_orderdate"), F.col("s")))


_GPS = "(SELECT event_id, epoch_us(ts) AS t, epoch_us(ts) + CAST(event_id % 61 - 30 AS BIGINT) * 3600000000 AS g, CAST(user_id % 361 - 180 AS DOUBLE) AS lon FROM events)"


def _gps(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.withColumn("g", F.timestamp_micros(F.unix_micros("t") + (F.col("event_id") % 61 - 30) * 3_600_000_000)).withColumn("lon", (F.col("user_id") % 361 - 180).cast("double"))


@query(_rule_sql(_GPS, "event_id", [f"CASE WHEN abs(g - t) <= 93600000000 THEN {_f('gps-ts-consistent', 0, 85)} ELSE {_f('gps-ts-date-mismatch', 3, 90, 65)} END"]))
def gps_timestamp(spark, d):
    return rules.findings(_gps(spark, d), "event_id", rules.gps_time(F.col("t"), F.col("g")))


@query(_rule_sql(_GPS, "event_id", [f"CASE WHEN abs((t - g) / 3600000000.0 - round_even(lon / 15 * 2, 0) / 2) <= 3 THEN {_f('timezone-inference-consistent', 0, 70, 60)} ELSE {_f('timezone-inference-offset-mismatch', 2, 70, 50)} END"]))
def timezone_inference(spark, d):
    return rules.findings(_gps(spark, d), "event_id", rules.zone(F.col("t"), F.col("g"), F.col("lon")))


_PAIR = "(SELECT p_partkey, p_size * 40.0 AS w, (p_partkey % 37 + 1) * 40.0 AS h, (p_size % 13 + 1) * 10.0 AS tw, (p_partkey % 11 + 1) * 10.0 AS th FROM part)"


@query(_rule_sql(_PAIR, "p_partkey", [f"CASE WHEN tw > w OR th > h THEN {_f('thumb-larger-than-main', 3, 97, 75)} WHEN abs(w/h - tw/th) > 0.05 AND abs(1/(w/h) - tw/th) < 0.05 THEN {_f('thumb-orientation-mismatch', 1, 90, 65)} WHEN abs(w/h - tw/th) > 0.05 THEN {_f('thumb-aspect-ratio-mismatch', 2, 93, 65)} ELSE {_f('thumb-dimensions-consistent', 0, 92)} END", f"CASE WHEN abs(w/h - tw/th) / (w/h) > 0.02 THEN {_f('thumb-aspect-ratio-mismatch', 2, 99, 75)} ELSE {_f('thumb-aspect-ratio-match', 0, 95)} END"]).replace("40.0", "CAST(40 AS DOUBLE)").replace("10.0", "CAST(10 AS DOUBLE)"))
def aspect_rules(spark, d):
    w, h, tw, th = (c.cast("double") for c in (F.col("p_size") * 40, (F.col("p_partkey") % 37 + 1) * 40, (F.col("p_size") % 13 + 1) * 10, (F.col("p_partkey") % 11 + 1) * 10))
    return rules.findings(table(spark, d, "part"), "p_partkey", rules.thumbnail_size(w, h, tw, th), rules.thumbnail_aspect(w, h, tw, th))


@query("SELECT event_id, CASE WHEN v < 0 THEN 'Unknown' WHEN v <= 19 THEN 'Very low' WHEN v <= 39 THEN 'Low' WHEN v <= 59 THEN 'Moderate' WHEN v <= 79 THEN 'High' ELSE 'Very high' END AS label FROM (SELECT event_id, CAST(floor(value) AS INTEGER) - 5 AS v FROM events WHERE value IS NOT NULL)")
def confidence_labels(spark, d):
    return table(spark, d, "events").where("value is not null").select("event_id", S.confidence_label(F.floor("value").cast("int") - 5).alias("label"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'r#00000001')")
def search_filter(spark, d):
    return listing.search(table(spark, d, "customer"), "c_name", "R#00000001").select("c_custkey", "c_name")


@query("SELECT doc_id, CASE WHEN n_chars IS NULL THEN '' WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars * 10 / 1024.0 + 0.5) / 10) ELSE printf('%.1f MB', floor(n_chars * 10 / 1048576.0 + 0.5) / 10) END AS size FROM documents")
def size_text(spark, d):
    return table(spark, d, "documents").select("doc_id", S.size_text(F.col("n_chars")).alias("size"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY sort_order, c_acctbal DESC, c_custkey) AS position FROM (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END AS sort_order FROM customer)")
def grid_sort(spark, d):
    """Rows with their place in a total order: ranges, then places inside them, then offsets."""
    from ..operators.listing import positions

    c = table(spark, d, "customer").withColumn("sort_order", F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(2))
    return positions(c, [F.col("sort_order").asc(), F.col("c_acctbal").desc(), F.col("c_custkey").asc()]).select("c_custkey", "position")


_RELATED = f"SELECT h.vec_id, h.bits, CAST(round_even(CAST(e.embedding[1] AS DOUBLE) * 20, 0) AS INTEGER) AS digest, e.label AS burst FROM ({_BITS_SQL}) h JOIN embeddings e ON h.vec_id = e.vec_id"


@query(
    f"WITH x AS ({_RELATED}), s AS (SELECT * FROM x WHERE burst > 0 ORDER BY vec_id LIMIT 1), r AS (SELECT x.vec_id AS item, CASE WHEN x.digest = s.digest THEN 'Exact Duplicate' WHEN x.bits <> 0 AND s.bits <> 0 AND bit_count(xor(x.bits, s.bits)) <= 24 THEN 'Near Duplicate (dHash Δ' || CAST(bit_count(xor(x.bits, s.bits)) AS INTEGER) || ')' WHEN x.burst = s.burst THEN 'Burst Sibling' END AS relation FROM x, s WHERE x.vec_id <> s.vec_id) "
    "SELECT item, relation, row_number() OVER (ORDER BY CASE WHEN relation = 'Exact Duplicate' THEN 0 WHEN starts_with(relation, 'Near') THEN 1 ELSE 2 END, CAST(item AS VARCHAR), item) AS position FROM r WHERE relation IS NOT NULL"
)
def related_items(spark, d):
    """What relates to the first vector of a labelled burst: the same rounded first component, a near hash, the same label."""
    e = table(spark, d, "embeddings").select("vec_id", F.bround(F.get("embedding", F.lit(0)).cast("double") * 20).cast("int").cast("string").alias("digest"), F.col("label").alias("burst"))
    x = e.join(vector_bits(spark, d), "vec_id")
    first = x.where("burst > 0").orderBy("vec_id").limit(1)
    return duplicates.related_items(x, first, "vec_id", "digest", "bits", "burst", "vec_id", 24)
