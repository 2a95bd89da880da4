"""Cache enrichment, ghosts, correlation, reconciliation, signatures and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIORITIES = ("None", "Low", "Medium", "High", "Critical")
STRENGTHS = ("None", "Weak", "Moderate", "Strong")


def first_entries(cache: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, case aside: the first by ``order``. A partial aggregation, so a hot key is cheap."""
    columns = [c for c in cache.columns if c != key]
    best = F.min(F.struct(*order, *[c for c in columns if c not in order]))
    return cache.groupBy(F.lower(F.col(key).cast("string")).alias("__key")).agg(best.alias("__best")).select("__key", *[F.col(f"__best.{c}") for c in columns])


def enrich(live: DataFrame, cache: DataFrame, live_key: str, cache_key: str, order: list[str], prefix: str = "cache_") -> DataFrame:
    """live, left-joined to the first cache entry of its name, case aside."""
    first = first_entries(cache, cache_key, order)
    renamed = first.select("__key", *[F.col(c).alias(f"{prefix}{c}") for c in first.columns if c != "__key"])
    return live.join(renamed, F.lower(F.col(live_key).cast("string")) == F.col("__key"), "left").drop("__key")


def ghosts(sources: list[tuple[str, DataFrame, bool]], live: DataFrame, live_key: str, key: str) -> DataFrame:
    """key, source of cache entries without a live item, cascaded: a name goes to the first source that has it.

    ``sources`` are (name, table, whether the name must also be absent from the sources before).
    Null names match nothing and stay.
    """
    known = live.select(F.lower(F.col(live_key).cast("string")).alias("__k"))
    out = None
    for name, table, cascade in sources:
        own = table.select(F.col(key).alias("key"), F.lower(F.col(key).cast("string")).alias("__k"))
        lost = own.join(known, "__k", "left_anti").select("key", F.lit(name).alias("source"), "__k")
        out = lost if out is None else out.unionByName(lost)
        if cascade:
            known = known.unionByName(own.select("__k"))
    return out.drop("__k")


def correlate(files: DataFrame, name: str, apps: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """name, app of files that an application's table refers to, by base name, case aside."""
    out = None
    for app, table, column in apps:
        names = table.select(F.lower(F.regexp_extract(F.col(column).cast("string"), r"([^/\\]*)$", 1)).alias("__k")).where("__k <> ''")
        hit = files.join(names, F.lower(F.col(name).cast("string")) == F.col("__k"), "left_semi").select(F.col(name).alias("name"), F.lit(app).alias("app"))
        out = hit if out is None else out.unionByName(hit)
    return out


def reconcile(candidates: DataFrame, keys: list[str], source: str, raw: str, normalized: str, confidence: str) -> DataFrame:
    """keys, preferred, source_used, status, confidence, n of conflicting candidates.

    None is Ambiguous (a group without candidates has no row here), one Resolved, equal values Merged,
    others Conflicted. The preferred one has the highest confidence, then the least source and value.
    """
    value = F.coalesce(F.col(normalized), F.col(raw))
    rank = F.struct((-F.col(confidence)).alias("r"), F.col(source).alias("s"), value.alias("v"))
    grouped = candidates.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col(raw).isNotNull(), value)).alias("__values"), F.min(rank).alias("__best"))
    status = F.when(F.col("n") == 1, "Resolved").when(F.col("__values") <= 1, "Merged").otherwise("Conflicted")
    return grouped.select(*keys, F.col("__best.v").alias("preferred"), F.col("__best.s").alias("source_used"), status.alias("status"), (-F.col("__best.r")).alias("confidence"), "n")


#: Family, order in it, keyword, profile, strength (fixed values).
PROFILES = (
    *(("social", i, k, f"workflow.{k}", 3) for i, k in enumerate(("instagram", "whatsapp", "facebook", "snapchat", "twitter", "telegram", "tiktok", "wechat"))),
    *(
        ("editing", i, k, f"workflow.{p}", 3)
        for i, (k, p) in enumerate(
            (("photoshop", "photoshop"), ("lightroom", "lightroom"), ("adobe camera raw", "acr"), ("capture one", "capture-one"), ("darktable", "darktable"), ("rawtherapee", "rawtherapee"), ("gimp", "gimp"), ("snapseed", "snapseed"), ("facetune", "facetune"), ("vsco", "vsco"), ("picsart", "picsart"), ("affinity photo", "affinity-photo"), ("on1", "on1"), ("paintshop", "paintshop"), ("meitu", "meitu"))
        )
    ),
)
#: Sizes of phone screens (fixed values).
SCREENS = ((1170, 2532), (1179, 2556), (1290, 2796), (1080, 2400), (1440, 3200), (2532, 1170), (2556, 1179))


def profile_table(spark: SparkSession, profiles=PROFILES) -> DataFrame:
    return spark.createDataFrame([tuple(p) for p in profiles], "family string, rank int, keyword string, profile_id string, strength int")


def keyword_matches(df: DataFrame, item: str, text: str, profiles=PROFILES) -> DataFrame:
    """item, family, profile_id, strength: the first profile of each family whose keyword the text contains.

    Rules are expressions over the row, so there is no join; families come out as rows.
    """
    low = F.lower(F.col(text).cast("string"))
    found = []
    for family in dict.fromkeys(p[0] for p in profiles):
        chain = F.lit(None).cast("struct<family:string,profile_id:string,strength:int>")
        for _, _, keyword, profile, strength in sorted((p for p in profiles if p[0] == family), key=lambda p: -p[1]):
            chain = F.when(F.contains(low, F.lit(keyword)), F.struct(F.lit(family).alias("family"), F.lit(profile).alias("profile_id"), F.lit(strength).alias("strength"))).otherwise(chain)
        found.append(chain)
    hits = F.filter(F.array(*found), lambda m: m.isNotNull())
    return df.select(F.col(item).alias("item"), F.explode(hits).alias("m")).select("item", "m.family", "m.profile_id", "m.strength")


def platform_matches(df: DataFrame, item: str, model: str, software: str, has_gps: str) -> DataFrame:
    """item, profile_id, strength of the camera platform: Pixel, else iPhone; else Samsung."""
    m, s = F.lower(F.coalesce(F.col(model), F.lit(""))), F.lower(F.coalesce(F.col(software), F.lit("")))
    gps = F.coalesce(F.col(has_gps), F.lit(False))

    def strength(by_model: Column, by_software: Column) -> Column:
        return F.when(by_model.cast("int") + by_software.cast("int") + gps.cast("int") >= 2, 3).otherwise(2)

    pixel = (F.contains(m, F.lit("pixel")), F.contains(s, F.lit("pixel")))
    phone = (F.contains(m, F.lit("iphone")) | F.contains(m, F.lit("ipad")), F.contains(s, F.lit("ios")) | F.contains(s, F.lit("iphone")))
    galaxy = F.contains(m, F.lit("samsung")) | F.contains(m, F.lit("sm-")) | F.contains(s, F.lit("samsung"))

    def hit(name: str, rank: Column | int) -> Column:
        return F.struct(F.lit(name).alias("profile_id"), (F.lit(rank) if isinstance(rank, int) else rank).cast("int").alias("strength"))

    match = F.when(pixel[0] | pixel[1], hit("platform.google-pixel", strength(*pixel))).when(phone[0] | phone[1], hit("platform.apple-iphone", strength(*phone))).when(galaxy, hit("platform.samsung-galaxy", 2))
    return df.select(F.col(item).alias("item"), match.alias("m")).where("m is not null").select("item", "m.profile_id", "m.strength")


def screenshot_matches(df: DataFrame, item: str, model: str, software: str, width: str, height: str, has_gps: str) -> DataFrame:
    """item, profile_id, strength of screenshots: only without camera model and GPS; by keyword, else by an exact screen size."""
    plain = (F.coalesce(F.trim(model), F.lit("")) == "") & ~F.coalesce(F.col(has_gps), F.lit(False))
    size = F.lit(False)
    for w, h in SCREENS:
        size = size | ((F.col(width) == w) & (F.col(height) == h))
    rank = F.when(F.contains(F.lower(F.coalesce(F.col(software), F.lit(""))), F.lit("screenshot")), 3).when(F.coalesce(size, F.lit(False)), 1)
    return df.where(plain).select(F.col(item).alias("item"), F.lit("workflow.screenshot").alias("profile_id"), rank.alias("strength")).where("strength is not null")


def signature_conflicts(matches: DataFrame, least: int = 2) -> DataFrame:
    """item, category, n, profiles: categories (id up to the first dot) with several matches of Moderate strength or more."""
    from ..functions.scalars import id_prefix

    strong = matches.where(F.col("strength") >= least).withColumn("category", id_prefix(F.col("profile_id")))
    return strong.groupBy("item", "category").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("profile_id")), ", ").alias("profiles")).where("n > 1")


def top_match(matches: DataFrame) -> DataFrame:
    """item, profile_id, strength: the strongest, then the least id."""
    best = F.min(F.struct((-F.col("strength")).alias("r"), F.col("profile_id").alias("p")))
    return matches.groupBy("item").agg(best.alias("b")).select("item", F.col("b.p").alias("profile_id"), (-F.col("b.r")).alias("strength"))


def rollup(findings: DataFrame, item: str, priority: str) -> DataFrame:
    """item, top_priority, counts of critical, high and medium findings, summary, badge; priorities are ordinals."""
    p = F.col(priority)
    out = findings.groupBy(F.col(item).alias("item")).agg(F.max(p).alias("top_priority"), F.count_if(p == 4).alias("n_critical"), F.count_if(p == 3).alias("n_high"), F.count_if(p == 2).alias("n_medium"))
    part = lambda n, word: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {word}")))
    text = F.concat_ws(" \u00b7 ", part("n_critical", "critical"), part("n_high", "high"), part("n_medium", "medium"))
    warned = F.col("n_critical") + F.col("n_high") + F.col("n_medium")
    return out.withColumn("summary", F.when(text == "", "All clear").otherwise(text)).withColumn("badge", F.when(warned > 0, F.concat(warned.cast("string"), F.lit(" \u26a0"))).otherwise("\u2713"))
