"""Line dedup by a log-template tree, in DataFrame functions only.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens, to a
leaf. Tokens with a digit, an at sign or a slash become a wildcard first, which leaves the line's own template.
In a leaf of many texts, what varies at a place becomes a wildcard as well, in three ways: tokens of few
texts there, all tokens of a place that has many, and all but a token that most lines have there. A line so
belongs to up to four templates, and goes where one of them recurs. Generalised templates hold ``LEAST_FIXED`` tokens or more, and half of their tokens or more, as they are.
A template recurs if it stands in many unlike documents; its
lines are dropped, but for the first (least doc_id, then the text's hash, then the line), so that no
text leaves the corpus altogether.

Copies of a document would make all their lines recur. So documents count by family, and a template
recurs when its documents are of ``MIN_FAMILIES`` families or more. Frequent templates (those of as many
distinct texts) don't decide the family: it is the least hash among a document's other templates. Where at
least 8 of 9 lines are frequent (two such documents with the same ones are 0.8 alike or more), it is
the rarest frequent template, which near copies share.

:func:`drop_template_lines` is the earlier form, where the least hash of all templates is the family, so
that a frequent template of low hash hides others. No query uses it; its test stands.

Lines of one or two tokens are templates as well, at ``SHORT_TIMES`` as many families; where all their
tokens are fields (a page number), the line as it stands is the template.

Defined cases: a null text stays null and counts for nothing; blank lines are never templates and
stay; a text whose lines all go becomes empty and its row stays; equal rows decide alike; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

MIN_FAMILIES = 20
#: Documents with so many of their lines frequent are copies of one another.
COPY_SHARE = (8, 9)
LEADING = 3
#: Leading tokens on the way to a leaf of the tree that generalises, and tokens that its templates keep at least.
TREE_LEADING, LEAST_FIXED = 2, 3
#: Lines of fewer tokens (headings, list marks) must recur in so many times as many families; in drop_template_lines they aren't templates.
MIN_TOKENS = 3
SHORT_TIMES = 5


def template_paths(lines: Column, leading: int = LEADING) -> Column:
    """Each line's way through the tree as one hash: token count, leading tokens, leaf; null for none.

    Three passes over the array, since an expression that a lambda names twice runs twice.
    """
    spaced = F.transform(lines, lambda x: F.trim(F.when(x.rlike(r"[\x09-\x0D]|  "), F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")).otherwise(x)))
    masked = F.transform(spaced, lambda x: F.when(x.rlike(r"[0-9@/]"), F.regexp_replace(x, r"(?<![^ ])[^ 0-9@/]*+[0-9@/][^ ]*+", "<*>")).otherwise(x))

    def path(x: Column) -> Column:
        blanks = F.length(x) - F.length(F.translate(x, " ", ""))
        return F.when(F.substring_index(x, " ", MIN_TOKENS - 1) != x, F.xxhash64(blanks, F.substring_index(x, " ", leading), x))

    return F.transform(masked, lambda x: path(x))


def drop_template_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_families: int = MIN_FAMILIES, counts: bool = False) -> DataFrame:
    """df with the lines of recurring templates dropped from its text; with ``counts``, also n_lines and n_dropped.

    Shuffles one (template, document) row for each line and, to apply the verdicts, the texts once.
    """
    own = [f"__{i}" for i in range(len(df.columns))]  # names of others can't clash
    at, id_at = df.columns.index(text_col), df.columns.index(id_col)
    base = df.toDF(*own)
    text, key = F.col(own[at]), F.col(own[id_at])
    lines = F.split(text, "\n", -1)
    seen = base.select(key.alias("doc"), F.xxhash64(text).alias("body"), template_paths(lines).alias("paths")).where(F.col("paths").isNotNull())
    seen = stash(seen.withColumn("family", F.array_min("paths")), "paths")  # read twice below, at 8 bytes a line
    each = seen.select("doc", "body", "family", F.posexplode("paths").alias("line", "path")).where(F.col("path").isNotNull())
    found = each.groupBy("path").agg(F.countDistinct("family").alias("families"), F.min(F.struct("doc", "body", "line")).alias("first")).where(F.col("families") >= min_families)
    hit = each.join(found, "path").where(~F.struct("doc", "body", "line").eqNullSafe(F.col("first")))
    gone = hit.groupBy("doc", "body").agg(F.collect_set("line").alias("gone"))
    cut = base.withColumn("__body", F.xxhash64(text)).join(gone, key.eqNullSafe(F.col("doc")) & (F.col("__body") == F.col("body")), "left")
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.col("gone"), i))
    new = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    out = [new.alias(c) if i == at else F.col(own[i]).alias(c) for i, c in enumerate(df.columns)]
    if counts:
        out += [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")]
    return cut.select(*out)


def spaced(x: Column) -> Column:
    """A line without white space at its ends and with single blanks between its tokens."""
    white = F.lit(False)
    for w in ("  ", "\t", "\n", "\v", "\f", "\r"):  # cheaper than an expression over each line
        white = white | x.contains(w)
    return F.trim(F.when(white, F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")).otherwise(x))


def masked(x: Column) -> Column:
    """A spaced line with its fields as wildcards; lines of one or two fields alone are left as they are."""
    bare = x.rlike(r"^[^ 0-9@/]*[0-9@/][^ ]*( [^ 0-9@/]*[0-9@/][^ ]*)?$")
    return F.when(x.rlike(r"[0-9@/]") & ~bare, F.regexp_replace(x, r"(?<![^ ])[^ 0-9@/]*+[0-9@/][^ ]*+", "<*>")).otherwise(x)


def template(x: Column) -> Column:
    """Hash of a masked line; its last bit is set for lines of fewer than MIN_TOKENS tokens; null for blank lines."""
    short = F.substring_index(x, " ", MIN_TOKENS - 1) == x
    return F.when(x != "", F.xxhash64(x).bitwiseAND(F.lit(-2)) + short.cast("long"))


def needed(path: Column, min_families: int) -> Column:
    """How many families make a template recur."""
    return F.when(path.bitwiseAND(F.lit(1)) == 1, min_families * SHORT_TIMES).otherwise(min_families)


def leaf(x: Column) -> Column:
    """A spaced line's leaf: token count and masked leading tokens; null where the line is too short to generalise."""
    blanks = F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
    return F.when(blanks >= LEAST_FIXED, F.xxhash64(blanks, masked(F.substring_index(x, " ", TREE_LEADING))))


def generalised(base: DataFrame, seen: DataFrame, lines: Column, min_families: int) -> DataFrame:
    """(path, wider): for lines' own templates in leaves of many texts, the generalised ones.

    Only lines of such leaves are read by token, each own template once, with its number of texts.
    """
    each = seen.select("body", F.explode(F.arrays_zip("paths", "leaves")).alias("at")).select("body", F.col("at.paths").alias("path"), F.col("at.leaves").alias("leaf"))
    full = each.where(F.col("leaf").isNotNull()).groupBy("leaf").agg(F.countDistinct("body").alias("texts")).where(F.col("texts") >= min_families).select("leaf")
    text = base.select(F.transform(lines, spaced).alias("lines")).select("lines", F.transform("lines", leaf).alias("leaves"))  # arrays, so that each line is evaluated once
    text = text.select(F.explode(F.arrays_zip("lines", "leaves")).alias("at")).select(F.col("at.lines").alias("line"), F.col("at.leaves").alias("leaf"))
    text = text.join(F.broadcast(full), "leaf")  # 8 bytes for a leaf of many texts
    text = text.select("leaf", masked(F.col("line")).alias("line")).distinct().withColumn("path", template(F.col("line")))
    many = each.join(F.broadcast(full), "leaf", "left_semi").groupBy("path").agg(F.countDistinct("body").alias("texts"))
    forms = text.join(many, "path")
    forms = stash(forms.select("path", "leaf", "texts", F.transform(F.split("line", " "), lambda t: F.when(t != "<*>", F.xxhash64(t))).alias("tokens")), "forms")  # read twice below
    tokens = forms.select("path", "leaf", "texts", F.posexplode("tokens").alias("place", "token"))
    there = tokens.groupBy("leaf", "place", "token").agg(F.sum("texts").alias("n"))
    wide = there.groupBy("leaf", "place").agg(F.count("token").alias("kinds"), F.sum("n").alias("all"))
    there = there.join(wide, ["leaf", "place"]).where(F.col("token").isNotNull() & ((F.col("n") >= min_families) | (F.col("kinds") < min_families) | (F.col("n") * 2 > F.col("all"))))
    facts = there.select("leaf", "place", "token", (F.col("n") >= min_families).alias("common"), (F.col("kinds") < min_families).alias("narrow"), (F.col("n") * 2 > F.col("all")).alias("most"))
    kept = tokens.select("path", "leaf", "place", "token").join(facts, ["leaf", "place", "token"], "left")
    lead = F.col("place") < TREE_LEADING
    ways = [F.coalesce(F.when(lead | F.col(c), F.col("token")), F.lit(0)) for c in ("common", "narrow", "most")]
    rows = kept.groupBy("path", "leaf").agg(F.array_sort(F.collect_list(F.struct("place", *[w.alias(f"way{i}") for i, w in enumerate(ways)], F.coalesce("token", F.lit(0)).alias("own")))).alias("ways"))
    made = []
    for w in ("way0", "way1", "way2"):
        fixed = F.size(F.filter(F.col(f"ways.{w}"), lambda t: t != 0))
        good = (fixed >= LEAST_FIXED) & (fixed * 2 >= F.size("ways")) & (F.col(f"ways.{w}") != F.col("ways.own"))
        made.append(F.when(good, F.xxhash64("leaf", f"ways.{w}").bitwiseAND(F.lit(-2))))
    return rows.select("path", F.array_distinct(F.array_compact(F.array(*made))).alias("wider")).where(F.size("wider") > 0)


def drop_recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_families: int = MIN_FAMILIES, counts: bool = False) -> DataFrame:
    """df with the lines of recurring templates dropped from its text; with ``counts``, also n_lines and n_dropped.

    Shuffles one (template, document) row for each line, the rows of frequent templates by document and
    by template again, and, to apply the verdicts, the texts once.
    """
    own = [f"__{i}" for i in range(len(df.columns))]  # names of others can't clash
    at, id_at = df.columns.index(text_col), df.columns.index(id_col)
    base = df.toDF(*own)
    text, key = F.col(own[at]), F.col(own[id_at])
    lines = F.split(text, "\n", -1)
    me = ["doc", "body"]
    clean = base.select(key.alias("doc"), F.xxhash64(text).alias("body"), F.transform(lines, spaced).alias("lines")).where(F.col("lines").isNotNull())
    seen = clean.select(*me, F.transform(F.transform("lines", masked), template).alias("paths"), F.transform("lines", leaf).alias("leaves"))
    seen = stash(seen, "paths")  # read five times below, at 16 bytes a line
    wider = generalised(base, seen, lines, min_families)
    each = seen.select(*me, F.posexplode("paths").alias("line", "path")).where(F.col("path").isNotNull())
    all_of = F.concat(F.array("path"), F.coalesce("wider", F.array().cast("array<bigint>")))
    each = each.join(wider, "path", "left").select(*me, "line", F.explode(all_of).alias("path"))
    frequent = each.groupBy("path").agg(F.countDistinct("body").alias("n"), F.min(F.struct(*me, "line")).alias("first")).where(F.col("n") >= needed(F.col("path"), min_families))
    hits = each.join(frequent, "path").select(*me, "line", "path", "n", F.struct(*me, "line").eqNullSafe(F.col("first")).alias("stays"))
    by_doc = hits.groupBy(*me).agg(F.collect_set(F.struct("line", "path", "n", "stays")).alias("hits"))
    common, total = F.array_distinct(F.col("hits.line")), F.size(F.filter("paths", lambda p: p.isNotNull()))
    rarest = F.array_min(F.transform("hits", lambda h: F.struct(h["n"], h["path"])))["path"]
    rest = F.array_min(F.filter("paths", lambda p, i: ~F.array_contains(common, i)))
    family = F.when(F.size(common) * COPY_SHARE[1] >= total * COPY_SHARE[0], rarest).otherwise(rest)
    told = by_doc.alias("h").join(seen.alias("s"), F.col("h.doc").eqNullSafe(F.col("s.doc")) & (F.col("h.body") == F.col("s.body")))
    told = stash(told.select("h.doc", "h.body", "hits", family.alias("family")), "families")  # read twice below
    each_hit = told.select(*me, "family", F.inline("hits"))
    found = each_hit.groupBy("path").agg(F.countDistinct("family").alias("families")).where(F.col("families") >= needed(F.col("path"), min_families)).select("path")
    gone = each_hit.where(~F.col("stays")).join(found, "path").groupBy(*me).agg(F.collect_set("line").alias("gone"))
    cut = base.withColumn("__body", F.xxhash64(text)).join(gone, key.eqNullSafe(F.col("doc")) & (F.col("__body") == F.col("body")), "left")
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.col("gone"), i))
    new = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    out = [new.alias(c) if i == at else F.col(own[i]).alias(c) for i, c in enumerate(df.columns)]
    if counts:
        out += [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")]
    return cut.select(*out)
