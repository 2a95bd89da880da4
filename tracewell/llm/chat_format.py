"""Chat formatting: logged conversations that prefix longer ones collapse, the rest is rendered.

A chat service that logs a conversation after every turn leaves cumulative snapshots. Each
conversation gets a rolling hash over its turns, one for each prefix. A conversation whose full hash
is a proper prefix's hash of another one is dropped by an anti-join; of equal conversations the one
of least id stays. DataFrame functions only.

Defined cases: turns are ordered by number, then role, then text, nulls first; a null role or text
differs from an empty one in the hash and is rendered empty; rows with a null conv_id are one
conversation; an empty table gives no rows. A conversation becomes one row and one string, so its
turns meet in one task by its nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _field(c: Column) -> Column:
    """Its length before it, so that neighbouring fields can't run into each other."""
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def prefix_hashes(turns: Column) -> Column:
    """array<string>: after each turn, the md5 of the hash before it, the role and the text."""
    start = F.array().cast("array<string>")
    return F.aggregate(turns, start, lambda done, t: F.concat(done, F.array(F.md5(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")), _field(t["role"]), _field(t["text"]))))))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n"))), "")


def format_chats(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations, itself included), chat: the maximal conversations."""
    spark_turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    logged = df.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(spark_turn)).alias("turns"))
    hashed = logged.select("conv_id", F.size("turns").alias("n"), prefix_hashes(F.col("turns")).alias("hashes"))
    full = hashed.groupBy(F.element_at("hashes", -1).alias("hash")).agg(F.min("conv_id").alias("keeper"), F.count("*").alias("n_copies"))
    longer = hashed.select(F.explode(F.slice("hashes", F.lit(1), F.col("n") - 1)).alias("hash")).distinct()
    maximal = full.join(longer, "hash", "left_anti")
    return logged.join(maximal, F.col("conv_id").eqNullSafe(F.col("keeper"))).select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", render(F.col("turns")).alias("chat"))
