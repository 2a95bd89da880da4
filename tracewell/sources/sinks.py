"""Reports, JSON and provenance as text columns, and the latest-wins item cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def findings_json(findings: DataFrame, item: str = "item") -> DataFrame:
    """item, json: an item's findings by id, nulls left out."""
    body = F.struct(*[F.col(c) for c in findings.columns if c != item])
    grouped = findings.groupBy(F.col(item).alias("item")).agg(F.sort_array(F.collect_list(body)).alias("findings"))
    return grouped.select("item", F.to_json(F.struct("item", "findings"), {"ignoreNullFields": "true"}).alias("json"))


def findings_text(findings: DataFrame, item: str = "item") -> DataFrame:
    """item, report: a heading and a line for each finding, most urgent first."""
    line = F.struct((-F.col("priority")).alias("rank"), F.col("id"), F.format_string("[%s] %s (%d)", F.element_at(F.array(*map(F.lit, ("None", "Low", "Medium", "High", "Critical"))), F.col("priority") + 1), F.col("id"), F.col("observed")).alias("text"))
    grouped = findings.groupBy(F.col(item).alias("item")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return grouped.select("item", F.concat(F.lit("Findings of "), F.col("item").cast("string"), F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["text"]), "\n")).alias("report"))


def provenance_json(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """json of the named columns under the names given, nulls left out."""
    return df.select(F.to_json(F.struct(*[F.col(c).alias(n) for n, c in fields.items()]), {"ignoreNullFields": "true"}).alias("json"))


def upsert(current: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key, the latest version of both; a partial aggregation, not a window."""
    both = current.unionByName(updates)
    rest = [c for c in both.columns if c not in (key, version)]
    return both.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("r")).select(key, F.col(f"r.{version}"), *[F.col(f"r.{c}") for c in rest]).select(*both.columns)
