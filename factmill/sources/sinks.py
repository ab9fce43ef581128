"""Sinks: append-only JSON lines, and a split of one table by route. Keyed tables are in recordstore.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_json(rows: DataFrame, path: str) -> None:
    """Audit, ledger, review and pending rows as JSON lines."""
    rows.write.mode("append").json(path)


def write_routes(rows: DataFrame, folder: str, route: str = "route") -> None:
    """One Parquet folder for each route; a single pass over the rows."""
    rows.write.mode("append").partitionBy(route).parquet(folder)


def timeline(facts: DataFrame) -> DataFrame:
    """Points of dated numeric facts, one for each (entity, subject, date, fact)."""
    rows = facts.where("value IS NOT NULL AND date IS NOT NULL").select("entity_type", F.lower("entity_name").alias("canonical_name"), F.col("subject_id").alias("subject"), "value", "unit", "date", F.col("id").alias("source_fact_id"))
    return rows.dropDuplicates(["canonical_name", "subject", "date", "source_fact_id"])
