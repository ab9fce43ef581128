"""Review: quarantined conflicts with snapshots, queue items of three kinds, merged records, and the routing of enrichment candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.operators.store import conflict_rows
from factmill.sources.shared import dealt

SEVERITIES = ("low", "medium", "high", "critical")


def awaiting(records: DataFrame) -> DataFrame:
    return records.where("requires_review")


def quarantine(found: DataFrame, facts: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conflict rows with JSON snapshots of both facts, audit rows, change set of both facts) of (id, match_id, conflict_type, severity, reason).

    fact1 is the existing fact, fact2 the new one. A severity that is not known is an error of the whole batch.
    """
    known = F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise(F.raise_error(F.concat(F.lit("severity must be low, medium, high or critical, got "), F.coalesce("severity", F.lit("null")))))
    rows = conflict_rows(found.withColumn("severity", known), at, "reason")
    snapshot = F.to_json(F.struct(*[c for c in facts.columns]))
    side = lambda key, name: facts.select(F.col("id").alias(key), snapshot.alias(name))
    rows = rows.join(dealt(side("match_id", "fact1_snapshot")), "match_id", "left").join(dealt(side("id", "fact2_snapshot")), "id", "left")
    audit = rows.select(F.lit("quarantined").alias("event_type"), F.col("conflict_id").alias("entity_id"), F.to_json(F.struct("conflict_type", "reason", "severity")).alias("details"), F.col("created_at").alias("timestamp"))
    changes = rows.select(F.explode(F.array("id", "match_id")).alias("id")).distinct().select("id", F.lit("quarantined").alias("status"), F.lit("quarantined").alias("tier"))
    return rows, audit, changes


def lookup(conflicts: DataFrame, ids: DataFrame, schema: str) -> DataFrame:
    """Conflicts of the ids with their snapshots decoded into `fact1` and `fact2`; a snapshot that is no JSON object stays text, and its fact is null."""
    rows = conflicts.join(dealt(ids.select("conflict_id").distinct()), "conflict_id", "left_semi")
    return rows.withColumns({"fact1": F.from_json("fact1_snapshot", schema), "fact2": F.from_json("fact2_snapshot", schema)})


def merged_records(conflicts: DataFrame, values: DataFrame) -> DataFrame:
    """Records of conflicts that are merged, from (conflict_id, fact1, fact2 with id, entity_type, entity_name) and (conflict_id, merged_value)."""
    name = lambda f: F.coalesce(F.col(f"{f}.entity_name"), F.lit(""))
    content = F.concat(F.lit("Merged: "), name("fact1"), F.lit(" / "), name("fact2"))
    content = F.when(F.col("merged_value").isNotNull(), F.concat(content, F.lit(" → "), F.col("merged_value"))).otherwise(content)
    return conflicts.join(dealt(values), "conflict_id").select(
        F.sha2(F.concat(F.lit("merged/"), "conflict_id"), 256).alias("id"), F.coalesce("fact1.entity_type", "fact2.entity_type", F.lit("note")).alias("fact_type"), content.alias("content"),
        F.array("fact1.id", "fact2.id").alias("merged_from"), "merged_value", F.lit("manual").alias("source_type"), F.lit("conflict_resolution").alias("source_name"), F.lit(2).alias("trust_level"), F.lit(0.85).alias("confidence"),
        F.lit("active").alias("status"), F.lit("active").alias("tier"),
    )


QUEUE = ("kind", "key", "validation_status", "resolution_action", "reasons", "confidence", "fact_type", "content", "safety_action")


def _item(rows: DataFrame, kind: str, **columns: Column) -> DataFrame:
    kinds = {"reasons": "array<string>", "confidence": "double"}
    return rows.select(F.lit(kind).alias("kind"), *[columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in QUEUE[1:]])


def validation_items(documents: DataFrame) -> DataFrame:
    """Queue items of documents (doc_id, validation, codes, confidence) that validation did not accept."""
    return _item(documents.where("validation <> 'accepted'"), "validation", key=F.col("doc_id"), validation_status=F.col("validation"), reasons=F.col("codes"), confidence=F.col("confidence"))


def resolution_items(decisions: DataFrame, records: DataFrame) -> DataFrame:
    """Queue items of decisions (id, action, confidence, rule) that quarantine a record."""
    held = decisions.where("action = 'quarantine'").select("id", "action", "rule").join(records.select("id", "fact_type", "content", "confidence"), "id")
    return _item(held, "resolution", key=F.col("id"), validation_status=F.lit("accepted"), resolution_action=F.col("action"), reasons=F.array("rule"), confidence=F.col("confidence"), fact_type=F.col("fact_type"), content=F.col("content"))


def medication_items(medications: DataFrame) -> DataFrame:
    """Queue items of medications (id, content, ddi_status, safety_action, note) that safety holds back: its note, or its status where there is none."""
    reason = F.coalesce(F.nullif("note", F.lit("")), F.nullif("ddi_status", F.lit("")), F.lit("medication_review"))
    return _item(medications, "medication", key=F.col("id"), validation_status=F.lit("accepted"), reasons=F.array(reason), fact_type=F.lit("medication"), content=F.col("content"), safety_action=F.col("safety_action"))


def enrichment_routes(candidates: DataFrame, decisions: DataFrame, gate: DataFrame) -> DataFrame:
    """candidates (id, fact_type) with `route`: blocked_ddi, pending (the safety gate queues it), rejected (by the quality gate) or written; and the ledger event of each."""
    d = decisions.select("id", F.col("decision").alias("safety"))
    g = gate.select("id", F.col("approved"))
    out = candidates.join(d, "id", "left").join(g, "id", "left")
    drug = F.col("fact_type") == "medication"
    route = F.when(drug & (F.col("safety") == "block"), "blocked_ddi").when(drug & F.col("safety").isin("review", "pending"), "pending").when(~F.coalesce("approved", F.lit(False)), "rejected").otherwise("written")
    event = F.when(F.col("route") == "blocked_ddi", "ddi_block").when(F.col("route") == "written", "enrichment_write")
    return out.withColumn("route", route).withColumn("event_type", event).select(*candidates.columns, "route", "event_type")
