"""Medication safety: interaction gates and score modifiers over a rule table of fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill import config as C


def rules(spark, table: list[tuple] = C.GATE_RULES) -> DataFrame:
    return spark.createDataFrame([(min(a, b), max(a, b), severity, note) for a, b, severity, note in table], "drug_a string, drug_b string, severity string, management string")


def findings(candidates: DataFrame, active: DataFrame, table: DataFrame) -> DataFrame:
    """(id, drug, active_drug, severity, management) of candidates (id, subject_id, drug) against the active drugs (subject_id, drug, n) of the subject.

    Candidates meet the rules first, so only drugs with a rule are joined by subject.
    """
    r = table.select(F.col("drug_a").alias("x"), F.col("drug_b").alias("y"), "severity", "management")
    both = F.broadcast(r.unionByName(r.select(F.col("y").alias("x"), F.col("x").alias("y"), "severity", "management")))
    wanted = candidates.withColumn("x", F.lower(F.trim("drug"))).join(both, "x")
    held = active.select("subject_id", F.lower(F.trim("drug")).alias("y"), F.col("drug").alias("active_drug"), "n")
    return wanted.join(held, ["subject_id", "y"]).select("id", "drug", "active_drug", "severity", "management", "n")


def worst(severity: Column) -> Column:
    """Rank of a severity for max(): HIGH 3, MEDIUM 2, LOW 1."""
    return F.when(severity == "HIGH", 3).when(severity == "MEDIUM", 2).when(severity == "LOW", 1).otherwise(0)


def gate(candidates: DataFrame, found: DataFrame, available: bool = True) -> DataFrame:
    """(id, decision, ddi_status, safety_action, n_findings) of every candidate medication."""
    if not available:
        return candidates.select("id", F.lit("pending").alias("decision"), F.lit("pending_ddi_check").alias("ddi_status"), F.lit("pending_ddi_check").alias("safety_action"), F.lit(0).cast("long").alias("n_findings"))
    top = found.groupBy("id").agg(F.max(worst(F.col("severity"))).alias("rank"), F.sum("n").alias("n_findings"))
    out = candidates.select("id").join(top, "id", "left")
    pick = lambda high, medium, low, none: F.when(F.col("rank") == 3, high).when(F.col("rank") == 2, medium).when(F.col("rank") == 1, low).otherwise(none)
    return out.select("id", pick("block", "review", "allow", "allow").alias("decision"), pick("high_blocked", "medium", "low", "clear").alias("ddi_status"), pick("block_write", "needs_review", "allow_with_note", "allow").alias("safety_action"), F.coalesce("n_findings", F.lit(0)).cast("long").alias("n_findings"))


def score_modifier(found: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, ddi_score): 1 less .40, .20 and .05 for each finding, never below 0."""
    cost = F.when(F.col("severity") == "HIGH", 40).when(F.col("severity") == "MEDIUM", 20).when(F.col("severity") == "LOW", 5).otherwise(0)
    loss = found.groupBy("id").agg(F.sum(cost * F.col("n")).alias("loss"))
    return ids.select("id").join(loss, "id", "left").select("id", F.greatest(F.lit(0.0), (100 - F.coalesce("loss", F.lit(0))) / 100.0).alias("ddi_score"))


def blocked_documents(records: DataFrame, doc: str = "doc_id") -> DataFrame:
    """records with `document_blocked`: any blocked medication stops the whole document. A partial aggregate and a join, not a window over a document."""
    stopped = records.groupBy(doc).agg(F.max(F.col("decision") == "block").alias("document_blocked"))
    return records.join(stopped, doc)


#: Decision, status of the check and message of the local gate, by the worst severity found; {} is the drug's name.
LOCAL = {
    "other": ("allow", None, "Not a medication record"), "down": ("pending", "pending_ddi_check", "Medication safety check unavailable."), "none": ("allow", "clear", "No interactions found."),
    "HIGH": ("block", "high_blocked", "High-severity interaction detected."), "MEDIUM": ("review", "medium", "Medium-severity interaction requires acknowledgment."), "LOW": ("allow", "low", "Low-severity interaction noted."),
}
#: The same of the gate behind a service.
SERVICE = {
    "other": ("allow", None, "Not a medication record"), "down": ("queue", "pending", "DDI connector unavailable. Medication write queued."), "none": ("allow", "clear", "No interactions found"),
    "HIGH": ("block", "high_blocked", "HIGH SEVERITY INTERACTION: {} interacts with existing medications. Write BLOCKED. User confirmation required."),
    "MEDIUM": ("warn", "medium", "MEDIUM severity interaction detected for {}. Proceeding with warning."), "LOW": ("allow", "low", "Low severity interaction noted for {}."),
}
#: Status of a record whose decision is put off.
QUEUED = {"queue": "pending_ddi", "review": "pending_medication_review", "pending": "pending_ddi_check"}


def _told(table: dict[str, tuple], state: Column, name: Column) -> Column:
    """(decision, ddi_status, message) of a state."""
    out = None
    for key, (decision, status, message) in table.items():
        before, _, after = message.partition("{}")
        text = F.concat(F.lit(before), name, F.lit(after)) if "{}" in message else F.lit(message)
        told = F.struct(F.lit(decision).alias("decision"), F.lit(status).cast("string").alias("ddi_status"), text.alias("message"))
        out = F.when(state == key, told) if out is None else out.when(state == key, told)
    return out


def routed(records: DataFrame, found: DataFrame, service: Column, available: Column) -> DataFrame:
    """records (id, fact_type, name, status, tier, requires_review, ...) with decision, ddi_status, ddi_message, outcome and n_findings, status, tier and review mark set.

    service: whether the gate behind a service judges a record, else the local one; available: whether that gate answers. Blocked records are
    `blocked`, those put off `queued`, quarantined under the status of their reason and marked for review; both carry the message. Others are `kept` as they are.
    """
    top = found.groupBy("id").agg(F.max(worst(F.col("severity"))).alias("__rank"), F.sum("n").alias("__n"))
    rank = F.coalesce("__rank", F.lit(0))
    state = (
        F.when(F.coalesce("fact_type", F.lit("")) != "medication", "other").when(~F.coalesce(available, F.lit(False)), "down")
        .when(rank == 3, "HIGH").when(rank == 2, "MEDIUM").when(rank == 1, "LOW").otherwise("none")
    )
    name = F.coalesce("name", F.lit(""))
    told = F.when(F.coalesce(service, F.lit(False)), _told(SERVICE, state, name)).otherwise(_told(LOCAL, state, name))
    out = records.join(top, "id", "left").withColumn("__state", state).withColumn("__told", told)
    decision = F.col("__told.decision")
    queued = decision.isin(*QUEUED)
    status = F.create_map(*[F.lit(x) for pair in QUEUED.items() for x in pair])
    stopped = (decision == "block") | queued
    checked = ~F.col("__state").isin("other", "down")
    return out.withColumns({
        "decision": decision, "ddi_status": F.col("__told.ddi_status"), "ddi_message": F.when(stopped, F.col("__told.message")),
        "outcome": F.when(decision == "block", "blocked").when(queued, "queued").otherwise("kept"), "n_findings": F.when(checked, F.coalesce("__n", F.lit(0))).otherwise(0).cast("long"),
        "status": F.when(queued, F.try_element_at(status, decision)).otherwise(F.col("status")), "tier": F.when(queued, "quarantined").otherwise(F.col("tier")),
        "requires_review": queued | F.coalesce("requires_review", F.lit(False)),
    }).drop("__rank", "__n", "__state", "__told")
