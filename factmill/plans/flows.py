"""The two flows: documents to routed records, and questions to answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill import config as C
from factmill.functions import text as T
from factmill.operators import extract, promote, records, safety, score
from factmill.sources.shared import materialize


def payloads(docs: DataFrame, confidence: Column | None = None) -> DataFrame:
    """(doc_id, text, entities, confidence, extraction_method): personal data redacted, then the pattern extractor. confidence: that of the extractor
    by columns of docs, by default its prior. Texts of under 20 characters give nothing."""
    confidence = F.lit(C.CONNECTOR_PRIOR["spacy"][1]) if confidence is None else confidence
    # texts and entities are worked out once, not for each filter and column that takes them
    clean = docs.select("doc_id", T.once(T.redact(F.col("text"))).alias("text"), confidence.alias("confidence")).where(F.length(F.trim("text")) >= 20)
    found = T.distinct_entities(T.entities(F.col("text")))
    kept = lambda e: F.map_filter(F.create_map(F.lit("value"), e["value"], F.lit("unit"), e["unit"]), lambda _, v: v.isNotNull())
    entities = F.transform(found, lambda e: F.struct(e["type"].alias("type"), e["text"].alias("text"), kept(e).alias("structured")))
    return clean.select("doc_id", "text", T.once(entities).alias("entities"), "confidence", F.lit("spacy").alias("extraction_method"))


def ingest(spark: SparkSession, docs: DataFrame, active_drugs: DataFrame, existing: DataFrame | None = None, confidence: Column | None = None) -> DataFrame:
    """Records of every document with their route: review (failed validation), blocked_ddi (the whole document), queued (needs acknowledgment),
    rejected (quality gate), duplicate (its content is stored already) or written. active_drugs: (drug, n) of the store; existing: (fact_type, content) of it.

    One pass over the documents, whose records are stored for the steps that follow; one aggregate per document for the block; the rule table is of fixed size.
    """
    p = payloads(docs, confidence)
    checked = p.withColumn("issues", extract.issues(F.col("confidence"), F.lit(1.0), F.lit(False), F.size("entities")))
    checked = checked.withColumn("validation", extract.status(F.col("issues")))
    rows = promote.tiered(records.from_entities(checked, kept=("validation",))).withColumn("id", F.xxhash64("doc_id", "ord"))
    # rows are read several times below; a document's text is read once
    rows = materialize(rows.select("id", "doc_id", "ord", "fact_type", "name", "content", "tier", "status", "trust_level", "confidence", "validation"), "extracted")
    drugs = rows.where("fact_type = 'medication'").select("id", F.lit(0).alias("subject_id"), F.col("name").alias("drug"))
    found = safety.findings(drugs, active_drugs.select(F.lit(0).alias("subject_id"), "drug", "n"), safety.rules(spark))
    decided = rows.join(safety.gate(drugs, found).select("id", "decision"), "id", "left").withColumn("decision", F.coalesce("decision", F.lit("allow")))
    whole = safety.blocked_documents(decided)
    good = (F.col("confidence") >= C.DEFAULT.min_confidence) & (F.length(F.trim("content")) >= 5)
    stored = F.lit(False)
    if existing is not None:
        known = existing.select("fact_type", T.norm(F.col("content")).alias("key"), F.lit(True).alias("stored")).distinct()
        whole = whole.withColumn("key", T.norm(F.col("content"))).join(known, ["fact_type", "key"], "left")
        stored = F.coalesce("stored", F.lit(False))
    route = (
        F.when(F.col("validation") != "accepted", "review").when(F.col("document_blocked"), "blocked_ddi").when(F.col("decision") == "review", "queued")
        .when(~good, "rejected").when(stored, "duplicate").otherwise("written")
    )
    return whole.select("doc_id", "ord", "fact_type", "name", "content", "tier", "status", "trust_level", "decision", route.alias("route"))


REFUSED = "No response reached the required confidence."


def answer(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """(id, specialty, task_type, n_accepted, consensus, band, refused) of questions (id, text) by responses (id, text); a consensus under the safe level is refused."""
    kind = questions.select("id", T.classify_query(F.col("text")).alias("q")).select("id", "q.specialty", "q.task_type", "q.requires_ddi")
    scored = score.response_consensus(score.response_scores(responses), "id")
    out = kind.join(scored, "id", "left").withColumn("consensus", F.coalesce("consensus", F.lit(0.0)))
    refused = (F.coalesce("n", F.lit(0)) == 0) | (F.col("consensus") < C.DEFAULT.safe_mode)
    return out.select("id", "specialty", "task_type", "requires_ddi", F.coalesce("n", F.lit(0)).cast("long").alias("n_accepted"), "consensus", extract.response_band(F.col("consensus")).alias("band"), refused.alias("refused"))
