"""Registered queries of the contract, review, registry and governance operators over the clinical views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill import config as C
from factmill.operators import contract, dedup, extract, gate, promote, registry, resolve, review, safety, store, vector, writer
from factmill.operators.vectorindex import VectorIndex
from factmill.plans import views
from factmill.sources.recordstore import RecordStore
from factmill.sources.shared import materialize, scratch_folder
from factmill.sources.tables import table

AS_OF = "2002-01-01"
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _content(records: DataFrame) -> DataFrame:
    return records.withColumn("content", F.concat_ws(" ", "fact_type", "name", F.col("subject_id").cast("string")))


@query
def store_point_lookup(s: SparkSession, d: str) -> DataFrame:
    """The neurology record of the smallest id."""
    r = views.records(s, d)
    return store.point_lookup(r, r.where("specialty = 'neurology'").agg(F.min("id")).first()[0]).select("id", "fact_type", "name", "tier")


@query
def store_status_update(s: SparkSession, d: str) -> DataFrame:
    """Neurology records of an odd id are archived as of a fixed time; every other one's tier is left alone."""
    r = views.records(s, d)
    changes = r.where("specialty = 'neurology' AND id % 2 = 1").select("id", F.lit("archived").alias("status"), F.when(F.col("id") % 4 == 1, "superseded").alias("tier")).distinct()
    return store.apply_status(r, changes, F.lit(AS_OF).cast("timestamp_ntz")).select("id", "status", "tier", "first_recorded")


@query
def ledger_events(s: SparkSession, d: str) -> DataFrame:
    r = views.records(s, d).where("tier = 'active'")
    return store.ledger(r, "enrichment_write", F.struct("tier"), F.col("first_recorded")).select("event_type", "record_id", "source_type", F.get_json_object("details", "$.tier").alias("tier"))


@query
def review_queue_scan(s: SparkSession, d: str) -> DataFrame:
    return review.awaiting(promote.tiered(views.records(s, d))).select("id", "fact_type", "name")


@query
def promote_by_hand(s: SparkSession, d: str) -> DataFrame:
    """Every third record is promoted by hand: it is active and no longer awaits review."""
    r = promote.tiered(views.records(s, d))
    return promote.promote_by_hand(r, r.where("id % 3 = 0")).select("id", "tier", "status", "requires_review")


def _split(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = views.records(s, d)
    return r.where("source_type <> 'document'"), r.where("source_type = 'document'")


@query
def governance_fold(s: SparkSession, d: str) -> DataFrame:
    """Records of other sources against those of documents, which exist."""
    return resolve.governance_fold(*_split(s, d))


@query
def truth_fold_existing(s: SparkSession, d: str) -> DataFrame:
    return resolve.fold(*_split(s, d))


@query
def quality_gate_full(s: SparkSession, d: str) -> DataFrame:
    """Records of 1998 and later against the earlier ones; those of trust 4 and 5 await review."""
    text = lambda c: F.col(c).cast("string")
    r = _content(views.records(s, d)).withColumn("requires_review", F.col("trust_level") >= 4)
    r = r.withColumn("id", F.concat_ws("/", text("id"), "name", "specialty", text("trust_level"), F.col("value").cast("int").cast("string")))
    r = materialize(r.select("id", "fact_type", "specialty", "name", "content", "confidence", "first_recorded", "status", "requires_review"), "gate_records")
    new, old = r.where("first_recorded >= '1998-01-01'"), r.where("first_recorded < '1998-01-01'")
    return promote.quality_gate(new, old, F.lit(AS_OF).cast("date"))


@query
def promotion_conflicts(s: SparkSession, d: str) -> DataFrame:
    r = views.records(s, d).withColumn("structured", F.create_map(F.lit("name"), "name", F.lit("value"), F.col("value").cast("string")))
    return promote.promotion_conflicts(r.where("tier = 'hypothesis'"), r.where("tier = 'active'"))


def _found(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = views.facts(s, d)
    return materialize(dedup.conflicts(f, f), "conflicts").withColumn("reason", F.col("conflict_type")), f


def _quarantined(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    found, facts = _found(s, d)
    return review.quarantine(found, facts.select("id", "entity_type", "entity_name"), F.lit(AS_OF).cast("timestamp_ntz"))


SNAPSHOT = "id long, entity_type string, entity_name string"


@query
def conflict_lookup(s: SparkSession, d: str) -> DataFrame:
    """Conflicts of an even new fact with their decoded snapshots."""
    rows, _, _ = _quarantined(s, d)
    got = review.lookup(rows, rows.where("id % 2 = 0"), SNAPSHOT)
    return got.select("conflict_id", "severity", F.col("fact1.entity_name").alias("existing_name"), F.col("fact2.entity_name").alias("new_name"), F.col("fact1.id").alias("existing_id"), F.col("fact2.id").alias("new_id"))


@query
def conflict_quarantine_changes(s: SparkSession, d: str) -> DataFrame:
    return _quarantined(s, d)[2]


@query
def conflict_audit(s: SparkSession, d: str) -> DataFrame:
    audit = _quarantined(s, d)[1]
    return audit.select("event_type", "entity_id", F.get_json_object("details", "$.conflict_type").alias("conflict_type"), F.get_json_object("details", "$.severity").alias("severity"))


@query
def conflict_pending_count(s: SparkSession, d: str) -> DataFrame:
    return store.pending(_quarantined(s, d)[0]).agg(F.count("*").alias("n"))


@query
def conflict_merged_records(s: SparkSession, d: str) -> DataFrame:
    rows = _quarantined(s, d)[0]
    rows = review.lookup(rows, rows, SNAPSHOT)
    values = rows.select("conflict_id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("v"), F.col("id").cast("string"))).alias("merged_value"))
    out = review.merged_records(rows, values)
    return out.select("fact_type", "content", F.get("merged_from", F.lit(0)).alias("from_1"), F.get("merged_from", F.lit(1)).alias("from_2"), "trust_level", "confidence", "source_type", "tier")


@query
def enrichment_routes(s: SparkSession, d: str) -> DataFrame:
    """Every fact as a candidate: medications pass the safety gate first, and all the quality gate, which lets values below 80 pass."""
    f = views.facts(s, d)
    drugs = f.where("entity_type = 'medication'").select("id", "subject_id", F.col("entity_name").alias("drug"))
    held = drugs.groupBy("subject_id", "drug").agg(F.count("*").alias("n")).unionByName(drugs.where("id % 7 = 0").select("subject_id", F.lit("valproate").alias("drug"), F.lit(1).cast("long").alias("n")).distinct())
    new = drugs.withColumn("drug", F.when(F.col("id") % 4 == 0, "lamotrigine").otherwise(F.col("drug")))
    decided = safety.gate(new, safety.findings(new, held, safety.rules(s)))
    gate = f.select("id", (F.coalesce("value", F.lit(0.0)) < 80).alias("approved"))
    return review.enrichment_routes(f.select("id", F.col("entity_type").alias("fact_type")), decided, gate)


@query
def enrichment_batch_count(s: SparkSession, d: str) -> DataFrame:
    return enrichment_routes(s, d).where("event_type = 'enrichment_write'").groupBy(F.lit("enrichment_batch").alias("event_type")).agg(F.count("*").alias("count"))


@query
def review_queue_items(s: SparkSession, d: str) -> DataFrame:
    """Items of all three kinds: documents that validation holds back, quarantined records, and medications that safety holds back."""
    v = extract.validated(views.extractions(s, d)).select("doc_id", F.col("status").alias("validation"), F.transform("issues", lambda i: i["code"]).alias("codes"), "confidence")
    new, old = _split(s, d)
    f = views.facts(s, d)
    drugs = f.where("entity_type = 'medication'").select("id", "subject_id", F.col("entity_name").alias("drug"))
    held = drugs.groupBy("subject_id", "drug").agg(F.count("*").alias("n"))
    gated = safety.gate(drugs, safety.findings(drugs, held, safety.rules(s))).where("decision = 'review'").join(drugs, "id")
    meds = gated.select("id", F.concat(F.lit("Medication: "), "drug").alias("content"), "ddi_status", "safety_action", F.when(F.col("id") % 2 == 0, "Seen with another drug.").alias("note"))
    items = review.validation_items(v).unionByName(review.resolution_items(resolve.governance_fold(new, old), _content(new))).unionByName(review.medication_items(meds))
    return items.select("kind", "key", "validation_status", "resolution_action", F.array_join("reasons", ",").alias("reasons"), "confidence", "fact_type", "content", "safety_action")


@query
def specialty_detect(s: SparkSession, d: str) -> DataFrame:
    turns = table(s, d, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "turn", "text")
    notes = views.notes(s, d).select(F.lit("note").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text")
    return turns.unionByName(notes).select("kind", "id", "turn", registry.detect_specialty(F.col("text")).alias("s")).select("kind", "id", "turn", "s.specialty", F.round("s.confidence", 6).alias("confidence"))


@query
def stand_in_entities(s: SparkSession, d: str) -> DataFrame:
    return views.notes(s, d).select("doc_id", contract.stand_in(F.col("text")).alias("e")).select("doc_id", "e.*")


OUTPUTS = """
SELECT event_id AS doc_id, concat('{{', CASE event_id % 7 WHEN 0 THEN '' ELSE '"extractor": "spacy", ' END, '"entities": ', CASE event_id % 5 WHEN 0 THEN '"none"' ELSE '[]' END, ', "confidence": ',
  CASE event_id % 4 WHEN 0 THEN '"high"' WHEN 1 THEN '1' ELSE '0.5' END, CASE event_id % 3 WHEN 0 THEN '' ELSE ', "latency_ms": 5' END, ', "raw_text": "t", "notes": ', CASE event_id % 11 WHEN 0 THEN 'null' ELSE '["n"]' END, '}}') AS output
FROM {events}"""
ENTITIES = """
SELECT event_id AS doc_id, CASE event_id % 9 WHEN 0 THEN '"word"' WHEN 1 THEN '{{"type": "diagnosis", "text": "asthma"}}' WHEN 2 THEN '{{"type": "diagnosis", "text": " "}}' WHEN 3 THEN '{{"text": "asthma"}}'
  WHEN 4 THEN '{{"type": "planet", "text": "mars"}}' WHEN 5 THEN '{{"type": "note", "text": "n", "structured": [1]}}' WHEN 6 THEN '{{"type": 5, "text": 7}}' WHEN 7 THEN '{{"type": "note", "text": "n", "structured": null}}' ELSE '{{"type": "planet", "structured": "x"}}' END AS entity
FROM {events}"""


@query
def payload_contract(s: SparkSession, d: str) -> DataFrame:
    out = contract.checked_outputs(s.sql(OUTPUTS, events=table(s, d, "events")))
    return out.select("doc_id", F.array_join("missing", ",").alias("missing"), "wrong")


@query
def connector_defaults(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select(F.col("event_id").alias("doc_id"), F.when(F.col("event_id") % 2 == 0, "own").alias("extractor"), F.when(F.col("event_id") % 3 == 0, "actual").alias("actual_extractor"), F.when(F.col("event_id") % 5 == 0, F.array(F.lit("n"))).alias("notes"))
    return contract.with_defaults(rows, F.lit("gemini")).select("doc_id", "extractor", "actual_extractor", F.size("notes").cast("long").alias("n_notes"))


@query
def entity_faults(s: SparkSession, d: str) -> DataFrame:
    """Two entities of each document, those of the event and of the next kind; every tenth document has none."""
    e = s.sql(ENTITIES, events=table(s, d, "events"))
    lists = F.when(F.col("doc_id") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("entity"), F.lit('{"type": "note", "text": ""}')))
    return e.select("doc_id", F.array_join(F.transform(contract.entity_faults(lists), lambda x: F.concat_ws(":", x["index"].cast("string"), x["code"])), ",").alias("faults"))


@query
def outcome_audit(s: SparkSession, d: str) -> DataFrame:
    v = extract.validated(views.extractions(s, d))
    outcome = F.when(F.col("doc_id") % 7 == 0, "blocked_ddi").when(F.col("status") == "accepted", "written").otherwise("queued_for_review")
    failures = F.col("doc_id") % 3
    events = F.when(failures > 0, F.array(F.struct(F.lit("tried").alias("action"), F.lit("x").alias("reason")), F.struct(F.lit("fallback_invoked").alias("action"), F.when(F.col("doc_id") % 2 == 0, "latency_too_high").alias("reason"))))
    codes = F.transform("issues", lambda i: i["code"])
    return v.select("doc_id", contract.gate_decision(outcome, F.col("status")).alias("gate_decision"), contract.error_category(outcome, codes, failures).alias("error_category"), contract.fallback_reason(events).alias("fallback_reason"))


@query
def vector_search_filtered(s: SparkSession, d: str) -> DataFrame:
    """The stated query set against the rows of one label, as a search within a specialty."""
    v = table(s, d, "embeddings")
    got = vector.top_k(v.where("vec_id % 50 = 0"), v.where("label = 3"), 5)
    return got.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query
def response_consistency(s: SparkSession, d: str) -> DataFrame:
    """Mean similarity of the five nearest rows of each query of the stated set; .4 without any."""
    v = table(s, d, "embeddings")
    asked = v.where("vec_id % 50 = 0")
    mean = vector.top_k(asked, v.where("label <> 3"), 5).groupBy("query_id").agg(F.avg("similarity").alias("m"))
    return asked.select(F.col("vec_id").alias("query_id")).join(mean, "query_id", "left").select("query_id", F.round(F.coalesce("m", F.lit(0.4)), 6).alias("consistency"))


PLANTED = """SELECT vec_id, CAST(embedding AS ARRAY<DOUBLE>) AS embedding FROM {e} UNION ALL
SELECT vec_id + 1000001, transform(embedding, (x, i) -> CAST(x AS DOUBLE) * 2 + 0.02 * ((i * 7 + vec_id) % 5) * (vec_id % 12)) FROM {e} WHERE vec_id % 50 = 0"""


@query
def vector_near_dup_planted(s: SparkSession, d: str) -> DataFrame:
    """Near duplicates at the engine's threshold, among rows and planted copies with more and more noise."""
    v = s.sql(PLANTED, e=table(s, d, "embeddings"))
    found = vector.top_k(v.where("vec_id > 1000000"), v.where("vec_id <= 1000000"), 1)
    return vector.near_duplicate(found, C.DEFAULT.dedup_cosine).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query
def vector_index_search(s: SparkSession, d: str) -> DataFrame:
    """The stated query set against a stored index after a batch of new, changed and deleted vectors, written twice, and one that brings some back; one label is left out, as by a filter."""
    v = table(s, d, "embeddings")
    index = VectorIndex.build(v.where("vec_id % 7 <> 0"), f"{scratch_folder(s)}/index-{uuid.uuid4().hex}")
    turned = F.when(F.col("vec_id") % 11 == 3, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    for _ in range(2):
        index.write(v.where("vec_id % 7 = 0 OR vec_id % 11 = 3").withColumn("embedding", turned), v.where("vec_id % 13 = 5").select("vec_id"), 1)
    index.write(v.where("vec_id % 26 = 5"), None, 2)
    found = index.search(v.where("vec_id % 50 = 0"), 5, F.col("label") != 3)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query
def vector_text(s: SparkSession, d: str) -> DataFrame:
    r = _content(views.records(s, d)).withColumn("structured", F.map_from_arrays(F.array(F.lit("name"), F.lit("unit"), F.lit("value")), F.array(F.col("name"), F.lit(""), F.col("value").cast("int").cast("string"))))
    return r.select("id", vector.record_text(F.col("content"), F.col("structured")).alias("text"))


@query
def occurrence_counts(s: SparkSession, d: str) -> DataFrame:
    f = dedup.prepared(views.facts(s, d))
    return f.groupBy("subject_id", "type", "name", F.col("rounded").alias("value")).agg(F.count("*").alias("occurrence_count"), F.min("id").alias("first_id"))


def _gate_rows(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, existing records, near pairs): records of 1998 and later against the earlier ones.

    An entity is a name with the subject's number mod 7. Contents leave the value out over 40, are too short at a value of 1, and the type is none
    at a value of 2. Near are records of one type, subject and value in different specialties.
    """
    text = lambda c: F.col(c).cast("string")
    value, subject = F.col("value").cast("int"), F.col("subject_id")
    r = views.records(s, d).withColumn("fact_type", F.when(value == 2, "rumour").otherwise(F.col("fact_type")))
    r = r.withColumn("name", F.concat(F.col("name"), F.lit("-"), (subject % 7).cast("string")))
    long = F.concat_ws(" ", "fact_type", "name", F.lit("subject"), text("subject_id"), F.lit("level"), value.cast("string"))
    content = F.when(value == 1, "x").when(value > 40, F.concat_ws(" ", "fact_type", "name")).otherwise(long)
    r = materialize(r.withColumn("content", content).withColumn("requires_review", (F.col("trust_level") == 5) & (F.col("source_count") == 3)), "gate_records")
    known = r.select("id", "fact_type", "specialty", "subject_id", "value").where("value > 2")
    a, b = known.alias("a"), known.alias("b")
    same = F.expr("a.fact_type = b.fact_type AND a.subject_id = b.subject_id AND a.value = b.value AND a.specialty < b.specialty")
    near = a.join(b, same).select("a.id", F.col("b.id").alias("other_id"), (0.92 + F.abs(F.col("a.id") - F.col("b.id")) % 8 / 100).alias("similarity"))
    return r.where("first_recorded >= '1998-01-01'"), r.where("first_recorded < '1998-01-01'"), near


@query
def quality_gate_ordered(s: SparkSession, d: str) -> DataFrame:
    """Every candidate against what is held by then, those before it included: all decisions, with the rule of a conflict."""
    new, old, near = _gate_rows(s, d)
    out = gate.ordered_gate(new, old, F.lit(AS_OF).cast("date"), near)
    return out.select("id", "decision", "match_id", "rule", F.md5("content").alias("content_md5"), F.round("confidence", 6).alias("confidence"), "status", "tier", "requires_review", "outdated")


@query
def record_writer(s: SparkSession, d: str) -> DataFrame:
    """The tables of a record store after the records before 1998 and batches of 1998, 1999 and later, each batch written twice: records, vectors, events, review items."""
    new, old, near = _gate_rows(s, d)
    near = materialize(near, "near_pairs")
    held = RecordStore(s, f"{scratch_folder(s)}/store-{uuid.uuid4().hex}", writer.tables(old.schema), 8)
    writer.load(held, old)
    year = F.year("first_recorded") - 1997
    for batch in (1, 2, 3):
        mine = new.where(year == batch) if batch < 3 else new.where(year >= batch)
        for _ in range(2):
            writer.write_batch(held, mine, F.date_add(F.lit(AS_OF).cast("date"), batch), batch, near)
        if batch == 2:
            held.compact("records")
    none = lambda t: F.lit(None).cast(t)
    day = F.date_add(F.lit(AS_OF).cast("date"), F.col("batch").cast("int"))
    rows = held.read("records").select(F.lit("record").alias("kind"), "id", F.col("status").alias("a"), F.col("tier").alias("b"), F.md5("content").alias("c"), F.col("last_confirmed").alias("day"), F.array_contains("tags", "possibly_outdated").alias("late"))
    rows = rows.unionByName(held.read("vectors").select(F.lit("vector").alias("kind"), "id", none("string").alias("a"), none("string").alias("b"), F.md5("text").alias("c"), none("date").alias("day"), none("boolean").alias("late")))
    rows = rows.unionByName(held.read("ledger").select(F.lit("event").alias("kind"), F.col("record_id").alias("id"), F.col("event_type").alias("a"), F.col("source_type").alias("b"), F.col("rule").alias("c"), day.alias("day"), none("boolean").alias("late")))
    return rows.unionByName(held.read("queue").select(F.lit("queue").alias("kind"), "id", F.col("reason").alias("a"), none("string").alias("b"), F.md5("content").alias("c"), day.alias("day"), none("boolean").alias("late")))


@query
def conflict_text_values(s: SparkSession, d: str) -> DataFrame:
    """Conflicts of facts whose values may be words: severities of symptoms, doses of medications, and results that are a number or a word."""
    f = views.facts(s, d)
    word = (
        F.when(F.col("entity_type") == "symptom", F.element_at(F.array(F.lit("mild"), F.lit(" Severe"), F.lit("MILD "), F.lit(None)), (F.col("id") % 4 + 1).cast("int")))
        .when(F.col("entity_type") == "medication", F.element_at(F.array(F.lit("5 mg"), F.lit("10 mg"), F.lit("7")), (F.col("id") % 3 + 1).cast("int"))).when(F.col("id") % 6 == 0, "positive")
    )
    f = f.withColumn("value_text", word).withColumn("value", F.when(F.col("value_text").isNull(), F.col("value"))).withColumn("date", F.date_trunc("month", "date").cast("date"))
    return dedup.conflicts(f, f)


@query
def safety_routes(s: SparkSession, d: str) -> DataFrame:
    """Facts of all types through the local gate (even ids) and the gate behind a service (odd ids), each down for every seventh id: all decisions, queued statuses and messages."""
    f = views.facts(s, d)
    drugs = f.where("entity_type = 'medication'")
    held = drugs.groupBy("subject_id", F.col("entity_name").alias("drug")).agg(F.count("*").alias("n"))
    found = safety.findings(drugs.select("id", "subject_id", F.col("entity_name").alias("drug")), held, safety.rules(s))
    rows = f.select("id", F.col("entity_type").alias("fact_type"), F.col("entity_name").alias("name"), F.lit("active").alias("status"), F.lit("active").alias("tier"), F.lit(False).alias("requires_review"))
    return safety.routed(rows, found, F.col("id") % 2 == 1, F.col("id") % 7 != 0).drop("name")
