"""Registered queries over the general tables and the clinical views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill import config as C
from factmill.functions import annotate as A
from factmill.functions import text as T
from factmill.operators import dedup, extract, promote, records, resolve, safety, score, store, vector
from factmill.plans import flows, more_queries, views
from factmill.sources import sinks
from factmill.sources.shared import dealt, materialize
from factmill.sources.tables import table, web_pages
from factmill.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF = "2002-01-01"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


# personal data


@query
def pii_redaction_summary(s: SparkSession, d: str) -> DataFrame:
    hits = F.size(T.pii_hits(F.col("text")))
    return _docs(s, d).select("lang", hits.alias("h")).groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if(F.col("h") > 0).cast("long").alias("n_docs_with_pii"), F.sum("h").cast("long").alias("n_hits"))


@query
def pii_redact_text(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.md5(T.redact(F.col("text"))).alias("redacted_md5"))


@query
def pii_verify_clean(s: SparkSession, d: str) -> DataFrame:
    found = T.pii_hits(F.col("text"))
    return _docs(s, d).select("doc_id", (F.size(found) == 0).alias("clean"), F.array_join(found, "|").alias("found"))


# quality of scanned text


@query
def ocr_special_ratio(s: SparkSession, d: str) -> DataFrame:
    r = T.special_ratio(F.col("text"))
    return _docs(s, d).select("doc_id", F.round(r, 6).alias("ratio"), (r > 0.10).alias("failed"), F.round(F.when(r > 0.10, F.least(F.lit(1.0), (r - 0.10) / 0.10)).otherwise(0.0), 6).alias("severity"))


@query
def ocr_long_tokens(s: SparkSession, d: str) -> DataFrame:
    n = F.size(T.long_tokens(F.col("text")))
    return _docs(s, d).select("doc_id", n.cast("long").alias("n"), F.round(F.least(F.lit(1.0), n / 3.0), 6).alias("severity"))


@query
def ocr_number_letter(s: SparkSession, d: str) -> DataFrame:
    n = F.size(T.confused_tokens(F.col("text")))
    return _docs(s, d).select("doc_id", n.cast("long").alias("n"), F.round(F.when(n > 0, F.least(F.lit(1.0), 0.5 + 0.2 * n)).otherwise(0.0), 6).alias("severity"))


@query
def ocr_line_spacing(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", T.line_faults(F.col("text")).cast("long").alias("n"))


@query
def ocr_artifact_gate(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", T.scan_artifacts(F.col("text")).alias("artifacts"))


def _misspelled(docs: DataFrame) -> DataFrame:
    """(doc_id, n): distinct tokens near a medical term. Terms are looked up once per distinct token of the corpus, among those of like letter pairs."""
    tokens = docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-zА-Яа-я]{4,}"), F.lit(0)), F.lower))).alias("t"))
    most = max(map(len, C.MEDICAL_TERMS))
    tokens = tokens.where(F.length("t") <= int(most * 1.36))  # a longer token cannot reach a ratio of .85
    near = tokens.select("t").distinct().withColumn("term", A.closest_term("t")).where("term IS NOT NULL")
    return tokens.join(near, "t").groupBy("doc_id").agg(F.least(F.count("*"), F.lit(C.OCR_CAP)).cast("long").alias("n"))


@query
def ocr_misspellings(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    n = F.coalesce("n", F.lit(0))
    return docs.select("doc_id").join(_misspelled(docs), "doc_id", "left").select("doc_id", n.cast("long").alias("n"), F.least(F.lit(1.0), n / 5.0).alias("severity"))


@query
def ocr_quality_report(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    t = F.col("text")
    w = C.OCR_WEIGHTS
    r, long_n, mixed, gaps = T.special_ratio(t), F.size(T.long_tokens(t)), F.size(T.confused_tokens(t)), T.line_faults(t)
    rows = docs.select("doc_id", r.alias("r"), long_n.alias("l"), mixed.alias("m"), gaps.alias("g"), (F.length(F.trim(t)) == 0).alias("empty")).join(_misspelled(docs), "doc_id", "left")
    loss = (
        F.when(F.col("m") > 0, F.least(F.lit(1.0), 0.5 + 0.2 * F.col("m"))).otherwise(0.0) * w["number_letter"]
        + F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / 5.0) * w["misspelling"]
        + F.when(F.col("r") > 0.10, F.least(F.lit(1.0), (F.col("r") - 0.10) / 0.10)).otherwise(0.0) * w["special"]
        + F.least(F.lit(1.0), F.col("l") / 3.0) * w["long"]
        + F.least(F.lit(1.0), F.col("g") / 3.0) * w["spacing"]
    )
    value = F.when(F.col("empty"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - loss)))
    return rows.select("doc_id", F.round(value, 6).alias("confidence"), (F.col("empty") | (loss > 0)).alias("errors_detected"))


# documents


@query
def doc_classify(s: SparkSession, d: str) -> DataFrame:
    counted = _docs(s, d).select("doc_id", "source", T.once(T.rule_hit_counts(F.col("text"))).alias("hits"))
    return counted.select("doc_id", T.once(T.choose_rule(F.col("hits"), F.col("source"))).alias("c")).select("doc_id", "c.document_type", "c.trust_level", "c.tier", F.round("c.confidence", 6).alias("confidence"), F.col("c.hits").cast("long").alias("hits"))


@query
def doc_type_detect(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", T.document_kind(F.col("text")).alias("kind"))


@query
def doc_tier_histogram(s: SparkSession, d: str) -> DataFrame:
    counted = _docs(s, d).select("source", T.once(T.rule_hit_counts(F.col("text"))).alias("hits"))
    return counted.select(T.once(T.choose_rule(F.col("hits"), F.col("source"))).alias("c")).groupBy("c.document_type", "c.tier").agg(F.count("*").alias("n"))


@query
def chunk_line_aligned(s: SparkSession, d: str) -> DataFrame:
    rows = _docs(s, d).select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk", "body"))
    return rows.select("doc_id", "chunk", F.length("body").alias("n_chars"), F.md5("body").alias("chunk_md5"))


@query
def web_main_text(s: SparkSession, d: str) -> DataFrame:
    return web_pages(table(s, d, "pages")).select("page_id", "url", "text", F.length("text").alias("n_chars"))


@query
def web_domain_trust(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", "url", T.domain_trust(F.col("url")).cast("int").alias("trust_level"))


@query
def ner_regex_entities(s: SparkSession, d: str) -> DataFrame:
    found = T.distinct_entities(T.entities(F.col("text")))
    return _docs(s, d).select("doc_id", F.explode(found).alias("e")).select("doc_id", "e.type", "e.text", "e.value", "e.unit")


@query
def ner_rules_medications(s: SparkSession, d: str) -> DataFrame:
    """Drugs with a dose in the documents and the notes; the first dose of a name stays."""
    m = lambda i: F.regexp_extract_all("text", F.lit(T.LOOSE_MEDICATION), F.lit(i))
    texts = _docs(s, d).select("doc_id", "text").unionByName(views.notes(s, d).select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    rows = texts.select("doc_id", F.posexplode(F.arrays_zip(m(1).alias("a"), m(2).alias("b"), m(3).alias("c"))).alias("pos", "z"))
    first = rows.groupBy("doc_id", F.lower("z.a").alias("name")).agg(F.min_by(F.concat("z.b", "z.c"), "pos").alias("dose"))
    return first.select("doc_id", "name", "dose")


@query
def negation_subject_certainty(s: SparkSession, d: str) -> DataFrame:
    """The notes' own entities, and all distinct words of four letters and more of the conversations."""
    notes = views.notes(s, d).select(F.lit("note").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "entity", "text")
    # notes repeat: each entity of a text is annotated once
    told = A.annotate(notes.select("entity", "text").distinct()).select(F.col("entity").alias("e"), F.col("text").alias("t"), "annotation")
    notes = notes.join(dealt(told), F.col("entity").eqNullSafe(F.col("e")) & F.col("text").eqNullSafe(F.col("t")))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)))
    # small files hold much work: turns are dealt out before their words multiply
    turns = table(s, d, "conversations").repartition(int(s.conf.get("spark.sql.shuffle.partitions")))
    turns = turns.withColumn("cued", A.may_have_cue(F.col("text")))  # once a turn: words of a turn without a cue are annotated alike
    turns = turns.select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "turn", F.explode(words).alias("entity"), "text", "cued")
    shown = ("kind", "id", "turn", "entity", "annotation.*")
    return notes.select(*shown).unionByName(A.annotate(turns, cued="cued").select(*shown))


@query
def entity_annotations(s: SparkSession, d: str) -> DataFrame:
    """Every entity that the patterns find in a note, annotated in its text."""
    found = views.notes(s, d).select("doc_id", "text", F.explode(T.distinct_entities(T.entities(F.col("text")))).alias("e"))
    return A.annotate(found.select("doc_id", "text", F.col("e.type").alias("type"), F.col("e.text").alias("entity"))).select("doc_id", "type", "entity", "annotation.*")


@query
def temporal_extract(s: SparkSession, d: str) -> DataFrame:
    """Dates of the documents as of a fixed day, and of the notes as of their own day."""
    docs = _docs(s, d).select("doc_id", "text", F.lit(AS_OF).cast("date").alias("noted"))
    texts = docs.unionByName(views.notes(s, d).select((-1 - F.col("doc_id")).alias("doc_id"), "text", "noted"))
    e = texts.select("doc_id", T.event_date(F.col("text"), F.col("noted")).alias("e"))
    return e.select("doc_id", F.col("e.date").alias("event_date"), F.col("e.confidence").alias("confidence"), F.col("e.from").alias("range_from"), F.col("e.to").alias("range_to"))


@query
def unit_normalize(s: SparkSession, d: str) -> DataFrame:
    f = dedup.normalize_units(views.facts(s, d).where("value IS NOT NULL"))
    return f.select("id", F.round("normalized_value", 4).alias("normalized_value"), "normalized_unit")


# duplicates and conflicts: every fact against the earlier ones of its subject


def _self(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        facts = views.facts(s, d)
        return f(facts, facts)

    return run


QUERIES["dedup_exact"] = _self(dedup.exact_matches)
QUERIES["dedup_alias"] = _self(dedup.alias_matches)
QUERIES["dedup_timeseries"] = _self(dedup.timeseries_matches)
QUERIES["dedup_decision"] = _self(dedup.decide)
QUERIES["conflict_drug"] = _self(lambda a, b: dedup.drug_conflicts(a, b).select("id", "match_id", "reason"))
QUERIES["conflict_temporal"] = _self(lambda a, b: dedup.temporal_conflicts(a, b).select("id", "match_id"))
QUERIES["conflict_detect"] = _self(dedup.conflicts)


def _kind(kind: int) -> Query:
    return _self(lambda a, b: dedup.paired_conflicts(a, b).where(F.col("kind") == kind).groupBy("id").agg(F.min_by("match_id", "ord").alias("match_id"), F.count("*").alias("n")))


QUERIES["conflict_type_mismatch"] = _kind(1)
QUERIES["conflict_value_mismatch"] = _kind(2)
QUERIES["conflict_implausible"] = _kind(3)


@query
def dedup_fuzzy_names(s: SparkSession, d: str) -> DataFrame:
    return dedup.alike_names(table(s, d, "part"), "p_name")


def _conflicts(s: SparkSession, d: str) -> DataFrame:
    facts = views.facts(s, d)
    found = dedup.conflicts(facts, facts).join(dealt(table(s, d, "events").select(F.col("event_id").alias("id"), "ts")), "id")
    return materialize(store.conflict_rows(found, F.col("ts")), "conflicts")


@query
def conflict_pending_ordered(s: SparkSession, d: str) -> DataFrame:
    return store.pending(_conflicts(s, d)).select("conflict_id", "id", "match_id", "severity", "created_at")


@query
def conflict_resolve(s: SparkSession, d: str) -> DataFrame:
    found = _conflicts(s, d)
    choice = F.get(F.array(*[F.lit(c) for c in (*store.CHOICES, "later")]), (F.col("id") % 6).cast("int"))
    changes, _ = store.resolve(found, found.select("conflict_id", choice.alias("choice")))
    return changes


# resolution


@query
def truth_rules_pairwise(s: SparkSession, d: str) -> DataFrame:
    return resolve.pairs(views.records(s, d, *resolve.PAIRED)).select("id", "old_id", resolve.knowledge_rules().alias("v")).select("id", "old_id", "v.*")


@query
def governance_rules_pairwise(s: SparkSession, d: str) -> DataFrame:
    return resolve.pairs(views.records(s, d, *resolve.PAIRED)).select("id", "old_id", resolve.governance_rules().alias("v")).select("id", "old_id", "v.*")


@query
def truth_fold_batch(s: SparkSession, d: str) -> DataFrame:
    return resolve.fold(views.records(s, d))


@query
def range_merge(s: SparkSession, d: str) -> DataFrame:
    return resolve.merged_range(views.records(s, d))


@query
def quality_gate_static(s: SparkSession, d: str) -> DataFrame:
    records = views.records(s, d).withColumn("content", F.concat_ws(" ", "fact_type", "name"))
    return promote.static_gate(records, F.lit(AS_OF).cast("date")).groupBy("gate", "outdated").agg(F.count("*").alias("n"))


@query
def content_duplicates(s: SparkSession, d: str) -> DataFrame:
    return promote.content_duplicates(views.records(s, d).withColumn("content", F.concat_ws(" ", "name", F.col("subject_id").cast("string"))))


@query
def same_entity_overlap(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"), F.col("p_size").alias("block"))
    return promote.overlap_of_copies(rows).withColumn("overlap", F.round("overlap", 6))


# extraction


@query
def consensus_merge(s: SparkSession, d: str) -> DataFrame:
    return extract.consensus(views.extractions(s, d))


@query
def validation_issues(s: SparkSession, d: str) -> DataFrame:
    v = extract.validated(views.extractions(s, d))
    return v.select("doc_id", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"), "status")


@query
def confidence_bands(s: SparkSession, d: str) -> DataFrame:
    return extract.consensus(views.extractions(s, d)).select(extract.band(F.col("confidence")).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


def _jobs(s: SparkSession, d: str) -> DataFrame:
    v = extract.validated(views.extractions(s, d))
    used = F.when(F.col("n_sources") == 1, "spacy").otherwise("gemini")
    return v.select("doc_id", used.alias("extractor"), "confidence", "agreement_score", "status", F.size("issues").alias("n_issues"), (F.col("n_sources") == 2).alias("fallback_used"), (3 - F.col("n_sources")).alias("failure_count"), F.col("n_entities").alias("n_records"), F.when(F.col("status") == "accepted", "written").otherwise("queued_for_review").alias("outcome"))


@query
def execution_metrics(s: SparkSession, d: str) -> DataFrame:
    return extract.execution_metrics(_jobs(s, d))


@query
def pipeline_metrics(s: SparkSession, d: str) -> DataFrame:
    return extract.pipeline_metrics(_jobs(s, d))


def _attempts(s: SparkSession, d: str) -> DataFrame:
    e = views.extractions(s, d).groupBy("doc_id", "extractor").agg(F.max("confidence").alias("confidence"), F.max("latency_ms").alias("latency_ms"))
    return e.select(F.col("extractor").alias("connector"), (F.col("latency_ms") < 200).alias("success"), F.col("latency_ms").cast("double").alias("latency_ms"), "confidence")


@query
def connector_profile(s: SparkSession, d: str) -> DataFrame:
    return extract.connector_profiles(_attempts(s, d)).drop("ord")


def _route_inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(s, d).select("doc_id", F.length("text").alias("n_chars"), T.once(T.scan_artifacts(F.col("text"))).alias("artifacts"))
    return docs, extract.connector_profiles(_attempts(s, d))


def _routes(s: SparkSession, d: str) -> DataFrame:
    return extract.route_scores(*_route_inputs(s, d))


@query
def route_scores(s: SparkSession, d: str) -> DataFrame:
    return _routes(s, d).select("doc_id", "connector", "place", "score", "eligible")


@query
def route_choice(s: SparkSession, d: str) -> DataFrame:
    return extract.chosen_routes(*_route_inputs(s, d))


@query
def route_fallback(s: SparkSession, d: str) -> DataFrame:
    profile = extract.connector_profiles(_attempts(s, d)).select("connector", "success_rate")
    results = views.extractions(s, d).groupBy("doc_id", F.col("extractor").alias("connector")).agg(F.max("confidence").alias("confidence"), F.max("latency_ms").alias("latency_ms")).join(F.broadcast(profile), "connector")
    return extract.fallback(_routes(s, d), results)


# medication safety


def _drugs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = views.facts(s, d).where("entity_type = 'medication'")
    return f.select("id", "subject_id", F.col("entity_name").alias("drug")), f.groupBy("subject_id", F.col("entity_name").alias("drug")).agg(F.count("*").alias("n"))


@query
def ddi_gate(s: SparkSession, d: str) -> DataFrame:
    new, held = _drugs(s, d)
    return safety.gate(new, safety.findings(new, held, safety.rules(s)))


@query
def ddi_score_modifier(s: SparkSession, d: str) -> DataFrame:
    new, held = _drugs(s, d)
    once = held.withColumn("n", F.lit(1))
    return safety.score_modifier(safety.findings(new, once, safety.rules(s)), new)


# hypotheses


@query
def hypothesis_tiering(s: SparkSession, d: str) -> DataFrame:
    return promote.tiered(views.records(s, d)).groupBy("tier", "status", "trust_level", "requires_review").agg(F.count("*").alias("n"))


@query
def active_context(s: SparkSession, d: str) -> DataFrame:
    return promote.active(promote.tiered(views.records(s, d))).select("id", "fact_type", "name")


@query
def enrichment_derive(s: SparkSession, d: str) -> DataFrame:
    return promote.derive(views.records(s, d))


@query
def promotion(s: SparkSession, d: str) -> DataFrame:
    r = views.records(s, d)
    weak = r.where("tier = 'hypothesis'").withColumn("source_type", F.when(F.col("source_type") == "web", "enrichment").otherwise(F.col("source_type")))
    evidence = r.where("tier = 'active'").withColumn("source_type", F.when(F.col("source_type") == "document", "extraction").otherwise(F.col("source_type")))
    return promote.promotion(weak, evidence)


# store


@query
def store_counts(s: SparkSession, d: str) -> DataFrame:
    return store.counts(views.records(s, d))


@query
def store_active_meds(s: SparkSession, d: str) -> DataFrame:
    return store.active_of_type(views.records(s, d), "medication").select("id", "name", "subject_id")


@query
def store_active_diagnoses(s: SparkSession, d: str) -> DataFrame:
    return store.active_of_type(views.records(s, d), "diagnosis").select("id", "name", "subject_id")


@query
def store_by_specialty(s: SparkSession, d: str) -> DataFrame:
    return store.by_specialty(views.records(s, d), "neurology", "active").select("id", "fact_type", "name")


@query
def store_recent_conflicts(s: SparkSession, d: str) -> DataFrame:
    return store.recent_conflicts(views.records(s, d), F.lit("1995-06-17").cast("date"), 90).select("id", "fact_type", "name")


@query
def explorer_topk(s: SparkSession, d: str) -> DataFrame:
    return store.latest(views.records(s, d), 50).select("id", "fact_type", "name", "first_recorded")


@query
def store_upsert(s: SparkSession, d: str) -> DataFrame:
    """Facts of each event type's latest state by user: a table of the facts of even ids, into which those of odd ids are inserted or replaced."""
    f = views.facts(s, d)
    keyed = f.select(F.concat_ws("/", F.col("subject_id").cast("string"), "entity_type").alias("id"), "entity_name", "value", F.col("ord").alias("seq"))
    even = F.col("seq") % 2 == 0
    base = keyed.where(even).groupBy("id").agg(F.max_by(F.struct("entity_name", "value"), "seq").alias("r")).select("id", "r.*")
    return store.upsert(base, keyed.where(~even))


@query
def migrate_backfill(s: SparkSession, d: str) -> DataFrame:
    f = store.backfill(views.records(s, d))
    return f.select("id", "entity_type", "entity_name", "normalized_value", "temporal_confidence", "trust_level", F.round("confidence", 6).alias("confidence"), "tier", "status")


@query
def facts_unified(s: SparkSession, d: str) -> DataFrame:
    r = views.records(s, d)
    facts = store.backfill(r.where("source_type = 'document'"))
    return store.facts_unified(facts, r).groupBy("entity_type", "source_type").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


# vectors


def _neighbours(s: SparkSession, d: str, k: int) -> DataFrame:
    v = table(s, d, "embeddings")
    return vector.top_k(v.where("vec_id % 50 = 0"), v, k)


@query
def vector_topk(s: SparkSession, d: str) -> DataFrame:
    """The stated query set of searches: ids divisible by 50, against all rows."""
    return _neighbours(s, d, 10).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query
def vector_near_dup(s: SparkSession, d: str) -> DataFrame:
    return vector.near_duplicate(_neighbours(s, d, 2), 0.40).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


# questions and answers


@query
def query_classify(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations")
    return c.select("conv_id", "turn", T.classify_query(F.col("text")).alias("q")).select("conv_id", "turn", "q.*")


def _scored(s: SparkSession, d: str) -> DataFrame:
    return score.response_scores(table(s, d, "conversations"))


@query
def response_score(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d).select("conv_id", "turn", F.round("coherence", 6).alias("coherence"), "citation", "score", "discarded")


@query
def response_consensus(s: SparkSession, d: str) -> DataFrame:
    return score.response_consensus(_scored(s, d), "conv_id")


@query
def governance_score(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations")
    g = score.governance_score(F.col("text"), (F.col("turn") % 3), F.lit(3), F.col("turn") % 2 == 0, F.lit(0.9))
    return c.select("conv_id", "turn", g.alias("g")).select("conv_id", "turn", "g.final_score", "g.mkb_consistency", "g.internal_coherence")


@query
def audit_perf_stats(s: SparkSession, d: str) -> DataFrame:
    return store.audit_performance(table(s, d, "events").withColumnRenamed("event_type", "tier"))


# flows


@query
def timeline_points(s: SparkSession, d: str) -> DataFrame:
    return sinks.timeline(views.facts(s, d)).drop("unit")


@query
def record_projection(s: SparkSession, d: str) -> DataFrame:
    """Records of three kinds of source from the facts' names as extractor lists, one fact a document."""
    f = views.facts(s, d)
    of = lambda t: F.when(F.col("entity_type") == t, F.array("entity_name")).otherwise(F.array().cast("array<string>"))
    lists = f.select(F.col("id").alias("doc_id"), of("diagnosis").alias("diagnoses"), of("medication").alias("medications"), of("test_result").alias("test_results"), of("symptom").alias("notes"), of("measurement").alias("recommendations"))
    lists = lists.withColumns({"confidence": F.lit(0.8), "trust_level": F.lit(4)})
    out = records.from_lists(lists, "document").unionByName(records.from_lists(lists, "web")).unionByName(records.from_lists(lists, "ai_response"))
    return out.groupBy("source_type", "fact_type", "tier", "trust_level", F.round("confidence", 4).alias("confidence"), "content").agg(F.count("*").alias("n"))


@query
def ingest_pipeline(s: SparkSession, d: str) -> DataFrame:
    """Documents and notes with extractors of three confidences, against drugs and diagnoses of the store."""
    f = views.facts(s, d)
    drugs = f.where("entity_type = 'medication'").groupBy(F.col("entity_name").alias("drug")).agg(F.count("*").alias("n")).unionByName(s.createDataFrame([("valproate", 1)], "drug string, n long"))
    known = f.where("entity_type = 'diagnosis'").select(F.col("entity_type").alias("fact_type"), F.concat(F.lit("Diagnosis:  "), "entity_name").alias("content"))
    texts = _docs(s, d).select("doc_id", "text").unionByName(views.notes(s, d).select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    confidence = F.when(F.col("doc_id") % 10 == -1, 0.6).when(F.col("doc_id") % 10 == -2, 0.3).otherwise(0.78)
    return flows.ingest(s, texts, drugs, known, confidence)


@query
def answer_pipeline(s: SparkSession, d: str) -> DataFrame:
    """The first turn of a conversation is the question, its other turns the responses."""
    c = table(s, d, "conversations").withColumnRenamed("conv_id", "id")
    first = c.groupBy("id").agg(F.min_by("text", "turn").alias("text"), F.min("turn").alias("turn"))
    others = c.join(first.select("id", F.col("turn").alias("asked")), "id").where("turn > asked").select("id", "text")
    return flows.answer(first.select("id", "text"), others)


# streams


@query
def stream_connector_profile(s: SparkSession, d: str) -> DataFrame:
    """Totals of each connector, kept by a stateful stream over the events table."""
    events = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    attempts = events.select(F.element_at(F.array(*[F.lit(c) for c in C.CONNECTORS]), (F.col("event_id") % 3 + 1).cast("int")).alias("connector"), (F.col("event_id") % 7 != 0).alias("success"), F.col("value").alias("latency_ms"), F.lit(0.5).alias("confidence"))
    out = jobs.replay(jobs.running_profiles(attempts))
    return out.groupBy("connector").agg(F.max("attempts").alias("attempts"), F.max("successes").alias("successes"))


@query
def stream_windowed_counts(s: SparkSession, d: str) -> DataFrame:
    events = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.replay(jobs.windowed_counts(events), "complete")
    return out.select(F.col("window.start").cast("date").alias("day"), "event_type", "n")


QUERIES |= more_queries.QUERIES
