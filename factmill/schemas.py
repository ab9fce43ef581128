"""Table schemas as DDL. Times are local to UTC and without zone; the open slot of a record is a map of strings."""

RECORDS = """id string, fact_type string, content string, structured map<string,string>, specialty string, source_type string, source_name string, source_url string, trust_level int,
confidence double, source_count int, status string, tier string, ddi_checked boolean, ddi_status string, ddi_findings array<struct<drug_a: string, drug_b: string, severity: string, management: string>>,
safety_action string, extraction_method string, resolution_id string, resolution_action string, resolution_confidence double, enrichment_confidence double, requires_review boolean,
first_recorded timestamp_ntz, last_confirmed timestamp_ntz, linked_to array<string>, chunk_ids array<string>, tags array<string>, session_id string,
promotion_history array<struct<timestamp: string, from_tier: string, to_tier: string, reasons: array<string>>>"""

FACTS = """id string, fact_type string, entity_type string, entity_name string, canonical_name string, value string, unit string, normalized_value double, normalized_unit string, date date,
date_range_start date, date_range_end date, temporal_confidence double, is_negated boolean, negation_type string, subject string, certainty string, ocr_confidence double, ocr_errors_detected boolean,
trust_level int, confidence double, tier string, status string, occurrence_count int, first_recorded timestamp_ntz, last_confirmed timestamp_ntz, specialty string, source_type string, source_name string,
source_url string, source_document_id string, extraction_method string, raw_text string, parent_fact_id string, superseded_by string, requires_review boolean, conflict_id string, session_id string, metadata map<string,string>"""

TIMELINE = "entity_type string, canonical_name string, subject string, value double, unit string, raw_value string, date date, source_fact_id string, confidence double, created_at timestamp_ntz"
CONFLICTS = """id string, fact1_id string, fact2_id string, fact1_snapshot string, fact2_snapshot string, conflict_type string, severity string, reason string, status string, resolution string,
resolution_notes string, created_at timestamp_ntz, resolved_at timestamp_ntz, session_id string"""
FAMILY_HISTORY = "fact_id string, relation string, condition string, age_at_onset int, age_at_death int, notes string, created_at timestamp_ntz"
PROVENANCE = "fact_id string, source_type string, source_name string, source_url string, source_document_id string, page_number int, raw_text string, extracted_at timestamp_ntz, confidence double"
AUDIT = "event_type string, entity_id string, entity_kind string, actor string, details string, timestamp timestamp_ntz, session_id string"
LEDGER = "event_type string, record_id string, source_type string, details string, timestamp timestamp_ntz, session_id string"
ALIASES = "canonical string, alias string, language string, entity_type string"
PAYLOAD = "doc_id long, extractor string, actual_extractor string, entities array<struct<type: string, text: string, structured: map<string,string>>>, confidence double, latency_ms int, raw_text string, notes array<string>"

#: The keys that make rows of a table unique.
KEYS = {"records": ("id",), "facts": ("id",), "timeline": ("canonical_name", "subject", "date", "source_fact_id"), "conflicts": ("id",), "aliases": ("canonical", "alias", "language", "entity_type")}
