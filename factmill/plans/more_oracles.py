"""SQL of the queries in more_queries, for an independent engine."""

from __future__ import annotations

from factmill.operators import registry
from factmill.plans import note_oracles, views

FACTS, NOTES, RECORDS = views.FACTS.format(events="events"), note_oracles.NOTES, views.RECORDS.format(lineitem="lineitem", orders="orders")
q = note_oracles.q


def folded(batch: str, existing: str, rules: list[tuple[str, str, float, str, str]]) -> str:
    """A fold by recursion over each key's rows in order. rules: condition on the state s and the row n, action, confidence, rule, and what becomes of the state."""
    case = lambda i: "CASE " + " ".join(f"WHEN {r[0]} THEN {q(r[i]) if isinstance(r[i], str) else f'CAST({r[i]} AS DOUBLE)'}" for r in rules) + " END"
    held = lambda c, own: "CASE " + " ".join(f"WHEN {r[0]} THEN " + ("s." if (r[4] == "keep" or (r[4] == "value" and not own) or r[4] == "mark") else "n.") + c for r in rules) + " END"
    best = "CASE " + " ".join(f"WHEN {r[0]} THEN " + ("greatest(s.confidence, n.confidence)" if r[4] in ("mark", "value") else "n.confidence" if r[4] == "replace" else "s.confidence") for r in rules) + " END"
    marked = "CASE " + " ".join(f"WHEN {r[0]} THEN " + ("true" if r[4] == "mark" else "false" if r[4] == "replace" else "s.marked") for r in rules) + " END"
    return f"""WITH RECURSIVE a AS (SELECT *, 1 AS known FROM ({batch}) UNION ALL SELECT *, 0 FROM ({existing})),
n AS (SELECT *, row_number() OVER (PARTITION BY fact_type, name, subject_id ORDER BY known, id, {{order}}) AS r FROM a),
s AS (SELECT fact_type, name, subject_id, r, id AS own, id, trust_level, source_count, first_recorded, value, confidence, false AS marked, CASE WHEN known = 1 THEN 'replace_with_new' END AS action, CAST(1 AS DOUBLE) AS sure, 'no_match' AS rule, CAST(NULL AS BIGINT) AS existing_id FROM n WHERE r = 1
 UNION ALL SELECT n.fact_type, n.name, n.subject_id, n.r, CASE WHEN n.known = 0 THEN n.id ELSE s.own END, n.id,
 CASE WHEN n.known = 0 THEN n.trust_level ELSE {held('trust_level', False)} END, CASE WHEN n.known = 0 THEN n.source_count ELSE {held('source_count', False)} END, CASE WHEN n.known = 0 THEN n.first_recorded ELSE {held('first_recorded', False)} END,
 CASE WHEN n.known = 0 THEN n.value ELSE {held('value', True)} END, CASE WHEN n.known = 0 THEN n.confidence ELSE {best} END, CASE WHEN n.known = 0 THEN false ELSE {marked} END,
 CASE WHEN n.known = 1 THEN {case(1)} END, {case(2)}, {case(3)}, s.own
 FROM s JOIN n ON n.fact_type = s.fact_type AND n.name = s.name AND n.subject_id = s.subject_id AND n.r = s.r + 1)"""


APART = "abs(CAST(floor((epoch_us(n.first_recorded) - epoch_us(s.first_recorded)) / 86400000000) AS BIGINT))"
LEVEL = "n.trust_level = s.trust_level"
GOVERNANCE = [
    (f"{LEVEL} AND n.source_count = s.source_count AND {APART} <= 90 AND n.value IS NOT DISTINCT FROM s.value", "merge", 0.95, "materially_identical_records_merge", "value"),
    ("s.trust_level = 1 AND n.trust_level > 1", "keep_existing", 0.95, "trust_level_1_beats_lower_trust", "keep"),
    ("n.trust_level = 1 AND s.trust_level > 1", "replace_with_new", 0.95, "trust_level_1_beats_lower_trust", "replace"),
    ("s.trust_level = 2 AND n.trust_level >= 3", "keep_existing", 0.9, "peer_review_beats_ai", "keep"),
    ("n.trust_level = 2 AND s.trust_level >= 3", "replace_with_new", 0.9, "peer_review_beats_ai", "replace"),
    (f"{LEVEL} AND {APART} > 90 AND n.first_recorded > s.first_recorded", "replace_with_new", 0.8, "same_trust_newer_than_90_days", "replace"),
    (f"{LEVEL} AND {APART} > 90", "keep_existing", 0.8, "same_trust_newer_than_90_days", "keep"),
    ("n.source_count >= 2 AND s.source_count <= 1 AND n.trust_level <= s.trust_level", "replace_with_new", 0.78, "multi_source_replaces_weaker_single_source", "replace"),
    (f"n.value IS NOT NULL AND s.value IS NOT NULL AND {APART} <= 90", "merge", 0.72, "numeric_same_period_merge", "value"),
    ("n.fact_type = 'medication' AND n.value IS DISTINCT FROM s.value", "quarantine", 0.0, "medication_dose_conflict", "keep"),
    ("true", "quarantine", 0.0, "unresolved_conflict_quarantines_candidate", "keep"),
]
TRUTH = [
    ("NOT s.marked AND n.value IS NOT DISTINCT FROM s.value", "merge", 0.95, "", "mark"), ("round(n.confidence - s.confidence, 3) >= 0.1", "replace_with_new", 0.8, "", "replace"),
    ("round(n.confidence - s.confidence, 3) <= -0.1", "keep_existing", 0.8, "", "keep"), ("true", "quarantine", 0.0, "", "keep"),
]
_COLS = "id, fact_type, name, subject_id, trust_level, source_count, first_recorded, value, confidence"
BATCH, HELD = (f"SELECT {_COLS} FROM ({RECORDS}) WHERE source_type {op} 'document'" for op in ("<>", "="))
NONE = f"SELECT {_COLS} FROM ({RECORDS}) WHERE false"
GOVERNED = folded(BATCH, HELD, GOVERNANCE).replace("{order}", "trust_level, source_count, first_recorded, value")
TRUTHS = lambda batch, held: folded(batch, held, TRUTH).replace("{order}", "value, confidence") + " SELECT id, action, sure AS confidence, existing_id FROM s WHERE action IS NOT NULL"


def oracles(keyed: str, conflicts: str, consensus: str, cosine: str) -> dict[str, str]:
    """SQL by query, from the fragments of the first module of SQL."""
    held = f"f AS ({FACTS}), m AS (SELECT id, subject_id, lower(entity_name) AS drug FROM f WHERE entity_type = 'medication')"
    rows = f"cf AS (SELECT sha256(concat_ws('/', CAST(id AS VARCHAR), CAST(match_id AS VARCHAR), conflict_type)) AS conflict_id, * FROM ({conflicts}))"
    snap = f"WITH {keyed}, {rows}, x AS (SELECT cf.*, e.entity_name AS en, n.entity_name AS nn, e.entity_type AS et FROM cf JOIN facts e ON e.id = cf.match_id JOIN facts n ON n.id = cf.id)"
    score = lambda words: f"least(1.0::DOUBLE, len(list_filter([{', '.join(map(q, words))}], lambda k: contains(lower(text), k))) / {max(1.0, len(words) * 0.3)}::DOUBLE)"
    scores = [(name, score(words)) for name, stub, words in registry.SPECIALTIES if not stub]
    nearest = lambda a, b: f"SELECT a.vec_id AS query_id, b.vec_id, {cosine} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {cosine} DESC, b.vec_id) AS r FROM {a} a, {b} b"
    asked, three, rest = "(SELECT * FROM embeddings WHERE vec_id % 50 = 0)", "(SELECT * FROM embeddings WHERE label = 3)", "(SELECT * FROM embeddings WHERE label <> 3)"
    planted = "(SELECT vec_id + 1000001 AS vec_id, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * 2 + 0.02 * (((i - 1) * 7 + vec_id) % 5) * (vec_id % 12)) AS embedding FROM embeddings WHERE vec_id % 50 = 0)"
    indexed = """(SELECT vec_id, CASE WHEN vec_id % 26 <> 5 AND vec_id % 11 = 3 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding
FROM embeddings WHERE (vec_id % 13 <> 5 OR vec_id % 26 = 5) AND label <> 3 AND embedding IS NOT NULL)"""
    routes = f"""{held}, new AS (SELECT id, subject_id, CASE WHEN id % 4 = 0 THEN 'lamotrigine' ELSE drug END AS drug FROM m), held AS (SELECT DISTINCT subject_id, drug FROM m UNION SELECT subject_id, 'valproate' FROM m WHERE id % 7 = 0),
rules AS ({note_oracles._RULES}), w AS (SELECT new.id, max(rank) AS rank FROM new JOIN rules ON x = new.drug JOIN held ON held.subject_id = new.subject_id AND held.drug = y GROUP BY 1),
er AS (SELECT f.id, entity_type AS fact_type, CASE WHEN rank = 3 THEN 'blocked_ddi' WHEN rank = 2 THEN 'pending' WHEN coalesce(value, 0) >= 80 THEN 'rejected' ELSE 'written' END AS route FROM f LEFT JOIN w ON w.id = f.id)"""
    fault = ["0:entity_not_object", "", "0:missing_required_field", "0:missing_required_field", "0:invalid_entity_type", "0:invalid_schema_shape", "0:missing_required_field,0:missing_required_field", "", "0:invalid_entity_type,0:missing_required_field,0:invalid_schema_shape"]
    gate = f"""WITH r AS (SELECT * REPLACE (concat_ws('/', CAST(id AS VARCHAR), name, specialty, CAST(trust_level AS VARCHAR), CAST(CAST(value AS INT) AS VARCHAR)) AS id), fact_type || ' ' || name || ' ' || CAST(subject_id AS VARCHAR) AS content, trust_level >= 4 AS waits, first_recorded >= TIMESTAMP '1998-01-01' AS fresh FROM ({RECORDS})),
o AS (SELECT * FROM r WHERE NOT fresh), d AS (SELECT fact_type, specialty, content, min(id) AS id FROM o WHERE status = 'active' GROUP BY 1, 2, 3), e AS (SELECT fact_type, specialty, name, min(id) AS id FROM o WHERE status = 'active' GROUP BY 1, 2, 3),
p AS (SELECT DISTINCT fact_type, specialty, name FROM o WHERE waits)
SELECT r.id, CASE WHEN confidence < 0.35 THEN 'confidence_below_threshold' WHEN d.id IS NOT NULL THEN 'duplicate' WHEN e.id IS NOT NULL AND p.name IS NOT NULL THEN 'pending_review_exists' WHEN e.id IS NOT NULL THEN 'conflict' ELSE 'approved' END AS decision,
 CASE WHEN confidence >= 0.35 THEN coalesce(d.id, e.id) END AS match_id, date_diff('day', CAST(first_recorded AS DATE), DATE '2002-01-01') > 1825 AS outdated
FROM r LEFT JOIN d USING (fact_type, specialty, content) LEFT JOIN e USING (fact_type, specialty, name) LEFT JOIN p USING (fact_type, specialty, name) WHERE fresh"""
    review = f"""WITH {consensus}, {held}, rules AS ({note_oracles._RULES}), w AS (SELECT m.id, max(rank) AS rank FROM m JOIN rules ON x = m.drug JOIN m h ON h.subject_id = m.subject_id AND h.drug = y GROUP BY 1), go AS ({GOVERNED} SELECT id, rule FROM s WHERE action = 'quarantine')
SELECT 'validation' AS kind, CAST(doc_id AS VARCHAR) AS key, status AS validation_status, CAST(NULL AS VARCHAR) AS resolution_action, array_to_string(codes, ',') AS reasons, CAST(confidence AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS fact_type, CAST(NULL AS VARCHAR) AS content, CAST(NULL AS VARCHAR) AS safety_action FROM v WHERE status <> 'accepted'
UNION ALL SELECT 'resolution', CAST(go.id AS VARCHAR), 'accepted', 'quarantine', rule, r.confidence, r.fact_type, r.fact_type || ' ' || r.name || ' ' || CAST(r.subject_id AS VARCHAR), NULL FROM go JOIN ({RECORDS}) r ON r.id = go.id
UNION ALL SELECT 'medication', CAST(w.id AS VARCHAR), 'accepted', NULL, CASE WHEN w.id % 2 = 0 THEN 'Seen with another drug.' ELSE 'medium' END, NULL, 'medication', 'Medication: ' || f.entity_name, 'needs_review' FROM w JOIN f ON f.id = w.id WHERE rank = 2"""
    missing = "array_to_string(list_filter([CASE WHEN event_id % 7 = 0 THEN 'extractor' END, CASE WHEN event_id % 3 = 0 THEN 'latency_ms' END], lambda z: z IS NOT NULL), ',')"
    return {
        "store_point_lookup": f"SELECT id, fact_type, name, tier FROM ({RECORDS}) WHERE id = (SELECT min(id) FROM ({RECORDS}) WHERE specialty = 'neurology')",
        "store_status_update": f"SELECT id, CASE WHEN hit THEN 'archived' ELSE status END AS status, CASE WHEN hit AND id % 4 = 1 THEN 'superseded' ELSE tier END AS tier, CASE WHEN hit THEN TIMESTAMP '2002-01-01' ELSE first_recorded END AS first_recorded FROM (SELECT *, id IN (SELECT id FROM ({RECORDS}) WHERE specialty = 'neurology' AND id % 2 = 1) AS hit FROM ({RECORDS}))",
        "ledger_events": f"SELECT 'enrichment_write' AS event_type, id AS record_id, source_type, tier FROM ({RECORDS}) WHERE tier = 'active'",
        "review_queue_scan": f"SELECT id, fact_type, name FROM ({RECORDS}) WHERE source_type IN ('ai_response', 'web') OR trust_level >= 3 OR extraction_method IN ('gemini', 'claude', 'phi3')",
        "promote_by_hand": f"SELECT id, CASE WHEN id % 3 = 0 THEN 'active' WHEN h THEN 'hypothesis' ELSE tier END AS tier, CASE WHEN id % 3 = 0 THEN 'active' WHEN h THEN 'hypothesis' ELSE status END AS status, h AND id % 3 <> 0 AS requires_review FROM (SELECT *, source_type IN ('ai_response', 'web') OR trust_level >= 3 OR extraction_method IN ('gemini', 'claude', 'phi3') AS h FROM ({RECORDS}))",
        "governance_fold": GOVERNED + " SELECT id, action, sure AS confidence, rule, existing_id FROM s WHERE action IS NOT NULL",
        "truth_fold_existing": TRUTHS(BATCH, HELD),
        "truth_fold_batch": TRUTHS(f"SELECT {_COLS} FROM ({RECORDS})", NONE),
        "quality_gate_full": gate,
        "promotion_conflicts": f"WITH r AS ({RECORDS}) SELECT id FROM r WHERE tier = 'hypothesis' AND EXISTS (SELECT 1 FROM r e WHERE e.tier = 'active' AND e.subject_id = r.subject_id AND e.fact_type = r.fact_type AND e.name = r.name AND e.value IS DISTINCT FROM r.value)",
        "conflict_lookup": f"{snap} SELECT conflict_id, severity, en AS existing_name, nn AS new_name, match_id AS existing_id, id AS new_id FROM x WHERE id % 2 = 0",
        "conflict_quarantine_changes": f"WITH {keyed}, {rows} SELECT id, 'quarantined' AS status, 'quarantined' AS tier FROM (SELECT id FROM cf UNION SELECT match_id FROM cf)",
        "conflict_audit": f"WITH {keyed}, {rows} SELECT 'quarantined' AS event_type, conflict_id AS entity_id, conflict_type, severity FROM cf",
        "conflict_pending_count": f"WITH {keyed}, {rows} SELECT count(*) AS n FROM cf",
        "conflict_merged_records": f"{snap} SELECT et AS fact_type, 'Merged: ' || en || ' / ' || nn || CASE WHEN id % 2 = 0 THEN ' → v' || CAST(id AS VARCHAR) ELSE '' END AS content, match_id AS from_1, id AS from_2, 2 AS trust_level, CAST(0.85 AS DOUBLE) AS confidence, 'manual' AS source_type, 'active' AS tier FROM x",
        "enrichment_routes": f"WITH {routes} SELECT id, fact_type, route, CASE route WHEN 'blocked_ddi' THEN 'ddi_block' WHEN 'written' THEN 'enrichment_write' END AS event_type FROM er",
        "enrichment_batch_count": f"WITH {routes} SELECT 'enrichment_batch' AS event_type, count(*) AS count FROM er WHERE route = 'written'",
        "review_queue_items": review,
        "specialty_detect": f"""WITH t AS (SELECT 'turn' AS kind, conv_id AS id, turn, text FROM conversations UNION ALL SELECT 'note', doc_id, 0, text FROM ({NOTES})), x AS (SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in scores)} FROM t)
SELECT kind, id, turn, CASE WHEN greatest(epilepsy, neurology) = 0 THEN 'general' WHEN epilepsy >= neurology THEN 'epilepsy' ELSE 'neurology' END AS specialty,
 round(CASE WHEN greatest(epilepsy, neurology) = 0 THEN 0.4::DOUBLE ELSE least(0.95::DOUBLE, greatest(epilepsy, neurology) + 0.3::DOUBLE) END, 6) AS confidence FROM x""",
        "stand_in_entities": rf"""SELECT doc_id, nullif(regexp_replace(dx, '^[ .;]+|[ .;]+$', '', 'g'), '') AS diagnosis, nullif(drug, '') AS medication, nullif(dose, '') AS dose, CAST(CASE WHEN dx <> '' OR drug <> '' THEN 0.68 ELSE 0.4 END AS DOUBLE) AS confidence
FROM (SELECT doc_id, regexp_extract(text, '(?i)\bdiagnosis\s*:?\s*([A-Za-z][A-Za-z ,/-]{{2,80}})', 1) AS dx, regexp_extract(text, '(?i)\b([A-Z][A-Za-z-]{{2,}})\s+(\d+(?:\.\d+)?)\s*(mg|mcg|ml|g|units?)\b', 1) AS drug,
 regexp_extract(text, '(?i)\b([A-Z][A-Za-z-]{{2,}})\s+(\d+(?:\.\d+)?)\s*(mg|mcg|ml|g|units?)\b', 2) || regexp_extract(text, '(?i)\b([A-Z][A-Za-z-]{{2,}})\s+(\d+(?:\.\d+)?)\s*(mg|mcg|ml|g|units?)\b', 3) AS dose FROM ({NOTES}))""",
        "payload_contract": f"SELECT event_id AS doc_id, {missing} AS missing, CASE WHEN {missing} <> '' THEN NULL WHEN event_id % 5 = 0 THEN 'entities' WHEN event_id % 4 = 0 THEN 'confidence' WHEN event_id % 11 = 0 THEN 'notes' END AS wrong FROM events",
        "connector_defaults": "SELECT event_id AS doc_id, CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'gemini' END AS extractor, CASE WHEN event_id % 3 = 0 THEN 'actual' WHEN event_id % 2 = 0 THEN 'own' ELSE 'gemini' END AS actual_extractor, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS n_notes FROM events",
        "entity_faults": f"SELECT event_id AS doc_id, CASE WHEN event_id % 10 = 0 THEN '-1:empty_extraction' ELSE concat_ws(',', nullif(CASE event_id % 9 {' '.join(f'WHEN {i} THEN {q(x)}' for i, x in enumerate(fault))} END, ''), '1:missing_required_field') END AS faults FROM events",
        "outcome_audit": f"""WITH {consensus}, o AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'blocked_ddi' WHEN status = 'accepted' THEN 'written' ELSE 'queued_for_review' END AS outcome FROM v)
SELECT doc_id, CASE WHEN outcome = 'written' THEN 'accepted' WHEN outcome = 'blocked_ddi' THEN 'blocked' WHEN status = 'needs_review' THEN 'review' WHEN status = 'rejected' THEN 'rejected' ELSE outcome END AS gate_decision,
 CASE WHEN len(codes) > 0 THEN codes[1] WHEN outcome = 'blocked_ddi' THEN 'safety_gate_block' WHEN doc_id % 3 > 0 THEN 'connector_failure' END AS error_category, CASE WHEN doc_id % 3 > 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'latency_too_high' ELSE 'fallback_invoked' END END AS fallback_reason FROM o""",
        "vector_search_filtered": f"SELECT query_id, vec_id, round(s, 6) AS similarity, r AS rank FROM ({nearest(asked, three)}) WHERE r <= 5",
        "vector_index_search": f"SELECT query_id, vec_id, round(s, 6) AS similarity, r AS rank FROM ({nearest(asked, indexed)}) WHERE r <= 5",
        "response_consistency": f"SELECT query_id, round(avg(s), 6) AS consistency FROM ({nearest(asked, rest)}) WHERE r <= 5 GROUP BY 1",
        "vector_near_dup_planted": f"SELECT query_id, vec_id, round(s, 6) AS similarity FROM ({nearest(planted, 'embeddings')}) WHERE r = 1 AND s >= 0.92",
        "vector_text": f"SELECT id, fact_type || ' ' || name || ' ' || CAST(subject_id AS VARCHAR) || ' | name: ' || name || CASE WHEN CAST(value AS INT) IS NOT NULL THEN ' | value: ' || CAST(CAST(value AS INT) AS VARCHAR) ELSE '' END AS text FROM ({RECORDS})",
        "occurrence_counts": f"SELECT subject_id, entity_type AS type, lower(entity_name) AS name, value, count(*) AS occurrence_count, min(id) AS first_id FROM ({FACTS}) GROUP BY 1, 2, 3, 4",
    }
