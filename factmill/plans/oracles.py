"""The same queries as plain SQL for an independent engine. They share constants with the package, but none of its expressions."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from factmill import config as C
from factmill.plans import gate_oracles, more_oracles, note_oracles, views

FACTS = views.FACTS.format(events="events")
RECORDS = views.RECORDS.format(lineitem="lineitem", orders="orders")
EXTRACTIONS = views.EXTRACTIONS.format(events="events")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(c: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({c}, '')), '\s+', ' ', 'g'))"


def values(rows: list[tuple], cols: str) -> str:
    cell = lambda v: q(v) if isinstance(v, str) else repr(v)
    return f"(VALUES {', '.join('(' + ', '.join(cell(v) for v in r) + ')' for r in rows)}) AS t({cols})"


ALIAS = f"aliases AS (SELECT * FROM {values(C.ALIAS_PAIRS, 'alias, canon')})"
KEYED = f"""f0 AS ({FACTS}), {ALIAS},
facts AS (SELECT f0.*, {norm('entity_name')} AS nm, coalesce(canon, '') AS cn, coalesce(canon, {norm('entity_name')}) AS ky FROM f0 LEFT JOIN aliases ON alias = {norm('entity_name')})"""
EARLIER = "n.subject_id = e.subject_id AND e.ord < n.ord"
GAP = "abs(date_diff('day', e.date, n.date))"

EXACT = f"""SELECT n.id, arg_min(e.id, e.ord) AS match_id FROM facts n JOIN facts e ON {EARLIER} AND n.entity_type = e.entity_type AND n.nm = e.nm AND round(n.value, 4) IS NOT DISTINCT FROM round(e.value, 4)
 AND ((n.date IS NULL AND e.date IS NULL) OR {GAP} <= 7) GROUP BY n.id"""
NAMES = sorted({x.lower() for x in re.findall(r"(?:THEN|ELSE) '([^']*)'", FACTS)})
ALIKE = [(a, b) for a in NAMES for b in NAMES if SequenceMatcher(None, *sorted((a, b))).ratio() >= 0.92]
ALIASED = f"""SELECT n.id, arg_min(e.id, e.ord) AS match_id FROM facts n JOIN facts e ON {EARLIER} AND n.entity_type = e.entity_type AND ((n.cn = e.cn AND n.cn <> '') OR (n.nm, e.nm) IN (SELECT (a, b) FROM {values(ALIKE, 'a, b')}))
 GROUP BY n.id"""
SERIES = f"""SELECT id, match_id, gap FROM (SELECT n.id, e.id AS match_id, {GAP} AS gap, row_number() OVER (PARTITION BY n.id ORDER BY {GAP} DESC, e.ord) AS r
 FROM facts n JOIN facts e ON {EARLIER} AND n.entity_type = e.entity_type AND n.ky = e.ky AND {GAP} > 7) WHERE r = 1"""
DRUGS = f"""SELECT id, match_id, reason, ord FROM (SELECT n.id, e.id AS match_id, reason, e.ord, row_number() OVER (PARTITION BY n.id ORDER BY e.ord) AS r FROM facts n JOIN facts e ON {EARLIER} AND n.entity_type = 'medication' AND e.entity_type = 'medication'
 JOIN {values(C.INTERACTIONS, 'da, db, reason')} ON (n.nm = da AND e.nm = db) OR (n.nm = db AND e.nm = da)) WHERE r = 1"""
TEMPORAL = f"""SELECT n.id, arg_min(e.id, e.ord) AS match_id, min(e.ord) AS ord FROM facts n JOIN facts e ON {EARLIER} AND ((n.entity_type IN ('medication','treatment','procedure','surgery') AND e.entity_type IN ('diagnosis','condition') AND n.date < e.date)
 OR (e.entity_type IN ('medication','treatment','procedure','surgery') AND n.entity_type IN ('diagnosis','condition') AND e.date < n.date)) GROUP BY n.id"""


def _has(c: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


EXCLUDES = " OR ".join(f"({_has('n.nm', a)} AND {_has('e.nm', b)}) OR ({_has('e.nm', a)} AND {_has('n.nm', b)})" for a, b in C.EXCLUSIVE)
DIFFER = "coalesce(greatest(abs(n.value), abs(e.value)) > 0 AND abs(n.value - e.value) / greatest(abs(n.value), abs(e.value), 1e-9) > 0.02, false)"
ODD = " OR ".join(f"(e.ky = {q(k)} AND {GAP} < {days} AND abs(n.value - e.value) > {delta})" for k, days, delta in C.IMPLAUSIBLE)
PAIRED = f"""SELECT * FROM (SELECT n.id, e.id AS match_id, e.ord, n.entity_type AS ty, CASE WHEN {EXCLUDES} THEN 1 WHEN n.ky = e.ky AND {GAP} <= 1 AND {DIFFER} THEN 2 WHEN n.ky = e.ky AND ({ODD}) THEN 3 END AS kind
 FROM facts n JOIN facts e ON {EARLIER} AND n.entity_type = e.entity_type) WHERE kind IS NOT NULL"""
CONFLICTS = f"""SELECT id, match_id, CASE stage WHEN 1 THEN 'drug_interaction' WHEN 2 THEN 'temporal' ELSE CASE kind WHEN 1 THEN 'type_mismatch' WHEN 2 THEN 'value_mismatch' ELSE 'implausible_change' END END AS conflict_type,
 CASE WHEN stage = 1 THEN 'critical' WHEN stage = 2 THEN 'medium' WHEN kind <> 2 THEN 'high' WHEN ty = 'medication' THEN 'critical' WHEN ty = 'test_result' THEN 'high' ELSE 'medium' END AS severity
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stage, ord, kind, match_id) AS r FROM (
 SELECT id, match_id, 1 AS stage, ord, 0 AS kind, '' AS ty FROM ({DRUGS}) UNION ALL SELECT id, match_id, 2, ord, 0, '' FROM ({TEMPORAL}) UNION ALL SELECT id, match_id, 3, ord, kind, ty FROM ({PAIRED}))) WHERE r = 1"""


def facts_query(body: str) -> str:
    return f"WITH {KEYED} {body}"


# regular expressions of this engine have ASCII word borders; letters are spelled out where it matters
WORD = r"[\p{L}\p{M}\p{N}\p{Pc}]+"


def _tokens(pattern: str) -> str:
    return f"len(list_filter(regexp_extract_all(text, '{WORD}'), lambda t: regexp_full_match(t, '{pattern}') AND t NOT IN ({', '.join(map(q, C.NOT_CONFUSED))})))"


CONFUSED = " + ".join(_tokens(p.replace(r"\b", "")) for p in C.CONFUSED)
HITS = " || ".join(f"list_slice(regexp_extract_all(text, {q(p)}), 1, 2)" for p, _ in C.PII)
REDACTED = "text"
for _p, _m in C.PII:
    REDACTED = f"regexp_replace({REDACTED}, {q(_p)}, {q(_m)}, 'g')"
SPECIAL = r"len(regexp_extract_all(text, '[^\p{L}\p{M}\p{N}\p{Pc}\s\-.,:;/()%°µ]')) / greatest(length(text), 1)"
ARTIFACTS = r"(regexp_matches(text, '\x{FFFD}|[|]{3,}|_{4,}|\b[lI]{8,}\b') OR length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) / greatest(length(text), 1) > 0.18)"


def _rule(keywords: tuple[str, ...]) -> str:
    return " + ".join(f"CAST({f'regexp_matches(lower(text), {q(k[1:-1])})' if k.startswith('/') else f'contains(lower(text), {q(k)})'} AS INT)" for k in keywords)


RULED = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS o, {q(kind)} AS document_type, {trust} AS trust_level, {q(tier)} AS tier, {_rule(words)} AS hits, {least} AS least, ({' OR '.join(f'contains(lower(source), {q(h)})' for h in hints)}) AS hinted FROM documents"
    for i, (kind, trust, tier, least, words, hints) in enumerate(C.DOCUMENT_RULES)
)
CLASSIFIED = f"""SELECT d.doc_id, coalesce(b.document_type, 'generic') AS document_type, CAST(coalesce(b.trust_level, 4) AS INT) AS trust_level, coalesce(b.tier, 'hypothesis') AS tier,
 CAST(CASE WHEN b.hits IS NULL THEN 0.4 ELSE least(1.0, 0.5 + 0.1 * b.hits) END AS DOUBLE) AS confidence, CAST(coalesce(b.hits, 0) AS BIGINT) AS hits
FROM documents d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, o) AS r FROM ({RULED}) WHERE hits >= least OR hinted) b ON b.doc_id = d.doc_id AND b.r = 1"""

PAIRS = f"""p AS (SELECT *, abs(date_diff('day', old_first_recorded, first_recorded)) AS apart FROM (SELECT *, lag(id) OVER w AS old_id, lag(trust_level) OVER w AS ot, lag(source_count) OVER w AS oc, lag(value) OVER w AS ov, lag(first_recorded) OVER w AS old_first_recorded
 FROM ({RECORDS}) WINDOW w AS (PARTITION BY fact_type, name, subject_id ORDER BY id, first_recorded, value, trust_level, source_count, confidence)) WHERE old_id IS NOT NULL)"""


def _chain(rules: list[tuple[str, str, float, str]]) -> str:
    case = lambda i: "CASE " + " ".join(f"WHEN {r[0]} THEN {q(r[i]) if isinstance(r[i], str) else f'CAST({r[i]} AS DOUBLE)'}" for r in rules) + " END"
    return f"WITH {PAIRS} SELECT id, old_id, {case(1)} AS action, {case(2)} AS confidence, {case(3)} AS rule FROM p"


KNOWLEDGE = _chain([
    ("ot = 1 AND trust_level > 1", "keep_existing", 0.95, "clinical_supremacy"), ("trust_level = 1 AND ot > 1", "replace_with_new", 0.95, "clinical_supremacy"),
    ("ot = 2 AND trust_level = 3", "keep_existing", 0.9, "peer_review_beats_ai"), ("trust_level = 2 AND ot = 3", "replace_with_new", 0.9, "peer_review_beats_ai"),
    ("trust_level = ot AND apart > 90 AND first_recorded > old_first_recorded", "replace_with_new", 0.8, "recency_same_trust"), ("trust_level = ot AND apart > 90", "keep_existing", 0.8, "recency_same_trust"),
    ("source_count > oc AND source_count >= 2", "replace_with_new", 0.75, "source_agreement"), ("fact_type = 'test_result'", "merge", 0.7, "value_range_merge"),
    ("fact_type = 'medication'", "quarantine", 0.0, "medication_dose_conflict"), ("true", "quarantine", 0.0, "unresolvable"),
])
GOVERNANCE = _chain([
    ("trust_level = ot AND source_count = oc AND apart <= 90 AND value = ov", "merge", 0.95, "materially_identical_records_merge"),
    ("ot = 1 AND trust_level > 1", "keep_existing", 0.95, "trust_level_1_beats_lower_trust"), ("trust_level = 1 AND ot > 1", "replace_with_new", 0.95, "trust_level_1_beats_lower_trust"),
    ("ot = 2 AND trust_level >= 3", "keep_existing", 0.9, "peer_review_beats_ai"), ("trust_level = 2 AND ot >= 3", "replace_with_new", 0.9, "peer_review_beats_ai"),
    ("trust_level = ot AND apart > 90 AND first_recorded > old_first_recorded", "replace_with_new", 0.8, "same_trust_newer_than_90_days"), ("trust_level = ot AND apart > 90", "keep_existing", 0.8, "same_trust_newer_than_90_days"),
    ("source_count >= 2 AND oc <= 1 AND trust_level <= ot", "replace_with_new", 0.78, "multi_source_replaces_weaker_single_source"), ("apart <= 90", "merge", 0.72, "numeric_same_period_merge"),
    ("fact_type = 'medication' AND value <> ov", "quarantine", 0.0, "medication_dose_conflict"), ("true", "quarantine", 0.0, "unresolved_conflict_quarantines_candidate"),
])

CONSENSUS = f"""x AS ({EXTRACTIONS}), s AS (SELECT doc_id, count(*) AS n_sources, round(avg(confidence), 3) AS avg_confidence, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM (SELECT doc_id, extractor, max(confidence) AS confidence, max(latency_ms) AS latency_ms FROM x GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT doc_id, count(*) AS n_entities, sum(k - 1) AS support, min(k) AS lo FROM (SELECT doc_id, entity_type, entity_text, count(DISTINCT extractor) AS k FROM x GROUP BY 1, 2, 3) GROUP BY 1),
a AS (SELECT *, CASE WHEN n_sources = 1 THEN 1.0 ELSE round(support / ((n_sources - 1) * n_entities), 3) END AS agreement_score FROM s JOIN e USING (doc_id)),
c AS (SELECT doc_id, n_sources, n_entities, latency_ms, avg_confidence, agreement_score, CASE WHEN n_sources = 1 THEN avg_confidence ELSE round(avg_confidence * agreement_score, 3) END AS confidence, lo < n_sources AS disagreement_flag FROM a),
i AS (SELECT *, list_filter([CASE WHEN agreement_score < 0.25 THEN 'agreement_below_reject_threshold' WHEN agreement_score < 0.6 THEN 'agreement_below_accept_threshold' END, CASE WHEN disagreement_flag THEN 'consensus_disagreement_flag' END,
 CASE WHEN confidence < 0.5 THEN 'confidence_below_reject_threshold' WHEN confidence < 0.7 THEN 'confidence_below_accept_threshold' END], lambda z: z IS NOT NULL) AS codes FROM c),
v AS (SELECT *, CASE WHEN agreement_score < 0.25 OR confidence < 0.5 THEN 'rejected' WHEN len(codes) > 0 THEN 'needs_review' ELSE 'accepted' END AS status FROM i)"""
PROFILE = f"""t AS (SELECT extractor AS connector, max(latency_ms) < 200 AS ok, max(latency_ms) AS l, max(confidence) AS c FROM ({EXTRACTIONS}) GROUP BY doc_id, extractor),
pr AS (SELECT b.connector, b.o, count(t.connector) AS attempts, coalesce(round(avg(CASE WHEN ok THEN CAST(l AS DOUBLE) END), 3), b.l0) AS avg_latency_ms, coalesce(round(avg(CASE WHEN ok THEN c END), 3), b.c0) AS avg_confidence, b.cost AS cost_estimate,
 coalesce(round(count(*) FILTER (ok) / nullif(count(t.connector), 0), 3), b.s0) AS success_rate FROM {values([(n, i, C.CONNECTOR_COST[n], *C.CONNECTOR_PRIOR[n]) for i, n in enumerate(C.CONNECTORS)], 'connector, o, cost, l0, c0, s0').replace(' AS t(', ' AS b(')} LEFT JOIN t ON t.connector = b.connector GROUP BY b.connector, b.o, b.cost, b.l0, b.c0, b.s0)"""
ROUTES = f"""{PROFILE}, d AS (SELECT doc_id, length(text) AS n, length(text) < 3000 AND NOT {ARTIFACTS} AS clean FROM documents),
r0 AS (SELECT doc_id, n, connector, CASE WHEN clean THEN o ELSE 2 - o END AS place, CAST(avg_latency_ms AS DOUBLE) AS lat, CAST(success_rate AS DOUBLE) AS suc, CAST(cost_estimate AS DOUBLE) AS cost, CAST(avg_confidence AS DOUBLE) AS conf0 FROM d, pr),
r1 AS (SELECT *, greatest(0, least(1, conf0 + CASE WHEN connector = 'spacy' AND place <> 0 THEN -0.18::DOUBLE WHEN connector = 'phi3' AND place = 0 THEN 0.04::DOUBLE WHEN connector = 'gemini' AND place = 0 THEN 0.03::DOUBLE ELSE 0::DOUBLE END)) AS conf FROM r0),
r AS (SELECT doc_id, connector, place, round(conf * 0.4::DOUBLE + least(suc, 1) * 0.25::DOUBLE + greatest(0, 1 - lat / 360) * 0.15::DOUBLE + greatest(0, 1 - cost / 0.03::DOUBLE) * 0.15::DOUBLE + CASE WHEN place = 0 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN connector = 'gemini' AND n >= 3000 THEN 0.05::DOUBLE ELSE 0 END, 3) AS score,
 conf >= 0.78 AND lat <= 180 AND suc >= 0.75 AS eligible, cost FROM r1)"""
HELD = f"""f AS ({FACTS}), m AS (SELECT id, subject_id, lower(entity_name) AS drug FROM f WHERE entity_type = 'medication'),
r AS (SELECT * FROM {values([(a, b, s) for a, b, s, _ in C.GATE_RULES], 'a, b, severity')}), both_ways AS (SELECT a, b, severity FROM r UNION ALL SELECT b, a, severity FROM r)"""
QUERY_WORDS = lambda rows, default: "CASE " + " ".join(f"WHEN {_has('lower(text)', w)} THEN {q(n)}" for n, w in rows) + f" ELSE {q(default)} END"
TASK = QUERY_WORDS(C.TASK_WORDS, "general_query")
SPECIALTY = QUERY_WORDS(C.SPECIALTY_WORDS, "general")
COHERENCE = f"""CASE WHEN coalesce(length(text), 0) = 0 THEN 0.0 WHEN {_has('lower(text)', ('however, this is not', 'on the other hand, it is', 'this contradicts', 'inconsistent with itself'))} THEN 0.4
 ELSE least(1.0, 0.65 + CASE WHEN {_has('lower(text)', ('because', 'therefore', 'due to', 'given that'))} THEN 0.15 ELSE 0 END + CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) > 6)) > 10 THEN 0.10 ELSE 0 END - CASE WHEN length(text) < 50 THEN 0.20 ELSE 0 END) END"""
CITATION = f"CASE WHEN regexp_matches(text, 'https?://') THEN 0.8 WHEN {_has('lower(text)', ('pubmed', 'cochrane', 'nejm', 'jama', 'guidelines', 'according to'))} THEN 0.65 ELSE 0.2 END"
SCORED = f"sc AS (SELECT conv_id, turn, CAST({COHERENCE} AS DOUBLE) AS coherence, CAST({CITATION} AS DOUBLE) AS citation FROM conversations), rs AS (SELECT *, round(greatest(0, least(1, 0.5::DOUBLE * 0.35::DOUBLE + coherence * 0.25::DOUBLE + citation * 0.2::DOUBLE + 0.2::DOUBLE)), 3) AS score FROM sc)"
GOVERNED = f"""SELECT conv_id, turn, round(k * 0.35::DOUBLE + h * 0.25::DOUBLE + c * 0.2::DOUBLE + 0.9::DOUBLE * 0.2::DOUBLE, 3) AS final_score, round(k, 3) AS mkb_consistency, round(h, 3) AS internal_coherence FROM (SELECT conv_id, turn, CAST(least(1, 0.4 + (turn % 3) / 3) AS DOUBLE) AS k, CASE WHEN turn % 2 = 0 THEN 1::DOUBLE ELSE 0.2::DOUBLE END AS c,
 CAST(CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(0, least(1, 0.6 + CASE WHEN {_has('lower(text)', ('because', 'therefore', 'given'))} THEN 0.2 ELSE 0 END + CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) > 12 THEN 0.1 ELSE 0 END - CASE WHEN contains(lower(text), 'contradict') THEN 0.4 ELSE 0 END)) END AS DOUBLE) AS h FROM conversations)"""
HYP = "(source_type IN ('ai_response', 'web') OR trust_level >= 3 OR extraction_method IN ('gemini', 'claude', 'phi3'))"
TIERED = f"SELECT *, CASE WHEN {HYP} THEN 'hypothesis' ELSE tier END AS t2, CASE WHEN {HYP} THEN 'hypothesis' ELSE status END AS s2, CASE WHEN {HYP} THEN greatest(trust_level, 3) ELSE trust_level END AS l2, {HYP} AS review FROM ({RECORDS})"
DERIVED = f"""r AS ({RECORDS}), c AS (SELECT id, subject_id, CASE fact_type WHEN 'diagnosis' THEN 'recommendation' ELSE 'note' END AS fact_type, CASE fact_type WHEN 'diagnosis' THEN 'review management plan for ' || name WHEN 'test_result' THEN 'trend ' || name ELSE 'reconcile medication ' || name END AS label,
 CASE fact_type WHEN 'diagnosis' THEN 'Hypothesis recommendation: ' ELSE 'Hypothesis relation: ' END AS lead, round(confidence * CASE fact_type WHEN 'diagnosis' THEN 0.7::DOUBLE WHEN 'test_result' THEN 0.65::DOUBLE ELSE 0.6::DOUBLE END, 3) AS confidence FROM r WHERE fact_type IN ('diagnosis', 'test_result', 'medication')),
k AS (SELECT subject_id, fact_type, lower(trim(label)) AS key, lead || label AS content, id, confidence, row_number() OVER (PARTITION BY subject_id, fact_type, lower(trim(label)) ORDER BY id, lead || label, confidence) AS r FROM c)"""
COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
NEAREST = f"SELECT a.vec_id AS query_id, b.vec_id, {COSINE} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0"
CONFLICT_ROWS = f"c0 AS ({CONFLICTS}), cf AS (SELECT sha256(concat_ws('/', CAST(c0.id AS VARCHAR), CAST(match_id AS VARCHAR), conflict_type)) AS conflict_id, c0.id, match_id, severity, ts AS created_at FROM c0 JOIN events ON event_id = c0.id)"
RESOLVED = " UNION ALL ".join(
    f"SELECT conflict_id, {who} AS id, {q(st)} AS status, {q(ti)} AS tier FROM cf WHERE id % 6 = {i}"
    for i, (old, new) in enumerate([(("active", "active"), ("rejected", "superseded")), (("rejected", "superseded"), ("active", "active")), (("active", "active"),) * 2, (("rejected", "superseded"),) * 2, (("merged", "superseded"),) * 2])
    for who, (st, ti) in (("match_id", old), ("id", new))
)

ORACLES: dict[str, str] = {
    "pii_redaction_summary": f"SELECT lang, count(*) AS n_docs, count(*) FILTER (h > 0) AS n_docs_with_pii, CAST(sum(h) AS BIGINT) AS n_hits FROM (SELECT lang, len({HITS}) AS h FROM documents) GROUP BY lang",
    "pii_redact_text": f"SELECT doc_id, md5({REDACTED}) AS redacted_md5 FROM documents",
    "pii_verify_clean": f"SELECT doc_id, len({HITS}) = 0 AS clean, array_to_string({HITS}, '|') AS found FROM documents",
    "ocr_special_ratio": f"SELECT doc_id, round(r, 6) AS ratio, r > 0.10 AS failed, round(CASE WHEN r > 0.10 THEN least(1.0, (r - 0.10::DOUBLE) / 0.10::DOUBLE) ELSE 0.0 END, 6) AS severity FROM (SELECT doc_id, {SPECIAL} AS r FROM documents)",
    "ocr_long_tokens": r"SELECT doc_id, CAST(n AS BIGINT) AS n, round(least(1.0, n / 3.0::DOUBLE), 6) AS severity FROM (SELECT doc_id, len(list_filter(regexp_extract_all(text, '\S{21,}'), lambda t: NOT regexp_matches(t, '^https?://') AND NOT regexp_full_match(t, '[A-Fa-f0-9]{20,}'))) AS n FROM documents)",
    "ocr_number_letter": f"SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(CASE WHEN n > 0 THEN round(least(1.0, 0.5 + 0.2 * n), 6) ELSE 0 END AS DOUBLE) AS severity FROM (SELECT doc_id, least({CONFUSED}, {C.OCR_CAP}) AS n FROM documents)",
    "ocr_artifact_gate": f"SELECT doc_id, {ARTIFACTS} AS artifacts FROM documents",
    "doc_classify": CLASSIFIED,
    "doc_tier_histogram": f"SELECT document_type, tier, count(*) AS n FROM ({CLASSIFIED}) GROUP BY 1, 2",
    "doc_type_detect": f"SELECT doc_id, CASE WHEN w >= 2 OR c >= 2 OR (w >= 1 AND n >= 20) THEN 'food_guide' ELSE 'clinical_report' END AS kind FROM (SELECT doc_id, {_rule(C.FOOD_WORDS)} AS w, {_rule(C.FOOD_CONDITIONS)} AS c, len(regexp_extract_all(text, '\\b[0-9]\\b')) AS n FROM documents)",
    "web_domain_trust": "SELECT page_id, url, CAST(CASE " + " ".join(f"WHEN contains(h, {q(dom)}) THEN {level}" for dom, level in C.DOMAINS) + " ELSE 5 END AS INT) AS trust_level FROM (SELECT *, ltrim(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1), 'w.') AS h FROM pages)",
    "unit_normalize": f"WITH f AS ({FACTS}), u AS (SELECT * FROM {values(C.UNITS, 'e, fu, cu, k, a')}), g AS (SELECT e, min(cu) AS target FROM u GROUP BY e) SELECT id, round(coalesce(value * CAST(k AS DOUBLE) + CAST(a AS DOUBLE), value), 4) AS normalized_value, coalesce(cu, target, unit, '') AS normalized_unit FROM f LEFT JOIN u ON u.e = lower(trim(entity_name)) AND fu = lower(trim(coalesce(unit, ''))) LEFT JOIN g ON g.e = lower(trim(entity_name)) WHERE value IS NOT NULL",
    "dedup_exact": facts_query(EXACT),
    "dedup_alias": facts_query(ALIASED),
    "dedup_timeseries": facts_query(SERIES),
    "dedup_decision": facts_query(f"""SELECT n.id, CASE WHEN x.id IS NOT NULL THEN 'exact' WHEN c.id IS NOT NULL THEN 'conflict' WHEN s.id IS NOT NULL THEN 'timeseries' WHEN a.id IS NOT NULL THEN 'semantic' ELSE 'none' END AS strategy,
 CASE WHEN x.id IS NOT NULL THEN 'merge' WHEN c.id IS NOT NULL THEN 'quarantine' WHEN s.id IS NOT NULL THEN 'append_timeline' WHEN a.id IS NOT NULL THEN 'merge' ELSE 'insert' END AS action,
 CASE WHEN x.id IS NOT NULL THEN x.match_id WHEN c.id IS NOT NULL THEN c.match_id WHEN s.id IS NOT NULL THEN s.match_id ELSE a.match_id END AS match_id
 FROM facts n LEFT JOIN ({EXACT}) x ON x.id = n.id LEFT JOIN ({CONFLICTS}) c ON c.id = n.id LEFT JOIN ({SERIES}) s ON s.id = n.id LEFT JOIN ({ALIASED}) a ON a.id = n.id"""),
    "conflict_drug": facts_query(f"SELECT id, match_id, reason FROM ({DRUGS})"),
    "conflict_temporal": facts_query(f"SELECT id, match_id FROM ({TEMPORAL})"),
    "conflict_detect": facts_query(CONFLICTS),
    "conflict_type_mismatch": facts_query(f"SELECT id, arg_min(match_id, ord) AS match_id, count(*) AS n FROM ({PAIRED}) WHERE kind = 1 GROUP BY id"),
    "conflict_value_mismatch": facts_query(f"SELECT id, arg_min(match_id, ord) AS match_id, count(*) AS n FROM ({PAIRED}) WHERE kind = 2 GROUP BY id"),
    "conflict_implausible": facts_query(f"SELECT id, arg_min(match_id, ord) AS match_id, count(*) AS n FROM ({PAIRED}) WHERE kind = 3 GROUP BY id"),
    "conflict_pending_ordered": f"WITH {KEYED}, {CONFLICT_ROWS} SELECT * FROM cf ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, created_at DESC, conflict_id",
    "conflict_resolve": f"WITH {KEYED}, {CONFLICT_ROWS} {RESOLVED}",
    "truth_rules_pairwise": KNOWLEDGE,
    "governance_rules_pairwise": GOVERNANCE,
    "range_merge": f"SELECT fact_type, name, subject_id, min(value) AS range_min, max(value) AS range_max, count(*) AS n FROM ({RECORDS}) GROUP BY 1, 2, 3",
    "quality_gate_static": f"SELECT CASE WHEN confidence < 0.35 THEN 'confidence_below_threshold' WHEN length(fact_type || ' ' || name) < 5 THEN 'content_too_short' ELSE 'approved' END AS gate, date_diff('day', CAST(first_recorded AS DATE), DATE '2002-01-01') > 1825 AS outdated, count(*) AS n FROM ({RECORDS}) GROUP BY 1, 2",
    "content_duplicates": f"WITH r AS (SELECT id, fact_type, specialty, lower(name || ' ' || CAST(subject_id AS VARCHAR)) AS c, status FROM ({RECORDS})) SELECT a.id, min(b.id) AS duplicate_of FROM r a JOIN r b ON a.fact_type = b.fact_type AND a.specialty = b.specialty AND a.c = b.c AND b.status = 'active' AND a.id <> b.id GROUP BY a.id",
    "same_entity_overlap": r"WITH w AS (SELECT p_partkey AS id, p_size AS s, list_distinct(regexp_split_to_array(lower(trim(concat_ws(' ', p_name, p_brand, p_type))), '\s+')) AS w FROM part) SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)), 6) AS overlap FROM w a JOIN w b ON a.s = b.s AND a.id < b.id WHERE len(a.w) > 2 AND len(b.w) > 2 AND len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)) > 0.7",
    "consensus_merge": f"WITH {CONSENSUS} SELECT * FROM c",
    "validation_issues": f"WITH {CONSENSUS} SELECT doc_id, array_to_string(codes, ',') AS codes, status FROM v",
    "confidence_bands": f"WITH {CONSENSUS} SELECT CASE WHEN confidence < 0.5 THEN 'reject' WHEN confidence < 0.7 THEN 'review' ELSE 'auto_accept' END AS band, count(*) AS n FROM c GROUP BY 1",
    "execution_metrics": f"""WITH {CONSENSUS} SELECT count(*) AS total_jobs, count(*) FILTER (n_sources = 1) AS spacy_count, count(*) FILTER (n_sources <> 1) AS gemini_count, count(*) FILTER (n_sources = 2) AS fallback_count, CAST(sum(3 - n_sources) AS BIGINT) AS failure_count, round(avg(confidence), 3) AS avg_confidence,
 round(avg(CASE WHEN status = 'accepted' THEN 0.0 ELSE 1.0 END), 3) AS review_rate, count(*) FILTER (status = 'accepted') AS accepted_count, count(*) FILTER (status = 'needs_review') AS review_count, count(*) FILTER (status = 'rejected') AS rejected_count, CAST(sum(len(codes)) AS BIGINT) AS validation_error_count,
 coalesce(round(avg(confidence) FILTER (status = 'accepted'), 3), 0) AS avg_confidence_accepted, coalesce(round(avg(confidence) FILTER (status = 'needs_review'), 3), 0) AS avg_confidence_needs_review, coalesce(round(avg(confidence) FILTER (status = 'rejected'), 3), 0) AS avg_confidence_rejected FROM v""",
    "pipeline_metrics": f"WITH {CONSENSUS} SELECT CAST(sum(n_entities) AS BIGINT) AS total_records, CAST(coalesce(sum(n_entities) FILTER (status = 'accepted'), 0) AS BIGINT) AS accepted_count, CAST(coalesce(sum(n_entities) FILTER (status = 'needs_review'), 0) AS BIGINT) AS review_count, CAST(coalesce(sum(n_entities) FILTER (status = 'rejected'), 0) AS BIGINT) AS rejected_count, round(sum(confidence * n_entities) / sum(n_entities), 3) AS avg_confidence, round(avg(agreement_score), 3) AS avg_agreement FROM v",
    "connector_profile": f"WITH {PROFILE} SELECT connector, attempts, CAST(avg_latency_ms AS DOUBLE) AS avg_latency_ms, CAST(avg_confidence AS DOUBLE) AS avg_confidence, CAST(cost_estimate AS DOUBLE) AS cost_estimate, CAST(success_rate AS DOUBLE) AS success_rate FROM pr",
    "route_scores": f"WITH {ROUTES} SELECT doc_id, connector, place, score, eligible FROM r",
    "route_choice": f"WITH {ROUTES} SELECT doc_id, connector, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY eligible DESC, CASE WHEN eligible THEN cost ELSE 0 END, score DESC, place) AS k FROM r) WHERE k = 1",
    "route_fallback": f"""WITH {ROUTES}, x AS (SELECT doc_id, extractor AS connector, max(confidence) AS confidence, max(latency_ms) AS latency_ms FROM ({EXTRACTIONS}) GROUP BY 1, 2),
 g AS (SELECT r.*, first_value(connector) OVER (PARTITION BY doc_id ORDER BY eligible DESC, CASE WHEN eligible THEN cost ELSE 0 END, score DESC, place) AS intended FROM r),
 b AS (SELECT g.doc_id, g.connector, intended, row_number() OVER (PARTITION BY g.doc_id ORDER BY g.connector <> intended, g.score DESC, CASE g.connector WHEN 'spacy' THEN 1 WHEN 'phi3' THEN 2 ELSE 3 END) AS k,
  x.confidence IS NULL OR ((x.confidence < 0.78 OR x.latency_ms > 180 OR pr.success_rate < 0.75) AND NOT (g.connector = 'spacy' AND intended = 'spacy' AND x.confidence < 0.78)) AS bad FROM g LEFT JOIN x ON x.doc_id = g.doc_id AND x.connector = g.connector LEFT JOIN pr ON pr.connector = g.connector)
 SELECT doc_id, intended, coalesce(arg_min(connector, k) FILTER (NOT bad), arg_max(connector, k)) AS actual, coalesce(min(k) FILTER (NOT bad) - 1, 3) AS failure_count FROM b GROUP BY 1, 2""",
    "timeline_points": f"SELECT DISTINCT entity_type, lower(entity_name) AS canonical_name, subject_id AS subject, value, date, id AS source_fact_id FROM ({FACTS}) WHERE value IS NOT NULL AND date IS NOT NULL",
    "ddi_gate": f"""WITH {HELD}, g AS (SELECT m.id, max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS rk, count(*) AS n FROM m JOIN both_ways w ON w.a = m.drug JOIN m h ON h.subject_id = m.subject_id AND h.drug = w.b GROUP BY m.id)
 SELECT m.id, CASE rk WHEN 3 THEN 'block' WHEN 2 THEN 'review' ELSE 'allow' END AS decision, CASE rk WHEN 3 THEN 'high_blocked' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'clear' END AS ddi_status, CASE rk WHEN 3 THEN 'block_write' WHEN 2 THEN 'needs_review' WHEN 1 THEN 'allow_with_note' ELSE 'allow' END AS safety_action, coalesce(n, 0) AS n_findings FROM m LEFT JOIN g ON g.id = m.id""",
    "ddi_score_modifier": f"WITH {HELD}, h AS (SELECT DISTINCT subject_id, drug FROM m), g AS (SELECT m.id, sum(CASE severity WHEN 'HIGH' THEN 40 WHEN 'MEDIUM' THEN 20 ELSE 5 END) AS loss FROM m JOIN both_ways w ON w.a = m.drug JOIN h ON h.subject_id = m.subject_id AND h.drug = w.b GROUP BY m.id) SELECT m.id, CAST(greatest(0, (100 - coalesce(loss, 0)) / 100) AS DOUBLE) AS ddi_score FROM m LEFT JOIN g ON g.id = m.id",
    "hypothesis_tiering": f"SELECT t2 AS tier, s2 AS status, l2 AS trust_level, review AS requires_review, count(*) AS n FROM ({TIERED}) GROUP BY 1, 2, 3, 4",
    "active_context": f"SELECT id, fact_type, name FROM ({TIERED}) WHERE t2 = 'active' AND s2 = 'active'",
    "enrichment_derive": f"WITH {DERIVED} SELECT k.subject_id, k.fact_type, k.key, k.content, k.id AS derived_from, k.confidence FROM k WHERE k.r = 1 AND NOT EXISTS (SELECT 1 FROM r WHERE r.subject_id = k.subject_id AND r.fact_type = k.fact_type AND lower(trim(r.name)) = k.key)",
    "promotion": f"""WITH r AS ({RECORDS}), e AS (SELECT subject_id, fact_type, name, count(*) AS n, bool_or(source_type = 'document') AS ex FROM r WHERE tier = 'active' GROUP BY 1, 2, 3), h AS (SELECT r.*, coalesce(n, 0) + source_count AS total, source_type = 'web' AND coalesce(ex, false) AS conf FROM r LEFT JOIN e USING (subject_id, fact_type, name) WHERE tier = 'hypothesis')
 SELECT id, total AS source_count, total >= 2 OR conf AS promoted, conf AS confirmed, CAST(CASE WHEN NOT (total >= 2 OR conf) THEN trust_level WHEN total >= 2 THEN 2 ELSE least(trust_level, 3) END AS INT) AS trust_level, CASE WHEN total >= 2 OR conf THEN 'active' ELSE 'hypothesis' END AS tier FROM h""",
    "store_counts": f"SELECT count(*) AS total, count(*) FILTER (tier = 'active') AS active, count(*) FILTER (tier = 'hypothesis') AS hypothesis, count(*) FILTER (tier = 'quarantined') AS quarantined FROM ({RECORDS})",
    "store_active_meds": f"SELECT id, name, subject_id FROM ({RECORDS}) WHERE fact_type = 'medication' AND status = 'active' AND tier = 'active'",
    "store_active_diagnoses": f"SELECT id, name, subject_id FROM ({RECORDS}) WHERE fact_type = 'diagnosis' AND status = 'active' AND tier = 'active'",
    "store_by_specialty": f"SELECT id, fact_type, name FROM ({RECORDS}) WHERE specialty = 'neurology' AND status = 'active' AND tier = 'active'",
    "store_recent_conflicts": f"SELECT id, fact_type, name FROM ({RECORDS}) WHERE status = 'conflicted' AND CAST(first_recorded AS DATE) >= DATE '1995-06-17' - INTERVAL 90 DAY",
    "explorer_topk": f"SELECT id, fact_type, name, first_recorded FROM ({RECORDS}) ORDER BY first_recorded DESC, id LIMIT 50",
    "store_upsert": f"""WITH f AS (SELECT CAST(subject_id AS VARCHAR) || '/' || entity_type AS id, entity_name, value, ord FROM ({FACTS})),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord % 2 DESC, ord DESC) AS r FROM f) SELECT id, entity_name, value FROM r WHERE r = 1""",
    "migrate_backfill": f"SELECT id, fact_type AS entity_type, name AS entity_name, value AS normalized_value, CAST(1.0 AS DOUBLE) AS temporal_confidence, trust_level, round(confidence, 6) AS confidence, tier, status FROM ({RECORDS})",
    "facts_unified": f"SELECT fact_type AS entity_type, source_type, count(*) AS n, count(DISTINCT id) AS ids FROM ({RECORDS}) GROUP BY 1, 2",
    "vector_topk": f"SELECT query_id, vec_id, round(s, 6) AS similarity, r AS rank FROM ({NEAREST}) WHERE r <= 10",
    "vector_near_dup": f"SELECT query_id, vec_id, round(s, 6) AS similarity FROM ({NEAREST.replace('WHERE', 'WHERE a.vec_id <> b.vec_id AND')}) WHERE r = 1 AND s >= 0.40",
    "query_classify": f"SELECT conv_id, turn, specialty, task_type, CAST(CASE WHEN specialty <> 'general' THEN 0.7 ELSE 0.55 END AS DOUBLE) AS confidence, task_type = 'medication_check' OR ix AS requires_ddi FROM (SELECT conv_id, turn, {SPECIALTY} AS specialty, {TASK} AS task_type, {_has('lower(text)', C.INTERACTION_WORDS)} AS ix FROM conversations)",
    "response_score": f"WITH {SCORED} SELECT conv_id, turn, round(coherence, 6) AS coherence, citation, score, score < 0.3 AS discarded FROM rs",
    "response_consensus": f"WITH {SCORED} SELECT conv_id, count(*) FILTER (score >= 0.3) AS n, CAST(CASE count(*) FILTER (score >= 0.3) WHEN 0 THEN 0 WHEN 1 THEN round(avg(score) FILTER (score >= 0.3) * 0.75::DOUBLE, 3) ELSE round(least(1, avg(score) FILTER (score >= 0.3) + 0.1::DOUBLE), 3) END AS DOUBLE) AS consensus FROM rs GROUP BY conv_id",
    "governance_score": GOVERNED,
    "audit_perf_stats": "SELECT tier, n, average, CASE WHEN n >= 5 THEN round(v[greatest(1, CAST(round_even(0.95 * n, 0) AS INT))], 3) END AS p95 FROM (SELECT event_type AS tier, count(value) AS n, round(avg(value), 3) AS average, list(value ORDER BY value) AS v FROM events GROUP BY 1)",
    "record_projection": f"WITH f AS ({FACTS}), k AS (SELECT * FROM {values([('diagnosis', 'document', 'diagnosis', 'Diagnosis: ', 0.8, 1, 'active'), ('medication', 'document', 'medication', 'Medication: ', 0.8, 1, 'active'), ('test_result', 'document', 'test_result', 'Test: ', 0.8, 1, 'active'), ('symptom', 'document', 'note', '', 0.64, 1, 'active'), ('diagnosis', 'web', 'diagnosis', 'Web source: ', 0.6, 4, 'hypothesis'), ('measurement', 'web', 'recommendation', 'Web recommendation: ', 0.56, 4, 'hypothesis'), ('diagnosis', 'ai_response', 'diagnosis', 'AI-suggested diagnosis: ', 0.72, 3, 'hypothesis'), ('medication', 'ai_response', 'medication', 'AI-suggested medication: ', 0.68, 3, 'hypothesis'), ('measurement', 'ai_response', 'recommendation', 'AI recommendation: ', 0.64, 3, 'hypothesis')], 'et, source_type, fact_type, lead, confidence, trust_level, tier')}) SELECT source_type, fact_type, tier, trust_level, CAST(confidence AS DOUBLE) AS confidence, lead || entity_name AS content, count(*) AS n FROM f JOIN k ON et = entity_type GROUP BY 1, 2, 3, 4, 5, 6",
    "answer_pipeline": f"""WITH {SCORED}, q AS (SELECT conv_id AS id, arg_min(text, turn) AS text, min(turn) AS asked FROM conversations GROUP BY 1),
 a AS (SELECT conv_id AS id, count(*) FILTER (score >= 0.3) AS n, avg(score) FILTER (score >= 0.3) AS m FROM rs JOIN q ON q.id = conv_id AND turn > asked GROUP BY 1), b AS (SELECT id, n, CAST(CASE n WHEN 0 THEN 0 WHEN 1 THEN round(m * 0.75::DOUBLE, 3) ELSE round(least(1, m + 0.1::DOUBLE), 3) END AS DOUBLE) AS consensus FROM a)
 SELECT q.id, {SPECIALTY} AS specialty, {TASK} AS task_type, {TASK} = 'medication_check' OR {_has('lower(text)', C.INTERACTION_WORDS)} AS requires_ddi, coalesce(n, 0) AS n_accepted, coalesce(consensus, 0) AS consensus, CASE WHEN coalesce(consensus, 0) >= 0.75 THEN 'high' WHEN coalesce(consensus, 0) >= 0.5 THEN 'acceptable' WHEN coalesce(consensus, 0) >= 0.3 THEN 'low' ELSE 'discarded' END AS band, coalesce(n, 0) = 0 OR coalesce(consensus, 0) < 0.4 AS refused FROM q LEFT JOIN b ON b.id = q.id""",
    "stream_connector_profile": "SELECT CASE event_id % 3 WHEN 0 THEN 'spacy' WHEN 1 THEN 'phi3' ELSE 'gemini' END AS connector, count(*) AS attempts, count(*) FILTER (event_id % 7 <> 0) AS successes FROM events GROUP BY 1",
    "stream_windowed_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
ORACLES |= note_oracles.ORACLES
ORACLES |= more_oracles.oracles(KEYED, CONFLICTS, CONSENSUS, COSINE)
ORACLES |= gate_oracles.ORACLES
WORDED = f"""wf0 AS (SELECT * REPLACE (CAST(date_trunc('month', date) AS DATE) AS date), CASE entity_type WHEN 'symptom' THEN ['mild', ' Severe', 'MILD ', NULL][id % 4 + 1] WHEN 'medication' THEN ['5 mg', '10 mg', '7'][id % 3 + 1] ELSE CASE WHEN id % 6 = 0 THEN 'positive' END END AS said FROM ({FACTS})),
f0 AS (SELECT * REPLACE (CASE WHEN said IS NULL THEN value ELSE try_cast(said AS DOUBLE) END AS value), CASE WHEN try_cast(said AS DOUBLE) IS NULL THEN trim(lower(said)) END AS said_text FROM wf0)"""
#: As DIFFER, and two texts that are not the same, or a text and a number.
DIFFER_TEXT = f"({DIFFER} OR (n.said_text IS NOT NULL AND e.said_text IS NOT NULL AND n.said_text <> e.said_text) OR (n.said_text IS NOT NULL AND e.value IS NOT NULL) OR (n.value IS NOT NULL AND e.said_text IS NOT NULL))"
ORACLES["conflict_text_values"] = f"WITH {KEYED.replace(f'f0 AS ({FACTS})', WORDED)} {CONFLICTS.replace(DIFFER, DIFFER_TEXT)}"
ORACLES["safety_routes"] = f"""WITH {HELD}, k AS (SELECT m.id, max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS rk, count(*) AS n FROM m JOIN both_ways w ON w.a = m.drug JOIN m h ON h.subject_id = m.subject_id AND h.drug = w.b GROUP BY m.id),
x AS (SELECT f.id, entity_type AS fact_type, entity_name AS name, id % 2 = 1 AS far, entity_type = 'medication' AS med, id % 7 = 0 AS down, coalesce(rk, 0) AS rk, coalesce(n, 0) AS n FROM f LEFT JOIN k USING (id)),
y AS (SELECT *, CASE WHEN NOT med THEN 'allow' WHEN down THEN CASE WHEN far THEN 'queue' ELSE 'pending' END WHEN rk = 3 THEN 'block' WHEN rk = 2 THEN CASE WHEN far THEN 'warn' ELSE 'review' END ELSE 'allow' END AS decision FROM x)
SELECT id, fact_type, decision, CASE WHEN NOT med THEN NULL WHEN down THEN CASE WHEN far THEN 'pending' ELSE 'pending_ddi_check' END ELSE ['clear', 'low', 'medium', 'high_blocked'][rk + 1] END AS ddi_status,
 CASE decision WHEN 'queue' THEN 'DDI connector unavailable. Medication write queued.' WHEN 'pending' THEN 'Medication safety check unavailable.' WHEN 'review' THEN 'Medium-severity interaction requires acknowledgment.'
  WHEN 'block' THEN CASE WHEN far THEN 'HIGH SEVERITY INTERACTION: ' || name || ' interacts with existing medications. Write BLOCKED. User confirmation required.' ELSE 'High-severity interaction detected.' END END AS ddi_message,
 CASE WHEN decision = 'block' THEN 'blocked' WHEN decision IN ('queue', 'pending', 'review') THEN 'queued' ELSE 'kept' END AS outcome, CAST(CASE WHEN med AND NOT down THEN n ELSE 0 END AS BIGINT) AS n_findings,
 CASE decision WHEN 'queue' THEN 'pending_ddi' WHEN 'pending' THEN 'pending_ddi_check' WHEN 'review' THEN 'pending_medication_review' ELSE 'active' END AS status,
 CASE WHEN decision IN ('queue', 'pending', 'review') THEN 'quarantined' ELSE 'active' END AS tier, decision IN ('queue', 'pending', 'review') AS requires_review FROM y"""
