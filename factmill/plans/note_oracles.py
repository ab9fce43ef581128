"""SQL of the queries over texts: entities, annotations, dates, chunks and the ingest flow, for an independent engine."""

from __future__ import annotations

from factmill import config as C
from factmill.functions import annotate as A
from factmill.functions import text as T
from factmill.plans import views


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NOTES = views.NOTES.format(events="events")
FACTS = views.FACTS.format(events="events")
TEXTS = f"SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, text FROM ({NOTES})"


def redacted(c: str) -> str:
    for pattern, mark in C.PII:
        c = f"regexp_replace({c}, {q(pattern)}, {q(mark)}, 'g')"
    return c


def entities(rows: str) -> str:
    """(doc_id, ord, type, text, value, unit) of rows (doc_id, text): the first of each type and lower-case text, numbered from 0."""
    groups = lambda p, n: ", ".join(f"regexp_extract_all(text, {q(p)}, {i}) AS g{i}" for i in range(1, n + 1))
    kinds = [(1, "medication", T.MEDICATION, 3), (2, "diagnosis", T.DIAGNOSIS, 1), (3, "test_result", T.TEST, 3)]
    parts = []
    for k, kind, pattern, n in kinds:
        text = "trim(g1[i])" if n == 3 else "regexp_replace(g1[i], '^[ .;]+|[ .;]+$', '', 'g')"
        rest = "g2[i] AS value, nullif(g3[i], '') AS unit" if n == 3 else "CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS unit"
        parts.append(f"SELECT doc_id, {k} AS k, i, {q(kind)} AS type, {text} AS text, {rest} FROM (SELECT *, unnest(range(1, len(g1) + 1)) AS i FROM (SELECT doc_id, {groups(pattern, n)} FROM ({rows})))")
    first = f"SELECT *, row_number() OVER (PARTITION BY doc_id, type, lower(text) ORDER BY k, i) AS r FROM ({' UNION ALL '.join(parts)}) WHERE text <> ''"
    return f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS ord, type, text, value, unit FROM ({first}) WHERE r = 1"


def _any(patterns: list[str]) -> str:
    return "(?:" + "|".join(patterns) + ")"


def _last(c: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({c}, {q('(?is)' + pattern)}) THEN length(regexp_extract({c}, {q('(?is)^(.*)' + pattern)}, 1)) ELSE -1 END"


def _last_kind(c: str) -> str:
    spots = {k: _last(c, _any([p for p, own in A.BEFORE if own == k])) for k in A.KINDS}
    most = f"greatest({', '.join(spots.values())})"
    return f"CASE {most} WHEN -1 THEN NULL " + " ".join(f"WHEN {at} THEN {q(k)}" for k, at in spots.items()) + " END"


def _relative(c: str) -> str:
    one = lambda i, p, k: f"CASE WHEN regexp_matches({c}, {q('(?is)' + p)}) THEN {{'gap': length({c}) - length(regexp_extract({c}, {q('(?is)^.*?' + p)})), 'place': {i}, 'kind': {q(k)}}} END"
    return f"list_sort(list_filter([{', '.join(one(i, p, k) for i, (p, k) in enumerate(A.RELATIVES))}], lambda z: z IS NOT NULL))[1]"


def annotated(rows: str, *keys: str) -> str:
    """keys and annotation of rows (keys, entity, text)."""
    k = ", ".join(keys)
    literal = lambda words: _any([w.replace("/", "\\/") for w in words])
    word = "[\\p{L}\\p{M}\\p{N}_]"
    after = " ".join(f"WHEN regexp_matches(after, {q('(?is)' + _any([p for p, own in A.AFTER if own == kind]))}) THEN {q(kind)}" for kind in ("ruled_out", "absent"))
    certain = " ".join(f"WHEN regexp_matches(target, {q('(?is)' + _any(ps))}) THEN {q(level)}" for level, ps in A.CERTAINTY)
    return f"""WITH a0 AS ({rows}),
l0 AS (SELECT *, length(entity) AS n, lower(text) AS low, lower(entity) AS sought FROM a0),
a1 AS (SELECT * EXCLUDE (low, sought), list_filter(range(1, length(low) - n + 2), lambda i: substring(low, i, n) = sought) AS p FROM l0),
a2 AS (SELECT *, list_filter(p, lambda i: NOT regexp_matches(substring(text, i - 1, CASE WHEN i > 1 THEN 1 ELSE 0 END), '{word}') AND NOT regexp_matches(substring(text, i + n, 1), '{word}')) AS w FROM a1),
a3 AS (SELECT *, list_reduce(list_transform(CASE WHEN len(w) > 0 THEN w ELSE p END, lambda i: [i]), lambda a, b: CASE WHEN b[1] >= a[len(a)] + n THEN list_concat(a, b) ELSE a END, CAST([-1000000] AS BIGINT[])) AS spots FROM a2),
a4 AS (SELECT {k}, entity, text, n, unnest(list_slice(spots, 2, len(spots))) AS i FROM a3),
a5 AS (SELECT *, substring(text, greatest(i - 80, 1), least(80, i - 1)) AS before, substring(text, i + n, 80) AS after, (2 * (i - 1) + n) // 2 AS mid FROM a4),
a6 AS (SELECT *, regexp_replace(regexp_extract(substring(text, 1, mid), '[^.!?\n]*$') || regexp_extract(substring(text, mid + 1), '^[^.!?\n]*'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS sentence FROM a5),
a7 AS (SELECT *, CASE WHEN strpos(lower(sentence), lower(entity)) > 0 THEN substring(lower(sentence), 1, strpos(lower(sentence), lower(entity)) - 1) END AS ahead FROM a6),
a8 AS (SELECT *, coalesce({_last_kind('before')}, CASE WHEN {_last('ahead', literal(A.GUARD))} > {_last('ahead', literal(A.CLAUSE_ENDS))} THEN {_last_kind('sentence')} END, CASE {after} END) AS neg,
 coalesce({_relative('sentence')}, {_relative('before')}) AS who FROM a7),
a9 AS (SELECT {k}, entity, text, arg_min(neg, i) FILTER (neg IS NOT NULL) AS neg, arg_min(who, i) FILTER (who IS NOT NULL) AS who, arg_min(sentence, i) AS sentence FROM a8 GROUP BY {k}, entity, text),
b0 AS (SELECT a0.*, neg, who, coalesce(nullif(sentence, ''), a0.text) AS target FROM a0 LEFT JOIN a9 ON {' AND '.join(f'a0.{x} = a9.{x}' for x in (*keys, 'entity', 'text'))}),
b1 AS (SELECT *, CASE {certain} END AS level FROM b0)
SELECT {k}, entity, neg IS NOT NULL AS is_negated, neg AS negation_type, CASE WHEN who IS NULL THEN 'patient' WHEN who.kind = 'family' THEN 'family_member' ELSE who.kind END AS subject,
 CAST(CASE WHEN who IS NULL THEN 0.9 WHEN who.kind = 'family' THEN 0.8 WHEN who.gap < 40 THEN 0.95 ELSE 0.85 END AS DOUBLE) AS subject_confidence,
 coalesce(level, 'confirmed') AS certainty, CAST(CASE WHEN level IS NULL THEN 0.6 ELSE 0.9 END AS DOUBLE) AS certainty_confidence FROM b1"""


_WORDS = "SELECT 'turn' AS kind, conv_id AS id, turn, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]{4,}'))) AS entity, text FROM conversations"
_DAY = lambda y, m, d: f"try_cast({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"
_G = lambda p, i: f"regexp_extract(text, {q(p)}, {i})"
ISO, US, EU, AGO = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b", r"(?i)(\d+)\s+(day|days|week|weeks|month|months|year|years)\s+ago"
DATED = f"""WITH t AS (SELECT doc_id, text, DATE '2002-01-01' AS noted FROM documents UNION ALL SELECT -1 - doc_id, text, noted FROM ({NOTES})),
x AS (SELECT *, coalesce({_DAY(_G(ISO, 1), _G(ISO, 2), _G(ISO, 3))}, {_DAY(_G(US, 3), _G(US, 1), _G(US, 2))}, {_DAY(_G(EU, 3), _G(EU, 2), _G(EU, 1))}) AS fixed,
 try_cast({_G(AGO, 1)} AS INT) AS k, CASE lower({_G(AGO, 2)})[1:3] WHEN 'day' THEN 1 WHEN 'wee' THEN 7 WHEN 'mon' THEN 30 WHEN 'yea' THEN 365 END AS unit,
 CASE WHEN contains(lower(text), 'today') THEN 0 WHEN contains(lower(text), 'yesterday') THEN 1 WHEN contains(lower(text), 'last week') THEN 7 WHEN contains(lower(text), 'last month') THEN 30 WHEN contains(lower(text), 'last year') THEN 365 END AS named FROM t),
y AS (SELECT doc_id, CASE WHEN fixed IS NOT NULL THEN fixed WHEN unit IS NOT NULL THEN noted - k * unit WHEN named IS NOT NULL THEN noted - named END AS event_date,
 CAST(CASE WHEN fixed IS NOT NULL THEN 1 WHEN unit IS NOT NULL THEN 0.75 WHEN named IS NOT NULL THEN 0.8 ELSE 0 END AS DOUBLE) AS confidence,
 CASE WHEN fixed IS NULL THEN greatest(1, coalesce(unit, named) // 2) END AS reach FROM x)
SELECT doc_id, event_date, confidence, event_date - CAST(reach AS INT) AS range_from, event_date + CAST(reach AS INT) AS range_to FROM y"""

_RULES = " UNION ALL ".join(f"SELECT {q(a)} AS x, {q(b)} AS y, {rank} AS rank" for left, right, severity, _ in C.GATE_RULES for a, b, rank in ((left, right, {"HIGH": 3, "MEDIUM": 2, "LOW": 1}[severity]), (right, left, {"HIGH": 3, "MEDIUM": 2, "LOW": 1}[severity])))
INGESTED = f"""WITH t AS (SELECT doc_id, {redacted('text')} AS text FROM ({TEXTS})), e AS ({entities("SELECT * FROM t WHERE length(trim(text)) >= 20")}),
f AS ({FACTS}), drugs AS (SELECT DISTINCT lower(entity_name) AS y FROM f WHERE entity_type = 'medication' UNION SELECT 'valproate'),
known AS (SELECT DISTINCT 'diagnosis: ' || lower(entity_name) AS content FROM f WHERE entity_type = 'diagnosis'), rules AS ({_RULES}),
worst AS (SELECT rules.x, max(rank) AS rank FROM rules JOIN drugs USING (y) GROUP BY 1),
r AS (SELECT e.*, CASE type WHEN 'medication' THEN 'Medication: ' || text WHEN 'diagnosis' THEN 'Diagnosis: ' || text ELSE rtrim('Test: ' || text || ': ' || value || ' ' || coalesce(unit, '')) END AS content,
 CASE WHEN type = 'medication' AND rank = 3 THEN 'block' WHEN type = 'medication' AND rank = 2 THEN 'review' ELSE 'allow' END AS decision,
 CASE WHEN doc_id % 10 = -1 THEN 0.6 WHEN doc_id % 10 = -2 THEN 0.3 ELSE 0.78 END AS confidence FROM e LEFT JOIN worst ON worst.x = lower(trim(text))),
b AS (SELECT *, bool_or(decision = 'block') OVER (PARTITION BY doc_id) AS blocked FROM r)
SELECT doc_id, ord, type AS fact_type, text AS name, b.content, 'active' AS tier, 'active' AS status, 1 AS trust_level, decision,
 CASE WHEN confidence < 0.7 THEN 'review' WHEN blocked THEN 'blocked_ddi' WHEN decision = 'review' THEN 'queued' WHEN length(trim(b.content)) < 5 THEN 'rejected' WHEN type = 'diagnosis' AND known.content IS NOT NULL THEN 'duplicate' ELSE 'written' END AS route
FROM b LEFT JOIN known ON known.content = lower(b.content)"""

LOOSE = q(T.LOOSE_MEDICATION)
ORACLES: dict[str, str] = {
    "ner_regex_entities": "SELECT doc_id, type, text, value, unit FROM (" + entities("SELECT doc_id, text FROM documents") + ")",
    "ner_rules_medications": f"""SELECT doc_id, lower(a[i]) AS name, arg_min(b[i] || c[i], i) AS dose FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i
 FROM (SELECT doc_id, regexp_extract_all(text, {LOOSE}, 1) AS a, regexp_extract_all(text, {LOOSE}, 2) AS b, regexp_extract_all(text, {LOOSE}, 3) AS c FROM ({TEXTS}))) GROUP BY 1, 2""",
    "negation_subject_certainty": annotated(f"SELECT 'note' AS kind, doc_id AS id, 0 AS turn, entity, text FROM ({NOTES}) UNION ALL {_WORDS}", "kind", "id", "turn"),
    "entity_annotations": annotated(f"SELECT e.doc_id, e.type, e.text AS entity, n.text FROM ({entities(f'SELECT doc_id, text FROM ({NOTES})')}) e JOIN ({NOTES}) n ON n.doc_id = e.doc_id", "doc_id", "type"),
    "temporal_extract": DATED,
    "ingest_pipeline": INGESTED,
}
