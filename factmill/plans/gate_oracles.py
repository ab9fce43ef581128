"""SQL of the ordered quality gate: groups by recursion over links, then one candidate of each group a step."""

from __future__ import annotations

from factmill.plans import views

RECORDS = views.RECORDS.format(lineitem="lineitem", orders="orders")

#: Records with their entities and contents, and what each may link to.
ROWS = """r AS (SELECT *, fact_type || '/' || specialty AS blk, lower(content) AS text, list_distinct(string_split(lower(content), ' ')) AS words,
  CASE WHEN confidence < 0.35 THEN 'confidence_below_threshold' WHEN length(content) < 5 THEN 'content_too_short'
   WHEN fact_type NOT IN ('diagnosis', 'medication', 'test_result', 'symptom', 'note', 'recommendation', 'relationship', 'event') THEN 'invalid_fact_type' END AS gate
 FROM (SELECT * REPLACE (kind AS fact_type, entity AS name), CASE WHEN v = 1 THEN 'x' WHEN v > 40 THEN kind || ' ' || entity ELSE kind || ' ' || entity || ' subject ' || subject_id || ' level ' || v END AS content,
   trust_level = 5 AND source_count = 3 AS waits, first_recorded >= TIMESTAMP '1998-01-01' AS fresh,
   CASE WHEN first_recorded < TIMESTAMP '1998-01-01' THEN 0 ELSE least(year(first_recorded) - 1997, 3) END AS batch, CASE WHEN first_recorded < TIMESTAMP '1998-01-01' THEN 0 ELSE # END + id AS seq
  FROM (SELECT *, CAST(value AS INT) AS v, CASE WHEN CAST(value AS INT) = 2 THEN 'rumour' ELSE fact_type END AS kind, name || '-' || (subject_id % 7) AS entity FROM (@)))),
u AS MATERIALIZED (SELECT *, hash('text', blk, text) AS t, hash('name', blk, name) AS n FROM r WHERE NOT fresh OR gate IS NULL),
near AS (SELECT a.id, b.id AS other, 0.92 + abs(a.id - b.id) % 8 / 100 AS sim, b.seq FROM u a JOIN u b ON a.fact_type = b.fact_type AND a.subject_id = b.subject_id AND a.value = b.value AND a.specialty <> b.specialty WHERE a.value > 2),
w AS (SELECT DISTINCT blk, t, words, unnest(words) AS word FROM u WHERE len(words) > 2),
e0 AS (SELECT DISTINCT t AS a, n AS b FROM u UNION SELECT x.t, y.t FROM w x JOIN w y ON x.blk = y.blk AND x.word = y.word AND x.t < y.t
  WHERE x.word NOT IN ('subject', 'level', x.words[1]) AND len(list_intersect(x.words, y.words)) / greatest(len(x.words), len(y.words)) > 0.7
 UNION SELECT p.t, q.t FROM near JOIN u p ON p.id = near.id JOIN u q ON q.id = near.other WHERE p.t < q.t),
e AS MATERIALIZED (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
l(node, lab) AS (SELECT t, t FROM u UNION SELECT n, n FROM u UNION SELECT e.b, l.lab FROM l JOIN e ON e.a = l.node WHERE l.lab < e.b),
g AS MATERIALIZED (SELECT node, min(lab) AS grp FROM l GROUP BY node),
c AS MATERIALIZED (SELECT u.*, grp, row_number() OVER (PARTITION BY grp ORDER BY u.seq) AS k, coalesce(near, []) AS near FROM u JOIN g ON g.node = u.t
  LEFT JOIN (SELECT id, list(other ORDER BY sim DESC, seq) AS near FROM near GROUP BY id) USING (id) WHERE fresh)"""

_HOLD = "{'id': id, 'blk': blk, 'name': name, 'text': text, 'words': words, 'content': content, 'kind': fact_type, 'trust': trust_level, 'src': source_count, 'conf': confidence, 'at': first_recorded, 'waits': waits, 'act': status = 'active', 'vec': NOT waits}"
_NEW = _HOLD.replace("'content': content", "'content': new_content").replace("'text': text", "'text': lower(new_content)").replace("'words': words", "'words': list_distinct(string_split(lower(new_content), ' '))").replace("'conf': confidence", "'conf': new_conf")
_SAME = "({h}.name = c.name OR (len({h}.words) > 2 AND len(c.words) > 2 AND len(list_intersect({h}.words, c.words)) / greatest(len({h}.words), len(c.words)) > 0.7))"
_APART = "abs(CAST(floor((epoch_us(first_recorded) - epoch_us(old.at)) / 86400000000.0) AS BIGINT))"

FOLD = f"""s(grp, k, held, pend, id, decision, rule, match_id, content, confidence, status, tier, waits) AS (
 SELECT c.grp, CAST(0 AS BIGINT), coalesce(any_value(held), []), coalesce(any_value(pend), []), CAST(NULL AS BIGINT), '', '', CAST(NULL AS BIGINT), '', CAST(0 AS DOUBLE), '', '', false
 FROM c LEFT JOIN (SELECT grp, list({_HOLD} ORDER BY id) AS held, list({_HOLD} ORDER BY id) FILTER (waits) AS pend FROM u JOIN g ON g.node = u.t WHERE NOT fresh GROUP BY grp) o ON o.grp = c.grp GROUP BY c.grp
 UNION ALL
 SELECT grp, k,
  list_filter(held, lambda h: d NOT IN ('replaced', 'merged') OR h.id <> old.id) || CASE WHEN d IN ('approved', 'replaced', 'merged') THEN [{_NEW}] ELSE [] END,
  pend || CASE WHEN d = 'quarantined' OR (waits AND d IN ('approved', 'replaced', 'merged')) THEN [{_NEW}] ELSE [] END,
  id, d, rule, old.id, new_content, new_conf, CASE WHEN d = 'quarantined' THEN 'quarantined' ELSE status END, CASE WHEN d = 'quarantined' THEN 'quarantined' ELSE tier END, waits OR d = 'quarantined'
 FROM (SELECT *, CASE WHEN d = 'merged' THEN content || ' [merged with: ' || old.content || ']' ELSE content END AS new_content, CASE WHEN d = 'merged' THEN least(confidence, old.conf) ELSE confidence END AS new_conf FROM
 (SELECT *, CASE WHEN d0 <> 'conflict' THEN d0 ELSE string_split(r0, ':')[1] END AS d, CASE WHEN d0 = 'conflict' THEN string_split(r0, ':')[2] END AS rule FROM
 (SELECT *, CASE WHEN old.trust = 1 AND trust_level > 1 THEN 'kept_existing:clinical_supremacy' WHEN trust_level = 1 AND old.trust > 1 THEN 'replaced:clinical_supremacy'
   WHEN old.trust = 2 AND trust_level = 3 THEN 'kept_existing:peer_review_beats_ai' WHEN trust_level = 2 AND old.trust = 3 THEN 'replaced:peer_review_beats_ai'
   WHEN trust_level = old.trust AND {_APART} > 90 THEN CASE WHEN first_recorded > old.at THEN 'replaced' ELSE 'kept_existing' END || ':recency_same_trust'
   WHEN source_count > old.src AND source_count >= 2 THEN 'replaced:source_agreement'
   WHEN fact_type = 'test_result' AND old.kind = 'test_result' THEN 'merged:value_range_merge' WHEN fact_type = 'medication' AND old.kind = 'medication' THEN 'quarantined:medication_dose_conflict' ELSE 'quarantined:unresolvable' END AS r0 FROM
 (SELECT *, CASE WHEN dup IS NOT NULL THEN 'duplicate' WHEN nr IS NOT NULL AND nr.trust = trust_level THEN 'near_duplicate' WHEN nr IS NULL AND ent IS NOT NULL AND waiting THEN 'pending_review_exists'
   WHEN nr IS NULL AND ent IS NULL THEN 'approved' ELSE 'conflict' END AS d0, CASE WHEN dup IS NOT NULL THEN dup WHEN nr IS NOT NULL THEN nr ELSE ent END AS old FROM
 (SELECT *, list_filter(held, lambda h: h.id = nid)[1] AS nr FROM
 (SELECT s.held, s.pend, c.*, list_filter(s.held, lambda h: h.act AND h.blk = c.blk AND h.text = c.text)[1] AS dup,
   list_filter(c.near, lambda n: len(list_filter(s.held, lambda h: h.id = n AND h.vec)) > 0)[1] AS nid,
   list_filter(s.held, lambda h: h.act AND h.blk = c.blk AND h.text <> c.text AND {_SAME.format(h="h")})[1] AS ent,
   len(list_filter(s.pend, lambda p: p.blk = c.blk AND {_SAME.format(h="p")})) > 0 AS waiting
  FROM s JOIN c ON c.grp = s.grp AND c.k = s.k + 1)))))))"""

_DAYS = "date_diff('day', CAST(first_recorded AS DATE), DATE '2002-01-01') > 1825"
VERDICTS = f"""SELECT s.id, s.decision, s.match_id, s.rule, s.content, s.confidence, s.status, s.tier, s.waits, {_DAYS.replace("first_recorded", "r.first_recorded")} AS outdated FROM s JOIN r ON r.id = s.id
UNION ALL SELECT id, gate, NULL, NULL, content, confidence, status, tier, waits, {_DAYS} FROM r WHERE fresh AND gate IS NOT NULL"""



def judged(seq: str) -> str:
    """The gate with candidates in the order of seq plus id."""
    return f"WITH RECURSIVE {ROWS.replace('@', RECORDS).replace('#', seq)}, {FOLD}, verdicts AS MATERIALIZED ({VERDICTS})"


#: Records after the load and batches of 1998, 1999 and later years: superseded ones, confirmations by the day of the last batch that touched them, vectors, events and review items.
WRITER = """,
j AS (SELECT v.*, r.source_type, r.batch, DATE '2002-01-01' + CAST(r.batch AS INTEGER) AS day FROM verdicts v JOIN r ON r.id = v.id),
hit AS (SELECT match_id AS id, max(day) AS day, bool_or(decision IN ('replaced', 'merged')) AS lost FROM j WHERE decision IN ('duplicate', 'near_duplicate', 'replaced', 'merged') GROUP BY 1),
k AS (SELECT id, content, status, tier, waits, false AS late FROM r WHERE NOT fresh UNION ALL
  SELECT id, content, status, tier, waits, date_diff('day', CAST(began AS DATE), day) > 1825 FROM (SELECT j.*, r.first_recorded AS began FROM j JOIN r ON r.id = j.id) WHERE decision IN ('approved', 'replaced', 'merged', 'quarantined'))
SELECT 'record' AS kind, k.id, CASE WHEN lost THEN 'superseded' ELSE k.status END AS a, CASE WHEN lost THEN 'superseded' ELSE k.tier END AS b, md5(k.content) AS c, coalesce(day, CAST(first_recorded AS DATE)) AS day, late
 FROM k JOIN r ON r.id = k.id LEFT JOIN hit ON hit.id = k.id
UNION ALL SELECT 'vector', k.id, NULL, NULL, md5(k.content), NULL, NULL FROM k LEFT JOIN hit ON hit.id = k.id WHERE NOT k.waits AND k.tier <> 'quarantined' AND NOT coalesce(lost, false)
UNION ALL SELECT 'event', CASE WHEN decision IN ('kept_existing', 'quarantined') THEN match_id ELSE id END, e, CASE WHEN rule IS NULL THEN source_type ELSE 'truth_resolution_engine' END, rule, day, NULL
 FROM (SELECT *, CASE WHEN decision IN ('confidence_below_threshold', 'content_too_short') THEN 'quality_reject' WHEN decision IN ('duplicate', 'near_duplicate') THEN 'dedup_confirm'
  WHEN decision = 'pending_review_exists' THEN 'dedup_pending_review' WHEN rule IS NOT NULL THEN 'truth_resolution' END AS e, unnest(range(CASE WHEN decision = 'quarantined' THEN 2 ELSE 1 END)) FROM j) WHERE e IS NOT NULL
UNION ALL SELECT 'queue', id, decision, NULL, md5(content), day, NULL FROM j
 WHERE decision IN ('confidence_below_threshold', 'content_too_short', 'invalid_fact_type', 'quarantined') OR (waits AND decision IN ('approved', 'replaced', 'merged'))"""

ORACLES = {
    "quality_gate_ordered": f"""{judged("0")}
SELECT id, decision, match_id, rule, md5(content) AS content_md5, round(confidence, 6) AS confidence, status, tier, waits AS requires_review, outdated FROM verdicts""",
    "record_writer": judged("least(year(first_recorded) - 1997, 3) * 1000000000000000") + WRITER,
}
