"""Clinical views over the general tables; the same text runs in other SQL engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factmill.sources.shared import spread
from factmill.sources.tables import table

FACTS = """
SELECT event_id AS id, event_id AS ord, user_id AS subject_id,
  CASE event_type WHEN 'click' THEN 'measurement' WHEN 'view' THEN 'test_result' WHEN 'purchase' THEN 'medication' WHEN 'signup' THEN 'diagnosis' ELSE 'symptom' END AS entity_type,
  CASE event_type
    WHEN 'click'    THEN CASE event_id % 4 WHEN 0 THEN 'weight' WHEN 1 THEN 'BP' WHEN 2 THEN 'temp' ELSE 'Pulse' END
    WHEN 'view'     THEN CASE event_id % 4 WHEN 0 THEN 'HbA1c' WHEN 1 THEN 'a1c' WHEN 2 THEN 'LDL-C' ELSE 'chol' END
    WHEN 'purchase' THEN CASE event_id % 6 WHEN 0 THEN 'Warfarin' WHEN 1 THEN 'apixaban' WHEN 2 THEN 'clopidogrel' WHEN 3 THEN 'omeprazole' WHEN 4 THEN 'sertraline' ELSE 'ibuprofen' END
    WHEN 'signup'   THEN CASE event_id % 5 WHEN 0 THEN 'HTN' WHEN 1 THEN 'hypertension' WHEN 2 THEN 'type 1 diabetes' WHEN 3 THEN 't2dm' ELSE 'acute bronchitis' END
    ELSE CASE event_id % 3 WHEN 0 THEN 'headache' WHEN 1 THEN 'headaches' ELSE 'nausea' END END AS entity_name,
  CASE WHEN event_type IN ('click','view') THEN CAST(floor(value / 5) AS DOUBLE) END AS value,
  CASE WHEN event_type = 'click' AND event_id % 4 = 0 THEN CASE WHEN event_id % 8 = 0 THEN 'kg' ELSE 'lbs' END
       WHEN event_type = 'view' THEN 'mg/dL' END AS unit,
  CASE WHEN event_id % 11 = 0 THEN CAST(NULL AS DATE) ELSE CAST(ts AS DATE) END AS date
FROM {events}"""

RECORDS = """
SELECT (l_orderkey * 10 + l_linenumber) * 101 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag, l_linestatus, l_shipdate) - 1 AS id,
  CASE l_partkey % 6 WHEN 0 THEN 'diagnosis' WHEN 1 THEN 'medication' WHEN 2 THEN 'test_result' WHEN 3 THEN 'symptom' WHEN 4 THEN 'note' ELSE 'recommendation' END AS fact_type,
  concat('p', CAST(l_partkey % 97 AS VARCHAR(10))) AS name, o_custkey AS subject_id,
  CASE l_suppkey % 5 WHEN 0 THEN 'neurology' WHEN 1 THEN 'epilepsy' WHEN 2 THEN 'gastroenterology' WHEN 3 THEN 'urology' ELSE 'general' END AS specialty,
  CAST(1 + ((l_suppkey + l_linenumber) % 5) AS INT) AS trust_level,
  CAST(1 + (l_linenumber % 3) AS INT) AS source_count,
  round(0.3 + l_discount * 7, 2) AS confidence, l_quantity AS value,
  CASE l_linestatus WHEN 'O' THEN 'active' ELSE 'hypothesis' END AS tier,
  CASE l_returnflag WHEN 'R' THEN 'conflicted' ELSE 'active' END AS status,
  CASE l_linenumber % 4 WHEN 0 THEN 'ai_response' WHEN 1 THEN 'web' ELSE 'document' END AS source_type,
  CASE l_linenumber % 3 WHEN 0 THEN 'gemini' WHEN 1 THEN 'rules_based' ELSE 'spacy' END AS extraction_method,
  l_shipdate AS first_recorded
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey"""

EXTRACTIONS = """
SELECT doc_id, extractor, entity_type, entity_text, count(*) AS n_mentions,
  0.4 + CAST((doc_id * 7 + x * 11) % 60 AS DOUBLE) / 100 AS confidence, CAST((doc_id * 13 + x * 37) % 240 AS INT) AS latency_ms
FROM (SELECT CAST(floor(event_id / 6) AS BIGINT) AS doc_id, event_id % 3 AS x,
        CASE event_id % 3 WHEN 0 THEN 'spacy' WHEN 1 THEN 'phi3' ELSE 'gemini' END AS extractor,
        CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 2 = 0 THEN 'diagnosis' ELSE 'medication' END AS entity_type,
        concat('e', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 4 AS VARCHAR(10))) AS entity_text
      FROM {events}) t
WHERE doc_id % 5 <> 0 OR x = 0
GROUP BY doc_id, x, extractor, entity_type, entity_text"""


def _pick(key: str, *values: str) -> str:
    """One of the values by a whole-number key."""
    whens = " ".join(f"WHEN {i} THEN '{v.replace(chr(39), chr(39) * 2)}'" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {whens} END"


#: Clinical sentences made of the events: a lead, an entity, a tail and an order, in every combination as the ids go on.
NOTES = f"""
SELECT event_id AS doc_id, user_id AS subject_id, CAST(ts AS DATE) AS noted, entity, concat(lead, entity, tail, ordered) AS text
FROM (SELECT event_id, user_id, ts, {_pick("event_id", "chest pain", "asthma", "migraine", "pneumonia", "diabetes")} AS entity,
  {_pick("event_id", "", "Patient denies ", "No history of ", "Father had ", "Suspect ", "Negative for fever, has ", "Maternal grandmother with ", "Diagnosed with ", "Consider asthma vs ")} AS lead,
  {_pick("event_id", ".", " ruled out.", " resolved.", ". No fever.", ", not present today.", " since 2024-03-15.", " for 2 weeks ago.", "; mother's sister is well.")} AS tail,
  {_pick("event_id", " Takes Lamotrigine 5 mg daily.", " Aspirin 100 mg once.", " Ibuprofen 200 mg as needed.", " HbA1c: 7.2 %.", " Diagnosis: hypertension.", " Seen yesterday.", " On 03/15/2024 lamotrigine 25 mg.", "", " Warfarin 5 mg, ibuprofen 400 mg.", " Weight 82.5 kg.", " History of stroke.", " Rest.", " AB 2.5 ml.")} AS ordered
  FROM {{events}}) t"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FACTS, events=table(spark, sf_dir, "events"))


def records(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Records, dealt anew by keys if there are any."""
    lines = table(spark, sf_dir, "lineitem")
    out = spark.sql(RECORDS, lineitem=spread(lines, "l_orderkey"), orders=table(spark, sf_dir, "orders"))
    return spread(out, *keys, stored=lines) if keys else out


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EXTRACTIONS, events=table(spark, sf_dir, "events"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NOTES, events=table(spark, sf_dir, "events"))
