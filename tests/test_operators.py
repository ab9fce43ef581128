"""Published examples of the operators' behaviour, and folds and annotations against plain re-derivations."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factmill.functions import annotate as A
from factmill.functions import text as T
from factmill.operators import dedup, extract, promote, resolve, safety, score, store, vector
from factmill.sources.tables import page_text, specialties

FACT = "id long, ord long, subject_id long, entity_type string, entity_name string, value double, unit string, date date"


def day(text):
    return dt.date.fromisoformat(text) if text else None


def facts(spark, *rows):
    return spark.createDataFrame([(i, i, 1, t, n, v, None, day(d)) for i, (t, n, v, d) in enumerate(rows)], FACT)


def strategy(spark, *rows):
    f = facts(spark, *rows)
    return {r["id"]: r["strategy"] for r in dedup.decide(f, f).collect()}[len(rows) - 1]


def conflict(spark, *rows):
    f = facts(spark, *rows)
    got = {r["id"]: r["conflict_type"] for r in dedup.conflicts(f, f).collect()}
    return got.get(len(rows) - 1)


def test_exact_and_alias_and_series(spark):
    assert strategy(spark, ("diagnosis", "hypertension", None, "2024-03-01"), ("diagnosis", "Hypertension ", None, "2024-03-05")) == "exact"
    assert strategy(spark, ("diagnosis", "hypertension", None, None), ("diagnosis", "hypertension", None, None)) == "exact"
    assert strategy(spark, ("diagnosis", "HTN", None, None), ("diagnosis", "hypertension", None, "2024-03-05")) == "semantic"
    assert strategy(spark, ("test_result", "HbA1c", 8.2, "2024-01-01"), ("test_result", "HbA1c", 7.5, "2024-04-01")) == "timeseries"
    assert strategy(spark, ("diagnosis", "asthma", None, None), ("symptom", "asthma", None, None)) == "none"


def test_conflicts(spark):
    assert conflict(spark, ("medication", "warfarin", None, None), ("medication", "Rivaroxaban", None, None)) == "drug_interaction"
    assert conflict(spark, ("diagnosis", "type 1 diabetes", None, None), ("diagnosis", "type 2 diabetes", None, None)) == "type_mismatch"
    assert conflict(spark, ("diagnosis", "acute bronchitis", None, None), ("diagnosis", "chronic asthma", None, None)) == "type_mismatch"
    assert conflict(spark, ("measurement", "weight", 85.0, "2024-03-01"), ("measurement", "weight", 78.0, "2024-03-04")) == "implausible_change"
    assert conflict(spark, ("measurement", "BP", 120.0, "2024-03-01"), ("measurement", "BP", 170.0, "2024-03-01")) == "value_mismatch"
    assert conflict(spark, ("test_result", "hba1c", 8.5, "2024-03-01"), ("test_result", "a1c", 5.0, "2024-03-30")) == "implausible_change"
    assert conflict(spark, ("test_result", "hba1c", 8.0, "2024-01-01"), ("test_result", "a1c", 7.3, "2024-04-01")) is None
    assert conflict(spark, ("diagnosis", "asthma", None, "2024-03-01"), ("medication", "aspirin", None, "2024-02-01")) == "temporal"


def test_units(spark):
    rows = [("weight", 185.0, "lbs"), ("HbA1c", 55.0, "mmol/mol"), ("weight", 3.0, "stone"), ("body weight", 3.0, "lbs"), ("temperature", 98.6, "F")]
    f = spark.createDataFrame([(i, n, v, u) for i, (n, v, u) in enumerate(rows)], "id long, entity_name string, value double, unit string")
    got = {r["id"]: (r["normalized_value"], r["normalized_unit"]) for r in dedup.normalize_units(f).collect()}
    assert 83 < got[0][0] < 85 and got[0][1] == "kg"
    assert 7.0 < got[1][0] < 7.5 and got[1][1] == "%"
    assert got[2] == (3.0, "kg") and got[3] == (3.0, "lbs")
    assert got[4][0] == pytest.approx(37.0)


def test_fuzzy_names_are_complete(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(4, 18))) for _ in range(40)]
    words += [w[:k] + "x" + w[k + 1 :] for w in words for k in (0, len(w) // 2)]
    names = sorted(set(words))
    from difflib import SequenceMatcher

    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if SequenceMatcher(None, a, b).ratio() >= 0.92}
    df = spark.createDataFrame([(w,) for w in names], "name string")
    assert {(r["a"], r["b"]) for r in dedup.alike_names(df).collect()} == want and want


RECORD = "id long, fact_type string, name string, subject_id long, trust_level int, source_count int, confidence double, value double, first_recorded timestamp_ntz"


def verdict(spark, rule, old, new, kind="diagnosis"):
    def row(i, x):
        trust, sources, value, date = x
        return (i, kind, "a", 1, trust, sources, 0.8, value, dt.datetime.fromisoformat(date))

    df = spark.createDataFrame([row(1, old), row(2, new)], RECORD)
    return tuple(resolve.pairs(df).select(rule.alias("v")).select("v.*").first())


def test_rule_chains(spark):
    k, g = resolve.knowledge_rules(), resolve.governance_rules()
    assert verdict(spark, k, (1, 1, 1.0, "2024-01-01"), (3, 1, 1.0, "2024-01-01"))[:2] == ("keep_existing", 0.95)
    assert verdict(spark, k, (3, 1, 1.0, "2023-01-01"), (3, 1, 1.0, "2024-01-01"))[0] == "replace_with_new"
    assert verdict(spark, k, (3, 1, 1.0, "2024-01-01"), (3, 1, 2.0, "2024-01-02"), "medication")[2] == "medication_dose_conflict"
    assert verdict(spark, g, (2, 1, 1.0, "2024-01-01"), (3, 1, 1.0, "2024-01-01"))[0] == "keep_existing"
    assert verdict(spark, g, (4, 1, 1.0, "2024-01-01"), (3, 2, 1.0, "2024-01-01"))[2] == "multi_source_replaces_weaker_single_source"
    assert verdict(spark, g, (3, 1, 7.2, "2024-01-01"), (3, 1, 7.8, "2024-01-10"))[:2] == ("merge", 0.72)
    assert verdict(spark, g, (3, 1, None, "2024-01-01"), (4, 1, 2.0, "2024-01-02"))[0] == "quarantine"


def test_days_are_floored_before_the_sign_is_dropped(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 12))], "a timestamp_ntz, b timestamp_ntz")
    assert tuple(df.select(resolve.days_apart(F.col("a"), F.col("b")), resolve.days_apart(F.col("b"), F.col("a"))).first()) == (1, 0)


def test_fold_against_plain_loop(spark):
    rng = random.Random(5)
    rows = [(i, "diagnosis", f"n{rng.randint(0, 4)}", rng.randint(0, 2), 1, 1, rng.choice([0.5, 0.55, 0.7, 0.9]), rng.choice([1.0, 2.0, None]), dt.datetime(2024, 1, 1)) for i in range(300)]
    want, state = {}, {}
    for i, _, n, s, _, _, c, v, _ in rows:
        if (n, s) not in state:
            want[i], state[n, s] = ("replace_with_new", 1.0, None), (i, (v, False), c)
            continue
        own, sig, best = state[n, s]
        delta = round(c - best, 3)
        if sig == (v, False):
            want[i], state[n, s] = ("merge", 0.95, own), (own, (v, True), max(c, best))
        elif delta >= 0.1:
            want[i], state[n, s] = ("replace_with_new", 0.8, own), (own, (v, False), c)
        elif delta <= -0.1:
            want[i] = ("keep_existing", 0.8, own)
        else:
            want[i] = ("quarantine", 0.0, own)
    got = {r["id"]: (r["action"], r["confidence"], r["existing_id"]) for r in resolve.fold(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == want


def test_consensus_scores(spark):
    cols = "doc_id long, extractor string, entity_type string, entity_text string, confidence double, latency_ms int"
    rows = [(1, "a", "dx", "x", 0.8, 5), (1, "b", "dx", "X ", 0.9, 5), (2, "a", "dx", "x", 0.8, 5), (2, "a", "dx", "y", 0.8, 5), (2, "b", "dx", "x", 0.8, 5), (3, "a", "dx", "x", 0.8, 5), (3, "b", "dx", "y", 0.8, 5), (4, "a", "dx", "x", 0.74, 5)]
    got = {r["doc_id"]: (r["agreement_score"], r["confidence"]) for r in extract.validated(spark.createDataFrame(rows, cols)).collect()}
    assert got[1] == (1.0, 0.85) and got[2][0] == 0.5 and got[3] == (0.0, 0.0) and got[4] == (1.0, 0.74)


def test_route_scores(spark):
    profiles = extract.connector_profiles(spark.createDataFrame([], "connector string, success boolean, latency_ms double, confidence double"))
    docs = spark.createDataFrame([(1, 100, False), (2, 4500, False)], "doc_id long, n_chars int, artifacts boolean")
    got = {(r["doc_id"], r["connector"]): r["score"] for r in extract.route_scores(docs, profiles).collect()}
    assert got[1, "spacy"] == 0.907 and got[2, "gemini"] == 0.847
    assert {r["doc_id"]: r["connector"] for r in extract.route_choice(extract.route_scores(docs, profiles)).collect()}[1] == "spacy"


def test_annotations(spark):
    cases = {
        ("chest pain", "Patient denies chest pain"): ("denied", "patient", "confirmed"),
        ("Pneumonia", "Pneumonia ruled out"): ("ruled_out", "patient", "ruled_out"),
        ("diabetes", "No history of diabetes"): ("absent", "patient", "historical"),
        ("chest pain", "no fever, has chest pain"): ("absent", "patient", "confirmed"),  # the window has a cue; only the sentence scan is guarded
        ("heart attack", "Father had heart attack at age 55"): (None, "father", "confirmed"),
        ("asthma", "Patient has asthma"): (None, "patient", "confirmed"),
        ("asthma", "Suspect asthma"): (None, "patient", "suspected"),
        ("a", "Consider a vs b"): (None, "patient", "differential"),
        ("c++", "They use c++ now. denies c++"): ("denied", "patient", "confirmed"),
        ("stroke", "Family history of stroke"): (None, "family_member", "historical"),
        ("asthma", "It is no. " + "x" * 90 + " asthma"): (None, "patient", "confirmed"),  # out of the window
        ("", ""): (None, "patient", "confirmed"),
        ("x", None): (None, "patient", "confirmed"),
        ("absent word", "nothing here"): (None, "patient", "confirmed"),
    }
    got = A.annotate(spark.createDataFrame(list(cases), "entity string, text string")).select("entity", "text", "annotation.*").collect()
    assert {(r["entity"], r["text"]): (r["negation_type"], r["subject"], r["certainty"]) for r in got} == cases
    assert {r["certainty_confidence"] for r in got if r["text"] in ("", None)} == {0.5} and all(r["is_negated"] == (r["negation_type"] is not None) for r in got)


def test_event_dates(spark):
    rows = ["diagnosed on 2024-03-15", "seen 2 weeks ago", "on 03/15/2024", "am 15.03.2024", "on 2024-13-40, yesterday", "nothing"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(T.event_date(F.col("t"), F.lit("2024-04-01").cast("date")).alias("e")).select("e.date", "e.confidence")
    got = [(str(r["date"]), r["confidence"]) for r in df.collect()]
    assert got == [("2024-03-15", 1.0), ("2024-03-18", 0.75), ("2024-03-15", 1.0), ("2024-03-15", 1.0), ("2024-03-31", 0.80), ("None", 0.0)]


def test_personal_data(spark):
    t = "DOB: 01/15/1980. SSN: 123-45-6789. Dr. Ann Lee, a.b@c.org, 555-123-4567"
    got = spark.range(1).select(T.redact(F.lit(t)), T.pii_hits(F.lit(t))).first()
    assert got[0] == "DOB: [DATE]. SSN: [ID_REMOVED]. [PHYSICIAN], [CONTACT_REMOVED], [CONTACT_REMOVED]" and len(got[1]) == 5


def test_scan_sample(spark):
    n = spark.range(1).select(F.size(T.confused_tokens(F.lit("Patient weight 50Omg prescribed metf0rmin l00mg, O2 98")))).first()[0]
    assert n == 2


def test_chunks(spark):
    lined = "\n".join("x" * 99 for _ in range(130))
    got = spark.range(1).select(T.chunks(F.lit(lined)), T.chunks(F.lit("[Page 1]\na\n[Page 2]\nb")), T.chunks(F.lit(""))).first()
    assert [len(c) for c in got[0]] == [5999, 5999, 999] and got[1] == ["[Page 1]\na\n", "[Page 2]\nb"] and got[2] == []


def test_documents(spark):
    note = "Chief complaint: pain. Assessment and plan: rest."
    kind = lambda t, **k: spark.range(1).select(T.classify_document(F.lit(t), **k).alias("c")).select("c.*").first()
    assert tuple(kind(note))[:3] == ("clinical_note", 1, "active")
    assert tuple(kind("plain words"))[:4] == ("generic", 4, "hypothesis", 0.4)
    assert kind(note, source_type=F.lit("ai_response"))["tier"] == "hypothesis"
    assert kind(note, ocr_confidence=F.lit(0.5))["tier"] == "quarantined"
    assert kind("plain", explicit_trust=F.lit(1))["tier"] == "active"


def test_gate_and_scores(spark):
    new = spark.createDataFrame([(1, 1, "lamotrigine"), (2, 1, "ibuprofen"), (3, 1, "aspirin")], "id long, subject_id long, drug string")
    held = spark.createDataFrame([(1, "Valproate", 1), (1, "warfarin", 1), (1, "sertraline", 1)], "subject_id long, drug string, n int")
    found = safety.findings(new, held, safety.rules(spark))
    assert {r["id"]: r["decision"] for r in safety.gate(new, found).collect()} == {1: "block", 2: "review", 3: "allow"}
    assert {r["id"]: r["ddi_score"] for r in safety.score_modifier(found, new).collect()} == {1: 0.6, 2: 0.75, 3: 1.0}
    assert {r["decision"] for r in safety.gate(new, found, available=False).collect()} == {"pending"}


def test_governance_score(spark):
    text = F.lit("Because of this the patient should therefore rest")
    got = spark.range(1).select(score.governance_score(text, F.lit(1), F.lit(1), F.lit(True), F.lit(0.9))["final_score"]).first()[0]
    assert got == 0.93


def test_promotion(spark):
    cols = "id long, subject_id long, fact_type string, name string, source_type string, source_count int, trust_level int, confidence double"
    weak = spark.createDataFrame([(1, 1, "note", "a", "enrichment", 1, 4, 0.9), (2, 1, "note", "b", "web", 1, 4, 0.9)], cols)
    evidence = spark.createDataFrame([(9, 1, "note", "A ", "extraction", 1, 1, 0.9)], cols)
    assert {r["id"]: (r["promoted"], r["trust_level"]) for r in promote.promotion(weak, evidence).collect()} == {1: (True, 2), 2: (False, 4)}


def test_upsert_and_resolution(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, seq int")
    assert sorted(map(tuple, store.upsert(base, changes).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    conflicts = spark.createDataFrame([("k", 1, 2, "pending"), ("l", 3, 4, "resolved")], "conflict_id string, id long, match_id long, status string")
    decisions = spark.createDataFrame([("k", "fact1"), ("l", "fact1"), ("m", "fact1"), ("k", "maybe")], "conflict_id string, choice string")
    good, bad = store.resolve(conflicts, decisions)
    assert sorted((r["id"], r["status"]) for r in good.collect()) == [(1, "rejected"), (2, "active")]
    assert sorted(r["error"] for r in bad.collect()) == ["invalid_choice", "not_pending", "unknown_conflict"]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = vector.top_k(v.where("vec_id = 1"), v, 2, block=1).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2]
    assert vector.near_duplicate(vector.top_k(v.where("vec_id <= 3"), v, 2), 0.92).count() == 2


def test_page_scan():
    body = "word " * 60
    assert page_text(f"<html><nav>menu</nav><article><p>{body}</p><script>x</script></article><footer>f</footer></html>") == " ".join(body.split())
    assert page_text("<p>a</p><p>b") == "a b" and page_text(None) == ""
    assert len(page_text(f"<body>{'y' * 9000}</body>")) == 8000


def test_specialties(spark):
    got = specialties(spark, ["specialty: epilepsy\nstatus: stub\nkeywords:\n  - eeg\n  - seizure\n"]).first()
    assert tuple(got) == ("epilepsy", True, ["eeg", "seizure"])


def test_records(spark):
    from factmill.operators import records

    cols = "doc_id long, confidence double, extraction_method string, entities array<struct<type: string, text: string, structured: map<string,string>>>"
    rows = [(1, 0.8, "spacy", [("medication", "Aspirin", {"dose": "10mg", "frequency": ""}), ("test_result", "Hb", {"value": "7", "unit": "g"}), ("odd", " x ", None), ("note", "  ", None)])]
    got = records.from_entities(spark.createDataFrame(rows, cols)).orderBy("ord").collect()
    assert [(r["fact_type"], r["content"]) for r in got] == [("medication", "Medication: Aspirin 10mg"), ("test_result", "Test: Hb: 7 g"), ("note", "x")]
    food = [(1, 0, "Rice", "рис", 1, None, 2, None, "SAFE", 0.9), (1, 1, "rice ", None, 3, None, None, None, None, 0.9), (1, 2, " ", None, None, None, None, None, None, 0.9)]
    fcols = "doc_id long, ord int, food_name string, food_name_ru string, ibs_score int, diverticulitis_score int, oxalates_score int, crystalluria_score int, safety_category string, confidence double"
    note = records.from_foods(spark.createDataFrame(food, fcols)).collect()
    assert [(r["content"], r["tags"]) for r in note] == [("Food: Rice (ru: рис) | Scores: IBS=1, Oxalates=2 | Safety: SAFE", ["food_guide", "food_entry", "safe"])]
    stale = spark.createDataFrame([("diagnosis", "asthma", "Diagnosis: [PERSON]"), ("note", "[DATE]", "[DATE]"), ("note", "a", "a")], "fact_type string, name string, content string")
    assert [(r["shown"], r["stale"]) for r in records.shown(stale).collect()] == [("Diagnosis: asthma", True), ("[DATE]", True), ("a", False)]


def test_ingest_blocks_whole_documents(spark):
    from factmill.plans import flows

    texts = ["He takes Lamotrigine 5 mg and Aspirin 100 mg daily.", "She takes Aspirin 100 mg every day.", "He takes Ibuprofen 100 mg every day.", "nothing to be found in this text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    drugs = spark.createDataFrame([("valproate", 1), ("warfarin", 1)], "drug string, n int")
    got = {(r["doc_id"], r["name"]): r["route"] for r in flows.ingest(spark, df, drugs).collect()}
    # the test pattern takes a capital word, what follows and a number: "He takes Lamotrigine 5" is a test result of the same document
    assert got == {
        (0, "Lamotrigine"): "blocked_ddi", (0, "He takes Lamotrigine"): "blocked_ddi", (0, "Aspirin"): "blocked_ddi", (1, "Aspirin"): "written",
        (1, "She takes Aspirin"): "written", (2, "Ibuprofen"): "queued", (2, "He takes Ibuprofen"): "written",
    }
    routes = {r["route"] for r in flows.ingest(spark, df, drugs, spark.createDataFrame([("medication", " medication:  ASPIRIN ")], "fact_type string, content string"), F.when(F.col("doc_id") == 2, 0.6).otherwise(0.8)).collect()}
    assert routes == {"blocked_ddi", "duplicate", "written", "review"}


def test_drain(spark, tmp_path):
    from factmill.streaming import jobs

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"id": 1, "v": "a", "seq": 1}\n{"id": 1, "v": "b", "seq": 2}\nno json\n')
    args = (spark, str(source), "id long, v string, seq long", str(tmp_path / "out"), str(tmp_path / "ck"))
    jobs.drain(*args)
    (source / "b.json").write_text('{"id": 1, "v": "c", "seq": 3}\n{"id": 2, "v": "d", "seq": 1}\n{"v": "no key"}\n')
    jobs.drain(*args)
    held = jobs.drain(*args)
    assert sorted((r["id"], r["v"]) for r in held.read("rows").collect()) == [(1, "c"), (2, "d")]
    assert sorted((r["line"], r["batch"]) for r in held.read("rejected").collect()) == [("no json", 0), ('{"v":"no key"}', 1)]
    assert len(held.versions()) == 2


def test_misspellings_against_the_whole_search():
    """Candidates by letter pairs lose no term that a search among all terms finds."""
    from difflib import get_close_matches

    import pandas as pd

    from factmill import config as C

    rng = random.Random(7)
    terms = sorted(C.MEDICAL_TERMS)
    tokens = set(terms)
    for _ in range(1500):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[rng.choice("abcdeirst")], [w[i], w[i]], [w[i], rng.choice("aeior")], [] if len(w) > 4 else [w[i]]])
        tokens.add("".join(w))
    tokens = sorted(tokens)
    want = [None if t in terms else (get_close_matches(t, terms, n=1, cutoff=0.85) or [None])[0] for t in tokens]
    assert list(next(A.closest_term.func(iter([pd.Series(tokens)])))) == want and sum(w is not None for w in want) > 300


def test_same_entity(spark):
    from factmill.operators.promote import same_entity

    cols = "id long, name string, content string, block string"
    old = spark.createDataFrame([(1, "asthma", "x", "a"), (2, "", "severe chronic pain in the left knee", "a"), (3, "asthma", "y", "b"), (4, "", "two words", "a")], cols)
    new = spark.createDataFrame([(10, "Asthma", "other", "a"), (11, "", "severe chronic pain in the left knee now", "a"), (12, "", "severe pain", "a"), (13, "x", "chronic pain in the right arm today", "a"), (14, "", "two words", "a"), (15, "", "severe chronic  pain in the left KNEE", "a"), (2, "", "severe chronic pain in the left knee", "a")], cols)
    assert {r["id"]: r["match_id"] for r in same_entity(new, old).collect()} == {10: 1, 11: 2, 15: 2}


def test_alias_by_name_and_vector(spark):
    f = facts(spark, ("symptom", "headache", None, None), ("symptom", "headaches", None, None), ("symptom", "cephalalgia", None, None), ("symptom", "nausea", None, None))
    assert {r["id"]: r["match_id"] for r in dedup.alias_matches(f, f).collect()} == {1: 0}
    vectors = spark.createDataFrame([("headache", [1.0, 0.1]), ("cephalalgia", [0.99, 0.12]), ("nausea", [0.0, 1.0]), ("odd", None)], "name string, vector array<double>")
    assert {r["id"]: r["match_id"] for r in dedup.alias_matches(f, f, vectors=vectors).collect()} == {1: 0, 2: 0}


def test_rules_against_pairs_of_all_facts(spark):
    """Firsts, running extremes and steps against every pair of facts."""
    rng = random.Random(9)
    rows = [(i, i, rng.randint(1, 2), rng.choice(["diagnosis", "medication"]), rng.choice(["warfarin", "apixaban", "asthma"]), rng.choice([None, 1.0]), None, rng.choice([None, *[dt.date(2024, 1, k) for k in (1, 3, 8, 9, 20, 28)]])) for i in range(120)]
    df = spark.createDataFrame(rows, FACT)
    exact, series, temporal = {}, {}, {}
    for n in rows:
        for e in rows:
            if e[1] >= n[1] or e[2] != n[2]:
                continue
            gap = abs((n[7] - e[7]).days) if n[7] and e[7] else None
            if (n[3], n[4], n[5]) == (e[3], e[4], e[5]) and ((n[7] is None and e[7] is None) or (gap is not None and gap <= 7)):
                exact.setdefault(n[0], e[0])
            if (n[3], n[4]) == (e[3], e[4]) and gap is not None and gap > 7 and gap > series.get(n[0], (0, 0))[1]:
                series[n[0]] = (e[0], gap)
            if n[7] and e[7] and ((n[3] == "medication" and e[3] == "diagnosis" and n[7] < e[7]) or (n[3] == "diagnosis" and e[3] == "medication" and e[7] < n[7])):
                temporal.setdefault(n[0], e[0])
    assert {r["id"]: r["match_id"] for r in dedup.exact_matches(df, df).collect()} == exact
    assert {r["id"]: (r["match_id"], r["gap"]) for r in dedup.timeseries_matches(df, df).collect()} == series
    assert {r["id"]: r["match_id"] for r in dedup.temporal_conflicts(df, df).collect()} == temporal and exact and series and temporal


def test_severity_of_a_quarantine_must_be_known(spark):
    from factmill.operators import review

    found = spark.createDataFrame([(2, 1, "value_mismatch", "odd", "r")], "id long, match_id long, conflict_type string, severity string, reason string")
    rows, _, _ = review.quarantine(found, facts(spark, ("note", "a", None, None)), F.lit("2024-01-01"))
    with pytest.raises(Exception, match="severity must be"):
        rows.collect()


def test_selection_by_counts(spark):
    """Every place of groups with ties, extremes, negative zeros and values that differ in their last bit."""
    import random

    from factmill.operators import store

    rng = random.Random(4)
    groups = {
        "ties": [1.0] * 50 + [2.0] * 7, "one": [3.5], "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0], "close": [1.0, 1.0000000000000002, 1.0000000000000004, 0.9999999999999999],
        "many": [rng.gauss(0, 1) for _ in range(300)] + [1e12], None: [float(i) for i in range(20)],
    }
    values = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "tier string, value double").repartition(5)
    for share in (0.0, 0.3, 0.5, 0.95, 1.0):
        place = {g: max(1, round(share * len(vs))) for g, vs in groups.items()}
        got = store.selected(values, spark.createDataFrame(list(place.items()), "tier string, place long"), "tier", "value").collect()
        assert {r["tier"]: r["value"] for r in got} == {g: sorted(vs)[place[g] - 1] for g, vs in groups.items()}
    assert store.selected(values.limit(0), spark.createDataFrame([("x", 1)], "tier string, place long"), "tier", "value").collect() == []
    assert {r["tier"]: r["p95"] for r in store.audit_performance(values.where("tier IN ('one', 'ties')")).collect()} == {"one": None, "ties": 2.0}


def test_safety_routes_of_every_state(spark):
    from factmill.operators import safety

    kinds = [("high", 3), ("medium", 2), ("low", 1), ("none", 0), ("down", 3), ("other", 0)]
    rows = [(i, "medication" if k != "other" else "note", k, "active", "active", i == 0, far, k != "down") for i, (k, far) in enumerate((k, far) for k, _ in kinds for far in (False, True))]
    df = spark.createDataFrame([*rows, (99, None, None, None, None, None, None, None)], "id long, fact_type string, name string, status string, tier string, requires_review boolean, far boolean, up boolean")
    found = spark.createDataFrame([(0, "HIGH", 1), (1, "HIGH", 2), (1, "LOW", 1), (2, "MEDIUM", 1), (3, "MEDIUM", 1), (4, "LOW", 1), (5, "LOW", 1), (8, "HIGH", 1)], "id long, severity string, n int")
    got = {r["id"]: r for r in safety.routed(df, found, F.col("far"), F.col("up")).collect()}
    assert [got[i]["decision"] for i in range(12)] == ["block", "block", "review", "warn", "allow", "allow", "allow", "allow", "pending", "queue", "allow", "allow"]
    assert [got[i]["status"] for i in range(12)] == ["active", "active", "pending_medication_review", "active", "active", "active", "active", "active", "pending_ddi_check", "pending_ddi", "active", "active"]
    assert got[1]["n_findings"] == 3 and got[8]["n_findings"] == 0 and got[0]["requires_review"] and got[2]["tier"] == "quarantined"
    assert got[1]["ddi_message"].startswith("HIGH SEVERITY INTERACTION: high interacts") and got[3]["ddi_message"] is None
    assert (got[99]["decision"], got[99]["outcome"], got[99]["ddi_status"]) == ("allow", "kept", None)


def test_vector_search_in_strips(spark):
    """More rows than a strip, rows without a vector, and a part that has none at all, against plain cosines."""
    import numpy as np

    from factmill.operators import vector

    values = np.random.default_rng(3).normal(size=(vector.STRIP + 40, 4))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    schema = "vec_id long, embedding array<double>"
    none = spark.createDataFrame([(9001, None), (9002, None)], schema).coalesce(1)
    df = spark.createDataFrame(rows, schema).coalesce(1).unionByName(none)
    asked = df.where("vec_id % 90 = 0 AND vec_id < 9000")
    unit = values / np.linalg.norm(values, axis=1, keepdims=True)
    plain = unit @ unit.T
    ids = [i for i, _ in rows if i % 90 == 0]
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in vector.top_k(asked, df, 3).collect()}
    assert got == {(i, k + 1): int(j) for i in ids for k, j in enumerate(np.argsort(-plain[i])[:3])}
    assert {(r["query_id"], r["vec_id"], r["similarity"]) for r in vector.top_k(asked, none, 1).collect()} == {(i, 9001, 0.0) for i in ids}
    near = {(r["query_id"], r["vec_id"]) for r in vector.range_search(asked, df, 0.9).collect()}
    assert near == {(i, int(j)) for i in ids for j in np.flatnonzero(plain[i] >= 0.9)}


def test_web_pages_one_by_one(spark):
    from factmill.sources.tables import web_pages

    html = ["<article>" + "word " * 100 + "</article>", None, "", "<p>a</p><nav>b</nav>"]
    got = web_pages(spark.createDataFrame(list(enumerate(html)), "page_id int, html string")).orderBy("page_id")
    assert [r["text"] for r in got.collect()] == [page_text(h) for h in html]


def test_web_pages_whole(spark):
    from factmill.sources.tables import web_pages

    words = [f"word{i}" for i in range(5000)]
    html = [f"<nav>menu</nav><article><p>{' '.join(words)}</p></article>", f"<p>{'</p><p>'.join(words)}</p>"]
    got = web_pages(spark.createDataFrame(list(enumerate(html)), "page_id int, html string")).orderBy("page_id")
    assert [r["text"] for r in got.collect()] == [" ".join(words)] * 2
