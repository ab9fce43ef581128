"""The record store, the ordered gate against a loop in plain Python, and the writer."""

import random

import pytest
from pyspark.sql import functions as F

from factmill.operators import gate, writer
from factmill.operators.promote import word_overlap
from factmill.sources.recordstore import RecordStore, Table

as_of = lambda: F.lit("2024-06-01").cast("date")
RECORD = "id long, fact_type string, specialty string, name string, content string, trust_level int, source_count int, confidence double, first_recorded timestamp_ntz, status string, tier string, requires_review boolean, source_type string"
FACTS = ("diagnosis", "medication", "test_result", "symptom", "note", "recommendation", "relationship", "event")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_store_merges_deltas_and_repeats_no_batch(spark, tmp_path):
    held = RecordStore(spark, str(tmp_path), {"a": Table("id long, v string", "id"), "log": Table("e string")}, 4)
    change = lambda rows: spark.createDataFrame(rows, "id long, v string, seq long, _deleted boolean")
    log = lambda *e: spark.createDataFrame([(x,) for x in e], "e string")
    assert held.read("a").collect() == [] and held.compact("a") is None
    assert held.commit({"a": change([(i, "x", 0, None) for i in range(40)]), "log": log("one", "one")}, "s", 0, "seq") == 1
    assert held.compact("a") == 2 and held.compact("a") is None
    assert held.commit({"a": change([(1, "y", 1, None), (1, "z", 2, False), (1, "w", None, True), (2, None, 1, True), (99, "new", 1, False)]), "log": log("two")}, "s", 1, "seq") == 3
    want = sorted([(i, "x") for i in range(3, 40)] + [(0, "x"), (1, "z"), (99, "new")])
    assert rows_of(held.read("a")) == want
    assert held.commit({"a": change([(1, "again", 9, False)]), "log": log("two")}, "s", 1, "seq") is None
    assert held.commit({"a": change([]), "log": log()}, "s", 2) == 4
    assert rows_of(held.read("a")) == want and rows_of(held.read("log")) == [("one",), ("one",), ("two",)]
    assert held.read("a", 1).count() == 40 and held.read("log", 2).count() == 2
    before = held.compact("a")
    assert rows_of(held.read("a")) == want and rows_of(held.read("a", 3)) == want
    (tmp_path / "a" / "d9-never-committed").mkdir()
    assert held.expire(1) > 0 and held.versions() == [before] and not (tmp_path / "a" / "d9-never-committed").exists()
    assert rows_of(held.read("a")) == want and held.read("log").count() == 3
    with pytest.raises(ValueError):
        held.read("a", 1)
    with pytest.raises(ValueError):
        RecordStore(spark, str(tmp_path), held.tables, 8).read("a")


def test_store_reads_few_buckets_and_refuses_rivals(spark, tmp_path):
    held = RecordStore(spark, str(tmp_path), {"a": Table("id long, v string", "id")}, 16)
    rows = spark.range(200).select("id", F.lit("x").alias("v"))
    held.commit({"a": rows}, "s", 0)
    held.compact("a")
    few = held.lookup("a", spark.createDataFrame([(5,), (5,), (777,)], "id long"))
    assert rows_of(few) == [(5, "x")] and 0 < len(few.inputFiles()) <= 2
    patches = spark.createDataFrame([(5, "p"), (6, None), (777, "q")], "id long, v string")
    assert rows_of(held.patched("a", patches)) == [(5, "p"), (6, "x")]
    state = held.manifest()
    state["version"] += 1
    held._commit(dict(state))
    with pytest.raises(Exception, match="(?i)exists"):
        held._commit(dict(state))
    with pytest.raises(Exception, match="null key"):
        held.commit({"a": spark.createDataFrame([(None, "x")], "id long, v string")}, "s", 5)
    with pytest.raises(ValueError):
        RecordStore(spark, str(tmp_path), {"a": Table("id long, _Deleted string", "id")})


def same(a, b):
    if a["name"] and (a["name"] or "").lower() == (b["name"] or "").lower():
        return True
    x, y = set(a["content"].lower().split()), set(b["content"].lower().split())
    return len(x) > 2 and len(y) > 2 and len(x & y) / max(len(x), len(y)) > 0.7


def norm(t):
    return " ".join(t.lower().split())


def rule(c, e):
    a, b = c["trust_level"], e["trust_level"]
    if b == 1 and a > 1:
        return "kept_existing"
    if a == 1 and b > 1:
        return "replaced"
    if (b, a) == (2, 3):
        return "kept_existing"
    if (a, b) == (2, 3):
        return "replaced"
    if a == b and abs((c["first_recorded"] - e["first_recorded"]).days) > 90:
        return "replaced" if c["first_recorded"] > e["first_recorded"] else "kept_existing"
    if c["source_count"] > e["source_count"] and c["source_count"] >= 2:
        return "replaced"
    return "merged" if c["fact_type"] == e["fact_type"] == "test_result" else "quarantined"


def plain_gate(candidates, existing, near):
    """Candidate by candidate over all that is held, without groups: (id, decision, match_id, content, status, tier, requires_review)."""
    held, out = [dict(e) for e in existing], []
    for c in map(dict, candidates):
        verdict = lambda d, m=None: out.append((c["id"], d, m, c["content"], c["status"], c["tier"], c["requires_review"]))  # noqa: B023,E731
        if c["confidence"] < 0.35:
            verdict("confidence_below_threshold")
            continue
        if len((c["content"] or "").strip()) < 5:
            verdict("content_too_short")
            continue
        if c["fact_type"] not in FACTS:
            verdict("invalid_fact_type")
            continue
        block = [e for e in held if e["status"] == "active" and (e["fact_type"], e["specialty"]) == (c["fact_type"], c["specialty"])]
        twin = next((e for e in block if norm(e["content"]) == norm(c["content"])), None)
        if twin:
            verdict("duplicate", twin["id"])
            continue
        vectors = {e["id"]: (p, e) for p, e in enumerate(held) if not e["requires_review"] and e["tier"] not in ("quarantined", "superseded")}
        found = sorted((-s, vectors[o][0]) for (i, o), s in near.items() if i == c["id"] and o in vectors)
        old = held[found[0][1]] if found else None
        if old and old["trust_level"] == c["trust_level"]:
            verdict("near_duplicate", old["id"])
            continue
        if old is None:
            old = next((e for e in block if same(c, e)), None)
            waits = [e for e in held if e["requires_review"] and (e["fact_type"], e["specialty"]) == (c["fact_type"], c["specialty"]) and same(c, e)]
            if old and waits:
                verdict("pending_review_exists", old["id"])
                continue
        if old is None:
            verdict("approved")
            held.append(c)
            continue
        d = rule(c, old)
        if d == "quarantined":
            c |= {"status": "quarantined", "tier": "quarantined", "requires_review": True}
        if d == "merged":
            c["content"] = f"{c['content']} [merged with: {old['content']}]"
        verdict(d, old["id"])
        if d in ("replaced", "merged"):
            old |= {"status": "superseded", "tier": "superseded"}
        if d != "kept_existing":
            held.append(c)
    return out


def records(seed, n, words, names, kinds):
    from datetime import datetime, timedelta

    rng = random.Random(seed)
    fields = [f.split()[0] for f in RECORD.split(", ")]
    out = []
    for i in range(n):
        content = " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4, 6])))
        if rng.random() < 0.1 and out:
            content = out[rng.randrange(len(out))]["content"].upper() + "  "
        row = (i, rng.choice(kinds), rng.choice(["a", "b"]), rng.choice(names), content, rng.randint(1, 5), rng.randint(1, 3), rng.choice([0.2, 0.5, 0.9]), datetime(2020, 1, 1) + timedelta(days=rng.randrange(300)), rng.choice(["active"] * 4 + ["conflicted"]), rng.choice(["active", "hypothesis"]), rng.random() < 0.06, "web")
        out.append(dict(zip(fields, row, strict=True)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_gate_against_a_plain_loop(spark, seed):
    words = [f"w{i}" for i in range((9, 14, 40)[seed - 1])]
    every = records(seed, 260, words, [None, "", "x", "X", *"yzuvw"], ["test_result", "medication", "note", "rumour"])
    if seed == 3:
        every = records(seed, 260, words, [f"n{i}" for i in range(90)], ["test_result"])
    rng = random.Random(seed)
    near = {}
    for _ in range(25):
        a, b = rng.sample(range(260), 2)
        near[a, b] = near[b, a] = rng.choice([0.93, 0.95, 0.97])
    old, new = every[:90], every[90:]
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], RECORD)
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in near.items() if a < b], "id long, other_id long, similarity double")
    got = gate.ordered_gate(frame(new), frame(old), as_of(), pairs)
    assert rows_of(got.select("id", "decision", "match_id", "content", "status", "tier", "requires_review")) == sorted(plain_gate(new, old, near))
    without = gate.ordered_gate(frame(new), frame(old).limit(0), as_of())
    assert rows_of(without.select("id", "decision", "match_id", "content", "status", "tier", "requires_review")) == sorted(plain_gate(new, [], {}))


def test_merges_that_reach_another_group(spark):
    """A merged text is the entity of a record that neither of its parts is."""
    from datetime import datetime

    day = datetime(2024, 1, 1)
    row = lambda i, name, content: (i, "test_result", "a", name, content, 3, 1, 0.9, day, "active", "active", False, "web")
    fields = [f.split()[0] for f in RECORD.split(", ")]
    new = [row(1, "x", "a1 a2 a3"), row(2, "x", "b1 b2 b3"), row(3, "y", "a1 a2 a3 b1 b2 b3 [merged with:")]
    texts = spark.createDataFrame([(r[0], r[4], "a") for r in new], "id long, text string, block string")
    assert word_overlap(texts).count() == 0
    frame = spark.createDataFrame(new, RECORD)
    got = gate.ordered_gate(frame, frame.limit(0), as_of())
    want = plain_gate([dict(zip(fields, r, strict=True)) for r in new], [], {})
    assert [w[1] for w in want] == ["approved", "merged", "merged"]
    assert rows_of(got.select("id", "decision", "match_id", "content", "status", "tier", "requires_review")) == sorted(want)


def test_gate_on_empty_tables(spark):
    none = spark.createDataFrame([], RECORD)
    assert gate.ordered_gate(none, none, as_of()).collect() == []
    odd = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, None, None, None, None), (2, "note", None, None, "long enough", None, None, None, None, None, None, None, None)], RECORD)
    assert {r["id"]: r["decision"] for r in gate.ordered_gate(odd, odd.where("id = 0"), as_of()).collect()} == {1: "content_too_short", 2: "approved"}


def test_writer_commits_all_tables_of_a_batch(spark, tmp_path):
    from datetime import datetime

    day = datetime(2015, 1, 1)
    row = lambda i, kind, name, content, trust, conf=0.9: (i, kind, "a", name, content, trust, 1, conf, day, "active", "active", False, "web")
    old = spark.createDataFrame([row(1, "note", "x", "one two three", 3), row(2, "medication", "m", "drug five mg", 3)], RECORD)
    new = spark.createDataFrame([row(11, "note", "x", "four five six", 1), row(12, "medication", "m", "drug ten mg", 3), row(13, "note", "z", "short conf", 3, 0.1), row(14, "note", "x", "Four five  six", 4)], RECORD)
    held = RecordStore(spark, str(tmp_path), writer.tables(old.schema), 4)
    assert writer.load(held, old) == 1 and writer.load(held, old) is None
    assert writer.write_batch(held, new, as_of(), 1) == 2 and writer.write_batch(held, new, as_of(), 1) is None
    got = {r["id"]: (r["status"], str(r["last_confirmed"]), list(r["tags"])) for r in held.read("records").collect()}
    assert got == {1: ("superseded", "2024-06-01", []), 2: ("active", "2015-01-01", []), 11: ("active", "2024-06-01", ["possibly_outdated"]), 12: ("quarantined", "2015-01-01", ["possibly_outdated"])}
    assert rows_of(held.read("vectors")) == [(2, "drug five mg"), (11, "four five six")]
    assert sorted((r["event_type"], r["record_id"]) for r in held.read("ledger").collect()) == [("dedup_confirm", 14), ("quality_reject", 13), ("truth_resolution", 2), ("truth_resolution", 2), ("truth_resolution", 11)]
    assert rows_of(held.read("queue").select("id", "reason")) == [(12, "quarantined"), (13, "confidence_below_threshold")]
    assert held.read("records", 1).count() == 2


def test_sinks(spark, tmp_path):
    from factmill.sources import sinks

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, route string")
    for _ in range(2):
        sinks.append_json(rows, str(tmp_path / "log"))
        sinks.write_routes(rows, str(tmp_path / "routes"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert spark.read.parquet(str(tmp_path / "routes")).where("route = 'b'").count() == 2
