"""First conflicts of facts without pairs, against all pairs in plain Python."""

import random
import time
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from factmill import config as C
from factmill.operators import dedup

FACT = "id long, ord long, subject_id long, entity_type string, entity_name string, value double, unit string, date date"


def plain_firsts(new, existing, earlier):
    """{(id, kind): match_id} with the canonical names of the engine's own tables."""
    canon = {a: c for a, c in C.ALIAS_PAIRS}
    key = lambda n: canon.get(n, n)

    def excludes(a, b):
        has = lambda n, words: any(w in n for w in words)
        return any((has(a, x) and has(b, y)) or (has(b, x) and has(a, y)) for x, y in C.EXCLUSIVE)

    out = {}
    for i, o, s, t, n, v, _, d in new:
        for i2, o2, s2, t2, n2, v2, _, d2 in sorted(existing, key=lambda r: (r[1], r[0])):
            if s != s2 or t != t2 or (earlier and o2 >= o):
                continue
            kinds = []
            a, b = (n or "").lower().strip(), (n2 or "").lower().strip()
            if excludes(a, b):
                kinds.append(1)
            if key(a) == key(b) and None not in (v, v2, d, d2):
                gap, most = abs((d - d2).days), max(abs(v), abs(v2))
                if gap <= 1 and most > 0 and abs(v - v2) / max(most, 1e-9) > 0.02:
                    kinds.append(2)
                if any(key(b) == e and gap < days and abs(v - v2) > change for e, days, change in C.IMPLAUSIBLE):
                    kinds.append(3)
            for k in kinds:
                out.setdefault((i, k), i2)
    return out


def invented(seed, n, start=0):
    rng = random.Random(seed)
    names = ["weight", "Weight", "bp", "HbA1c", "a1c", "temp", "acute pain", "chronic pain", "benign left cyst", "malignant cyst", "right cyst", None, "pulse"]
    values = [None, 0.0, -0.0, 1.0, 0.98, 49.0, 50.0, 51.0, 98.0, 100.0, 102.0, -49.0, -50.0, -51.0, 7.0, 9.0, 9.0000001, 5.0, 10.0, 1e-12, 36.6, 38.6, 38.7, 0.1, 0.3, 2.3, 2.1]
    return [(start + i, rng.randrange(n), rng.randrange(3), rng.choice(["measurement", "diagnosis"]), rng.choice(names), rng.choice(values), None, rng.choice([None] + [date(2024, 1, 1) + timedelta(days=x) for x in range(0, 70, 3)] + [date(2024, 1, 2)])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("earlier", [True, False])
def test_firsts_against_all_pairs(spark, seed, earlier):
    old = invented(seed, 250)
    new = old if earlier else invented(seed + 10, 250, 1000)
    order = {r[0]: r[1] for r in old}
    frame = lambda rows: spark.createDataFrame(rows, FACT)
    got = {(r["id"], r["kind"]): order[r["match_id"]] for r in dedup.first_conflicts(frame(new), frame(old), earlier).collect()}
    assert got == {k: order[m] for k, m in plain_firsts(new, old, earlier).items()}


def test_limits_that_are_values(spark):
    """49 and 50 are exactly two per cent apart and don't differ; 5 kg in a week is not over 5."""
    day = date(2024, 1, 1)
    rows = [(0, 0, 1, "m", "pulse", 50.0, None, day), (1, 1, 1, "m", "pulse", 49.0, None, day), (2, 2, 1, "m", "pulse", 48.9, None, day), (3, 3, 2, "m", "weight", 300.0, None, day), (4, 4, 2, "m", "weight", 305.0, None, day), (5, 5, 2, "m", "weight", 299.9, None, day)]
    df = spark.createDataFrame(rows, FACT)
    assert {(r["id"], r["kind"], r["match_id"]) for r in dedup.first_conflicts(df, df).collect()} == {(2, 2, 0), (5, 3, 4)}


def test_one_subject_of_very_many_facts(spark):
    """200,000 facts of one entity, most of them on few days: the pairs would be 20,000,000,000."""
    facts = spark.range(200_000).select(
        "id", F.col("id").alias("ord"), F.lit(1).cast("long").alias("subject_id"), F.lit("measurement").alias("entity_type"), F.lit("weight").alias("entity_name"),
        (60 + F.col("id") % 997 / 1000).alias("value"), F.lit("kg").alias("unit"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("date"),
    )
    odd = spark.createDataFrame([(200_000, 200_000, 1, "measurement", "weight", 90.0, "kg", date(2024, 1, 5))], FACT)
    began = time.time()
    got = dedup.first_conflicts(facts.unionByName(odd), facts.unionByName(odd)).collect()
    assert {(r["id"], r["kind"]) for r in got} == {(200_000, 2), (200_000, 3)} and time.time() - began < 120
    assert {r["match_id"] for r in got if r["kind"] == 2} == {3}
    assert {r["match_id"] for r in got if r["kind"] == 3} == {0}


@pytest.mark.parametrize("earlier", [True, False])
def test_text_values_against_all_pairs(spark, earlier):
    rng = random.Random(6)
    said = [None, "", "mild", " MILD", "severe", "7", "7.0", "8"]
    rows = [(i, i, rng.randrange(2), "symptom", rng.choice(["pain", "cough"]), rng.choice([None, None, 7.0]), None, rng.choice([None] + [date(2024, 1, x) for x in range(1, 9)]), rng.choice(said)) for i in range(120)]
    df = spark.createDataFrame(rows, FACT + ", value_text string")

    def value(r):
        text = " ".join((r[8] or "").lower().split())
        return r[5] if r[5] is not None else float(text) if text[:1].isdigit() else text or None

    want = {}
    for n in rows:
        for e in rows:
            a, b = value(n), value(e)
            if n[2] != e[2] or n[4] != e[4] or None in (a, b, n[7], e[7]) or abs((n[7] - e[7]).days) > 1 or (earlier and e[1] >= n[1]):
                continue
            differ = abs(a - b) / max(abs(a), abs(b)) > 0.02 if isinstance(a, float) and isinstance(b, float) else a != b
            if differ:
                want.setdefault(n[0], e[0])
    got = {}
    for r in dedup.first_conflicts(df, df, earlier).collect():
        got[r["id"]] = min(r["match_id"], got.get(r["id"], r["match_id"]))
    assert got == want and len(want) > 30


def test_no_table_of_facts_is_broadcast(spark, tmp_path):
    """Small files hold many facts: only the fixed rules of drugs may be sent through the driver."""
    rows = [(i, i, i % 3, "medication", "warfarin", 1.0 * i, None, date(2024, 1, 1)) for i in range(9)]
    spark.createDataFrame(rows, FACT).write.parquet(f"{tmp_path}/facts")
    df = spark.read.parquet(f"{tmp_path}/facts")
    joins = lambda x: x._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")
    for f in (dedup.exact_matches, dedup.temporal_conflicts, dedup.first_exclusive, dedup.first_value_conflicts, dedup.first_text_conflicts, dedup.paired_conflicts):
        assert joins(f(df, df)) == 0, f.__name__
    assert joins(dedup.drug_conflicts(df, df)) == 1
