"""What the ordered gate writes and joins does not follow the square of the records of a name."""

import random

from pyspark.sql import functions as F

from factmill.operators import gate, groups, promote
from tests.test_writer import RECORD, as_of, plain_gate, records, rows_of

SHOWN = ("id", "decision", "match_id", "content", "status", "tier", "requires_review")


def test_texts_of_one_name_are_not_paired(spark, monkeypatch):
    every = records(5, 120, ["w"], ["x"], ["note", "test_result"])
    for r in every:
        r["content"] = f"{r['fact_type']} x subject {r['id']} level 5"
    sizes, write = {}, gate.materialize
    monkeypatch.setattr(gate, "materialize", lambda df, name: (out := write(df, name), sizes.setdefault(name, []).append(out.count()))[0])
    frame = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], RECORD)
    got = gate.ordered_gate(frame(every[40:]), frame(every[:40]), as_of())
    assert rows_of(got.select(*SHOWN)) == sorted(plain_gate(every[40:], every[:40], {}))
    assert max(sizes["gate_links"]) < 120


def test_pairs_of_unlike_values(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(8)), rng.choice("AB"), rng.randrange(3)) for i in range(150)]
    texts = spark.createDataFrame(rows, "id long, text string, block string, m int")
    m = {r[0]: r[3] for r in rows}
    every = {tuple(r) for r in promote.word_overlap(texts).collect()}
    assert {tuple(r) for r in promote.word_overlap(texts, 0.7, "m").collect()} == {r for r in every if m[r[0]] != m[r[1]]} != every


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    rng = random.Random(3)
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)], "a long, b long")
    one = sorted(map(tuple, groups.components(edges).collect()))
    monkeypatch.setattr(groups, "ONE_TASK", 0)
    assert one == sorted(map(tuple, groups.components(edges).groupBy("node").agg(F.min("root").alias("root")).collect()))


def test_full_gate_compares_its_texts_once(spark, monkeypatch):
    every = records(4, 90, [f"w{i}" for i in range(12)], [None, "x", "y"], ["note", "test_result"])
    frame = spark.createDataFrame([tuple(r.values()) for r in every], RECORD)
    met, meet = [], promote.word_overlap
    monkeypatch.setattr(promote, "word_overlap", lambda texts, *a: (met.append(texts.count()), meet(texts, *a))[1])
    new, old = frame.where("id >= 40"), frame.where("id < 40")
    got = {r["id"]: (r["decision"], r["match_id"]) for r in promote.quality_gate(new, old, as_of()).collect()}
    assert len(met) == 1 and met[0] <= 90
    block = F.concat_ws("/", "fact_type", "specialty").alias("block")
    shape = lambda df: df.select("id", "name", "content", block)
    entity = {r["id"]: r["match_id"] for r in promote.same_entity(shape(new), shape(old.where("status = 'active'"))).collect()}
    waiting = {r["id"] for r in promote.same_entity(shape(new), shape(old.where("requires_review"))).collect()}
    asked = {i: d for i, d in got.items() if d[0] in ("pending_review_exists", "conflict", "approved")}
    assert asked == {i: ("approved", None) if i not in entity else ("pending_review_exists" if i in waiting else "conflict", entity[i]) for i in asked}
    assert len({d[0] for d in asked.values()}) > 1
