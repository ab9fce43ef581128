"""The stored vector index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factmill.operators.vectorindex import VectorIndex

KIND = "vec_id long, embedding array<double>, specialty string, tier string"


def brute(rows: dict, queries: dict, k: int, fits=lambda r: True) -> dict:
    """{(query, row, rank): similarity}"""
    out = {}
    for q, v in queries.items():
        got = []
        for i, (x, *rest) in rows.items():
            if x is not None and len(x) == len(v) and np.any(x) and fits(rest):
                got.append((-round(float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), 9), i))
        out |= {(q, i, r + 1): -s for r, (s, i) in enumerate(sorted(got)[:k])}
    return out


def rows_of(df):
    rows = df.collect()
    assert len({(r[0], r[1]) for r in rows}) == len(rows)
    return pytest.approx({(r[0], r[1], r[3]): r[2] for r in rows}, abs=1e-9)


def test_search_upsert_and_delete(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 4
    rows = {i: ((centres[i % 12] + rng.normal(size=16)).round(4).tolist(), ("urology", "epilepsy")[i % 2], ("active", "hypothesis")[i // 2 % 2]) for i in range(600)}
    rows[600], rows[601] = rows[3], rows[3]  # equal vectors go by id
    rows[602], rows[603], rows[604] = (None, "urology", "active"), ([0.0] * 16, "urology", "active"), ([1.0, 2.0], "urology", "active")
    frame = lambda r: spark.createDataFrame([(i, *x) for i, x in r.items()], KIND)
    index = VectorIndex.build(frame(rows), f"{tmp_path}/index")
    queries = {i: rows[i][0] for i in range(0, 600, 50)} | {1000: rng.normal(size=16).tolist()}
    asked = spark.createDataFrame(list(queries.items()), "vec_id long, embedding array<double>")
    assert rows_of(index.search(asked, 7)) == brute(rows, queries, 7)
    fits = (F.col("specialty") == "urology") & (F.col("tier") == "active")
    assert rows_of(index.search(asked, 7, fits)) == brute(rows, queries, 7, lambda r: r == ["urology", "active"])

    moved = {i: ((-np.array(rows[i][0])).tolist(), "urology", "active") for i in (3, 50, 51, 100)} | {5: (None, "urology", "active")}
    gone = spark.range(200, 300).withColumnRenamed("id", "vec_id")
    assert index.write(frame(moved), gone, 1)
    assert not index.write(frame({7: rows[8]}), None, 1)
    with pytest.raises(ValueError):
        index.write(frame(moved), None, -1)
    assert index.write(frame({250: rows[8]}), None, 2)
    now = {i: r for i, r in (rows | moved).items() if not 200 <= i < 300} | {250: rows[8]}
    assert rows_of(index.search(asked, 7)) == brute(now, queries, 7)
    assert rows_of(index.search(asked.where("vec_id = 150"), 1000)) == brute(now, {150: queries[150]}, 1000)  # k shrinks to what there is


def test_cells_are_pruned(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    data = [(i, (centres[i % 20] + 0.05 * rng.normal(size=16)).tolist(), "s", "t") for i in range(800)]
    index = VectorIndex.build(spark.createDataFrame(data, KIND), f"{tmp_path}/index", cells=40)
    asked = spark.createDataFrame([x[:2] for x in data[:1]], "vec_id long, embedding array<double>")
    visits, read = [], index.rows
    monkeypatch.setattr(index, "rows", lambda cells=None: (visits.append(cells), read(cells))[1])
    assert index.search(asked, 5).count() == 5
    visited = {c for v in visits if v for c in v}
    assert visited and len(visited) < read().select("cell").distinct().count() / 2


def test_nothing_to_find(spark, tmp_path):
    one = spark.createDataFrame([(1, [1.0, 0.0], "s", "t")], KIND)
    index = VectorIndex.build(one, f"{tmp_path}/index")
    asked = spark.createDataFrame([(9, [0.0, 0.0]), (10, [1.0]), (11, None), (12, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert rows_of(index.search(asked, 3)) == {(12, 1, 1): 0.0}
    assert index.search(asked, 3, F.col("tier") == "none").count() == 0
    assert index.search(asked.limit(0), 3).count() == 0


def test_packs_are_not_broadcast(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(x) for x in np.random.default_rng(i).normal(size=4)]) for i in range(60)], "vec_id long, embedding array<double>")
    index = VectorIndex.build(rows, f"file://{tmp_path}/index")
    visit, seen = index._visit, []
    index._visit = lambda *a: (seen.append(visit(*a)), seen[-1])[1]
    assert index.search(rows.where("vec_id < 9"), 3).count() == 27
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen]
    assert len(plans) == 2 and not any("BroadcastHashJoin [cell" in p for p in plans)
