"""Centroid clustering and vector codes against exact searches in Python integers, and on awkward rows."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factmill.llm import centroids, codes

VECTORS = "vec_id long, embedding array<double>, label int, id string, v string, e int, k int, n int, s string, cluster string, code string, l int, salt int"
REST = ("a", "b", 1, 2, 3, "c", "d", "e", 4, 5)


def table(spark, rows):
    """Extra columns have names that operators use inside."""
    return spark.createDataFrame([(i, v, lab, *REST) for i, v, lab in rows], VECTORS)


def far(a, b):
    return sum((int(x) - int(y)) ** 2 for x, y in zip(a, b, strict=True))


def plain_nearest(x, c):
    return [min((far(v, e), k) for k, e in enumerate(c)) for v in x]


def moved(x, at, c):
    out = []
    for k, old in enumerate(c):
        own = [v for v, a in zip(x, at, strict=True) if a == k]
        out.append([sum(col) // len(own) for col in zip(*own, strict=True)] if own else old)
    return out


def plain_clusters(rows, clusters, rounds, dims, scale, seed):
    good = [(i, [math.floor(scale * float(x)) for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    x, c = [v for _, v in good], [v for _, v in sorted(good, key=key)[:clusters]]
    for _ in range(rounds):
        c = moved(x, [k for _, k in plain_nearest(x, c)], c)
    at = plain_nearest(x, c)
    total = {k: sum(d for d, a in at if a == k) for k in range(len(c))}
    shas = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in c]
    return [(i, k, d, total[k], sum(total.values()), shas[k]) for (i, _), (d, k) in zip(good, at, strict=True)]


def plain_codes(rows, parts, entries, rounds, scale):
    good = [(i, [math.floor(scale * float(x)) for x in v], lab) for i, v, lab in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    dims = len(min(good, key=lambda r: (r[0] is None, r[0] or 0, len(r[1])))[1])
    good = [r for r in good if len(r[1]) == dims]
    w = dims // parts
    books = [[r[1][p * w : (p + 1) * w] for r in sorted(good, key=order)[:entries]] for p in range(parts)]
    cut = lambda p: [r[1][p * w : (p + 1) * w] for r in good]
    for _ in range(rounds):
        books = [moved(cut(p), [k for _, k in plain_nearest(cut(p), books[p])], books[p]) for p in range(parts)]
    at = [plain_nearest(cut(p), books[p]) for p in range(parts)]
    error = [sum(at[p][j][0] for p in range(parts)) for j in range(len(good))]
    labels = {lab: sum(e for e, r in zip(error, good, strict=True) if r[2] == lab) for _, _, lab in good}
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{at[p][j][1]:02x}" for p in range(parts)), error[j], labels[r[2]], sha) for j, r in enumerate(good)]


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in row)


def odd_rows(dims, seed=5):
    """Ties, repeated rows and ids, null ids and labels, wrong lengths, nulls, NaN and infinities; half of all rows are one vector."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.integers(-3, 4, dims).astype(float).tolist(), int(i) % 3 if i % 5 else None) for i in range(60)]
    rows += [(100 + i, [0.5] * dims, 1) for i in range(60)]
    rows += [rows[3], rows[3], (4, [9.0] * dims, 2), (None, [1.0] * dims, None), (None, [-2.0] * dims, 1)]
    bad = [None, [], [1.0] * (dims - 1), [1.0] * (2 * dims), [None] + [0.0] * (dims - 1), [float("nan")] + [0.0] * (dims - 1), [float("inf")] * dims]
    return rows + [(200 + i, v, i) for i, v in enumerate(bad)]


@pytest.mark.parametrize("clusters", [1, 8, 500])
def test_clusters_against_plain_integers(spark, clusters):
    rows = odd_rows(6)
    got = centroids.cluster_vectors(table(spark, rows).repartition(3), clusters=clusters, rounds=4, dims=6, scale=2)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_clusters(rows, clusters, 4, 6, 2, 3), key=key)


@pytest.mark.parametrize("entries", [1, 7, 256])
def test_codes_against_plain_integers(spark, entries):
    rows = odd_rows(8)
    got = codes.compress_vectors(table(spark, rows).repartition(3), parts=4, entries=entries, rounds=2, scale=2)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint", "string", "bigint", "bigint", "string"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_codes(rows, 4, entries, 2, 2), key=key)


def test_empty_and_unusable_tables(spark):
    for rows in ([], [(1, None, 1), (2, [float("nan")] * 64, None), (3, [], 2)]):
        assert centroids.cluster_vectors(table(spark, rows)).collect() == []
        assert codes.compress_vectors(table(spark, rows)).collect() == []


def test_components_that_leave_64_bits_are_an_error(spark):
    rows = [(1, [1e30] * 64, 1)]
    for run in (centroids.cluster_vectors, codes.compress_vectors):
        with pytest.raises(Exception, match="is beyond"):
            run(table(spark, rows)).collect()
    big = (centroids.largest(64) - 1) / 1024
    rows = [(1, [big] * 64, 1), (2, [-big] * 64, 1)]
    assert {r["distance"] for r in centroids.cluster_vectors(table(spark, rows), clusters=1, rounds=0).collect()} == {0, 64 * (2 * (centroids.largest(64) - 1)) ** 2}


def test_partitions_do_not_matter(spark):
    rows = [r for r in odd_rows(64, 8) if r[0] is not None]
    for run in (lambda t: centroids.cluster_vectors(t, clusters=5), lambda t: codes.compress_vectors(t, entries=9)):
        one = run(table(spark, rows).repartition(1)).collect()
        assert sorted(map(tuple, one)) == sorted(map(tuple, run(table(spark, rows).repartition(7, F.col("vec_id"))).collect()))


numbers = st.integers(-(2**26), 2**26)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_screening_keeps_the_nearest(data):
    dims, k = data.draw(st.integers(1, 5)), data.draw(st.integers(1, 6))
    base = data.draw(st.sampled_from([0, 2**26 - 9]))
    cell = st.one_of(numbers, st.integers(base - 3, base + 3))
    x = np.array(data.draw(st.lists(st.lists(cell, min_size=dims, max_size=dims), min_size=1, max_size=5)), np.int64)
    c = np.array(data.draw(st.lists(st.lists(cell, min_size=dims, max_size=dims), min_size=k, max_size=k)), np.int64)
    want = plain_nearest(x, c)
    may = centroids.screened(x, c)
    assert all(may[i, j] for i, v in enumerate(x) for j, e in enumerate(c) if far(v, e) == want[i][0])
    at, d = centroids.nearest(x, c)
    assert list(zip(d.tolist(), at.tolist(), strict=True)) == want
    at, d = codes.search(x, c)
    assert list(zip(d.tolist(), at.tolist(), strict=True)) == want


def test_screening_leaves_few(monkeypatch):
    """On unit vectors nearly all rows keep one centroid; ties of far apart centroids keep both."""
    rng = np.random.default_rng(1)
    raw = rng.standard_normal((2000, 64))
    x = np.floor(1024 * raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.int64)
    assert (centroids.screened(x, x[:50]).sum(1) == 1).mean() > 0.95
    assert centroids.screened(np.zeros((1, 2), np.int64), np.array([[5, 0], [0, 5], [-50, 0]])).tolist() == [[True, True, False]]


def test_partial_distances_drop_early():
    """Most pairs go before their last dimension."""
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, tuple) and isinstance(at[0], np.ndarray) and isinstance(at[1], int):
                seen.append((at[1], len(at[0])))
            return np.asarray(super().__getitem__(at)) if isinstance(at, tuple) and isinstance(at[0], np.ndarray) else super().__getitem__(at)

    rng = np.random.default_rng(2)
    x, book = rng.integers(-60, 60, (3000, 4)), rng.integers(-60, 60, (64, 4))
    codes.search(x.view(Counted), book)
    steps = {d: sum(n for e, n in seen if e == d) for d in (1, 2, 3)}
    assert steps[1] > steps[2] > steps[3] and steps[3] < 0.2 * x.shape[0] * len(book)


def test_near_duplicates_of_empty_and_clashing_tables(spark):
    from factmill.llm import embeddings

    schema = "vec_id long, embedding array<double>, cls long, v string, id int, dim int, part int, block string, raw int, n int, a int, b int, node int, root int, m int, n_links string, component_id int, kept string"
    rest = (1, "x", 2, 3, 4, "y", 5, 6, 7, 8, 9, 10, 11, "z", 12, "w")
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 0.0], *rest), (2, [2.0, 0.0], *rest), (3, [0.0, 1.0], *rest), (4, None, *rest), (5, [0.0, 0.0], *rest), (6, [], *rest), (7, [float("nan"), 1.0], *rest)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, schema)).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 1, False), *((i, 0, i, True) for i in range(3, 8))]
