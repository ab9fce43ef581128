"""Centroid clustering in whole numbers, screened by single-precision products with rigorous rounding-error intervals.

Components become whole numbers, so sums, means and distances are exact and every run and every partitioning gives the same rows.
A matrix product in single precision gives each scalar product x.c to within g |x| |c|, g = n u / (1 - n u) with u = 2^-24 and
n = dims + 2, in whatever order it is summed: rounding each of the two factors counts for two, products and sums for dims. Of the
squared distances that leaves intervals. A centroid whose interval begins above the smallest upper end is out; a vector that keeps
one centroid alone is done, for that is proven nearest. All others are compared again in exact integers, the lowest number first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.llm.store import materialize

#: Elements of a block of products, and of exact differences.
CELLS = 2_000_000
#: Unit roundoff of single precision.
UNIT = 2.0**-24


def largest(dims: int) -> int:
    """Magnitude up to which whole components keep every squared distance in 64 bits."""
    return math.isqrt((2**63 - 1) // max(dims, 1)) // 2


def finite(vector: Column) -> Column:
    """Whether the array is there and has neither null nor non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def whole(vector: Column, scale: int, most: int) -> Column:
    """Components x as floor(scale * x) in double precision; an error where one is beyond most, for its distances would not fit 64 bits."""

    def one(x: Column) -> Column:
        scaled = x.cast("double") * float(scale)
        return F.when(F.abs(scaled) < float(most), F.floor(scaled)).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {most}")).cast("long"))

    return F.transform(vector, one)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of longs of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1)


def screened(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which centroids (columns) may be nearest to which vectors (rows); the nearest ones are always among them."""
    centre = c.sum(0) // len(c)  # a shift leaves distances alone and makes the bounds small
    a, b = x - centre, c - centre
    dots = (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.float64)
    n = x.shape[1] + 2
    up = 1 + 2.0**-40
    norm_a, norm_b = (np.sqrt((m.astype(np.float64) ** 2).sum(1)) * up for m in (a, b))
    own = (b.astype(np.float64) ** 2).sum(1)
    scale = norm_a[:, None] * norm_b[None, :]
    # 2 |error of a product|, and what double precision itself loses below.
    off = 2 * (n * UNIT / (1 - n * UNIT)) * up * scale + 2.0**-44 * (own[None, :] + 2 * scale)
    value = own[None, :] - 2 * dots
    return value - off <= (value + off).min(1)[:, None]


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, exact, ties to the lowest number."""
    kinds, first = np.unique(c, axis=0, return_index=True)
    order = np.argsort(first)
    kinds, first = kinds[order], first[order]  # equal centroids: the lowest number stands for all
    out = np.zeros(len(x), np.int64)
    step = max(1, CELLS // len(kinds))
    for s in range(0, len(x), step):
        part = x[s : s + step]
        may = screened(part, kinds)
        best = may.argmax(1)
        open_ = np.flatnonzero(may.sum(1) > 1)
        if len(open_):
            row, k = np.nonzero(may[open_])
            far, width = np.empty(len(row), np.int64), max(1, CELLS // x.shape[1])
            for i in range(0, len(row), width):
                j = slice(i, i + width)
                far[j] = ((part[open_[row[j]]] - kinds[k[j]]) ** 2).sum(1)
            heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            least = np.repeat(np.minimum.reduceat(far, heads), np.diff(np.append(heads, len(row))))
            hit = np.flatnonzero(far == least)
            best[open_] = k[hit[np.unique(row[hit], return_index=True)[1]]]
        out[s : s + step] = first[best]
    return out, ((x - c[out]) ** 2).sum(1)


def sums(x: np.ndarray, number: np.ndarray, count: np.ndarray, total: np.ndarray) -> None:
    """Add the rows of x to total, and their number to count, by number."""
    order = np.argsort(number, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(number[order]) != 0))
    at = number[order][heads]
    count[at] += np.diff(np.append(heads, len(order)))
    total[at] += np.add.reduceat(x[order], heads, axis=0)


def _moved(points: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after one round. A task adds up what it has and sends a row for each centroid it met."""
    dims = c.shape[1]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(0))
                sums(x, nearest(x, c)[0], count, total)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at]), pa.array(list(total[at]), pa.list_(pa.int64()))], ["k", "n", "s"])

    partial = points.select("v").mapInArrow(step, "k int, n long, s array<long>")
    rows = partial.groupBy("k").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(dims))).alias("s")).collect()
    out = c.copy()
    for r in rows:
        out[r["k"]] = np.array(r["s"], np.int64) // r["n"]
    return out


def cluster_vectors(
    vectors: DataFrame, clusters: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector of exactly dims finite components.

    Components x count as floor(scale * x). The first centroids are the vectors whose "seed:id" has the smallest SHA-256. Every round assigns
    each vector to the nearest centroid and moves each centroid that has vectors to the componentwise floor of their mean.

    Null vectors, vectors of another length and those with null or non-finite components are left out. Rows without an id are clustered, but
    start a cluster only if there are too few others. Repeated rows each count; equal ids are ordered by their vectors. Fewer vectors than
    clusters make fewer clusters; an empty table gives an empty one. Further columns, of any name, are ignored. A component beyond 2^27 / scale
    or so, where distances leave 64 bits, is an error.

    What crosses the network is a row of sums for each task and centroid; what comes to the driver are the centroids, clusters * dims numbers.
    """
    v = F.col(f"`{vector_col}`")
    usable = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("e")).where((F.size("e") == dims) & finite(F.col("e")))
    points = materialize(usable.select("id", whole(F.col("e"), scale, largest(dims)).alias("v")), "points")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = points.select(hashed.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()
    schema = "vec_id {}, cluster int, distance long".format(points.schema["id"].dataType.simpleString())
    if not start:
        return points.sparkSession.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    c = np.array([r["v"] for r in start], np.int64)
    for _ in range(rounds):
        before, c = c, _moved(points, c)
        if (before == c).all():  # the rounds left would move nothing
            break

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                k, far = nearest(matrix(batch.column(1)), c)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    done = materialize(points.mapInArrow(assign, schema), "assigned")
    inertia = {r["cluster"]: r["i"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("i")).collect()}
    about = [(k, i, sum(inertia.values()), hashlib.sha256(",".join(map(str, c[k].tolist())).encode()).hexdigest()) for k, i in inertia.items()]
    table = done.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
