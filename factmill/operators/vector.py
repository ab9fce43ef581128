"""Vector search over array columns: cosine, top-k for a query set, and best match over a threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows that meet a block of queries at a time, so that a worker's matrices don't grow with a batch of rows.
STRIP = 500


def _strips(rows: pa.Array) -> Iterator[tuple[int, list]]:
    """(first row, Python values) of each strip."""
    for lo in range(0, len(rows), STRIP):
        yield lo, rows.slice(lo, STRIP).to_pylist()


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 if one is empty, zero or of another length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0) | norm.isNull(), 0.0).otherwise(dot(a, b) / norm)


def record_text(content: Column, structured: Column) -> Column:
    """What a record's vector is made of: its content and the details that are not blank, in the order of their keys."""
    entries = F.array_sort(F.map_entries(F.map_filter(structured, lambda _, v: F.coalesce(v, F.lit("")) != "")))
    return F.concat_ws(" | ", content, F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"])), " | "))


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10, block: int = 2000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, similarity, rank) of a stated query set against all rows.

    Queries come in blocks of bounded size, each block broadcast; each task keeps k rows of its own for each query, and a window ranks what the
    tasks kept. So the shuffle carries queries x tasks x k rows, never all pairs. Equal similarities go by id.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    keyed = queries.select(id_col, vector_col).withColumn("__b", F.pmod(F.xxhash64(id_col), F.lit(blocks)))
    parts = []
    for b in range(blocks):
        got = keyed.where(F.col("__b") == b).orderBy(id_col).toArrow()
        ids = got.column(id_col)
        q = _matrix(got.column(vector_col).to_pylist())

        def nearest(batches: Iterator[pa.RecordBatch], ids: list = ids.to_pylist(), q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            held_s, held_i = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                for lo, vectors in _strips(batch.column(1)):
                    v = _matrix(vectors, q.shape[1])
                    s = np.concatenate([held_s, q @ v.T], axis=1)
                    i = np.concatenate([held_i, np.tile(batch.column(0).slice(lo, STRIP).to_numpy(), (len(ids), 1))], axis=1)
                    order = np.lexsort((i, -s), axis=1)[:, :k]
                    held_s, held_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            width = held_i.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), width)), pa.array(held_i.ravel()), pa.array(held_s.ravel())], ["query_id", id_col, "similarity"])

        parts.append(rows.select(F.col(id_col).cast("long").alias(id_col), vector_col).mapInArrow(nearest, f"query_id long, {id_col} long, similarity double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = out.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), id_col))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("r", "x")).select("query_id", f"x.{id_col}", (-F.col("x.s")).alias("similarity"), (F.col("r") + 1).alias("rank"))


def range_search(queries: DataFrame, rows: DataFrame, least: float, block: int = 2000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, similarity) of all rows at cosine >= least of a stated query set. Query blocks are packed rows, paired with the
    rows' partitions by a join on a block number, so that the number of scans doesn't grow with the queries."""
    n = queries.count()
    blocks = max(1, -(-n // block))
    asks = queries.select(F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("b"), F.struct(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v")).alias("q"))
    packed = asks.groupBy("b").agg(F.collect_list("q").alias("asked"))  # a block holds about `block` vectors
    chunk = F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(max(1, -(-rows.count() // (8 * block)))))
    held = rows.select(chunk.alias("c"), F.struct(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v")).alias("q")).groupBy("c").agg(F.collect_list("q").alias("held"))
    dealt = held.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one = batch.column(0)[k].as_py()
                asked = _unit([x["v"] for x in one])
                for _, other in _strips(batch.column(1)[k].values):
                    v = _unit([x["v"] for x in other])
                    width = max(asked.shape[1], v.shape[1])
                    q, v = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (asked, v))
                    s = q @ v.T
                    i, j = np.nonzero(s >= least)
                    same = np.array([len(one[a]["v"]) == len(other[b]["v"]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)
                    i, j = i[same], j[same]
                    yield pa.RecordBatch.from_arrays([pa.array([one[a]["i"] for a in i.tolist()], pa.int64()), pa.array([other[b]["i"] for b in j.tolist()], pa.int64()), pa.array(s[i, j])], ["query_id", id_col, "similarity"])

    return dealt.select("asked", "held").mapInArrow(near, f"query_id long, {id_col} long, similarity double")


def _unit(rows: list) -> np.ndarray:
    """Unit rows padded to one length; null, empty, zero and non-finite vectors are zero rows."""
    m = np.zeros((len(rows), max((len(r) for r in rows if r), default=0)))
    for i, r in enumerate(rows):
        if r and None not in r and np.isfinite(r).all():
            m[i, : len(r)] = r
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _matrix(rows: list, width: int | None = None) -> np.ndarray:
    """Unit rows of `width`, or of the longest; a null, empty or zero vector, or one of another length, is a zero row."""
    width = max((len(r) for r in rows if r), default=0) if width is None else width
    m = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        if r and len(r) == width and None not in r:
            m[i] = r
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def near_duplicate(found: DataFrame, least: float) -> DataFrame:
    """(query_id, vec_id, similarity) of the best other row, where it reaches the threshold."""
    other = found.where("query_id <> vec_id")
    best = other.groupBy("query_id").agg(F.max_by(F.struct("vec_id", "similarity"), F.struct("similarity", -F.col("vec_id"))).alias("b")).select("query_id", "b.*")
    return best.where(F.col("similarity") >= least)
