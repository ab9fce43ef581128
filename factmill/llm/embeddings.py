"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors at cosine c are at squared distance 2 - 2c. After a random rotation the dimensions are split into blocks; two vectors within
the distance are, in at least one block, within that block's proportional share of the squared distance. Each block is
range-joined: bounded pivots cut its space into cells, a vector lives in the cell of its nearest pivot and visits every cell
whose bisector is within the block's radius, so no pair is missed. Those at home in a cell, and its guests, are cut into chunks of bounded size. The union of
candidates is verified in double precision where it is found; a pair that several blocks find is counted by the first, so
cells emit link counts and a forest of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.operators.groups import components
from factmill.llm.kernels import U, grouped, mix, utf8
from factmill.llm.store import materialize

BLOCKS = 4
#: Vectors to a pivot and bounds of the number of pivots. Few large cells: their number decides how often a vector is sent, while the share of pairs that they rule out hardly depends on it.
PER_PIVOT, PIVOTS_LEAST, PIVOTS_MOST = 16_000, 4, 512
#: Vectors in a chunk of those at home in a cell or of its guests, and distances and pairs of vectors that a task holds at a time.
CHUNK, STRIP, PAIRS = 32_000, 4_000_000, 100_000
#: What a vector does in a block: it asks the later ones of its kind and all that are only asked; it asks the latter; it is only asked.
BOTH, ASKS, ASKED = 0, 1, 2
#: What single precision may be off by in squared block distances and in the distance to a bisector.
SLACK = 1e-5


def rotation(dim: int, seed: int = 97) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def bounds(dim: int) -> np.ndarray:
    """First dimensions of the blocks."""
    return np.unique(np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int))


def _turned(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, their rotation in single precision). Rows are turned one by one: a row's result is the same whatever
    rows stand beside it, so every task that turns a vector finds the same numbers."""
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    return unit, (unit[:, None, :] @ rotation(raw.shape[1]))[:, 0].astype(np.float32)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x, np.float64) for x in column.to_pylist()]


def _visits(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], least: float) -> Iterator[tuple]:
    """(batch, dim, part, rows of the batch, row of each visit among them, its cell, whether it is at home there, raw) of a batch's vectors: each in its home cell and in the earlier cells that it visits."""
    for batch in batches:
        rows = _vectors(batch.column(2))
        sizes = np.array([len(r) for r in rows])
        for dim in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == dim)
            raw = np.stack([rows[i] for i in own])
            _, turned = _turned(raw)
            edge = bounds(dim)
            _, centre = _turned(pivots[dim])
            for part, (s, e) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                radius = np.sqrt((2 - 2 * least) * (e - s) / dim + SLACK)
                x, p = turned[:, s:e].astype(np.float64), centre[:, s:e].astype(np.float64)
                far = (x**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2 * x @ p.T
                home = far.argmin(1)
                apart = np.sqrt(np.maximum((p**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2 * p @ p.T, 1e-18))
                gap = (far - far[np.arange(len(x)), home][:, None]) / (2 * apart[home])
                visits = (gap <= radius + SLACK) & (np.arange(len(p))[None, :] < home[:, None])
                visits[np.arange(len(x)), home] = True
                i, cell = np.nonzero(visits)
                yield batch, dim, part, own, i, cell, home[i] == cell, raw


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row of numbers as one binary value."""
    at = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _deal(vectors: DataFrame, pivots: dict[int, np.ndarray], least: float, single: bool) -> DataFrame:
    """(block, part, side, cls, mult, raw). Those at home in a cell and its guests are split by hash into chunks of about CHUNK, and a block is what two chunks
    need to meet: two chunks at home, or one at home and one of guests, for guests never meet each other. The first guests go where a chunk
    meets itself. So a guest is sent once to a cell for each chunk at home there, of which there is mostly one. A first pass counts both kinds in each cell; the counts are at most PIVOTS_MOST for each part and length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, int] = {}
        for _, dim, part, _, _, cell, homed, _ in _visits(batches, pivots, least):
            for k, n in zip(*(x.tolist() for x in np.unique(cell * 2 + homed, return_counts=True)), strict=True):
                total[dim, part, k] = total.get((dim, part, k), 0) + n
        keys = list(total)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int32()) for i in range(3)), pa.array(list(total.values()), pa.int64())], ["dim", "part", "kind", "n"])

    narrow = vectors.select("cls", "mult", "v")
    counted = narrow.mapInArrow(count, "dim int, part int, kind int, n long").groupBy("dim", "part", "kind").agg(F.sum("n").alias("n")).collect()
    chunks = {(r["dim"], r["part"], r["kind"]): -(-r["n"] // CHUNK) for r in counted}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, dim, part, own, i, cell, homed, raw in _visits(batches, pivots, least):
            cls, mult = batch.column(0).to_numpy()[own], batch.column(1).to_numpy()[own]
            kept = raw.astype(np.float32) if single else raw
            guests, homes = (np.array([chunks.get((dim, part, 2 * k + side), 1) for k in range(len(pivots[dim]))])[cell] for side in (0, 1))
            chunk = (mix(cls[i].view(U) ^ U(21)) % np.where(homed, homes, guests).astype(U)).astype(np.int64)
            times = np.where(homed, homes + guests - 1, homes)
            row = np.repeat(np.arange(len(i)), times)
            other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            at_home, chunk, homes = homed[row], chunk[row], homes[row]
            lo = np.where(at_home, np.minimum(chunk, other), other)
            hi = np.where(at_home, np.maximum(chunk, other), np.where(chunk == 0, other, homes + chunk - 1))
            side = np.where(at_home & (lo == hi), BOTH, np.where(at_home & (chunk == lo), ASKS, ASKED)).astype(np.int32)
            block = np.full(len(row), dim * 64 + part, U)
            for x in (cell[row], lo, hi):
                block = mix(block * U(0x9E3779B97F4A7C15) + x.astype(U) + U(1))
            at = i[row]
            for s in range(0, len(row), 20_000):
                k = slice(s, s + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[k].view(np.int64)), pa.array(np.full(len(row[k]), part, np.int32)), pa.array(side[k]), pa.array(cls[at[k]]), pa.array(mult[at[k]]), _packed(kept[at[k]])],
                    ["block", "part", "side", "cls", "mult", "raw"],
                )

    return narrow.mapInArrow(deal, "block long, part int, side int, cls long, mult long, raw binary")


def _joined(dealt: DataFrame, least: float, single: bool) -> DataFrame:
    """Rows (a, b, n): links of the blocks as a forest with n null, and per vector a the number n of vectors linked, with b null."""
    kind = np.dtype(np.float32 if single else np.float64)

    def solve(table: pa.Table) -> pa.RecordBatch:
        block = table.column("block").to_numpy()
        heads = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        out_a, out_b, out_n = [], [], []
        for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(block)], strict=True):
            rows = table.slice(s, e - s)
            part = rows.column("part")[0].as_py()
            side, cls, mult = (rows.column(c).to_numpy() for c in ("side", "cls", "mult"))
            data, at = utf8(rows.column("raw"))
            dim = int(at[1]) // kind.itemsize
            raw = np.frombuffer(data.tobytes(), kind).reshape(-1, dim).astype(np.float64)
            turned = _turned(raw)[1]
            edge = bounds(dim)
            share = (2 - 2 * least) * np.diff(edge) / dim + SLACK
            own = turned[:, edge[part] : edge[part + 1]]
            half = (own**2).sum(1, keepdims=True) / -2
            one = np.ones_like(half)
            asks, asked = np.flatnonzero(side != ASKED), np.flatnonzero(side != ASKS)
            # the product of a row of left and a row of right is minus half their squared distance
            left, right = np.hstack([own, half, one]), np.ascontiguousarray(np.hstack([own, one, half])[asked].T)
            most = np.float32(-(share[part] + SLACK) / 2)
            norm = np.sqrt((raw**2).sum(1))
            root = list(range(len(cls)))
            n_links = np.zeros(len(cls), np.int64)

            def top(x: int) -> int:
                while root[x] != x:  # noqa: B023
                    root[x] = root[root[x]]  # noqa: B023
                    x = root[x]  # noqa: B023
                return x

            strip = max(1, STRIP // max(1, len(asked)))
            for lo in range(0, len(asks) if len(asked) else 0, strip):
                some = asks[lo : lo + strip]
                found = np.flatnonzero(left[some] @ right >= most)
                for at in range(0, len(found), PAIRS):
                    i, j = np.divmod(found[at : at + PAIRS], len(asked))
                    i, j = some[i], asked[j]
                    ok = (side[j] == ASKED) | (i < j)  # of two that ask and are asked, the first finds the second
                    i, j = i[ok], j[ok]
                    dist = (turned[i].astype(np.float64) - turned[j].astype(np.float64)) ** 2
                    first = np.ones(len(i), bool)
                    for p in range(part):
                        first &= dist[:, edge[p] : edge[p + 1]].sum(1) > share[p]
                    first &= dist[:, edge[part] : edge[part + 1]].sum(1) <= share[part]
                    i, j = i[first], j[first]
                    cosine = (raw[i] * raw[j]).sum(1) / (norm[i] * norm[j])
                    ok = cosine >= least
                    i, j = i[ok], j[ok]
                    n_links += np.bincount(i, mult[j], len(cls)).astype(np.int64) + np.bincount(j, mult[i], len(cls)).astype(np.int64)
                    for x, y in zip(i.tolist(), j.tolist(), strict=True):
                        a, b = top(x), top(y)
                        if a != b:
                            root[max(a, b)] = min(a, b)
                            out_a.append(cls[x])
                            out_b.append(cls[y])
                            out_n.append(None)
            for x in np.flatnonzero(n_links).tolist():
                out_a.append(cls[x])
                out_b.append(None)
                out_n.append(n_links[x])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_a, out_b, out_n)], ["a", "b", "n"])

    ordered = dealt.repartition("block").sortWithinPartitions("block", "cls")
    return ordered.mapInArrow(lambda batches: (solve(t) for t in grouped(batches)), "a long, b long, n long")


def near_duplicates(rows: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: id, n_links (other rows at cosine >= least), component_id (smallest id reachable, itself included), kept (id = component_id).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do vectors of different
    lengths. Equal vectors are one class while joining and count each in n_links. Repeated ids stay rows of their own. An empty table gives no rows.
    """
    spark = rows.sparkSession
    single = rows.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "float" if single else "double"
    v = F.transform(F.col(vector_col).cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind))
    base = rows.select(F.col(id_col).alias("id"), v.alias("v"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.coalesce(F.forall("v", number) & F.exists("v", lambda x: x != 0), F.lit(False))
    base = base.withColumn("cls", F.when(valid, F.xxhash64("v")))
    classes = base.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("mult"), F.min("id").alias("least_id"), F.first("v").alias("v"))
    classes = materialize(classes, "vectors")
    pivots: dict[int, np.ndarray] = {}
    for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect():
        most = min(PIVOTS_MOST, max(PIVOTS_LEAST, r["n"] // PER_PIVOT))
        chosen = classes.where(F.size("v") == r["dim"]).orderBy(F.xxhash64("cls", F.lit(5))).limit(most).select("v").collect()
        pivots[r["dim"]] = np.array([list(c[0]) for c in chosen], np.float64)
    found = materialize(_joined(_deal(classes, pivots, least, single), least, single), "links") if pivots else spark.createDataFrame([], "a long, b long, n long")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "cls")
    named = classes.select("cls", "mult", "least_id").join(counts, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    component = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(component, "root").select("cls", (F.col("mult") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = base.select("id", "cls").join(named, "cls", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("cls").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
