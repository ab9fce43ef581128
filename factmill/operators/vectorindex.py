"""A stored vector index: cells around pivots in a partitioned table, batches of upserts and deletes, and exact k nearest rows by cosine.

A row lies in the cell of its nearest pivot, with its distance to that pivot (its gap). By the triangle inequality no row of a cell is nearer to
a query than the query's distance to the pivot less the cell's greatest gap, or the least gap less that distance. A search first visits, for
each query, the cells with the least bounds that hold k rows together; the k-th distance found there then rules out all cells with a greater
bound, and the rest are visited. So results are exact, whatever the pivots. What conditions a search has (specialty, tier) hold before rows
of cells are counted, so cells without a fitting row are not visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factmill.operators.vector import _unit
from factmill.sources.shared import dealt, hadoop_path, materialize

#: Pivots at most, and rows of a chunk of a cell and queries of a pack that meet in one product.
CELLS_MOST, CHUNK_ROWS, PACK_QUERIES = 1024, 4096, 512
#: What rounding may add to a distance of unit vectors.
SLACK = 1e-7


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


class VectorIndex:
    """The index below a folder that driver and executors share. One writer at a time.

    Rows have an id (long), a vector of the pivots' length and any other columns, which searches may ask for; batch, cell, unit and gap are the index's own.
    Null, zero, shorter, longer and non-finite vectors are not indexed; an upsert with one removes what the id had before. The pivots, at most CELLS_MOST, come
    from a sample of the first rows; they decide the speed of a search and nothing else.
    """

    def __init__(self, spark: SparkSession, root: str, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.spark, self.root, self.id, self.vector = spark, root.rstrip("/"), id_col, vector_col

    @classmethod
    def build(cls, rows: DataFrame, root: str, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None) -> VectorIndex:
        """An index of rows, whose ids are distinct, as batch 0: about as many cells as the square root of the rows."""
        index = cls(rows.sparkSession, root, id_col, vector_col)
        cells = min(CELLS_MOST, cells or max(1, int(rows.count() ** 0.5)))
        fits = F.exists(vector_col, lambda x: x != 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        pivots = rows.where(fits).select(F.col(vector_col).cast("array<double>").alias("pivot"), F.xxhash64(id_col).alias("h"), id_col).orderBy("h", id_col).limit(cells)
        pivots.select("h", "pivot").coalesce(1).write.parquet(f"{index.root}/pivots")
        index.write(rows, None, 0)
        return index

    def _pivots(self) -> np.ndarray:
        """Unit pivots, at most CELLS_MOST; those that are not as long as the first are left out."""
        rows = [r[0] for r in self.spark.read.parquet(f"{self.root}/pivots").orderBy("h", "pivot").select("pivot").collect()]
        return _unit([r for r in rows if len(r) == len(rows[0])])

    def batches(self) -> list[int]:
        """Committed batches, ascending."""
        fs, there = hadoop_path(self.spark, f"{self.root}/committed")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(there)) if fs.exists(there) else []

    def write(self, rows: DataFrame | None, gone: DataFrame | None, batch: int) -> bool:
        """Upsert rows and delete the ids of gone (an id in both is deleted), all of it visible at once; False if the batch was written before. Ids of rows are distinct."""
        done = self.batches()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after {done[-1]}")
        ids = [df.select(F.col(self.id).cast("long").alias(self.id)) for df in (rows, gone) if df is not None]
        if gone is not None and rows is not None:
            rows = rows.join(gone.select(self.id).distinct(), self.id, "left_anti")
        if rows is not None:
            # ranges of cell and id: few files to a cell, and more than one task to a cell that holds a large share of the rows
            placed = self._placed(rows).repartitionByRange("cell", self.id).sortWithinPartitions("cell", self.id)
            placed.write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/rows/batch={batch}")
        if ids:
            changed = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
            changed.distinct().write.mode("overwrite").parquet(f"{self.root}/changed/batch={batch}")
        fs, there = hadoop_path(self.spark, f"{self.root}/committed/{batch}")
        fs.create(there, False).close()
        return True

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with unit vector, cell and gap; those that can't be indexed are left out."""
        pivots, vector = self._pivots(), self.vector
        rows = rows.select(F.col(self.id).cast("long").alias(self.id), F.col(vector).cast("array<double>").alias(vector), *[F.col(c) for c in rows.columns if c not in (self.id, vector)])
        schema = StructType.fromDDL(", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["unit array<double>", "cell int", "gap double"]))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = batch.column(1).to_pylist()
                fit = np.array([v is not None and len(v) == pivots.shape[1] for v in got], bool)
                unit = _unit([v if ok else None for v, ok in zip(got, fit, strict=True)])
                fit &= unit.any(axis=1)
                if not fit.any():
                    continue
                unit, batch = unit[fit], batch.filter(pa.array(fit))
                far = _distance(unit, pivots)
                cell = far.argmin(axis=1)
                own = [pa.array(list(unit), pa.list_(pa.float64())), pa.array(cell, pa.int32()), pa.array(far[np.arange(len(cell)), cell])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "unit", "cell", "gap"])

        return rows.mapInArrow(place, schema)

    def _stored(self, kind: str, batches: list[int]) -> DataFrame | None:
        fs, _ = hadoop_path(self.spark, self.root)
        paths = [p for p in (f"{self.root}/{kind}/batch={b}" for b in batches) if fs.exists(hadoop_path(self.spark, p)[1])]
        return self.spark.read.option("basePath", f"{self.root}/{kind}").option("mergeSchema", "true").parquet(*paths) if paths else None

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The rows that are held: of each id the last batch that names it. With cells, only their folders are read."""
        done = self.batches()
        held = self._stored("rows", done)
        if cells is not None:
            held = held.where(F.col("cell").isin(cells))
        changed = self._stored("changed", done[1:])
        if changed is None:
            return held
        last = changed.groupBy(self.id).agg(F.max("batch").alias("__last"))
        return held.join(last, self.id, "left").where(F.coalesce("__last", F.lit(done[0])) <= F.col("batch")).drop("__last")

    def search(self, queries: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
        """(query_id, id, similarity, rank): the k nearest rows that fit, fewer if there are fewer, by cosine rounded to 12 places and then by id.

        queries has the id and vector columns, ids distinct; queries that could not be indexed have no rows. Cells cross to the driver as one line each.
        """
        pivots = self._pivots()
        held = self.rows() if where is None else self.rows().where(where)
        cells = held.groupBy("cell").agg(F.count("*").alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high")).orderBy("cell").collect()
        number, n = np.array([r.cell for r in cells], np.int64), np.array([r.n for r in cells], np.int64)
        low, high = np.array([r.low for r in cells], float), np.array([r.high for r in cells], float)
        chunks = dict(zip(number.tolist(), (-(-n // CHUNK_ROWS)).tolist(), strict=True))
        asked = self._placed(queries.select(self.id, self.vector)).select(F.col(self.id).alias("q"), "unit")

        def plan(first: bool):
            def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if not len(batch) or not len(number):
                        continue
                    far = _distance(np.stack(batch.column(1).to_numpy(zero_copy_only=False)), pivots[number])
                    bound = np.maximum(np.maximum(far - high, low - far), 0)
                    order = np.lexsort((far, bound), axis=1)
                    before = np.cumsum(n[order], axis=1) - n[order]
                    early = np.zeros(far.shape, bool)
                    np.put_along_axis(early, order, before < k, axis=1)
                    limit = None if first else batch.column(2).to_numpy(zero_copy_only=False)[:, None]
                    row, cell = np.nonzero(early if first else ~early & (bound <= limit + SLACK))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(number[cell], pa.int32())], ["q", "unit", "cell"])

            return cells_of

        kind = "q long, unit array<double>, cell int"
        near = materialize(self._visit(asked.mapInArrow(plan(True), kind), chunks, k, where), "index-near")
        # fewer than k rows in all: the first visit has seen every cell
        limit = self._best(near, k).groupBy("q").agg(F.min("s").alias("s")).select("q", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("s"))).alias("limit"))
        rest = self._visit(asked.join(dealt(limit), "q").mapInArrow(plan(False), kind), chunks, k, where)
        best = self._best(near.unionByName(rest), k)
        return best.select(F.col("q").alias("query_id"), self.id, F.col("s").alias("similarity"), "rank")

    def _best(self, found: DataFrame, k: int) -> DataFrame:
        """The k best of what chunks found for a query: at most k times the chunks that it visits."""
        order = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("m"), self.id)))
        return found.groupBy("q").agg(F.slice(order, 1, k).alias("best")).select("q", F.posexplode("best").alias("r", "x")).select("q", f"x.{self.id}", (-F.col("x.m")).alias("s"), (F.col("r") + 1).cast("long").alias("rank"))

    def _visit(self, probes: DataFrame, chunks: dict[int, int], k: int, where: Column | None) -> DataFrame:
        """(q, id, s): of each chunk of a visited cell, the k nearest rows of each query that visits it. A chunk meets packs of queries; no pair leaves a task but those."""
        probes, name = materialize(probes, "index-probes"), self.id
        sizes = {r.cell: r.n for r in probes.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        held = self.rows(sorted(sizes))
        held = held if where is None else held.where(where)
        ways = lambda each: F.element_at(F.create_map(*[F.lit(x) for pair in each.items() for x in pair]), F.col("cell")) if each else F.lit(1)
        packs = {c: -(-m // PACK_QUERIES) for c, m in sizes.items()}
        packed = probes.groupBy("cell", F.pmod(F.xxhash64("q"), ways(packs)).alias("pack")).agg(F.collect_list(F.struct("q", "unit")).alias("asked"))
        chunk = F.pmod(F.xxhash64(self.id), ways({c: chunks[c] for c in sizes}))
        held = held.groupBy("cell", chunk.alias("chunk")).agg(F.collect_list(F.struct(F.col(self.id).alias("i"), "unit")).alias("held"))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ask, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = np.array([x["i"] for x in row], np.int64)
                    s = np.round(np.array([x["unit"] for x in ask]) @ np.array([x["unit"] for x in row]).T, 12)
                    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                    q = np.repeat(np.array([x["q"] for x in ask], np.int64), order.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], ["q", name, "s"])

        # a query's vector is stored once for each cell, next to itself, so the file says little of what the packs hold; they are the side whose rows of a cell a task keeps
        return held.join(dealt(packed), "cell").select("asked", "held").mapInArrow(nearest, f"q long, `{name}` long, s double")
