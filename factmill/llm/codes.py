"""Product codes of vectors in whole numbers, found by partial-distance search.

A vector is cut into equal parts and each part is replaced by the number of the nearest entry of that position's codebook. The
search adds up squared differences one dimension at a time, the dimension in which the codebook varies most first, for all rows of
a block at once; a pair of row and entry is dropped as soon as its sum is strictly above the row's best complete distance so far.
The first complete distance is that to the entry nearest in the leading dimension alone, so most pairs go after one or two steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm.centroids import finite, largest, matrix, sums, whole
from factmill.llm.store import materialize

#: Elements of a block of first-dimension sums, and entries that are searched together before the best distances are brought up to date.
CELLS, TOGETHER = 1_000_000, 16
#: Copies of the table of sums by label, so that one label is not one task.
SALTS = 8


def search(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry of one codebook, exact, ties to the lower index."""
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    # A first complete distance for every row.
    lead = np.argsort(book[:, 0], kind="stable")
    at = np.clip(np.searchsorted(book[lead, 0], x[:, 0]), 1, max(1, len(book) - 1))
    left, right = lead[at - 1], lead[np.minimum(at, len(book) - 1)]
    best = np.where(np.abs(x[:, 0] - book[left, 0]) <= np.abs(x[:, 0] - book[right, 0]), left, right)
    far = ((x - book[best]) ** 2).sum(1)
    for s in range(0, len(book), TOGETHER):
        some = book[s : s + TOGETHER]
        total = (x[:, :1] - some[None, :, 0]) ** 2
        row, k = np.nonzero(total <= far[:, None])
        total = total[row, k]
        for d in range(1, x.shape[1]):
            total = total + (x[row, d] - some[k, d]) ** 2
            keep = total <= far[row]  # equal sums stay: a lower index may win
            row, k, total = row[keep], k[keep], total[keep]
        if not len(row):
            continue
        rank = np.lexsort((k, total, row))
        row, k, total = row[rank], k[rank] + s, total[rank]
        head = np.append(True, row[1:] != row[:-1])
        row, k, total = row[head], k[head], total[head]
        better = (total < far[row]) | (k < best[row])
        best[row[better]], far[row[better]] = k[better], total[better]
    return best, far


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of the rows of x, a column for each part; books: part, entry, position."""
    parts, entries, width = books.shape
    codes, far = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    step = max(1, CELLS // entries)
    for s in range(0, len(x), step):
        for p in range(parts):
            codes[s : s + step, p], far[s : s + step, p] = search(x[s : s + step, p * width : (p + 1) * width], books[p])
    return codes, far


def _trained(points: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round. A task adds up what it has and sends a row for each entry it met."""
    parts, entries, width = books.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(0))
                codes, _ = encode(x, books)
                sums(x.reshape(-1, width), (codes + np.arange(parts) * entries).reshape(-1), count, total)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at]), pa.array(list(total[at]), pa.list_(pa.int64()))], ["k", "n", "s"])

    partial = points.select("v").mapInArrow(step, "k int, n long, s array<long>")
    out = books.reshape(-1, width).copy()
    for r in partial.groupBy("k").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(width))).alias("s")).collect():
        out[r["k"]] = np.array(r["s"], np.int64) // r["n"]
    return out.reshape(books.shape)


def compress_vectors(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each finite vector; code has two hex digits a part (entries: 256 at most).

    Components x count as floor(scale * x). Each position's codebook begins as that part of the vectors with the smallest ids; a round assigns
    all parts and moves each entry that has parts to the componentwise floor of their mean.

    Null vectors and those with null or non-finite components are left out, and so are vectors that do not have as many components as the
    one of the smallest id (or cannot be cut into equal parts). Rows without an id come last in the order of ids, equal ids are ordered by
    their vectors, and repeated rows each count. Null labels are one label. Fewer vectors than entries make smaller codebooks; an empty table gives
    an empty one. Further columns, of any name, are ignored. A component whose distances would leave 64 bits is an error.

    What crosses the network is a row of sums for each task and entry, and errors by label; what comes to the driver are the codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits has 1 to 256 entries")
    usable = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("e"), F.col(f"`{label_col}`").alias("label"))
    usable = usable.where(finite(F.col("e")) & (F.size("e") > 0) & (F.size("e") % parts == 0))
    first = usable.select(F.col("id"), F.size("e").alias("n")).orderBy(F.col("id").asc_nulls_last(), "n").first()
    kinds = {k: usable.schema[k].dataType.simpleString() for k in ("id", "label")}
    if first is None:
        return usable.sparkSession.createDataFrame([], f"vec_id {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string")
    dims = first["n"]
    points = materialize(usable.where(F.size("e") == dims).select("id", "label", whole(F.col("e"), scale, largest(dims)).alias("v")), "points")
    start = points.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, dims // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _trained(points, books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                codes, far = encode(matrix(batch.column(2)), books)
                text = [bytes(row).hex() for row in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text), pa.array(far.sum(1))], ["vec_id", "label", "code", "error"])

    done = materialize(points.mapInArrow(assign, f"vec_id {kinds['id']}, label {kinds['label']}, code string, error long"), "codes")
    by_label = materialize(done.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "errors")
    by_label = by_label.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = done.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    joined = salted.join(by_label, salted["label"].eqNullSafe(by_label["l"]) & (salted["salt"] == by_label["s"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
