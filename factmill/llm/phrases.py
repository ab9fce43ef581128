"""Lempel-Ziv phrase fingerprints: a text is cut into dictionary phrases, and the smallest hashes of the phrase set are its fingerprint.

The parse reads on until what it has read since the last phrase is new, adds that to the dictionary and begins again, so texts that
would compress each other share phrases. Likeness is the Jaccard similarity of two phrase sets as their joined smallest hashes give
it, which is exact for sets that the fingerprints hold whole. A dictionary holds every beginning of its phrases, so the end of a
phrase is searched from the length of the one before it up or down instead of character by character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm.kernels import U, keyed, mix

#: Hashes in a fingerprint, and hex digits of each.
KEEP, DIGITS = 256, 12
#: Code points whose phrases are hashed at once.
CHUNK = 1_000_000
_POWER = keyed(1 << 10, 1313)


def _powers(n: int) -> np.ndarray:
    global _POWER
    if n > len(_POWER):
        _POWER = keyed(2 * n, 1313)
    return _POWER


def parse(text: str, known: set[str], ends: list[int], at: int = 0, until: int | None = None) -> int:
    """Parse text[at:] into phrases: known gets them, ends their ends. A last piece that is known already adds nothing. until: stop before
    the first phrase that would read the character there or one after it. Returns where the parse stopped."""
    last = len(text) if until is None else until
    add, note, end = known.add, ends.append, at + 1
    piece = text[at:end]
    while True:
        if piece in known:
            if end >= last:  # nothing is left, or the next character is out of bounds
                return at
            end += 1
            piece = text[at:end]
            while piece in known and end < last:
                end += 1
                piece = text[at:end]
            if piece in known:
                return at
        else:
            shorter = piece[:-1]
            while shorter and shorter not in known:
                piece, shorter = shorter, shorter[:-1]
            end = at + len(piece)
        if end > last or not piece:
            return at
        add(piece)
        note(end)
        at, end = end, end + len(piece)
        piece = text[at:end]


def hashes(text: str, ends: list[int], at: int = 0) -> np.ndarray:
    """64-bit hashes of the phrases from at on that end there, in order; they depend on the phrases' characters alone."""
    if not ends:
        return np.zeros(0, U)
    points = np.frombuffer(text[at : ends[-1]].encode("utf-32-le"), np.uint32)
    stop = np.array(ends, np.int64) - at
    start = np.append(0, stop[:-1])
    out, i = np.empty(len(stop), U), 0
    while i < len(stop):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + CHUNK, "right")))
        spans = stop[i:j] - start[i:j]
        place = np.arange(start[i], stop[j - 1]) - np.repeat(start[i:j], spans)
        term = mix(points[start[i] : stop[j - 1]].astype(U) + U(1)) * _powers(int(spans.max()))[place]
        out[i:j] = mix(np.add.reduceat(term, start[i:j] - start[i]) + spans.astype(U))
        i = j
    return out


def smallest(values: np.ndarray, keep: int = KEEP) -> np.ndarray:
    """The smallest distinct values, ascending, cut to the digits that a fingerprint shows."""
    short = values >> U(64 - 4 * DIGITS)
    if len(short) > 2 * keep:
        few = np.unique(np.partition(short, 2 * keep)[: 2 * keep])  # equal values come from equal phrases or by rare chance
        if len(few) >= keep:
            return few[:keep]
    return np.unique(short)[:keep]


def shown(sketch: np.ndarray) -> str:
    """A fingerprint as hex digits."""
    return np.ascontiguousarray(sketch.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 8 - DIGITS // 2 :].tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Share of the smallest values of both that both have, 0 to 1; two empty sketches are equal."""
    both = np.sort(np.concatenate([a, b]))
    if not len(both):
        return 1.0
    again = both[1:] == both[:-1]
    union = len(both) - int(again.sum())
    if union <= keep:
        return (len(both) - union) / union
    return int(again[np.cumsum(~again) < keep].sum()) / keep


def sketch(text: str) -> np.ndarray:
    ends: list[int] = []
    parse(text, set(), ends)
    return smallest(hashes(text, ends))


def sketch_with_edit(text: str, follower: str) -> tuple[str, np.ndarray, np.ndarray]:
    """(edited text, sketch of text, sketch of the edited text). The second half of text gives way to the beginning of follower; what both
    have in common is parsed once."""
    half = len(text) // 2
    common = len(text) - half
    edited = text[:common] + follower[:half]
    if edited == text:
        mine = sketch(text)
        return edited, mine, mine
    known: set[str] = set()
    shared: list[int] = []
    at = parse(text, known, shared, until=common)
    also, first = set(known), hashes(text, shared)
    out = []
    for whole, dictionary in ((text, known), (edited, also)):
        ends: list[int] = []
        parse(whole, dictionary, ends, at)
        out.append(smallest(np.concatenate([first, hashes(whole, ends, at)])))
    return edited, out[0], out[1]


def _bounds(docs: DataFrame, buckets: int) -> tuple[np.ndarray, dict[int, int], dict[int, tuple]]:
    """(largest id below each bucket's end, bucket before, id that the bucket begins with) of buckets of about equal rows, ids descending."""
    ids = docs.select("id")
    shares = [i / buckets for i in range(1, buckets)]
    cut = ids.agg(F.percentile_approx("id", shares, max(10_000, 10 * buckets)).alias("c")).first()["c"] if shares else None
    edges = np.unique(np.array(cut or [], np.int64))
    firsts = ids.groupBy(_bucket(edges)("id").alias("b")).agg(F.max("id").alias("first")).orderBy("b").collect()
    before, begin = {}, {}
    for i, r in enumerate(firsts):
        before[r["b"]] = firsts[i - 1]["b"]  # before the first comes the last: the ring closes
        begin[r["b"]] = (r["first"],)
    return edges, before, begin


def _numbers(ids: pa.Array, edges: np.ndarray) -> np.ndarray:
    """Buckets of ids, the largest first; null ids are in the last."""
    known = ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    return len(edges) - np.searchsorted(edges, known, "right")


def _bucket(edges: np.ndarray):
    @F.arrow_udf("int")
    def of(ids: pa.Array) -> pa.Array:
        return pa.array(_numbers(ids, edges).astype(np.int32))

    return of


def _places(edges: np.ndarray, before: dict[int, int], begin: dict[int, tuple]):
    """Where a row goes: its bucket, and if it may be the first there also the bucket before, as a guest, coded as -1 - bucket."""

    @F.arrow_udf("array<int>")
    def of(ids: pa.Array) -> pa.Array:
        out = [[b, -1 - before[b]] if (i,) == begin[b] else [b] for i, b in zip(ids.to_pylist(), _numbers(ids, edges).tolist(), strict=True)]
        return pa.array(out, pa.list_(pa.int32()))

    return of


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(guest, id, text, type of the id) of the rows, of each bucket's guests only the first."""
    closed = None
    for batch in batches:
        for s in range(0, len(batch), 128):
            part = batch.slice(s, 128)
            for bucket, guest, i, text in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                if bucket != closed:
                    closed = bucket if guest else None
                    yield guest, i, text, batch.schema.field(2).type


OUT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprint_documents(docs: DataFrame, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each document.

    Documents stand in a ring by descending whole-number id, and each is compared with the next and with its own edit, whose last floor(n_chars / 2) code
    points are the first as many of the next document. Ids are cut into buckets of about equal rows (as many as there are shuffle
    partitions); a text goes to its bucket, the first one of a bucket also to the bucket before, and there they are read in order, two texts at a time.

    Null texts are empty; an empty text has the empty fingerprint, is 1 like another and 0 like any text with characters, and n_chars of 0 or 1
    leave nothing to edit. Rows of one id are ordered by their texts, and null ids come last. A single document is its own next one. Very long texts are parsed whole, in memory that grows with the
    one text. An empty table gives an empty one. Further columns, of any name, are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges, before, begin = _bounds(rows, buckets)
    placed = rows.withColumn("place", F.explode(_places(edges, before, begin)("id")))
    placed = placed.withColumn("guest", F.col("place") < 0).withColumn("bucket", F.when(F.col("guest"), -1 - F.col("place")).otherwise(F.col("place")))
    dealt = placed.select("bucket", "guest", "id", "text").repartitionById(len(edges) + 1, "bucket")
    ordered = dealt.sortWithinPartitions("bucket", "guest", F.col("id").desc_nulls_last(), "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the documents of sorted buckets. A row waits for the text after it, and then for that one's fingerprint."""
        held: tuple | None = None  # id and text that wait for the next text
        row: tuple | None = None  # a row without near_next, and its sketch
        out: list[tuple] = []
        kind_of = None

        def flush() -> pa.RecordBatch:
            types = [kind_of, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", *OUT])
            out.clear()
            return batch

        for guest, i, text, kind_of in _rows(batches):
            if held is not None:
                edited, mine, other = sketch_with_edit(held[1], text)
                if row is not None:
                    out.append((*row[0], likeness(row[1], mine)))
                sha = hashlib.sha256(edited.encode()).hexdigest()
                row = (held[0], len(held[1]), sha, shown(mine), shown(other), likeness(mine, other)), mine
            held = (i, text)
            if guest:  # it has its row elsewhere and closes the bucket; further guests are of the same id
                if row is not None:
                    out.append((*row[0], likeness(row[1], sketch(text))))
                held = row = None
            if len(out) >= 500:
                yield flush()
        if out:
            yield flush()

    types = ["long", "string", "string", "string", "double", "double"]
    return ordered.mapInArrow(read, f"doc_id {kind}, " + ", ".join(f"{c} {t}" for c, t in zip(OUT, types, strict=True)))
