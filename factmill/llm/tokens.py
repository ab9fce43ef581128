"""Token counts and harmonic packing over one public tokenizer file."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm.kernels import U, squeeze, unsqueeze, utf8
from factmill.llm.pretoken import CHUNK_BYTES, Pieces, cut, open_pieces
from factmill.llm.pretoken import pieces as split_long
from factmill.llm.store import materialize

#: Documents that are handed to the encoder at once.
ROWS = 256
#: Documents, pre-tokens and distinct pre-tokens of a block. A block that is full is closed; nothing is left out.
BLOCK_DOCS, BLOCK_TOKENS, BLOCK_PIECES = 20_000, 2_500_000, 200_000
#: UTF-8 bytes of text for each part of the distinct pre-tokens.
PART_BYTES = 16_000_000


class Frequencies:
    """Pre-token frequencies of a block of documents: distinct pre-tokens once, and how often each document has which."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.strings: list[str] = []
        self.hashes: list[int] = []
        self.entry, self.times, self.doc = [], [], []
        self.whole: list[int] = []
        self.tokens = 0

    def full(self) -> bool:
        return len(self.whole) >= BLOCK_DOCS or self.tokens >= BLOCK_TOKENS or len(self.strings) >= BLOCK_PIECES

    def add(self, texts: list[str]) -> None:
        parts, owner, first = [], [], len(self.whole)
        for i, t in enumerate(texts):
            direct = self.pieces.whole(t)  # it has a special token's string: the library counts it as a whole
            self.whole.append(len(self.pieces.tokenizer.encode(t, add_special_tokens=False).ids) if direct else 0)
            for p in () if direct else split_long(t):
                parts.append(p)
                owner.append(first + i)
        lo = 0
        while lo < len(parts):
            hi, size = lo, 0
            while hi < len(parts) and (hi == lo or size + len(parts[hi]) <= CHUNK_BYTES):
                size += len(parts[hi])
                hi += 1
            joined, starts, stops, docs, hashes = cut(parts[lo:hi])
            distinct, head, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            place = np.empty(len(distinct), np.int64)
            for k, h in enumerate(distinct.tolist()):
                if (found := self.at.get(h)) is None:
                    found = self.at[h] = len(self.strings)
                    self.strings.append(joined[starts[head[k]] : stops[head[k]]])
                    self.hashes.append(h)
                place[k] = found
            pair, n = np.unique(np.asarray(owner[lo:hi], np.int64)[docs] << 32 | place[inverse], return_counts=True)
            self.doc.append(pair >> 32)
            self.entry.append((pair & 0xFFFFFFFF).astype(np.uint32))
            self.times.append(n.astype(np.uint32))
            self.tokens += len(hashes)
            lo = hi

    def packed(self, parts: int) -> tuple[bytes, list[int], list[bytes]]:
        """(frequencies, parts, the distinct pre-tokens of each part); frequencies point into the pre-tokens in order of part."""
        none = [np.zeros(0, np.int64)]
        part = ((np.array(self.hashes, U) >> U(32)) * U(parts) >> U(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        which, first = np.unique(part[order], return_index=True)
        held = [pack_strings([self.strings[i] for i in order[s:e].tolist()]) for s, e in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=False)]
        entry = place[np.concatenate(self.entry or none).astype(np.int64)]
        return squeeze(np.concatenate(self.doc or none).astype(np.uint32), entry, np.concatenate(self.times or none).astype(np.uint32)), which.tolist(), held


def pack_strings(strings: list[str]) -> bytes:
    coded = [x.encode() for x in strings]
    return squeeze(np.fromiter(map(len, coded), np.uint32, len(coded)), np.frombuffer(b"".join(coded), np.uint8))


def unpack_strings(blob: bytes) -> list[str]:
    sizes, raw = unsqueeze(blob, np.uint32, np.uint8)
    ends, data = np.cumsum(sizes).tolist(), raw.tobytes()
    return [data[s:e].decode() for s, e in zip([0, *ends[:-1]], ends, strict=False)]


def _frequencies(docs: DataFrame, tokenizer_file: str, parts: int, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, n_bytes, whole, frequencies, pieces): one row for each block of documents; pieces are its distinct pre-tokens by part."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["block", "ids", "n_bytes", "whole", "frequencies", "pieces"]
    piece = pa.struct([("part", pa.int32()), ("strings", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        held, ids, sizes = Frequencies(open_pieces(tokenizer_file)), [], []

        def flush() -> pa.RecordBatch:
            one = lambda values, of: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, of) if isinstance(values, list) else values)
            frequencies, which, strings = held.packed(parts)
            dealt = pa.array([{"part": p, "strings": x} for p, x in zip(which, strings, strict=True)], piece)
            row = pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), one(pa.concat_arrays(ids), None), one(pa.array(np.concatenate(sizes), pa.int64()), None), one(held.whole, pa.int64()), pa.array([frequencies], pa.binary()), one(dealt, None)], names
            )
            held.clear()
            ids.clear()
            sizes.clear()
            return row

        for batch in batches:
            text = batch.column(1)
            _, at = utf8(text)
            for i in range(0, len(text), ROWS):
                held.add([x or "" for x in text.slice(i, ROWS).to_pylist()])
                ids.append(batch.column(0).slice(i, ROWS))
                sizes.append(np.diff(at[i : i + ROWS + 1]))
                if held.full():
                    yield flush()
                    block += 1
        if ids:
            yield flush()

    return docs.select(id_col, text_col).mapInArrow(count, f"block long, ids array<{kind}>, n_bytes array<long>, whole array<long>, frequencies binary, pieces array<struct<part: int, strings: binary>>")


def _piece_counts(pieces: DataFrame, tokenizer_file: str, parts: int) -> DataFrame:
    """(block, part, counts) of (part, block, strings): every distinct pre-token lives in one part, where its tokens are counted once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = open_pieces(tokenizer_file)
        at, known = None, {}
        for batch in batches:
            for i in range(len(batch)):
                part, block, blob = (batch.column(k)[i].as_py() for k in range(3))
                if part != at:
                    at, known = part, {}
                strings = unpack_strings(blob)
                new = [x for x in strings if x not in known]
                known.update(zip(new, own.lengths(new), strict=True))
                n = np.fromiter((known[x] for x in strings), np.uint32, len(strings))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([squeeze(n)], pa.binary())], ["block", "part", "counts"])

    dealt = pieces.repartition(parts, "part").sortWithinPartitions("part", "block")
    return dealt.select("part", "block", "strings").mapInArrow(count, "block long, part int, counts binary")


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit.

    Texts are cut into pre-tokens, and blocks of documents keep their frequencies: which distinct pre-token of the block each document has
    how often. Distinct pre-tokens are dealt by hash, so that each of the corpus is counted in one place and once; its count goes
    back to the blocks that have it and is summed by their frequencies. A frequent one crosses the network once a block, and
    only lengths are kept, never a document's ids.
    Null and empty texts: 0 bytes, 0 tokens. Repeated rows give repeated results; an empty table gives no rows. A text with a special token's
    string is counted by the library as a whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    blocks = materialize(_frequencies(docs, tokenizer_file, parts, id_col, text_col), "frequencies")
    each = blocks.select("block", F.explode("pieces").alias("p")).select("p.part", "block", "p.strings")
    # one entry for each part
    counts = _piece_counts(each, tokenizer_file, parts).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "counts"))).alias("c")).select("block", F.transform("c", lambda x: x["counts"]).alias("counts"))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, sizes, whole, blob, counts = (batch.column(k)[i] for k in range(5))
                doc, entry, times = unsqueeze(blob.as_py(), np.uint32, np.uint32, np.uint32)
                n = whole.values.to_numpy().copy()
                if len(doc):
                    each = np.concatenate([unsqueeze(x.as_py(), np.uint32)[0] for x in counts.values])
                    n += np.bincount(doc, each[entry] * times.astype(np.int64), len(n)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, sizes.values, pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = blocks.join(counts, "block", "left").select("ids", "n_bytes", "whole", "frequencies", "counts")
    return rows.mapInArrow(total, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def slots(length: int, capacity: int, slack: float = 0.03) -> list[tuple[int, int]]:
    """How a rest of `length` < capacity is cut: (piece length, class k), k pieces to a bin.

    Class k takes lengths up to capacity // k. A piece that would leave more than `slack` of its slot empty is cut at the
    next smaller slot, which it fills exactly; what is left is treated in the same way. From class 32 on a slot's waste
    is small by itself.
    """
    out = []
    while length:
        k = capacity // length
        room = capacity // k
        if k >= 32 or room - length <= slack * room:
            out.append((length, k))
            break
        cut = capacity // (k + 1)
        out.append((cut, k + 1))
        length -= cut
    return out


class Bins:
    """Open bins of one worker: one for each class, closed when it holds its fixed number of pieces."""

    def __init__(self, part: int, capacity: int):
        self.capacity, self.next = capacity, part << 33
        self.open: dict[int, list] = {}

    def place(self, pieces: list) -> Iterator[tuple]:
        """(piece, sequence, offset) of pieces that share a bin."""
        at = 0
        for p in pieces:
            yield p, self.next, at
            at += p[2]
        self.next += 1

    def add(self, piece: list, k: int) -> Iterator[tuple]:
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            del self.open[k]
            yield from self.place(held)

    def close(self) -> Iterator[tuple]:
        """What is left of all classes goes first fit, longest first; its number is bounded by the classes alone."""
        bins: list[list] = []
        room: list[int] = []
        for p in sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2]):
            at = next((i for i, r in enumerate(room) if r >= p[2]), None)
            if at is None:
                bins.append([])
                room.append(self.capacity)
                at = len(bins) - 1
            bins[at].append(p)
            room[at] -= p[2]
        self.open = {}
        for held in bins:
            yield from self.place(held)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids and one end id are cut into full sequences and a rest, and the rest into harmonic slots. Workers
    fill the bins of each class independently, with as many pieces as the class says, so nothing is shuffled; a retried
    task repeats its work with the same sequence ids, which begin with its partition number. Only the few pieces that are
    left in open bins at a task's end are packed first fit. Null and empty texts are the end id alone; repeated rows are
    packed again. An empty table gives no rows. Sequence ids are unique, not gapless.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces = open_pieces(tokenizer_file)
        bins = Bins(TaskContext.get().partitionId(), capacity)
        rows: list[tuple] = []
        id_type = pa.int64()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)
            rows.clear()
            return out

        def keep(placed: Iterator[tuple]) -> None:
            rows.extend((*p, sequence, offset) for p, sequence, offset in placed)

        for batch in batches:
            id_type = batch.column(0).type
            keys, text = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(text), ROWS):
                for key, ids in zip(keys[i : i + ROWS], pieces.encode([x or "" for x in text.slice(i, ROWS).to_pylist()], True), strict=True):
                    whole = np.append(ids, np.uint32(end_id)).astype("<u4")
                    n = len(whole)
                    cuts = [(capacity, 1)] * (n // capacity) + slots(n % capacity, capacity)
                    at = 0
                    for size, k in cuts:
                        piece = (key, at, size, zlib.crc32(whole[at : at + size].tobytes()), n)
                        keep(bins.add(piece, k))
                        at += size
                if len(rows) >= 20_000:
                    yield flush()
        keep(bins.close())
        if rows:
            yield flush()
        pieces.forget()  # else the worker's table stays in memory while later stages run

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(id_col, text_col).mapInArrow(fill, schema).withColumnRenamed("id", id_col)
