"""Vectorised text kernels for Arrow tasks: words, their hashes and shingles of many documents at once.

Hashes are 64 bits wide and depend on the bytes alone, so they agree between tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are expanded into arrays at once.
CHUNK_BYTES = 2_000_000
#: The six ASCII white-space bytes.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def keyed(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random multipliers; a longer table starts with the shorter one."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BYTE[_IS_SPACE] = 0
_POW = keyed(4096, 11)
_STEP = keyed(16, 77)


def powers(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = keyed(2 * n, 11)
    return _POW


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most limit bytes together; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first byte) of every white-space separated word, A-Z lowered, in order. No word crosses a document."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    spans = np.diff(np.append(starts, n))
    pos = np.arange(starts[0], n) - np.repeat(starts, spans)
    power = powers(int(spans.max()))
    term = _BYTE[data[starts[0] :]] * power[pos]
    hashes = mix(np.add.reduceat(term, starts - starts[0]))
    return hashes, np.searchsorted(offsets, starts, "right") - 1, starts


def shingles(hashes: np.ndarray, docs: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, index of the first word) of every run of k words; short: a document with fewer words gives all of them as one."""
    n = len(hashes)
    if n >= k:
        at = np.flatnonzero(docs[: n - k + 1] == docs[k - 1 :])
        total = np.zeros(len(at), U)
        for i in range(k):
            total += hashes[at + i] * _STEP[i]
        out = [mix(total)], [docs[at]], [at]
    else:
        out = [], [], []
    if short and n:
        heads = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        sizes = np.diff(np.append(heads, n))
        for size in range(1, k):
            at = heads[sizes == size]
            total = np.full(len(at), size, U)
            for i in range(size):
                total += hashes[at + i] * _STEP[i]
            out[0].append(mix(total ^ U(0x5851F42D4C957F2D)))
            out[1].append(docs[at])
            out[2].append(at)
    if not out[0]:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in out)


def distinct(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, document), sorted by document, then hash."""
    order = np.lexsort((hashes, docs))
    h, d = hashes[order], docs[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[keep], d[keep]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by their first column, a long; a group never crosses two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
        if held and (cut or held[-1].column(0)[-1].as_py() != key[0]):
            if not cut:
                yield pa.Table.from_batches(held)
                held = []
            else:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


_Z = pa.Codec("zstd", compression_level=1)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of like place stand together, for small numbers differ in their low bytes alone."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays)
    head = np.array([len(raw), *(len(a) for a in arrays)], np.int64).tobytes()
    return head + _Z.compress(raw, asbytes=True)


def unsqueeze(blob: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays of squeeze(), of the given types."""
    head = np.frombuffer(blob[: 8 * (len(kinds) + 1)], np.int64)
    raw = np.frombuffer(_Z.decompress(blob[8 * (len(kinds) + 1) :], int(head[0]), asbytes=True), np.uint8)
    out, at = [], 0
    for kind, n in zip(kinds, head[1:].tolist(), strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out
