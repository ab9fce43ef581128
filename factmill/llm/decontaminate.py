"""Benchmark decontamination: n-gram seeds join passages to test items, and Smith-Waterman alignment over words scores them.

Every n-gram of an item is a seed, however many documents hold it, so no number of copies hides an item. Around each group
of hits on near diagonals a window is opened. A window that shares too few words with its item for any alignment to reach
the least score is passed over; the others are aligned, equal windows once.
Items are taken in blocks of bounded size, each block being all that is broadcast; a larger benchmark takes more passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm.kernels import runs, shingles, utf8, words

SEED_WORDS = 3
#: Bytes of item text in one block.
BLOCK_BYTES = 8_000_000
#: Alignment: points of a match, a mismatch and a gap, and the least share of the item's full score.
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
#: Seed hits, and words of windows, that are expanded at once; and results of equal windows kept in a task.
WINDOW_WORDS = 2_000_000
ALIGNED_MOST = 5_000


class Items:
    """One block of items: their words, and their n-grams sorted by hash with (item, place)."""

    def __init__(self, ids: list, texts: list[str]):
        data, at = utf8(pa.array(texts, pa.large_string()))
        hashes, docs, _ = words(data, at)
        bounds = np.searchsorted(docs, np.arange(len(ids) + 1))
        self.ids = ids
        self.words = [hashes[bounds[i] : bounds[i + 1]] for i in range(len(ids))]
        seed, item, first = shingles(hashes, docs, SEED_WORDS, short=False)
        order = np.lexsort((first, item, seed))
        self.seed, self.item, self.place = seed[order], item[order], (first - bounds[item])[order]
        self.sizes = np.diff(bounds)
        self.vocabulary, place = np.unique(hashes, return_inverse=True)
        #: (item, word) as one number, sorted, and how often the item has the word.
        self.bag, self.times = np.unique(docs * len(self.vocabulary) + place, return_counts=True)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(best local score, end in text) of two word sequences."""
    n = len(text)
    slope = np.arange(n + 1) * -GAP
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for w in item:
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(text == w, MATCH, MISMATCH), row[1:] + GAP), 0)
        row = np.maximum.accumulate(new + slope) - slope
        j = int(row.argmax())
        if row[j] > best:
            best, end = int(row[j]), j
    return best, end


def _reaching(items: Items, known: np.ndarray, item: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which windows share enough words with their items for LEAST_SCORE: no alignment matches more words than both sides have in common."""
    spots = np.flatnonzero(known >= 0)
    words_at, size = known[spots], len(items.vocabulary)
    lo, hi = np.searchsorted(spots, first), np.searchsorted(spots, end)
    least = LEAST_SCORE * items.sizes[item]
    enough = hi - lo >= least
    left = np.flatnonzero(enough)
    n = (hi - lo)[left]
    for i, j in runs(np.append(0, np.cumsum(n)), WINDOW_WORDS):
        own, k = left[i:j], n[i:j]
        each = np.repeat(np.arange(j - i), k)
        at = np.repeat(lo[own], k) + np.arange(len(each)) - np.repeat(np.cumsum(k) - k, k)
        key, times = np.unique(each * size + words_at[at], return_counts=True)
        window = key // size
        pair = item[own][window] * size + key % size
        place = np.minimum(np.searchsorted(items.bag, pair), len(items.bag) - 1)
        shared = np.where(items.bag[place] == pair, np.minimum(times, items.times[place]), 0)
        enough[own] = np.bincount(window, shared, j - i) >= least[own]
    return enough


def find(items: Items, hashes: np.ndarray, docs: np.ndarray, aligned: dict | None = None) -> Iterator[tuple[int, int, float, int, int]]:
    """(document, item, score, first word, end word) of the best window of each pair that reaches LEAST_SCORE. aligned: results of windows seen before."""
    if not len(items.seed):
        return
    seed, doc, at = shingles(hashes, docs, SEED_WORDS, short=False)
    lo = np.searchsorted(items.seed, seed, "left")
    hit = lo < len(items.seed)
    hit[hit] = items.seed[lo[hit]] == seed[hit]
    if not hit.any():
        return
    lo, doc, at = lo[hit], doc[hit], at[hit]
    n = np.searchsorted(items.seed, seed[hit], "right") - lo
    known = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
    known[items.vocabulary[known] != hashes] = -1
    aligned = {} if aligned is None else aligned
    ends = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
    for i, j in runs(np.append(0, np.cumsum(n))[ends], WINDOW_WORDS):
        part = slice(ends[i], ends[j])
        yield from _find(items, hashes, docs, known, lo[part], n[part], doc[part], at[part], aligned)


def _find(items: Items, hashes: np.ndarray, docs: np.ndarray, known: np.ndarray, lo: np.ndarray, n: np.ndarray, doc: np.ndarray, at: np.ndarray, aligned: dict) -> Iterator[tuple[int, int, float, int, int]]:
    each = np.repeat(np.arange(len(lo)), n)
    post = np.repeat(lo, n) + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    pair_doc, pair_item = doc[each], items.item[post]
    start = at[each] - items.place[post]
    order = np.lexsort((start, pair_item, pair_doc))
    pair_doc, pair_item, start = pair_doc[order], pair_item[order], start[order]
    sizes = items.sizes
    slack = sizes[pair_item] // 2
    cut = np.ones(len(start), bool)
    cut[1:] = (pair_doc[1:] != pair_doc[:-1]) | (pair_item[1:] != pair_item[:-1]) | (np.diff(start) > slack[1:])
    heads = np.flatnonzero(cut)
    last = start[np.append(heads[1:], len(start)) - 1]
    pair_doc, pair_item, start, slack = pair_doc[heads], pair_item[heads], start[heads], slack[heads]
    own_first, own_end = np.searchsorted(docs, pair_doc, "left"), np.searchsorted(docs, pair_doc, "right")
    first, end = np.maximum(own_first, start - slack), np.minimum(own_end, last + sizes[pair_item] + slack)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for x in np.flatnonzero(_reaching(items, known, pair_item, first, end)).tolist():
        d, i = int(pair_doc[x]), int(pair_item[x])
        m = int(sizes[i])
        if best.get((d, i), (0,))[0] >= 1.0:
            continue
        s, zero = int(start[x]), int(own_first[x])
        if s >= zero and s + m <= own_end[x] and np.array_equal(hashes[s : s + m], items.words[i]):
            best[d, i] = (1.0, s - zero, s + m - zero)
            continue
        a = int(first[x])
        text = hashes[a : int(end[x])]
        key = i, text.tobytes()
        if key not in aligned:
            if len(aligned) >= ALIGNED_MOST:
                aligned.clear()
            aligned[key] = align(items.words[i], text)
        points, stop = aligned[key]
        score = points / (MATCH * m)
        if score >= LEAST_SCORE and score > best.get((d, i), (0,))[0]:
            best[d, i] = (score, max(0, a + stop - m) - zero, a + stop - zero)
    for (d, i), (score, first_word, end_word) in best.items():
        yield d, i, score, max(0, first_word), end_word


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Items]:
    """The items in blocks of about BLOCK_BYTES; each block alone comes to the driver."""
    items = benchmark.where(F.length(F.trim(text_col)) > 0).select(item_col, text_col)
    size = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64(item_col, text_col), F.lit(blocks)) == b).orderBy(item_col, text_col).collect()
        if rows:
            yield Items([r[0] for r in rows], [r[1] for r in rows])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per (row of docs, item) that aligns: id, item_id, score (share of the full score), first_word, end_word.

    Exact, edited and partly paraphrased copies align; a document without any gives no row. Empty and null texts, and items of fewer than
    three words, align with nothing. Repeated rows and items are reported each. No shuffle of texts.
    """
    id_kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"`{id_col}` {id_kind.simpleString()}, `{item_col}` {item_kind.simpleString()}, score double, first_word long, end_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, item_col, text_col):

        def scan(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(_scan(items, batch.column(1)))
                if found:
                    d, i, score, first, end = zip(*found, strict=True)
                    names = pa.array([items.ids[x] for x in i])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), names, pa.array(score), pa.array(first, pa.int64()), pa.array(end, pa.int64())], [id_col, item_col, "score", "first_word", "end_word"])

        out = out.unionByName(docs.select(id_col, text_col).mapInArrow(scan, schema))
    return out


def _scan(items: Items, column: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
    data, at = utf8(column)
    aligned: dict = {}
    for i, j in runs(at, 500_000):
        hashes, doc, _ = words(data[at[i] : at[j]], at[i : j + 1] - at[i])
        for d, item, score, first, end in find(items, hashes, doc, aligned):
            yield i + d, item, score, first, end


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs without the rows that align with an item; columns and all other rows stay as they are."""
    for items in _blocks(benchmark, item_col, text_col):

        def clean(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dirty = np.zeros(len(batch), bool)
                dirty[[d for d, *_ in _scan(items, batch.column(batch.schema.get_field_index(text_col)))]] = True
                yield batch.filter(pa.array(~dirty)) if dirty.any() else batch

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
