"""Quality classifier: hashed word and character n-gram vectors averaged per document, softmax output, numpy SGD.

Labels are learned from a bounded, balanced sample (ROWS_PER_CLASS of each class, smallest hash of the id first), whose
features are built on the executors. The vector table and the output layer fold into one number per bucket, so scoring
is a narrow pass: the mean of the buckets' numbers over a document's features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm.kernels import SPACES, U, keyed, mix, runs, utf8, words
from factmill.llm.store import fresh

BUCKETS = 1 << 16
DIMENSIONS = 8
GRAMS = (3, 4)
#: Bound of the training sample, and passes of the descent over it.
ROWS_PER_CLASS = 1500
EPOCHS = 8
RATE = 0.6
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_RAW = mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))
_RAW[_SPACE] = _RAW[32]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every word, repeated-word mark and character n-gram, with repetitions.

    N-grams keep their case and may have white space only at either end, where it marks the border of a word. Whether a
    word repeats the one before is a word feature of its own. No feature crosses a document.
    """
    hashes, docs, _ = words(data, offsets)
    found = [hashes ^ U(0x1234567)]
    owner = [docs]
    if len(hashes) > 1:
        again = (hashes[1:] == hashes[:-1]).astype(U)
        same = docs[1:] == docs[:-1]
        found.append(mix(again[same] + U(99)))
        owner.append(docs[1:][same])
    n = len(data)
    if n:
        raw, blank = _RAW[data], _SPACE[data]
        at = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        step = keyed(8, 41)
        for k in GRAMS:
            if n < k:
                continue
            m = n - k + 1
            total = raw[:m] * step[0]
            keep = at[:m] == at[k - 1 :]
            for i in range(1, k):
                total += raw[i : i + m] * step[i]
                if i < k - 1:
                    keep &= ~blank[i : i + m]
            found.append(mix(total[keep] + U(k)))
            owner.append(at[:m][keep])
    return (np.concatenate(found) % U(BUCKETS)).astype(np.int32), np.concatenate(owner)


def bags(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, share of the document's features) of each document."""
    bucket, doc = features(data, offsets)
    for i in range(len(offsets) - 1):
        count = np.bincount(bucket[doc == i], minlength=1) if len(offsets) > 2 else np.bincount(bucket, minlength=1)
        b = np.flatnonzero(count)
        yield b.astype(np.int32), (count[b] / max(1, count.sum())).astype(np.float32)


def descend(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Train vectors and output layer; (number per bucket, bias) whose mean plus bias is the log-odds of label 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    if len(examples) == 0 or len(set(labels.tolist())) < 2:
        only = 0.0 if len(examples) == 0 else (4.0 if labels[0] else -4.0)
        return np.zeros(BUCKETS), only
    size, steps = 16, EPOCHS * -(-len(examples) // 16)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(examples))
        for i in range(0, len(order), size):
            rate = RATE * (1 - step / steps)
            step += 1
            pick = [p for p in order[i : i + size] if len(examples[p][0])]
            if not pick:
                continue
            bucket = np.concatenate([examples[p][0] for p in pick])
            share = np.concatenate([examples[p][1] for p in pick])
            lengths = np.array([len(examples[p][0]) for p in pick])
            hidden = np.add.reduceat(vectors[bucket] * share[:, None], np.append(0, np.cumsum(lengths)[:-1]))
            logits = hidden @ layer + bias
            chance = np.exp(logits - logits.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            chance[np.arange(len(pick)), labels[pick]] -= 1
            back = chance @ layer.T
            layer -= rate * (hidden.T @ chance)
            bias -= rate * 0.1 * chance.sum(0)
            change = np.repeat(back, lengths, 0) * (rate * 4 * share)[:, None]
            order_b = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(bucket[order_b]) > 0))
            vectors[bucket[order_b][first]] -= np.add.reduceat(change[order_b], first)
    fold = layer[:, 1] - layer[:, 0]
    return (vectors @ fold).astype(np.float64), float(bias[1] - bias[0])


def held_out(id_col: str, mod: int, rest: int):
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows_per_class: int = ROWS_PER_CLASS) -> tuple[np.ndarray, float]:
    """Model from at most rows_per_class labelled rows of each class; labels that are null or not 0 or 1, null ids, and the held-out third take no part.

    A label or document whose id is repeated is learned from once for each pair; null and empty texts have no features and change nothing but
    the bias. Without labelled rows every score is one half, with one class alone it is near that class.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, 3, 1)).select(id_col, F.col(label_col).cast("int").alias("__label"))
    order = [F.xxhash64(id_col), F.col(id_col)]
    sample = known.where("__label = 0").orderBy(*order).limit(rows_per_class).unionByName(known.where("__label = 1").orderBy(*order).limit(rows_per_class))
    text = docs.select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(sample), id_col)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            rows = [next(bags(data[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]))) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b, _ in rows], pa.binary()), pa.array([s.tobytes() for _, s in rows], pa.binary()), batch.column(2)], ["id", "buckets", "shares", "label"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = text.select(id_col, "__text", "__label").mapInArrow(build, f"id {kind}, buckets binary, shares binary, label int").collect()
    rows.sort(key=lambda r: (r["id"], r["label"], bytes(r["buckets"])))
    return descend([(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows], np.array([r["label"] for r in rows], int))


def log_odds(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    n = len(offsets) - 1
    out = np.full(n, bias)
    for i, j in runs(offsets, 500_000):
        bucket, doc = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        count = np.bincount(doc, minlength=j - i)
        out[i:j] += np.bincount(doc, weights[bucket], j - i) / np.maximum(count, 1)
    return out


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a double column `out` from 0 to 1, higher where label 1 is likelier. Empty and null texts get the bias alone; null ids and repeated
    rows are scored like others; very long texts are scored whole. A column of the name `out` is replaced; others stay. One narrow pass."""
    weights, bias = model
    hidden = fresh(docs, "__text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(batch.schema.get_field_index(hidden)))
            odds = log_odds(data, at, weights, bias)
            keep = [i for i, name in enumerate(batch.schema.names) if name != hidden]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))], [*(batch.schema.names[i] for i in keep), out])

    kept = [c for c in docs.columns if c != out]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{out}` double"])
    return docs.select(*kept, F.col(text_col).alias(hidden)).mapInArrow(score, schema)
