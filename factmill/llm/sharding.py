"""Sharding by a Feistel permutation over global row numbers.

Rows are numbered 0..N-1 in the order of (id, size, checksum). A keyed Feistel network permutes the numbers; results
outside the domain are permuted again until they fall inside (cycle walking), so the walk is a bijection on 0..N-1.
Shard = permuted number mod shards, slot = permuted number div shards: shard counts differ by one at most, slots have no
gaps, and `locate` computes both from a row number alone, without the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm.kernels import U, mix
from factmill.llm.store import materialize

ROUNDS = 6


def _network(x: np.ndarray, half: int, seed: int, order: range) -> np.ndarray:
    mask, shift = U((1 << half) - 1), U(half)
    left, right = x >> shift, x & mask
    forward = order.step > 0
    for r in order:
        key = U((seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)
        if forward:
            left, right = right, left ^ (mix(right + key) & mask)
        else:
            left, right = right ^ (mix(left + key) & mask), left
    return (left << shift) | right


def _walk(x: np.ndarray, n: int, seed: int, order: range) -> np.ndarray:
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out = _network(np.asarray(x, U), half, seed, order)
    while len(far := np.flatnonzero(out >= U(n))):
        out[far] = _network(out[far], half, seed, order)
    return out.astype(np.int64)


def permute(row: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Place of each row number in the shuffled order of n rows. The network's domain is below 8n, so few walks are long."""
    return _walk(row, n, seed, range(ROUNDS))


def unpermute(place: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row number at each place: the inverse of permute."""
    return _walk(place, n, seed, range(ROUNDS - 1, -1, -1))


def locate(row: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of each row number."""
    place = permute(row, n, seed)
    return place % shards, place // shards


def number_rows(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """df with a gapless `row` in the order of the given columns, and the number of rows.

    One range shuffle of df; what comes to the driver is one count per partition.
    """
    numbered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    numbered = materialize(numbered, "rows")
    counts = {r["part"]: r["n"] for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect()}
    firsts, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        firsts.append(total)
        total += counts.get(part, 0)
    first = F.lit(firsts or [0])
    return numbered.withColumn("row", F.get(first, F.col("part")).cast("long") + F.col("seq")).drop("part", "seq"), total


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes + 1), text_crc32, law 'rows', shard, slot, grown_shard (null: it belongs to another law).

    Null text: size 1, null checksum. Null ids come first. Equal rows get row numbers, and so slots, of their own.
    An empty table gives no rows. Other columns are not carried, so none can clash.
    """
    text = F.col(text_col)
    narrow = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows, n = number_rows(narrow, id_col, "size", "text_crc32")

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    at = F.col("place")
    return rows.withColumn("place", place("row")).select(
        id_col,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (at % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row",
    )
