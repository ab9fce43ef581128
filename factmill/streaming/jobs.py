"""Streams: running connector profiles, and draining a pending queue into a keyed table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.sources.recordstore import RecordStore, Table
from factmill.sources.shared import scratch_folder

PROFILE = "connector string, attempts long, successes long, latency_total double, confidence_total double"


def running_profiles(attempts: DataFrame) -> DataFrame:
    """Update stream of each connector's totals from a stream (connector, success, latency_ms, confidence); the state is four numbers a connector."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ok, latency, confidence = state.get if state.exists else (0, 0, 0.0, 0.0)
        for b in batches:
            good = b[b["success"]]
            n, ok = n + len(b), ok + len(good)
            latency, confidence = latency + float(good["latency_ms"].sum()), confidence + float(good["confidence"].sum())
        state.update((n, ok, latency, confidence))
        yield pd.DataFrame({"connector": [key[0]], "attempts": [n], "successes": [ok], "latency_total": [latency], "confidence_total": [confidence]})

    return attempts.groupBy("connector").applyInPandasWithState(step, PROFILE, "n long, ok long, latency double, confidence double", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Events per window and type, with rows later than the watermark dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"))


def drain(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "id", order: str = "seq") -> RecordStore:
    """Commit all JSON lines that are new in `source` to the record store at `target`, a batch at a time; a restart repeats no batch.

    Table `rows` has the lines by key, the last in order of each; lines that are no JSON of the schema, or have no key, are in `rejected`.
    """
    held = RecordStore(spark, target, {"rows": Table(schema, key), "rejected": Table("line string, batch long")})

    def write(batch: DataFrame, number: int) -> None:
        good = F.col("_corrupt_record").isNull() & F.col(key).isNotNull()
        line = F.coalesce("_corrupt_record", F.to_json(F.struct(*held.schemas["rows"].names)))
        rejected = batch.where(~good).select(line.alias("line"), F.lit(number).cast("long").alias("batch"))
        held.commit({"rows": batch.where(good).drop("_corrupt_record"), "rejected": rejected}, checkpoint, number, order)

    stream = spark.readStream.schema(f"{schema}, _corrupt_record string").json(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return held


def _folder(spark: SparkSession) -> str:
    """A new folder for what a replayed stream puts out."""
    return f"{scratch_folder(spark)}/replay-{uuid.uuid4().hex}"


def replay(stream: DataFrame, mode: str = "update") -> DataFrame:
    """Run a stream over what is there now, and return what it has put out: one Parquet folder a batch, of which a complete stream's last one counts."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)
    batches: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/b{number}")
        batches.append(number)

    stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/b{n}" for n in (batches[-1:] if mode == "complete" else sorted(set(batches)))])
