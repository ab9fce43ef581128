"""Truth resolution: rule chains on a pair of records, and the fold of a batch in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factmill import config as C


#: Key of the records that pairs() sets against each other.
PAIRED = ("fact_type", "name", "subject_id")


def pairs(records: DataFrame) -> DataFrame:
    """Each record with the one before it of the same fact type, name and subject: columns of the earlier one begin with `old_`."""
    w = W.partitionBy(*PAIRED).orderBy("id", "first_recorded", "value", "trust_level", "source_count", "confidence")
    cols = ["id", "trust_level", "source_count", "confidence", "value", "first_recorded"]
    return records.withColumns({f"old_{c}": F.lag(c).over(w) for c in cols}).where("old_id IS NOT NULL")


def days_apart(new: Column, old: Column) -> Column:
    """Whole days between two times, floored before the sign is dropped."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.abs(F.floor((micros(new) - micros(old)) / F.lit(86_400_000_000)).cast("long"))


def _verdict(action: str, confidence: float, rule: str) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule"))


def _chain(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = None
    for cond, verdict in rules:
        out = F.when(cond, verdict) if out is None else out.when(cond, verdict)
    return out.otherwise(otherwise)


def knowledge_rules(conflict_type: str = "value_conflict") -> Column:
    """Seven rules of the knowledge base: the first that holds."""
    new, old = F.col("trust_level"), F.col("old_trust_level")
    apart, newer = days_apart(F.col("first_recorded"), F.col("old_first_recorded")), F.col("first_recorded") > F.col("old_first_recorded")
    stale = (new == old) & (apart > C.DEFAULT.recency_days)
    value = F.lit(conflict_type == "value_conflict")
    return _chain(
        [
            ((old == 1) & (new > 1), _verdict("keep_existing", 0.95, "clinical_supremacy")),
            ((new == 1) & (old > 1), _verdict("replace_with_new", 0.95, "clinical_supremacy")),
            ((old == 2) & (new == 3), _verdict("keep_existing", 0.90, "peer_review_beats_ai")),
            ((new == 2) & (old == 3), _verdict("replace_with_new", 0.90, "peer_review_beats_ai")),
            (stale & newer, _verdict("replace_with_new", 0.80, "recency_same_trust")),
            (stale, _verdict("keep_existing", 0.80, "recency_same_trust")),
            ((F.col("source_count") > F.col("old_source_count")) & (F.col("source_count") >= 2), _verdict("replace_with_new", 0.75, "source_agreement")),
            (value & (F.col("fact_type") == "test_result"), _verdict("merge", 0.70, "value_range_merge")),
            (value & (F.col("fact_type") == "medication"), _verdict("quarantine", 0.0, "medication_dose_conflict")),
        ],
        _verdict("quarantine", 0.0, "unresolvable"),
    )


def governance_rules() -> Column:
    """Governance chain: the first that holds. A medication's value is its dose."""
    new, old = F.col("trust_level"), F.col("old_trust_level")
    apart = days_apart(F.col("first_recorded"), F.col("old_first_recorded"))
    same_value = F.col("value").eqNullSafe(F.col("old_value"))
    identical = (new == old) & (F.col("source_count") == F.col("old_source_count")) & (apart <= C.DEFAULT.recency_days) & same_value
    stale, newer = (new == old) & (apart > C.DEFAULT.recency_days), F.col("first_recorded") > F.col("old_first_recorded")
    numeric = F.col("value").isNotNull() & F.col("old_value").isNotNull() & (apart <= C.DEFAULT.recency_days)
    return _chain(
        [
            (identical, _verdict("merge", 0.95, "materially_identical_records_merge")),
            ((old == 1) & (new > 1), _verdict("keep_existing", 0.95, "trust_level_1_beats_lower_trust")),
            ((new == 1) & (old > 1), _verdict("replace_with_new", 0.95, "trust_level_1_beats_lower_trust")),
            ((old == 2) & (new >= 3), _verdict("keep_existing", 0.9, "peer_review_beats_ai")),
            ((new == 2) & (old >= 3), _verdict("replace_with_new", 0.9, "peer_review_beats_ai")),
            (stale & newer, _verdict("replace_with_new", 0.8, "same_trust_newer_than_90_days")),
            (stale, _verdict("keep_existing", 0.8, "same_trust_newer_than_90_days")),
            ((F.col("source_count") >= 2) & (F.col("old_source_count") <= 1) & (new <= old), _verdict("replace_with_new", 0.78, "multi_source_replaces_weaker_single_source")),
            (numeric, _verdict("merge", 0.72, "numeric_same_period_merge")),
            ((F.col("fact_type") == "medication") & ~same_value, _verdict("quarantine", 0.0, "medication_dose_conflict")),
        ],
        _verdict("quarantine", 0.0, "unresolved_conflict_quarantines_candidate"),
    )


#: Fixed value: difference of confidence from which the better record wins.
LEAST_DELTA = 0.1


def _folded(records: DataFrame, existing: DataFrame | None, columns: list[str], key: tuple[str, ...], order: str, start: Callable, step: Callable) -> DataFrame:
    """(id, action, confidence, rule, existing_id) of each record against the state of its key, in order.

    The state begins with the last existing record of the key, or with the first record. It is one record, so rows stream through in sorted order:
    one shuffle on the key, and memory does not grow with a key's length. start(id, values) makes a state, step(state, id, values)
    gives (action, confidence, rule, next state).
    """
    schema = "id long, action string, confidence double, rule string, existing_id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for k, known, i, *values in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
                if k != at:
                    at, state = k, None
                if known == 0:
                    state = start(i, values)
                elif state is None:
                    state = start(i, values)
                    out.append((i, "replace_with_new", 1.0, "no_match", None))
                else:
                    own = state[0]
                    action, confidence, rule, state = step(state, i, values)
                    out.append((i, action, confidence, rule, own))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "action", "confidence", "rule", "existing_id"])

    keyed = lambda df, known: df.select(F.to_json(F.struct(*key)).alias("k"), F.lit(known).alias("known"), F.col(order).cast("long").alias(order), *columns)
    rows = keyed(records, 1) if existing is None else keyed(records, 1).unionByName(keyed(existing, 0))
    return rows.repartition("k").sortWithinPartitions("k", "known", order, *columns).mapInArrow(run, schema)


KEY = ("fact_type", "name", "subject_id")


def fold(records: DataFrame, existing: DataFrame | None = None, key: tuple[str, ...] = KEY, order: str = "id") -> DataFrame:
    """(id, action, confidence, existing_id) of each record against the latest resolved or existing record of its key, in order.

    Equal values merge once (a merged record is marked, so a later equal value no longer is); a confidence at least LEAST_DELTA apart
    decides; the rest is quarantined and leaves the state alone.
    """

    def start(i: int, values: list) -> tuple:
        return i, (values[0], False), values[1]

    def step(state: tuple, i: int, values: list) -> tuple:
        own, signature, best = state
        value, c = values
        delta = round(c - best, 3)
        if signature == (value, False):
            return "merge", 0.95, "same_value", (own, (value, True), max(best, c))
        if delta >= LEAST_DELTA:
            return "replace_with_new", 0.8, "confidence", (own, (value, False), c)
        return ("keep_existing", 0.8, "confidence", state) if delta <= -LEAST_DELTA else ("quarantine", 0.0, "undecided", state)

    return _folded(records, existing, ["value", "confidence"], key, order, start, step).drop("rule")


def governance_fold(records: DataFrame, existing: DataFrame | None = None, key: tuple[str, ...] = KEY, order: str = "id") -> DataFrame:
    """(id, action, confidence, rule, existing_id) of each record by the governance chain against the state of its key, in order.

    A replacement takes over the existing id; a merge keeps the existing record's trust, sources and date and takes the new value; keeping and
    quarantine leave the state alone. A medication's value is its dose.
    """

    def start(i: int, values: list) -> tuple:
        return i, *values

    def step(state: tuple, i: int, values: list) -> tuple:
        own, old_trust, old_sources, old_time, old_value, _ = state
        trust, sources, time, value, kind = values
        apart = abs((time - old_time) // 86_400_000_000) if None not in (time, old_time) else 0
        merged, replaced = (own, old_trust, old_sources, old_time, value, kind), (own, *values)
        level = trust == old_trust
        if level and sources == old_sources and apart <= C.DEFAULT.recency_days and value == old_value:
            return "merge", 0.95, "materially_identical_records_merge", merged
        for best, rule, confidence in ((1, "trust_level_1_beats_lower_trust", 0.95), (2, "peer_review_beats_ai", 0.9)):
            if old_trust == best < trust:
                return "keep_existing", confidence, rule, state
            if trust == best < old_trust:
                return "replace_with_new", confidence, rule, replaced
        if level and apart > C.DEFAULT.recency_days:
            return ("replace_with_new", 0.8, "same_trust_newer_than_90_days", replaced) if time > old_time else ("keep_existing", 0.8, "same_trust_newer_than_90_days", state)
        if sources >= 2 and old_sources <= 1 and trust <= old_trust:
            return "replace_with_new", 0.78, "multi_source_replaces_weaker_single_source", replaced
        if value is not None and old_value is not None and apart <= C.DEFAULT.recency_days:
            return "merge", 0.72, "numeric_same_period_merge", merged
        if kind == "medication" and value != old_value:
            return "quarantine", 0.0, "medication_dose_conflict", state
        return "quarantine", 0.0, "unresolved_conflict_quarantines_candidate", state

    timed = lambda df: df.withColumn("micros", F.unix_micros(F.col("first_recorded").cast("timestamp"))).withColumn("kind", F.col("fact_type"))
    return _folded(timed(records), None if existing is None else timed(existing), ["trust_level", "source_count", "micros", "value", "kind"], key, order, start, step)


def merged_range(records: DataFrame) -> DataFrame:
    """Least and greatest value of the records of a key, and how many there are."""
    return records.groupBy("fact_type", "name", "subject_id").agg(F.min("value").alias("range_min"), F.max("value").alias("range_max"), F.count("*").alias("n"))


