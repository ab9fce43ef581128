"""The record store as tables: scans, keyed upsert, change sets, ledger rows, migration, conflicts and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factmill.sources.shared import dealt, materialize


def point_lookup(records: DataFrame, record_id) -> DataFrame:
    return records.where(F.col("id") == record_id)


def active_of_type(records: DataFrame, fact_type: str) -> DataFrame:
    return records.where((F.col("fact_type") == fact_type) & (F.col("status") == "active") & (F.col("tier") == "active"))


def recent_conflicts(records: DataFrame, as_of: Column, days: int = 0, time_col: str = "first_recorded") -> DataFrame:
    """Conflicted records confirmed in the last `days`; by default those of the day itself."""
    return records.where((F.col("status") == "conflicted") & (F.col(time_col).cast("date") >= F.date_sub(as_of, days)))


def by_specialty(records: DataFrame, specialty: str, tier: str | None = None) -> DataFrame:
    out = records.where((F.col("specialty") == specialty) & (F.col("status") == "active"))
    return out.where(F.col("tier") == tier) if tier else out


def latest(records: DataFrame, n: int = 50, tier: str | None = None) -> DataFrame:
    """The n newest records, by id where times are equal."""
    out = records.where(F.col("tier") == tier) if tier else records
    return out.orderBy(F.desc("first_recorded"), "id").limit(n)


def counts(records: DataFrame) -> DataFrame:
    n = lambda t: F.count_if(F.col("tier") == t).cast("long").alias(t)
    return records.agg(F.count("*").alias("total"), n("active"), n("hypothesis"), n("quarantined"))


def upsert(table: DataFrame, changes: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The table after inserting or replacing by key; of several changes of a key the last in `order` stays."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in table.columns]), order).alias("r")).select("r.*")
    return table.join(last.select(key), key, "left_anti").unionByName(last)


def apply_status(records: DataFrame, changes: DataFrame, as_of: Column, time_col: str = "first_recorded") -> DataFrame:
    """records after a change set (id, status, tier): nulls leave a column alone; the confirmation time is set."""
    c = changes.select("id", F.col("status").alias("__status"), F.col("tier").alias("__tier"), F.lit(True).alias("__hit"))
    out = records.join(c, "id", "left")
    return out.withColumns({"status": F.coalesce("__status", "status"), "tier": F.coalesce("__tier", "tier"), time_col: F.when(F.col("__hit"), as_of).otherwise(F.col(time_col))}).select(*records.columns)


def deduplicated(records: DataFrame, order: str) -> DataFrame:
    """One row per id: the last in order."""
    return records.withColumn("__r", F.row_number().over(W.partitionBy("id").orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def ledger(records: DataFrame, event_type: str, details: Column, at: Column) -> DataFrame:
    return records.select(F.lit(event_type).alias("event_type"), F.col("id").alias("record_id"), "source_type", F.to_json(details).alias("details"), at.alias("timestamp"))


def backfill(records: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """records as facts, without those that facts has already; the name falls back to the content, the value is a number where it is one."""
    new = records if facts is None else records.join(facts.select("id"), "id", "left_anti")
    return new.select(
        "id", F.col("fact_type").alias("entity_type"), F.coalesce(F.nullif("name", F.lit("")), F.lit("")).alias("entity_name"), F.col("value").cast("double").alias("normalized_value"),
        F.when(F.col("first_recorded").isNotNull(), 1.0).otherwise(0.5).alias("temporal_confidence"), F.lit("patient").alias("subject"), F.lit("confirmed").alias("certainty"), F.lit(1).alias("occurrence_count"),
        "trust_level", "confidence", "tier", "status", "specialty", "source_type", "extraction_method",
    )


def facts_unified(facts: DataFrame, records: DataFrame) -> DataFrame:
    """Facts, and records that are no facts yet, in the facts' columns."""
    return facts.unionByName(backfill(records, facts).select(*facts.columns))


def conflict_rows(found: DataFrame, at: Column, *more: str) -> DataFrame:
    """Pending conflict rows from (id, match_id, conflict_type, severity); the key is a hash of what it is about. Columns named in `more` come along."""
    return found.select(F.sha2(F.concat_ws("/", F.col("id").cast("string"), F.col("match_id").cast("string"), "conflict_type"), 256).alias("conflict_id"), "id", "match_id", "conflict_type", "severity", F.lit("pending").alias("status"), at.alias("created_at"), *more)


def severity_rank(c: Column) -> Column:
    return F.when(c == "critical", 0).when(c == "high", 1).when(c == "medium", 2).otherwise(3)


def pending(conflicts: DataFrame, severity: str | None = None) -> DataFrame:
    """Pending conflicts, the most severe and newest first."""
    out = conflicts.where("status = 'pending'")
    out = out.where(F.col("severity") == severity) if severity else out
    return out.orderBy(severity_rank(F.col("severity")), F.desc("created_at"), "conflict_id")


CHOICES = ("fact1", "fact2", "both", "neither", "merge")


def resolve(conflicts: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(change set of records, rejected decisions) from decisions (conflict_id, choice); only pending conflicts and known choices are carried out."""
    joined = decisions.join(dealt(conflicts.select("conflict_id", "id", "match_id", F.col("status").alias("state"))), "conflict_id", "left")
    error = F.when(~F.col("choice").isin(*CHOICES), "invalid_choice").when(F.col("state").isNull(), "unknown_conflict").when(F.col("state") != "pending", "not_pending")
    marked = joined.withColumn("error", error)
    win, lose, merged = ("active", "active"), ("rejected", "superseded"), ("merged", "superseded")
    one = lambda who, s: F.struct(F.col(who).alias("id"), F.lit(s[0]).alias("status"), F.lit(s[1]).alias("tier"))
    # fact1 is the existing record, fact2 the new one
    both = lambda a, b: F.array(one("match_id", a), one("id", b))
    choice = F.col("choice")
    changes = F.when(choice == "fact1", both(win, lose)).when(choice == "fact2", both(lose, win)).when(choice == "both", both(win, win)).when(choice == "neither", both(lose, lose)).otherwise(both(merged, merged))
    good = marked.where("error IS NULL").select("conflict_id", F.explode(changes).alias("c")).select("conflict_id", "c.id", "c.status", "c.tier")
    return good, marked.where("error IS NOT NULL").select("conflict_id", "choice", "error")


def review(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Change set of reviewer decisions (id, decision): accept, reject; defer changes nothing."""
    d = decisions.where(F.col("decision").isin("accept", "reject"))
    return d.join(records.select("id"), "id", "left_semi").select("id", F.when(F.col("decision") == "accept", "active").otherwise("archived").alias("status"), F.when(F.col("decision") == "accept", "active").otherwise("superseded").alias("tier"))


#: Ranges into which a pass of a selection cuts the values that are left of a group.
RANGES = 1024


def selected(values: DataFrame, places: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value): the value at a place (group, place; from 1, ascending) of each group of values without nulls or NaN, by counting.

    A pass counts the values of each range of a group's bracket and keeps the range that has the place, until that is a single value. Counts are
    added up before they are shuffled and a group has at most RANGES of them, so no task sees a group's values. Groups are matched null to null.
    """
    rows = values.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    spans = rows.groupBy("g").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n"))
    marks = spans.join(places.select(F.col(group).alias("h"), "place"), F.col("g").eqNullSafe(F.col("h"))).where("place BETWEEN 1 AND n").select("g", "least", "most", "place")
    marks = materialize(marks, "marks")
    done = marks.where("least = most").select("g", "least")
    left = marks.where("least < most")
    while not left.isEmpty():
        own = left.select(F.col("g").alias("h"), "least", "most", "place")
        met = rows.join(own, F.col("g").eqNullSafe(F.col("h")) & F.col("v").between(F.col("least"), F.col("most")))
        width = F.col("most") - F.col("least")
        half = lambda c: F.col(c) / 2
        share = F.when(width < float("inf"), (F.col("v") - F.col("least")) / width).otherwise((half("v") - half("least")) / (half("most") - half("least")))
        at = F.when(F.col("v") == F.col("most"), RANGES - 1).otherwise(F.least(F.floor(share * RANGES), F.lit(RANGES - 2)))
        counted = met.groupBy("g", "place", at.alias("at")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        below = F.sum("n").over(W.partitionBy("g").orderBy("at"))
        marks = counted.withColumn("upto", below).where("upto >= place AND upto - n < place").select("g", "least", "most", (F.col("place") - (F.col("upto") - F.col("n"))).alias("place"))
        marks = materialize(marks, "marks")
        done, left = done.unionByName(marks.where("least = most").select("g", "least")), marks.where("least < most")
    return done.select(F.col("g").alias(group), F.col("least").alias(value))


def audit_performance(times: DataFrame, value: str = "value", tier: str = "tier") -> DataFrame:
    """(tier, n, average, p95): nearest-rank 95th percentile of at least five values, else null. One row per tier; values are counted by range, neither gathered nor ranked."""
    sized = times.select(tier, value).where(F.col(value).isNotNull())
    n = sized.groupBy(tier).agg(F.count("*").alias("n"), F.round(F.avg(value), 3).alias("average"))
    places = n.where("n >= 5").select(tier, F.greatest(F.lit(1), F.rint(F.col("n") * 0.95).cast("long")).alias("place"))
    p95 = selected(sized, places, tier, value).select(F.col(tier).alias("__tier"), F.round(value, 3).alias("p95"))
    return n.join(p95, F.col(tier).eqNullSafe(F.col("__tier")), "left").drop("__tier")
