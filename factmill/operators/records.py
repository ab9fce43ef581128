"""Extractor outputs as records: one projection for each kind of source, and marks on records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY_TYPES = ("diagnosis", "medication", "test_result", "symptom", "note", "recommendation")
#: Fixed value: marks that redaction leaves in a text.
PLACEHOLDER = r"\[(?:PERSON|LOCATION|DATE|CONTACT_REMOVED|ID_REMOVED|URL_REMOVED|PHYSICIAN)\]"


def content(fact_type: Column, text: Column, structured: Column) -> Column:
    """The line that shows a record."""
    get = lambda k: F.nullif(F.try_element_at(structured, F.lit(k)), F.lit(""))
    value = F.when(get("value").isNotNull(), F.rtrim(F.concat(F.lit(": "), F.concat_ws(" ", get("value"), get("unit"))))).otherwise("")
    return (
        F.when(fact_type == "diagnosis", F.concat(F.lit("Diagnosis: "), text))
        .when(fact_type == "medication", F.concat_ws(" ", F.concat(F.lit("Medication: "), text), get("dose"), get("frequency")))
        .when(fact_type == "test_result", F.concat(F.lit("Test: "), text, value))
        .when(fact_type == "symptom", F.concat(F.lit("Symptom: "), text))
        .when(fact_type == "recommendation", F.concat(F.lit("Recommendation: "), text))
        .otherwise(F.substr(text, F.lit(1), F.lit(500)))
    )


def from_entities(payloads: DataFrame, doc: str = "doc_id", kept: tuple[str, ...] = ()) -> DataFrame:
    """(doc, ord, fact_type, name, content, structured, source_type, trust_level, confidence, tier, status, extraction_method) and the kept columns from
    (doc, entities array<struct<type, text, structured map>>, confidence, extraction_method). Blank texts go; unknown types are notes."""
    e = payloads.select(doc, *kept, "confidence", "extraction_method", F.posexplode("entities").alias("ord", "e")).where("trim(e.text) <> ''")
    kind = F.when(F.col("e.type").isin(*ENTITY_TYPES), F.col("e.type")).otherwise("note")
    text = F.trim("e.text")
    named = F.when(kind.isin("diagnosis", "medication"), "name").otherwise("text")
    rest = F.map_filter(F.coalesce("e.structured", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: ~k.isin("type", "text", "name"))
    return e.select(
        doc, "ord", kind.alias("fact_type"), text.alias("name"), content(kind, text, F.col("e.structured")).alias("content"), F.map_concat(F.map_from_arrays(F.array(named), F.array(text)), rest).alias("structured"),
        F.lit("extraction").alias("source_type"), F.lit(1).alias("trust_level"), "confidence", F.lit("active").alias("tier"), F.lit("active").alias("status"), "extraction_method", *kept,
    )


#: For each source, the lists that become records: (list, fact type, lead of the content, factor of the confidence), trust level, tier.
SOURCES = {
    "document": ([("diagnoses", "diagnosis", "Diagnosis: ", 1.0), ("medications", "medication", "Medication: ", 1.0), ("test_results", "test_result", "Test: ", 1.0), ("notes", "note", "", 0.8)], 1, "active"),
    "web": ([("diagnoses", "diagnosis", "Web source: ", 0.75), ("recommendations", "recommendation", "Web recommendation: ", 0.70)], None, "hypothesis"),
    "ai_response": ([("diagnoses", "diagnosis", "AI-suggested diagnosis: ", 0.9), ("medications", "medication", "AI-suggested medication: ", 0.85), ("recommendations", "recommendation", "AI recommendation: ", 0.8)], 3, "hypothesis"),
}


def from_lists(outputs: DataFrame, source: str, doc: str = "doc_id") -> DataFrame:
    """Records of one source from (doc, one array<string> column for each list, confidence[, trust_level]); lists that a source does not keep are dropped."""
    lists, trust, tier = SOURCES[source]
    parts = []
    for name, kind, lead, factor in lists:
        level = F.lit(trust) if trust is not None else F.col("trust_level")
        parts.append(outputs.select(doc, F.lit(kind).alias("fact_type"), F.explode(name).alias("name"), (F.col("confidence") * factor).alias("confidence"), level.cast("int").alias("trust_level")).withColumn("content", F.concat(F.lit(lead), F.substr(F.col("name"), F.lit(1), F.lit(500 if kind == "note" else 300)))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({"source_type": F.lit(source), "tier": F.lit(tier)})


def flatten_output(lists: dict[str, str]) -> Column:
    """entities array<struct<type, text, structured>> from list columns, in the order given: {column: type}."""
    one = lambda t: lambda x: F.struct(F.lit(t).alias("type"), x.alias("text"), F.map_from_arrays(F.array(F.lit("text")), F.array(x)).alias("structured"))
    return F.concat(*[F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), one(t)) for c, t in lists.items()])


SCORES = (("IBS", "ibs_score"), ("Diverticulitis", "diverticulitis_score"), ("Oxalates", "oxalates_score"), ("Crystalluria", "crystalluria_score"))


def from_foods(foods: DataFrame) -> DataFrame:
    """One note for each food (doc_id, ord, food_name, food_name_ru, the four scores, safety_category, confidence): the first of a name in a document."""
    key = F.lower(F.trim("food_name"))
    first = foods.where(F.trim("food_name") != "").groupBy("doc_id", key.alias("key")).agg(F.min_by(F.struct(*foods.columns), "ord").alias("f")).select("key", "f.*")
    scores = F.concat_ws(", ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{n}="), F.col(c).cast("string"))) for n, c in SCORES])
    line = F.concat_ws(
        " ", F.concat(F.lit("Food: "), F.col("food_name")), F.when(F.coalesce("food_name_ru", F.lit("")) != "", F.concat(F.lit("(ru: "), F.col("food_name_ru"), F.lit(")"))),
        F.when(scores != "", F.concat(F.lit("| Scores: "), scores)), F.when(F.coalesce("safety_category", F.lit("")) != "", F.concat(F.lit("| Safety: "), F.col("safety_category"))),
    )
    tags = F.array_compact(F.array(F.lit("food_guide"), F.lit("food_entry"), F.nullif(F.lower("safety_category"), F.lit(""))))
    return first.select("doc_id", F.lit("note").alias("fact_type"), F.col("food_name").alias("name"), F.substr(line, F.lit(1), F.lit(500)).alias("content"), tags.alias("tags"), "confidence")


def shown(records: DataFrame) -> DataFrame:
    """records with `shown` and `stale`: content with marks of redaction gives way to the name."""
    marked, clean = F.col("content").rlike(PLACEHOLDER), ~F.col("name").rlike(PLACEHOLDER)
    title = F.initcap(F.replace(F.col("fact_type"), F.lit("_"), F.lit(" ")))
    return records.withColumn("shown", F.when(marked & F.coalesce(clean, F.lit(False)), F.concat(title, F.lit(": "), F.col("name"))).otherwise(F.col("content"))).withColumn("stale", marked)


def for_review(records: DataFrame, codes: str = "codes") -> DataFrame:
    """records of documents that failed validation, quarantined with the reasons in `structured`."""
    reasons = F.map_from_arrays(F.array(F.lit("review_reasons")), F.array(F.array_join(codes, ",")))
    kept = F.map_filter("structured", lambda k, _: k != "review_reasons")
    return records.withColumns({"tier": F.lit("quarantined"), "status": F.lit("pending_validation_review"), "structured": F.map_concat(kept, reasons)})
