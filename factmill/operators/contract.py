"""The contract of extractor outputs: missing keys, types, defaults, faults of entities, and what an outcome is called in the audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill import config as C

#: The keys of an output, and the JSON types that they must have.
OUTPUT_KEYS = {"extractor": ("string",), "entities": ("array",), "confidence": ("number",), "latency_ms": ("integer",), "raw_text": ("string",), "notes": ("array",)}


def json_type(value: Column) -> Column:
    """array, object, string, integer, number, boolean or null of a JSON value's text."""
    v = F.trim(value)
    return (
        F.when(v.startswith("["), "array").when(v.startswith("{"), "object").when(v.startswith('"'), "string")
        .when(v.rlike(r"^-?\d+$"), "integer").when(v.rlike(r"^-?\d"), "number").when(v.isin("true", "false"), "boolean").otherwise("null")
    )


def checked_outputs(outputs: DataFrame, column: str = "output") -> DataFrame:
    """outputs with `missing` (keys that are not there, in order), `wrong` (the first key of a wrong type, null without one) and `fields` (key to JSON text)."""
    fields = F.from_json(column, "map<string,string>")
    names = F.array(*[F.lit(k) for k in sorted(OUTPUT_KEYS)])
    raw = F.transform_values(F.from_json(column, "map<string,variant>"), lambda _, v: F.to_json(v))
    out = outputs.withColumn("fields", raw)
    out = out.withColumn("missing", F.array_sort(F.array_except(names, F.coalesce(F.map_keys("fields"), F.array().cast("array<string>")))))
    wrong = F.lit(None).cast("string")
    for key, kinds in reversed(OUTPUT_KEYS.items()):
        allowed = (*kinds, "integer") if "number" in kinds else kinds
        wrong = F.when(~json_type(F.try_element_at("fields", F.lit(key))).isin(*allowed), key).otherwise(wrong)
    del fields
    return out.withColumn("wrong", F.when(F.size("missing") == 0, wrong))


def with_defaults(outputs: DataFrame, connector: Column) -> DataFrame:
    """outputs (extractor, actual_extractor, notes) with what a connector fills in: its own name, the extractor's name, no notes."""
    out = outputs.withColumn("extractor", F.coalesce("extractor", connector))
    return out.withColumn("actual_extractor", F.coalesce("actual_extractor", "extractor")).withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))


def entity_faults(entities: Column) -> Column:
    """Array of (index, code) of entities, given as JSON texts: no object, no type or text, a type that is not known, details of a wrong shape; one fault of an empty list."""

    def check(e: Column, i: Column) -> Column:
        one = lambda code: F.struct(i.alias("index"), F.lit(code).alias("code"))
        read = F.from_json(e, "map<string,variant>")
        get = lambda k: F.to_json(F.try_element_at(read, F.lit(k)))
        plain = lambda k: F.when(json_type(F.coalesce(get(k), F.lit("null"))) == "string", F.from_json(F.concat(F.lit('{"v":'), get(k), F.lit("}")), "v string")["v"])
        kind, text = plain("type"), plain("text")
        blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
        shape = json_type(F.coalesce(get("structured"), F.lit("null")))
        faults = F.array_compact(F.array(
            F.when(blank(kind), one("missing_required_field")).when(~kind.isin(*C.FACT_TYPES), one("invalid_entity_type")),
            F.when(blank(text), one("missing_required_field")), F.when(~shape.isin("object", "null"), one("invalid_schema_shape")),
        ))
        return F.when(json_type(e) != "object", F.array(one("entity_not_object"))).otherwise(faults)

    none = F.array(F.struct(F.lit(-1).alias("index"), F.lit("empty_extraction").alias("code")))
    return F.when(F.size(entities) == 0, none).otherwise(F.flatten(F.transform(entities, check)))


def gate_decision(outcome: Column, status: Column) -> Column:
    return F.when(outcome == "written", "accepted").when(outcome == "blocked_ddi", "blocked").when(status == "needs_review", "review").when(status == "rejected", "rejected").otherwise(outcome)


def error_category(outcome: Column, codes: Column, failures: Column) -> Column:
    return F.when(F.size(codes) > 0, F.get(codes, F.lit(0))).when(outcome == "blocked_ddi", "safety_gate_block").when(failures > 0, "connector_failure")


def fallback_reason(events: Column) -> Column:
    """Reason of the first event (action, reason) that invoked a fallback; null without one."""
    first = F.get(F.filter(events, lambda e: e["action"] == "fallback_invoked"), F.lit(0))
    return F.when(first.isNotNull(), F.coalesce(first["reason"], F.lit("fallback_invoked")))


#: Patterns and confidences of the local stand-in of a small model.
STAND_IN_DIAGNOSIS = r"(?i)\bdiagnosis\s*:?\s*([A-Za-z][A-Za-z ,/-]{2,80})"
STAND_IN_MEDICATION = r"(?i)\b([A-Z][A-Za-z-]{2,})\s+(\d+(?:\.\d+)?)\s*(mg|mcg|ml|g|units?)\b"


def stand_in(text: Column) -> Column:
    """struct(diagnosis, medication, dose, confidence) of the first diagnosis and the first dose of a text."""
    diagnosis = F.nullif(F.regexp_replace(F.regexp_extract(text, STAND_IN_DIAGNOSIS, 1), r"^[ .;]+|[ .;]+$", ""), F.lit(""))
    drug = F.nullif(F.regexp_extract(text, STAND_IN_MEDICATION, 1), F.lit(""))
    dose = F.when(drug.isNotNull(), F.concat(F.regexp_extract(text, STAND_IN_MEDICATION, 2), F.regexp_extract(text, STAND_IN_MEDICATION, 3)))
    found = F.regexp_like(text, F.lit(STAND_IN_DIAGNOSIS)) | drug.isNotNull()
    return F.struct(diagnosis.alias("diagnosis"), drug.alias("medication"), dose.alias("dose"), F.when(found, 0.68).otherwise(0.40).alias("confidence"))
