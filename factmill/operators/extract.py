"""Extractor outputs: consensus, validation, metrics, connector profiles and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill import config as C


def consensus(extractions: DataFrame) -> DataFrame:
    """One row per document from (doc_id, extractor, entity_type, entity_text, confidence, latency_ms): agreement and consensus confidence.

    An entity's support is (sources - 1) / (all sources - 1); a single source agrees with itself.
    """
    kind, text = F.lower(F.trim("entity_type")), F.lower(F.trim("entity_text"))
    entity = extractions.groupBy("doc_id", kind.alias("t"), text.alias("x")).agg(F.count_distinct("extractor").alias("n"))
    source = extractions.groupBy("doc_id", "extractor").agg(F.max("confidence").alias("confidence"), F.max("latency_ms").alias("latency_ms"))
    total = source.groupBy("doc_id").agg(F.count("*").alias("n_sources"), F.round(F.avg("confidence"), 3).alias("avg_confidence"), F.sum("latency_ms").cast("long").alias("latency_ms"))
    seen = entity.groupBy("doc_id").agg(F.count("*").alias("n_entities"), F.sum(F.col("n") - 1).alias("support"), F.min("n").alias("least"))
    alone = F.col("n_sources") == 1
    agreement = F.when(alone, 1.0).otherwise(F.round(F.col("support") / ((F.col("n_sources") - 1) * F.col("n_entities")), 3))
    out = total.join(seen, "doc_id").withColumn("agreement_score", agreement)
    return out.select(
        "doc_id", "n_sources", "n_entities", "latency_ms", "avg_confidence", "agreement_score",
        F.when(alone, F.col("avg_confidence")).otherwise(F.round(F.col("avg_confidence") * F.col("agreement_score"), 3)).alias("confidence"),
        (F.col("least") < F.col("n_sources")).alias("disagreement_flag"),
    )


def merged_entities(payloads: DataFrame) -> DataFrame:
    """(doc_id, type, text, entity, sources): the heaviest entity of each key, the first of equal weight, with its sources in order.

    payloads: (doc_id, ord, extractor, entities array<struct<type, text, structured map>>).
    """
    e = payloads.select("doc_id", "ord", "extractor", F.posexplode("entities").alias("pos", "entity"))
    e = e.withColumn("weight", F.size("entity.structured"))
    kind, text = F.lower(F.trim("entity.type")), F.lower(F.trim("entity.text"))
    grouped = e.groupBy("doc_id", kind.alias("type"), text.alias("text")).agg(
        F.max_by("entity", F.struct("weight", -F.col("ord"), -F.col("pos"))).alias("entity"), F.array_sort(F.collect_set(F.struct("ord", "extractor"))).alias("s")
    )
    return grouped.select("doc_id", "type", "text", "entity", F.array_distinct(F.transform("s", lambda x: x["extractor"])).alias("sources"))


def band(confidence: Column, accept: float = C.DEFAULT.extraction_accept, review: float = C.DEFAULT.extraction_review) -> Column:
    return F.when(confidence < review, "reject").when(confidence < accept, "review").otherwise("auto_accept")


def response_band(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.50, "acceptable").when(score >= 0.30, "low").otherwise("discarded")


def issues(confidence: Column, agreement: Column, disagrees: Column, n_entities: Column, route: Column | None = None, actual: Column | None = None, fallback: Column | None = None) -> Column:
    """Array of (code, severity), in order."""
    one = lambda code, severity: F.struct(F.lit(code).alias("code"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"))
    found = []
    if route is not None:
        found.append(F.when(~route.eqNullSafe(actual), one("route_actual_mismatch", F.when(fallback, "warning").otherwise("fatal"))))
    found += [
        F.when(n_entities == 0, one("empty_entities", "fatal")),
        F.when(agreement < C.DEFAULT.consensus_review, one("agreement_below_reject_threshold", "fatal")).when(agreement < C.DEFAULT.consensus_accept, one("agreement_below_accept_threshold", "warning")),
        F.when(disagrees, one("consensus_disagreement_flag", "warning")),
        F.when(confidence < C.DEFAULT.extraction_review, one("confidence_below_reject_threshold", "fatal")).when(confidence < C.DEFAULT.extraction_accept, one("confidence_below_accept_threshold", "warning")),
    ]
    return F.array_compact(F.array(*found))


def status(found: Column) -> Column:
    return F.when(F.exists(found, lambda i: i["severity"] == "fatal"), "rejected").when(F.size(found) > 0, "needs_review").otherwise("accepted")


def entity_issues(entities: Column, types: tuple[str, ...] = C.FACT_TYPES) -> Column:
    """Array of (index, code) of entities without type or text, or of a type that is not known."""
    def check(e: Column, i: Column) -> Column:
        one = lambda code: F.struct(i.alias("index"), F.lit(code).alias("code"))
        blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
        return F.array_compact(F.array(F.when(blank(e["type"]) | blank(e["text"]), one("missing_required_field")), F.when(~blank(e["type"]) & ~F.lower(F.trim(e["type"])).isin(*types), one("invalid_entity_type"))))

    return F.flatten(F.transform(entities, check))


def validated(extractions: DataFrame) -> DataFrame:
    """consensus() with the array `issues` and the `status`."""
    out = consensus(extractions)
    out = out.withColumn("issues", issues(F.col("confidence"), F.col("agreement_score"), F.col("disagreement_flag"), F.col("n_entities")))
    return out.withColumn("status", status(F.col("issues")))


def execution_metrics(jobs: DataFrame) -> DataFrame:
    """One row of totals over (extractor, confidence, status, n_issues, fallback_used, failure_count, outcome)."""
    mean = lambda s: F.coalesce(F.round(F.avg(F.when(F.col("status") == s, F.col("confidence"))), 3), F.lit(0.0)).alias(f"avg_confidence_{s}")
    n = lambda cond, name: F.count_if(cond).cast("long").alias(name)
    return jobs.agg(
        F.count("*").alias("total_jobs"), n(F.col("extractor") == "spacy", "spacy_count"), n(F.col("extractor") == "gemini", "gemini_count"),
        n(F.col("fallback_used"), "fallback_count"), F.coalesce(F.sum("failure_count"), F.lit(0)).cast("long").alias("failure_count"),
        F.coalesce(F.round(F.avg("confidence"), 3), F.lit(0.0)).alias("avg_confidence"), F.coalesce(F.round(F.avg((F.col("outcome") == "queued_for_review").cast("double")), 3), F.lit(0.0)).alias("review_rate"),
        n(F.col("status") == "accepted", "accepted_count"), n(F.col("status") == "needs_review", "review_count"), n(F.col("status") == "rejected", "rejected_count"),
        F.coalesce(F.sum("n_issues"), F.lit(0)).cast("long").alias("validation_error_count"), mean("accepted"), mean("needs_review"), mean("rejected"),
    )


def pipeline_metrics(runs: DataFrame) -> DataFrame:
    """One row over (n_records, confidence, agreement_score, status): the average confidence is weighted by records."""
    part = lambda s, name: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n_records"))), F.lit(0)).cast("long").alias(name)
    return runs.agg(
        F.coalesce(F.sum("n_records"), F.lit(0)).cast("long").alias("total_records"), part("accepted", "accepted_count"), part("needs_review", "review_count"), part("rejected", "rejected_count"),
        F.coalesce(F.round(F.sum(F.col("confidence") * F.col("n_records")) / F.sum("n_records"), 3), F.lit(0.0)).alias("avg_confidence"), F.coalesce(F.round(F.avg("agreement_score"), 3), F.lit(0.0)).alias("avg_agreement"),
    )


def priors(spark) -> DataFrame:
    rows = [(name, i, C.CONNECTOR_COST[name], *C.CONNECTOR_PRIOR[name]) for i, name in enumerate(C.CONNECTORS)]
    return spark.createDataFrame(rows, "connector string, ord int, cost double, latency_ms double, confidence double, success_rate double")


def connector_profiles(attempts: DataFrame) -> DataFrame:
    """Profile of each known connector from (connector, success, latency_ms, confidence); priors where there is no history."""
    ok = lambda c: F.when(F.col("success"), F.col(c))
    seen = attempts.groupBy("connector").agg(
        F.count("*").alias("attempts"), F.count_if("success").alias("successes"), F.round(F.avg(ok("latency_ms")), 3).alias("l"), F.round(F.avg(ok("confidence")), 3).alias("c")
    )
    out = F.broadcast(priors(attempts.sparkSession)).join(seen, "connector", "left")
    return out.select(
        "connector", "ord", F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"), F.coalesce("l", "latency_ms").alias("avg_latency_ms"), F.coalesce("c", "confidence").alias("avg_confidence"), F.col("cost").alias("cost_estimate"),
        F.coalesce(F.round(F.col("successes") / F.col("attempts"), 3), F.col("success_rate")).alias("success_rate"),
    )


def _scored_routes(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """docs with `routes`: array of (connector, place, score, eligible, cost_estimate). The profiles, three fixed rows, are one array in one broadcast row."""
    one = profiles.groupBy().agg(F.array_sort(F.collect_list(F.struct("ord", "connector", "avg_latency_ms", "avg_confidence", "success_rate", "cost_estimate"))).alias("profiles"))
    short = (F.col("n_chars") < C.DEFAULT.char_limit) & ~F.col("artifacts")

    def route(p: Column) -> Column:
        place = F.when(short, p["ord"]).otherwise(2 - p["ord"])
        first = place == 0
        shift = F.when((p["connector"] == "spacy") & ~first, -0.18).when((p["connector"] == "phi3") & first, 0.04).when((p["connector"] == "gemini") & first, 0.03).otherwise(0.0)
        conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["avg_confidence"] + shift))
        big = (p["connector"] == "gemini") & (F.col("n_chars") >= C.DEFAULT.char_limit)
        score = (
            conf * 0.4 + F.least(p["success_rate"], F.lit(1.0)) * 0.25 + F.greatest(F.lit(0.0), 1 - p["avg_latency_ms"] / (2 * C.DEFAULT.max_latency_ms)) * 0.15
            + F.greatest(F.lit(0.0), 1 - p["cost_estimate"] / 0.03) * 0.15 + F.when(first, 0.05).otherwise(0.0) + F.when(big, 0.05).otherwise(0.0)
        )
        eligible = (conf >= C.DEFAULT.preferred_confidence) & (p["avg_latency_ms"] <= C.DEFAULT.max_latency_ms) & (p["success_rate"] >= C.DEFAULT.min_success_rate)
        return F.struct(p["connector"].alias("connector"), place.alias("place"), F.round(score, 3).alias("score"), eligible.alias("eligible"), p["cost_estimate"].alias("cost_estimate"))

    return docs.crossJoin(F.broadcast(one)).withColumn("routes", F.transform("profiles", route)).drop("profiles")


def route_scores(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, connector, place, score, eligible, cost_estimate) for (doc_id, n_chars, artifacts): clean short texts try the cheap connector first."""
    return _scored_routes(docs, profiles).select("doc_id", F.explode("routes").alias("r")).select("doc_id", "r.*")


def chosen_routes(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """route_choice() of route_scores(), worked out within each row: no shuffle."""
    key = lambda r: F.struct(F.when(r["eligible"], 0).otherwise(1).alias("a"), F.when(r["eligible"], r["cost_estimate"]).otherwise(0.0).alias("b"), (-r["score"]).alias("c"), r["place"].alias("d"), r["connector"].alias("connector"), r["score"].alias("score"))
    best = F.explode(F.array(F.array_min(F.transform("routes", key))))
    return _scored_routes(docs, profiles).select("doc_id", best.alias("b")).select("doc_id", "b.connector", "b.score")


def route_choice(scores: DataFrame) -> DataFrame:
    """(doc_id, connector, score): the cheapest eligible route, then the best; without any, the best of all."""
    key = F.struct(F.when(F.col("eligible"), 0).otherwise(1).alias("a"), F.when(F.col("eligible"), F.col("cost_estimate")).otherwise(0.0).alias("b"), (-F.col("score")).alias("c"), F.col("place").alias("d"))
    return scores.groupBy("doc_id").agg(F.min_by("connector", key).alias("connector"), F.min_by("score", key).alias("score"))


def degradation(confidence: Column, latency_ms: Column, success_rate: Column) -> Column:
    """Why a result is not good enough, null if it is."""
    return F.when(confidence < C.DEFAULT.preferred_confidence, "confidence_too_low").when(latency_ms > C.DEFAULT.max_latency_ms, "latency_too_high").when(success_rate < C.DEFAULT.min_success_rate, "reliability_too_low")


def fallback(scores: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, intended, actual, failure_count) from route_scores() and results (doc_id, connector, confidence, latency_ms, success_rate).

    The chosen route is tried first, then the others by score; the first good enough result is taken, else the last. A connector without result fails. An
    intended spaCy result of low confidence is kept.
    """
    intended = route_choice(scores).select("doc_id", F.col("connector").alias("intended"))
    order = F.array_position(F.array(*[F.lit(c) for c in C.CONNECTORS]), F.col("connector"))
    tries = scores.join(intended, "doc_id").join(results, ["doc_id", "connector"], "left")
    bad = F.col("confidence").isNull() | degradation(F.col("confidence"), F.col("latency_ms"), F.col("success_rate")).isNotNull()
    kept = (F.col("connector") == "spacy") & (F.col("intended") == "spacy") & (F.col("confidence") < C.DEFAULT.preferred_confidence)
    key = F.struct(F.when(F.col("connector") == F.col("intended"), 0).otherwise(1).alias("later"), (-F.col("score")).alias("s"), order.alias("o"), F.coalesce(bad & ~F.coalesce(kept, F.lit(False)), F.lit(True)).alias("bad"), "connector")
    lined = tries.groupBy("doc_id", "intended").agg(F.array_sort(F.collect_list(key)).alias("t"))  # three entries
    good = F.filter("t", lambda x: ~x["bad"])
    taken = F.coalesce(F.get(good, F.lit(0)), F.element_at("t", -1))
    place = F.array_position("t", taken)
    return lined.select("doc_id", "intended", taken["connector"].alias("actual"), (place - 1 + F.when(F.size(good) == 0, 1).otherwise(0)).cast("long").alias("failure_count"))
