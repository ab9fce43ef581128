"""Scores of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill import config as C
from factmill.functions.text import citations, coherence, contains_any


def weighted(consistency: Column, clear: Column, cited: Column, safe: Column) -> Column:
    """Final score of a response, 0 to 1, to three digits."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), consistency * 0.35 + clear * 0.25 + cited * 0.20 + safe * 0.20)), 3)


def response_scores(responses: DataFrame, text: str = "text", consistency: Column | None = None, safe: Column | None = None) -> DataFrame:
    """responses with coherence, citations, score and whether it is discarded; without context the consistency is neutral."""
    consistency = consistency if consistency is not None else F.lit(0.5)
    safe = safe if safe is not None else F.lit(1.0)
    out = responses.withColumn("coherence", coherence(F.col(text))).withColumn("citation", citations(F.col(text)))
    out = out.withColumn("score", weighted(consistency, F.col("coherence"), F.col("citation"), safe))
    return out.withColumn("discarded", F.col("score") < C.DEFAULT.discard)


def response_consensus(scored: DataFrame, key: str) -> DataFrame:
    """(key, n, consensus): 0 without responses, three quarters of a single score, else the mean plus a tenth, at most 1."""
    kept = F.count_if(~F.col("discarded"))
    mean = F.avg(F.when(~F.col("discarded"), F.col("score")))
    value = F.when(kept == 0, 0.0).when(kept == 1, F.round(mean * 0.75, 3)).otherwise(F.round(F.least(F.lit(1.0), mean + 0.10), 3))
    return scored.groupBy(key).agg(kept.cast("long").alias("n"), value.alias("consensus"))


def governance_score(text: Column, matches: Column, n_context: Column, cited: Column, safe: Column) -> Column:
    """struct of the final score and its four parts."""
    lower = F.lower(text)
    consistency = F.when(n_context == 0, 0.5).otherwise(F.least(F.lit(1.0), 0.4 + matches / F.greatest(n_context, F.lit(1))))
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    raw = 0.6 + F.when(contains_any(lower, ("because", "therefore", "given")), 0.2).otherwise(0.0) + F.when(words > 12, 0.1).otherwise(0.0) - F.when(F.contains(lower, F.lit("contradict")), 0.4).otherwise(0.0)
    clear = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    cite, safe = F.when(cited, 1.0).otherwise(0.2), F.greatest(F.lit(0.0), F.least(F.lit(1.0), safe))
    final = F.round(consistency * 0.35 + clear * 0.25 + cite * 0.20 + safe * 0.20, 3)
    return F.struct(final.alias("final_score"), F.round(consistency, 3).alias("mkb_consistency"), F.round(clear, 3).alias("internal_coherence"), cite.alias("citation_presence"), F.round(safe, 3).alias("ddi_safety_score"))
