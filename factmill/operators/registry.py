"""Specialties by the keywords of their plug-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (specialty, whether it is a stub, keywords), in the order of the registry.
SPECIALTIES = [
    ("epilepsy", False, ("epilep", "seizure", "convuls", "anticonvulsant", "antiepileptic", "aed", "eeg", "levetiracetam", "valproate", "lamotrigine", "carbamazepine", "phenytoin", "topiramate", "brivaracetam", "ictal", "postictal", "status epilepticus", "absence", "tonic clonic", "focal onset")),
    ("gastroenterology", True, ("gastro", "bowel", "crohn", "colitis", "ibs", "gerd", "reflux", "liver", "colon", "intestin", "inflammatory bowel", "uc", "ulcerative")),
    ("neurology", False, ("neuro", "brain", "stroke", "headache", "migraine", "dementia", "alzheimer", "parkinson", "ms", "multiple sclerosis", "neuropathy", "vertigo", "tremor", "ataxia")),
    ("urology", True, ("urology", "bladder", "prostate", "kidney", "renal", "urinary", "bph", "psa", "hematuria", "nephrolithiasis", "stone")),
]


def keyword_score(text: Column, keywords: tuple[str, ...]) -> Column:
    """Share of three tenths of the keywords that the text has, at most 1; 0 without keywords."""
    lower = F.lower(text)
    hits = F.size(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(lower, k))) if keywords else F.lit(0)
    return F.least(F.lit(1.0), hits / F.lit(max(1.0, len(keywords) * 0.3)))


def detect_specialty(text: Column, specialties: list[tuple[str, bool, tuple[str, ...]]] = SPECIALTIES) -> Column:
    """struct(specialty, confidence): the active specialty with the highest score, the first on a tie; general if none scores."""
    scored = [F.struct(keyword_score(text, words).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, stub, words) in enumerate(specialties) if not stub]
    best = F.array_max(F.array(*scored))
    none = best["score"] == 0
    return F.struct(F.when(none, "general").otherwise(best["name"]).alias("specialty"), F.when(none, 0.4).otherwise(F.least(F.lit(0.95), best["score"] + 0.30)).alias("confidence"))
