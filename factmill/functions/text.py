"""Text functions as columns: normalisation, personal data, scan quality, classification, entity patterns. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factmill import config as C


def norm(c: Column) -> Column:
    """Lower case, white space collapsed, null as ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))


def canonical(c: Column) -> Column:
    """Canonical term of a name, '' if it has none."""
    pairs = F.create_map(*[F.lit(x) for pair in C.ALIAS_PAIRS for x in pair])
    return F.coalesce(F.try_element_at(pairs, norm(c)), F.lit(""))


def entity_key(c: Column) -> Column:
    """Canonical term, or the normalised name where there is none."""
    return F.coalesce(F.nullif(canonical(c), F.lit("")), norm(c))


def redact(c: Column) -> Column:
    """Personal data replaced, pattern after pattern."""
    for pattern, mark in C.PII:
        c = F.regexp_replace(c, "(?U)" + pattern, mark.replace("$", r"\$"))
    return c


def pii_hits(c: Column) -> Column:
    """Up to two matches of each pattern; none means clean."""
    return F.flatten(F.array(*[F.slice(F.regexp_extract_all(c, F.lit("(?U)" + p), F.lit(0)), 1, 2) for p, _ in C.PII]))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def count_contained(c: Column, words: tuple[str, ...]) -> Column:
    return sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))


def special_ratio(c: Column) -> Column:
    """Share of characters that are neither words, white space nor usual punctuation."""
    return F.regexp_count(c, F.lit(r"(?U)[^\w\s\-.,:;/()%°µ]")) / F.greatest(F.length(c), F.lit(1))


def long_tokens(c: Column) -> Column:
    """Tokens of over 20 characters that are neither addresses nor hexadecimal."""
    found = F.regexp_extract_all(c, F.lit(r"(?U)\S{21,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.rlike(r"^https?://") & ~t.rlike(r"^[A-Fa-f0-9]{20,}$"))


def confused_tokens(c: Column) -> Column:
    """Tokens that mix digits and look-alike letters, at most OCR_CAP."""
    found = F.flatten(F.array(*[F.regexp_extract_all(c, F.lit("(?U)" + p), F.lit(0)) for p in C.CONFUSED]))
    return F.slice(F.filter(found, lambda t: ~t.isin(*C.NOT_CONFUSED)), 1, C.OCR_CAP)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once, though use takes it several times or for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def line_faults(c: Column) -> Column:
    """Merged lines plus gaps of four blank lines; texts of under four lines have none."""
    blank = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")) == ""
    return let(F.split(c, "\n", -1), lambda lines: let(F.filter(lines, lambda x: ~blank(x)), lambda full: _line_faults(lines, full)))


def _line_faults(lines: Column, full: Column) -> Column:
    total = F.aggregate(full, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    merged = let(total / F.size(full), lambda mean: F.size(F.filter(full, lambda x: (F.length(x) > mean * 3) & (F.length(x) > 200))))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("gaps"))

    def step(a: Column, x: Column) -> Column:
        blank = F.trim(F.regexp_replace(x, r"(?U)\s+", " ")) == ""
        run = F.when(blank, a["run"] + 1).otherwise(0)
        return F.struct(F.when(run >= 4, 0).otherwise(run).alias("run"), (a["gaps"] + F.when(run >= 4, 1).otherwise(0)).alias("gaps"))

    gaps = F.aggregate(lines, start, step)["gaps"]
    return F.when((F.size(lines) < 4) | (F.size(full) == 0), 0).otherwise(merged + gaps)


def scan_artifacts(c: Column) -> Column:
    """Whether a text shows marks of a bad scan."""
    odd = F.length(F.regexp_replace(c, r"(?U)[\p{L}\p{N}\s]", "")) / F.greatest(F.length(c), F.lit(1))
    return c.rlike(r"(?U)(\x{FFFD}|[|]{3,}|_{4,}|\b(?:l|I){8,}\b)") | (odd > 0.18)


def rule_hits(text: Column, keywords: tuple[str, ...]) -> Column:
    lower = F.lower(text)
    return sum(((lower.rlike("(?U)" + k[1:-1]) if k.startswith("/") else F.contains(lower, F.lit(k))).cast("int") for k in keywords), F.lit(0))


def rule_hit_counts(text: Column) -> Column:
    """Array of how many keywords of each document rule a text has, in the rules' order."""
    return F.array(*[rule_hits(text, keywords) for *_, keywords, _ in C.DOCUMENT_RULES])


def once(value: Column) -> Column:
    """A column that later steps use several times and that must not be worked out for each: a generator of one row."""
    return F.explode(F.array(value))


def classify_document(text: Column, path: Column | None = None, source_type: Column | None = None, explicit_trust: Column | None = None, ocr_confidence: Column | None = None) -> Column:
    """choose_rule() of a text."""
    return choose_rule(rule_hit_counts(text), path, source_type, explicit_trust, ocr_confidence)


def choose_rule(counts: Column, path: Column | None = None, source_type: Column | None = None, explicit_trust: Column | None = None, ocr_confidence: Column | None = None) -> Column:
    """struct(document_type, trust_level, tier, confidence, hits) from rule_hit_counts(): the rule with most hits, the first on a tie, then overrides."""
    name = F.lower(F.coalesce(path, F.lit(""))) if path is not None else None
    options = []
    for i, (kind, trust, tier, least, _, hints) in enumerate(C.DOCUMENT_RULES):
        hits = F.get(counts, F.lit(i))
        ok = hits >= least
        if name is not None:
            ok = ok | contains_any(name, hints)
        options.append(F.when(ok, F.struct(hits.alias("hits"), F.lit(-i).alias("order"), F.lit(kind).alias("document_type"), F.lit(trust).alias("trust_level"), F.lit(tier).alias("tier"))))
    none = F.struct(F.lit(-1).alias("hits"), F.lit(-99).alias("order"), F.lit("generic").alias("document_type"), F.lit(4).alias("trust_level"), F.lit("hypothesis").alias("tier"))
    best = F.array_max(F.array_compact(F.array(*options, none)))
    trust, tier = best["trust_level"], best["tier"]
    if source_type is not None:
        trust = F.when(source_type == "ai_response", F.greatest(trust, F.lit(3))).when(source_type == "web", F.greatest(trust, F.lit(4))).when(source_type == "manual", F.least(trust, F.lit(2))).otherwise(trust)
        tier = F.when(source_type.isin("ai_response", "web"), "hypothesis").when(source_type == "manual", "active").otherwise(tier)
    if explicit_trust is not None:
        tier = F.when(explicit_trust.isNull(), tier).when(explicit_trust <= 2, "active").when(tier == "active", "hypothesis").otherwise(tier)
        trust = F.coalesce(explicit_trust, trust)
    if ocr_confidence is not None:
        tier = F.when(ocr_confidence < 0.60, "quarantined").otherwise(tier)
    hits = best["hits"]
    confidence = F.when(hits < 0, 0.40).otherwise(F.least(F.lit(1.0), 0.5 + 0.1 * hits))
    return F.struct(best["document_type"].alias("document_type"), trust.cast("int").alias("trust_level"), tier.alias("tier"), confidence.alias("confidence"), F.greatest(hits, F.lit(0)).alias("hits"))


def document_kind(text: Column) -> Column:
    """food_guide or clinical_report."""
    lower = F.lower(text)
    words, conditions = count_contained(lower, C.FOOD_WORDS), count_contained(lower, C.FOOD_CONDITIONS)
    digits = F.regexp_count(text, F.lit(r"(?U)\b[0-9]\b"))
    return F.when((words >= 2) | (conditions >= 2) | ((words >= 1) & (digits >= 20)), "food_guide").otherwise("clinical_report")


def domain_trust(url: Column) -> Column:
    host = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), r"^[w.]+", "")
    out = F.lit(5)
    for domain, level in reversed(C.DOMAINS):
        out = F.when(F.contains(host, F.lit(domain)), level).otherwise(out)
    return out


def chunks(text: Column, size: int = 6000) -> Column:
    """Array of chunks: pages where they are marked, else whole lines of about `size` characters together. Blank chunks are left out."""
    pages = F.transform(F.split(text, r"\[Page ", -1), lambda c, i: F.when(i > 0, F.concat(F.lit("[Page "), c)).otherwise(c))
    raw = F.filter(pages, lambda c: F.regexp_replace(c, r"(?U)^\[Page \s*|\s+", "") != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("size"))

    def step(a: Column, line: Column) -> Column:
        n = F.length(line) + 1
        full = (a["size"] + n > size) & a["open"].isNotNull()
        return F.struct(
            F.when(full, F.array_append(a["done"], a["open"])).otherwise(a["done"]).alias("done"),
            F.when(full | a["open"].isNull(), line).otherwise(F.concat(a["open"], F.lit("\n"), line)).alias("open"),
            F.when(full, n).otherwise(a["size"] + n).alias("size"),
        )

    folded = F.aggregate(F.split(text, "\n", -1), empty, step, lambda a: F.array_append(a["done"], a["open"]))
    lined = F.filter(folded, lambda c: F.regexp_replace(c, r"(?U)\s+", "") != "")
    return F.when(F.contains(text, F.lit("[Page ")), raw).otherwise(lined)


#: Entity patterns.
MEDICATION = r"(?i)\b([A-Z][A-Za-z-]{2,})\s+(\d+(?:\.\d+)?)\s*(mg|mcg|ml|g|units?)\b"
DIAGNOSIS = r"(?i)\b(?:diagnosis|diagnosed with|history of)\s*:?\s*([A-Za-z][A-Za-z ,/-]{3,80})"
TEST = r"\b([A-Z][A-Za-z ]{2,40})\s*:?\s+(\d+(?:\.\d+)?)\s*(mg/dL|mmol/L|%|bpm|mmHg)?\b"
LOOSE_MEDICATION = r"(?i)([A-Za-z]{4,})\s+(\d+(?:\.\d+)?)\s*(mg|mcg|ml|g|units?)"


ENTITY = "struct<type:string,text:string,value:string,unit:string>"


def _found(text: Column, kind: str, pattern: str, value: bool) -> Column:
    """One scan for the whole matches; their groups are read from the short matches."""
    part = lambda m, g: F.regexp_extract(m, pattern, g)
    none = F.lit(None).cast("string")
    if value:
        make = lambda m: F.struct(F.lit(kind).alias("type"), F.trim(part(m, 1)).alias("text"), part(m, 2).alias("value"), F.nullif(part(m, 3), F.lit("")).alias("unit"))
    else:
        make = lambda m: F.struct(F.lit(kind).alias("type"), F.regexp_replace(part(m, 1), r"^[ .;]+|[ .;]+$", "").alias("text"), none.alias("value"), none.alias("unit"))
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), make)


def entities(text: Column) -> Column:
    """Array of (type, text, value, unit): medications with dose, diagnoses, test values, in this order."""
    return F.concat(_found(text, "medication", MEDICATION, True), _found(text, "diagnosis", DIAGNOSIS, False), _found(text, "test_result", TEST, True))


def distinct_entities(found: Column) -> Column:
    """The first of each (type, lower-case text); blank texts go."""
    add = lambda done, e: F.when((e["text"] == "") | F.exists(done, lambda d: (d["type"] == e["type"]) & (F.lower(d["text"]) == F.lower(e["text"]))), done).otherwise(F.array_append(done, e))
    return F.aggregate(found, F.array().cast(f"array<{ENTITY}>"), add)


def drug_candidates(text: Column) -> Column:
    """The first twenty capitalised words that may name drugs."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Z][a-z]{3,}\b"), F.lit(0))
    return F.slice(F.filter(words, lambda w: ~w.isin("This", "That", "These", "The", "For", "With", "From", "When", "Patient")), 1, 20)


def classify_query(text: Column) -> Column:
    """struct(specialty, task_type, confidence, requires_ddi) by the first list that has a word of the query."""
    lower = F.lower(text)
    specialty, task = F.lit("general"), F.lit("general_query")
    for name, words in reversed(C.SPECIALTY_WORDS):
        specialty = F.when(contains_any(lower, words), name).otherwise(specialty)
    for name, words in reversed(C.TASK_WORDS):
        task = F.when(contains_any(lower, words), name).otherwise(task)
    return F.struct(
        specialty.alias("specialty"), task.alias("task_type"), F.when(specialty != "general", 0.70).otherwise(0.55).alias("confidence"),
        ((task == "medication_check") | contains_any(lower, C.INTERACTION_WORDS)).alias("requires_ddi"),
    )


def coherence(text: Column) -> Column:
    """Coherence of a response by marks of contradiction, reasoning, detail and length."""
    lower = F.lower(text)
    bad = contains_any(lower, ("however, this is not", "on the other hand, it is", "this contradicts", "inconsistent with itself"))
    reasons = contains_any(lower, ("because", "therefore", "due to", "given that"))
    long_words = F.size(F.filter(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "), lambda w: F.length(w) > 6))
    score = 0.65 + F.when(reasons, 0.15).otherwise(0.0) + F.when(long_words > 10, 0.10).otherwise(0.0) - F.when(F.length(text) < 50, 0.20).otherwise(0.0)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).when(bad, 0.4).otherwise(F.least(F.lit(1.0), score))


def citations(text: Column, listed: Column | None = None) -> Column:
    """Citation score: listed, linked, named, none."""
    named = contains_any(F.lower(text), ("pubmed", "cochrane", "nejm", "jama", "guidelines", "according to"))
    out = F.when(text.rlike("https?://"), 0.80).when(named, 0.65).otherwise(0.20)
    return F.when(listed, 0.85).otherwise(out) if listed is not None else out


def event_date(text: Column, as_of: Column) -> Column:
    """struct(date, confidence, from, to): an explicit date, else so many units ago, else a named day, else nothing."""
    iso = F.regexp_extract(text, r"(?U)\b(\d{4}-\d{1,2}-\d{1,2})\b", 1)
    us = [F.regexp_extract(text, r"(?U)\b(\d{1,2})/(\d{1,2})/(\d{4})\b", i) for i in (1, 2, 3)]
    eu = [F.regexp_extract(text, r"(?U)\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b", i) for i in (1, 2, 3)]
    made = lambda y, m, d: F.when(y != "", F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))
    parts = F.split(iso, "-")
    explicit = F.coalesce(F.when(iso != "", made(parts[0], parts[1], parts[2])), made(us[2], us[0], us[1]), made(eu[2], eu[1], eu[0]))
    ago = r"(?i)(\d+)\s+(day|days|week|weeks|month|months|year|years)\s+ago"
    n = F.regexp_extract(text, ago, 1).try_cast("int")
    kind = F.lower(F.regexp_extract(text, ago, 2))
    unit = F.when(kind.startswith("day"), 1).when(kind.startswith("week"), 7).when(kind.startswith("month"), 30).when(kind.startswith("year"), 365)
    past, half = F.date_sub(as_of, (n * unit).cast("int")), F.greatest(F.lit(1), F.floor(unit / 2).cast("int"))
    lower = F.lower(text)
    named = F.lit(None).cast("int")
    for phrase, days in reversed((("today", 0), ("yesterday", 1), ("last week", 7), ("last month", 30), ("last year", 365))):
        named = F.when(F.contains(lower, F.lit(phrase)), days).otherwise(named)
    day, reach = F.date_sub(as_of, named), F.greatest(F.lit(1), F.floor(named / 2).cast("int"))
    none = F.lit(None).cast("date")
    pack = lambda d, c, a, b: F.struct(d.alias("date"), F.lit(c).alias("confidence"), a.alias("from"), b.alias("to"))
    return (
        F.when(explicit.isNotNull(), pack(explicit, 1.0, none, none))
        .when(kind != "", pack(past, 0.75, F.date_sub(past, half), F.date_add(past, half)))
        .when(named.isNotNull(), pack(day, 0.80, F.date_sub(day, reach), F.date_add(day, reach)))
        .otherwise(pack(none, 0.0, none, none))
    )
