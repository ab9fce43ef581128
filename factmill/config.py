"""Thresholds, controlled vocabularies and rule tables. They must equal those that the queries' results are defined by."""

from __future__ import annotations

from dataclasses import dataclass

TIERS = ("active", "hypothesis", "quarantined", "superseded")
FACT_TYPES = ("diagnosis", "medication", "test_result", "symptom", "note", "recommendation", "relationship", "event")
CONNECTORS = ("spacy", "phi3", "gemini")


@dataclass(frozen=True)
class Config:
    """Feature flags and thresholds of the engine."""

    enable_enrichment: bool = True
    enable_promotion: bool = True
    enable_governance_resolution: bool = True
    enable_hypothesis_tiering: bool = True
    enable_governance_scoring: bool = True
    min_confidence: float = 0.35
    extraction_accept: float = 0.70
    extraction_review: float = 0.50
    consensus_accept: float = 0.60
    consensus_review: float = 0.25
    safe_mode: float = 0.40
    discard: float = 0.30
    dedup_cosine: float = 0.92
    name_ratio: float = 0.92
    exact_days: int = 7
    recency_days: int = 90
    outdated_days: int = 1825
    char_limit: int = 3000
    preferred_confidence: float = 0.78
    max_latency_ms: float = 180.0
    min_success_rate: float = 0.75


DEFAULT = Config()

#: Canonical term and its surface forms.
ALIASES = {
    "hypertension": ("hypertension", "htn", "high blood pressure", "elevated bp", "elevated blood pressure", "raised blood pressure"),
    "diabetes mellitus": ("diabetes", "dm", "diabetes mellitus", "t2dm", "t1dm", "type 2 diabetes", "type 1 diabetes"),
    "myocardial infarction": ("myocardial infarction", "mi", "ami", "heart attack", "acute myocardial infarction"),
    "cerebrovascular accident": ("cva", "stroke", "cerebrovascular accident"),
    "chronic kidney disease": ("ckd", "chronic kidney disease", "chronic renal failure"),
    "congestive heart failure": ("chf", "congestive heart failure", "heart failure"),
    "hba1c": ("hba1c", "a1c", "glycated haemoglobin", "glycated hemoglobin", "glycosylated haemoglobin", "glycosylated hemoglobin"),
    "hemoglobin": ("hemoglobin", "haemoglobin", "hgb", "hb"),
    "cholesterol": ("cholesterol", "chol", "total cholesterol"),
    "ldl": ("ldl", "ldl cholesterol", "ldl-c", "low density lipoprotein"),
    "hdl": ("hdl", "hdl cholesterol", "hdl-c", "high density lipoprotein"),
    "blood pressure": ("blood pressure", "bp"),
    "heart rate": ("heart rate", "hr", "pulse"),
    "weight": ("weight", "body weight", "bw"),
    "temperature": ("temperature", "temp", "body temperature"),
}
ALIAS_PAIRS = [(alias, canonical) for canonical, names in ALIASES.items() for alias in dict.fromkeys((canonical, *names))]

#: Interacting drugs of the conflict check, and of the write gate with its severity.
INTERACTIONS = [
    ("warfarin", "rivaroxaban", "anticoagulant_duplication"),
    ("warfarin", "apixaban", "anticoagulant_duplication"),
    ("warfarin", "dabigatran", "anticoagulant_duplication"),
    ("ssri", "mao inhibitor", "serotonin_syndrome_risk"),
    ("fluoxetine", "tranylcypromine", "serotonin_syndrome_risk"),
    ("sertraline", "phenelzine", "serotonin_syndrome_risk"),
    ("clopidogrel", "omeprazole", "reduced_antiplatelet_effect"),
]
GATE_RULES = [
    ("lamotrigine", "valproate", "HIGH", "Do not combine without clinician review."),
    ("warfarin", "ibuprofen", "MEDIUM", "Needs medication acknowledgment before write."),
    ("sertraline", "ibuprofen", "LOW", "Low-severity interaction noted."),
]

#: Variants of which one excludes the other, as substrings.
EXCLUSIVE = [
    (("type 1 diabetes", "t1dm"), ("type 2 diabetes", "t2dm")),
    (("left-sided", "left sided", "left"), ("right-sided", "right sided", "right")),
    (("benign",), ("malignant",)),
    (("acute",), ("chronic",)),
]

#: Fixed values: (canonical entity, gap in days below which, change above which a change is implausible).
IMPLAUSIBLE = [("weight", 7, 5.0), ("weight", 30, 20.0), ("blood pressure", 1, 30.0), ("temperature", 1, 2.0), ("hba1c", 60, 2.0)]

#: Fixed values: (entity, unit, canonical unit, factor, addend) with canonical value = value * factor + addend.
UNITS = [
    ("weight", "lb", "kg", 0.45359237, 0.0), ("weight", "lbs", "kg", 0.45359237, 0.0), ("weight", "pound", "kg", 0.45359237, 0.0), ("weight", "pounds", "kg", 0.45359237, 0.0),
    ("weight", "kg", "kg", 1.0, 0.0), ("weight", "g", "kg", 1 / 1000.0, 0.0), ("weight", "oz", "kg", 0.0283495, 0.0),
    ("temperature", "f", "°C", 5.0 / 9.0, -160.0 / 9.0), ("temperature", "°f", "°C", 5.0 / 9.0, -160.0 / 9.0), ("temperature", "c", "°C", 1.0, 0.0), ("temperature", "°c", "°C", 1.0, 0.0),
    ("hba1c", "mmol/mol", "%", 1 / 10.929, 2.15), ("hba1c", "%", "%", 1.0, 0.0),
    ("glucose", "mg/dl", "mmol/L", 1 / 18.0182, 0.0), ("glucose", "mmol/l", "mmol/L", 1.0, 0.0),
    ("cholesterol", "mg/dl", "mmol/L", 1 / 38.67, 0.0), ("cholesterol", "mmol/l", "mmol/L", 1.0, 0.0),
    ("creatinine", "mg/dl", "µmol/L", 88.4, 0.0), ("creatinine", "µmol/l", "µmol/L", 1.0, 0.0), ("creatinine", "umol/l", "µmol/L", 1.0, 0.0),
    ("height", "in", "cm", 2.54, 0.0), ("height", "inches", "cm", 2.54, 0.0), ("height", "cm", "cm", 1.0, 0.0), ("height", "m", "cm", 100.0, 0.0),
]

#: Personal-data patterns in the order in which they are replaced.
PII = [
    (r"\b\d{3}-\d{2}-\d{4}\b", "[ID_REMOVED]"),
    (r"\b\d{10}\b", "[ID_REMOVED]"),
    (r"\b[A-Z]{2}\d{6}\b", "[ID_REMOVED]"),
    (r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", "[DATE]"),
    (r"\b\d{4}-\d{2}-\d{2}\b", "[DATE]"),
    (r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b", "[CONTACT_REMOVED]"),
    (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "[CONTACT_REMOVED]"),
    (r"\b(?:Dr\.?|Mr\.?|Mrs\.?|Ms\.?)\s+[A-Z][a-z]+\s+[A-Z][a-z]+\b", "[PHYSICIAN]"),
]

#: Fixed values: (type, trust, tier, least hits, keywords or /patterns/, file name hints), in order of preference.
DOCUMENT_RULES = [
    ("clinical_note", 1, "active", 2, ("chief complaint", "history of present illness", "assessment and plan", "physical examination", "review of systems", "discharge summary", "operative report", "progress note", "consultation note", "medical record number", "attending physician"), ("clinic", "clinical", "hospital", "discharge", "consult", "op_report", "progress_note")),
    ("lab_report", 1, "active", 2, ("laboratory report", "lab results", "reference range", "specimen", "cbc", "comprehensive metabolic panel", "hba1c", "tsh", r"/\b(?:wbc|rbc|hgb|plt|alt|ast|bun|cr)\b:?\s*\d/", "collection date", "accession number"), ("lab", "labs", "bloodwork", "results")),
    ("imaging", 1, "active", 2, ("impression:", "findings:", "mri", "ct scan", "ultrasound", "radiologist", "contrast", "no acute findings"), ("mri", "ct", "xray", "imaging", "radiology", "ultrasound")),
    ("prescription", 1, "active", 2, ("rx:", "prescription", "take ", " once daily", " twice daily", " tid", " bid", " qd", " qid", " prn", r"/\b\d+\s?mg\b/", r"/\bsig\b/"), ("rx", "prescription")),
    ("peer_reviewed_guideline", 2, "active", 2, ("clinical practice guideline", "systematic review", "meta-analysis", "cochrane", "published in", "doi:", "pubmed"), ("guideline", "pubmed", "meta_analysis", "systematic_review")),
    ("food_guide", 3, "hypothesis", 1, ("fodmap", "ibs score", "diverticulitis score", "oxalate", "crystalluria", "безопасно", "разрешено", "нежелательно", "исключить", "safety category", "food rating"), ("food", "diet", "nutrition", "fodmap")),
    ("patient_education", 4, "hypothesis", 2, ("what is", "how to manage", "living with", "frequently asked", "patient information", "educational material"), ("patient", "education", "info", "faq")),
    ("web_article", 4, "hypothesis", 1, ("http://", "https://", "www.", "read more", "subscribe", "copyright ©", "all rights reserved"), ("web", "html", "article")),
    ("ai_response", 3, "hypothesis", 1, ("as an ai", "language model", "chatgpt", "claude", "gemini"), ("ai", "chat", "response")),
]

#: Words of food guides, and conditions scored in them.
FOOD_WORDS = ("продукт", "питание", "пища", "блюдо", "рацион", "продукты", "еда", "калорий", "белки", "жиры", "углеводы")
FOOD_CONDITIONS = ("ibs", "diverticulitis", "oxalate", "crystalluria", "fodmap")

#: Trusted domains, matched as substrings of the host whose leading letters w and dots are stripped.
DOMAINS = [("pubmed.ncbi.nlm.nih.gov", 2), ("pmc.ncbi.nlm.nih.gov", 2), ("who.int", 2), ("ilae.org", 2), ("aan.com", 2), ("aga.com", 2), ("auanet.org", 2), ("mayoclinic.org", 4), ("nhs.uk", 4), ("medlineplus.gov", 4), ("epilepsy.com", 4)]

#: Patterns of confused digits and letters, their exceptions, and the check's cap.
CONFUSED = [r"\b\d*[O]\d*[a-zA-Z]*\b", r"\b\d*[I]\d+\b", r"\b\d*[S]\d+\b", r"\b\d*[B]\d+\b", r"\b[l]\d+\b", r"\b\d+[l]\d+\b", r"\b[a-zA-Z]{3,}\d[a-zA-Z]{2,}\b"]
NOT_CONFUSED = ("O2", "CO2", "B12", "B6", "K1", "K2")
OCR_CAP = 20
#: Weights of the five checks of scanned text.
OCR_WEIGHTS = {"number_letter": 0.30, "misspelling": 0.25, "special": 0.20, "long": 0.15, "spacing": 0.10}
#: Medical terms that misspellings are compared with.
MEDICAL_TERMS = """hypertension diabetes hypothyroidism hyperthyroidism pneumonia bronchitis asthma copd emphysema myocardial infarction angina
arrhythmia tachycardia bradycardia atrial fibrillation ventricular hemoglobin hematocrit platelets leukocytes erythrocytes creatinine bilirubin
cholesterol triglycerides metformin lisinopril atorvastatin amlodipine losartan levothyroxine omeprazole warfarin rivaroxaban apixaban ibuprofen
paracetamol acetaminophen aspirin amoxicillin azithromycin ciprofloxacin diagnosis prescription medication treatment procedure patient symptoms
history examination laboratory radiology ultrasound tomography resonance endoscopy ibs irritable bowel syndrome diverticulitis oxalates
crystalluria epilepsy seizure migraine hba1c glucose insulin sodium potassium calcium""".split()

#: Cost of a call, and profile of a connector that has no history (latency in ms, confidence, success rate).
CONNECTOR_COST = {"spacy": 0.0, "phi3": 0.005, "gemini": 0.02}
CONNECTOR_PRIOR = {"spacy": (5.0, 0.78, 0.99), "phi3": (25.0, 0.76, 0.95), "gemini": (120.0, 0.90, 0.90)}

#: Words that name a specialty or a task in a query, in order of preference.
SPECIALTY_WORDS = [
    ("neurology", ("neuro", "brain", "seizure", "headache", "migraine", "stroke", "ms ", "alzheimer", "parkinson")),
    ("epilepsy", ("epilep", "seizure", "anticonvulsant", "levetiracetam", "valproate", "lamotrigine", "eeg")),
    ("gastroenterology", ("gastro", "bowel", "crohn", "colitis", "ibs", "gerd", "liver", "colon", "intestin")),
    ("urology", ("urology", "bladder", "prostate", "kidney", "renal", "urinary", "bph")),
]
TASK_WORDS = [
    ("medication_check", ("medication", "drug", "dose", "pill", "take", "prescription")),
    ("differential_diagnosis", ("diagnos", "symptom", "what is", "could be", "differential")),
    ("evidence_lookup", ("treatment", "therapy", "manage", "guideline")),
]
INTERACTION_WORDS = ("interact", "combine", "safe with", "take with")
