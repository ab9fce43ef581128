"""Secret scans with DataFrame functions only: three base patterns, and character Markov models for the rest.

Positions come from `split`: the pieces between the matches and the matches themselves alternate, so their running
lengths are the code point offsets. Candidates of the method are long runs of key characters, or what base spans leave
of them; two first-order character models, of random strings and of ordinary identifiers, are compared by the
log-likelihood ratio of the best stretch. A candidate with such a stretch is a secret as a whole, for the stretch alone
can miss the secret's ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm.store import fresh

#: The base patterns in the order of their kinds, and the least characters of the whole match or of group 2.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "markov")
#: Runs of key characters that the models judge, and the alphabet of the models.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Log-likelihood ratio in nats from which a candidate counts as a secret.
LEAST_LLR = 20.0
SAMPLES = 400
#: Words of which the ordinary identifiers of the labelled sample are made.
WORDS = """account address array batch buffer build cache client column config connection content context controller count
customer data database default document element entry error event factory field file filter format function group handler
header height helper image index input instance item language layout length level library limit list listener location
manager market message method model module name number object option order output package page parameter parser password
patient payment pending policy position process product project property provider query queue record reference region
report request response result return schema search section server service session setting source start state status
storage stream string supplier table target template test text thread time token type update user value version view
window worker the and with from that this these have been which their there would about other""".split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(sample, random): n random strings in hex, base 64 and upper case, and n identifiers in snake, camel, kebab and joined case, among them rulers of one character. Made by rule."""
    word = lambda k: F.get(F.array(*[F.lit(w) for w in WORDS]), F.pmod(F.hash("id", F.lit(k)), F.lit(len(WORDS))))
    digest = lambda k: F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")), 256)
    coded = F.base64(F.unhex(digest("b")))
    random = F.when(F.col("id") % 3 == 0, F.substring(digest("h"), 1, 40)).when(F.col("id") % 3 == 1, coded).otherwise(F.upper(F.regexp_replace(coded, "[^A-Za-z0-9]", "")))
    words = [word(k) for k in range(4)]
    year = (1990 + F.col("id") % 40).cast("string")
    plain = (
        F.when(F.col("id") % 25 == 4, F.repeat(F.substr(F.lit("=-_+/xX09"), F.col("id") % 9 + 1, F.lit(1)), F.lit(30)))
        .when(F.col("id") % 5 == 0, F.concat_ws("_", *words))
        .when(F.col("id") % 5 == 1, F.concat(words[0], *[F.initcap(w) for w in words[1:]]))
        .when(F.col("id") % 5 == 2, F.concat_ws("-", *words[:3], year))
        .when(F.col("id") % 5 == 3, F.concat(*words))
        .otherwise(F.concat_ws("/", *words[:3], F.upper(words[3])))
    )
    ids = spark.range(n)
    return ids.select(random.alias("sample"), F.lit(True).alias("random")).unionByName(ids.select(plain.alias("sample"), F.lit(False).alias("random")))


def train(samples: DataFrame, smoothing: float = 20.0) -> list[float]:
    """Log ratio of the two transition probabilities of every pair of alphabet characters, as one row-major list.

    What comes to the driver has one row per pair of alphabet characters at most.
    """
    at = F.explode(F.sequence(F.lit(1), F.length("sample") - 1))
    pairs = samples.where(F.length("sample") > 1).select("random", "sample", at.alias("i")).groupBy("random", F.expr("substring(sample, i, 2)").alias("pair")).agg(F.count("*").alias("n"))
    size = len(ALPHABET)
    counts = {True: [[0] * size for _ in range(size)], False: [[0] * size for _ in range(size)]}
    for r in pairs.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).collect():
        counts[r["random"]][ALPHABET.index(r["pair"][0])][ALPHABET.index(r["pair"][1])] = r["n"]
    return ratios(counts[True], counts[False], smoothing)


def ratios(random: list[list[int]], ordinary: list[list[int]], weight: float) -> list[float]:
    """Log ratios of transition probabilities that are backed by the characters' own frequencies with `weight` observations."""
    size = len(ALPHABET)

    def chances(of: list[list[int]]) -> list[list[float]]:
        total = sum(map(sum, of))
        alone = [(sum(row[j] for row in of) + 0.5) / (total + 0.5 * size) for j in range(size)]
        return [[(of[i][j] + weight * alone[j]) / (sum(of[i]) + weight) for j in range(size)] for i in range(size)]

    x, y = chances(random), chances(ordinary)
    return [math.log(x[i][j] / y[i][j]) for i in range(size) for j in range(size)]


def _gains(token: Column, model: list[float]) -> Column:
    """Log ratio of each pair of neighbouring characters of a string of two or more. The string is cut into characters once, so cost follows its length."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    places = F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    first, second = F.slice(places, 1, F.size(places) - 1), F.slice(places, 2, F.size(places))
    return F.zip_with(first, second, lambda i, j: F.coalesce(F.get(table, i * len(ALPHABET) + j), F.lit(0.0)))


def llr(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string over the alphabet: above 0, random is likelier."""
    return F.aggregate(_gains(token, model), F.lit(0.0), lambda total, x: total + x)


def best_llr(token: Column, model: list[float]) -> Column:
    """The largest log-likelihood ratio of any stretch of a string, so that ordinary words around a random stretch don't outweigh it."""
    none = F.struct(F.lit(0.0).alias("here"), F.lit(0.0).alias("best"))
    grow = lambda s, x: F.struct(F.greatest(s["here"] + x, F.lit(0.0)).alias("here"), F.greatest(s["best"], s["here"] + x).alias("best"))
    return F.aggregate(_gains(token, model), none, grow)["best"]


def _outside(c: Column, base: Column) -> Column:
    """The parts of a run that no base span covers, as an array of spans."""
    part = lambda first, end: F.struct(first.alias("start"), c["rank"].alias("rank"), end.alias("end"), F.substr(c["match"], (first - c["start"] + 1).cast("int"), (end - first).cast("int")).alias("match"))
    over = F.filter(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,match:string>>")
    after = F.aggregate(
        over,
        F.struct(c["start"].alias("at"), none.alias("parts")),
        lambda s, b: F.struct(F.greatest(s["at"], b["end"]).alias("at"), F.when(b["start"] > s["at"], F.concat(s["parts"], F.array(part(s["at"], b["start"])))).otherwise(s["parts"]).alias("parts")),
        lambda s: F.when(s["at"] < c["end"], F.concat(s["parts"], F.array(part(s["at"], c["end"])))).otherwise(s["parts"]),
    )
    return F.when(F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])), after).otherwise(F.array(c))


def _running(lengths: Column) -> Column:
    """Running totals of an array in blocks of 256, so that a text with very many matches stays cheap."""
    grow = lambda total, x: F.struct((total["at"] + x).alias("at"), F.concat(total["all"], F.array(total["at"] + x)).alias("all"))
    none = lambda at: F.struct(at.cast("long").alias("at"), F.array().cast("array<long>").alias("all"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / 256).cast("int")), lambda b: F.slice(lengths, b * 256 + 1, 256))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y))
    ends = F.aggregate(sums, none(F.lit(0)), grow)["all"]
    return F.flatten(F.zip_with(blocks, F.zip_with(ends, sums, lambda e, s: e - s), lambda x, first: F.aggregate(x, none(first), grow)["all"]))


def _spans(text: str, found: str, pattern: str, rank: int) -> Column:
    """Array of (start, rank, end, match) of the matches in column `found`."""
    pieces = F.split(F.col(text), pattern, -1)
    gaps = F.transform(F.slice(pieces, 1, F.size(found)), lambda x: F.length(x).cast("long"))
    sizes = F.transform(F.col(found), lambda x: F.length(x).cast("long"))
    ends = _running(F.zip_with(gaps, sizes, lambda a, b: a + b))
    made = F.zip_with(ends, F.col(found), lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), m.alias("match")))
    return F.when(F.size(found) > 0, made).otherwise(F.array().cast("array<struct<start:bigint,rank:int,end:bigint,match:string>>"))


def find_secrets(docs: DataFrame, model: list[float] | None = None, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """docs with one more column `out`: array of (start, rank, end, match), sorted; rank points into KINDS.

    Null or empty text: an empty array. Rows are neither dropped nor merged; no shuffle. Base spans always stay; model
    spans never overlap them. Columns of docs keep their values whatever they are called.
    """
    model = model or train(labelled_samples(docs.sparkSession))
    text, base, *names = (fresh(docs, f"__{n}") for n in ("text", "base", "assign", "access", "hex", "runs"))
    patterns = (ASSIGN, ACCESS, HEX, CANDIDATE)
    at = [fresh(docs, f"{n}_at") for n in names]
    df = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumns({name: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for name, p in zip(names, patterns, strict=True)})
    df = df.withColumns({spans: _spans(text, name, p, rank) for rank, (spans, name, p) in enumerate(zip(at, names, patterns, strict=True))})
    df = df.withColumn(at[0], F.filter(at[0], lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_LEAST))
    df = df.withColumn(base, F.array_sort(F.concat(*at[:3])))
    parts = F.flatten(F.transform(at[3], lambda c: _outside(c, F.col(base))))
    likely = F.filter(parts, lambda c: (F.length(c["match"]) > 1) & (best_llr(c["match"], model) >= LEAST_LLR))
    df = df.withColumn(out, F.array_sort(F.concat(base, F.when(F.size(at[3]) > 0, likely).otherwise(F.slice(at[3], 1, 0)))))
    return df.select(*[F.col(c) for c in docs.columns if c != out], out)


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_secrets(found: DataFrame, id_col: str = "doc_id", spans: str = "secrets") -> DataFrame:
    """One row per row of find_secrets: counts of the base kinds, SHA-256 of the base spans, and all spans as text."""
    count = lambda rank: F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")
    base = F.filter(spans, lambda s: s["rank"] < 3)
    return found.select(id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col(spans)).alias("spans"))


def redact_secrets(docs: DataFrame, model: list[float] | None = None, mask: str = "<SECRET>", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with every secret of the text replaced by `mask` (overlapping spans by one); size_col, if there, follows the text. All rows stay."""
    spans, merged = fresh(docs, "__found"), fresh(docs, "__merged")
    found = find_secrets(docs, model, text_col, spans)
    joined = F.aggregate(
        spans,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    df = found.withColumn(merged, joined)
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(F.col(merged), i - 1)["end"])
    pieces = F.transform(merged, lambda s, i: F.substr(F.col(text_col), (before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int")))
    tail = F.substr(F.col(text_col), (F.element_at(merged, -1)["end"] + 1).cast("int"))
    text = F.when(F.size(merged) > 0, F.array_join(F.concat(pieces, F.array(tail)), mask)).otherwise(F.col(text_col))
    df = df.withColumn(text_col, text)
    if size_col in docs.columns:
        df = df.withColumn(size_col, F.when(F.size(merged) > 0, F.length(text_col)).otherwise(F.col(size_col)).cast(docs.schema[size_col].dataType))
    return df.select(*docs.columns)
