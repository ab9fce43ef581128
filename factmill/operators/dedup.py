"""Duplicate and conflict search between new facts and existing ones of the same subject.

Facts: (id, ord, subject_id, entity_type, entity_name, value, unit, date), and value_text where values may be words. With `earlier`, a fact is only compared with those
that come before it. The first match of a group is the first fact of the group, so most rules join facts to groups of one row, and
never pair all facts of a subject; values are searched along sorted values of a day. Only paired_conflicts(), which counts pairs, makes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factmill import config as C
from factmill.functions.annotate import may_be_alike, name_ratio
from factmill.functions.text import canonical, entity_key, norm
from factmill.operators.vector import range_search
from factmill.sources.shared import dealt, materialize

#: Rows of a table of names that may be broadcast.
SENT_NAMES = 100_000

TREATMENTS = ("medication", "treatment", "procedure", "surgery")
DIAGNOSES = ("diagnosis", "condition")


def prepared(facts: DataFrame) -> DataFrame:
    """facts with the keys that the rules join on. A value_text that reads as a number is that number, if the fact has none."""
    words = norm(F.col("value_text")) if "value_text" in facts.columns else F.lit("")
    value = F.coalesce("value", words.try_cast("double")) if "value_text" in facts.columns else F.col("value")
    return facts.withColumn("value", value).withColumn("text", F.when(F.col("value").isNull(), F.nullif(words, F.lit("")))).select(
        "id", "ord", "subject_id", F.lower(F.coalesce("entity_type", F.lit(""))).alias("type"), norm(F.col("entity_name")).alias("name"), canonical(F.col("entity_name")).alias("canon"),
        entity_key(F.col("entity_name")).alias("key"), F.round("value", 4).alias("rounded"), "value", "text", F.col("date").cast("date").alias("date"),
    )


def _sides(new: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    return side(prepared(new), "n"), side(prepared(existing), "e")


def _on(*keys: str, earlier: bool = True) -> Column:
    cond = F.col("n_subject_id") == F.col("e_subject_id")
    for k in keys:
        cond = cond & (F.col(f"n_{k}") == F.col(f"e_{k}"))
    return cond & (F.col("e_ord") < F.col("n_ord")) if earlier else cond


def _gap() -> Column:
    return F.abs(F.datediff("n_date", "e_date"))


def _firsts(existing: DataFrame, *keys: str) -> DataFrame:
    """(e_<key>..., e_ord, e_id) of the first existing fact of each group: the earliest match of all, so that a group meets a new fact as one row."""
    e = prepared(existing) if "type" not in existing.columns else existing
    return e.groupBy("subject_id", *keys).agg(F.min(F.struct("ord", "id")).alias("f")).select(*[F.col(k).alias(f"e_{k}") for k in ("subject_id", *keys)], F.col("f.ord").alias("e_ord"), F.col("f.id").alias("e_id"))


def _earlier(pairs: DataFrame, earlier: bool) -> DataFrame:
    return pairs.where("e_ord < ord") if earlier else pairs


def exact_matches(new: DataFrame, existing: DataFrame, earlier: bool = True, days: int = C.DEFAULT.exact_days) -> DataFrame:
    """(id, match_id): the first existing fact of the same type, name and value within `days`, or both undated.

    A new fact asks for the first fact of each day around it, so equal facts of a subject are never paired with each other.
    """
    around = F.when(F.col("date").isNull(), F.array(F.lit(None).cast("date"))).otherwise(F.sequence(F.date_sub("date", days), F.date_add("date", days)))
    n = prepared(new).withColumn("day", F.explode(around))
    first = _firsts(prepared(existing), "type", "name", "rounded", "date")
    on = (F.col("subject_id") == F.col("e_subject_id")) & (F.col("type") == F.col("e_type")) & (F.col("name") == F.col("e_name")) & F.col("rounded").eqNullSafe(F.col("e_rounded")) & F.col("day").eqNullSafe(F.col("e_date"))
    return _earlier(n.join(dealt(first), on), earlier).groupBy("id").agg(F.min_by("e_id", "e_ord").alias("match_id"))


def alias_matches(new: DataFrame, existing: DataFrame, earlier: bool = True, vectors: DataFrame | None = None, least_name: float = C.DEFAULT.name_ratio, least_cosine: float = C.DEFAULT.dedup_cosine) -> DataFrame:
    """(id, match_id): the first existing fact of the same type whose name has the same canonical term, or is alike, or whose vector is near, whatever its date.

    Names are compared once for each pair of distinct names, and so are vectors (name, vector): what can match is a small table of
    names, and facts meet the first fact of each name.
    """
    n, e = prepared(new), prepared(existing)
    names = n.select("name").unionByName(e.select("name")).where("name <> ''").distinct()
    alike = alike_names(names, "name", least_name).select("a", "b")
    if vectors is not None:
        alike = alike.unionByName(near_names(vectors, least_cosine))
    same = names.select(F.col("name").alias("a"), F.col("name").alias("b"))
    means = same.unionByName(alike).unionByName(alike.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    means = materialize(means, "means")
    means = F.broadcast(means) if means.count() <= SENT_NAMES else dealt(means)
    by_name = n.join(means, F.col("name") == F.col("a")).select("id", "ord", "subject_id", "type", F.concat(F.lit("n:"), "b").alias("means"))
    by_canon = n.where("canon <> ''").select("id", "ord", "subject_id", "type", F.concat(F.lit("c:"), "canon").alias("means"))
    held = e.select("id", "ord", "subject_id", "type", F.explode(F.array_compact(F.array(F.when(F.col("name") != "", F.concat(F.lit("n:"), "name")), F.when(F.col("canon") != "", F.concat(F.lit("c:"), "canon"))))).alias("means"))
    first = _firsts(held, "type", "means")
    on = (F.col("subject_id") == F.col("e_subject_id")) & (F.col("type") == F.col("e_type")) & (F.col("means") == F.col("e_means"))
    return _earlier(by_name.unionByName(by_canon).join(dealt(first), on), earlier).groupBy("id").agg(F.min_by("e_id", "e_ord").alias("match_id"))


def near_names(vectors: DataFrame, least: float) -> DataFrame:
    """(a, b) of distinct names whose vectors (name, vector) are at cosine >= least. Every name asks all rows, in blocks that the search broadcasts."""
    v = vectors.select(norm(F.col("name")).alias("name"), "vector").groupBy("name").agg(F.min("vector").alias("vector")).withColumn("vec_id", F.xxhash64("name"))
    found = range_search(v, v, least, vector_col="vector")
    name = lambda c, to: v.select(F.col("vec_id").alias(c), F.col("name").alias(to))
    return found.where("query_id < vec_id").join(name("query_id", "a"), "query_id").join(name("vec_id", "b"), "vec_id").select("a", "b")


def timeseries_matches(new: DataFrame, existing: DataFrame, earlier: bool = True, days: int = C.DEFAULT.exact_days) -> DataFrame:
    """(id, match_id, gap): the existing fact of the same entity that lies farthest in time, over `days` away; the first on a tie.

    The farthest fact is the first or the last in time of those before, so running extremes of the entity are enough: no pairs.
    """
    cols = ["id", "ord", "subject_id", "type", "key", "date"]
    both = prepared(existing).select(*cols, F.lit(0).alias("asks")).unionByName(prepared(new).select(*cols, F.lit(1).alias("asks"))).where("date IS NOT NULL")
    w = W.partitionBy("subject_id", "type", "key").orderBy("ord", F.desc("asks"))
    frame = w.rowsBetween(W.unboundedPreceding, W.currentRow) if earlier else w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    held = F.col("asks") == 0
    first = F.min(F.when(held, F.struct("date", "ord", "id"))).over(frame)
    last = F.min(F.when(held, F.struct((-F.unix_date("date")).alias("back"), "ord", "id", "date"))).over(frame)
    seen = both.withColumns({"first": first, "last": last}).where("asks = 1 AND first IS NOT NULL")
    spot = lambda x: F.struct((-F.abs(F.datediff("date", x["date"]))).alias("gap"), x["ord"].alias("ord"), x["id"].alias("id"))
    best = F.least(spot(F.col("first")), spot(F.col("last")))
    return seen.select("id", best.alias("b")).where(-F.col("b.gap") > days).select("id", F.col("b.id").alias("match_id"), (-F.col("b.gap")).alias("gap"))


def alike_names(names: DataFrame, name: str = "name", least: float = C.DEFAULT.name_ratio) -> DataFrame:
    """(a, b, ratio) of distinct normalised names that are alike. Names of a ratio over 2/3 share a run of two characters, so pairs meet by bigrams
    of their rarest kind: each name is dealt by as many of its bigrams as it could lose and still be alike."""
    distinct = names.select(norm(F.col(name)).alias("a")).where("length(a) > 1").distinct()
    grams = distinct.select("a", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("a") - 1), lambda i: F.substr(F.col("a"), i, F.lit(2))))).alias("g"))
    held = grams.groupBy("g").agg(F.count("*").alias("n"))
    ranked = grams.join(dealt(held), "g").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("all"))
    # a changed character touches two bigrams: alike names differ in (1 - least) / least of their characters at most
    lost = F.ceil(2 * F.length("a") * (1 - least) / least).cast("int") * 2 + 2
    few = ranked.select("a", F.explode(F.transform(F.slice("all", 1, lost), lambda x: x["g"])).alias("g"))
    left, right = few.alias("l"), few.alias("r")
    pairs = left.join(dealt(right), F.expr("l.g = r.g AND l.a < r.a") & may_be_alike(F.col("l.a"), F.col("r.a"), least)).select(F.col("l.a").alias("a"), F.col("r.a").alias("b")).distinct()
    return pairs.withColumn("ratio", name_ratio("a", "b")).where(F.col("ratio") >= least)


def _excludes(a: Column, b: Column) -> Column:
    has = lambda c, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))
    out = F.lit(False)
    for left, right in C.EXCLUSIVE:
        out = out | (has(a, left) & has(b, right)) | (has(b, left) & has(a, right))
    return out


def values_differ(a: Column, b: Column) -> Column:
    """Over two per cent of the larger magnitude apart; null never differs."""
    most = F.greatest(F.abs(a), F.abs(b))
    return F.coalesce((most > 0) & (F.abs(a - b) / F.greatest(most, F.lit(1e-9)) > SHARE), F.lit(False))


def _implausible() -> Column:
    gap, delta = _gap(), F.abs(F.col("n_value") - F.col("e_value"))
    out = F.lit(False)
    for entity, days, change in C.IMPLAUSIBLE:
        out = out | ((F.col("e_key") == entity) & (gap < days) & (delta > change))
    return F.coalesce(out, F.lit(False))


def drug_conflicts(new: DataFrame, existing: DataFrame, earlier: bool = True) -> DataFrame:
    """(id, match_id, reason) of medications that interact with an existing one. Drugs meet the fixed rule table first, and then the first fact of the other drug."""
    spark = new.sparkSession
    rules = spark.createDataFrame([(x, y, r) for a, b, r in C.INTERACTIONS for x, y in ((a, b), (b, a))], "name string, other string, reason string")
    n = prepared(new).where("type = 'medication'").join(F.broadcast(rules), "name")
    first = _firsts(prepared(existing).where("type = 'medication'"), "name")
    pairs = _earlier(n.join(dealt(first), (F.col("subject_id") == F.col("e_subject_id")) & (F.col("other") == F.col("e_name"))), earlier)
    return pairs.groupBy("id").agg(F.min(F.struct("e_ord", "e_id", "reason")).alias("f")).select("id", F.col("f.e_id").alias("match_id"), "f.reason", F.col("f.e_ord").alias("ord"))


def _steps(rows: DataFrame, later: bool) -> DataFrame:
    """(subject_id, above, upto, e_ord, e_id): which fact is the first in order to lie after (before) a day, for days from `above` to `upto`, as day numbers.

    Only facts that lie farther than all before them can be the first; a later fact of a day already passed never is.
    """
    day = F.unix_date("date") * (1 if later else -1)
    per_day = rows.where("date IS NOT NULL").groupBy("subject_id", day.alias("upto")).agg(F.min(F.struct("ord", "id")).alias("f"))
    w = W.partitionBy("subject_id").orderBy("f.ord").rowsBetween(W.unboundedPreceding, -1)
    passed = per_day.withColumn("above", F.max("upto").over(w))
    return passed.where("above IS NULL OR upto > above").select(F.col("subject_id").alias("e_subject_id"), F.coalesce("above", F.lit(-(1 << 31)).cast("long")).alias("above"), "upto", F.col("f.ord").alias("e_ord"), F.col("f.id").alias("e_id"))


def temporal_conflicts(new: DataFrame, existing: DataFrame, earlier: bool = True) -> DataFrame:
    """(id, match_id): a treatment dated before a diagnosis of the subject, whatever the entities. Each fact meets one step of its subject in each direction."""
    n, e = prepared(new).where("date IS NOT NULL"), prepared(existing)

    def side(asks: tuple[str, ...], asked: tuple[str, ...], later: bool) -> DataFrame:
        day = F.unix_date("date") * (1 if later else -1)
        rows = n.where(F.col("type").isin(*asks)).withColumn("day", day)
        steps = _steps(e.where(F.col("type").isin(*asked)), later)
        return rows.join(dealt(steps), (F.col("subject_id") == F.col("e_subject_id")) & (F.col("day") >= F.col("above")) & (F.col("day") < F.col("upto")))

    pairs = _earlier(side(TREATMENTS, DIAGNOSES, True).unionByName(side(DIAGNOSES, TREATMENTS, False)), earlier)
    return pairs.groupBy("id").agg(F.min_by("e_id", "e_ord").alias("match_id"), F.min("e_ord").alias("ord"))


def paired_conflicts(new: DataFrame, existing: DataFrame, earlier: bool = True) -> DataFrame:
    """(id, match_id, ord, kind, type) of all pairs of facts of one type that are in conflict, by the first kind that holds, for counts of pairs; conflicts() doesn't pair."""
    n, e = _sides(new, existing)
    same = n.join(dealt(e), _on("type", "key", earlier=earlier))
    value = (_gap() <= 1) & values_differ(F.col("n_value"), F.col("e_value"))
    kind = F.when(_excludes(F.col("n_name"), F.col("e_name")), 1).when(value, 2).when(_implausible(), 3)
    same = same.withColumn("kind", kind)
    variant = lambda c: _marked(F.col(c))
    other = n.where(variant("n_name")).join(dealt(e.where(variant("e_name"))), _on("type", earlier=earlier) & (F.col("n_key") != F.col("e_key")) & _excludes(F.col("n_name"), F.col("e_name"))).withColumn("kind", F.lit(1))
    return same.unionByName(other).where("kind IS NOT NULL").select(F.col("n_id").alias("id"), F.col("e_id").alias("match_id"), F.col("e_ord").alias("ord"), "kind", F.col("n_type").alias("type"))


def first_exclusive(new: DataFrame, existing: DataFrame, earlier: bool = True) -> DataFrame:
    """(id, match_id, ord, type): the first existing fact of a variant that excludes the new one's, in the same type. A new fact meets the first fact of each opposite variant."""
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("name"), w))
    sides = [(f"{i}{s}", f"{i}{t}", words) for i, (left, right) in enumerate(C.EXCLUSIVE) for s, t, words in (("l", "r", left), ("r", "l", right))]
    spread = lambda df, at: df.withColumn("variant", F.explode(F.array_compact(F.array(*[F.when(has(x[2]), F.lit(x[at])) for x in sides]))))
    first = _firsts(spread(prepared(existing), 0), "type", "variant")
    on = (F.col("subject_id") == F.col("e_subject_id")) & (F.col("type") == F.col("e_type")) & (F.col("variant") == F.col("e_variant"))
    found = _earlier(spread(prepared(new), 1).join(dealt(first), on), earlier)
    return found.groupBy("id", "type").agg(F.min(F.struct("e_ord", "e_id")).alias("f")).select("id", F.col("f.e_id").alias("match_id"), F.col("f.e_ord").alias("ord"), "type")


#: Two values differ if they are farther apart than this share of the larger magnitude.
SHARE = 0.02
#: Decimal places to which limits are cut where that is within a billionth of them, so that a limit that is a value compares as that value.
PLACES = 10


def _limits(facts: DataFrame) -> DataFrame:
    """A row for each rule of values and direction that a fact has: a value x of sign * value is in conflict if x > c, or x = c and not strict, up to `span` days away."""
    none, change = F.lit(None).cast("double"), lambda days, most: F.struct(F.lit(3).alias("kind"), F.lit(days - 1).alias("span"), F.lit(float(most)).alias("change"))
    rules = [F.struct(F.lit(2).alias("kind"), F.lit(1).alias("span"), none.alias("change")), *(F.when(F.col("key") == entity, change(days, most)) for entity, days, most in C.IMPLAUSIBLE)]
    rows = facts.withColumn("rule", F.explode(F.array_compact(F.array(*rules)))).withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    rows = rows.select("*", "rule.kind", "rule.span", "rule.change", (F.col("value") * F.col("sign")).alias("v"))
    exact = F.when(F.col("kind") == 3, F.col("v") + F.col("change")).when(F.col("v") > 0, F.col("v") / (1 - SHARE)).otherwise(F.col("v") * (1 - SHARE))
    near = F.round("exact", PLACES)
    rows = rows.withColumn("exact", exact).withColumn("c", F.when(F.abs(near - F.col("exact")) <= 1e-9 * F.abs("exact"), near).otherwise(F.col("exact")))
    inside = F.when(F.col("kind") == 3, F.abs(F.col("v") - F.col("c")) <= F.col("change")).otherwise(~values_differ(F.col("c"), F.col("v")))
    return rows.withColumn("strict", inside).drop("rule", "exact", "v", "change")


def first_value_conflicts(new: DataFrame, existing: DataFrame, earlier: bool = True) -> DataFrame:
    """(id, match_id, ord, kind, type): the first existing fact of the same entity whose value is at odds, for either kind: 2 differs within a day, 3 changes too much within
    the days of its rule.

    A new fact asks the days around it that the entity has facts on and whose extreme values are beyond its limits. Of one day, the first fact beyond a
    limit is a running minimum of the order along falling values, with each value standing once; so no two facts of an entity
    are paired, and a day of very many facts is sorted once. Facts without a value or a date have no such conflict.
    """
    usable = F.col("value").isNotNull() & ~F.isnan("value") & F.col("date").isNotNull()
    n, e = prepared(new).where(usable), prepared(existing).where(usable)
    keys = ["subject_id", "type", "key", "date"]
    values = e.groupBy(*keys, "value").agg(F.min(F.struct("ord", "id")).alias("f"))
    days = values.groupBy(*keys).agg(F.max("value").alias("most"), F.min("value").alias("least"), F.min("f.ord").alias("first"))
    asks = _limits(n).withColumn("date", F.explode(F.sequence(F.date_sub("date", F.col("span")), F.date_add("date", F.col("span"))))).drop("span", "value")
    asks = asks.join(dealt(days), keys).withColumn("reach", F.when(F.col("sign") == 1, F.col("most")).otherwise(-F.col("least")))
    asks = asks.where("reach > c OR (reach = c AND NOT strict)")
    asks = asks.where("first < ord") if earlier else asks
    held = values.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).select(*keys, "sign", (F.col("value") * F.col("sign")).alias("at"), F.lit(1).alias("tie"), "f", *[F.lit(None).cast(t).alias(c) for c, t in (("id", n.schema["id"].dataType), ("kind", "int"), ("mine", n.schema["ord"].dataType))])
    tie = F.when(F.col("strict"), 0).otherwise(2)
    asked = asks.select(*keys, "sign", F.col("c").alias("at"), tie.alias("tie"), F.lit(None).cast(values.schema["f"].dataType).alias("f"), "id", "kind", F.col("ord").alias("mine"))
    w = W.partitionBy(*keys, "sign").orderBy(F.desc("at"), "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = held.unionByName(asked).withColumn("b", F.min("f").over(w)).where("id IS NOT NULL AND b IS NOT NULL")
    found = found.where("b.ord < mine") if earlier else found
    return found.groupBy("id", "type", "kind").agg(F.min("b").alias("b")).select("id", F.col("b.id").alias("match_id"), F.col("b.ord").alias("ord"), "kind", "type")


def first_text_conflicts(new: DataFrame, existing: DataFrame, earlier: bool = True) -> DataFrame:
    """(id, match_id, ord, type): the first existing fact of the same entity within a day whose value is another text, or a number where one of both is a text.

    A day of an entity is two rows, the first fact and the first one of another value: whichever is not the new fact's value is its match.
    """
    label = F.when(F.col("text").isNotNull(), F.concat(F.lit("t:"), "text")).when(F.col("value").isNotNull(), "number")
    usable = lambda df: prepared(df).withColumn("label", label).where("label IS NOT NULL AND date IS NOT NULL")
    keys = ["subject_id", "type", "key", "date"]
    labels = usable(existing).groupBy(*keys, "label").agg(F.min(F.struct("ord", "id")).alias("f"))
    one = labels.groupBy(*keys).agg(F.min(F.struct("f", "label")).alias("one"))
    two = labels.join(dealt(one), keys).where("label <> one.label").groupBy(*keys).agg(F.min("f").alias("two"))
    asks = usable(new).withColumn("date", F.explode(F.sequence(F.date_sub("date", 1), F.date_add("date", 1))))
    met = asks.join(dealt(one.join(dealt(two), keys, "left")), keys).withColumn("f", F.when(F.col("label") != F.col("one.label"), F.col("one.f")).otherwise(F.col("two"))).where("f IS NOT NULL")
    met = met.where("f.ord < ord") if earlier else met
    return met.groupBy("id", "type").agg(F.min("f").alias("f")).select("id", F.col("f.id").alias("match_id"), F.col("f.ord").alias("ord"), "type")


def first_conflicts(new: DataFrame, existing: DataFrame, earlier: bool = True) -> DataFrame:
    """(id, match_id, ord, kind, type): for each kind of conflict between facts of one type, the first existing fact with it; of value conflicts, up to one by numbers and one by texts."""
    exclusive = first_exclusive(new, existing, earlier).withColumn("kind", F.lit(1))
    out = exclusive.unionByName(first_value_conflicts(new, existing, earlier))
    if "value_text" not in new.columns and "value_text" not in existing.columns:
        return out
    return out.unionByName(first_text_conflicts(new, existing, earlier).withColumn("kind", F.lit(2)))


def _marked(c: Column) -> Column:
    words = [w for left, right in C.EXCLUSIVE for w in (*left, *right)]
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


KINDS = {1: "type_mismatch", 2: "value_mismatch", 3: "implausible_change"}


def conflicts(new: DataFrame, existing: DataFrame, earlier: bool = True) -> DataFrame:
    """(id, match_id, conflict_type, severity): the first conflict of each new fact: drugs, then time, then the first existing fact in order."""
    rank = lambda stage, df, kind: df.select("id", F.struct(F.lit(stage).alias("stage"), "ord", kind.alias("kind"), "match_id", df["type"] if "type" in df.columns else F.lit("").alias("type")).alias("f"))
    pool = rank(1, drug_conflicts(new, existing, earlier), F.lit(0)).unionByName(rank(2, temporal_conflicts(new, existing, earlier), F.lit(0))).unionByName(rank(3, first_conflicts(new, existing, earlier), F.col("kind")))
    best = pool.groupBy("id").agg(F.min("f").alias("f"))
    stage, kind = F.col("f.stage"), F.col("f.kind")
    name = F.when(stage == 1, "drug_interaction").when(stage == 2, "temporal").when(kind == 1, "type_mismatch").when(kind == 2, "value_mismatch").otherwise("implausible_change")
    severity = F.when(stage == 1, "critical").when(stage == 2, "medium").when(kind != 2, "high").when(F.col("f.type") == "medication", "critical").when(F.col("f.type") == "test_result", "high").otherwise("medium")
    return best.select("id", F.col("f.match_id").alias("match_id"), name.alias("conflict_type"), severity.alias("severity"))


def decide(new: DataFrame, existing: DataFrame, earlier: bool = True) -> DataFrame:
    """(id, strategy, action, match_id) of every new fact: exact, then conflict, then time series, then alias, else insert."""
    tag = lambda p, df, name, action: df.select("id", F.struct(F.lit(p).alias("p"), F.lit(name).alias("strategy"), F.lit(action).alias("action"), "match_id").alias("f"))
    pool = (
        tag(1, exact_matches(new, existing, earlier), "exact", "merge")
        .unionByName(tag(2, conflicts(new, existing, earlier), "conflict", "quarantine"))
        .unionByName(tag(3, timeseries_matches(new, existing, earlier), "timeseries", "append_timeline"))
        .unionByName(tag(4, alias_matches(new, existing, earlier), "semantic", "merge"))
    )
    best = pool.groupBy("id").agg(F.min("f").alias("f"))
    out = new.select("id").join(dealt(best), "id", "left")
    return out.select("id", F.coalesce("f.strategy", F.lit("none")).alias("strategy"), F.coalesce("f.action", F.lit("insert")).alias("action"), F.col("f.match_id").alias("match_id"))


def normalize_units(facts: DataFrame) -> DataFrame:
    """facts with canonical value and unit; an unknown entity keeps both, an unknown unit keeps the value under the canonical unit."""
    spark = facts.sparkSession
    rules = spark.createDataFrame(C.UNITS, "entity string, from_unit string, canonical string, factor double, addend double")
    targets = rules.groupBy("entity").agg(F.first("canonical").alias("target"))
    keyed = facts.withColumn("entity", F.lower(F.trim(F.coalesce("entity_name", F.lit(""))))).withColumn("from_unit", F.lower(F.trim(F.coalesce("unit", F.lit("")))))
    out = keyed.join(F.broadcast(rules), ["entity", "from_unit"], "left").join(F.broadcast(targets), "entity", "left")
    return out.select(*facts.columns, F.coalesce(F.col("value") * F.col("factor") + F.col("addend"), F.col("value")).alias("normalized_value"), F.coalesce("canonical", "target", F.coalesce("unit", F.lit(""))).alias("normalized_unit"))
