"""The registered queries of the subpackage: thin calls of its operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm import centroids, codes, decontaminate, embeddings, html, jaccard, lm, phrases, quality, secrets, sharding, tokens

BYTE_BPE = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"), shards=16)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels"), "quality")
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_read(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_secrets(secrets.find_secrets(_read(spark, sf_dir, "documents")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=512)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(_read(spark, sf_dir, "pages"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"), least=0.95)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), capacity=2048, end_id=1)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_read(spark, sf_dir, "embeddings"), clusters=8, rounds=10, dims=64, scale=1024, seed=3)


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress_vectors(_read(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprint_documents(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_secret_scans": op5_secret_scans,
    "op6_token_counts": op6_token_counts,
    "op7_html_extraction": op7_html_extraction,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_packing": op9_packing,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_vector_code_compression": op12_vector_code_compression,
    "op13_document_fingerprints": op13_document_fingerprints,
}
#: Floor of the quotient of two whole numbers, n above 0; the division itself leaves no rest.
_FLOOR = "({s} - (({s} % {n}) + {n}) % {n}) // {n}"
_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_SQUARED = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _clustering_sql(clusters: int, rounds: int, dims: int, scale: int, seed: int) -> str:
    """Rounds of assignment (a) and movement (c), written out one after the other."""
    far, mean = _SQUARED.format(a="e.v", b="c.c"), _FLOOR.format(s="CAST(sum(x) AS BIGINT)", n="count(*)")
    ctes = [
        f"""e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
FROM embeddings WHERE len(embedding) = {dims} AND {_FINITE})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM e ORDER BY h LIMIT {clusters}))",
    ]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, min({{'d': CAST({far} AS BIGINT), 'k': c.k}}) AS m FROM e, c{i} AS c GROUP BY r)")
        if i < rounds:
            ctes.append(f"""m{i} AS (SELECT k, list(x ORDER BY i) AS c FROM (SELECT k, i, {mean} AS x FROM
(SELECT a.m.k AS k, unnest(e.v) AS x, unnest(range({dims})) AS i FROM a{i} AS a JOIN e USING (r)) GROUP BY k, i) GROUP BY k)""")
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM c{i} AS o LEFT JOIN m{i} AS m USING (k))")
    return f"""WITH {", ".join(ctes)}
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia,
CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM e JOIN a{rounds} USING (r) JOIN c{rounds} AS c ON c.k = m.k"""


def _codes_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    far, mean = _SQUARED.format(a="e.v", b="c.c"), _FLOOR.format(s="CAST(sum(x) AS BIGINT)", n="count(*)")
    ctes = [
        f"""w AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
FROM embeddings WHERE embedding IS NOT NULL AND {_FINITE})""",
        f"e AS MATERIALIZED (SELECT r, vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM w, range({parts}) AS t(p))",
        f"c0 AS (SELECT p, k, v AS c FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM e) WHERE k < {entries})",
    ]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, e.p, min({{'d': CAST({far} AS BIGINT), 'k': c.k}}) AS m FROM e JOIN c{i} AS c ON c.p = e.p GROUP BY r, e.p)")
        if i < rounds:
            ctes.append(f"""m{i} AS (SELECT p, k, list(x ORDER BY i) AS c FROM (SELECT p, k, i, {mean} AS x FROM
(SELECT p, a.m.k AS k, unnest(e.v) AS x, unnest(range(len(e.v))) AS i FROM a{i} AS a JOIN e USING (r, p)) GROUP BY p, k, i) GROUP BY p, k)""")
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT p, k, coalesce(m.c, o.c) AS c FROM c{i} AS o LEFT JOIN m{i} AS m USING (p, k))")
    return f"""WITH {", ".join(ctes)},
f AS (SELECT r, string_agg(format('{{:02x}}', m.k), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256 FROM w JOIN f USING (r)"""


#: SQL of the queries that it can express. Links are followed by recursion.
ORACLES: dict[str, str] = {
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS x FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n p ON p.doc_id = o.a JOIN n q ON q.doc_id = o.b WHERE 100 * c >= 90 * (p.n + q.n - c)),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT n.doc_id, n.n AS n_shingles, component_id FROM n JOIN m ON m.id = n.doc_id""",
    "op8_embedding_near_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r(id, c) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN m ON m.id = vec_id LEFT JOIN k ON k.a = vec_id""",
    "op11_centroid_clustering": _clustering_sql(clusters=8, rounds=10, dims=64, scale=1024, seed=3),
    "op12_vector_code_compression": _codes_sql(parts=16, entries=64, rounds=2, scale=256),
}
