"""The registered queries of this subpackage and, where SQL can say it, their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm import ann, codes, leaks, merkle, mixing, near, negatives, personal, secrets, shards, suffixes, toxicity, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_table(spark, sf_dir, "documents"))


def op3_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), inside=True)
    return found.select("doc_id", "item_id", "windows", "coverage", "consistent")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.taken(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(_table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_data(_table(spark, sf_dir, "documents"))


def op8_wavelet_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return wavelet.round_trip(_table(spark, sf_dir, "documents"), Path(tokenizer).read_text(encoding="utf-8"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.with_neighbours(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.with_label_errors(*codes.compressed(_table(spark, sf_dir, "embeddings")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_secrets": op2_secrets,
    "op3_leaks": op3_leaks,
    "op4_mixing": op4_mixing,
    "op5_neighbours": op5_neighbours,
    "op6_shards": op6_shards,
    "op7_personal_data": op7_personal_data,
    "op8_wavelet_tokens": op8_wavelet_tokens,
    "op9_toxicity": op9_toxicity,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_fingerprints": op11_fingerprints,
    "op12_vector_codes": op12_vector_codes,
    "op13_hard_negatives": op13_hard_negatives,
}


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Rounds of assigning parts to entries and of moving entries, one after the other."""
    ctes = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS q, len(embedding) // {parts} AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""s AS MATERIALIZED (SELECT rid, p, q[p * w + 1 : (p + 1) * w] AS x FROM v, unnest(range({parts})) AS u(p))""",
        f"""b0 AS MATERIALIZED (
  SELECT s.p, f.e, s.x AS c FROM s JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < {entries}) f USING (rid))""",
    ]
    distance = "list_sum([(s.x[i] - b.c[i]) * (s.x[i] - b.c[i]) for i in range(1, len(s.x) + 1)])"
    for k in range(rounds + 1):
        ctes.append(f"""d{k} AS MATERIALIZED (
  SELECT rid, p, min({{'d': d, 'e': e}}) AS best FROM (SELECT s.rid, s.p, b.e, {distance} AS d FROM s JOIN b{k} b ON s.p = b.p) GROUP BY rid, p)""")
        if k < rounds:
            ctes.append(f"""m{k} AS (
  SELECT p, e, list(c ORDER BY i) AS c FROM (
    SELECT d.p, d.best.e AS e, i, ((sum(s.x[i]) - ((sum(s.x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS c
    FROM d{k} d JOIN s ON s.rid = d.rid AND s.p = d.p, unnest(range(1, len(s.x) + 1)) AS u(i) GROUP BY d.p, d.best.e, i) GROUP BY p, e)""")
            ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e)")
    return (
        "WITH "
        + ",\n".join(ctes)
        + f""",
o AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM d{rounds} GROUP BY rid)
SELECT v.vec_id, o.code, o.error, (sum(o.error) OVER (PARTITION BY v.label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN o USING (rid)
"""
    )


ORACLES: dict[str, str] = {
    "op10_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS shingle
  FROM w, LATERAL (SELECT unnest(range(1, greatest(2, len(words) - 2))) AS i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, w.doc_id = c.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) c ON c.x = w.doc_id
""",
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, (sum(source_size::DOUBLE) OVER ()
    - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor
  FROM s),
t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, (SELECT max(factor) FROM f) * w) AS target FROM f),
o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d)
SELECT o.doc_id, o.size::BIGINT AS size, t.source_size, t.target,
       CASE WHEN t.source_size = 0 THEN 0
            ELSE (floor(t.target)::BIGINT // t.source_size) * o.size
                 + greatest(0, least(o.pos + o.size, floor(t.target)::BIGINT % t.source_size) - o.pos) END::BIGINT AS taken
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
""",
    "op12_vector_codes": _codes_sql(),
    "op13_hard_negatives": """
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.q, c.q)::BIGINT AS score
  FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
""",
}
