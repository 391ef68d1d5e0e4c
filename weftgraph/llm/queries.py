"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, language, mixing, mtree, quality, sharding, simhash_forest, suffix_dedup, token_counts
from .common import table

BPE_FILE = "byte_bpe_50k.json"


def op1_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(table(spark, sf_dir, "documents"))


def _held_out(folds: int, fold: int) -> F.Column:
    """Whether crc32 of the id's text falls in the held-out fold (a null id does not)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~_held_out(3, 1))
    scored = quality.score(docs, model)
    return scored.select("doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, ~_held_out(4, 2))
    return language.identify(docs, model).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), ids=False, digests=True)


def op8_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_weighted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_study(table(spark, sf_dir, "documents"))


def op10_simhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_forest.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


QUERIES = {f.__name__: f for f in (op1_mtree_top_k, op2_source_mix, op3_token_counts, op4_suffix_dedup, op5_quality_scores, op6_language_id, op7_bpe_round_trip, op8_bounded_ring, op9_weighted_samples, op10_simhash_forest)}

ORACLES: dict[str, str] = {
    "op2_source_mix": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                     [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
        l(k, level) AS (
          SELECT 0, (SELECT CAST(sum(source_size) AS DOUBLE) / sum(w) FROM s)
          UNION ALL
          SELECT k + 1, (SELECT (sum(source_size) - coalesce(sum(3 * source_size) FILTER (WHERE l.level * w >= 3 * source_size), 0))
                                / sum(w) FILTER (WHERE l.level * w < 3 * source_size) FROM s)
          FROM l WHERE k < 30),
        t AS (SELECT source, source_size, least(w * (SELECT level FROM l WHERE k = 30), CAST(3 * source_size AS DOUBLE)) AS target,
                     CAST('0x' || substr(md5(concat_ws(chr(31), '17', source)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS drawn FROM s),
        n AS (SELECT d.doc_id, d.size, t.*, row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id) - 1 AS i,
                     CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               size * CASE WHEN size > 0 THEN least(CAST(floor((i + 1) * rate + drawn) - floor(i * rate + drawn) AS BIGINT), 3) ELSE 0 END AS taken
        FROM n""",
    "op10_simhash_forest": r"""
        WITH RECURSIVE r AS (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text),
        w AS (SELECT id, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS ws FROM r),
        s AS (SELECT DISTINCT id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k : k + 4], ' '))
                                              WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
        c AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        p AS (SELECT a.id AS u, b.id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
        e AS (SELECT u, v FROM p JOIN c x ON x.id = u JOIN c y ON y.id = v WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
        cc(id, label) USING KEY (id) AS (SELECT id, id FROM r UNION
          SELECT e.v, min(cc.label) FROM cc JOIN e ON e.u = cc.id JOIN recurring.cc k ON k.id = e.v WHERE cc.label < k.label GROUP BY e.v)
        SELECT d.doc_id, coalesce(label, d.doc_id) AS class_id FROM documents d LEFT JOIN r ON r.text = d.text LEFT JOIN cc ON cc.id = r.id""",
    "op4_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT doc_id, h, unnest(generate_series(1, length(h) // 2 - 49)) AS pos FROM d),
        w AS (SELECT doc_id, pos, substr(h, 2 * pos - 1, 100) AS s FROM p),
        f AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
        m AS (SELECT doc_id, pos FROM w JOIN f USING (s) WHERE first_id < doc_id),
        e AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER o <= 50 THEN 0 ELSE 1 END AS fresh
              FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
        n AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM e),
        i AS (SELECT doc_id, span, min(pos) AS a, max(pos) + 49 AS z FROM n GROUP BY doc_id, span),
        k AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, max(z) AS last_z FROM i GROUP BY doc_id),
        c AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM i),
        r AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) AS kept
              FROM c JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last_z + 1) END)) AS kept_sha256
        FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id""",
    "op1_mtree_top_k": """
        WITH x AS (
          SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS (
          SELECT q.n, q.vec_id AS query_id, x.vec_id,
                 CAST(coalesce(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
          FROM x q JOIN x ON x.n <> q.n WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
