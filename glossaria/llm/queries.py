"""Queries opN_* over the driver's tables, and SQL for those that DuckDB can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_count, decontam, langid, lm_score, piece_lattice, quality, shard, simhash, transport, urlgraph


def tokenizer_path(name: str) -> str:
    """A vocabulary file: in the folder of $TOKENIZERS_DIR, if that is set, else where it is installed."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain: documents that are labelled as of good quality."""
    good = _table(spark, sf_dir, "labels").filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("member")).distinct()
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.compression_scores(docs, lm_score.rows_of(docs, good), ["doc_id"])


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.interleave(_table(spark, sf_dir, "documents"), 40)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.stream_digest(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge_pages(_table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.encoding_digest(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_lm_scores, op3_shards, op4_decontamination, op5_transport_streams, op6_language_id, op7_url_filter, op8_simhash, op9_sentencepiece, op10_quality, pipeline)}

# CRC-32 by half bytes: the low half of each byte comes first.
_CRC_STEPS = []
for _i in range(16):
    _c = _i
    for _ in range(4):
        _c = _c >> 1 ^ 0xEDB88320 if _c & 1 else _c >> 1
    _CRC_STEPS.append(_c)

_SHARDS = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS stratum,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
c AS (
  SELECT doc_id, stratum, k, CAST(strlen(t) + 16 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, 2 * strlen(t)), lambda i:
           CAST(strpos('0123456789ABCDEF', h[1 + i + CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END]) - 1 AS BIGINT))),
           lambda s, n: xor(s >> 4, CAST({_CRC_STEPS}[1 + (xor(s, n) & 15)] AS BIGINT))), CAST(4294967295 AS BIGINT)) AS text_crc32
  FROM (SELECT *, hex(encode(t)) AS h FROM d)),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY k, doc_id NULLS FIRST, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS f
  FROM c),
p AS (
  SELECT *, row_number() OVER (ORDER BY f, stratum, k, doc_id NULLS FIRST, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 40 // n AS INTEGER) AS shard,
       CAST(place - ((place * 40 // n) * n + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""

_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS x
  FROM (SELECT item_id, w[i : i + least(10, len(w)) - 1] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0))),
spot AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hit AS (
  SELECT r, i, n, item_id
  FROM (SELECT r, i, z.n, array_to_string(w[i : i + z.n - 1], ' ') AS x FROM spot, (SELECT DISTINCT n FROM win) z WHERE i + z.n - 1 <= len(w)) a
  JOIN win USING (n, x)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op3_shards": _SHARDS, "op4_decontamination": _DECONTAMINATION}
