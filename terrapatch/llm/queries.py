"""The registered query of each operator of this subpackage, and its SQL where DuckDB can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrapatch.llm import common


def vocab_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrapatch.llm import bpe

    return bpe.round_trip(common.table(spark, sf_dir, "documents"), vocab_path("byte_bpe_50k.json"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from terrapatch.llm import lm

    held = common.crc_mod("doc_id", 7) == 2
    out = lm.scored(common.table(spark, sf_dir, "documents"), vocab_path("byte_bpe_50k.json"), ~held)
    return out.select("doc_id", held.alias("held_out"), *[F.col(c) for c in out.columns if c != "doc_id"])


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrapatch.llm import packing

    return packing.packed(common.table(spark, sf_dir, "documents"), vocab_path("word_bpe_49k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrapatch.llm import simhash

    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from terrapatch.llm import toxicity

    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held = common.crc_mod("doc_id", 4) == 2
    field = toxicity.learned(docs, labels.where(~held))
    out = toxicity.tagged(docs, field)
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "n_spans")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrapatch.llm import suffixes

    return suffixes.removed(common.table(spark, sf_dir, "documents"))


def op7_sitetree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrapatch.llm import sitetree

    return sitetree.extracted(common.table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrapatch.llm import warc

    path = common.shared_path(spark, "archive")
    warc.archived(common.table(spark, sf_dir, "pages"), path)
    return warc.read_back(spark, path)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrapatch.llm import topk

    return topk.search(common.table(spark, sf_dir, "embeddings"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrapatch.llm import minhash

    return minhash.fingerprinted(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_bpe": op1_bpe, "op2_lm": op2_lm, "op3_packing": op3_packing, "op4_simhash": op4_simhash, "op5_toxicity": op5_toxicity, "op6_suffixes": op6_suffixes, "op7_sitetree": op7_sitetree, "op8_warc": op8_warc, "op9_topk": op9_topk, "op10_minhash": op10_minhash}
ORACLE: dict[str, str] = {
    "op8_warc": """
        WITH p AS (
            SELECT page_id, sha1(coalesce(html, '')) AS sha, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
        ), f AS (
            SELECT sha, payload_bytes, min(page_id) AS first FROM p GROUP BY sha, payload_bytes
        )
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(sha, CAST(i // 8 * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - i % 8 * 5 AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM p JOIN f USING (sha, payload_bytes)
    """,
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 10
    """,
}
