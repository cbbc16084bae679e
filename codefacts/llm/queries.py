"""The thin queries opN_<name>: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.llm import linededup
from codefacts.llm.common import held_out, table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codefacts.llm.quality import fitted, scored

    docs = table(spark, sf_dir, "documents")
    got = scored(docs.select("doc_id", "text"), fitted(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codefacts.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codefacts.llm.embdedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codefacts.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codefacts.llm.packing import packed

    pieces = packed(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codefacts.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), digests=True)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codefacts.llm.langid import identified, profiles

    docs = table(spark, sf_dir, "documents")
    got = identified(docs.select("doc_id", "text"), profiles(docs.where(~held_out("doc_id"))))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codefacts.llm.linededup import deduplicated

    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.md5("text").alias("clean_md5"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codefacts.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codefacts.llm.records import token_records

    read = token_records(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_embeddings": op3_embeddings,
    "op4_archives": op4_archives,
    "op5_packing": op5_packing,
    "op6_bpe": op6_bpe,
    "op7_language": op7_language,
    "op8_lines": op8_lines,
    "op9_nearest": op9_nearest,
    "op10_records": op10_records,
}

#: op4 needs no archive to be checked: what the archives must say is a matter of the pages.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
q AS (SELECT page_id, n, sha1(body) AS digest, max(page_id) OVER (PARTITION BY body) AS kept FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND kept <> page_id THEN kept END AS refers_to
FROM q
"""

ORACLE_SQL: dict[str, str] = {"op4_archives": OP4_SQL, "op8_lines": linededup.oracle()}
