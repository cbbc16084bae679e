"""A training corpus from ``documents``: language, quality, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.llm.common import checkpointed, held_out, staged, table
from codefacts.llm.jaccard import near_copies
from codefacts.llm.langid import identified, profiles
from codefacts.llm.linededup import deduplicated
from codefacts.llm.packing import packed
from codefacts.llm.quality import fitted, scored

LANGUAGE_SCORE = 0.3  # below it a text resembles no language that was learned
QUALITY_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or unlike every language learned, go."""
    found = identified(docs, profiles(docs.where(~held_out("doc_id"))))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SCORE)).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score below the threshold go."""
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels"))).where(F.col("score") >= QUALITY_SCORE).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and with them documents of which nothing is left."""
    clean = deduplicated(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike("\\S")
    return clean.where(left).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard similarity of 0.8 or more, or at most 3 differing SimHash bits) one row stays: that of the least doc_id, then of the least MD5 of its text; rows without doc_id come last."""
    found = near_copies(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("row")
    kept = found.groupBy("component").agg(first).select(F.col("row.doc_id").alias("id"), F.col("row.text_hash").alias("hash"))
    many = found.groupBy("doc_id", "text_hash").count().toDF("of", "of_hash", "copies")
    kept = checkpointed(kept.join(many, F.col("id").eqNullSafe(F.col("of")) & F.col("hash").eqNullSafe(F.col("of_hash"))).select("id", "hash", "copies"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.md5("text").eqNullSafe(F.col("hash"))
    once = docs.join(kept.where("copies = 1"), same, "left_semi")
    often = docs.join(kept.where("copies > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(often).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    pieces = packed(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality),
    ("lines", lines),
    ("near", near),
    ("packing", packing),
]

#: BPE, the random field and the rank profiles are out of SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
