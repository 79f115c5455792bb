"""The registered queries: thin callers of the operators, and SQL where it can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, licenses, lm, minhash, pieces, quality, sharding, toxicity, vectors
from .common import crc_mod, table

#: the vocabulary that the registered queries use
PIECE_MODEL = os.environ.get("FLOWLOOM_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    out = lm.scored(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, at = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col(at)
    return out.select("doc_id", F.array_join(found["licenses"], ",").alias("licenses"), F.array_join(found["sentences"], ",").alias("sentences"), F.size(found["sentences"]).alias("n_sentences"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_bytes(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, number and hash of the ids, and whether they decode to the text (in which U+2581 reads as a space)."""
    out, at, same = pieces.encode(docs, PIECE_MODEL)
    return out.select("doc_id", F.size(at).cast("long").alias("n_tokens"), F.xxhash64(at).alias("ids_hash"), F.col(same).alias("round_trip"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    out, at = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", f"{at}.p_text", f"{at}.p_page", f"{at}.score", (F.col(f"{at}.score") >= quality.THRESHOLD).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", decontam.contaminated().alias("contaminated"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out, at = langid.identify(docs, docs.where(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), f"{at}.lang_pred", f"{at}.score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels"))
    out, at = toxicity.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), F.col(at).alias("score"), (F.col(at) >= toxicity.THRESHOLD).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_license_scan, op3_sentencepiece, op4_quality, op5_sharding, op6_embedding_dedup, op7_minhash, op8_decontamination, op9_language_id, op10_toxicity)}
ORACLE_SQL: dict[str, str] = {"op8_decontamination": decontam.ORACLE_SQL}
