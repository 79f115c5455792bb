"""Corpus cleaning in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

1. Language identification: documents go whose text has no letter or less than `LEAST_LANGUAGE` of
   whose 4-grams the best language knows.
2. Quality: documents go that the co-trained classifier holds unlikely to be good.
3. Near duplicates: one document of each class stays, the one with the least id; of rows that repeat
   this id, one.
4. Decontamination: documents go that hold benchmark passages to 1 in 20 of their words.
5. SentencePiece: what is left is encoded; one row for each document, with its ids.

Language and quality models are learnt from the documents that reach the stage. Every stage but the
last returns the columns that it got. `run` writes each stage's result as Parquet in the shared folder
and reads it again, so no stage runs twice for what the next ones read.

Defined results: null and empty texts have no language, so stage 1 drops them; a table without rows
gives none; null ids stay through stages 1, 2 and 4, and in 3 each row without id stays; null language,
source or length are values of their own for stage 2; without quality labels of both classes stage 2
keeps all or none, as the only class says; equal rows of one id are one row after stage 3; other columns,
whatever their names, are carried to the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import decontam, langid, minhash, pieces, quality
from flowloom.llm.common import table, written
from flowloom.llm.queries import PIECE_MODEL

LEAST_LANGUAGE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out, at = langid.identify(docs, docs)
    return out.where(langid.accepted(F.col(at), LEAST_LANGUAGE)).drop(at)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out, at = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.where(F.col(at)["score"] >= quality.THRESHOLD).drop(at)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out, at, same = pieces.encode(docs, PIECE_MODEL)
    return out.select("doc_id", "lang", "source", F.size(at).cast("long").alias("n_tokens"), F.col(at).alias("ids"), F.col(same).alias("round_trip"))


STAGES = [
    ("language ID", language),
    ("quality classifier", good_quality),
    ("MinHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece", tokens),
]

#: SQL cannot express the trained and sampling stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
