"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def _shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made up for a local session alone, where they are one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the shared folder that the session names."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: later readers prune its columns and nothing before it runs twice."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_pair(*columns: Column) -> tuple[Column, Column]:
    """Two hashes of 64 bits that together name a value. The literal stands first, so that it seeds the second; behind, that would be a function of the first."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns)


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has no more than so many rows (of fixed width, as the caller sees to); joined by shuffle else."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let Python get rows in batches of few bytes. A limit of rows alone would let long texts make batches of any size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("b"))
    if now <= 0 or now > most:
        spark.conf.set(key, most)


def fresh(df: DataFrame, name: str) -> str:
    """A column name made from `name` that df does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sample_bounded(df: DataFrame, key: Column, limit: int, seed: int) -> DataFrame:
    """About `limit` rows, at most that many, picked by a hash of the key: the same for the same rows."""
    total = df.count()
    if total <= limit:
        return df
    share = min(1.0, limit * 0.97 / total)
    picked = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
    return df.where(picked).limit(limit)
