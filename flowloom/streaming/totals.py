"""Running totals of breakdowns over micro-batches, with entry bound, idle expiry and latches.

A breakdown's state is one table of at most its entry bound of rows. Every epoch reads the table of the
epoch before, adds the batch's grouped sums, and writes a table of its own; an epoch that is replayed
reads what it wrote, so no batch counts twice. Older tables are removed once two newer ones are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import total
from ..operators.aggregate import BREAKDOWNS, bounded

COUNTS = ("bytes", "packets", "flows")
TTL = "15 minutes"


class Totals:
    def __init__(self, spark: SparkSession, folder: str, max_entries: int = 100_000, ttl: str = TTL):
        self.spark, self.folder, self.most, self.ttl = spark, folder, max_entries, ttl

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _epochs(self, name: str) -> list[int]:
        """Epochs whose tables are whole."""
        path, fs = self._files(f"{self.folder}/{name}")
        if not fs.exists(path):
            return []
        found = [int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(path) if s.getPath().getName().startswith("epoch=")]
        return sorted(e for e in found if fs.exists(self._files(f"{self.folder}/{name}/epoch={e}/_SUCCESS")[0]))

    def merge(self, name: str, batch: DataFrame, epoch: int) -> tuple[DataFrame, DataFrame]:
        """(entries, the row `other`) after the batch's entries (keys and measures) are added."""
        keys = list(BREAKDOWNS[name].keys)
        path = f"{self.folder}/{name}/epoch={epoch}"
        whole = self._epochs(name)
        if epoch not in whole:
            before = self.spark.read.parquet(f"{self.folder}/{name}/epoch={max(e for e in whole if e < epoch)}") if any(e < epoch for e in whole) else None
            self._next(batch, before, keys).write.mode("overwrite").parquet(path)
            for old in [e for e in whole if e < epoch][:-1]:
                stale, fs = self._files(f"{self.folder}/{name}/epoch={old}")
                fs.delete(stale, True)
        state = self.spark.read.parquet(path)
        return state.where("not is_other").drop("is_other"), state.where("is_other").select(*COUNTS)

    def _next(self, batch: DataFrame, before: DataFrame | None, keys: list[str]) -> DataFrame:
        rows = batch.select(*keys, *[F.col(c).cast("decimal(20,0)").alias(c) for c in COUNTS], "bytes_measured", "packets_measured", "born", "last_seen")
        if before is not None:
            # entries without a record for longer than the time to live are gone, and not part of `other`
            live = before.where("not is_other").drop("is_other")
            if dict(live.dtypes)["last_seen"] == "timestamp":
                now = batch.agg(F.max("last_seen").alias("now"))
                live = live.where(F.coalesce(F.col("last_seen") >= now.scalar() - F.expr(f"INTERVAL {self.ttl}"), F.lit(True)))
            rows = live.unionByName(rows)
        sums = rows.groupBy(*keys).agg(
            *[total(F.col(c), F.lit(1)).alias(c) for c in COUNTS], F.bool_and("bytes_measured").alias("bytes_measured"), F.bool_and("packets_measured").alias("packets_measured"),
            F.min("born").alias("born"), F.max("last_seen").alias("last_seen"),
        )
        # held keys were born before new ones, so a full table keeps them
        entries, folded = bounded(sums, keys, self.most)
        if before is not None:
            folded = folded.unionByName(before.where("is_other").select(*COUNTS))
        other = folded.agg(*[F.coalesce(total(F.col(c), F.lit(1)), F.lit(0).cast("decimal(20,0)")).alias(c) for c in COUNTS])
        return entries.withColumn("is_other", F.lit(False)).unionByName(other.withColumn("is_other", F.lit(True)), allowMissingColumns=True)
