"""Streaming: landed datagrams to flow records to published counters.

A collector process writes datagrams as parquet files; Structured Streaming reads them as they land.
NetFlow 9 and IPFIX keep their devices' announcements in keyed state, so layouts outlive a batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..decode import batch, fixed
from ..decode.templated import Device, Limits
from ..operators import publish
from ..operators.aggregate import BREAKDOWNS, breakdown
from ..schema import DATAGRAMS
from .totals import Totals


def datagrams(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(DATAGRAMS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def templated(rows: DataFrame, limits: Limits = Limits(), idle_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """Flow rows (and errors) of a stream of NetFlow 9 and IPFIX datagrams; a device's state goes after idle_ms without one."""
    import pandas as pd

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        device = pickle.loads(state.get[0]) if state.exists else Device(limits)
        rows = pd.concat(list(frames)).sort_values("arrival_seq")
        out = []
        for x in rows.itertuples():
            kind = {9: "netflow_v9", 10: "ipfix"}.get(int.from_bytes(x.payload[:2], "big"), "unknown")
            records, errors = device.decode(bytes(x.payload), int(x.src_port or 0), x.now)
            about = (x.arrival_seq, key[0], kind)
            out += [batch._row(*about, r, None) for r in records] + [batch._row(*about, None, e) for e in errors]
        state.update((pickle.dumps(device),))
        state.setTimeoutDuration(idle_ms)
        if out:
            yield pa.Table.from_pylist(out, schema=batch.TYPES).to_pandas(integer_object_nulls=True)

    seen = F.coalesce(F.unix_micros("recv_ts") / 1e6, F.lit(0.0)).alias("now")
    keyed = rows.select("src_addr", "arrival_seq", F.coalesce("src_port", F.lit(0)).alias("src_port"), "payload", seen)
    return keyed.groupBy("src_addr").applyInPandasWithState(step, batch.SCHEMA, "device binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def flows(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Flow rows of a stream of datagrams of any protocol."""
    df = rows.withColumn("kind", batch.version(F.col("payload")))
    out = templated(df.where(F.col("kind").isin("netflow_v9", "ipfix")).drop("kind"), limits).where("error is null").drop("error", "note", "amount")
    out = out.unionByName(df.where("kind = 'sflow_v5'").select("arrival_seq", "src_addr", "payload").mapInArrow(batch._sflow, batch.SCHEMA).where("error is null").drop("error", "note", "amount"))
    for read, kind in ((fixed.netflow5, "netflow_v5"), (fixed.netflow8, "netflow_v8")):
        f = read(df.where(F.col("kind") == kind))[0]
        fields = batch.HEAD | batch.KINDS
        out = out.unionByName(f.select(*[(F.col(n) if n in f.columns else F.lit(None)).cast(batch._DDL[t]).alias(n) for n, t in fields.items() if n not in ("error", "note", "amount")]))
    return out


def with_numbers(rows: DataFrame) -> DataFrame:
    """Decoded rows as the breakdowns take them: addresses of both families as bytes, counters of 64 unsigned bits."""
    whole = {c: F.col(c).cast("decimal(20,0)") for c in ("bytes", "packets", "flows")}
    return rows.withColumns({"src_ip": F.col("src_addr"), "dst_ip": F.col("dst_addr")} | whole)


def publisher(
    names: list[str], write: Callable[[DataFrame, int], None], enrich: Callable[[DataFrame], DataFrame] = lambda f: f, top_k: int = publish.TOP_K, min_bytes: int = 0,
    totals: Totals | None = None, failed: Callable[[str, Exception], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: one pass over the batch's flows feeds all breakdowns. `enrich` is called for each batch, so it may reload its tables.

    With `totals` the samples are running totals since the job began, without it those of the batch alone. A
    breakdown that fails is told to `failed` and loses its own samples only; without `failed` it stops the batch."""

    def put(rows: DataFrame, epoch: int) -> None:
        seen = rows if "recv_ts" in rows.columns else rows.withColumn("recv_ts", F.current_timestamp())
        held = enrich(with_numbers(seen)).persist()
        parts: list[DataFrame] = []
        try:
            for name in names:
                try:
                    entries = breakdown(held, name)
                    if totals is None:
                        kept = entries if name == "exporters" else publish.cut(entries, list(BREAKDOWNS[name].keys), top_k, min_bytes)
                        part = publish.samples(kept, name)
                    else:
                        part = publish.published(*totals.merge(name, entries, epoch), name, top_k, min_bytes)
                    part = part.persist()
                    part.count()
                    parts.append(part)
                except Exception as e:
                    if failed is None:
                        raise
                    failed(name, e)
            if parts:
                out = parts[0]
                for p in parts[1:]:
                    out = out.unionByName(p)
                write(out, epoch)
        finally:
            for p in [*parts, held]:
                p.unpersist()

    return put


def windowed_exporters(rows: DataFrame, window: str = "5 minutes", late: str = "10 minutes", at: str = "recv_ts") -> DataFrame:
    """An event-time form of the exporter breakdown, for sinks that append."""
    return rows.withWatermark(at, late).groupBy(F.window(at, window), "exporter", "version").agg(F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), F.sum("flows").alias("flows"))
