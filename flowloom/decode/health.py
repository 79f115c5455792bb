"""What datagrams say about the devices that send them: losses, pools, errors, layouts, refusals.

NetFlow 5 and 8 number records by engine, IPFIX records, NetFlow 9 and sFlow datagrams; each session is
followed in order of arrival. Rows are (exporter, version, odid, metric, value).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import unsigned
from ..operators.tracking import PacketLoss, RecordLoss, SamplePool, missed
from . import batch, fixed, sflow
from .templated import Limits

ROW = "exporter string, version string, odid long, metric string, value long"
SESSION = {"exporter": "string", "version": "string", "odid": "long"}
_READING = pa.schema([("exporter", pa.string()), ("version", pa.string()), ("odid", pa.int64()), ("arrival_seq", pa.int64()), ("place", pa.int64()), ("source", pa.int64()), ("number", pa.int64()), ("rate", pa.int64()), ("pool", pa.int64()), ("drops", pa.int64())])


def _rows(df: DataFrame, metric: str, value: str) -> DataFrame:
    return df.select("exporter", "version", "odid", F.lit(metric).alias("metric"), F.col(value).alias("value"))


def fixed_losses(datagrams: DataFrame) -> DataFrame:
    """Records that NetFlow 5 and 8 devices sent and that did not arrive."""
    kind = batch.version(F.col("payload"))
    df = datagrams.withColumn("version", kind).where("version in ('netflow_v5', 'netflow_v8')")
    number = lambda at, size: unsigned(F.col("payload"), at, size)
    head = F.when(F.col("version") == "netflow_v5", fixed.V5_HEADER).otherwise(fixed.V8_HEADER)
    odid = F.when(F.col("version") == "netflow_v8", number(22, 1)).otherwise(F.lit(0).cast("long"))
    rows = df.where(F.octet_length("payload") >= head).select(F.col("src_addr").alias("exporter"), "version", odid.alias("odid"), "arrival_seq", number(16, 4).alias("seq"), number(2, 2).alias("records"), number(20, 2).alias("engine"))
    return _rows(missed(rows, SESSION, "arrival_seq", ["seq", "records", "engine"], RecordLoss, datagrams), "sequence_missed", "missed")


def _readings(batches):
    """One row for each sampler in sFlow datagrams."""
    for b in batches:
        out = []
        for x in b.to_pylist():
            _, _, about = sflow.decode(bytes(x["payload"]))
            if about is not None:
                base = {"exporter": x["src_addr"], "version": "sflow_v5", "odid": about["odid"], "arrival_seq": x["arrival_seq"]}
                out += [base | dict(zip(("place", "source", "number", "rate", "pool", "drops"), (i, *s), strict=True)) for i, s in enumerate(about["samplers"])]
        yield pa.RecordBatch.from_pylist(out, schema=_READING)


def sflow_health(datagrams: DataFrame) -> DataFrame:
    """Lost datagrams of sFlow agents, and how their samplers' pools and drops grew."""
    df = datagrams.where(batch.version(F.col("payload")) == "sflow_v5").select("arrival_seq", "src_addr", "payload")
    said = df.mapInArrow(_readings, "exporter string, version string, odid long, arrival_seq long, place long, source long, number long, rate long, pool long, drops long")
    number = lambda at: unsigned(F.col("payload"), at, 4)
    family, head = number(4), F.when(number(4) == 1, 12).otherwise(24)  # words up to the agent's address, and that of 4 or 16 bytes
    heads = df.where(family.isin(1, 2) & (F.octet_length("payload") >= head + 16)).select(F.col("src_addr").alias("exporter"), F.lit("sflow_v5").alias("version"), number(head).alias("odid"), "arrival_seq", number(head + 4).alias("number"))
    lost = missed(heads, SESSION, "arrival_seq", ["number"], PacketLoss, datagrams)
    at = F.col("arrival_seq") * 65536
    pools = missed(said.withColumn("at", at + F.col("place")), SESSION | {"source": "long"}, "at", ["number", "rate", "pool", "drops"], SamplePool, datagrams.select(at.alias("at")))
    pools = pools.groupBy("exporter", "version", "odid").agg(F.sum("pool").alias("pool"), F.sum("drops").alias("drops"))
    return _rows(lost, "sequence_missed", "missed").unionByName(_rows(pools, "sample_pool", "pool")).unionByName(_rows(pools, "samples_dropped", "drops"))


def templated_health(datagrams: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """What the state of NetFlow 9 and IPFIX devices counts; `unread e:n` names an element that layouts announce and nothing reads."""
    df = datagrams.withColumn("kind", batch.version(F.col("payload"))).where(F.col("kind").isin("netflow_v9", "ipfix"))
    notes = batch.templated(df, limits, records=False).where("note is not null")
    return notes.select("exporter", "version", "odid", F.col("note").alias("metric"), F.col("amount").alias("value"))


def unresolved_fixed(datagrams: DataFrame) -> DataFrame:
    """NetFlow 5 records that name a sampler while their header has no rate: no device declares one for them."""
    flows, _ = fixed.netflow5(datagrams.where(batch.version(F.col("payload")) == "netflow_v5"))
    owed = (F.col("sampling_rate") == 0) & (F.coalesce("sampler_id", F.lit(0)) != 0)
    return _rows(flows.groupBy("exporter", "version", "odid").agg(F.count_if(owed).alias("n")), "sampling_unresolved", "n")


def of_datagrams(datagrams: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All of the above."""
    out = fixed_losses(datagrams).unionByName(sflow_health(datagrams))
    return out.unionByName(templated_health(datagrams, limits)).unionByName(unresolved_fixed(datagrams))
