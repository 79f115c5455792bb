"""Health counters by exporter, as rows (metric, labels, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregate import BREAKDOWNS, bounded
from .publish import PREFIX


def _rows(df: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    names = F.create_map(*[x for c in labels for x in (F.lit(c), F.col(c).cast("string"))])
    return df.select(F.lit(f"{PREFIX}_{name}").alias("metric"), names.alias("labels"), F.col(value).cast("double").alias("value"))


def flows_by_version(flows: DataFrame) -> DataFrame:
    return flows.groupBy("exporter", "version").agg(F.count("*").alias("flows"))


def last_flow(flows: DataFrame, seen: str = "arrival_seq") -> DataFrame:
    return flows.groupBy("exporter").agg(F.max(seen).alias("last_flow"))


def last_datagram(datagrams: DataFrame) -> DataFrame:
    """When each device was last heard, decodable or not."""
    return datagrams.groupBy(F.col("src_addr").alias("exporter")).agg(F.max("recv_ts").alias("last_datagram"))


def errors_by_reason(errors: DataFrame) -> DataFrame:
    return errors.groupBy("exporter", "version", "reason").agg(F.count("*").alias("errors"))


def clock_inversions(records: DataFrame) -> DataFrame:
    """Records of a domain whose end is before their start."""
    return records.groupBy("exporter", "odid").agg(F.count_if(F.col("end_us") < F.col("start_us")).alias("inversions"), F.count_if(F.col("end_us").isNotNull()).alias("clocked"))


def zero_flow_aggregates(flows: DataFrame) -> DataFrame:
    return flows.where("flows_reported").groupBy("exporter", "odid").agg(F.count_if(F.col("flows") == 0).alias("zero"), F.count("*").alias("aggregates"))


def sampling_in_force(flows: DataFrame) -> DataFrame:
    return flows.groupBy("exporter", "odid").agg(F.max("sampling_rate").alias("rate"), F.bool_or(F.col("sampling_rate") > 1).alias("sampled"))


def received(datagrams: DataFrame, most: int = 9216) -> DataFrame:
    """Packets, bytes and drops of each listener, drops included in the counts."""
    return datagrams.groupBy("listener").agg(F.count("*").alias("packets"), F.sum(F.octet_length("payload")).alias("bytes"), F.count_if(F.octet_length("payload") > most).alias("truncated"))


def table_health(entries: DataFrame, name: str, most: int) -> DataFrame:
    """Entries that a breakdown of at most `most` keys holds, and the keys and flows that fold into `other`."""
    admitted, _ = bounded(entries, list(BREAKDOWNS[name].keys), most)
    whole = entries.agg(F.count("*").alias("keys"), F.sum("flows").alias("flows"))
    held = admitted.agg(F.count("*").alias("entries"), F.coalesce(F.sum("flows"), F.lit(0)).alias("held"))
    return whole.join(held).select(F.lit(name).alias("aggregation"), "entries", (F.col("keys") - F.col("entries")).alias("folded_keys"), (F.coalesce("flows", F.lit(0)) - F.col("held")).cast("long").alias("folded_flows"))  # one row each


def metrics(flows: DataFrame, errors: DataFrame | None = None, devices: DataFrame | None = None) -> DataFrame:
    """The long table of the gauges and counters above, of decoding errors, and of what devices' datagrams say (`decode.health`)."""
    out = _rows(flows_by_version(flows), "flows_total", ["exporter", "version"], "flows")
    out = out.unionByName(_rows(last_flow(flows), "last_flow", ["exporter"], "last_flow"))
    if devices is None:  # a device's own count is taken where it is known: decoded records have no clocks that run backwards
        out = out.unionByName(_rows(clock_inversions(flows).where("clocked > 0"), "clock_inversions_total", ["exporter", "odid"], "inversions"))
    out = out.unionByName(_rows(zero_flow_aggregates(flows), "aggregate_zero_flows_total", ["exporter", "odid"], "zero"))
    out = out.unionByName(_rows(sampling_in_force(flows).where("sampled"), "sampling_rate", ["exporter", "odid"], "rate"))
    if errors is not None:
        out = out.unionByName(_rows(errors_by_reason(errors), "decode_errors_total", ["exporter", "version", "reason"], "errors"))
    if devices is not None:
        known = devices.where("odid is not null and metric not like 'unread%'")
        labels = F.create_map(*[x for c in ("exporter", "version", "odid") for x in (F.lit(c), F.col(c).cast("string"))])
        out = out.unionByName(known.select(F.concat(F.lit(f"{PREFIX}_"), "metric", F.when(F.col("metric") == "templates", "").otherwise("_total")).alias("metric"), labels.alias("labels"), F.col("value").cast("double").alias("value")))
        refused = devices.where("odid is null and metric like '%refused'").groupBy("exporter", "metric").agg(F.sum("value").alias("value"))
        out = out.unionByName(refused.select(F.concat(F.lit(f"{PREFIX}_"), "metric", F.lit("_total")).alias("metric"), F.create_map(F.lit("exporter"), F.col("exporter")).alias("labels"), F.col("value").cast("double").alias("value")))
    return out
