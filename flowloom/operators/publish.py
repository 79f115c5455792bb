"""What is published of a breakdown: the Top-K cut, the rest, info rows and the listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import addresses
from .aggregate import ADDRESSES, BREAKDOWNS

PREFIX = "flowloom"
TOP_K = 1000


def ordered(entries: DataFrame, keys: list[str]) -> list:
    """Most bytes first, then the oldest; keys make the order total."""
    return [F.desc("bytes"), F.asc("born"), *[F.asc(k) for k in keys]]


def cut(entries: DataFrame, keys: list[str], top_k: int = TOP_K, min_bytes: int = 0) -> DataFrame:
    """The Top-K entries of at least min_bytes. Planned as one top-k over sorted partitions, not a global sort."""
    kept = entries.where(F.col("bytes") >= min_bytes) if min_bytes else entries
    return kept.orderBy(*ordered(entries, keys)).limit(top_k)


def labelled(entries: DataFrame, name: str) -> DataFrame:
    """Keys rendered as label text. Entries with a label that is not UTF-8 are left out."""
    b = BREAKDOWNS[name]
    kind = lambda k: entries.schema[k].dataType.simpleString()
    label = lambda k: addresses.text(F.col(k), kind(k)) if k in ADDRESSES and kind(k) in ("binary", "bigint") else b.labels[k](F.col(k)) if k in b.labels else F.col(k).cast("string")
    shown = entries.withColumns({k: label(k) for k in b.keys})
    return shown.where(" and ".join(f"is_valid_utf8({k})" for k in b.keys))


def families(name: str) -> list[str]:
    """The metrics of a breakdown, whether or not any of their samples are published."""
    return [f"{PREFIX}_{BREAKDOWNS[name].family}_{m}_total" for m in ("bytes", "packets", "flows")]


def samples(entries: DataFrame, name: str) -> DataFrame:
    """Long form: metric, labels, value. Bytes and packets are withheld where some record lacked the count; flows never."""
    b = BREAKDOWNS[name]
    keys = list(b.keys)
    shown = labelled(entries, name)
    names = F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k))])
    value = lambda c: F.col(c).cast("double")
    rows = F.array(
        F.struct(F.lit(f"{PREFIX}_{b.family}_bytes_total").alias("metric"), F.when(F.col("bytes_measured"), value("bytes")).alias("value")),
        F.struct(F.lit(f"{PREFIX}_{b.family}_packets_total").alias("metric"), F.when(F.col("packets_measured"), value("packets")).alias("value")),
        F.struct(F.lit(f"{PREFIX}_{b.family}_flows_total").alias("metric"), value("flows").alias("value")),
    )
    return shown.select(names.alias("labels"), F.inline(rows)).where("value is not null").select("metric", "labels", "value")


def other_row(other: DataFrame, name: str) -> DataFrame:
    """The row of folded records, always published: every label is `other`."""
    full = {k: F.lit("other") for k in BREAKDOWNS[name].keys} | {"bytes_measured": F.lit(True), "packets_measured": F.lit(True)}
    return other.withColumns(full)


def published(admitted: DataFrame, other: DataFrame, name: str, top_k: int = TOP_K, min_bytes: int = 0) -> DataFrame:
    """All samples of a breakdown. Exporters are not cut."""
    keys = list(BREAKDOWNS[name].keys)
    kept = admitted if name == "exporters" else cut(admitted, keys, top_k, min_bytes)
    b = BREAKDOWNS[name]
    rest = other_row(other, name)
    names = F.create_map(*[x for k in keys for x in (F.lit(k), F.lit("other"))])
    rows = rest.select(names.alias("labels"), F.inline(F.array(*[F.struct(F.lit(f"{PREFIX}_{b.family}_{m}_total").alias("metric"), F.col(m).cast("double").alias("value")) for m in ("bytes", "packets", "flows")])))
    return samples(kept, name).unionByName(rows.select("metric", "labels", "value"))


def listing(admitted: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Every entry with its rank, the withheld tail included; the first `most` ranks alone if given.

    A table has at most its entry bound of rows, and ranks come from running counts of sorted ranges, so no task ranks them all."""
    keys = list(BREAKDOWNS[name].keys)
    order = ordered(admitted, keys)
    if most is not None:
        shown = admitted.orderBy(*order).limit(most)
        ranked = shown.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    else:
        spread = admitted.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
        spread = spread.checkpoint() if spread.sparkSession.sparkContext.getCheckpointDir() else spread.persist()  # a row's partition is part of its rank
        sizes = spread.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
        before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
        ranked = spread.join(F.broadcast(before.select("part", "first", "before")), "part").withColumn("rank", F.col("place") - F.col("first") + F.col("before") + 1)
    return labelled(ranked, name).select("rank", *keys, "bytes", "packets", "flows", "bytes_measured", "packets_measured")


def report(admitted: DataFrame, other: DataFrame, name: str, top_k: int = TOP_K, min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(one row about a table: entries, published, withheld and its totals, other, label names; all its ranked rows). Exporters are never cut."""
    keys = list(BREAKDOWNS[name].keys)
    cut_at = (1 << 31) - 1 if name == "exporters" else top_k
    about = withheld(admitted, name, cut_at, 0 if name == "exporters" else min_bytes)
    rest = other.select(F.struct("bytes", "packets", "flows").alias("other"))
    about = about.withColumns({"aggregation": F.lit(name), "entries": F.col("published") + F.col("withheld"), "other": rest.scalar(), "label_names": F.array(*map(F.lit, keys))})
    return about, listing(admitted, name)


def withheld(admitted: DataFrame, name: str, top_k: int = TOP_K, min_bytes: int = 0) -> DataFrame:
    """Numbers of published and withheld entries, and the withheld totals (measured only if all are)."""
    keys = list(BREAKDOWNS[name].keys)
    shown = cut(admitted, keys, top_k, min_bytes).agg(
        F.count("*").alias("published"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"p_{c}") for c in ("bytes", "packets", "flows")],
        *[F.count_if(~F.col(c)).alias(f"p_{c}") for c in ("bytes_measured", "packets_measured")],
    )
    total = admitted.agg(
        F.count("*").alias("entries"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes", "packets", "flows")],
        *[F.count_if(~F.col(c)).alias(c) for c in ("bytes_measured", "packets_measured")],
    )
    one = total.withColumn("p", shown.select(F.struct("*").alias("p")).scalar())
    return one.select(
        F.col("p.published").alias("published"), (F.col("entries") - F.col("p.published")).alias("withheld"),
        *[(F.col(c) - F.col(f"p.p_{c}")).alias(f"withheld_{c}") for c in ("bytes", "packets", "flows")],
        *[(F.col(c) == F.col(f"p.p_{c}")).alias(f"withheld_{c}") for c in ("bytes_measured", "packets_measured")],
    )


def _info(rows: DataFrame, family: str, labels: dict[str, str]) -> DataFrame:
    """Samples of an info family: value 1, labels from columns."""
    names = F.create_map(*[x for label, c in labels.items() for x in (F.lit(label), F.col(c).cast("string"))])
    return rows.select(F.lit(f"{PREFIX}_{family}_info").alias("metric"), names.alias("labels"), F.lit(1.0).alias("value"))


def interface_info(cuts: list[DataFrame], interfaces: DataFrame) -> DataFrame:
    """(exporter, if_index, name) of named interfaces that the published cuts show."""
    seen = None
    for c in cuts:
        pair = c.select("exporter", F.explode(F.array("input_if", "output_if")).alias("if_index")).where("if_index <> 0").distinct()
        seen = pair if seen is None else seen.unionByName(pair)
    return seen.distinct().join(F.broadcast(interfaces), ["exporter", "if_index"])


def asn_info(published_asns: DataFrame, named: DataFrame) -> DataFrame:
    """(asn, organization) of published numbers that a lookup has named."""
    seen = published_asns.select(F.explode(F.array("src_as", "dst_as")).alias("asn")).where("asn <> 0").distinct()
    return seen.join(named, "asn")


def info_families(dims: dict[str, DataFrame], cuts: list[DataFrame] = (), asns: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Samples of device, VLAN, interface and AS info. Devices and VLANs are listed whole; interfaces and numbers as far as the published cuts show them."""
    parts = []
    if "devices" in dims:
        parts.append(_info(dims["devices"], "device", {"exporter": "exporter", "hostname": "hostname"}))
    if "vlans" in dims:
        parts.append(_info(dims["vlans"].where("name is not null"), "vlan", {"exporter": "exporter", "vlan": "vlan_id", "name": "name"}))
    if "interfaces" in dims and cuts:
        parts.append(_info(interface_info(list(cuts), dims["interfaces"]), "interface", {"exporter": "exporter", "ifindex": "if_index", "name": "name"}))
    if asns is not None:
        parts.append(_info(asn_info(*asns), "asn", {"asn": "asn", "organization": "organization"}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
