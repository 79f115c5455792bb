"""Lookup joins that fill what devices leave out. A device's own reading is never overwritten.

Dimension tables are small configuration files; each is broadcast if it has at most `BROADCAST_ROWS`
rows and joined by shuffle beyond. Longest-prefix matches are one equi-join for each family and prefix
length that occurs, longest first; addresses are bytes of either family, or IPv4 numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import addresses
from ..functions.fixed import SERVICES
from ..functions.records import is_aggregated

BROADCAST_ROWS = 1_000_000


def small(dim: DataFrame) -> DataFrame:
    return F.broadcast(dim) if dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dim


def plain() -> Column:
    """Records that are looked up at all: not the aggregated ones."""
    return ~is_aggregated(F.col("version"), F.col("flows_reported"))


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def with_halves(prefixes: DataFrame) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """A prefix table with its networks as family and halves, and how many prefixes it has of each family and length. One job a table, however many columns it fills."""
    family, upper, lower = addresses.halves(F.col("network"), _kind(prefixes, "network"))
    out = prefixes.withColumns({"_family": family, "_upper": upper, "_lower": lower}).where("_family is not null")
    found = out.groupBy("_family", "length").count().collect()  # at most 33 + 129 rows
    return out, sorted(((r["_family"], r["length"], r["count"]) for r in found), reverse=True)


def longest_prefix(flows: DataFrame, prefixes: DataFrame, address: str, out: dict[str, str], by: list[str] = (), table: tuple | None = None) -> DataFrame:
    """flows with the columns `out` (prefix column -> new name) of the longest prefix that holds the address; NULL without one.

    prefixes: `by`, network, length and the columns of `out`; (by, network, length) is unique. Networks and
    addresses are bytes of either family or IPv4 numbers. `table` is what `with_halves` gives."""
    rows, sizes = table or with_halves(prefixes)
    family, upper, lower = addresses.halves(F.col(address), _kind(flows, address))
    flows = flows.withColumns({"_of": family, "_up": upper, "_low": lower})
    found: list[Column] = []
    hits = []
    for kind, n, count in sizes:
        high, low = addresses.masks(kind, n)
        hit = f"_hit_{kind}_{n}"
        dim = rows.where((F.col("_family") == kind) & (F.col("length") == n)).select(*[F.col(b).alias(f"_by_{b}") for b in by], "_upper", "_lower", F.struct(*[F.col(c).alias(o) for c, o in out.items()]).alias(hit))
        on = F.when(F.col("_of") == kind, F.col("_up").bitwiseAND(F.lit(high))) == F.col("_upper")
        if kind == 6 and n > 64:
            on = on & (F.col("_low").bitwiseAND(F.lit(low)) == F.col("_lower"))
        for b in by:
            on = on & (F.col(b) == F.col(f"_by_{b}"))
        flows = flows.join(F.broadcast(dim) if count <= BROADCAST_ROWS else dim, on, "left").drop("_upper", "_lower", *[f"_by_{b}" for b in by])
        found.append(F.col(hit))
        hits.append(hit)
    best = F.coalesce(*found) if found else None
    flows = flows.withColumns({o: best[o] if best is not None else F.lit(None).cast(prefixes.schema[c].dataType) for c, o in out.items()})
    return flows.drop(*hits, "_of", "_up", "_low")


def fill_vlans(flows: DataFrame, prefixes: DataFrame) -> DataFrame:
    table = with_halves(prefixes)
    for side in ("src", "dst"):
        flows = longest_prefix(flows, prefixes, f"{side}_ip", {"vlan_id": f"_{side}_vlan"}, ["exporter"], table)
        own = F.col(f"{side}_vlan") if f"{side}_vlan" in flows.columns else F.lit(0).cast("long")
        flows = flows.withColumn(f"{side}_vlan", F.when((own == 0) & plain(), F.coalesce(F.col(f"_{side}_vlan"), F.lit(0))).otherwise(own).cast("long")).drop(f"_{side}_vlan")
    return flows


def fill_asns(flows: DataFrame, asns: DataFrame) -> DataFrame:
    """AS numbers where the device gave none; `src_as_filled` and `dst_as_filled` say which."""
    table = with_halves(asns)
    for side in ("src", "dst"):
        flows = longest_prefix(flows, asns, f"{side}_ip", {"asn": f"_{side}_asn"}, table=table)
        use = (F.col(f"{side}_as") == 0) & plain() & (F.coalesce(F.col(f"_{side}_asn"), F.lit(0)) != 0)
        flows = flows.withColumns({f"{side}_as_filled": use, f"{side}_as": F.when(use, F.col(f"_{side}_asn")).otherwise(F.col(f"{side}_as"))}).drop(f"_{side}_asn")
    return flows


def filled_asn_names(flows: DataFrame, asns: DataFrame) -> DataFrame:
    """(asn, organization): names of the numbers that lookups resolved; empty names never count."""
    resolved = flows.select(F.explode(F.array_compact(F.array(*[F.when(F.col(f"{s}_as_filled"), F.col(f"{s}_as")) for s in ("src", "dst")]))).alias("asn")).distinct()
    names = asns.where("organization is not null and organization <> ''").groupBy("asn").agg(F.min("organization").alias("organization"))
    return resolved.join(small(names), "asn")


def fill_countries(flows: DataFrame, countries: DataFrame) -> DataFrame:
    table = with_halves(countries)
    for side in ("src", "dst"):
        flows = longest_prefix(flows, countries, f"{side}_ip", {"code": f"_{side}_code"}, table=table)
        code = F.when(addresses.is_private(F.col(f"{side}_ip"), _kind(flows, f"{side}_ip")), F.lit("private")).otherwise(F.nullif(F.col(f"_{side}_code"), F.lit("")))
        flows = flows.withColumn(f"{side}_country", F.when(plain(), code)).drop(f"_{side}_code")
    return flows


def flag_threats(flows: DataFrame, threats: DataFrame) -> DataFrame:
    """Sides whose address is listed. The list has addresses as the flows have them, bytes or IPv4 numbers."""
    listed = small(threats.select(F.col("address").alias("_listed")).distinct())
    for side in ("src", "dst"):
        flows = flows.join(listed, F.col(f"{side}_ip") == F.col("_listed"), "left").withColumn(f"{side}_flagged", F.col("_listed").isNotNull() & plain()).drop("_listed")
    return flows


def name_services(flows: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """Application names from service ports, configured ones first; only where the device gave neither name nor id."""
    spark = flows.sparkSession
    built_in = spark.createDataFrame(SERVICES, "protocol long, port long, name string")
    for dim in ([mapped] if mapped is not None else []) + [built_in]:
        bare = F.coalesce(F.nullif(F.col("app_name"), F.lit("")), F.lit("")) == ""
        for side in ("dst", "src"):
            d = small(dim.select(F.col("protocol").alias("_p"), F.col("port").alias("_port"), F.col("name").alias(f"_{side}_name")))
            flows = flows.join(d, (F.col("protocol") == F.col("_p")) & (F.col(f"{side}_port") == F.col("_port")), "left").drop("_p", "_port")
        use = bare & (F.col("app_id") == 0) & plain()
        flows = flows.withColumn("app_name", F.when(use, F.coalesce("_dst_name", "_src_name")).otherwise(F.col("app_name"))).drop("_dst_name", "_src_name")
    return flows


def outcomes(flows: DataFrame, was: list[str], now: list[str]) -> DataFrame:
    """Numbers of records in which a lookup filled something, found nothing, or was not asked, because the device said all (or the record is an aggregate). 0 and empty are nothing said."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0") == False  # noqa: E712, E731
    whole, filled = F.lit(True), F.lit(False)
    for a, b in zip(was, now, strict=True):
        whole, filled = whole & said(a), filled | (~said(a) & said(b))
    state = F.when(~plain() | whole, "skipped").when(filled, "filled").otherwise("unknown")
    return flows.groupBy(state.alias("result")).agg(F.count("*").alias("records"))
