"""The eleven traffic breakdowns: grouped sums with an admission filter each.

Every breakdown is one grouped aggregation: Catalyst combines before the shuffle, so a shuffle moves
one row for each key and task. Filters stand before any lookup join and reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.fixed import SERVICES, TCP
from ..functions.records import is_aggregated, total

MEASURES = ["bytes", "packets", "flows", "bytes_measured", "packets_measured", "born", "last_seen"]


def measures(df: DataFrame) -> list[Column]:
    """Corrected bytes and packets, flows, all of which stop at their type's greatest value; whether every record had the count; first and last arrival."""
    seen = F.col("recv_ts") if "recv_ts" in df.columns else F.col("arrival_seq")
    size = lambda c, rate: total(F.col(c), rate, df.schema[c].dataType.simpleString())
    rate = F.col("sampling_rate")
    return [
        size("bytes", rate).alias("bytes"), size("packets", rate).alias("packets"), size("flows", F.lit(1)).alias("flows"),
        F.bool_and(F.col("bytes").isNotNull()).alias("bytes_measured"), F.bool_and(F.col("packets").isNotNull()).alias("packets_measured"),
        F.min("arrival_seq").alias("born"), F.max(seen).alias("last_seen"),
    ]


@dataclass(frozen=True)
class Breakdown:
    """A breakdown: its keys (name -> column), which records it admits, and its published name and labels."""

    name: str
    family: str
    keys: dict[str, Callable[[], Column]]
    admit: Callable[[], Column]
    labels: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    takes_aggregated: bool = False
    needs_ports: bool = False


def _c(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


def _keys(*names: str, **derived: Callable[[], Column]) -> dict[str, Callable[[], Column]]:
    return {n: _c(n) for n in names} | derived


def _both(a: str, b: str) -> Callable[[], Column]:
    return lambda: F.col(a).isNotNull() & F.col(b).isNotNull()


#: labels that depend on the column's type
ADDRESSES = ("src_ip", "dst_ip", "address")
_ADDRESS: dict = {}

BREAKDOWNS = {
    b.name: b
    for b in (
        Breakdown("exporters", "exporter", _keys("exporter", "version", "odid", "direction"), lambda: F.lit(True), takes_aggregated=True),
        Breakdown("hosts", "host_pair", _keys("exporter", "src_ip", "dst_ip", "input_if", "output_if", "direction"), _both("src_ip", "dst_ip"), _ADDRESS),
        Breakdown(
            "services", "service", _keys("exporter", "src_ip", "dst_ip", "protocol", "port", "endpoint", "input_if", "output_if", "direction"),
            lambda: F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull() & (F.col("protocol") != 0), _ADDRESS | {"protocol": labels.protocol}, needs_ports=True,
        ),
        Breakdown(
            "destinations", "destination", _keys("exporter", "dst_ip", "protocol", "port", "endpoint", "direction"),
            lambda: F.col("dst_ip").isNotNull() & (F.col("protocol") != 0), _ADDRESS | {"protocol": labels.protocol}, needs_ports=True,
        ),
        Breakdown("tcp_flags", "tcp_flags", _keys("exporter", "tcp_flags", "direction"), lambda: (F.col("protocol") == TCP) & F.col("tcp_flags").isNotNull(), {"tcp_flags": labels.tcp_flags}),
        Breakdown("dscp", "dscp", _keys("exporter", "direction", dscp=lambda: labels.dscp_of(F.col("tos"))), lambda: F.col("tos").isNotNull(), {"dscp": labels.dscp}),
        Breakdown("asns", "asn_pair", _keys("exporter", "src_as", "dst_as", "direction"), lambda: (F.col("src_as") != 0) | (F.col("dst_as") != 0)),
        Breakdown(
            "applications", "application", _keys("exporter", "direction", application=lambda: labels.application(F.col("app_name"), F.col("app_id"))),
            lambda: labels.application(F.col("app_name"), F.col("app_id")).isNotNull(),
        ),
        Breakdown(
            "countries", "country_pair", _keys("exporter", "src_country", "dst_country", "direction"), lambda: F.col("src_country").isNotNull() | F.col("dst_country").isNotNull(),
            {"src_country": labels.country, "dst_country": labels.country},
        ),
        Breakdown("threats", "threat", _keys("exporter", "address", "endpoint", "input_if", "output_if", "direction"), lambda: F.col("address").isNotNull(), _ADDRESS),
        Breakdown("vlans", "vlan_pair", _keys("exporter", "src_vlan", "dst_vlan", "direction"), lambda: (F.col("src_vlan") != 0) | (F.col("dst_vlan") != 0)),
    )
}


def with_service_port(flows: DataFrame, extra: list[tuple[int, int, str]] = ()) -> DataFrame:
    """The port that names the service and its side: the destination's if it is a known service, else the source's if that is, else the destination's."""
    known = sorted({(p, port) for p, port, _ in [*SERVICES, *extra]})
    is_service = lambda port: F.lit(False) if not known else (F.col("protocol") * 65536 + F.col(port)).isin([p * 65536 + n for p, n in known])
    from_src = ~is_service("dst_port") & is_service("src_port")
    return flows.withColumns({"port": F.when(from_src, F.col("src_port")).otherwise(F.col("dst_port")), "endpoint": F.when(from_src, F.lit("src")).otherwise(F.lit("dst"))})


def with_flagged_sides(flows: DataFrame) -> DataFrame:
    """One row for each flagged side of a record."""
    side = lambda flag, ip, name: F.when(F.col(flag), F.struct(F.col(ip).alias("address"), F.lit(name).alias("endpoint")))
    sides = F.array_compact(F.array(side("src_flagged", "src_ip", "src"), side("dst_flagged", "dst_ip", "dst")))
    return flows.withColumn("side", F.explode(sides)).withColumns({"address": F.col("side.address"), "endpoint": F.col("side.endpoint")}).drop("side")


def breakdown(flows: DataFrame, name: str, mapped: list[tuple[int, int, str]] = (), by: dict[str, Column] | None = None) -> DataFrame:
    """One breakdown's keys and measures; `by` adds keys, such as the window of a record."""
    b = BREAKDOWNS[name]
    if not b.takes_aggregated:
        flows = flows.where(~is_aggregated(F.col("version"), F.col("flows_reported")))
    if b.needs_ports:
        flows = with_service_port(flows, mapped)
    if name == "threats":
        flows = with_flagged_sides(flows)
    return flows.where(b.admit()).groupBy(*[k().alias(n) for n, k in b.keys.items()], *[c.alias(n) for n, c in (by or {}).items()]).agg(*measures(flows))


def bounded(entries: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """(admitted entries, one row `other` of the rest): a key is admitted if fewer than `most` keys were born before it.

    The bound is the `most`-th key in order of birth, found by a top-k; no row is ranked."""
    order = F.struct("born", *keys)
    last = entries.select(order.alias("o")).orderBy("o").limit(most).agg(F.max("o").alias("o"), F.count("*").alias("n"))
    edge = last.select(F.when(F.col("n") >= most, F.col("o")).alias("edge"))
    marked = entries.withColumn("fold", F.coalesce(order > edge.scalar(), F.lit(False)))
    other = marked.agg(*[F.coalesce(total(F.when(F.col("fold"), F.col(c)), F.lit(1), marked.schema[c].dataType.simpleString()), F.lit(0)).alias(c) for c in ("bytes", "packets", "flows")])
    return marked.where(~F.col("fold")).drop("fold"), other


def idle_sessions(flows: DataFrame, keys: list[str], at: str, ttl_us: int) -> DataFrame:
    """Entries with idle expiry: a key that pauses for more than the TTL starts anew from zero."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy(at)
    begun = flows.withColumn("begun", F.when(F.col(at) - F.lag(at).over(w) <= ttl_us, 0).otherwise(1))
    return begun.withColumn("session", F.sum("begun").over(w)).drop("begun")
