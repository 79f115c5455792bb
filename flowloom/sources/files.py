"""Lookup files: address lists, name mappings, prefix tables; and parquet replay of datagrams."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import SERVICES, TCP, UDP
from ..schema import DATAGRAMS

LINE_BYTES = 256
NAME_BYTES = 255
IF_MAX, VLAN_MAX, PORT_MAX = 0x7FFFFFFF, 4094, 65535

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
IPV6 = r"^(?=.*:)[0-9A-Fa-f:.]{2,45}$"


def datagrams(spark: SparkSession, path: str) -> DataFrame:
    """Datagrams that a collector has landed as parquet."""
    return spark.read.schema(DATAGRAMS).parquet(path)


def accepted(rows: DataFrame, most: int = 9216) -> DataFrame:
    """Datagrams that were not cut off by the receive buffer."""
    return rows.where(F.octet_length("payload") <= most)


def _first_field(line: Column) -> Column:
    return F.regexp_extract(F.trim(line), r"^([^\s,;]+)", 1)


def _unmapped(a: Column) -> Column:
    """Without a zone; an IPv4 address mapped into IPv6 as the IPv4 one."""
    bare = F.regexp_replace(a, "%.*$", "")
    return F.regexp_replace(F.lower(bare), r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", "$1")


def threat_list(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(distinct addresses as text, number of skipped lines) of files with one address a line.

    Comments (# or ;) and blank lines are no lines; a line whose first field is no address, a network
    included, is skipped and counted; a line of 256 bytes or more fails the load."""
    lines = spark.read.text(list(paths)).select(F.col("value").alias("line"))
    checked = lines.withColumn("line", F.when(F.octet_length("line") >= LINE_BYTES, F.raise_error(F.lit("a line of an address list is too long"))).otherwise(F.col("line")))
    rows = checked.where(F.trim("line") != "").where(~F.trim("line").rlike("^[#;]")).select(_unmapped(_first_field(F.col("line"))).alias("address"))
    is_address = F.col("address").rlike(IPV4) | F.col("address").rlike(IPV6)
    return rows.where(is_address).distinct(), rows.where(~is_address).agg(F.count("*").alias("skipped"))


def as_bytes(address: Column) -> Column:
    """Text of an address of either family as 4 or 16 bytes; NULL for others. For lookup files, which are small."""

    @F.arrow_udf("binary")
    def packed(column: pa.Array) -> pa.Array:
        out = []
        for x in column.to_pylist():
            try:
                a = ipaddress.ip_address(x or "")
                out.append((getattr(a, "ipv4_mapped", None) or a).packed)
            except ValueError:
                out.append(None)
        return pa.array(out, pa.binary())

    return packed(address)


def as_number(address: Column) -> Column:
    """Dotted IPv4 text as a number; NULL for others."""
    parts = F.split(address, r"\.")
    value = sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("long") * (256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(address.rlike(IPV4), value)


def merged_list(lists: list[DataFrame], previous: DataFrame | None = None, floor: int = 1000) -> DataFrame:
    """The union of address lists; the previous list if the union has fewer than `floor` addresses."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    out = out.distinct()
    return previous if previous is not None and out.limit(floor).count() < floor else out


def tagged_csv_addresses(spark: SparkSession, path: str) -> DataFrame:
    """Values of the rows of type `ip` in a CSV of date, user, type, value, tags, link."""
    rows = spark.read.schema("date string, user string, type string, value string, tags string, link string").csv(path)
    return rows.where(F.lower("type") == "ip").select(_unmapped(F.trim("value")).alias("address")).where(F.col("address").rlike(IPV4) | F.col("address").rlike(IPV6)).distinct()


def prefix_table(spark: SparkSession, path: str, value: str, kind: str = "string") -> DataFrame:
    """network (bytes), length and a value from a CSV of prefix, value, of either family. Zero and empty values are no answer."""
    rows = spark.read.schema(f"prefix string, `{value}` {kind}").csv(path)
    parts = F.split("prefix", "/")
    out = rows.select(as_bytes(parts[0]).alias("network"), parts[1].cast("int").alias("length"), F.col(value))
    empty = F.col(value).cast("string").isin("", "0") | F.col(value).isNull()
    return out.where(F.col("network").isNotNull() & ~empty)


def built_in_services(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SERVICES, "protocol long, port long, name string")


class MappingError(ValueError):
    """A mapping file that is refused as a whole."""


@dataclass
class Mapping:
    devices: list[tuple[str, str]] = field(default_factory=list)
    interfaces: list[tuple[str, int, str]] = field(default_factory=list)
    vlans: list[tuple[str, int, str | None]] = field(default_factory=list)
    prefixes: list[tuple[str, str, int]] = field(default_factory=list)
    services: list[tuple[int, int, str]] = field(default_factory=list)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        make = spark.createDataFrame
        nets = [(e, bytearray(n.network_address.packed), n.prefixlen, v) for e, p, v in self.prefixes if (n := ipaddress.ip_network(p))]
        return {
            "devices": make(self.devices, "exporter string, hostname string"), "interfaces": make(self.interfaces, "exporter string, if_index long, name string"),
            "vlans": make(self.vlans, "exporter string, vlan_id long, name string"), "prefixes": make(nets, "exporter string, network binary, length int, vlan_id long"),
            "services": make(self.services, "protocol long, port long, name string"),
        }


def _whole(value, most: int, what: str) -> int:
    text = str(value)
    if not re.fullmatch("0|[1-9][0-9]*", text) or not 1 <= int(text) <= most:
        raise MappingError(f"{what} {text!r} is not a number from 1 to {most}")
    return int(text)


def _name(value, what: str) -> str:
    if not isinstance(value, str):
        value = str(value) if isinstance(value, int | float) else ""
    if not value.strip() or len(value.encode()) > NAME_BYTES or not value.isprintable():
        raise MappingError(f"the name of {what} is blank, too long or not printable")
    return value


def _only(table, keys: set[str], what: str) -> dict:
    if not isinstance(table, dict):
        raise MappingError(f"{what} is not a table")
    if unknown := set(map(str, table)) - keys:
        raise MappingError(f"{what} has unknown fields {sorted(unknown)}")
    return table


def _address(text: str) -> str:
    try:
        a = ipaddress.ip_address(text)
    except ValueError as e:
        raise MappingError(f"{text!r} is no address") from e
    return str(a.ipv4_mapped or a) if a.version == 6 else str(a)


def _prefix(text: str) -> str:
    try:
        n = ipaddress.ip_network(text)
    except ValueError as e:
        raise MappingError(f"{text!r} is no prefix, or has host bits") from e
    if n.prefixlen == 0 or (n.version == 6 and n.network_address.ipv4_mapped):
        raise MappingError(f"prefix {text!r} covers everything or is a mapped one")
    return str(n)


def mapping(text: str) -> Mapping:
    """Reads a mapping of devices, interfaces, VLANs and services from YAML. Anything odd fails the whole file."""
    import yaml

    class Loader(yaml.SafeLoader):
        """Refuses a key that a table has twice."""

    def table(loader, node):
        keys = [loader.construct_object(k) for k, _ in node.value]
        if len(keys) != len(set(map(str, keys))):
            raise MappingError("a key occurs twice")
        return dict(zip(keys, (loader.construct_object(v, deep=True) for _, v in node.value), strict=True))

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, table)
    try:
        documents = list(yaml.load_all(text, Loader))
    except yaml.YAMLError as e:
        raise MappingError(str(e)) from e
    if len(documents) > 1:
        raise MappingError("more than one document")
    root = _only(documents[0] if documents and documents[0] is not None else {}, {"devices", "services"}, "the file")
    out = Mapping()
    for spelling, device in (root.get("devices") or {}).items():
        exporter = _address(str(spelling))
        if exporter in {e for e, _, _ in out.interfaces} | {e for e, _ in out.devices} | {e for e, _, _ in out.vlans}:
            raise MappingError(f"device {exporter} occurs twice")
        device = _only(device or {}, {"hostname", "interfaces", "vlans"}, f"device {exporter}")
        if "hostname" in device:
            out.devices.append((exporter, _name(device["hostname"], exporter)))
        for index, name in (device.get("interfaces") or {}).items():
            out.interfaces.append((exporter, _whole(index, IF_MAX, "interface"), _name(name, f"interface {index}")))
        for vlan, about in (device.get("vlans") or {}).items():
            number = _whole(vlan, VLAN_MAX, "VLAN")
            about = _only(about or {}, {"name", "prefixes"}, f"VLAN {number}")
            out.vlans.append((exporter, number, _name(about["name"], f"VLAN {number}") if "name" in about else None))
            out.prefixes += [(exporter, _prefix(str(p)), number) for p in about.get("prefixes") or []]
    for spelling, name in (root.get("services") or {}).items():
        port, _, proto = str(spelling).partition("/")
        if proto not in ("tcp", "udp"):
            raise MappingError(f"service {spelling!r} is not port/tcp or port/udp")
        out.services.append((TCP if proto == "tcp" else UDP, _whole(port, PORT_MAX, "port"), _name(name, f"service {spelling}")))
    if len({(e, p) for e, p, _ in out.prefixes}) < len(out.prefixes):
        raise MappingError("a prefix belongs to two VLANs of a device")
    return out


def mapping_file(spark: SparkSession, path: str) -> Mapping:
    """The mapping in a file that Spark can read."""
    return mapping("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


