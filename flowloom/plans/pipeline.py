"""End to end in batch: datagrams or flow records to published metrics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..decode import batch
from ..decode import health as device_health
from ..decode.templated import Limits
from ..operators import enrich, health, publish
from ..operators.aggregate import BREAKDOWNS, bounded, breakdown
from ..streaming.jobs import with_numbers


@dataclass(frozen=True)
class Settings:
    """Capacities and switches, with the engine's defaults."""

    max_entries: int = 100_000
    top_k: int = publish.TOP_K
    min_bytes: int = 0
    modules: tuple[str, ...] = tuple(BREAKDOWNS)
    limits: Limits = field(default_factory=Limits)

    def __post_init__(self):
        if self.max_entries < 1 or self.top_k < 1 or self.min_bytes < 0:
            raise ValueError("max_entries and top_k begin at 1, min_bytes at 0")
        if unknown := set(self.modules) - set(BREAKDOWNS):
            raise ValueError(f"unknown breakdowns {sorted(unknown)}")


def enriched(flows: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """All lookups whose tables are given, in the engine's order: names, VLANs, AS numbers, countries, threats."""
    flows = enrich.name_services(flows, dims.get("services"))
    for name, step in (("prefixes", enrich.fill_vlans), ("asns", enrich.fill_asns), ("countries", enrich.fill_countries), ("threats", enrich.flag_threats)):
        if name in dims:
            flows = step(flows, dims[name])
    return flows


def from_datagrams(datagrams: DataFrame, dims: dict[str, DataFrame], settings: Settings = Settings()) -> DataFrame:
    flows, _ = batch.decode(datagrams, settings.limits)
    return enriched(with_numbers(flows), dims)


def health_metrics(datagrams: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Health counters and gauges of the devices that sent the datagrams."""
    flows, errors = batch.decode(datagrams, settings.limits)
    return health.metrics(flows, errors, device_health.of_datagrams(datagrams, settings.limits))


def published(flows: DataFrame, settings: Settings = Settings(), dims: dict[str, DataFrame] | None = None) -> DataFrame:
    """Metrics of all breakdowns whose columns the flows have, and info families of the tables given.

    The flows are read by every breakdown; a caller that reads the result more than once, or whose flows
    are dear to make, persists them and releases them afterwards."""
    held = flows
    out, cuts = None, []
    needs = {"countries": "src_country", "vlans": "src_vlan", "threats": "src_flagged"}
    for name in settings.modules:
        if needs.get(name, "exporter") not in flows.columns:
            continue
        admitted, other = bounded(breakdown(held, name), list(BREAKDOWNS[name].keys), settings.max_entries)
        part = publish.published(admitted, other, name, settings.top_k, settings.min_bytes)
        out = part if out is None else out.unionByName(part)
        if name in ("hosts", "services", "threats"):
            cuts.append(publish.cut(admitted, list(BREAKDOWNS[name].keys), settings.top_k, settings.min_bytes))
    known = {k: v for k, v in (dims or {}).items() if k in ("devices", "vlans") or (k == "interfaces" and cuts)}
    return out.unionByName(publish.info_families(known, cuts)) if known else out
