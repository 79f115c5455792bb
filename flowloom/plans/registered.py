"""The registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..decode import batch, fixed
from ..decode import health as device_health
from ..decode.templated import Limits
from ..functions import labels, records
from ..functions.fixed import DSCP, PROTOCOLS, SERVICES, TCP_FLAGS
from ..operators import distributions, enrich, health, publish, tracking
from ..operators.aggregate import BREAKDOWNS, bounded, breakdown, idle_sessions, with_service_port
from ..sources import driver_tables as T
from ..sources import exposition, wire
from ..sources.wire import encode_v5, encode_v8

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TOP, LEAST, ENTRIES = 1000, 1000, 2000


def register(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def _values(rows, columns: str) -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


def _cases(column: str, names: dict[int, str]) -> str:
    return f"CASE {column} {' '.join(f"WHEN {k} THEN '{v}'" for k, v in names.items())} ELSE CAST({column} AS VARCHAR) END"


def _ip(column: str) -> str:
    return "concat_ws('.', " + ", ".join(f"CAST(({column} >> {s}) & 255 AS VARCHAR)" for s in (24, 16, 8, 0)) + ")"


# -- enriched flows, in both languages


def dims(spark: SparkSession) -> dict[str, DataFrame]:
    make = spark.createDataFrame
    return {
        "prefixes": make(T.PREFIXES, "exporter string, network long, length int, vlan_id long, name string"),
        "countries": make(T.COUNTRIES, "network long, length int, code string"),
        "asns": make(T.ASNS, "network long, length int, asn long, organization string"),
        "threats": make([(x,) for x in T.THREATS], "address long"),
        "interfaces": make(T.INTERFACES, "exporter string, if_index long, name string"),
        "services": make(T.MAPPED_SERVICES, "protocol long, port long, name string"),
    }


def enriched(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """flows with the named lookups, all of them by default, in the engine's order."""
    f, d = T.flows(spark, sf_dir), dims(spark)
    parts = parts or ("services", "vlans", "asns", "countries", "threats")
    if "services" in parts:
        f = enrich.name_services(f, d["services"])
    if "vlans" in parts:
        f = enrich.fill_vlans(f, d["prefixes"])
    if "asns" in parts:
        f = enrich.fill_asns(f, d["asns"])
    if "countries" in parts:
        f = enrich.fill_countries(f, d["countries"])
    return enrich.flag_threats(f, d["threats"]) if "threats" in parts else f


_PLAIN = "(version <> 'netflow_v8' AND NOT flows_reported)"


def _lpm(side: str, rows: list[tuple], value: int, by_exporter: bool = False) -> str:
    out = []
    for r in sorted(rows, key=lambda r: -r[2 if by_exporter else 1]):
        exporter, (net, n) = (r[0], r[1:3]) if by_exporter else (None, r[:2])
        mask = (0xFFFFFFFF << (32 - n)) & 0xFFFFFFFF
        cond = f"{side}_ip & {mask} = {net}" + (f" AND exporter = '{exporter}'" if by_exporter else "")
        v = r[value]
        out.append(f"WHEN {cond} THEN " + (f"'{v}'" if isinstance(v, str) else "NULL" if v is None else str(v)))
    return f"CASE {' '.join(out)} END"


_PRIVATE = "({0}_ip BETWEEN 167772160 AND 184549375 OR {0}_ip BETWEEN 2886729728 AND 2887778303 OR {0}_ip BETWEEN 3232235520 AND 3232301055)"
_SERVICE = lambda rows, side: f"CASE {' '.join(f"WHEN protocol = {p} AND {side}_port = {n} THEN '{s}'" for p, n, s in rows)} END"
_NAMED = f"CASE WHEN coalesce(app_name, '') = '' AND app_id = 0 AND {_PLAIN} THEN coalesce({_SERVICE(T.MAPPED_SERVICES, 'dst')}, {_SERVICE(T.MAPPED_SERVICES, 'src')}, {_SERVICE(SERVICES, 'dst')}, {_SERVICE(SERVICES, 'src')}) ELSE app_name END"
_LISTED = ", ".join(map(str, T.THREATS))
ENRICHED_SQL = (
    "SELECT f.* REPLACE ("
    + ", ".join([f"{_NAMED} AS app_name"] + [f"CASE WHEN {s}_as_filled THEN {_lpm(s, T.ASNS, 2)} ELSE {s}_as END AS {s}_as" for s in ("src", "dst")])
    + "), "
    + ", ".join(
        f"CAST(CASE WHEN {_PLAIN} THEN coalesce({_lpm(s, T.PREFIXES, 3, True)}, 0) ELSE 0 END AS BIGINT) AS {s}_vlan, "
        f"CASE WHEN {_PLAIN} THEN CASE WHEN {_PRIVATE.format(s)} THEN 'private' ELSE {_lpm(s, T.COUNTRIES, 2)} END END AS {s}_country, "
        f"{s}_ip IN ({_LISTED}) AND {_PLAIN} AS {s}_flagged"
        for s in ("src", "dst")
    )
    + f" FROM (SELECT *, src_as = 0 AND {_PLAIN} AND coalesce({_lpm('src', T.ASNS, 2)}, 0) <> 0 AS src_as_filled, dst_as = 0 AND {_PLAIN} AND coalesce({_lpm('dst', T.ASNS, 2)}, 0) <> 0 AS dst_as_filled FROM ({T.FLOWS_SQL})) f"
)
_KNOWN_PORTS = ", ".join(str(p * 65536 + n) for p, n in sorted({(p, n) for p, n, _ in [*SERVICES, *T.MAPPED_SERVICES]}))
_FROM_SRC = f"(protocol * 65536 + dst_port NOT IN ({_KNOWN_PORTS}) AND protocol * 65536 + src_port IN ({_KNOWN_PORTS}))"
PORTED_SQL = f"SELECT *, CASE WHEN {_FROM_SRC} THEN src_port ELSE dst_port END AS port, CASE WHEN {_FROM_SRC} THEN 'src' ELSE 'dst' END AS endpoint FROM ({T.FLOWS_SQL})"
_APP = "coalesce(nullif(app_name, ''), CASE WHEN app_id <> 0 THEN concat(CAST(app_id >> 24 AS VARCHAR), ':', CAST(app_id & 16777215 AS VARCHAR)) END)"
_SUMS = (
    "CAST(sum(coalesce(bytes * greatest(sampling_rate, 1), 0)) AS BIGINT) AS bytes, CAST(sum(coalesce(packets * greatest(sampling_rate, 1), 0)) AS BIGINT) AS packets, "
    "CAST(sum(flows) AS BIGINT) AS flows, bool_and(bytes IS NOT NULL) AS bytes_measured, bool_and(packets IS NOT NULL) AS packets_measured, min(arrival_seq) AS born, max(arrival_seq) AS last_seen"
)
_SOURCE = {
    "services": PORTED_SQL, "destinations": PORTED_SQL, "countries": ENRICHED_SQL, "vlans": ENRICHED_SQL, "applications": ENRICHED_SQL, "asns": ENRICHED_SQL,
    "threats": f"SELECT *, src_ip AS address, 'src' AS endpoint FROM ({ENRICHED_SQL}) WHERE src_flagged UNION ALL SELECT *, dst_ip, 'dst' FROM ({ENRICHED_SQL}) WHERE dst_flagged",
}
_ADMIT = {
    "exporters": "true", "hosts": "src_ip IS NOT NULL AND dst_ip IS NOT NULL", "services": "protocol <> 0", "destinations": "protocol <> 0", "tcp_flags": "protocol = 6 AND tcp_flags IS NOT NULL",
    "dscp": "tos IS NOT NULL", "asns": "src_as <> 0 OR dst_as <> 0", "applications": f"{_APP} IS NOT NULL", "countries": "src_country IS NOT NULL OR dst_country IS NOT NULL", "threats": "true",
    "vlans": "src_vlan <> 0 OR dst_vlan <> 0",
}
_DERIVED = {"dscp": {"dscp": "CAST(tos >> 2 AS INTEGER)"}, "applications": {"application": _APP}}
_LOOKUPS = {"countries": ("countries",), "vlans": ("vlans",), "applications": ("services",), "asns": ("asns",), "threats": ("threats",)}


def breakdown_sql(name: str, by: str = "") -> str:
    keys = ", ".join(f"{_DERIVED.get(name, {}).get(k, k)} AS {k}" for k in BREAKDOWNS[name].keys) + (f", {by}" if by else "")
    plain = "" if name == "exporters" else f" AND {_PLAIN}"
    return f"SELECT {keys}, {_SUMS} FROM ({_SOURCE.get(name, T.FLOWS_SQL)}) WHERE ({_ADMIT[name]}){plain} GROUP BY {', '.join(map(str, range(1, len(BREAKDOWNS[name].keys) + 1 + bool(by))))}"


def entries(spark: SparkSession, sf_dir: str, name: str, by: dict | None = None) -> DataFrame:
    parts = _LOOKUPS.get(name)
    f = enriched(spark, sf_dir, *parts) if parts else T.flows(spark, sf_dir)
    return breakdown(f, name, T.MAPPED_SERVICES, by)


def _register_breakdowns() -> None:
    for name, b in BREAKDOWNS.items():
        keys = list(b.keys)
        order = f"bytes DESC, born, {', '.join(keys)}"
        register(f"agg_{name}", breakdown_sql(name))(lambda s, d, n=name: entries(s, d, n))
        cols = ", ".join([*keys, "bytes", "packets", "flows"])
        register(f"topk_{name}", f"SELECT {cols} FROM ({breakdown_sql(name)}) WHERE bytes >= {LEAST} ORDER BY {order} LIMIT {TOP}")(
            lambda s, d, n=name, k=keys: publish.cut(entries(s, d, n), k, TOP, LEAST).select(*k, "bytes", "packets", "flows")
        )


_register_breakdowns()

_HOSTS = list(BREAKDOWNS["hosts"].keys)
_RANKED = f"SELECT *, row_number() OVER (ORDER BY born, {', '.join(_HOSTS)}) AS r FROM ({breakdown_sql('hosts')})"
_ADMITTED = f"SELECT * EXCLUDE (r) FROM ({_RANKED}) WHERE r <= {ENTRIES}"
_ORDER = f"bytes DESC, born, {', '.join(_HOSTS)}"


def _bounded_hosts(spark, sf_dir):
    return bounded(entries(spark, sf_dir, "hosts"), _HOSTS, ENTRIES)


@register("other_hosts", f"SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(packets), 0) AS BIGINT) AS packets, CAST(coalesce(sum(flows), 0) AS BIGINT) AS flows FROM ({_RANKED}) WHERE r > {ENTRIES}")
def other_hosts(spark, sf_dir):
    return _bounded_hosts(spark, sf_dir)[1].select("bytes", "packets", "flows")


@register(
    "entries_hosts",
    f"SELECT row_number() OVER (ORDER BY {_ORDER}) AS rank, exporter, {_ip('src_ip')} AS src_ip, {_ip('dst_ip')} AS dst_ip, CAST(input_if AS VARCHAR) AS input_if, CAST(output_if AS VARCHAR) AS output_if, direction, bytes, packets, flows, bytes_measured, packets_measured FROM ({_ADMITTED})",
)
def entries_hosts(spark, sf_dir):
    return publish.listing(_bounded_hosts(spark, sf_dir)[0], "hosts")


@register(
    "report_hosts",
    f"SELECT 'hosts' AS aggregation, CAST(count(*) AS BIGINT) AS entries, CAST(least(count(*), {TOP}) AS BIGINT) AS published, CAST(count(*) FILTER (k > {TOP}) AS BIGINT) AS withheld, CAST(coalesce(sum(bytes) FILTER (k > {TOP}), 0) AS BIGINT) AS withheld_bytes, "
    f"coalesce(bool_and(bytes_measured) FILTER (k > {TOP}), true) AS withheld_bytes_measured, (SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM ({_RANKED}) WHERE r > {ENTRIES}) AS other_bytes FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS k FROM ({_ADMITTED}))",
)
def report_hosts(spark, sf_dir):
    about, _ = publish.report(*_bounded_hosts(spark, sf_dir), "hosts", TOP)
    return about.select("aggregation", "entries", "published", "withheld", "withheld_bytes", "withheld_bytes_measured", F.col("other.bytes").alias("other_bytes"))


@register(
    "info_families",
    f"SELECT '{publish.PREFIX}_device_info' AS metric, concat(exporter, '|', hostname) AS labels_text, 1.0::DOUBLE AS value FROM {_values(T.DEVICES, 'exporter, hostname')} "
    f"UNION ALL SELECT '{publish.PREFIX}_vlan_info', concat_ws('|', exporter, CAST(vlan_id AS VARCHAR), name), 1.0::DOUBLE FROM {_values([(e, v, n) for e, _, _, v, n in T.PREFIXES], 'exporter, vlan_id, name')} WHERE name IS NOT NULL "
    f"UNION ALL SELECT DISTINCT '{publish.PREFIX}_interface_info', concat_ws('|', i.exporter, CAST(i.if_index AS VARCHAR), i.name), 1.0::DOUBLE FROM {_values(T.INTERFACES, 'exporter, if_index, name').replace('AS t(', 'AS i(')} "
    f"JOIN (SELECT * FROM ({breakdown_sql('hosts')}) ORDER BY {_ORDER} LIMIT {TOP}) h ON h.exporter = i.exporter AND i.if_index IN (h.input_if, h.output_if) WHERE i.if_index <> 0",
)
def info_families(spark, sf_dir):
    d = dims(spark) | {"devices": spark.createDataFrame(T.DEVICES, "exporter string, hostname string"), "vlans": spark.createDataFrame([(e, v, n) for e, _, _, v, n in T.PREFIXES], "exporter string, vlan_id long, name string")}
    out = publish.info_families(d, [publish.cut(entries(spark, sf_dir, "hosts"), _HOSTS, TOP)])
    return out.select("metric", F.concat_ws("|", *[F.try_element_at("labels", F.lit(k)) for k in ("exporter", "hostname", "vlan", "ifindex", "name")]).alias("labels_text"), "value")


@register(
    "withheld_hosts",
    f"SELECT CAST(count(*) FILTER (k <= {TOP}) AS BIGINT) AS published, CAST(count(*) FILTER (k > {TOP}) AS BIGINT) AS withheld, "
    + ", ".join(f"CAST(coalesce(sum({c}) FILTER (k > {TOP}), 0) AS BIGINT) AS withheld_{c}" for c in ("bytes", "packets", "flows"))
    + ", " + ", ".join(f"coalesce(bool_and({c}) FILTER (k > {TOP}), true) AS withheld_{c}" for c in ("bytes_measured", "packets_measured"))
    + f" FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS k FROM ({_ADMITTED}))",
)
def withheld_hosts(spark, sf_dir):
    return publish.withheld(_bounded_hosts(spark, sf_dir)[0], "hosts", TOP)


@register(
    "measured_withheld",
    f"SELECT metric, labels_text, value FROM (SELECT unnest(['{publish.PREFIX}_dscp_bytes_total', '{publish.PREFIX}_dscp_packets_total', '{publish.PREFIX}_dscp_flows_total']) AS metric, "
    f"concat_ws('|', exporter, direction, {_cases('dscp', DSCP)}) AS labels_text, "
    f"unnest([CASE WHEN bytes_measured THEN CAST(bytes AS DOUBLE) END, CASE WHEN packets_measured THEN CAST(packets AS DOUBLE) END, CAST(flows AS DOUBLE)]) AS value FROM ({breakdown_sql('dscp')})) WHERE value IS NOT NULL",
)
def measured_withheld(spark, sf_dir):
    out = publish.samples(entries(spark, sf_dir, "dscp"), "dscp")
    return out.select("metric", F.concat_ws("|", *[F.element_at("labels", k) for k in ("exporter", "direction", "dscp")]).alias("labels_text"), "value")


@register("sampling_corrected", f"SELECT exporter, sampling_rate, CAST(sum(CASE WHEN bytes IS NOT NULL THEN least(bytes * greatest(sampling_rate, 1), 18446744073709551615) END) AS BIGINT) AS bytes, CAST(sum(packets * greatest(sampling_rate, 1)) AS BIGINT) AS packets FROM ({T.FLOWS_SQL}) GROUP BY 1, 2")
def sampling_corrected(spark, sf_dir):
    c = lambda n: F.sum(records.corrected_exact(F.col(n), F.col("sampling_rate"))).cast("long").alias(n)
    return T.flows(spark, sf_dir).groupBy("exporter", "sampling_rate").agg(c("bytes"), c("packets"))


@register("aggregate_gate", f"SELECT version, flows_reported, {_PLAIN} AS admitted, count(*) AS n FROM ({T.FLOWS_SQL}) GROUP BY 1, 2, 3")
def aggregate_gate(spark, sf_dir):
    gate = ~records.is_aggregated(F.col("version"), F.col("flows_reported"))
    return T.flows(spark, sf_dir).groupBy("version", "flows_reported", gate.alias("admitted")).agg(F.count("*").alias("n"))


@register("service_port_choice", f"SELECT protocol, port, endpoint, count(*) AS n FROM ({PORTED_SQL}) GROUP BY 1, 2, 3")
def service_port_choice(spark, sf_dir):
    return with_service_port(T.flows(spark, sf_dir), T.MAPPED_SERVICES).groupBy("protocol", "port", "endpoint").agg(F.count("*").alias("n"))


@register("app_label", f"SELECT app_id, app_name, {_APP} AS application, count(*) AS n FROM ({T.FLOWS_SQL}) GROUP BY 1, 2, 3")
def app_label(spark, sf_dir):
    return T.flows(spark, sf_dir).groupBy("app_id", "app_name", labels.application(F.col("app_name"), F.col("app_id")).alias("application")).agg(F.count("*").alias("n"))


@register("protocol_label", f"SELECT p AS protocol, {_cases('p', PROTOCOLS)} AS label, count(*) AS n FROM (SELECT l_partkey % 140 AS p FROM lineitem) GROUP BY 1, 2")
def protocol_label(spark, sf_dir):
    p = (F.col("l_partkey") % 140).alias("protocol")
    return T.table(spark, sf_dir, "lineitem").select(p).groupBy("protocol", labels.protocol(F.col("protocol")).alias("label")).agg(F.count("*").alias("n"))


@register("dscp_label", f"SELECT tos, {_cases('(tos >> 2)', DSCP)} AS label, count(*) AS n FROM (SELECT l_partkey % 256 AS tos FROM lineitem) GROUP BY 1, 2")
def dscp_label(spark, sf_dir):
    tos = (F.col("l_partkey") % 256).alias("tos")
    return T.table(spark, sf_dir, "lineitem").select(tos).groupBy("tos", labels.dscp(labels.dscp_of(F.col("tos"))).alias("label")).agg(F.count("*").alias("n"))


@register("tcp_flags_label", "SELECT f AS flags, CASE WHEN f = 0 THEN 'none' ELSE concat_ws(',', " + ", ".join(f"CASE WHEN f & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(TCP_FLAGS)) + ") END AS label, count(*) AS n FROM (SELECT l_partkey % 256 AS f FROM lineitem) GROUP BY 1, 2")
def tcp_flags_label(spark, sf_dir):
    f = (F.col("l_partkey") % 256).alias("flags")
    return T.table(spark, sf_dir, "lineitem").select(f).groupBy("flags", labels.tcp_flags(F.col("flags")).alias("label")).agg(F.count("*").alias("n"))


def _counted(name: str, columns: list[str], *parts: str) -> None:
    register(name, f"SELECT {', '.join(columns)}, count(*) AS n FROM ({ENRICHED_SQL}) GROUP BY ALL")(lambda s, d: enriched(s, d, *parts).groupBy(*columns).agg(F.count("*").alias("n")))


_counted("lpm_vlan", ["exporter", "src_vlan", "dst_vlan"], "vlans")
_counted("lpm_country", ["src_country", "dst_country"], "countries")
_counted("asn_fill", ["src_as", "dst_as", "src_as_filled", "dst_as_filled"], "asns")
_counted("threat_flag", ["exporter", "src_flagged", "dst_flagged"], "threats")
_counted("service_name", ["protocol", "app_name"], "services")


@register(
    "asn_info",
    f"SELECT DISTINCT CAST(t.asn AS BIGINT) AS asn, t.organization FROM (SELECT src_as AS asn FROM ({ENRICHED_SQL}) WHERE src_as_filled UNION SELECT dst_as FROM ({ENRICHED_SQL}) WHERE dst_as_filled) r "
    f"JOIN (SELECT asn, organization FROM {_values(T.ASNS, 'network, length, asn, organization')} WHERE organization <> '') t ON t.asn = r.asn "
    f"JOIN (SELECT src_as AS asn FROM ({breakdown_sql('asns')}) UNION SELECT dst_as FROM ({breakdown_sql('asns')})) p ON p.asn = r.asn",
)
def asn_info(spark, sf_dir):
    f = enriched(spark, sf_dir, "asns")
    shown = publish.cut(breakdown(f, "asns"), list(BREAKDOWNS["asns"].keys), TOP)
    return publish.asn_info(shown, enrich.filled_asn_names(f, dims(spark)["asns"]))


_SHOWN = lambda n: f"SELECT * FROM ({breakdown_sql(n)}) ORDER BY bytes DESC, born, {', '.join(BREAKDOWNS[n].keys)} LIMIT {TOP}"


@register(
    "interface_info",
    f"SELECT DISTINCT i.exporter, CAST(i.if_index AS BIGINT) AS if_index, i.name FROM {_values(T.INTERFACES, 'exporter, if_index, name').replace('AS t(', 'AS i(')} JOIN ("
    + " UNION ".join(f"SELECT exporter, {c} AS if_index FROM ({_SHOWN(n)})" for n in ("hosts", "services", "threats") for c in ("input_if", "output_if"))
    + ") s ON s.exporter = i.exporter AND s.if_index = i.if_index WHERE i.if_index <> 0",
)
def interface_info(spark, sf_dir):
    cuts = [publish.cut(entries(spark, sf_dir, n), list(BREAKDOWNS[n].keys), TOP) for n in ("hosts", "services", "threats")]
    return publish.interface_info(cuts, dims(spark)["interfaces"])


_SAID = lambda c: f"(coalesce(CAST({c} AS VARCHAR), '') NOT IN ('', '0'))"


@register(
    "enrichment_outcomes",
    f"SELECT result, count(*) AS records FROM (SELECT CASE WHEN NOT {_PLAIN} OR {_SAID('app_name')} THEN 'skipped' WHEN {_SAID(_NAMED)} THEN 'filled' ELSE 'unknown' END AS result FROM ({T.FLOWS_SQL})) GROUP BY 1",
)
def enrichment_outcomes(spark, sf_dir):
    f = T.flows(spark, sf_dir)
    named = enrich.name_services(f.withColumn("was", F.col("app_name")), dims(spark)["services"])
    return enrich.outcomes(named, ["was"], ["app_name"])


@register(
    "asn_outcomes",
    f"SELECT CASE WHEN NOT {_PLAIN} OR (src_as <> 0 AND NOT src_as_filled AND dst_as <> 0 AND NOT dst_as_filled) THEN 'skipped' WHEN src_as_filled OR dst_as_filled THEN 'filled' ELSE 'unknown' END AS result, count(*) AS records FROM ({ENRICHED_SQL}) GROUP BY 1",
)
def asn_outcomes(spark, sf_dir):
    f = T.flows(spark, sf_dir).withColumns({"src_was": F.col("src_as"), "dst_was": F.col("dst_as")})
    return enrich.outcomes(enrich.fill_asns(f, dims(spark)["asns"]), ["src_was", "dst_was"], ["src_as", "dst_as"])


_BOUND = "(SELECT i, pow(2.0, i / 8.0) AS hi FROM range(-80, 520) AS r(i))"


def _hist_sql(value: str, where: str) -> str:
    v = f"SELECT exporter, CAST({value} AS DOUBLE) AS v FROM ({T.FLOWS_SQL}) WHERE {_PLAIN} AND {where}"
    idx = "CAST(ceil(log2(v) * 8) AS BIGINT)"
    return f"SELECT exporter, CASE WHEN v > 0 THEN CASE WHEN v <= pow(2.0, ({idx} - 1) / 8.0) THEN {idx} - 1 ELSE {idx} END END AS bucket, count(*) AS n FROM ({v}) GROUP BY 1, 2"


@register("hist_flow_bytes", _hist_sql("bytes * greatest(sampling_rate, 1)", "bytes IS NOT NULL"))
def hist_flow_bytes(spark, sf_dir):
    return distributions.histogram(distributions.sizes(T.flows(spark, sf_dir)))


@register("hist_flow_duration", _hist_sql("(end_us - start_us) / 1000000.0", "end_us IS NOT NULL"))
def hist_flow_duration(spark, sf_dir):
    return distributions.histogram(distributions.durations(T.flows(spark, sf_dir)))


@register("hist_totals", f"SELECT exporter, count(*) AS n, CAST(sum(bytes * greatest(sampling_rate, 1)) AS BIGINT) AS total FROM ({T.FLOWS_SQL}) WHERE {_PLAIN} AND bytes IS NOT NULL GROUP BY 1")
def hist_totals(spark, sf_dir):
    return distributions.totals(distributions.sizes(T.flows(spark, sf_dir))).withColumn("total", F.col("total").cast("long"))


_HALVED = f"SELECT exporter, k, bucket, CAST(ceil(bucket / pow(2, k)) AS BIGINT) AS b, n FROM ({ORACLE_SQL['hist_flow_bytes']}), range(0, 12) AS r(k)"
_FITS = f"SELECT exporter, min(k) AS k FROM (SELECT exporter, k FROM ({_HALVED}) GROUP BY 1, 2 HAVING count(DISTINCT b) <= 40) GROUP BY 1"
_NARROW_SQL = f"SELECT exporter, h.b AS bucket, CAST(sum(h.n) AS BIGINT) AS n FROM ({_HALVED}) h JOIN ({_FITS}) USING (exporter, k) GROUP BY 1, 2"


@register("hist_narrowed", _NARROW_SQL)
def hist_narrowed(spark, sf_dir):
    return distributions.narrowed(hist_flow_bytes(spark, sf_dir), 40)


@register(
    "hist_admitted",
    f"SELECT exporter, bucket, n FROM ({ORACLE_SQL['hist_flow_bytes']}) WHERE exporter IN (SELECT exporter FROM ({T.FLOWS_SQL}) GROUP BY 1 ORDER BY min(arrival_seq), 1 LIMIT 5)",
)
def hist_admitted(spark, sf_dir):
    """Histograms of the first five devices; the others are beyond the budget."""
    return distributions.kept(hist_flow_bytes(spark, sf_dir), distributions.admitted(T.flows(spark, sf_dir), 5))


# -- readings of single fields, and published text


_OPTIONS = "SELECT l_partkey % 5 AS interval, CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey % 7 END AS space, l_orderkey % 100 AS population, l_linenumber % 4 AS size, l_partkey % 3 AS random, CASE WHEN l_orderkey % 3 > 0 THEN 10 END AS plain FROM lineitem"


@register(
    "options_rate",
    f"SELECT rate, count(*) AS n FROM (SELECT CAST(CASE WHEN space IS NOT NULL AND interval > 0 THEN (interval + space) // interval WHEN size > 0 AND population > 0 THEN population // size WHEN random > 0 THEN random ELSE coalesce(plain, 0) END AS BIGINT) AS rate FROM ({_OPTIONS})) GROUP BY 1",
)
def options_rate(spark, sf_dir):
    ok, pk, sk, ln = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    rate = records.options_rate(pk % 5, F.when(sk % 2 == 0, sk % 7), ok % 100, ln % 4, pk % 3, F.when(ok % 3 > 0, 10))
    return T.table(spark, sf_dir, "lineitem").select(rate.alias("rate")).groupBy("rate").agg(F.count("*").alias("n"))


_RAW = "CASE l_partkey % 4 WHEN 0 THEN '   ' WHEN 1 THEN repeat('long name ', CAST(l_suppkey % 40 AS INTEGER)) WHEN 2 THEN concat('app ', CAST(l_suppkey % 9 AS VARCHAR), '   ') ELSE concat(' é', CAST(l_orderkey % 5 AS VARCHAR)) END"


@register("vendor_names", f"SELECT name, count(*) AS n FROM (SELECT CASE WHEN octet_length(encode(t)) BETWEEN 1 AND 255 THEN t END AS name FROM (SELECT rtrim({_RAW}, ' ') AS t FROM lineitem)) GROUP BY 1")
def vendor_names(spark, sf_dir):
    raw = F.expr(_RAW.replace("VARCHAR", "STRING").replace("INTEGER", "INT")).cast("binary")
    return T.table(spark, sf_dir, "lineitem").select(records.clean_name(raw).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@register("country_label", f"SELECT exporter, coalesce(nullif(src_country, ''), 'unknown') AS src_country, coalesce(nullif(dst_country, ''), 'unknown') AS dst_country, direction, bytes FROM ({breakdown_sql('countries')})")
def country_label(spark, sf_dir):
    return publish.labelled(entries(spark, sf_dir, "countries"), "countries").select("exporter", "src_country", "dst_country", "direction", "bytes")


@register(
    "exposition_lines",
    f"SELECT concat('{publish.PREFIX}_dscp_', m, '_total{{direction=\"', direction, '\",dscp=\"', {_cases('dscp', DSCP)}, '\",exporter=\"', exporter, '\"}} ', CAST(v AS VARCHAR)) AS line FROM (SELECT *, unnest(['bytes', 'packets', 'flows']) AS m, unnest([CASE WHEN bytes_measured THEN bytes END, CASE WHEN packets_measured THEN packets END, flows]) AS v FROM ({breakdown_sql('dscp')})) WHERE v IS NOT NULL "
    f"UNION ALL SELECT concat('# TYPE {publish.PREFIX}_dscp_', m, '_total counter') FROM (SELECT unnest(['bytes', 'packets', 'flows']) AS m)",
)
def exposition_lines(spark, sf_dir):
    return exposition.exposition(publish.samples(entries(spark, sf_dir, "dscp"), "dscp"), families=publish.families("dscp"))


@register(
    "published_exporters",
    f"SELECT concat('{publish.PREFIX}_exporter_', m, '_total') AS metric, labels_text, CAST(v AS DOUBLE) AS value FROM (SELECT concat_ws('|', exporter, version, CAST(odid AS VARCHAR), direction) AS labels_text, unnest(['bytes', 'packets', 'flows']) AS m, unnest([CASE WHEN bytes_measured THEN bytes END, CASE WHEN packets_measured THEN packets END, flows]) AS v FROM ({breakdown_sql('exporters')})) WHERE v IS NOT NULL "
    f"UNION ALL SELECT concat('{publish.PREFIX}_exporter_', unnest(['bytes', 'packets', 'flows']), '_total'), 'other|other|other|other', 0.0::DOUBLE",
)
def published_exporters(spark, sf_dir):
    """All devices, whatever the cut, and the row of the rest, which is there also when nothing was folded."""
    keys = list(BREAKDOWNS["exporters"].keys)
    out = publish.published(*bounded(entries(spark, sf_dir, "exporters"), keys, ENTRIES), "exporters", 1, 1 << 40)
    return out.select("metric", F.concat_ws("|", *[F.element_at("labels", k) for k in keys]).alias("labels_text"), "value")


@register("last_datagram", "SELECT concat('192.0.2.', CAST(user_id % 8 AS VARCHAR)) AS exporter, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1")
def last_datagram(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.concat(F.lit("192.0.2."), (F.col("user_id") % 8).cast("string")).alias("src_addr"), F.col("ts").cast("timestamp").alias("recv_ts"))
    return health.last_datagram(e).select("exporter", F.unix_micros("last_datagram").alias("last_us"))


# -- counters near the end of their range, and addresses of both families

_HUGE = "CAST(bytes AS HUGEINT) * 100000000000 * greatest(sampling_rate, 1)"


@register("agg_saturated", f"SELECT exporter, direction, CAST(least(sum(least(coalesce({_HUGE}, 0), 18446744073709551615)), 18446744073709551615) AS VARCHAR) AS bytes, CAST(sum(coalesce(packets * greatest(sampling_rate, 1), 0)) AS VARCHAR) AS packets FROM ({T.FLOWS_SQL}) WHERE version = 'ipfix' GROUP BY 1, 2")
def agg_saturated(spark, sf_dir):
    """Bytes of up to 10**16 a record and rates of up to 1000: records and sums stop at 2**64 - 1."""
    f = T.flows(spark, sf_dir).where("version = 'ipfix'").withColumns({c: F.col(c).cast("decimal(20,0)") for c in ("packets", "flows")}).withColumn("bytes", (F.col("bytes").cast("decimal(12,0)") * F.lit(10**11).cast("decimal(12,0)")).cast("decimal(20,0)"))
    by = [F.col("exporter"), F.col("direction")]
    return f.groupBy(*by).agg(records.total(F.col("bytes"), F.col("sampling_rate")).cast("string").alias("bytes"), records.total(F.col("packets"), F.col("sampling_rate")).cast("string").alias("packets"))


def flows_v6(spark, sf_dir):
    """Flows with addresses as bytes, the source of every other one of IPv6: 2001:db8:0:x::y. FLOWS_V6_SQL has them as text."""
    f = T.flows(spark, sf_dir)
    v6 = lambda x, y: F.unhex(F.concat(F.lit("20010db80000"), F.lpad(F.hex(x), 4, "0"), F.lit("0" * 12), F.lpad(F.hex(y), 4, "0")))
    v4 = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    six = F.col("arrival_seq") % 20 >= 10
    return f.withColumns({"src_ip": F.when(six, v6(F.col("src_ip") % 50 + 1, F.col("src_ip") % 7 + 1)).otherwise(v4("src_ip")), "dst_ip": v4("dst_ip")})


_V6 = "concat('2001:db8:0:', lower(hex(src_ip % 50 + 1)), '::', lower(hex(src_ip % 7 + 1)))"
FLOWS_V6_SQL = f"SELECT * REPLACE (CASE WHEN arrival_seq % 20 >= 10 THEN {_V6} ELSE {_ip('src_ip')} END AS src_ip), src_ip % 50 + 1 AS x, src_ip % 7 + 1 AS y, arrival_seq % 20 >= 10 AS six, src_ip AS src_number FROM ({T.FLOWS_SQL})"


@register("agg_hosts_v6", f"SELECT exporter, src_ip, {_ip('dst_ip')} AS dst_ip, CAST(input_if AS VARCHAR) AS input_if, CAST(output_if AS VARCHAR) AS output_if, direction, {_SUMS} FROM ({FLOWS_V6_SQL}) WHERE {_PLAIN} GROUP BY 1, 2, 3, 4, 5, 6")
def agg_hosts_v6(spark, sf_dir):
    return publish.labelled(breakdown(flows_v6(spark, sf_dir), "hosts"), "hosts")


_NETS6 = [("192.0.2.1", "2001:db8::", 32, 60), ("192.0.2.1", "2001:db8:0:10::", 60, 61), ("192.0.2.1", "2001:db8:0:11::3", 128, 62), ("192.0.2.1", "10.0.0.0", 8, 10), ("192.0.2.2", "2001:db8:0:8::", 61, 63)]


@register(
    "lpm_vlan_v6",
    f"SELECT exporter, CAST(CASE WHEN NOT {_PLAIN} THEN 0 WHEN exporter = '192.0.2.1' AND six THEN CASE WHEN x = 17 AND y = 3 THEN 62 WHEN x // 16 = 1 THEN 61 ELSE 60 END WHEN exporter = '192.0.2.1' THEN 10 "
    f"WHEN exporter = '192.0.2.2' AND six AND x // 8 = 1 THEN 63 ELSE 0 END AS BIGINT) AS src_vlan, count(*) AS n FROM ({FLOWS_V6_SQL}) GROUP BY 1, 2",
)
def lpm_vlan_v6(spark, sf_dir):
    nets = spark.createDataFrame([(e, bytearray(ipaddress.ip_address(n).packed), k, v) for e, n, k, v in _NETS6], "exporter string, network binary, length int, vlan_id long")
    return enrich.fill_vlans(flows_v6(spark, sf_dir), nets).groupBy("exporter", "src_vlan").agg(F.count("*").alias("n"))


@register("threat_flag_v6", f"SELECT exporter, {_PLAIN} AND ((six AND x % 5 = 0 AND y = 2) OR (NOT six AND src_number % 64 = 9)) AS src_flagged, count(*) AS n FROM ({FLOWS_V6_SQL}) GROUP BY 1, 2")
def threat_flag_v6(spark, sf_dir):
    listed = [f"2001:db8:0:{x:x}::2" for x in range(5, 51, 5)] + [str(ipaddress.ip_address(167772160 + k)) for k in range(9, 65536, 64)]
    threats = spark.createDataFrame([(bytearray(ipaddress.ip_address(a).packed),) for a in listed], "address binary")
    return enrich.flag_threats(flows_v6(spark, sf_dir), threats).groupBy("exporter", "src_flagged").agg(F.count("*").alias("n"))


# -- tracking, on events: one domain for each user


def _sequence(spark, sf_dir):
    """Datagrams of 150 sessions: numbers rise by 1 to 3 and now and then one comes late."""
    e = T.table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("session"), (F.col("event_id") * 2 - F.when(F.col("event_id") % 11 == 0, F.lit(9)).otherwise(F.col("event_id") % 3)).alias("seq"))


_SEQ_SQL = "SELECT event_id, user_id AS session, event_id * 2 - CASE WHEN event_id % 11 = 0 THEN 9 ELSE event_id % 3 END AS seq FROM events"


@register("seq_missed_packets", f"SELECT session, CAST(sum(greatest(coalesce(seq - before - 1, 0), 0)) AS BIGINT) AS missed FROM (SELECT session, seq, max(seq) OVER (PARTITION BY session ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({_SEQ_SQL})) GROUP BY 1")
def seq_missed_packets(spark, sf_dir):
    return tracking.missed_packets(_sequence(spark, sf_dir), ["session"], "event_id", "seq")


@register("seq_missed_fold", ORACLE_SQL["seq_missed_packets"])
def seq_missed_fold(spark, sf_dir):
    return tracking.missed(_sequence(spark, sf_dir), {"session": "long"}, "event_id", ["seq"], tracking.PacketLoss)


@register("seq_missed_records", "SELECT session, CAST(sum(coalesce(seq - expected, 0)) AS BIGINT) AS missed FROM (SELECT session, seq, lag(seq + n) OVER (PARTITION BY session ORDER BY event_id) AS expected FROM (SELECT event_id, user_id AS session, event_id * 40 AS seq, 1 + event_id % 30 AS n FROM events)) GROUP BY 1")
def seq_missed_records(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session"), (F.col("event_id") * 40).alias("seq"), (1 + F.col("event_id") % 30).alias("records"))
    return tracking.missed(e, {"session": "long"}, "event_id", ["seq", "records"], tracking.RecordLoss)


_DECL = "SELECT concat('dev', CAST(user_id % 10 AS VARCHAR)) AS exporter, user_id % 3 AS odid, event_id AS seq, 1 + event_id % 4 AS sampler, 10 * (1 + event_id % 3) AS rate, event_type FROM events"


@register(
    "sampler_resolution",
    f"""WITH e AS ({_DECL}), d AS (SELECT * FROM e WHERE event_type = 'signup'),
    r AS (SELECT * FROM e WHERE event_type <> 'signup'),
    own AS (SELECT r.exporter, r.odid, r.seq, r.sampler, max_by(d.rate, d.seq) AS rate FROM r JOIN d ON d.exporter = r.exporter AND d.odid = r.odid AND d.sampler = r.sampler AND d.seq < r.seq GROUP BY ALL),
    latest AS (SELECT r.exporter, r.seq, d.odid, d.sampler, max_by(d.rate, d.seq) AS rate FROM r JOIN d ON d.exporter = r.exporter AND d.seq < r.seq GROUP BY ALL),
    same AS (SELECT l.exporter, l.seq, CASE WHEN min(l.rate) = max(l.rate) THEN min(l.rate) ELSE 0 END AS rate FROM latest l JOIN r ON r.exporter = l.exporter AND r.seq = l.seq AND r.sampler = l.sampler GROUP BY ALL),
    agreed AS (SELECT exporter, seq, CASE WHEN min(rate) = max(rate) THEN min(rate) ELSE 0 END AS rate FROM latest GROUP BY ALL)
    SELECT r.exporter, r.odid, r.seq AS arrival_seq, CAST(coalesce(own.rate, same.rate, agreed.rate, 0) AS BIGINT) AS rate, coalesce(own.rate, same.rate, agreed.rate, 0) = 0 AS owed
    FROM r LEFT JOIN own ON own.exporter = r.exporter AND own.seq = r.seq LEFT JOIN same ON same.exporter = r.exporter AND same.seq = r.seq LEFT JOIN agreed ON agreed.exporter = r.exporter AND agreed.seq = r.seq""",
)
def sampler_resolution(spark, sf_dir):
    u, i = F.col("user_id"), F.col("event_id")
    e = T.table(spark, sf_dir, "events").select(F.concat(F.lit("dev"), (u % 10).cast("string")).alias("exporter"), (u % 3).alias("odid"), i.alias("arrival_seq"), (1 + i % 4).alias("sampler_id"), (10 * (1 + i % 3)).alias("rate"), "event_type")
    told = e.where("event_type = 'signup'").withColumnRenamed("arrival_seq", "declared_seq")
    asked = e.where("event_type <> 'signup'").withColumn("sampling_rate", F.lit(0).cast("long"))
    return tracking.resolved_rates(asked, told)


_UP = "SELECT event_id, epoch_us(ts) // 1000 AS export_ms, (event_id * 977) % 4294967296 AS uptime, (event_id * 977 + (event_id % 7) * 1000 - 3000 + 4294967296) % 4294967296 AS reading FROM events"
_AGE = "((uptime - reading + 4294967296) % 4294967296)"


@register("clock_anchor", f"SELECT event_id, CAST(export_ms - CASE WHEN {_AGE} > 4294967296 - 3600000 THEN {_AGE} - 4294967296 ELSE {_AGE} END AS BIGINT) AS instant_ms FROM ({_UP})")
def clock_anchor(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").withColumn("export_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    up = F.pmod(F.col("event_id") * 977, F.lit(records.WRAP))
    reading = F.pmod(F.col("event_id") * 977 + (F.col("event_id") % 7) * 1000 - 3000, F.lit(records.WRAP))
    return e.select("event_id", records.anchored_ms(F.col("export_ms"), up, reading).alias("instant_ms"))


_CLOCKED = f"SELECT *, CASE WHEN odid = 1 AND input_if = 2 THEN start_us - 5 ELSE end_us END AS late_us FROM ({T.FLOWS_SQL})"


@register("clock_inversions", f"SELECT exporter, odid, CAST(count(*) FILTER (late_us < start_us) AS BIGINT) AS inversions, count(late_us) AS clocked FROM ({_CLOCKED}) GROUP BY 1, 2")
def clock_inversions(spark, sf_dir):
    f = T.flows(spark, sf_dir).withColumn("end_us", F.when((F.col("odid") == 1) & (F.col("input_if") == 2), F.col("start_us") - 5).otherwise(F.col("end_us")))
    return health.clock_inversions(f)


@register("flows_by_version", f"SELECT exporter, version, count(*) AS flows FROM ({T.FLOWS_SQL}) GROUP BY 1, 2")
def flows_by_version(spark, sf_dir):
    return health.flows_by_version(T.flows(spark, sf_dir))


@register("last_flow", f"SELECT exporter, max(arrival_seq) AS last_flow FROM ({T.FLOWS_SQL}) GROUP BY 1")
def last_flow(spark, sf_dir):
    return health.last_flow(T.flows(spark, sf_dir))


@register("health_sampling", f"SELECT exporter, odid, max(sampling_rate) AS rate, bool_or(sampling_rate > 1) AS sampled FROM ({T.FLOWS_SQL}) GROUP BY 1, 2")
def health_sampling(spark, sf_dir):
    return health.sampling_in_force(T.flows(spark, sf_dir))


@register("zero_flow_aggregates", f"SELECT exporter, odid, CAST(count(*) FILTER (flows = 0) AS BIGINT) AS zero, count(*) AS aggregates FROM ({T.FLOWS_SQL}) WHERE flows_reported GROUP BY 1, 2")
def zero_flow_aggregates(spark, sf_dir):
    return health.zero_flow_aggregates(T.flows(spark, sf_dir))


_SESSIONS = "SELECT user_id, epoch_us(ts) AS us, value FROM events"
_TTL = 6 * 3600 * 1_000_000


@register(
    "idle_sessions",
    f"SELECT user_id, session, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS session FROM (SELECT user_id, event_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= {_TTL} THEN 0 ELSE 1 END AS b FROM (SELECT user_id, event_id, epoch_us(ts) AS us FROM events))) GROUP BY 1, 2",
)
def idle_sessions_query(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return idle_sessions(e, ["user_id"], "us", _TTL).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


# -- wire formats: datagrams are made from lineitem and read again

_WIRE = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS b, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem"
_FACTS = "bytes, packets, flows, src_port, dst_port, protocol, tos, src_as, dst_as, input_if, output_if"


def wire_rows(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """Contents of datagrams, one of each row; with `once` of one of the rows that share a number."""
    li = T.table(spark, sf_dir, "lineitem").withColumn("arrival_seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    if once:  # before the fields are made, as there are fewer columns to deal
        li = li.select("arrival_seq", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").dropDuplicates(["arrival_seq"])
    b, q = F.floor("l_extendedprice"), F.floor("l_quantity")
    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    return li.select(
        "arrival_seq", b.alias("bytes"), q.alias("packets"), (1 + pk % 9).alias("flows"), (49152 + ok % 16384).alias("src_port"), (pk % 1024).alias("dst_port"),
        (sk % 256).alias("protocol"), (pk % 256).alias("tos"), (ok % 256).alias("tcp_flags"), (64500 + pk % 7).alias("src_as"), (64600 + ok % 5).alias("dst_as"), (sk % 5).alias("input_if"),
        (sk % 11).alias("output_if"), (pk % 33).alias("src_mask"), (sk % 33).alias("dst_mask"), (F.lit(167772160) + pk % 65536).alias("src"), (F.lit(3325256704) + ok % 256).alias("dst"),
        (ok % 60000).alias("first"), (ok % 60000 + q).alias("last"),
    )


_MADE = f"""SELECT l_orderkey * 10 + l_linenumber AS arrival_seq, b AS bytes, q AS packets, 1 + l_partkey % 9 AS flows, 49152 + l_orderkey % 16384 AS src_port, l_partkey % 1024 AS dst_port, l_suppkey % 256 AS protocol,
 l_partkey % 256 AS tos, l_orderkey % 256 AS tcp_flags, 64500 + l_partkey % 7 AS src_as, 64600 + l_orderkey % 5 AS dst_as, l_suppkey % 5 AS input_if, l_suppkey % 11 AS output_if, l_partkey % 33 AS src_mask,
 l_suppkey % 33 AS dst_mask, 167772160 + l_partkey % 65536 AS src_addr, 3325256704 + l_orderkey % 256 AS dst_addr, (1756200000000 - 60000 + l_orderkey % 60000) * 1000 AS start_us,
 (1756200000000 - 60000 + l_orderkey % 60000 + q) * 1000 AS end_us FROM ({_WIRE})"""
_ABSENT = {c: "0" for c in fixed.ZERO_MEANS_NONE}


def _roundtrip_sql(fields: dict) -> str:
    out = ["arrival_seq"]
    for c in fixed.COLUMNS:
        if c in fields or c in ("start_us", "end_us"):
            out.append(f"CAST({c} AS BIGINT) AS {c}")
        else:
            out.append(f"CAST({'1' if c == 'flows' else _ABSENT.get(c, 'NULL')} AS BIGINT) AS {c}")
    return f"SELECT {', '.join(out)} FROM ({_MADE})"


def _shown(flows: DataFrame) -> DataFrame:
    address = lambda c: F.conv(F.hex(c), 16, 10).cast("long").alias(c)
    return flows.select("arrival_seq", *[address(c) if c in ("src_addr", "dst_addr") else F.col(c).cast("long").alias(c) for c in fixed.COLUMNS])


@register("decode_v5_roundtrip", _roundtrip_sql({k: 0 for k in fixed.V5_FIELDS}))
def decode_v5_roundtrip(spark, sf_dir):
    return _shown(fixed.netflow5(_landed(encode_v5(wire_rows(spark, sf_dir))))[0])


def _register_v8() -> None:
    for m, fields in fixed.V8_FIELDS.items():
        register(f"decode_v8_m{m}_roundtrip", _roundtrip_sql(fields))(lambda s, d, m=m: _shown(fixed.netflow8(_landed(encode_v8(wire_rows(s, d), m)))[0]))


_register_v8()


_ADDED = "arrival_seq, concat('192.0.2.', CAST(arrival_seq % 8 + 1 AS VARCHAR)) AS exporter"
_SIMPLE = ["bytes", "packets", "src_port", "dst_port", "protocol", "tos", "tcp_flags", "input_if", "output_if", "src_as", "dst_as"]


def _landed(datagrams: DataFrame) -> DataFrame:
    """Datagrams as if read from files: a payload that depends on its row's number is made once, and not again for every field that is read from it."""
    return datagrams.withColumn("payload", F.when(F.monotonically_increasing_id() >= 0, F.col("payload")))


def _decoded(datagrams: DataFrame, columns: list[str]) -> DataFrame:
    flows, _ = batch.decode(_landed(datagrams))
    address = lambda c: F.conv(F.hex(c), 16, 10).cast("long").alias(c)
    return flows.select("arrival_seq", "exporter", *[address(c) if c.endswith("_addr") else F.col(c).cast("long").alias(c) for c in columns])


_V9 = [*_SIMPLE, "src_mask", "dst_mask", "src_addr", "dst_addr", "start_us", "end_us"]


@register("decode_v9", f"SELECT {_ADDED}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _V9)} FROM ({_MADE})")
def decode_v9(spark, sf_dir):
    return _decoded(wire.encode_v9(wire_rows(spark, sf_dir)), _V9)


_IPFIX = [*_SIMPLE, "src_addr", "dst_addr", "start_us", "end_us"]


@register("decode_ipfix", f"SELECT {_ADDED}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' if c != 'tos' else 'CAST((tos // 4) * 4 AS BIGINT) AS tos' for c in _IPFIX)} FROM ({_MADE})")
def decode_ipfix(spark, sf_dir):
    return _decoded(wire.encode_ipfix(wire_rows(spark, sf_dir)), _IPFIX)


@register(
    "decode_sflow",
    f"""SELECT {_ADDED}, CAST(bytes % 65536 AS BIGINT) AS bytes, CAST(1 AS BIGINT) AS packets, CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port, CAST(protocol AS BIGINT) AS protocol, CAST(tos AS BIGINT) AS tos,
    CAST(tcp_flags AS BIGINT) AS tcp_flags, CAST(input_if AS BIGINT) AS input_if, CAST(output_if AS BIGINT) AS output_if, CAST(10 AS BIGINT) AS sampling_rate,
    CASE WHEN input_if <> 0 AND input_if <> output_if THEN 'ingress' ELSE 'unknown' END AS direction FROM ({_MADE})""",
)
def decode_sflow(spark, sf_dir):
    flows, _ = batch.decode(_landed(wire.encode_sflow(wire_rows(spark, sf_dir))))
    return flows.select("arrival_seq", "exporter", *[F.col(c).cast("long").alias(c) for c in (*_SIMPLE[:-2], "sampling_rate")], "direction")


def _numbered(spark, sf_dir):
    return wire_rows(spark, sf_dir, once=True)


_COUNT = "(SELECT max(event_id) + 1 FROM events)"
_TIMED = f"SELECT arrival_seq, arrival_seq % 8 + 1 AS device, epoch_us(ts) AS us, arrival_seq // {_COUNT} AS turn FROM (SELECT DISTINCT arrival_seq FROM ({_MADE})) JOIN events ON event_id = arrival_seq % {_COUNT}"
_LIVE = f"SELECT device, us - max(CASE WHEN arrival_seq % 97 = 0 THEN us END) OVER (PARTITION BY device ORDER BY us, turn ROWS UNBOUNDED PRECEDING) <= 3600000000 AS live FROM ({_TIMED})"


@register("template_expiry", f"SELECT concat('192.0.2.', CAST(device AS VARCHAR)) AS exporter, count(*) FILTER (live) AS records, count(*) FILTER (NOT coalesce(live, false)) AS missing FROM ({_LIVE}) GROUP BY 1")
def template_expiry(spark, sf_dir):
    """Records and missing layouts of each device when layouts are announced now and then and live for an hour of event time. Rows are dealt over all events' instants."""
    e = T.table(spark, sf_dir, "events")
    n = e.agg(F.max("event_id") + 1).scalar()
    rows = _numbered(spark, sf_dir).withColumn("event_id", F.col("arrival_seq") % n).join(e.select("event_id", F.col("ts").cast("timestamp").alias("recv")), "event_id")
    rows = rows.withColumn("place", F.unix_micros("recv") * 1000 + F.floor(F.col("arrival_seq") / n))
    data = wire.encode_v9(rows, F.col("arrival_seq") % 97 == 0, recv="recv", order="place")
    out = batch.templated(data.withColumn("kind", F.lit("netflow_v9")), Limits(ttl=3600.0)).where("note is null")
    return out.groupBy("exporter").agg(F.count_if(F.col("error").isNull()).alias("records"), F.count_if(F.col("error") == "missing_template").alias("missing"))


# -- health of devices, from datagrams


@register(
    "decode_errors",
    f"""SELECT exporter, version, reason, count(*) AS n FROM (SELECT '192.0.2.1' AS exporter, CASE m WHEN 0 THEN 'netflow_v5' WHEN 3 THEN 'netflow_v8' WHEN 4 THEN 'netflow_v8' ELSE 'unknown' END AS version,
     CASE m WHEN 2 THEN 'unsupported_version' WHEN 4 THEN 'unsupported_aggregation' ELSE 'malformed' END AS reason FROM (SELECT arrival_seq % 7 AS m FROM ({_MADE})) WHERE m < 5) GROUP BY 1, 2, 3""",
)
def decode_errors(spark, sf_dir):
    """Datagrams of which some are cut off, of an unknown version, or of an unknown method."""
    m, p = F.col("arrival_seq") % 7, F.col("payload")
    damaged = F.when(m == 0, F.substring(p, 1, 40)).when(m == 1, F.substring(p, 1, 3)).when(m == 2, F.concat(F.unhex(F.lit("0063")), F.substring(p, 3, 70)))
    v8 = lambda method: F.concat(F.unhex(F.lit("0008")), F.substring(p, 3, 20), F.unhex(F.lit(method)), F.substring(p, 25, 16))
    damaged = damaged.when(m == 3, v8("0102")).when(m == 4, v8("6302")).otherwise(p)
    data = encode_v5(wire_rows(spark, sf_dir)).withColumn("payload", damaged).withColumns({"recv_ts": F.lit(None).cast("timestamp"), "listener": F.lit("udp")})
    _, errors = batch.decode(_landed(data))
    return health.errors_by_reason(errors).withColumnRenamed("errors", "n")


_GAPS = "CAST(max(arrival_seq) - min(arrival_seq) + 1 - count(DISTINCT arrival_seq) AS BIGINT) AS missed"


@register(
    "sequence_missed",
    f"SELECT '192.0.2.1' AS exporter, 'netflow_v5' AS version, 0 AS odid, {_GAPS} FROM ({_MADE}) UNION ALL "
    + " UNION ALL ".join(f"SELECT concat('192.0.2.', CAST(arrival_seq % 8 + 1 AS VARCHAR)), '{v}', 7, {_GAPS} FROM ({_MADE}) GROUP BY 1" for v in ("netflow_v9", "ipfix", "sflow_v5")),
)
def sequence_missed(spark, sf_dir):
    """Numbers that devices skipped: rows of the table that are not there."""
    rows = _numbered(spark, sf_dir)
    found = device_health.fixed_losses(_landed(encode_v5(rows)))  # each part is given the datagrams of its protocols, so that these are made once
    found = found.unionByName(device_health.sflow_health(_landed(wire.encode_sflow(rows, number="arrival_seq"))))
    found = found.unionByName(device_health.templated_health(_landed(wire.encode_v9(rows).unionByName(wire.encode_ipfix(rows))))).where("metric = 'sequence_missed'")
    return found.select("exporter", "version", F.col("odid").cast("int").alias("odid"), F.col("value").alias("missed"))


@register(
    "sample_pool",
    f"SELECT exporter, metric, CAST(sum(n) AS BIGINT) AS value FROM (SELECT concat('192.0.2.', CAST(arrival_seq % 8 + 1 AS VARCHAR)) AS exporter, arrival_seq % 5 AS s, unnest(['sample_pool', 'samples_dropped']) AS metric, unnest([(max(arrival_seq) - min(arrival_seq)) * 10, max(arrival_seq) - min(arrival_seq)]) AS n FROM ({_MADE}) GROUP BY 1, 2) GROUP BY 1, 2",
)
def sample_pool(spark, sf_dir):
    """How far the pools and drops of sFlow samplers grew."""
    n = F.col("arrival_seq")
    data = wire.encode_sflow(_numbered(spark, sf_dir).withColumn("input_if", n % 5), number="arrival_seq", pool=(n * 10) % (1 << 32), drops=n % (1 << 32))
    return device_health.sflow_health(_landed(data)).where("metric <> 'sequence_missed'").select("exporter", "metric", "value")


@register(
    "device_state",
    f"SELECT concat('192.0.2.', CAST(arrival_seq % 8 + 1 AS VARCHAR)) AS exporter, unnest(['templates', 'sampling_unresolved', 'clock_inversions']) AS metric, unnest([1, count(DISTINCT arrival_seq), 0]) AS value FROM ({_MADE}) GROUP BY 1",
)
def device_state(spark, sf_dir):
    """Layouts, records whose sampling rate is owed, and clocks that run backwards, by NetFlow 9 device."""
    found = device_health.templated_health(_landed(wire.encode_v9(_numbered(spark, sf_dir))))
    return found.where("odid is not null and metric in ('templates', 'sampling_unresolved', 'clock_inversions')").select("exporter", "metric", "value")


@register("table_health", f"SELECT 'hosts' AS aggregation, least(count(*), {ENTRIES}) AS entries, count(*) FILTER (r > {ENTRIES}) AS folded_keys, CAST(coalesce(sum(flows) FILTER (r > {ENTRIES}), 0) AS BIGINT) AS folded_flows FROM ({_RANKED})")
def table_health(spark, sf_dir):
    """How full a breakdown is, and what its bound folds."""
    return health.table_health(entries(spark, sf_dir, "hosts"), "hosts", ENTRIES)


@register("received", f"SELECT 'udp' AS listener, count(*) AS packets, CAST(sum(CASE WHEN arrival_seq % 11 = 0 THEN 9300 ELSE 72 END) AS BIGINT) AS bytes, count(*) FILTER (arrival_seq % 11 = 0) AS truncated FROM ({_MADE})")
def received(spark, sf_dir):
    """Packets and bytes of a listener, and those that its buffer cut off."""
    long = F.when(F.col("arrival_seq") % 11 == 0, F.repeat(F.lit("00"), 9300)).otherwise(F.hex("payload"))
    data = encode_v5(wire_rows(spark, sf_dir)).withColumns({"listener": F.lit("udp"), "payload": F.unhex(long)})
    return health.received(data)


from . import rule_queries  # noqa: E402, F401  (registers the rules)
