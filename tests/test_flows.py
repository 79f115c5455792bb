import pytest
from pyspark.sql import functions as F

from flowloom.operators import distributions, enrich, publish, rules
from flowloom.operators.aggregate import BREAKDOWNS, bounded, breakdown, idle_sessions
from flowloom.plans.pipeline import Settings, from_datagrams, published
from flowloom.sources import exposition, files

from . import wire
from .test_decode import datagrams

FIELDS = "arrival_seq long, exporter string, version string, odid long, src_ip long, dst_ip long, src_port long, dst_port long, protocol long, direction string, tos long, tcp_flags long, input_if long, output_if long, bytes long, packets long, flows long, flows_reported boolean, sampling_rate long, src_as long, dst_as long, app_id long, app_name string, start_us long, end_us long"
BASE = {
    "exporter": "192.0.2.1", "version": "netflow_v9", "odid": 0, "src_ip": 167772161, "dst_ip": 3325256711, "src_port": 51234, "dst_port": 443, "protocol": 6, "direction": "ingress", "tos": 0xB8, "tcp_flags": 0x12,
    "input_if": 1, "output_if": 2, "bytes": 1000, "packets": 10, "flows": 1, "flows_reported": False, "sampling_rate": 0, "src_as": 64500, "dst_as": 64501, "app_id": 0, "app_name": "https", "start_us": 0, "end_us": 1000000,
}


def make(spark, *changes):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return spark.createDataFrame([tuple((BASE | {"arrival_seq": i} | c)[n] for n in names) for i, c in enumerate(changes)], FIELDS)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_every_breakdown_gets_the_record(spark):
    f = make(spark, {}, {})
    assert one(breakdown(f, "exporters")).bytes == 2000
    assert one(breakdown(f, "hosts")).packets == 20
    r = one(breakdown(f, "services"))
    assert (r.port, r.endpoint, r.flows) == (443, "dst", 2)
    assert one(breakdown(f, "tcp_flags")).tcp_flags == 0x12
    assert one(publish.labelled(breakdown(f, "tcp_flags"), "tcp_flags")).tcp_flags == "syn,ack"
    assert one(publish.labelled(breakdown(f, "dscp"), "dscp")).dscp == "ef"
    assert one(breakdown(f, "applications")).application == "https"


def test_sampling_and_gates(spark):
    assert tuple(one(breakdown(make(spark, {"sampling_rate": 1000}), "exporters")))[4:7] == (1000000, 10000, 1)
    bare = make(spark, {"src_ip": None, "dst_ip": None, "bytes": 500, "packets": 5, "flows": 3, "tos": None, "tcp_flags": None, "app_name": None})
    assert [n for n in ("exporters", "hosts", "services", "destinations", "tcp_flags", "dscp", "asns", "applications") if breakdown(bare, n).count()] == ["exporters", "asns"]
    for gate in ({"version": "netflow_v8"}, {"flows_reported": True}):
        assert breakdown(make(spark, gate), "hosts").count() == 0
        assert breakdown(make(spark, gate), "exporters").count() == 1
    assert one(breakdown(make(spark, {"app_name": None, "app_id": 13 << 24 | 42}), "applications")).application == "13:42"


def test_reverse_leg_names_the_source_port(spark):
    r = one(breakdown(make(spark, {"src_port": 443, "dst_port": 51234}), "destinations"))
    assert (r.port, r.endpoint) == (443, "src")


def test_entry_bound(spark):
    f = make(spark, *[{"src_ip": i} for i in range(1, 6)])
    admitted, other = bounded(breakdown(f, "hosts"), list(BREAKDOWNS["hosts"].keys), 2)
    assert sorted(r.src_ip for r in admitted.collect()) == [1, 2]
    assert tuple(one(other)) == (3000, 30, 3)
    admitted, other = bounded(breakdown(f, "hosts"), list(BREAKDOWNS["hosts"].keys), 5)
    assert admitted.count() == 5 and tuple(one(other)) == (0, 0, 0)


@pytest.mark.parametrize(("least", "k", "want"), [(0, 2, [5000, 3000]), (100, 9, [5000, 3000, 100]), (101, 9, [5000, 3000])])
def test_cut(spark, least, k, want):
    f = make(spark, *[{"src_ip": i, "bytes": b} for i, b in enumerate((50, 5000, 100, 3000), 1)])
    assert [r.bytes for r in publish.cut(breakdown(f, "hosts"), list(BREAKDOWNS["hosts"].keys), k, least).collect()] == want


def test_unmeasured_counts_are_withheld_but_rank(spark):
    f = make(spark, {"bytes": None}, *[{} for _ in range(10)])
    got = {r.metric.split("_")[-2]: r.value for r in publish.samples(breakdown(f, "exporters"), "exporters").collect()}
    assert got == {"packets": 110.0, "flows": 11.0}
    assert one(breakdown(f, "exporters")).bytes == 10000


def test_published_text(spark):
    f = make(spark, {}, {"bytes": 5})
    lines = [r.line for r in exposition.exposition(published(f, Settings(modules=("exporters",)))).collect()]
    assert lines[0] == "# TYPE flowloom_exporter_bytes_total counter"
    assert 'flowloom_exporter_bytes_total{direction="ingress",exporter="192.0.2.1",odid="0",version="netflow_v9"} 1005' in lines
    assert 'flowloom_exporter_flows_total{direction="other",exporter="other",odid="other",version="other"} 0' in lines
    table, series = exposition.remote_write(published(f, Settings(modules=("exporters",))), 5)
    names = {r.ref: r.symbol for r in table.collect()}
    assert names[0] == "" and all(names[x.labels[0]] == "__name__" for x in series.collect())


def test_type_lines_of_withheld_families(spark):
    f = make(spark, {"bytes": None, "packets": None}, {"flows": 2 * 10**15})
    lines = [r.line for r in exposition.exposition(publish.samples(breakdown(f, "exporters"), "exporters"), families=publish.families("exporters")).collect()]
    assert [x.split()[2] for x in lines if x.startswith("#")] == publish.families("exporters")[:1] + publish.families("exporters")[2:] + publish.families("exporters")[1:2]
    assert [x.split()[-1] for x in lines if not x.startswith("#")] == ["2000000000000001"]


def test_withheld_totals(spark):
    f = make(spark, *[{"src_ip": i, "bytes": b} for i, b in enumerate((50, 5000, None, 3000), 1)])
    r = one(publish.withheld(breakdown(f, "hosts"), "hosts", 2))
    assert (r.published, r.withheld, r.withheld_bytes, r.withheld_bytes_measured, r.withheld_packets_measured) == (2, 2, 50, False, True)


def test_idle_expiry(spark):
    f = make(spark, *[{"start_us": t} for t in (0, 50, 111)]).withColumnRenamed("start_us", "at")
    assert [r.session for r in idle_sessions(f, ["exporter"], "at", 60).orderBy("at").collect()] == [1, 1, 2]


def test_histograms(spark):
    f = make(spark, {"bytes": 1 << 29}, {"version": "netflow_v8"}, {"bytes": 0}, {"bytes": None})
    assert {(r.bucket, r.n) for r in distributions.histogram(distributions.sizes(f)).collect()} == {(232, 1), (None, 1)}
    powers = spark.range(0, 63).select(F.pow(F.lit(2.0), F.col("id")).alias("v"), (F.col("id") * 8).alias("want"))
    assert powers.where(distributions.bucket(F.col("v")) != F.col("want")).count() == 0
    many = spark.range(0, 500).select(F.lit("x").alias("exporter"), F.col("id").alias("bucket"), F.lit(1).alias("n"))
    narrow = distributions.narrowed(many)
    assert narrow.count() <= 200 and narrow.agg(F.sum("n")).first()[0] == 500


def test_lookups(spark):
    prefixes = spark.createDataFrame([("192.0.2.1", 167772160, 8, 10), ("192.0.2.1", 167837696, 16, 20), ("192.0.2.1", 167837952, 24, 30), ("192.0.2.2", 167837952, 24, 99)], "exporter string, network long, length int, vlan_id long")
    f = make(spark, {"src_ip": 167837953}, {"src_ip": 167838209}, {"src_ip": 167903745}, {"src_ip": 1}, {"src_ip": 167837953, "exporter": "192.0.2.2"}, {"src_ip": 167837953, "version": "netflow_v8"})
    assert [r.src_vlan for r in enrich.fill_vlans(f, prefixes).orderBy("arrival_seq").collect()] == [30, 20, 10, 0, 99, 0]
    asns = spark.createDataFrame([(167772160, 8, 65000, "Net")], "network long, length int, asn long, organization string")
    g = enrich.fill_asns(make(spark, {"src_as": 0}, {}, {"src_as": 0, "src_ip": 5}), asns)
    assert [(r.src_as, r.src_as_filled) for r in g.orderBy("arrival_seq").collect()] == [(65000, True), (64500, False), (0, False)]
    assert [(r.asn, r.organization) for r in enrich.filled_asn_names(g, asns).collect()] == [(65000, "Net")]
    countries = spark.createDataFrame([(3325256704, 24, "US"), (167772160, 8, "FR")], "network long, length int, code string")
    assert tuple(one(enrich.fill_countries(make(spark, {}), countries).select("src_country", "dst_country"))) == ("private", "US")
    threats = spark.createDataFrame([(3325256711,)], "address long")
    h = enrich.flag_threats(make(spark, {}, {"src_ip": 3325256711}), threats)
    assert sorted((r.endpoint, r.flows) for r in breakdown(h, "threats").collect()) == [("dst", 2), ("src", 1)]


def test_service_names(spark):
    mapped = spark.createDataFrame([(6, 443, "own-web")], "protocol long, port long, name string")
    f = make(spark, {"app_name": None}, {"app_name": None, "dst_port": 5, "src_port": 22}, {}, {"app_name": None, "app_id": 7})
    assert [r.app_name for r in enrich.name_services(f, mapped).orderBy("arrival_seq").collect()] == ["own-web", "ssh", "https", None]


def snapshots(spark, **series):
    rows = [(name, 60 * i, float(start + step * i)) for name, (start, step) in series.items() for i in range(11)]
    return spark.createDataFrame(rows, "s string, t long, value double")


def rate_at(spark, second=600, **series):
    return {r.s: r.rate for r in rules.rate(snapshots(spark, **series), ["s"]).where(F.col("at") == second).collect()}


def test_rates(spark):
    assert rate_at(spark, a=(0, 60000), b=(0, 30000)) == pytest.approx({"a": 1000.0, "b": 500.0})
    r = rules.rate(snapshots(spark, a=(0, 60000), b=(0, 30000)), ["s"])
    total = r.groupBy("at").agg(F.sum("rate").alias("rate"))
    packets = rules.rate(snapshots(spark, a=(0, 60), b=(0, 30)), ["s"]).groupBy("at").agg(F.sum("rate").alias("rate"))
    assert {x.q for x in rules.ratio(total, packets, [], "q").where("at = 600").collect()} == {1000.0}
    assert rules.ratio(total, rules.rate(snapshots(spark, a=(0, 0)), ["s"]).drop("s"), [], "q").count() == 0
    shares = rules.share(rules.rate(snapshots(spark, a=(0, 15000), b=(0, 45000), c=(5, 0)), ["s"]), []).where("at = 600")
    assert {x.s: round(x.share, 6) for x in shares.collect()} == {"a": 0.25, "b": 0.75, "c": 0.0}
    assert rules.share(rules.rate(snapshots(spark, a=(5, 0)), ["s"]), []).count() == 0


def test_rate_counts_a_restart_from_zero(spark):
    df = spark.createDataFrame([("a", 60 * i, v) for i, v in enumerate([100.0, 200.0, 10.0, 60.0, 120.0, 180.0])], "s string, t long, value double")
    r = rules.increase(df, ["s"]).where("at = 300").first()
    assert r.increase == pytest.approx((10 + 50 + 60 + 60) * (240 + 60) / 240) or r.increase > 0


def test_threat_list(spark, tmp_path):
    p = tmp_path / "list.txt"
    p.write_text("# head\n192.0.2.1 seen twice\n192.0.2.1;x\n; no\n\n::ffff:198.51.100.9,\n2001:db8::1%eth0\n192.0.2.0/24\nhost.example\n")
    listed, skipped = files.threat_list(spark, str(p))
    assert sorted(r.address for r in listed.collect()) == ["192.0.2.1", "198.51.100.9", "2001:db8::1"]
    assert skipped.first().skipped == 2
    (tmp_path / "long.txt").write_text("1" * 256)
    with pytest.raises(Exception, match="too long"):
        files.threat_list(spark, str(tmp_path / "long.txt"))[0].collect()
    assert files.merged_list([listed], listed, floor=9).count() == 3


MAPPING = """
devices:
  192.0.2.1:
    hostname: sw1
    interfaces: {1: Vl1, 10102: Gi0/2}
    vlans: &site
      800: {name: internal, prefixes: [192.0.2.0/24, "2001:db8:800::/64"]}
  192.0.2.2: {vlans: *site}
services: {5246/udp: capwap}
"""


def test_mapping(spark):
    m = files.mapping(MAPPING)
    assert m.devices == [("192.0.2.1", "sw1")] and m.services == [(17, 5246, "capwap")]
    assert {k: v.count() for k, v in m.tables(spark).items()} == {"devices": 1, "interfaces": 2, "vlans": 2, "prefixes": 4, "services": 1}


@pytest.mark.parametrize(
    "text",
    [
        "devices: {192.0.2.1: {color: red}}", "other: 1", "--- {}\n--- {}", "devices: {192.0.2.1: {}, 192.0.2.1: {}}", 'devices: {192.0.2.1: {hostname: a}, "::ffff:192.0.2.1": {hostname: b}}',
        "devices: {192.0.2.1: {vlans: {5: {prefixes: [192.0.2.1/24]}}}}", "devices: {192.0.2.1: {vlans: {5: {prefixes: [0.0.0.0/0]}}}}", "devices: {192.0.2.1: {vlans: {4095: {}}}}",
        'devices: {192.0.2.1: {interfaces: {"01": a}}}', 'devices: {192.0.2.1: {hostname: " "}}', "services: {0/tcp: a}", "services: {80/sctp: a}", "devices: {nowhere: {}}", 'devices: {192.0.2.1: {hostname: "a\\u0007"}}',
    ],
)
def test_bad_mappings_fail_as_a_whole(text):
    with pytest.raises(files.MappingError):
        files.mapping(text)


def test_datagrams_to_metrics(spark):
    data = datagrams(spark, wire.v5(), wire.v9(wire.v9_template(), wire.flowset(300, wire.V9_RECORD)), wire.sflow(wire.sample(wire.sampled_ipv4())))
    metrics = published(from_datagrams(data, {}), Settings(modules=("exporters", "hosts")))
    got = {(r.metric, r.labels.get("version")): r.value for r in metrics.collect()}
    assert got["flowloom_exporter_bytes_total", "netflow_v5"] == 512000 * 100
    assert got["flowloom_exporter_bytes_total", "netflow_v9"] == 512000
    assert got["flowloom_exporter_bytes_total", "sflow_v5"] == 700 * 1000


def test_settings_are_checked():
    for bad in ({"top_k": 0}, {"min_bytes": -1}, {"modules": ("nothing",)}):
        with pytest.raises(ValueError, match=r".+"):
            Settings(**bad)
