import random
from struct import pack

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom.decode import batch, fixed, sflow, templated
from flowloom.decode.templated import Device, Limits
from flowloom.functions import records
from flowloom.operators.tracking import Declarations, PacketLoss, RecordLoss, SamplePool
from flowloom.plans import registered
from flowloom.sources import wire as encoders

from . import oracle, wire

FLOW = {
    "src_addr": wire.a("10.0.0.1"), "dst_addr": wire.a("198.51.100.7"), "src_port": 51234, "dst_port": 443, "protocol": 6, "tos": 0xB8, "tcp_flags": 0x1B, "input_if": 3, "output_if": 4,
    "bytes": 512000, "packets": 1000, "src_as": 64500, "dst_as": 64501, "src_mask": 24, "dst_mask": 25,
}


def has(record, want):
    return {k: record.get(k) for k in want} == want


def datagrams(spark, *payloads, src="192.0.2.1"):
    rows = [(i, None, src, 2055, "udp", bytearray(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "arrival_seq long, recv_ts timestamp, src_addr string, src_port int, listener string, payload binary")


def test_netflow5(spark):
    flows, errors = fixed.netflow5(datagrams(spark, wire.v5(), wire.v5(2, sampling=0xC064), wire.v5()[:60], wire.v5(0), wire.v5() + b"xx"))
    rows = [r.asDict() for r in flows.orderBy("arrival_seq").collect()]
    assert len(rows) == 4
    export = 1756200000_500_000
    want = FLOW | {"flows": 1, "sampling_rate": 100, "start_us": export - 30_000_000, "end_us": export - 15_000_000}
    assert all({k: (bytes(r[k]) if isinstance(r[k], bytearray) else r[k]) for k in want} == want for r in rows)
    assert [(r.arrival_seq, r.reason) for r in errors.orderBy("arrival_seq").collect()] == [(2, "malformed"), (3, "malformed")]


def test_netflow8_errors(spark):
    head = lambda m, v, n=1: pack(">HHIIIIBBBBI", 8, n, 60000, 1756200000, 0, 1, 0, 0, m, v, 0)
    flows, errors = fixed.netflow8(datagrams(spark, head(1, 2) + bytes(28), head(15, 2) + bytes(99), head(1, 3) + bytes(28), head(7, 2) + bytes(39), b"\0\x08"))
    assert [(r.odid, r.flows, r.src_as) for r in flows.collect()] == [(1, 0, 0)]
    assert sorted((r.arrival_seq, r.reason) for r in errors.collect()) == [(1, "unsupported_aggregation"), (2, "malformed"), (3, "malformed"), (4, "malformed")]


def test_netflow9():
    d = Device()
    data = wire.flowset(300, wire.V9_RECORD)
    assert d.decode(wire.v9(data)) == ([], ["missing_template"])
    rows, errors = d.decode(wire.v9(wire.v9_template(), data, seq=2))
    assert errors == [] and len(rows) == 1
    at = 1756300000_000_000
    assert has(rows[0], FLOW | {"odid": 256, "version": "netflow_v9", "flows": 1, "flows_reported": False, "start_us": at - 90_000_000, "end_us": at - 75_000_000, "sampling_rate": 0})
    assert len(d.decode(wire.v9(data + b""), port=7)[0]) == 0  # another session has layouts of its own
    assert d.decode(wire.v9(wire.flowset(5, b"1234")))[1] == ["reserved_set"]


def test_netflow9_late_failure_keeps_layouts_but_no_records():
    d = Device()
    data = wire.flowset(300, wire.V9_RECORD)
    assert d.decode(wire.v9(wire.v9_template(), data, pack(">HH", 300, 2)))[0] == []
    assert len(d.decode(wire.v9(data))[0]) == 1


@pytest.mark.parametrize("fields", [[(8, 0)], [(8, 4)] * 200])
def test_refused_layout_withdraws(fields):
    d = Device()
    d.decode(wire.v9(wire.v9_template()))
    assert "invalid_template" in d.decode(wire.v9(wire.v9_template(fields=fields)))[1]
    assert d.decode(wire.v9(wire.flowset(300, wire.V9_RECORD)))[1] == ["missing_template"]


def test_layouts_expire():
    d = Device(Limits(ttl=10))
    d.decode(wire.v9(wire.v9_template()), now=0)
    assert len(d.decode(wire.v9(wire.flowset(300, wire.V9_RECORD)), now=10)[0]) == 1
    assert d.decode(wire.v9(wire.flowset(300, wire.V9_RECORD)), now=11)[1] == ["missing_template"]


def test_ipfix():
    d = Device()
    rows, errors = d.decode(wire.ipfix(wire.IPFIX_TEMPLATE, wire.flowset(400, wire.IPFIX_RECORD)))
    assert errors == []
    want = {"src_addr": wire.a("2001:db8::1"), "dst_addr": wire.a("2001:db8::2"), "src_port": 51234, "dst_port": 443, "protocol": 6, "bytes": 512000, "packets": 1000, "odid": 512}
    assert has(rows[0], want | {"start_us": 1756400100000_000, "end_us": 1756400160000_000})
    assert (12325, 9999) in d.unread


def test_ipfix_is_checked_as_a_whole():
    d = Device()
    good = wire.flowset(400, wire.IPFIX_RECORD)
    assert d.decode(wire.ipfix(wire.IPFIX_TEMPLATE, good, pack(">HH", 400, 3))) == ([], ["malformed"])
    assert d.decode(wire.ipfix(good))[1] == ["missing_template"]


def test_ipfix_variable_length():
    layout = wire.flowset(2, pack(">HH", 500, 2) + pack(">HH", 96, 0xFFFF) + pack(">HH", 1, 4))
    d = Device()
    long = b"n" * 255
    rows, _ = d.decode(wire.ipfix(layout, wire.flowset(500, b"\x03abc" + pack(">I", 7) + b"\xff\x00\xff" + long + pack(">I", 8))))
    assert [(r.get("app_name"), r["bytes"]) for r in rows] == [("abc", 7), (long.decode(), 8)]


def test_sflow():
    rows, errors, about = sflow.decode(wire.sflow(wire.sample(wire.sampled_ipv4(), wire.raw_record(wire.frame(wire.tcp_packet(), [100])))))
    assert errors == [] and about["odid"] == 7
    want = {"bytes": 1518, "packets": 1, "flows": 1, "sampling_rate": 1000, "odid": 7, "tcp_flags": 0x18, "tos": 0xB8, "src_port": 51234, "dst_port": 443, "direction": "unknown", "input_if": 3, "output_if": 4}
    assert has(rows[0], want)
    assert sflow.decode(wire.sflow(wire.sample(wire.sampled_ipv4(), source=3)))[0][0]["direction"] == "ingress"
    assert sflow.decode(wire.sflow(wire.sample(wire.sampled_ipv4(), source=4)))[0][0]["direction"] == "egress"
    assert sflow.decode(wire.sflow(wire.sample(wire.sampled_ipv4(), inward=0x3FFFFFFF, outward=0x40000001)))[0][0]["input_if"] == 0
    assert sflow.decode(wire.sflow(wire.sample(wire.raw_record(b"x", protocol=5))))[1] == ["unsupported_header_protocol"]
    assert sflow.decode(wire.sflow(wire.sample(wire.sampled_ipv4(70000))))[1] == ["malformed"]
    assert sflow.decode(wire.sflow(wire.sample(wire.sampled_ipv4()))[:-1])[:2] == ([], ["malformed"])


def test_later_fragment_has_no_ports():
    rows, _, _ = sflow.decode(wire.sflow(wire.sample(wire.raw_record(wire.frame(wire.tcp_packet(fragment=100))))))
    assert "src_port" not in rows[0] and rows[0]["protocol"] == 6


def test_batch_decodes_every_protocol(spark):
    good = [wire.v5(), wire.v9(wire.v9_template(), wire.flowset(300, wire.V9_RECORD)), wire.ipfix(wire.IPFIX_TEMPLATE, wire.flowset(400, wire.IPFIX_RECORD)), wire.sflow(wire.sample(wire.sampled_ipv4()))]
    flows, errors = batch.decode(datagrams(spark, *good, b"\0\x07abc", b"x"))
    assert sorted(r.version for r in flows.collect()) == ["ipfix", "netflow_v5", "netflow_v9", "sflow_v5"]
    assert sorted(r.reason for r in errors.collect()) == ["malformed", "unsupported_version"]


def test_netflow5_and_8_in_one_pass(spark):
    r = random.Random(1)
    data = [pack(">HHIIIIBBBB", 5, n, 60000, 1756200000, 5, 9, 1, 2, 0x40, 7) + r.randbytes(cut) for n in (0, 1, 3, 30, 31) for cut in (0, 48, 143, 144, 48 * 31)]
    data += [pack(">HHIIIIBBBB", 8, n, 60000, 1756200000, 5, 9, 1, 2, m, agg) + bytes(4) + r.randbytes(cut) for m in (*range(16), 255) for n, cut in ((0, 44), (1, 44), (2, 88), (2, 50)) for agg in (1, 2)]
    df = datagrams(spark, *data, b"\0\5", b"\0\x08\0\1", b"").withColumn("kind", batch.version(F.col("payload")))
    both = fixed.netflow5_and_8(df.where(F.col("kind").isin("netflow_v5", "netflow_v8")))
    names = ["arrival_seq", "exporter", "version", "odid", "direction", "flows_reported", "sampling_rate", *fixed.COLUMNS]
    apart = fixed.netflow5(df.where("kind = 'netflow_v5'"))[0].select(names).unionByName(fixed.netflow8(df.where("kind = 'netflow_v8'"))[0].select(names))
    show = lambda x: sorted((repr(tuple(row)) for row in x.select(names).collect()))
    assert show(both) == show(apart) and both.count() > 70


def test_datagrams_are_made_twice_for_all_protocols(spark):
    plan = registered.QUERIES["decode_ipfix"](spark, str(oracle.SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # four before: one for each of four branches


def test_encoded_fields(spark):
    rows = {c: 3 + i for i, c in enumerate(("src", "dst", "src_port", "dst_port", "protocol", "tos", "tcp_flags", "src_mask", "dst_mask", "input_if", "output_if", "packets", "src_as", "dst_as", "first", "last"))}
    made = spark.createDataFrame([rows | {"arrival_seq": 0x01020304, "bytes": (1 << 31) + 5}])
    raw = bytes(encoders.encode_ipfix(made).first().payload)
    at = 1756199940000
    assert raw[8:12] == bytes([1, 2, 3, 4])
    assert raw.endswith(pack(">IIHHBBHIIQQIIQQ", 3, 4, 5, 6, 7, 8 >> 2, 9, 12, 13, (1 << 31) + 5, 14, 15, 16, 17 + at, 18 + at))


def test_sflow_dealt_with_other_protocols(spark):
    good = [wire.sflow(wire.sample(wire.sampled_ipv4()))] * 30 + [wire.v9(wire.v9_template(), wire.flowset(300, wire.V9_RECORD))] + [wire.sflow(wire.sample(wire.sampled_ipv4()))[:-1]] * 3
    flows, errors = batch.decode(datagrams(spark, *good))
    assert sorted((r.arrival_seq, r.version) for r in flows.collect()) == [(i, "sflow_v5") for i in range(30)] + [(30, "netflow_v9")]
    assert sorted((r.arrival_seq, r.reason) for r in errors.collect()) == [(i, "malformed") for i in range(31, 34)]


@pytest.mark.parametrize(
    ("told", "asks", "want"),
    [
        ([(1, 32)], 1, (32, False)), ([(1, 32)], None, (32, False)), ([(1, 32), (2, 1024)], None, (0, True)), ([(None, 32)], None, (32, False)), ([(1, 32)], 2, (32, False)),
        ([(1, 32), (1, 64)], 1, (64, False)), ([(1, 32)], 0, (0, False)), ([(0, 32)], 0, (32, False)),
    ],
)
def test_sampling(told, asks, want):
    d = Declarations()
    for sampler, rate in told:
        d.declare(5, sampler, rate)
    assert d.resolve(5, asks) == want


def test_sampling_of_other_domains_and_scopes():
    d = Declarations()
    d.declare(1, None, 32)
    assert d.resolve(2) == (32, False)
    d.declare_scope(("interface", 2, 9), 8)
    assert d.resolve(2, scopes=[("template", 2, 0, 300), ("interface", 2, 9)]) == (8, False)
    d.declare(3, 7, 10)
    d.declare(4, 7, 20)
    assert d.resolve(5, 7) == (0, True)


def test_options_record_declares_a_rate():
    d = Device()
    layout = wire.flowset(1, pack(">HHH", 301, 4, 8) + pack(">HH", 1, 4) + pack(">HH", 48, 1) + pack(">HH", 34, 4))
    fields = [(48, 1), (1, 4)]
    d.decode(wire.v9(layout, wire.flowset(301, pack(">IBI", 0, 1, 64)), wire.v9_template(302, fields)))
    assert d.decode(wire.v9(wire.flowset(302, pack(">BI", 1, 5))))[0][0]["sampling_rate"] == 64


def test_applications_are_learnt():
    d = Device()
    layout = wire.flowset(1, pack(">HHH", 303, 4, 8) + pack(">HH", 1, 4) + pack(">HH", 95, 4) + pack(">HH", 96, 8))
    d.decode(wire.v9(layout, wire.flowset(303, pack(">I", 0) + b"\x0d\0\0\x2a" + b"web\0\0\0\0\0"), wire.v9_template(304, [(95, 4), (1, 4)])))
    row = d.decode(wire.v9(wire.flowset(304, b"\x0d\0\0\x2a" + pack(">I", 5))))[0][0]
    assert (row["app_id"], row["app_name"]) == (13 << 24 | 42, "web")


def test_sequences():
    def run(tracker, rows):
        t = tracker()
        for r in rows:
            t.see(*r)
        return t

    assert run(PacketLoss, [(n,) for n in (10, 11, 15, 14, 16)]).missed == 3
    assert run(PacketLoss, [((1 << 32) - 1,), (1,)]).missed == 1
    assert run(RecordLoss, [(10, 5), (15, 5), (25, 5)]).missed == 5
    assert run(RecordLoss, [(10, 5), (100, 5, 0, False), (500, 5)]).missed == 85
    pool = run(SamplePool, [(1, 100, 1000, 0), (2, 100, 1100, 3), (3, 200, 9000, 9), (4, 200, 9200, 10)])
    assert (pool.pool, pool.drops) == (300, 4)


@pytest.mark.parametrize(
    ("uptime", "first", "last", "want"),
    [
        (120000, 30000, 45000, (-90_000, -75_000)), (100000, (1 << 32) - 10000, (1 << 32) - 5000, (-110_000, -105_000)), (1000, (1 << 32) - 1000, 500, (-2000, -500)), (120000, 121000, 122000, (1000, 2000)),
        (120000, 3720000, 3720001, (-((1 << 32) - 3600000), -((1 << 32) - 3600001))),
    ],
)
def test_clock(spark, uptime, first, last, want):
    from pyspark.sql import functions as F

    at = 1756300000_000
    assert [(templated.anchored(at * 1000, uptime, x) - at * 1000) // 1000 for x in (first, last)] == list(want)
    row = spark.range(1).select(*[records.anchored_ms(F.lit(at), F.lit(uptime).cast("long"), F.lit(x).cast("long")).alias(n) for n, x in (("a", first), ("b", last))]).first()
    assert (row.a - at, row.b - at) == want


SEEDS = [wire.v9(wire.v9_template(), wire.flowset(300, wire.V9_RECORD)), wire.ipfix(wire.IPFIX_TEMPLATE, wire.flowset(400, wire.IPFIX_RECORD)), wire.sflow(wire.sample(wire.raw_record(wire.frame(wire.tcp_packet()))))]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(SEEDS), st.lists(st.tuples(st.integers(0, 200), st.integers(0, 255)), max_size=6), st.integers(0, 200))
def test_damaged_datagrams_never_raise(seed, changes, cut):
    raw = bytearray(seed[: len(seed) - cut % len(seed)] if cut % 3 == 0 else seed)
    for at, value in changes:
        if at < len(raw):
            raw[at] = value
    d = Device()
    for _ in range(2):
        rows, errors = d.decode(bytes(raw))
        assert not rows or "malformed" not in errors or bytes(raw[:2]) in (b"\0\x09", b"\0\x0a")
    sflow.decode(bytes(raw))
