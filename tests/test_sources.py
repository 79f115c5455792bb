"""MaxMind files, remote-write bodies, the HTTP front, addresses of both families, saturation, device health."""

import ipaddress
import json
import random
import urllib.error
import urllib.request
from decimal import Decimal
from struct import pack, unpack

import pytest
from pyspark.sql import functions as F

from flowloom.decode import health
from flowloom.decode.templated import Device, Limits
from flowloom.functions import addresses, records
from flowloom.operators import distributions, enrich
from flowloom.plans.pipeline import health_metrics
from flowloom.sources import exposition, files, mmdb, server

from . import wire
from .test_decode import datagrams

# -- MaxMind DB


def _value(x) -> bytes:
    def head(kind, size):
        assert size < 285
        body = bytes([size]) if size < 29 else bytes([29, size - 29])
        return bytes([kind << 5 | body[0]]) + body[1:] if kind < 8 else bytes([body[0], kind - 7]) + body[1:]

    if isinstance(x, dict):
        return head(7, len(x)) + b"".join(_value(k) + _value(v) for k, v in x.items())
    if isinstance(x, str):
        return head(2, len(x.encode())) + x.encode()
    if isinstance(x, list):
        return head(11, len(x)) + b"".join(map(_value, x))
    raw = x.to_bytes((x.bit_length() + 7) // 8, "big")
    return head(6, len(raw)) + raw


def database(networks: dict[str, dict], bits: int) -> bytes:
    """A database of both families with these networks, with an alias of the IPv4 part under 2002::/16."""
    root: list = [None, None]
    data, places = b"", {}
    for text, value in sorted(networks.items(), key=lambda x: ipaddress.ip_network(x[0]).prefixlen):
        net = ipaddress.ip_network(text)
        path = f"{int(net.network_address):032b}".rjust(128, "0")[: net.prefixlen + 96] if net.version == 4 else f"{int(net.network_address):0128b}"[: net.prefixlen]
        raw = _value(value)
        if raw not in places:
            places[raw] = len(data)
            data += raw
        node = root
        for b in path[:-1]:
            if not isinstance(node[int(b)], list):  # a leaf above is split
                node[int(b)] = [node[int(b)], node[int(b)]]
            node = node[int(b)]
        node[int(path[-1])] = ("leaf", places[raw])
    v4 = root
    for _ in range(96):
        v4 = v4[0]
    at = root
    for b in f"{0x2002:016b}"[:-1]:
        at[int(b)] = at[int(b)] if isinstance(at[int(b)], list) else [at[int(b)], at[int(b)]]
        at = at[int(b)]
    at[0] = v4
    order, number = [], {}

    def walk(n):
        if id(n) not in number:
            number[id(n)] = len(order)
            order.append(n)
            for c in n:
                if isinstance(c, list):
                    walk(c)

    walk(root)
    tree = b""
    for n in order:
        a, b = ((number[id(c)] if isinstance(c, list) else len(order) if c is None else len(order) + 16 + c[1]) for c in n)
        if bits == 28:
            tree += (a & 0xFFFFFF).to_bytes(3, "big") + bytes([(a >> 24) << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3, "big")
        else:
            tree += a.to_bytes(bits // 8, "big") + b.to_bytes(bits // 8, "big")
    meta = _value({"node_count": len(order), "record_size": bits, "ip_version": 6, "database_type": "Test", "languages": ["en"]})
    return tree + bytes(16) + data + mmdb.MARK + meta


@pytest.mark.parametrize("bits", [24, 28, 32])
def test_maxmind_files(spark, tmp_path, bits):
    as_of = lambda n, name: {"autonomous_system_number": n, "autonomous_system_organization": name}
    nets = {"192.0.2.0/24": as_of(64500, "Example Net"), "10.0.0.0/8": as_of(64501, "x" * 60), "2001:db8::/32": as_of(64502, "Six"), "198.51.100.128/25": as_of(0, "none")}
    (tmp_path / "asn.mmdb").write_bytes(database(nets, bits))
    got = {(str(ipaddress.ip_address(bytes(r.network))), r.length): (r.asn, r.organization) for r in mmdb.asn_table(spark, str(tmp_path / "asn.mmdb")).collect()}
    assert got == {("192.0.2.0", 24): (64500, "Example Net"), ("10.0.0.0", 8): (64501, "x" * 60), ("2001:db8::", 32): (64502, "Six")}
    (tmp_path / "country.mmdb").write_bytes(database({"192.0.2.0/24": {"country": {"iso_code": "DE"}}, "10.0.0.0/8": {"country": {}}}, bits))
    assert [(bytes(r.network), r.length, r.code) for r in mmdb.country_table(spark, str(tmp_path / "country.mmdb")).collect()] == [(bytes([192, 0, 2, 0]), 24, "DE")]
    (tmp_path / "bad.mmdb").write_bytes(b"not one")
    with pytest.raises(ValueError, match="not a MaxMind"):
        mmdb.asn_table(spark, str(tmp_path / "bad.mmdb"))


# -- remote write


def fields(raw: bytes):
    def varint(at):
        n = shift = 0
        while True:
            n |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                return n, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        if tag & 7 == 2:
            size, at = varint(at)
            yield tag >> 3, raw[at : at + size]
            at += size
        elif tag & 7 == 1:
            yield tag >> 3, unpack("<d", raw[at : at + 8])[0]
            at += 8
        else:
            n, at = varint(at)
            yield tag >> 3, n


def read_request(body: bytes):
    symbols, out = [], []
    for number, raw in fields(body):
        if number == exposition.SYMBOLS:
            symbols.append(raw.decode())
    for number, raw in fields(body):
        if number == exposition.TIMESERIES:
            series = dict(fields(raw))
            refs, at = [], 0
            for b in series[exposition.LABELS_REFS]:  # fewer than 128 symbols: one byte each
                refs.append(b)
                at += 1
            sample = dict(fields(series[exposition.SAMPLES]))
            out.append(([(symbols[a], symbols[b]) for a, b in zip(refs[::2], refs[1::2], strict=True)], sample[exposition.VALUE], sample[exposition.TIMESTAMP], dict(fields(series[exposition.METADATA]))[exposition.METADATA_TYPE]))
    return symbols, out


def test_remote_write_bodies(spark):
    rows = [("flowloom_x_total", {"b": "2", "a": "ü"}, 1.5), ("flowloom_gauge", {"a": "", "z": "2"}, -3.0), ("flowloom_x_total", {}, 2.0**60)]
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, value double").coalesce(1)
    bodies = exposition.requests(df, 1_756_200_000_123, most=2).collect()
    assert [r.series for r in bodies] == [2, 1]
    symbols, series = read_request(bytes(bodies[0].body))
    assert symbols[0] == "" and len(symbols) == len(set(symbols))
    assert series == [([("__name__", "flowloom_x_total"), ("a", "ü"), ("b", "2")], 1.5, 1_756_200_000_123, 1), ([("__name__", "flowloom_gauge"), ("z", "2")], -3.0, 1_756_200_000_123, 2)]


# -- HTTP


def test_http_front():
    calls = []
    s = server.serve(("127.0.0.1", 0), lambda: ["a 1", "b 2"], {"hosts": lambda: {"entries": 1}, "asns": lambda: 1 / 0}, lambda: calls.append(1))
    base = f"http://127.0.0.1:{s.server_address[1]}"

    def ask(path, method="GET"):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, method=method, data=b"" if method == "POST" else None), timeout=10) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, ""

    assert ask("/healthz") == (200, "OK\n") and ask("/metrics") == (200, "a 1\nb 2\n")
    assert json.loads(ask("/entries?aggregation=hosts")[1]) == {"hosts": {"entries": 1}}
    assert [ask(p)[0] for p in ("/entries?aggregation=what", "/entries?aggregation=asns", "/nothing", "/-/reload")] == [400, 500, 404, 405]
    assert ask("/-/reload", "POST")[0] == 200 and calls == [1] and ask("/healthz")[0] == 200
    s.shutdown()


# -- addresses


def test_addresses_as_text(spark):
    r = random.Random(1)
    texts = ["::", "::1", "1::", "2001:db8::1:0:0:1", "2001:0:0:1::", "1:0:0:2::3", "1:0:2:0:3:0:4:0", "fe80::1", "192.0.2.1", "0.0.0.0", "1:2:3:4:5:6:7:8", "0:1:0:1:0:1:0:1"]
    texts += [str(ipaddress.ip_address(bytes(x for _ in range(8) for x in r.choice([(0, 0), (0, 0), (0, 7), (18, 52)])))) for _ in range(200)]
    df = spark.createDataFrame([(bytearray(ipaddress.ip_address(t).packed), t) for t in texts] + [(None, None), (bytearray(b"abc"), None)], "a binary, t string")
    assert df.where(~addresses.text(F.col("a"), "binary").eqNullSafe(F.col("t"))).count() == 0
    assert df.where("t is not null").select(files.as_bytes(F.col("t")).alias("b"), "a").where("b <> a").count() == 0
    private = {t for t in ("10.1.2.3", "172.31.0.1", "172.32.0.1", "192.168.5.5", "fc00::1", "fdff::", "fe80::1", "::1")}
    got = spark.createDataFrame([(bytearray(ipaddress.ip_address(t).packed), t) for t in private], "a binary, t string").where(addresses.is_private(F.col("a"), "binary"))
    assert {x.t for x in got.collect()} == {"10.1.2.3", "172.31.0.1", "192.168.5.5", "fc00::1", "fdff::"}


def test_longest_prefixes_of_both_families(spark):
    r = random.Random(2)
    some = lambda family: ipaddress.ip_address(bytes([32, 1, *(r.choice([0, 0, 1, 255]) for _ in range(14))]) if family == 6 else bytes([10, *(r.choice([0, 1, 255]) for _ in range(3))]))
    nets = {ipaddress.ip_network((some(f), n), strict=False) for f, lengths in ((4, (8, 9, 17, 24, 32)), (6, (16, 32, 47, 63, 64, 65, 96, 127, 128))) for n in lengths for _ in range(4)}
    table = spark.createDataFrame([(bytearray(n.network_address.packed), n.prefixlen, str(n)) for n in nets], "network binary, length int, name string")
    asked = [some(f) for f in (4, 6) for _ in range(100)]
    df = spark.createDataFrame([(bytearray(a.packed), str(a)) for a in asked] + [(None, "none")], "a binary, t string")
    for row in enrich.longest_prefix(df, table, "a", {"name": "found"}).collect():
        inside = [n for n in nets if row.t != "none" and ipaddress.ip_address(row.t) in n]
        assert row.found == (str(max(inside, key=lambda n: n.prefixlen)) if inside else None)


# -- counters


@pytest.mark.parametrize(("rows", "want"), [([(2**63, 1000)], 2**64 - 1), ([(2**63, 1), (2**63, 1)], 2**64 - 1), ([(2**63, 1), (2**63 - 1, 0)], 2**64 - 1), ([(2**62, 1), (None, 5), (3, 7)], 2**62 + 21), ([(None, 1)], 0)])
def test_sums_stop_at_the_end_of_their_range(spark, rows, want):
    df = spark.createDataFrame([(None if c is None else Decimal(c), r) for c, r in rows], "c decimal(20,0), r long")
    assert df.agg(records.total(F.col("c"), F.col("r")).alias("x")).first().x == want


def test_narrowing_fits_its_bound(spark):
    hist = spark.createDataFrame([("a", 2 * i, 1) for i in range(201)] + [("b", i, 1) for i in range(200)] + [("a", None, 5)], "exporter string, bucket long, n long")
    got = distributions.narrowed(hist, 200).collect()
    used = {e: sum(r.exporter == e and r.bucket is not None for r in got) for e in "ab"}
    assert used["b"] == 200 and 100 <= used["a"] <= 200 and sum(r.n for r in got) == 406


# -- health of devices


def test_health_of_datagrams(spark):
    data = datagrams(spark, wire.v9(wire.v9_template(), seq=10), *(wire.v9(wire.flowset(300, wire.V9_RECORD), seq=s) for s in (11, 15, 14, 16)))
    rows = {(r.version, r.metric): r.value for r in health.of_datagrams(data).collect()}
    assert rows["netflow_v9", "sequence_missed"] == 3 and rows["netflow_v9", "templates"] == 1


def test_health_metrics(spark):
    data = datagrams(spark, wire.v9(wire.v9_template(), wire.flowset(300, wire.V9_RECORD), seq=1), wire.v9(wire.flowset(999, b"1234"), seq=2), b"xx")
    rows = [(r.metric.removeprefix("flowloom_"), dict(r.labels), r.value) for r in health_metrics(data).collect()]
    assert ("flows_total", "netflow_v9", 1.0) in [(m, x.get("version"), v) for m, x, v in rows]
    errors = {x["reason"]: v for m, x, v in rows if m == "decode_errors_total"}
    assert errors == {"missing_template": 1.0, "malformed": 1.0}
    assert [v for m, x, v in rows if m == "templates"] == [1.0] and [v for m, _, v in rows if m == "strings_refused_total"] == [0.0]


def test_limits_of_a_device():
    d = Device(Limits(domains=1, ttl=10.0, layouts=1))
    v9 = lambda odid, *sets: pack(">HHIIII", 9, 1, 0, 0, 1, odid) + b"".join(sets)
    layout = lambda k, *elements: pack(">HH", 0, 8 + 4 * len(elements)) + pack(">HH", k, len(elements)) + b"".join(pack(">HH", *e) for e in elements)
    assert d.decode(v9(1, layout(300, (1, 4), (9999, 4))), 0, 0.0)[1] == []
    assert d.decode(v9(1, layout(301, (1, 4))), 0, 1.0)[1] == ["invalid_template"]
    assert d.decode(v9(2), 0, 5.0)[1] == ["domain_limit"]
    assert d.decode(v9(2), 0, 20.0)[1] == []  # the first has been idle and makes room
    notes = {(v, o, k): n for v, o, k, n in d.notes()}
    assert notes["", None, "domains_refused"] == 1 and notes["", None, "layouts_refused"] == 1 and notes["", None, "unread 0:9999"] == 1


# -- NetFlow 8, from bytes put together by the public record layouts

_S = (3, 40, 5000, 1000, 4000)  # flows, packets, bytes, first, last
_A, _B = bytes([10, 1, 2, 3]), bytes([192, 0, 2, 9])
V8_RECORDS = {
    1: (pack(">5I4H", *_S, 64500, 64501, 3, 4), {"src_as": 64500, "dst_as": 64501, "input_if": 3, "output_if": 4}),
    2: (pack(">5IBBHHH", *_S, 17, 0, 0, 5353, 53), {"protocol": 17, "src_port": 5353, "dst_port": 53}),
    3: (pack(">5I4sBBHHH", *_S, _A, 24, 0, 64500, 3, 0), {"src_addr": _A, "src_mask": 24, "src_as": 64500, "input_if": 3}),
    4: (pack(">5I4sBBHHH", *_S, _B, 25, 0, 64501, 4, 0), {"dst_addr": _B, "dst_mask": 25, "dst_as": 64501, "output_if": 4}),
    5: (pack(">5I4s4sBBHHHHH", *_S, _A, _B, 25, 24, 0, 64500, 64501, 3, 4), {"src_addr": _A, "dst_addr": _B, "dst_mask": 25, "src_mask": 24, "src_as": 64500, "dst_as": 64501, "input_if": 3, "output_if": 4}),
    6: (pack(">4s4IHBBII", _B, *_S[1:], 4, 184, 0, 7, 8), {"dst_addr": _B, "output_if": 4, "tos": 184, "flows": 1}),
    7: (pack(">4s4s4IHHBBHII", _B, _A, *_S[1:], 4, 3, 184, 0, 0, 7, 8), {"dst_addr": _B, "src_addr": _A, "output_if": 4, "input_if": 3, "tos": 184, "flows": 1}),
    8: (pack(">4s4sHH4IHHBBBBII", _B, _A, 53, 5353, *_S[1:], 4, 3, 184, 17, 0, 0, 7, 8), {"dst_addr": _B, "src_addr": _A, "dst_port": 53, "src_port": 5353, "output_if": 4, "input_if": 3, "tos": 184, "protocol": 17, "flows": 1}),
    9: (pack(">5I4HBBH", *_S, 64500, 64501, 3, 4, 184, 0, 0), {"src_as": 64500, "dst_as": 64501, "input_if": 3, "output_if": 4, "tos": 184}),
    10: (pack(">5IBBHHHHH", *_S, 17, 184, 0, 5353, 53, 3, 4), {"protocol": 17, "tos": 184, "src_port": 5353, "dst_port": 53, "input_if": 3, "output_if": 4}),
    11: (pack(">5I4sBBHHH", *_S, _A, 24, 184, 64500, 3, 0), {"src_addr": _A, "src_mask": 24, "tos": 184, "src_as": 64500, "input_if": 3}),
    12: (pack(">5I4sBBHHH", *_S, _B, 25, 184, 64501, 4, 0), {"dst_addr": _B, "dst_mask": 25, "tos": 184, "dst_as": 64501, "output_if": 4}),
    13: (pack(">5I4s4sBBBBHHHH", *_S, _A, _B, 25, 24, 184, 0, 64500, 64501, 3, 4), {"src_addr": _A, "dst_addr": _B, "dst_mask": 25, "src_mask": 24, "tos": 184, "src_as": 64500, "dst_as": 64501, "input_if": 3, "output_if": 4}),
    14: (pack(">5I4s4sBBBBHHHH", *_S, _A, _B, 25, 24, 184, 17, 5353, 53, 3, 4), {"src_addr": _A, "dst_addr": _B, "dst_mask": 25, "src_mask": 24, "tos": 184, "protocol": 17, "src_port": 5353, "dst_port": 53, "input_if": 3, "output_if": 4}),
}


def test_netflow8_records(spark):
    from flowloom.decode import fixed

    head = lambda m, n: pack(">HHIIIIBBBBI", 8, n, 10_000, 1_756_200_000, 0, 77, 1, 2, m, 2, 0)
    rows = [(m, "192.0.2.1", 2055, bytearray(head(m, 2) + record * 2)) for m, (record, _) in V8_RECORDS.items()]
    flows, errors = fixed.netflow8(spark.createDataFrame(rows, "arrival_seq long, src_addr string, src_port int, payload binary"))
    assert errors.count() == 0
    got = flows.collect()
    assert len(got) == 28
    for r in got:
        want = {"flows": 3, "packets": 40, "bytes": 5000, "odid": r.arrival_seq, "start_us": 1_756_199_991_000_000, "end_us": 1_756_199_994_000_000} | V8_RECORDS[r.arrival_seq][1]
        for name in ("flows", "packets", "bytes", "src_addr", "dst_addr", "src_port", "dst_port", "protocol", "tos", "src_as", "dst_as", "src_mask", "dst_mask", "input_if", "output_if", "odid", "start_us", "end_us"):
            value = r[name]
            value = bytes(value) if isinstance(value, bytes | bytearray) else value
            assert value == want.get(name, 0 if name in fixed.ZERO_MEANS_NONE else None), (r.arrival_seq, name)
