"""Datagrams laid out byte by byte."""

from ipaddress import ip_address
from struct import pack


def a(text):
    return ip_address(text).packed


def v5(count=1, uptime=60000, secs=1756200000, nanos=500_000_000, seq=42, engine=(0, 1), sampling=100, sampler=0):
    head = pack(">HHIIIIBBH", 5, count, uptime, secs, nanos, seq, *engine, sampling)
    one = a("10.0.0.1") + a("198.51.100.7") + a("10.0.0.254") + pack(">HHIIIIHH", 3, 4, 1000, 512000, 30000, 45000, 51234, 443) + pack(">BBBBHHBBH", 0, 0x1B, 6, 0xB8, 64500, 64501, 24, 25, sampler)
    return head + one * count


V9_FIELDS = [(8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (5, 1), (6, 1), (9, 1), (13, 1), (10, 4), (14, 4), (1, 4), (2, 4), (16, 4), (17, 4), (22, 4), (21, 4)]
V9_RECORD = a("10.0.0.1") + a("198.51.100.7") + pack(">HHBBBBB", 51234, 443, 6, 0xB8, 0x1B, 24, 25) + pack(">IIIIIIII", 3, 4, 512000, 1000, 64500, 64501, 30000, 45000)


def flowset(kind, body):
    return pack(">HH", kind, 4 + len(body)) + body


def v9_template(number=300, fields=V9_FIELDS):
    return flowset(0, pack(">HH", number, len(fields)) + b"".join(pack(">HH", *f) for f in fields))


def v9(*sets, uptime=120000, secs=1756300000, seq=1, odid=256):
    return pack(">HHIIII", 9, len(sets), uptime, secs, seq, odid) + b"".join(sets)


def ipfix(*sets, secs=1756400000, seq=1, odid=512):
    body = b"".join(sets)
    return pack(">HHIII", 10, 16 + len(body), secs, seq, odid) + body


IPFIX_TEMPLATE = flowset(2, pack(">HH", 400, 10) + b"".join(pack(">HH", *f) for f in [(27, 16), (28, 16), (7, 2), (11, 2), (4, 1)]) + pack(">HHI", 0x8000 | 9999, 4, 12325) + b"".join(pack(">HH", *f) for f in [(1, 8), (2, 8), (152, 8), (153, 8)]))
IPFIX_RECORD = a("2001:db8::1") + a("2001:db8::2") + pack(">HHB", 51234, 443, 6) + b"\1\2\3\4" + pack(">QQQQ", 512000, 1000, 1756400100000, 1756400160000)


def tcp_packet(tos=0xB8, flags=0x18, proto=6, fragment=0):
    ip = pack(">BBHHHBBH", 0x45, tos, 52, 1, fragment, 64, proto, 0) + a("10.0.0.1") + a("198.51.100.7")
    return ip + pack(">HHIIBBHHH", 51234, 443, 1, 0, 0x50, flags, 100, 0, 0)


def frame(packet, tags=()):
    return b"\2" * 12 + b"".join(pack(">HH", 0x8100, t) for t in tags) + pack(">H", 0x0800) + packet


def raw_record(header, length=1518, protocol=1):
    body = pack(">IIII", protocol, length, 4, len(header)) + header
    return pack(">II", 1, len(body)) + body


def sampled_ipv4(length=700):
    body = pack(">II", length, 17) + a("10.0.0.9") + a("198.51.100.9") + pack(">IIII", 1111, 53, 0, 0x20)
    return pack(">II", 3, len(body)) + body


def sample(*records, seq=900, source=0x01000003, rate=1000, pool=1000000, drops=2, inward=3, outward=4):
    body = pack(">IIIIIIII", seq, source, rate, pool, drops, inward, outward, len(records)) + b"".join(records)
    return pack(">II", 1, len(body)) + body


def sflow(*samples, seq=5, agent=7):
    return pack(">II", 5, 1) + a("192.0.2.50") + pack(">IIII", agent, seq, 555000, len(samples)) + b"".join(samples)
