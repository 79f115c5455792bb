"""Encoders of datagrams with one record each, for round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..decode import fixed

EXPORT_SECONDS, UPTIME_MS = 1756200000, 60000


def _hex(n: Column, size: int) -> Column:
    return F.lpad(F.hex(n.cast("long")), 2 * size, "0")


def _bytes(n: Column, size: int) -> Column:
    """A number that is not negative and fits, big-endian."""
    return F.lpad(F.unhex(F.hex(n)), size, F.lit(b"\0"))


def _fixed(digits: str) -> Column:
    return F.lit(bytes.fromhex(digits))


def _run(fields: list[tuple[str, int]]) -> list[Column]:
    """Bytes of neighbouring fields, by words of up to 8 bytes: one text of digits for several fields."""
    out, word, size = [], None, 0
    for name, width in [*fields, (None, 8)]:
        if size + width > 8 and size:
            out.append(_bytes(word, size))
            word, size = None, 0
        if name:
            n = F.col(name).cast("long") if width == 8 else F.col(name).cast("long").bitwiseAND(F.lit((1 << 8 * width) - 1))
            word, size = (n if word is None else F.shiftleft(word, 8 * width).bitwiseOR(n)), size + width
    return out


def _record(fields: dict[str, tuple[int, int]], length: int) -> Column:
    """Hex digits of a record: each field at its place, zeros between."""
    out, at = [], 0
    for name, (place, size) in sorted(fields.items(), key=lambda x: x[1][0]):
        if place > at:
            out.append(F.lit("00" * (place - at)))
        source, width = {"src_addr": "src", "dst_addr": "dst"}.get(name, name), size or 4
        out.append(_hex(F.lit(0) if name == "sampler" else F.col(source), width))
        at = place + width
    return F.concat(*out, F.lit("00" * (length - at)))


def _datagram(rows: DataFrame, header: Column, record: Column) -> DataFrame:
    return rows.select("arrival_seq", F.lit("192.0.2.1").alias("src_addr"), F.lit(2055).alias("src_port"), F.unhex(F.concat(header, record)).alias("payload"))


def _head(version: int) -> str:
    return f"{version:04X}0001{UPTIME_MS:08X}{EXPORT_SECONDS:08X}00000000"


def encode_v5(rows: DataFrame, rate: int = 0) -> DataFrame:
    return _datagram(rows, F.concat(F.lit(_head(5)), _hex(F.col("arrival_seq") % (1 << 31), 4), F.lit(f"0000{rate:04X}")), _record(fixed.V5_FIELDS, fixed.V5_RECORD))


def encode_v8(rows: DataFrame, method: int) -> DataFrame:
    header = F.concat(F.lit(_head(8)), _hex(F.col("arrival_seq") % (1 << 31), 4), F.lit(f"0000{method:02X}0200000000"))
    return _datagram(rows, header, _record(fixed.V8_FIELDS[method], fixed.V8_LENGTH[method]))


# Element numbers, widths and sources of the layouts that the encoders announce.
V9_LAYOUT = [
    (8, 4, "src"), (12, 4, "dst"), (7, 2, "src_port"), (11, 2, "dst_port"), (4, 1, "protocol"), (5, 1, "tos"), (6, 1, "tcp_flags"), (9, 1, "src_mask"), (13, 1, "dst_mask"), (10, 4, "input_if"),
    (14, 4, "output_if"), (1, 4, "bytes"), (2, 4, "packets"), (16, 4, "src_as"), (17, 4, "dst_as"), (22, 4, "first"), (21, 4, "last"),
]
IPFIX_LAYOUT = [
    (8, 4, "src"), (12, 4, "dst"), (7, 2, "src_port"), (11, 2, "dst_port"), (4, 1, "protocol"), (195, 1, "dscp"), (6, 2, "tcp_flags"), (10, 4, "input_if"), (14, 4, "output_if"), (1, 8, "bytes"),
    (2, 8, "packets"), (16, 4, "src_as"), (17, 4, "dst_as"), (152, 8, "start_ms"), (153, 8, "end_ms"),
]
LAYOUT_ID = 300


def device(rows: DataFrame) -> DataFrame:
    return rows.withColumn("exporter", F.concat(F.lit("192.0.2."), (F.col("arrival_seq") % 8 + 1).cast("string")))


def _set(kind: int, body: Column, size: int) -> Column:
    return F.concat(_fixed(f"{kind:04X}{size + 4:04X}"), body)


def _layout(elements: list[tuple[int, int, str]], kind: int) -> Column:
    body = f"{LAYOUT_ID:04X}{len(elements):04X}" + "".join(f"{n:04X}{size:04X}" for n, size, _ in elements)
    return _set(kind, _fixed(body), len(body) // 2)


def _data(elements: list[tuple[int, int, str]]) -> Column:
    return _set(LAYOUT_ID, F.concat(*_run([(c, size) for _, size, c in elements])), sum(size for _, size, _ in elements))


def _from_device(rows: DataFrame, payload: Column, recv: str | None = None, order: str = "arrival_seq") -> DataFrame:
    seen = (F.lit(None) if recv is None else F.col(recv)).cast("timestamp").alias("recv_ts")
    return rows.select(F.col(order).alias("arrival_seq"), seen, F.col("exporter").alias("src_addr"), F.lit(2055).alias("src_port"), F.lit("udp").alias("listener"), payload.alias("payload"))


def encode_v9(rows: DataFrame, announced: Column | None = None, recv: str | None = None, order: str = "arrival_seq") -> DataFrame:
    """NetFlow 9 datagrams of one record; the layout goes with those for which `announced` holds (default: all). `recv` and `order` are the columns that say when they arrived and in which order."""
    rows = device(rows)
    head = F.concat(_fixed(f"00090001{UPTIME_MS:08X}{EXPORT_SECONDS:08X}"), _bytes(F.col("arrival_seq") % (1 << 31), 4), _fixed("00000007"))
    layout = _layout(V9_LAYOUT, 0)
    return _from_device(rows, F.concat(head, layout if announced is None else F.when(announced, layout).otherwise(F.lit(b"")), _data(V9_LAYOUT)), recv, order)


def encode_ipfix(rows: DataFrame) -> DataFrame:
    """IPFIX messages of a layout and one record."""
    at = EXPORT_SECONDS * 1000 - UPTIME_MS
    rows = device(rows).withColumns({"dscp": F.shiftright(F.col("tos").cast("int"), 2), "start_ms": F.col("first") + at, "end_ms": F.col("last") + at})
    size = 16 + 4 + 4 + 4 * len(IPFIX_LAYOUT) + 4 + sum(n for _, n, _ in IPFIX_LAYOUT)
    head = F.concat(_fixed(f"000A{size:04X}{EXPORT_SECONDS:08X}"), _bytes(F.col("arrival_seq") % (1 << 31), 4), _fixed("00000007"))
    return _from_device(rows, F.concat(head, _layout(IPFIX_LAYOUT, 2), _data(IPFIX_LAYOUT)))


def encode_sflow(rows: DataFrame, rate: int = 10, number: str = "first", pool: Column | None = None, drops: Column | None = None) -> DataFrame:
    """sFlow datagrams with one sample, read by the device itself. `number` is the column that numbers samples and datagrams."""
    pool, drops = _hex(F.lit(1_000_000) if pool is None else pool, 4), _hex(F.lit(0) if drops is None else drops, 4)
    word = lambda c: _hex(F.col(c), 4)
    record = F.concat(F.lit("0000000300000020"), _hex(F.col("bytes") % 65536, 4), word("protocol"), word("src"), word("dst"), word("src_port"), word("dst_port"), word("tcp_flags"), word("tos"))
    sample = F.concat(F.lit("0000000100000048"), word(number), _hex(F.col("input_if"), 4), F.lit(f"{rate:08X}"), pool, drops, word("input_if"), word("output_if"), F.lit("00000001"), record)
    return _from_device(device(rows), F.unhex(F.concat(F.lit("0000000500000001C000023200000007"), F.lit("00000001") if number == "first" else word(number), F.lit("00000000" + "00000001"), sample)))
