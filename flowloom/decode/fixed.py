"""NetFlow 5 and 8: fixed layouts, decoded by column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import anchored_ms, ordered, unsigned

V5_HEADER, V5_RECORD, V5_MOST = 24, 48, 30
V8_HEADER = 28

# Record length of each NetFlow 8 aggregation method.
V8_LENGTH = {1: 28, 2: 28, 3: 32, 4: 32, 5: 40, 6: 32, 7: 40, 8: 44, 9: 32, 10: 32, 11: 32, 12: 32, 13: 40, 14: 40}

# Place and width of each field in the records of a method.
_COUNTS = {"flows": (0, 4), "packets": (4, 4), "bytes": (8, 4), "first": (12, 4), "last": (16, 4)}
_AS = {"src_as": (20, 2), "dst_as": (22, 2), "input_if": (24, 2), "output_if": (26, 2)}
_PORTS = {"protocol": (20, 1), "src_port": (24, 2), "dst_port": (26, 2)}
_SRC = {"src_addr": (20, 0), "src_mask": (24, 1), "src_as": (26, 2), "input_if": (28, 2)}
_DST = {"dst_addr": (20, 0), "dst_mask": (24, 1), "dst_as": (26, 2), "output_if": (28, 2)}
_PREFIX = {"src_addr": (20, 0), "dst_addr": (24, 0), "dst_mask": (28, 1), "src_mask": (29, 1), "src_as": (32, 2), "dst_as": (34, 2), "input_if": (36, 2), "output_if": (38, 2)}
V8_FIELDS = {
    1: _COUNTS | _AS,
    2: _COUNTS | _PORTS,
    3: _COUNTS | _SRC,
    4: _COUNTS | _DST,
    5: _COUNTS | _PREFIX,
    6: {"dst_addr": (0, 0), "packets": (4, 4), "bytes": (8, 4), "first": (12, 4), "last": (16, 4), "output_if": (20, 2), "tos": (22, 1)},
    7: {"dst_addr": (0, 0), "src_addr": (4, 0), "packets": (8, 4), "bytes": (12, 4), "first": (16, 4), "last": (20, 4), "output_if": (24, 2), "input_if": (26, 2), "tos": (28, 1)},
    8: {
        "dst_addr": (0, 0), "src_addr": (4, 0), "dst_port": (8, 2), "src_port": (10, 2), "packets": (12, 4), "bytes": (16, 4), "first": (20, 4), "last": (24, 4),
        "output_if": (28, 2), "input_if": (30, 2), "tos": (32, 1), "protocol": (33, 1),
    },
    9: _COUNTS | _AS | {"tos": (28, 1)},
    10: _COUNTS | _PORTS | {"tos": (21, 1), "input_if": (28, 2), "output_if": (30, 2)},
    11: _COUNTS | _SRC | {"tos": (25, 1)},
    12: _COUNTS | _DST | {"tos": (25, 1)},
    13: _COUNTS | _PREFIX | {"tos": (30, 1)},
    14: _COUNTS | {"src_addr": (20, 0), "dst_addr": (24, 0), "dst_mask": (28, 1), "src_mask": (29, 1), "tos": (30, 1), "protocol": (31, 1), "src_port": (32, 2), "dst_port": (34, 2), "input_if": (36, 2), "output_if": (38, 2)},
}
V5_FIELDS = {
    "src_addr": (0, 0), "dst_addr": (4, 0), "input_if": (12, 2), "output_if": (14, 2), "packets": (16, 4), "bytes": (20, 4), "first": (24, 4), "last": (28, 4),
    "src_port": (32, 2), "dst_port": (34, 2), "tcp_flags": (37, 1), "protocol": (38, 1), "tos": (39, 1), "src_as": (40, 2), "dst_as": (42, 2), "src_mask": (44, 1),
    "dst_mask": (45, 1), "sampler": (46, 2),
}
COLUMNS = ["src_addr", "dst_addr", "src_port", "dst_port", "protocol", "tos", "tcp_flags", "input_if", "output_if", "bytes", "packets", "flows", "src_as", "dst_as", "src_mask", "dst_mask", "start_us", "end_us"]
ZERO_MEANS_NONE = ("src_port", "dst_port", "protocol", "input_if", "output_if", "src_as", "dst_as")


def _field(place: tuple[int, int], record: Column) -> Column:
    at, size = place
    return F.substring("payload", record + at + 1, F.lit(4)) if size == 0 else unsigned(F.col("payload"), record + at, size)


def _columns(fields: dict[str, tuple[int, int]], record: Column, export_ms: Column, uptime: Column) -> dict[str, Column]:
    got = {k: _field(p, record) for k, p in fields.items()}
    start, end = ordered(*(anchored_ms(export_ms, uptime, got.pop(k)) * 1000 for k in ("first", "last")))
    got |= {"start_us": start, "end_us": end}
    got.setdefault("flows", F.lit(1).cast("long"))
    empty = {k: F.lit(0).cast("long") for k in ZERO_MEANS_NONE} | {"src_addr": F.lit(None).cast("binary"), "dst_addr": F.lit(None).cast("binary")}
    return {c: got.get(c, empty.get(c, F.lit(None).cast("long"))) for c in COLUMNS}


def _columns_by_method(methods: dict[int, dict] = V8_FIELDS) -> dict[str, Column]:
    """The columns of a NetFlow 8 record: each field's place is looked up by method, so it is read by one expression."""
    least, most = min(methods), max(methods)
    places = {k for f in methods.values() for k in f}
    fields = {}
    for k in places:
        width = next(f[k][1] for f in methods.values() if k in f)
        place = F.element_at(F.array(*[F.lit(methods[m][k][0] if k in methods.get(m, ()) else None).cast("int") for m in range(least, most + 1)]), F.col("_method").cast("int") - (least - 1))
        at = F.col("_at") + place
        fields[k] = F.substring("payload", at + 1, F.lit(4)) if width == 0 else unsigned(F.col("payload"), at, width)
    start, end = ordered(*(anchored_ms(F.col("_export_ms"), F.col("_uptime"), fields.pop(k)) * 1000 for k in ("first", "last")))
    out = {}
    for c in COLUMNS:
        if c in ("start_us", "end_us"):
            out[c] = start if c == "start_us" else end
        elif c not in fields:
            out[c] = F.lit(None).cast("long")
        else:
            out[c] = F.coalesce(fields[c], F.lit(1 if c == "flows" else 0).cast("long")) if c == "flows" or c in ZERO_MEANS_NONE else fields[c]
    return out


def _number(at: int, size: int) -> Column:
    return unsigned(F.col("payload"), at, size)


def _header(df: DataFrame) -> DataFrame:
    return df.withColumns({"_size": F.octet_length("payload"), "_count": F.coalesce(_number(2, 2), F.lit(0)), "_uptime": _number(4, 4), "_export_ms": _number(8, 4) * 1000 + F.floor(_number(12, 4) / 1_000_000)})


def _exploded(df: DataFrame, header: Column, length: Column) -> DataFrame:
    return df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_count").cast("int") - 1))).withColumn("_at", (header + F.col("_i") * length).cast("int"))


def _good5() -> Column:
    return F.coalesce((F.col("_size") >= V5_HEADER) & F.col("_count").between(1, V5_MOST) & (F.col("_size") >= F.col("_count") * V5_RECORD + V5_HEADER), F.lit(False))


def _good8() -> Column:
    framed = F.coalesce((F.col("_size") >= V8_HEADER) & (F.col("_agg") == 2), F.lit(False))
    return framed & F.col("_length").isNotNull() & F.coalesce(F.col("_count").between(1, 0xFFFF // 28) & (F.col("_size") >= F.col("_count") * F.col("_length") + V8_HEADER), F.lit(False))


def _header8(datagrams: DataFrame) -> DataFrame:
    lengths = F.create_map(*[F.lit(x) for kv in V8_LENGTH.items() for x in kv])
    df = _header(datagrams).withColumns({"_method": _number(22, 1), "_agg": _number(23, 1)})
    return df.withColumn("_length", F.try_element_at(lengths, F.coalesce(F.col("_method"), F.lit(0)).cast("int")))


def netflow5_and_8(datagrams: DataFrame) -> DataFrame:
    """Flow records of datagrams of both protocols, which `kind` tells apart, in one pass; NetFlow 5 is read as method 0."""
    five = F.col("kind") == "netflow_v5"
    # places come from a higher-order function, which ends generated code: what drops other protocols' datagrams stays a short method that the JVM compiles
    header, length = F.when(five, F.lit(V5_HEADER)).otherwise(F.lit(V8_HEADER)), F.when(five, F.lit(V5_RECORD)).otherwise(F.col("_length"))
    count = F.when(F.when(five, _good5()).otherwise(_good8()), F.col("_count").cast("int"))
    df = _header8(datagrams).withColumn("_at", F.transform(F.sequence(F.lit(0), count - 1), lambda i: (header + i * length).cast("int")))
    rows = df.withColumns({"_at": F.explode("_at"), "_method": F.when(five, F.lit(0)).otherwise(F.col("_method"))})
    fields = {k: v for k, v in V5_FIELDS.items() if k != "sampler"}
    cols = [c.alias(n) for n, c in _columns_by_method({0: fields} | V8_FIELDS).items()]
    rate = F.when(five, _number(22, 2).bitwiseAND(F.lit(0x3FFF))).otherwise(F.lit(0).cast("long"))
    return rows.select("arrival_seq", F.col("src_addr").alias("exporter"), F.col("kind").alias("version"), F.col("_method").cast("long").alias("odid"), F.lit("unknown").alias("direction"), F.lit(False).alias("flows_reported"), rate.alias("sampling_rate"), *cols)


def netflow5(datagrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flow records, errors) of NetFlow 5 datagrams."""
    df = _header(datagrams)
    good = _good5()
    rows = _exploded(df.where(good), F.lit(V5_HEADER), F.lit(V5_RECORD))
    cols = _columns(V5_FIELDS, F.col("_at"), F.col("_export_ms"), F.col("_uptime"))
    rate = _number(22, 2).bitwiseAND(F.lit(0x3FFF))
    flows = rows.select("arrival_seq", F.col("src_addr").alias("exporter"), F.lit("netflow_v5").alias("version"), F.lit(0).cast("long").alias("odid"), F.lit("unknown").alias("direction"), F.lit(False).alias("flows_reported"), rate.alias("sampling_rate"), _field(V5_FIELDS["sampler"], F.col("_at")).alias("sampler_id"), *[c.alias(n) for n, c in cols.items()])
    return flows, _errors(df.where(~good), "netflow_v5", F.lit("malformed"))


def netflow8(datagrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flow records, errors) of NetFlow 8 datagrams; the domain is the aggregation method."""
    df = _header8(datagrams)
    good = _good8()
    rows = _exploded(df.where(good), F.lit(V8_HEADER), F.col("_length"))
    cols = [c.alias(n) for n, c in _columns_by_method().items()]
    flows = rows.select("arrival_seq", F.col("src_addr").alias("exporter"), F.lit("netflow_v8").alias("version"), F.col("_method").alias("odid"), F.lit("unknown").alias("direction"), F.lit(False).alias("flows_reported"), F.lit(0).cast("long").alias("sampling_rate"), F.lit(None).cast("long").alias("sampler_id"), *cols)
    framed = F.coalesce((F.col("_size") >= V8_HEADER) & (F.col("_agg") == 2), F.lit(False))
    reason = F.when(framed & F.col("_length").isNull(), F.lit("unsupported_aggregation")).otherwise(F.lit("malformed"))
    return flows, _errors(df.where(~good), "netflow_v8", reason)


def _errors(df: DataFrame, version: str, reason: Column) -> DataFrame:
    return df.select("arrival_seq", F.col("src_addr").alias("exporter"), F.lit(version).alias("version"), reason.alias("reason"))
