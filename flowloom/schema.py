"""Column types of the engine's tables. NULL means that the device did not report a field."""

from __future__ import annotations

from pyspark.sql import types as T

DATAGRAMS = T.StructType([
    T.StructField("arrival_seq", T.LongType(), False),
    T.StructField("recv_ts", T.TimestampType()),
    T.StructField("src_addr", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("listener", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])

#: Addresses are binary (4 or 16 bytes); counters are unsigned 64-bit numbers. A zero interface, AS,
#: VLAN, port, protocol, rate or application id is how devices spell "none" and stays zero.
FLOWS = T.StructType([
    T.StructField("exporter", T.StringType()), T.StructField("version", T.StringType()), T.StructField("odid", T.LongType()),
    T.StructField("src_addr", T.BinaryType()), T.StructField("dst_addr", T.BinaryType()),
    T.StructField("src_port", T.IntegerType()), T.StructField("dst_port", T.IntegerType()), T.StructField("protocol", T.ShortType()),
    T.StructField("direction", T.StringType()), T.StructField("tos", T.ShortType()), T.StructField("tcp_flags", T.ShortType()),
    T.StructField("input_if", T.LongType()), T.StructField("output_if", T.LongType()),
    T.StructField("bytes", T.DecimalType(20, 0)), T.StructField("packets", T.DecimalType(20, 0)), T.StructField("flows", T.DecimalType(20, 0)),
    T.StructField("flows_reported", T.BooleanType()), T.StructField("src_as", T.LongType()), T.StructField("dst_as", T.LongType()),
    T.StructField("src_mask", T.ShortType()), T.StructField("dst_mask", T.ShortType()),
    T.StructField("start_us", T.LongType()), T.StructField("end_us", T.LongType()), T.StructField("sampling_rate", T.LongType()),
    T.StructField("app_id", T.LongType()), T.StructField("app_name", T.StringType()), T.StructField("app_category", T.StringType()),
])

ERRORS = ("unsupported_version", "malformed", "unsupported_aggregation", "missing_template", "invalid_template", "reserved_set", "domain_limit", "unsupported_header_protocol")
