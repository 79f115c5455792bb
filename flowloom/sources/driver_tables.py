"""Flow tables derived from the driver's parquet tables, so that every operator can be checked by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records from lineitem. FLOWS_SQL is the same view in SQL."""
    li = table(spark, sf_dir, "lineitem")
    ok, pk, sk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber").cast("long")
    client = (ok % 16384 + 49152).cast("long")
    service = F.element_at(F.array(*map(F.lit, (443, 53, 22, 8080, 50123, 0))), (pk % 6 + 1).cast("int")).cast("long")
    back = ok % 4 == 0
    kind = sk % 4
    epoch = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    return li.select(
        (ok * 10 + ln).alias("arrival_seq"),
        F.concat(F.lit("192.0.2."), (sk % 8 + 1).cast("string")).alias("exporter"),
        F.element_at(F.array(*map(F.lit, ("netflow_v5", "netflow_v8", "netflow_v9", "ipfix", "sflow_v5"))), (ln % 5 + 1).cast("int")).alias("version"),
        (sk % 3).alias("odid"),
        ((pk * 37) % 65536 + 167772160).alias("src_ip"),
        (ok % 256 + 3325256704).alias("dst_ip"),
        F.when(back, service).otherwise(client).alias("src_port"),
        F.when(back, client).otherwise(service).alias("dst_port"),
        F.when(kind == 0, F.lit(17)).when(kind == 1, F.lit(1)).otherwise(F.lit(6)).cast("long").alias("protocol"),
        F.when(F.col("l_returnflag") == "A", "ingress").when(F.col("l_returnflag") == "R", "egress").otherwise("unknown").alias("direction"),
        F.when(F.col("l_linestatus") == "O", (F.floor("l_quantity") * 5) % 256).alias("tos"),
        F.when(pk % 5 != 0, (pk * 7) % 256).alias("tcp_flags"),
        (sk % 5).alias("input_if"),
        ln.alias("output_if"),
        F.when(pk % 97 != 0, F.floor("l_extendedprice")).alias("bytes"),
        F.when(pk % 89 != 0, F.floor("l_quantity")).alias("packets"),
        F.lit(1).cast("long").alias("flows"),
        (ln % 7 == 3).alias("flows_reported"),
        F.when(kind == 0, F.lit(0)).when(kind == 1, F.lit(1)).when(kind == 2, F.lit(100)).otherwise(F.lit(1000)).cast("long").alias("sampling_rate"),
        F.when(pk % 3 == 0, F.lit(0).cast("long")).otherwise(pk % 7 + 64500).alias("src_as"),
        F.when(ok % 2 == 0, F.lit(0).cast("long")).otherwise(ok % 5 + 64600).alias("dst_as"),
        F.when(sk % 5 == 0, (sk % 11) + 13 * 16777216).otherwise(F.lit(0)).cast("long").alias("app_id"),
        F.when(sk % 7 == 0, F.concat(F.lit("app-"), (sk % 3).cast("string"))).alias("app_name"),
        epoch.alias("start_us"),
        F.when(pk % 13 != 0, epoch + F.floor("l_quantity") * 1000000).alias("end_us"),
    )


FLOWS_SQL = """
SELECT l_orderkey * 10 + l_linenumber AS arrival_seq,
 concat('192.0.2.', CAST(1 + l_suppkey % 8 AS VARCHAR)) AS exporter,
 CASE l_linenumber % 5 WHEN 0 THEN 'netflow_v5' WHEN 1 THEN 'netflow_v8' WHEN 2 THEN 'netflow_v9' WHEN 3 THEN 'ipfix' ELSE 'sflow_v5' END AS version,
 l_suppkey % 3 AS odid, 167772160 + (l_partkey * 37) % 65536 AS src_ip, 3325256704 + l_orderkey % 256 AS dst_ip,
 CASE WHEN l_orderkey % 4 = 0 THEN svc ELSE 49152 + l_orderkey % 16384 END AS src_port,
 CASE WHEN l_orderkey % 4 = 0 THEN 49152 + l_orderkey % 16384 ELSE svc END AS dst_port,
 CAST(CASE l_suppkey % 4 WHEN 0 THEN 17 WHEN 1 THEN 1 ELSE 6 END AS BIGINT) AS protocol,
 CASE l_returnflag WHEN 'A' THEN 'ingress' WHEN 'R' THEN 'egress' ELSE 'unknown' END AS direction,
 CASE WHEN l_linestatus = 'O' THEN (CAST(floor(l_quantity) AS BIGINT) * 5) % 256 END AS tos,
 CASE WHEN l_partkey % 5 <> 0 THEN (l_partkey * 7) % 256 END AS tcp_flags,
 l_suppkey % 5 AS input_if, CAST(l_linenumber AS BIGINT) AS output_if,
 CASE WHEN l_partkey % 97 <> 0 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS bytes,
 CASE WHEN l_partkey % 89 <> 0 THEN CAST(floor(l_quantity) AS BIGINT) END AS packets,
 CAST(1 AS BIGINT) AS flows, l_linenumber % 7 = 3 AS flows_reported,
 CAST(CASE l_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 100 ELSE 1000 END AS BIGINT) AS sampling_rate,
 CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 64500 + l_partkey % 7 END AS src_as,
 CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE 64600 + l_orderkey % 5 END AS dst_as,
 CASE WHEN l_suppkey % 5 = 0 THEN l_suppkey % 11 + 13 * 16777216 ELSE 0 END AS app_id,
 CASE WHEN l_suppkey % 7 = 0 THEN concat('app-', CAST(l_suppkey % 3 AS VARCHAR)) END AS app_name,
 epoch_us(l_shipdate) AS start_us,
 CASE WHEN l_partkey % 13 <> 0 THEN epoch_us(l_shipdate) + CAST(floor(l_quantity) AS BIGINT) * 1000000 END AS end_us
FROM (SELECT *, CASE l_partkey % 6 WHEN 0 THEN 443 WHEN 1 THEN 53 WHEN 2 THEN 22 WHEN 3 THEN 8080 WHEN 4 THEN 50123 ELSE 0 END AS svc FROM lineitem)
"""

# Small lookup tables for the registered queries; both engines read the same rows.
PREFIXES = [  # exporter, network, length, vlan id, name
    ("192.0.2.1", 167772160, 8, 10, "campus"), ("192.0.2.1", 167772160, 18, 20, "servers"), ("192.0.2.1", 167772160, 24, 30, None),
    ("192.0.2.2", 167788544, 18, 99, "other-site"), ("192.0.2.3", 3325256704, 25, 40, "dmz"), ("192.0.2.3", 3325256704, 28, 41, "edge"),
]
COUNTRIES = [(3325256704, 25, "US"), (3325256832, 26, "DE"), (3325256832, 28, "FR"), (167772160, 9, "JP")]  # network, length, code
ASNS = [(3325256704, 24, 64999, "Example Net"), (3325256832, 25, 65001, "Other Net"), (167772160, 10, 65010, ""), (167804928, 17, 65020, "Campus Net")]  # network, length, number, organisation
THREATS = [167772160 + (i * 37) % 65536 for i in range(0, 400, 7)] + [3325256704 + 66, 3325256704 + 200]
INTERFACES = [("192.0.2.1", 1, "uplink"), ("192.0.2.2", 2, "core"), ("192.0.2.3", 4, "peering"), ("192.0.2.4", 3, "lab")]
DEVICES = [("192.0.2.1", "edge-1"), ("192.0.2.2", "edge-2"), ("192.0.2.3", "core-1")]
MAPPED_SERVICES = [(6, 50123, "backup"), (17, 50123, "telemetry")]  # protocol, port, name
