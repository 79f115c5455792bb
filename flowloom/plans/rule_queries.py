"""Recording, alert and audit rules over published counters, and the same in SQL.

The counters of a breakdown are its entries' running totals, read once a tick: a tick is a week of
flows and stands for 60 seconds. Health counters run over the driver's events, three seconds each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import rules
from ..operators.aggregate import BREAKDOWNS
from ..sources import driver_tables as T
from .registered import breakdown_sql, entries, register

WEEK_US, TICK = 604_800_000_000, 60
_T_SQL = f"CAST(start_us // {WEEK_US} * {TICK} AS BIGINT)"


def published(spark, sf_dir: str, name: str, counter: str) -> DataFrame:
    """Snapshots (keys, t, value) of a counter of a breakdown."""
    keys = list(BREAKDOWNS[name].keys)
    at = {"t": (F.floor(F.col("start_us") / WEEK_US) * TICK).cast("long")}
    w = Window.partitionBy(*keys).orderBy("t")
    return entries(spark, sf_dir, name, at).select(*keys, "t", F.sum(counter).over(w).cast("double").alias("value"))


def published_sql(name: str, counter: str) -> str:
    keys = ", ".join(BREAKDOWNS[name].keys)
    return f"SELECT {keys}, t, CAST(sum({counter}) OVER (PARTITION BY {keys} ORDER BY t) AS DOUBLE) AS value FROM ({breakdown_sql(name, f'{_T_SQL} AS t')})"


def increase_sql(source: str, labels: list[str], step: int = TICK, span: int = 300) -> str:
    """Extrapolated growth over (at - span, at] of the snapshots of a source."""
    s = ", ".join(labels)
    return f"""SELECT {s}, "at", d * (w + least(near, CASE WHEN d > 0 AND v >= 0 THEN w * v / d ELSE near END) + far) / w AS increase FROM (
 SELECT *, CASE WHEN st >= w / (n - 1) * 1.1 THEN w / (n - 1) / 2 ELSE st END AS near, CASE WHEN en >= w / (n - 1) * 1.1 THEN w / (n - 1) / 2 ELSE en END AS far FROM (
 SELECT {s}, "at", count(*) AS n, CAST(max(t) - min(t) AS DOUBLE) AS w, CAST(min(t) - ("at" - {span}) AS DOUBLE) AS st, CAST("at" - max(t) AS DOUBLE) AS en, arg_min(value, t) AS v,
  sum(CASE WHEN t0 > "at" - {span} THEN CASE WHEN value < v0 THEN value ELSE value - v0 END ELSE 0 END) AS d
 FROM (SELECT *, unnest(range(CAST(ceil(t / {step}.0) AS BIGINT) * {step}, CAST(ceil(t / {step}.0) AS BIGINT) * {step} + {span}, {step})) AS "at" FROM (
  SELECT {s}, t, value, lag(t) OVER k AS t0, lag(value) OVER k AS v0 FROM ({source}) WINDOW k AS (PARTITION BY {s} ORDER BY t)))
 WHERE t > "at" - {span} GROUP BY {s}, "at" HAVING count(*) > 1))"""


def rate_sql(name: str, counter: str, keep: list[str]) -> str:
    inner = increase_sql(published_sql(name, counter), list(BREAKDOWNS[name].keys))
    return f'SELECT {", ".join(keep)}, "at", sum(increase / 300) AS rate FROM ({inner}) GROUP BY {", ".join(keep)}, "at"'


def rate(spark, sf_dir: str, name: str, counter: str, keep: list[str]) -> DataFrame:
    return rules.summed(rules.rate(published(spark, sf_dir, name, counter), list(BREAKDOWNS[name].keys)), keep)


def _rounded(df: DataFrame, column: str, digits: int = 4) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


_ED = ["exporter", "direction"]
#: rule, breakdown, counter, the labels that stay
RECORDED = [
    ("rate5m_exporter", "exporters", "bytes", _ED), ("rate5m_exporter_packets", "exporters", "packets", _ED), ("rate5m_exporter_flows", "exporters", "flows", _ED),
    ("country_src_rate", "countries", "bytes", [*_ED, "src_country"]), ("country_dst_rate", "countries", "bytes", [*_ED, "dst_country"]),
    ("country_src_flows", "countries", "flows", [*_ED, "src_country"]), ("country_dst_flows", "countries", "flows", [*_ED, "dst_country"]),
    ("asn_src_rate", "asns", "bytes", [*_ED, "src_as"]), ("asn_dst_rate", "asns", "bytes", [*_ED, "dst_as"]), ("dscp_rate", "dscp", "bytes", [*_ED, "dscp"]),
    ("dest_proto_port_bytes", "destinations", "bytes", [*_ED, "protocol", "port", "endpoint"]), ("dest_proto_port", "destinations", "packets", [*_ED, "protocol", "port", "endpoint"]),
    ("dest_proto_port_flows", "destinations", "flows", [*_ED, "protocol", "port", "endpoint"]), ("dest_proto_packets", "destinations", "packets", [*_ED, "protocol", "endpoint"]),
    ("flag_rate", "tcp_flags", "flows", [*_ED, "tcp_flags"]), ("threat_endpoint_bytes", "threats", "bytes", [*_ED, "endpoint"]), ("threat_endpoint_rate", "threats", "flows", [*_ED, "endpoint"]),
]
for _name, _of, _counter, _keep in RECORDED:
    register(_name, f'SELECT {", ".join(_keep)}, "at", round(rate, 4) AS rate FROM ({rate_sql(_of, _counter, _keep)})')(lambda s, d, x=(_of, _counter, _keep): _rounded(rate(s, d, *x), "rate"))


def _ratio_sql(top: str, bottom: str, by: list[str], name: str) -> str:
    on = " AND ".join(f"a.{c} = b.{c}" for c in by)
    return f'SELECT {", ".join(f"a.{c}" for c in by)}, a."at", round(a.rate / b.rate, 4) AS {name} FROM ({top}) a JOIN ({bottom}) b ON {on} AND a."at" = b."at" WHERE b.rate > 0'


def _register_ratio(name: str, column: str, top: tuple[str, str], bottom: tuple[str, str]) -> None:
    register(name, _ratio_sql(rate_sql(*top, _ED), rate_sql(*bottom, _ED), _ED, column))(
        lambda s, d: _rounded(rules.ratio(rate(s, d, *top, _ED), rate(s, d, *bottom, _ED), _ED, column), column)
    )


_register_ratio("bytes_per_packet", "bytes_per_packet", ("exporters", "bytes"), ("exporters", "packets"))
_register_ratio("coverage_ratio", "coverage", ("destinations", "bytes"), ("exporters", "bytes"))


def _register_share(name: str, of: str, counter: str, label: str) -> None:
    keep = [*_ED, label]
    sql = f'SELECT {", ".join(keep)}, "at", round(rate / total, 4) AS share FROM (SELECT *, sum(rate) OVER (PARTITION BY exporter, direction, "at") AS total FROM ({rate_sql(of, counter, keep)})) WHERE total > 0'
    register(name, sql)(lambda s, d: _rounded(rules.share(rate(s, d, of, counter, keep), _ED), "share"))


_register_share("dscp_share", "dscp", "bytes", "dscp")
_register_share("flag_share", "tcp_flags", "flows", "tcp_flags")


# -- health counters over events: event i happens at second 3 i

#: counter -> its labels and by how much an event raises it, as (Spark, SQL)
_DEVICE = ("exporter", "concat('192.0.2.', cast(1 + user_id % 5 AS {text}))")
_LISTENER = ("listener", "concat('udp:', cast(2055 + user_id % 3 AS {text}))")
COUNTERS = {
    "receiver_packets": ([_LISTENER], "CASE WHEN event_id % 2000 < 1400 THEN 1 + user_id % 3 ELSE 0 END"),
    "receiver_dropped": ([_LISTENER, ("reason", "CASE WHEN user_id % 2 = 0 THEN 'queue_full' ELSE 'truncated' END")], "CASE WHEN event_id % 1500 < 400 AND user_id % 7 = 0 THEN 1 ELSE 0 END"),
    "decode_errors": ([_DEVICE, ("reason", "CASE user_id % 3 WHEN 0 THEN 'missing_template' WHEN 1 THEN 'malformed' ELSE 'reserved_set' END")], "CASE WHEN event_id % 1200 < 500 AND user_id % 4 < 2 THEN 1 ELSE 0 END"),
    "sequence_missed": ([_DEVICE, ("odid", "user_id % 2")], "CASE WHEN event_id % 900 < 200 THEN user_id % 3 ELSE 0 END"),
    "overflow_records": ([("aggregation", "CASE user_id % 3 WHEN 0 THEN 'hosts' WHEN 1 THEN 'services' ELSE 'destinations' END")], "CASE WHEN event_id % 1100 < 300 THEN 1 ELSE 0 END"),
    "strings_refused": ([_DEVICE], "CASE WHEN event_id % 4000 < 900 AND user_id % 5 < 2 THEN 1 ELSE 0 END"),
}


def health_counter(spark, sf_dir: str, name: str) -> DataFrame:
    labels, growth = COUNTERS[name]
    e = T.table(spark, sf_dir, "events").select((F.col("event_id") * 3).alias("t"), *[F.expr(x.replace("{text}", "string")).alias(n) for n, x in labels], F.expr(growth).alias("more"))
    return e.withColumn("value", F.sum("more").over(Window.partitionBy(*[n for n, _ in labels]).orderBy("t")).cast("double")).drop("more")


def health_counter_sql(name: str) -> str:
    labels, growth = COUNTERS[name]
    names = ", ".join(n for n, _ in labels)
    said = ", ".join(f"{x.replace('{text}', 'VARCHAR')} AS {n}" for n, x in labels)
    return f"SELECT t, {names}, CAST(sum(more) OVER (PARTITION BY {names} ORDER BY t) AS DOUBLE) AS value FROM (SELECT event_id * 3 AS t, {said}, {growth} AS more FROM events)"


def _lasting_sql(rows: str, labels: list[str], hold: int, step: int) -> str:
    names = ", ".join(labels)
    return f'SELECT {names}, "at", min(CAST(firing AS INTEGER)) OVER w = 1 AND count(*) OVER w >= {hold // step + 1} AS firing FROM ({rows}) WINDOW w AS (PARTITION BY {names} ORDER BY "at" RANGE BETWEEN {hold} PRECEDING AND CURRENT ROW)'


STEP = 300
#: alert, counter, only these rows, span, hold, whether it fires on growth or on none
ALERTS = [
    ("alert_receiver_idle", "receiver_packets", "true", 900, 900, False), ("alert_receiver_dropping", "receiver_dropped", "true", 900, 300, True),
    ("alert_decode_errors", "decode_errors", "reason <> 'missing_template'", 900, 300, True), ("alert_templates_missing", "decode_errors", "reason = 'missing_template'", 1800, 1800, True),
    ("alert_sequence_loss", "sequence_missed", "true", 900, 300, True), ("alert_overflow", "overflow_records", "true", 900, 300, True),
    ("alert_strings_refused", "strings_refused", "true", 3600, 900, True),
]


def _register_alert(name: str, counter: str, only: str, span: int, hold: int, growth: bool) -> None:
    labels = [n for n, _ in COUNTERS[counter][0]]
    rows = f'SELECT {", ".join(labels)}, "at", increase {">" if growth else "="} 0 AS firing FROM ({increase_sql(f"SELECT * FROM ({health_counter_sql(counter)}) WHERE {only}", labels, STEP, span)})'
    fires = rules.rising if growth else rules.idle
    register(name, _lasting_sql(rows, labels, hold, STEP))(lambda s, d: fires(health_counter(s, d, counter).where(only), labels, span, hold, STEP))


for _alert in ALERTS:
    _register_alert(*_alert)

_NOW = "(SELECT max(epoch_us(ts) // 1000000) FROM events)"


@register("alert_silent", f"SELECT user_id, CAST({_NOW} - max(epoch_us(ts) // 1000000) AS BIGINT) AS age, CAST({_NOW} - max(epoch_us(ts) // 1000000) AS BIGINT) > 14400 AS firing FROM events GROUP BY 1")
def alert_silent(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    last = e.groupBy("user_id").agg(F.max("s").alias("last_seen")).withColumn("now", e.agg(F.max("s")).scalar())
    return rules.silent(last, F.col("now"), 14400).select("user_id", "age", "firing")


_GAUGE = "SELECT user_id % 5 AS list, event_id * 60 AS t, max(CAST(floor(value) AS BIGINT)) AS value FROM events GROUP BY 1, 2"


@register("alert_list_collapsed", f"SELECT list, t, value, max(value) OVER w AS most, value < 0.5 * max(value) OVER w AS firing FROM ({_GAUGE}) WINDOW w AS (PARTITION BY list ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)")
def alert_list_collapsed(spark, sf_dir):
    g = T.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("list"), (F.col("event_id") * 60).alias("t")).agg(F.max(F.floor("value")).alias("value"))
    return rules.collapsed(g, ["list"])


_SKIPPED = "SELECT user_id % 2 AS list, event_id * 3 // 60 * 60 AS \"at\", max(CASE WHEN event_id % 3000 < 1700 THEN user_id % 4 ELSE 0 END) AS value FROM events GROUP BY 1, 2"


@register("alert_list_partly_unread", _lasting_sql(f'SELECT list, "at", value > 0 AS firing FROM ({_SKIPPED})', ["list"], 900, 60))
def alert_list_partly_unread(spark, sf_dir):
    skipped = F.when(F.col("event_id") % 3000 < 1700, F.col("user_id") % 4).otherwise(0)
    g = T.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 2).alias("list"), (F.floor(F.col("event_id") * 3 / 60) * 60).alias("at")).agg(F.max(skipped).alias("value"))
    return rules.above(g, ["list"], 0, 900)


# -- audits

_TOLD = "SELECT concat('192.0.2.', CAST(1 + user_id % 8 AS VARCHAR)) AS exporter, user_id % 3 AS odid, 1 + event_id % 4 AS sampler, max_by(10 * (1 + event_id % 2), event_id) AS sampling_rate FROM events GROUP BY 1, 2, 3"


@register(
    "several_rates",
    f"SELECT exporter, odid, count(DISTINCT sampling_rate) AS rates FROM (SELECT exporter, odid, max(sampling_rate) AS sampling_rate FROM ({T.FLOWS_SQL}) GROUP BY 1, 2 UNION ALL SELECT exporter, odid, sampling_rate FROM ({_TOLD})) GROUP BY 1, 2 HAVING count(DISTINCT sampling_rate) > 1",
)
def several_rates(spark, sf_dir):
    """Domains whose rate in force and declared sampler rates are more than one."""
    u, i = F.col("user_id"), F.col("event_id")
    told = T.table(spark, sf_dir, "events").groupBy(F.concat(F.lit("192.0.2."), (1 + u % 8).cast("string")).alias("exporter"), (u % 3).alias("odid"), (1 + i % 4).alias("sampler")).agg(F.max_by(10 * (1 + i % 2), i).alias("sampling_rate"))
    in_force = T.flows(spark, sf_dir).groupBy("exporter", "odid").agg(F.max("sampling_rate").alias("sampling_rate"))
    return rules.several_rates(in_force.unionByName(told.drop("sampler")), ["exporter", "odid"])


_LOST = f"SELECT exporter, odid, {_T_SQL} AS t, sum(output_if % 3) AS lost FROM ({T.FLOWS_SQL}) WHERE version = 'sflow_v5' GROUP BY 1, 2, 3"
_LOST_RATE = f'SELECT exporter, "at", sum(increase / 300) AS rate FROM ({increase_sql(f"SELECT exporter, odid, t, CAST(sum(lost) OVER (PARTITION BY exporter, odid ORDER BY t) AS DOUBLE) AS value FROM ({_LOST})", ["exporter", "odid"])}) GROUP BY 1, 2'
_SFLOW_RATE = f'SELECT exporter, "at", sum(increase / 300) AS rate FROM ({increase_sql(published_sql("exporters", "flows"), list(BREAKDOWNS["exporters"].keys))}) WHERE version = \'sflow_v5\' GROUP BY 1, 2'


@register("sflow_delivered", f'SELECT a.exporter, a."at", round(a.rate / (a.rate + b.rate), 6) AS delivered FROM ({_SFLOW_RATE}) a JOIN ({_LOST_RATE}) b ON a.exporter = b.exporter AND a."at" = b."at" WHERE a.rate + b.rate > 0')
def sflow_delivered(spark, sf_dir):
    """Part of the samples of an sFlow device that arrived, of those that it took."""
    keys = list(BREAKDOWNS["exporters"].keys)
    got = rules.summed(rules.rate(published(spark, sf_dir, "exporters", "flows").where("version = 'sflow_v5'"), keys), ["exporter"])
    at = (F.floor(F.col("start_us") / WEEK_US) * TICK).cast("long").alias("t")
    lost = T.flows(spark, sf_dir).where("version = 'sflow_v5'").groupBy("exporter", "odid", at).agg(F.sum(F.col("output_if") % 3).alias("lost"))
    drops = lost.select("exporter", "odid", "t", F.sum("lost").over(Window.partitionBy("exporter", "odid").orderBy("t")).cast("double").alias("value"))
    return _rounded(rules.delivered(got, rules.summed(rules.rate(drops, ["exporter", "odid"]), ["exporter"]), ["exporter"]), "delivered", 6)
