"""Sinks: text exposition, JSON listings, and remote write as label tables or request bodies."""

from __future__ import annotations

from collections.abc import Iterable
from struct import pack

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def _number(value: Column) -> Column:
    """Whole numbers that fit in 63 bits without a fraction, others as they are."""
    whole = (value == F.floor(value)) & (F.abs(value) < 2.0**63)
    return F.when(whole, F.floor(value).cast("string")).otherwise(value.cast("string"))


def text_lines(metrics: DataFrame) -> DataFrame:
    """One line of text exposition for each sample (metric, labels, value), labels by name."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), _escaped(e["value"]), F.lit('"')))
    names = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit(""))
    return metrics.select("metric", F.concat("metric", names, F.lit(" "), _number(F.col("value"))).alias("line"))


def exposition(metrics: DataFrame, kind: str = "counter", families: Iterable[str] = ()) -> DataFrame:
    """Lines in order: each metric's type line, then its samples. Metrics named in `families` have a type line also where all their samples are withheld."""
    lines = text_lines(metrics)
    names = lines.select("metric")
    if families:
        names = names.unionByName(metrics.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, families))).alias("metric")))
    types = names.distinct().select("metric", F.concat(F.lit("# TYPE "), "metric", F.lit(f" {kind}")).alias("line"))
    both = types.withColumn("rank", F.lit(0)).unionByName(lines.withColumn("rank", F.lit(1)))
    return both.orderBy("metric", "rank", "line").select("line")


def listing_json(listing: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return listing.select(F.to_json(F.struct("*")).alias("json"))


def symbols(metrics: DataFrame) -> DataFrame:
    """(ref, symbol): every label name and value once; the empty string is 0."""
    words = metrics.select(F.explode(F.concat(F.array(F.lit("__name__"), F.col("metric")), F.map_keys("labels"), F.map_values("labels"))).alias("symbol")).where("symbol <> ''").distinct()
    listed = words.agg(F.array_sort(F.collect_set("symbol")).alias("s"))
    return listed.select(F.posexplode(F.concat(F.array(F.lit("")), F.col("s"))).alias("ref", "symbol"))


def remote_write(metrics: DataFrame, at_ms: int) -> tuple[DataFrame, DataFrame]:
    """(symbols, series): a series has its labels as references, sorted by name, its value and instant."""
    table = symbols(metrics)
    refs = table.agg(F.map_from_entries(F.collect_list(F.struct("symbol", "ref"))).alias("m"))
    labels = F.array_sort(F.map_entries(F.map_concat(F.col("labels"), F.create_map(F.lit("__name__"), F.col("metric")))))
    with_refs = metrics.withColumn("refs", refs.scalar())
    pairs = F.flatten(F.transform(labels, lambda e: F.array(F.element_at("refs", e["key"]), F.element_at("refs", e["value"]))))
    return table, with_refs.select(pairs.alias("labels"), F.col("value"), F.lit(at_ms).alias("timestamp_ms"))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


# Field numbers of the public io.prometheus.write.v2 messages.
SYMBOLS, TIMESERIES = 4, 5
LABELS_REFS, SAMPLES, METADATA = 1, 2, 5
VALUE, TIMESTAMP, METADATA_TYPE = 1, 2, 1
KINDS = {"untyped": 0, "counter": 1, "gauge": 2}


def request(series: list[tuple[str, dict[str, str], float]], at_ms: int) -> bytes:
    """One request of remote write 2.0, not compressed: a symbol table that begins with the empty string, then each series with its labels sorted by name."""
    symbols: dict[str, int] = {"": 0}
    ref = lambda s: symbols.setdefault(s, len(symbols))
    out = []
    for metric, labels, value in series:
        pairs = sorted({"__name__": metric, **{k: v for k, v in labels.items() if v}}.items())
        refs = b"".join(_varint(ref(x)) for p in pairs for x in p)
        sample = _varint(VALUE << 3 | 1) + pack("<d", value) + _varint(TIMESTAMP << 3) + _varint(at_ms)
        kind = KINDS["counter" if metric.endswith("_total") else "gauge"]
        out.append(_field(TIMESERIES, _field(LABELS_REFS, refs) + _field(SAMPLES, sample) + _field(METADATA, _varint(METADATA_TYPE << 3) + _varint(kind))))
    return b"".join(_field(SYMBOLS, s.encode()) for s in symbols) + b"".join(out)


def requests(metrics: DataFrame, at_ms: int, most: int = 2000) -> DataFrame:
    """(series, body) rows: request bodies of at most `most` series each, made where the rows are. Sending them is the caller's."""

    def make(batches):
        for b in batches:
            rows = b.to_pylist()
            for a in range(0, len(rows), most):
                part = [(r["metric"], dict(r["labels"]), r["value"]) for r in rows[a : a + most]]
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([request(part, at_ms)], pa.binary())], ["series", "body"])

    return metrics.select("metric", "labels", "value").mapInArrow(make, "series long, body binary")
