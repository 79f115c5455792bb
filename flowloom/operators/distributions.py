"""Exponential histograms of flow sizes and durations.

A value v lies in bucket i of schema 3 if 2**((i-1)/8) < v <= 2**(i/8). log2 is off by one ulp at some
exact powers, so the index is corrected against the bucket's own bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import is_aggregated

SCHEMA_FACTOR = 8
MOST_BUCKETS = 200


def bucket(v: Column, factor: int = SCHEMA_FACTOR) -> Column:
    """Bucket index of a positive value; NULL for others (they are in the zero bucket)."""
    i = F.ceil(F.log2(v) * factor)
    return F.when(v > 0, F.when(v <= F.pow(F.lit(2.0), (i - 1) / F.lit(float(factor))), i - 1).otherwise(i)).cast("long")


def _plain(flows: DataFrame) -> DataFrame:
    return flows.where(~is_aggregated(F.col("version"), F.col("flows_reported")))


def sizes(flows: DataFrame) -> DataFrame:
    """exporter, value: corrected bytes of flows that reported them."""
    return _plain(flows).where("bytes is not null").select("exporter", (F.col("bytes").cast("double") * F.greatest("sampling_rate", F.lit(1))).alias("value"))


def durations(flows: DataFrame) -> DataFrame:
    """exporter, value: seconds between both instants."""
    return _plain(flows).where("start_us is not null and end_us is not null").select("exporter", ((F.col("end_us") - F.col("start_us")) / 1e6).alias("value"))


def histogram(values: DataFrame) -> DataFrame:
    """exporter, bucket (NULL: zero bucket), n."""
    return values.groupBy("exporter", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def totals(values: DataFrame) -> DataFrame:
    return values.groupBy("exporter").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def narrowed(hist: DataFrame, most: int = MOST_BUCKETS) -> DataFrame:
    """The histogram with its resolution halved, for exporters with more populated buckets than `most`, until they fit.

    A halving joins buckets 2i - 1 and 2i to i. All halvings are tried on a histogram's few buckets, and the least that fits is taken; at 31 of them no two buckets above or below zero are apart."""
    tried = hist.where("bucket is not null").select("exporter", "bucket", F.posexplode(F.array(*[F.lit(float(1 << k)) for k in range(32)])).alias("halvings", "width"))
    fits = tried.groupBy("exporter", "halvings", "width").agg(F.countDistinct(F.ceil(F.col("bucket") / F.col("width"))).alias("used")).where(F.col("used") <= most)
    least = fits.groupBy("exporter").agg(F.min("width").alias("width"))
    scaled = hist.join(least, "exporter", "left").withColumn("bucket", F.ceil(F.col("bucket") / F.coalesce("width", F.lit(1.0))).cast("long"))
    return scaled.groupBy("exporter", "bucket").agg(F.sum("n").alias("n"))


def kept(hist: DataFrame, devices: DataFrame) -> DataFrame:
    """The histograms of devices that are still followed: one that is dropped takes its histogram along."""
    return hist.join(devices.select("exporter").distinct(), "exporter", "left_semi")


def admitted(flows: DataFrame, most: int = 65_536) -> DataFrame:
    """The first `most` devices by arrival, whose records the histograms observe."""
    return flows.groupBy("exporter").agg(F.min("arrival_seq").alias("born")).orderBy("born", "exporter").limit(most)
