"""Rate, ratio and alert rules over counter snapshots.

A snapshot row is (labels..., t, value): a counter's value at an instant (t in seconds). Rates follow
the public definition for counters: increases between neighbouring samples of a range, a fall being
a restart from zero, extrapolated to the range's edges when the samples come near enough to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE = 300


def _in_ranges(snapshots: DataFrame, labels: list[str], step: int, span: int) -> DataFrame:
    """Each sample once for each evaluation instant `at` (multiples of step) with at - span < t <= at, with its series' sample before it."""
    w = Window.partitionBy(*labels).orderBy("t")
    rows = snapshots.withColumns({"t0": F.lag("t").over(w), "v0": F.lag("value").over(w)})
    first = F.ceil(F.col("t") / step) * step
    return rows.withColumn("at", F.explode(F.sequence(first, first + (span - 1) // step * step, F.lit(step)))).where(F.col("t") > F.col("at") - span)


def increase(snapshots: DataFrame, labels: list[str], step: int = 60, span: int = RANGE) -> DataFrame:
    """labels, at, increase: extrapolated growth over (at - span, at]; ranges with fewer than two samples give none."""
    rows = _in_ranges(snapshots, labels, step, span)
    grown = F.when(F.col("t0") > F.col("at") - span, F.when(F.col("value") < F.col("v0"), F.col("value")).otherwise(F.col("value") - F.col("v0"))).otherwise(0.0)
    g = rows.groupBy(*labels, "at").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"), F.min_by("value", "t").alias("v"), F.sum(grown).alias("d")).where("n > 1")
    width = (F.col("b") - F.col("a")).cast("double")
    gap = width / (F.col("n") - 1)
    start, end = (F.col("a") - (F.col("at") - span)).cast("double"), (F.col("at") - F.col("b")).cast("double")
    near = F.when(start >= gap * 1.1, gap / 2).otherwise(start)
    zero = F.when((F.col("d") > 0) & (F.col("v") >= 0), width * F.col("v") / F.nullif(F.col("d"), F.lit(0.0)))  # a counter was not below zero
    near = F.least(near, F.coalesce(zero, near))
    far = F.when(end >= gap * 1.1, gap / 2).otherwise(end)
    return g.select(*labels, "at", (F.col("d") * (width + near + far) / width).alias("increase"))


def rate(snapshots: DataFrame, labels: list[str], step: int = 60, span: int = RANGE) -> DataFrame:
    return increase(snapshots, labels, step, span).select(*labels, "at", (F.col("increase") / span).alias("rate"))


def summed(rates: DataFrame, keep: list[str]) -> DataFrame:
    return rates.groupBy(*keep, "at").agg(F.sum("rate").alias("rate"))


def ratio(top: DataFrame, bottom: DataFrame, on: list[str], name: str) -> DataFrame:
    """top / bottom where bottom is above zero; no row elsewhere."""
    b = bottom.where("rate > 0").withColumnRenamed("rate", "_bottom")
    return top.join(b, [*on, "at"]).select(*[c for c in top.columns if c != "rate"], (F.col("rate") / F.col("_bottom")).alias(name))


def share(rates: DataFrame, within: list[str], name: str = "share") -> DataFrame:
    """Each row's part of its group's sum, where that is above zero."""
    total = F.sum("rate").over(Window.partitionBy(*within, "at"))
    return rates.withColumn("_total", total).where("_total > 0").withColumn(name, F.col("rate") / F.col("_total")).drop("_total", "rate")


def rising(snapshots: DataFrame, labels: list[str], span: int, hold: int, step: int = 60) -> DataFrame:
    """(labels, at, firing): counters that grew in the last `span` seconds, at all evaluations for `hold` seconds."""
    grown = increase(snapshots, labels, step, span).withColumn("firing", F.col("increase") > 0)
    return lasting(grown.select(*labels, "at", "firing"), labels, hold, step)


def idle(snapshots: DataFrame, labels: list[str], span: int, hold: int, step: int = 60) -> DataFrame:
    """(labels, at, firing): counters that are there and did not grow in the last `span` seconds, for `hold` seconds."""
    still = increase(snapshots, labels, step, span).withColumn("firing", F.col("increase") == 0)
    return lasting(still.select(*labels, "at", "firing"), labels, hold, step)


def above(gauge: DataFrame, labels: list[str], limit: float, hold: int, step: int = 60) -> DataFrame:
    """(labels, at, firing): gauges (labels, at, value) above a limit for `hold` seconds."""
    return lasting(gauge.select(*labels, "at", (F.col("value") > limit).alias("firing")), labels, hold, step)


def lasting(condition_rows: DataFrame, labels: list[str], seconds: int, step: int = 60) -> DataFrame:
    """Rows (labels, at, firing) with `firing` only where the condition held at all evaluations of the last `seconds`."""
    w = Window.partitionBy(*labels).orderBy("at").rangeBetween(-seconds, 0)
    held = F.min(F.col("firing").cast("int")).over(w) == 1
    whole = F.count("*").over(w) >= seconds // step + 1
    return condition_rows.withColumn("firing", held & whole)


def silent(last_seen: DataFrame, at: Column, after: int) -> DataFrame:
    """Exporters whose last datagram is older than `after` seconds."""
    return last_seen.withColumn("age", at - F.col("last_seen")).withColumn("firing", F.col("age") > after)


def collapsed(gauge: DataFrame, labels: list[str], span: int = 86400, part: float = 0.5) -> DataFrame:
    """A gauge below `part` of its greatest value in the last `span` seconds."""
    most = F.max("value").over(Window.partitionBy(*labels).orderBy("t").rangeBetween(-span, 0))
    return gauge.withColumn("most", most).withColumn("firing", F.col("value") < part * F.col("most"))


def several_rates(rates: DataFrame, domain: list[str]) -> DataFrame:
    """Domains with more than one sampling rate."""
    return rates.groupBy(*domain).agg(F.countDistinct("sampling_rate").cast("long").alias("rates")).where("rates > 1")


def delivered(flows: DataFrame, drops: DataFrame, on: list[str]) -> DataFrame:
    """Flows by flows and drops, from two tables of rates; no row where both are zero."""
    lost = drops.select(*on, "at", F.col("rate").alias("_lost"))
    whole = F.col("rate") + F.col("_lost")
    return flows.join(lost, [*on, "at"]).where(whole > 0).select(*on, "at", (F.col("rate") / whole).alias("delivered"))
