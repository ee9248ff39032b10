"""A maintained roll-up of events, from which the dashboard, outliers and observations are read.

One scan of a batch gives all facts: an event is exploded to a row for each of them and counted before it moves. ``main`` is by day,
hour, source, host and severity; the others by day and one thing. Counts are exact and add up over batches, so no batch is
ever read again; different values of many are estimated by sketches that merge. A batch that comes again under its name
replaces itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.schema import is_error
from logweave.storage import stored

from . import aggregates as A
from . import anomalies, insights
from .filters import ALL, LogFilter

#: Entity types whose mentions the observations count, and letters of a message that make its pattern.
HOT_TYPES, PATTERN = ("user", "ip", "device", "vm"), 120
KEYS = ("day", "hour", "source_type", "hostname", "severity", "severity_score", "process", "component", "matched_format", "message")
#: What each fact is counted by.
FACTS = {
    "main": ("day", "hour", "source_type", "hostname", "severity", "severity_score"), "process": ("day", "process", "severity_score"), "component": ("day", "component", "severity_score"),
    "format": ("day", "matched_format"), "message": ("day", "message", "hostname", "severity", "severity_score"),
}


def facts(log: DataFrame) -> DataFrame:
    """(fact, KEYS, weight, timestamp, latest, first): all facts of ``log`` by one scan."""
    short = log.withColumn("hour", F.substring("timestamp", 12, 2)).withColumn("message", F.substring("message", 1, PATTERN))
    none = {k: F.lit(None).cast(short.schema[k].dataType) for k in KEYS}

    def of(fact: str) -> F.Column:
        keys = [(F.col(k) if k in FACTS[fact] else none[k]).alias(k) for k in KEYS]
        one = F.struct(F.lit(fact).alias("fact"), *keys)
        return one if fact != "message" else F.when(is_error(), one)  # the messages of errors alone

    each = short.select("timestamp", F.col("id"), F.col("severity").alias("_severity"), F.explode(F.array(*map(of, FACTS))).alias("f")).where("f is not null")
    first = F.min(F.struct("timestamp", "id", F.col("_severity").alias("severity"))).alias("first")
    rows = each.select("f.*", "timestamp", "id", "_severity").groupBy("fact", *KEYS)
    return rows.agg(F.count("*").alias(A.WEIGHT), F.min("timestamp").alias("timestamp"), F.max("timestamp").alias("latest"), first)


def fact_of(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("fact") == name).drop("fact", "batch")


@dataclass
class RollUp:
    spark: SparkSession
    path: str

    def append(self, log: DataFrame, m: DataFrame, batch: str) -> None:
        """Counts a batch of events ``log`` and their mentions ``m(log_id, type, value)``. Events are read once for the facts and
        once for their mentions."""
        # sorted by fact, so that a question opens the row groups of its own
        facts(log).repartitionByRange("fact", "day").sortWithinPartitions("fact", "day").write.mode("overwrite").parquet(f"{self.path}/facts/batch={batch}")
        named = stored(m.groupBy("type", "value").agg(F.count("*").alias(A.WEIGHT)), "named")
        named.where(F.col("type").isin(*HOT_TYPES)).write.mode("overwrite").parquet(f"{self.path}/mentions/batch={batch}")
        sketch = named.groupBy("type").agg(F.hll_sketch_agg("value").alias("sketch"))  # a row for each type
        sketch.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sketches/batch={batch}")

    def fact(self, name: str) -> DataFrame:
        return fact_of(self.spark.read.parquet(f"{self.path}/facts"), name)

    def mentions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/mentions").drop("batch")

    def distinct(self) -> DataFrame:
        """About how many different values each entity type has."""
        sketches = self.spark.read.parquet(f"{self.path}/sketches")
        return sketches.groupBy("type").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("values"))

    def insights(self, flt: LogFilter = ALL) -> DataFrame:
        return insights.build(self.fact("main"), self.mentions(), flt, messages=self.fact("message"))

    def outliers(self, flt: LogFilter = ALL, **how) -> DataFrame:
        return anomalies.detect(self.fact("main"), flt, **how)

    def dashboard(self, flt: LogFilter = ALL) -> dict[str, DataFrame]:
        """A19 by day, source, host and severity: other filters need the events."""
        return A.dashboard(self.fact("main"), flt, {name: self.fact(name) for name in FACTS})
