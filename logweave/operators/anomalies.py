"""Robust outliers of daily volume, daily error rate and hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.schema import is_error

from .aggregates import count
from .filters import ALL, LogFilter

#: The usual threshold, least points of a baseline, scales of both deviations.
THRESHOLD, MIN_POINTS, MIN_HOST_EVENTS, MAD_SCALE, MEAN_SCALE = 3.5, 7, 50, 0.6745, 1.253314


def modified_z(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``baseline`` (the exact median), ``z`` and the number of ``points``.

    ``rows`` is an aggregate with a row for each day or host. Its two medians are one row each.
    """
    med = rows.agg(F.median(value).alias("baseline"), F.count("*").alias("points"))
    off = rows.join(F.broadcast(med)).withColumn("_off", F.abs(F.col(value) - F.col("baseline")))
    spread = off.agg(F.median("_off").alias("_mad"), F.avg("_off").alias("_mean"))
    d = F.col(value) - F.col("baseline")
    z = F.when(F.col("_mad") > 0, F.lit(MAD_SCALE) * d / F.col("_mad")).when(F.col("_mean") > 0, d / (F.lit(MEAN_SCALE) * F.col("_mean"))).otherwise(0.0)
    return off.join(F.broadcast(spread)).withColumn("z", F.when(F.col("points") >= 2, z).otherwise(0.0)).drop("_off", "_mad", "_mean")


def _finding(rows: DataFrame, kind: str, subject: str, value: str) -> DataFrame:
    up: Column = F.when(F.col(value) >= F.col("baseline"), "above").otherwise("below")
    return rows.select(F.lit(kind).alias("kind"), F.col(subject).alias("subject"), F.round(F.abs("z"), 2).alias("score"), F.round(value, 2).alias("observed"), F.round("baseline", 2).alias("baseline"), up.alias("direction"), F.when(F.abs("z") >= 6, "high").otherwise("medium").alias("severity"))


def detect(log: DataFrame, flt: LogFilter = ALL, threshold: float = THRESHOLD, limit: int = 25) -> DataFrame:
    """Findings, the largest score first; without MIN_POINTS days or hosts there are none of their kind."""
    rows = flt(log)
    totals = [count(rows).cast("double").alias("total"), count(rows, is_error()).cast("double").alias("errors")]
    rate = (F.col("errors") / F.col("total") * 100).alias("rate")
    days = rows.where("day is not null").groupBy("day").agg(*totals).select("*", rate)
    hosts = rows.where("hostname is not null").groupBy("hostname").agg(*totals).where(F.col("total") >= MIN_HOST_EVENTS).select("*", rate)
    enough = F.col("points") >= MIN_POINTS
    volume = modified_z(days, "total").where(enough & (F.abs("z") >= threshold))
    rates = modified_z(days, "rate").where(enough & (F.abs("z") >= threshold))
    noisy = modified_z(hosts, "rate").where(enough & (F.col("z") >= threshold) & (F.col("rate") > 0))
    found = _finding(volume, "volume_spike", "day", "total").unionByName(_finding(rates, "error_rate_spike", "day", "rate")).unionByName(_finding(noisy, "noisy_host", "hostname", "rate"))
    return found.orderBy(F.desc("score"), "kind", "subject").limit(limit)


def trend(log: DataFrame, days: int = 7, flt: LogFilter = ALL) -> DataFrame:
    """Error rates of the last ``days`` days and of those before, if both are there, the earlier is
    above 0 and they differ by a point."""
    rows = flt(log).where("day is not null")
    daily = rows.groupBy("day").agg(count(rows).alias("total"), count(rows, is_error()).alias("errors"))
    ranked = daily.withColumn("n", F.row_number().over(Window.orderBy(F.desc("day"))))  # a row for each day
    late, early = F.col("n") <= days, (F.col("n") > days) & (F.col("n") <= 2 * days)
    pct = lambda part: F.round(F.lit(100.0) * F.sum(F.when(part, F.col("errors"))) / F.sum(F.when(part, F.col("total"))), 1)
    out = ranked.agg(F.count("*").alias("days"), pct(late).alias("recent_rate"), pct(early).alias("prior_rate")).withColumn("change", F.round(F.col("recent_rate") - F.col("prior_rate"), 1))
    return out.where((F.col("days") >= 2 * days) & (F.col("prior_rate") > 0) & (F.abs("change") >= 1)).withColumn("direction", F.when(F.col("change") > 0, "worsened").otherwise("improved"))
