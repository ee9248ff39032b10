"""Predicates, projections, listings and samples of events."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.schema import BAND_MAX, BANDS, band

ROW_FIELDS = ("id", "timestamp", "day", "hostname", "source_type", "process", "component", "severity", "severity_score", "message", "matched_format")


@dataclass(frozen=True)
class LogFilter:
    """Constraints that every operator takes in the same way; unset ones are absent."""

    start: str | None = None
    end: str | None = None
    severity: str | None = None
    source_type: str | None = None
    hostname: str | None = None
    search: str | None = None

    def __post_init__(self) -> None:
        for d in (self.start, self.end):
            if d is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", d):
                raise ValueError(f"not a day: {d!r}")
        if self.start and self.end and self.start > self.end:
            raise ValueError("start is after end")

    @property
    def active(self) -> bool:
        return any(getattr(self, f.name) for f in fields(self))

    def describe(self) -> dict[str, str]:
        return {f.name: v for f in fields(self) if (v := getattr(self, f.name))}

    def column(self) -> Column:
        out = F.lit(True)
        if self.start:
            out &= F.col("day") >= self.start
        if self.end:
            out &= F.col("day") <= self.end
        if self.severity:
            out &= F.col("severity") == self.severity.upper()
        if self.source_type:
            out &= F.col("source_type") == self.source_type
        if self.hostname:
            out &= F.col("hostname") == self.hostname
        if self.search:
            out &= F.lower("message").contains(self.search.lower())
        return out

    def __call__(self, log: DataFrame) -> DataFrame:
        return log.where(self.column()) if self.active else log


ALL = LogFilter()


def list_logs(log: DataFrame, flt: LogFilter = ALL, newest: bool = True, before: str | None = None, after: str | None = None, limit: int = 100, **equal: object) -> DataFrame:
    """a page of events by time, with ties by id; ``before`` and ``after`` are its cursor."""
    rows = flt(log)
    for c, v in equal.items():
        rows = rows.where(F.col(c) == v)
    if before:
        rows = rows.where(F.col("timestamp") < before)
    if after:
        rows = rows.where(F.col("timestamp") > after)
    order = [F.desc("timestamp"), F.desc("id")] if newest else [F.asc("timestamp"), F.asc("id")]
    return rows.orderBy(*order).limit(limit).select(*(c for c in ROW_FIELDS if c in log.columns), band(F.col("severity_score")).alias("alert_level"))


def alerts(log: DataFrame, level: str | None = None, flt: LogFilter = ALL, limit: int = 100) -> DataFrame:
    """events of one band, or of all of them."""
    low, high = BANDS[level] if level else (1, BAND_MAX)
    return list_logs(log.where(F.col("severity_score").between(low, high)), flt, limit=limit)


def time_window(log: DataFrame, start: str, end: str, host: str | None = None, severity: str | None = None, limit: int = 200) -> DataFrame:
    """F8: events of a window in order; bare days are whole days."""
    low = start if len(start) > 10 else f"{start}T00:00:00"
    high = end if len(end) > 10 else f"{end}T23:59:59.999999"
    rows = log.where(F.col("timestamp").between(low, high))
    if host:
        rows = rows.where(F.col("hostname") == host)
    if severity:
        rows = rows.where(F.col("severity") == severity.upper())
    return rows.orderBy("timestamp", "id").limit(min(limit, 500)).select(*(c for c in ROW_FIELDS if c in log.columns))


def detail(log: DataFrame, m: DataFrame, log_id: str) -> DataFrame:
    """One event with its entities."""
    own = m.where(F.col("log_id") == log_id).groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("type", "value"))).alias("entities"))
    return log.where(F.col("id") == log_id).join(own, F.col("id") == F.col("log_id"), "left").drop("log_id")


def distinct_values(log: DataFrame, column: str, limit: int = 500) -> DataFrame:
    """F10."""
    if column not in ("hostname", "source_type", "severity", "process", "component", "day", "matched_format"):
        raise ValueError(f"no listing of {column}")
    return log.select(F.col(column).alias("value")).where("value is not null").distinct().orderBy("value").limit(limit)


def sample(log: DataFrame, n: int, seed: str = "") -> DataFrame:
    """``n`` events by a hash of their id, the same each time."""
    return log.orderBy(F.md5(F.concat(F.lit(seed), "id")), "id").limit(n)


def stratified(log: DataFrame, per: int = 3, by: str = "source_type", seed: str = "") -> DataFrame:
    """up to ``per`` events of each kind."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(seed), "id")), "id")
    return log.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per).drop("_n")
