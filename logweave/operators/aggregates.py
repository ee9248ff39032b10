"""Counts, rankings and series over events. Every function takes a filter and gives one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.schema import BAND_MAX, FIELDS, is_alert, is_error

from .filters import ALL, LogFilter


#: The column that says for how many events a row of a roll-up stands.
WEIGHT = "_weight"


def count(rows: DataFrame, which: Column | None = None) -> Column:
    """The number of events of ``rows``, or of those that ``which`` holds for: of rows, or of the events they stand for."""
    if WEIGHT in rows.columns:
        return F.coalesce(F.sum(F.col(WEIGHT) if which is None else F.when(which, F.col(WEIGHT))), F.lit(0))
    return F.count("*") if which is None else F.count_if(which)


def total(rows: DataFrame) -> Column:
    return count(rows).alias("total")


def errors(rows: DataFrame) -> Column:
    return count(rows, is_error()).alias("errors")


def alerts(rows: DataFrame) -> Column:
    return count(rows, is_alert()).alias("alerts")


def overview(log: DataFrame, m: DataFrame | None = None, flt: LogFilter = ALL) -> DataFrame:
    """A1: all headline counts in one pass; users are those that the filtered events mention."""
    score = F.col("severity_score")
    rows = flt(log)
    latest = "latest" if WEIGHT in rows.columns else "timestamp"
    of = lambda which, name: count(rows, which).alias(name)
    out = rows.agg(
        of(None, "total_logs"), F.countDistinct("hostname").alias("total_hosts"), F.countDistinct("source_type").alias("total_sources"),
        of(score <= BAND_MAX, "total_alerts"), of(score <= 2, "total_critical"), of(score == 3, "error_level"), of(score <= 3, "total_errors"), of(score == 4, "total_warnings"),
        F.min("timestamp").alias("earliest_timestamp"), F.max(latest).alias("latest_timestamp"),
    )
    if m is None:
        return out
    named = m.where("type = 'user'")
    if flt.active:
        named = named.join(rows.select(F.col("id").alias("log_id")), "log_id", "left_semi")
    users = named.agg(F.countDistinct("value").alias("total_users"))
    return out.join(F.broadcast(users))  # one row each


def by_day(log: DataFrame, days: int | None = None, flt: LogFilter = ALL) -> DataFrame:
    """A2: the last ``days`` days that have events, in order."""
    rows = flt(log).where("day is not null")
    out = rows.groupBy(F.col("day").alias("bucket")).agg(total(rows), alerts(rows), errors(rows))
    return (out.orderBy(F.desc("bucket")).limit(days) if days else out).orderBy("bucket")


def within_day(log: DataFrame, day: str, granularity: str = "hour", flt: LogFilter = ALL) -> DataFrame:
    """A3."""
    n = 16 if granularity == "minute" else 13
    rows = flt(log).where((F.col("day") == day) & F.col("timestamp").isNotNull())
    return rows.groupBy(F.substring("timestamp", 1, n).alias("bucket")).agg(total(rows), alerts(rows), errors(rows)).orderBy("bucket")


def severity_distribution(log: DataFrame, flt: LogFilter = ALL) -> DataFrame:
    """A4."""
    rows = flt(log).where("severity is not null")
    return rows.groupBy("severity", F.col("severity_score").alias("score")).agg(count(rows).alias("count")).orderBy("score", "severity")


def by_source_type(log: DataFrame, flt: LogFilter = ALL) -> DataFrame:
    """A5."""
    rows = flt(log).where("source_type is not null")
    return rows.groupBy("source_type").agg(total(rows), errors(rows)).orderBy(F.desc("total"), "source_type")


def top(log: DataFrame, column: str, name: str, limit: int = 10, metric: str = "total", flt: LogFilter = ALL) -> DataFrame:
    """The values of a column with most events, or most errors."""
    rows = flt(log).where(F.col(column).isNotNull() & (F.col(column) != ""))
    return rows.groupBy(F.col(column).alias(name)).agg(total(rows), errors(rows)).orderBy(F.desc(metric), name).limit(limit)


def top_hosts(log: DataFrame, limit: int = 10, metric: str = "total", flt: LogFilter = ALL) -> DataFrame:
    return top(log, "hostname", "host", limit, metric, flt)


def top_processes(log: DataFrame, limit: int = 10, flt: LogFilter = ALL) -> DataFrame:
    return top(log, "process", "process", limit, "total", flt)


def top_error_components(log: DataFrame, limit: int = 10, flt: LogFilter = ALL) -> DataFrame:
    """Errors are filtered before they are counted."""
    rows = flt(log).where(is_error() & F.col("component").isNotNull() & (F.col("component") != ""))
    return rows.groupBy("component").agg(count(rows).alias("errors")).orderBy(F.desc("errors"), "component").limit(limit)


def heat_map(log: DataFrame, days: int = 14, flt: LogFilter = ALL) -> DataFrame:
    """Events by day and hour of the last days, the day's total, and a bucket from 0 to 4 by the root of the count."""
    rows = flt(log).where("day is not null and timestamp is not null")
    last = rows.select("day").distinct().orderBy(F.desc("day")).limit(days)
    cells = rows.join(F.broadcast(last), "day", "left_semi").groupBy("day", F.substring("timestamp", 12, 2).cast("int").alias("hour")).agg(total(rows), errors(rows))
    return cells.withColumn("day_total", F.sum("total").over(Window.partitionBy("day"))).withColumn("bucket", F.round(F.sqrt("total") / F.sqrt(F.max("total").over(Window.partitionBy())) * 4).cast("int")).orderBy("day", "hour")


def error_rate_by_day(log: DataFrame, days: int | None = None, flt: LogFilter = ALL) -> DataFrame:
    """The error rate of each day in per cent and the mean over the days shown."""
    out = by_day(log, days, flt).select("bucket", "total", "errors", (F.lit(100.0) * F.col("errors") / F.col("total")).alias("error_rate"))
    return out.withColumn("mean_rate", F.round(F.avg("error_rate").over(Window.partitionBy()), 6))


def top_messages(log: DataFrame, limit: int = 10, errors_only: bool = True, length: int = 120, flt: LogFilter = ALL) -> DataFrame:
    """Beginnings of messages by number, up to four of their hosts, and the severity of the first."""
    rows = flt(log).where(F.col("message").isNotNull() & (F.col("message") != ""))
    rows = rows.where(is_error()) if errors_only else rows
    rows = rows.withColumn("pattern", F.substring("message", 1, length))
    # a row for each message and host, so that no task gathers all hosts of a common message
    first = F.col("first") if WEIGHT in rows.columns else F.struct("timestamp", "id", "severity")
    pairs = rows.groupBy("pattern", "hostname").agg(count(rows).alias("n"), F.min(first).alias("first"))
    counts = pairs.groupBy("pattern").agg(F.sum("n").alias("occurrences"), F.min("first").alias("first")).orderBy(F.desc("occurrences"), "pattern").limit(limit)
    few = pairs.join(F.broadcast(counts.select("pattern")), "pattern").withColumn("_r", F.row_number().over(Window.partitionBy("pattern").orderBy("hostname"))).where("_r <= 4 and hostname is not null")
    hosts = few.groupBy("pattern").agg(F.array_join(F.array_sort(F.collect_list("hostname")), ",").alias("hosts"))
    out = counts.join(hosts, "pattern", "left").select("pattern", "occurrences", F.coalesce("hosts", F.lit("")).alias("hosts"), F.col("first.severity").alias("severity"))
    return out.orderBy(F.desc("occurrences"), "pattern")


def severity_by_source(log: DataFrame, limit: int = 12, flt: LogFilter = ALL) -> DataFrame:
    """A12."""
    score = F.col("severity_score")
    rows = flt(log).where("source_type is not null")
    of = lambda which, name: count(rows, which).alias(name)
    out = rows.groupBy("source_type").agg(total(rows), of(score <= 2, "critical"), of(score == 3, "errors"), of(score == 4, "warnings"))
    return out.orderBy(F.desc("total"), "source_type").limit(limit)


def parse_coverage(log: DataFrame, limit: int = 30, flt: LogFilter = ALL) -> DataFrame:
    """A13."""
    rows = flt(log).where("matched_format is not null")
    return rows.groupBy("matched_format").agg(count(rows).alias("count")).orderBy(F.desc("count"), "matched_format").limit(limit)


def field_coverage(log: DataFrame) -> DataFrame:
    """Values of each field that is there, their share, and whether a required one is missing somewhere."""
    known = [f for f in FIELDS if f.name in log.columns]
    one = log.agg(F.count("*").alias("_n"), *(F.count(f.name).alias(f.name) for f in known))
    rows = F.array(*(F.struct(F.lit(f.name).alias("field"), F.lit(f.required).alias("required"), F.col(f.name).alias("present")) for f in known))
    return one.select("_n", F.explode(rows).alias("f")).select("f.field", "f.required", "f.present", F.round(F.lit(100.0) * F.col("f.present") / F.col("_n"), 2).alias("percent"), (F.col("f.required") & (F.col("f.present") < F.col("_n"))).alias("violation"))


def shares(counts: DataFrame, label: str, value: str, keep: int = 5) -> DataFrame:
    """The first ``keep`` slices and the rest as one, with their shares."""
    rank = F.row_number().over(Window.orderBy(F.desc(value), label))  # a row for each group
    rest = counts.withColumn("_r", rank).withColumn("_l", F.when(F.col("_r") <= keep, F.col(label)).otherwise("Other"))
    return rest.groupBy(F.col("_l").alias("slice")).agg(F.sum(value).alias("value"), F.count("*").alias("members")).withColumn("share", F.round(100.0 * F.col("value") / F.sum("value").over(Window.partitionBy()), 4))


def parse_summary(log: DataFrame, m: DataFrame) -> DataFrame:
    """Events by source, by format with shares, and mentions by type, as (fact, key, count, share)."""
    def fact(rows, name, key):
        out = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("count"))
        return out.select(F.lit(name).alias("fact"), "key", "count", F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()), 4).alias("share"))

    return fact(log, "source_type", "source_type").unionByName(fact(log, "matched_format", "matched_format")).unionByName(fact(m, "entity_type", "type"))


def facts(log: DataFrame, flt: LogFilter = ALL) -> DataFrame:
    """Six facts for a report as (fact, key, value)."""
    rows = flt(log)
    count = F.count("*").alias("value")

    def named(df, name, key):
        return df.select(F.lit(name).alias("fact"), F.col(key).cast("string").alias("key"), F.col("value"))

    ranked = lambda df, key, n: df.orderBy(F.desc("value"), key).limit(n)
    failed = rows.where(is_error())
    parts = [
        named(rows.agg(count).withColumn("key", F.lit("all")), "total", "key"), named(rows.groupBy("severity").agg(count), "severity", "severity"),
        named(ranked(rows.groupBy("source_type").agg(count), "source_type", 10), "source", "source_type"), named(rows.groupBy("day").agg(count).orderBy(F.desc("day")).limit(14), "day", "day"),
        named(ranked(failed.groupBy("hostname").agg(count), "hostname", 10), "error_host", "hostname"), named(ranked(failed.groupBy(F.substring("message", 1, 90).alias("m")).agg(count), "m", 8), "error_message", "m"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def template(log: DataFrame, name: str, severity: str | None = None, limit: int = 20) -> DataFrame:
    """Named queries with optional predicates."""
    rows = log.where(F.col("severity") == severity.upper()) if severity else log
    if name == "top_hosts_by_severity":
        return rows.groupBy("hostname", "severity").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "hostname", "severity").limit(limit)
    if name == "count_by_severity":
        return rows.groupBy("severity").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "severity")
    if name == "host_inventory":
        return rows.groupBy("hostname").agg(F.count("*").alias("count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")).orderBy("hostname").limit(limit)
    raise ValueError(f"no template {name!r}")


def top_entities(m: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` values of each type with most mentions."""
    order = Window.partitionBy("type").orderBy(F.desc("mentions"), "value")
    return m.groupBy("type", "value").agg(count(m).alias("mentions")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dashboard(log: DataFrame, flt: LogFilter = ALL, facts_of: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Every panel over one filtered table, which the caller may persist; or over the facts of a roll-up."""
    rows = flt(log)
    of = lambda name: flt((facts_of or {}).get(name, log))
    return {
        "overview": overview(rows), "by_day": by_day(rows, 30), "severity": severity_distribution(rows), "sources": by_source_type(rows), "hosts": top_hosts(rows), "error_hosts": top_hosts(rows, metric="errors"),
        "processes": top_processes(of("process")), "components": top_error_components(of("component")), "heat_map": heat_map(rows), "error_rate": error_rate_by_day(rows, 30),
        "messages": top_messages(of("message")), "severity_by_source": severity_by_source(rows), "formats": parse_coverage(of("format")),
    }
