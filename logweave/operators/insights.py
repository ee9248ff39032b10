"""Rule-based observations (id, level, title, value) over the aggregates.

Each rule is a small query over an aggregate of bounded size; all become one union.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.storage import stored

from . import aggregates as A
from .anomalies import trend
from .filters import ALL, LogFilter


def pct(part, whole) -> Column:
    return F.round(F.lit(100.0) * part / whole, 1)


def _row(df: DataFrame, name: str | Column, level: Column | str, title: Column, value: Column) -> DataFrame:
    text = F.lit(level) if isinstance(level, str) else level
    return df.select((F.lit(name) if isinstance(name, str) else name).alias("id"), text.alias("level"), title.alias("title"), value.cast("double").alias("value"))


def build(log: DataFrame, m: DataFrame | None = None, flt: LogFilter = ALL, min_volume: int = 20, days: int = 7, messages: DataFrame | None = None) -> DataFrame:
    """N1 to N15. An empty table gives one row that says so. ``log`` and ``m`` may be facts of a roll-up; then
    ``messages`` are those of its messages. Events are read once, and all rules but the hot entities read the facts
    that are counted then."""
    from . import rollup

    rows = flt(log)
    if messages is None and A.WEIGHT not in rows.columns and {"id", "timestamp", *rollup.KEYS} - {"hour"} <= set(rows.columns):
        counted, flt = stored(rollup.facts(rows), "facts"), ALL
        rows, messages = rollup.fact_of(counted, "main"), rollup.fact_of(counted, "message")
    total = A.overview(rows)
    whole = F.broadcast(total.select("total_logs", "total_errors", "total_alerts", "total_critical"))
    some = F.col("total_logs") > 0
    out = [_row(total.where(~some), "empty", "info", F.lit("No logs yet"), F.lit(0))]

    sources = A.by_source_type(rows).where("errors > 0").orderBy(F.desc("errors"), "source_type").limit(1).join(whole)
    share = pct(F.col("errors"), F.col("total_errors"))
    out.append(_row(sources, "top-error-source", F.when(share >= 40, "warning").otherwise("info"), F.concat("source_type", F.lit(" produces the most errors")), share))

    hosts = A.top_hosts(rows, 50, "errors")
    rate = pct(F.col("errors"), F.col("total"))
    risky = hosts.where(F.col("total") >= min_volume).withColumn("rate", rate).where("rate > 0").orderBy(F.desc("rate"), "host").limit(1)
    out.append(_row(risky, "riskiest-host", F.when(F.col("rate") >= 25, "critical").otherwise("warning"), F.concat("host", F.lit(" has the highest error rate")), F.col("rate")))

    big = hosts.limit(1).join(whole).withColumn("share", share).where("share >= 20")
    out.append(_row(big, "error-concentration", F.when(F.col("share") >= 40, "warning").otherwise("info"), F.concat("host", F.lit(" concentrates errors")), F.col("share")))

    noise = A.severity_distribution(rows).agg(F.sum(F.when(F.col("score") >= 6, F.col("count")).otherwise(0)).alias("noise")).join(whole).where(some)
    out.append(_row(noise, "signal-to-noise", "info", F.lit("Signal and noise"), pct(F.col("noise"), F.col("total_logs"))))

    alert = pct(F.col("total_alerts"), F.col("total_logs"))
    out.append(_row(total.where("total_alerts > 0"), "alert-volume", F.when(alert >= 5, "critical").otherwise("warning"), F.concat(F.col("total_alerts").cast("string"), F.lit(" alerts of warning or worse")), alert))

    daily = A.by_day(rows)
    out.append(_row(daily.orderBy(F.desc("total"), "bucket").limit(1), "busiest-day", "info", F.concat("bucket", F.lit(" was the busiest day")), F.col("total")))
    worst = daily.where("alerts > 0").orderBy(F.desc("alerts"), "bucket").limit(1)
    out.append(_row(worst, "worst-day", F.when(F.col("alerts") >= 10, "critical").otherwise("warning"), F.concat("bucket", F.lit(" had the most alerts")), F.col("alerts")))
    out.append(_row(trend(rows, days), "error-trend", F.when(F.col("change") > 0, "warning").otherwise("good"), F.concat(F.lit("Error rate has "), "direction"), F.col("change")))

    message = A.top_messages(rows if messages is None else flt(messages), 1).join(whole).withColumn("share", pct(F.col("occurrences"), F.col("total_errors"))).where("share >= 10")
    out.append(_row(message, "dominant-error-message", F.when(F.col("share") >= 25, "warning").otherwise("info"), F.lit("One message dominates the errors"), F.col("share")))

    hours = rows.where("timestamp is not null").groupBy(F.substring("timestamp", 12, 2).alias("hour")).agg(A.total(rows), A.errors(rows))
    out.append(_row(hours.orderBy(F.desc("total"), "hour").limit(1), "peak-hour", "info", F.concat(F.lit("Traffic peaks at "), "hour", F.lit(":00 UTC")), F.col("total")))
    bad_hour = hours.where("total >= 50").withColumn("rate", rate).orderBy(F.desc("rate"), "hour").limit(1).join(whole).where(F.col("rate") > 1.5 * pct(F.col("total_errors"), F.col("total_logs")))
    out.append(_row(bad_hour, "worst-hour-rate", "warning", F.concat("hour", F.lit(":00 has a high error rate")), F.col("rate")))

    sick = A.severity_by_source(rows, 1000).where("total >= 100").withColumn("rate", pct(F.col("errors") + F.col("critical"), F.col("total"))).orderBy(F.desc("rate"), "source_type").limit(1).where("rate >= 5")
    out.append(_row(sick, "unhealthiest-source", F.when(F.col("rate") >= 15, "warning").otherwise("info"), F.concat("source_type", F.lit(" is the least healthy source")), F.col("rate")))

    if m is not None:
        kinds = ("user", "ip", "device", "vm")
        order = Window.partitionBy("type").orderBy(F.desc("mentions"), "value")
        ranked = A.top_entities(m.where(F.col("type").isin(*kinds)), 2).withColumn("second", F.lead("mentions").over(order))
        hot = ranked.where("rank = 1 and second is not null").where(F.col("mentions") >= F.greatest(F.lit(20), F.col("second") * 3))
        first = hot.orderBy(F.array_position(F.array(*map(F.lit, kinds)), F.col("type"))).limit(1)
        out.append(_row(first, F.concat(F.lit("entity-hotspot-"), "type"), "info", F.concat(F.lit("One "), "type", F.lit(" dominates activity")), F.round(F.col("mentions") / F.col("second"), 1)))

    dated = daily.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("dated")).join(whole).where(some & (F.col("dated") < F.col("total_logs") * 0.98))
    out.append(_row(dated, "timestamp-coverage", "info", F.lit("Logs without a usable date"), pct(F.col("total_logs") - F.col("dated"), F.col("total_logs"))))
    return reduce(DataFrame.unionByName, out)
