"""The same transforms over streams: landing folders, feeds or topics in, events, topics and live series out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logweave.functions.normalize import parse
from logweave.operators.exports import upsert_days
from logweave.schema import is_error
from logweave.storage import new_path

#: Seconds around its arrival within which an event's own time is believed, and for which an id is remembered.
TRUST, EXPIRY = 3600, 7200


def landing(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Lines of files as they land; a trigger takes so many files, and none is lost."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("source_file"))


def topic(spark: SparkSession, servers: str, name: str, per_trigger: int = 100_000) -> DataFrame:
    """A topic of JSON records ``{raw, source, ...}``; needs the Kafka package. ``sources.feed`` reads any other broker."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": name, "maxOffsetsPerTrigger": per_trigger}
    body = F.from_json(F.col("value").cast("string"), "raw string, source string, received_at string, tenant string")
    return spark.readStream.format("kafka").options(**options).load().select(body.alias("r")).select("r.raw", F.col("r.source").alias("source_file"))


def stamped(parsed: DataFrame, trust: int = TRUST) -> DataFrame:
    """``parsed`` with ``arrived``, the time of its trigger, and ``seen_at``: the event's own time where that is at most
    ``trust`` seconds before ``arrived`` and not after it, else ``arrived``.

    Arrival never goes back, so ``seen_at`` is never more than ``trust`` behind any that came before, whatever the clocks
    of devices say. A watermark on it that waits longer than that drops nothing. The trigger's time is part
    of the query's log: a batch that is run again has the same.
    """
    now = parsed.withColumn("arrived", F.current_timestamp())
    own = (F.col("event_ts") <= F.col("arrived")) & (F.col("event_ts") >= F.col("arrived") - F.make_dt_interval(secs=F.lit(trust)))
    return now.withColumn("seen_at", F.when(own, F.col("event_ts")).otherwise(F.col("arrived")))


def events(lines: DataFrame, as_of: str, trust: int = TRUST, expiry: int = EXPIRY) -> DataFrame:
    """Parsed events; an id that comes again within ``expiry`` seconds of arrival is left out.

    Ids are kept in the state store until ``expiry`` has passed by arrival, not by the events' own time: one wrong clock
    or a backfill of any age loses nothing. A time that cannot be read stays null. What passes is counted as
    ``events`` among the query's observed metrics.
    """
    if expiry <= trust:
        raise ValueError("ids must be kept longer than own times are believed")
    once = stamped(parse(lines, as_of), trust).withWatermark("seen_at", f"{expiry} seconds").dropDuplicatesWithinWatermark(["id"])
    return once.observe("events", F.count(F.lit(1)).alias("rows"), F.count_if(is_error()).alias("errors"))


def series(parsed: DataFrame, width: str = "1 hour") -> DataFrame:
    """A2, A3, A10 live: volume and errors by window of ``seen_at``; closed windows are final, and each event is in one of
    them. ``strays`` counts the events of a window whose own time is another."""
    stray = ~F.col("event_ts").eqNullSafe(F.col("seen_at"))
    counts = parsed.groupBy(F.window("seen_at", width).alias("w")).agg(F.count("*").alias("total"), F.count_if(is_error()).alias("errors"), F.count_if(stray).alias("strays"))
    return counts.select(F.col("w.start").alias("start"), "total", "errors", "strays", (100.0 * F.col("errors") / F.col("total")).alias("error_rate"))


def to_table(parsed: DataFrame, path: str, checkpoint: str, publish: Callable[[DataFrame], None] | None = None) -> DataStreamWriter:
    """Each batch is stored once, upserted by id into a table by day, then handed to ``publish``; the
    checkpoint moves on only after both. ``created_at`` is the time of arrival. A batch that is run again changes nothing."""
    place = new_path(parsed.sparkSession, "batch")

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        df.withColumnRenamed("arrived", "created_at").drop("seen_at").write.mode("overwrite").parquet(place)
        rows = spark.read.parquet(place)
        if rows.isEmpty():
            return
        upsert_days(spark, path, rows, stable=True)
        if publish is not None:
            publish(rows.select(F.col("id").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value")))

    return parsed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def to_topic(parsed: DataFrame, servers: str, name: str, checkpoint: str) -> DataStreamWriter:
    """Events as JSON under their id; needs the Kafka package."""
    rows = parsed.select(F.col("id").alias("key"), F.to_json(F.struct(*parsed.columns)).alias("value"))
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", name).option("checkpointLocation", checkpoint)
