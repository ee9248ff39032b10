"""Counters of running streams that survive a restart, and the live tail of their table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, batch long, at string, input long, rows long, errors long, rate double"


class Counters(StreamingQueryListener):
    """Keeps what each finished batch counted: a row for each batch under ``path``, overwritten if the batch runs again.

    ``rows`` are the events that passed (the observed metric ``events``), ``input`` the lines read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        metrics = p.observedMetrics.get("events")
        if metrics is None or not p.numInputRows:
            return
        row = (str(p.id), p.batchId, p.timestamp, p.numInputRows, metrics["rows"], metrics["errors"], float(p.processedRowsPerSecond))
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("overwrite").json(f"{self.path}/of={p.id}/n={p.batchId}")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def totals(spark: SparkSession, path: str) -> DataFrame:
    """T4: for each query its batches, lines, events and errors so far, and the last batch's rate."""
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).json(path)
    last = F.max_by("rate", "batch").alias("rate")
    return rows.groupBy("query").agg(F.count("*").alias("batches"), F.sum("input").alias("input"), F.sum("rows").alias("rows"), F.sum("errors").alias("errors"), F.max("at").alias("at"), last)


def tail(spark: SparkSession, table: str, after: tuple[str, str] | None = None, limit: int = 100) -> DataFrame:
    """The next ``limit`` events of a table in order of arrival, after (created_at, id) of the last one shown."""
    rows = spark.read.parquet(table)
    if after is not None:
        at, last = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        rows = rows.where((F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col("id") > last)))
    return rows.orderBy("created_at", "id").limit(limit)


def latest(query) -> dict:
    """What a running query says of its last batch, as a plain record."""
    last = query.lastProgress
    return {} if last is None else json.loads(last.json)
