"""What queries share: stored edges and indexes over a folder of tables, built by the first query of an application that
needs them, as jobs over the view would have left them behind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from logweave.operators import edgestore, rollup, textindex
from logweave.storage import new_path

from . import logview as V

_BUILT: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]) -> object:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def edges(spark: SparkSession, sf_dir: str) -> edgestore.EdgeStore:
    return _once(spark, sf_dir, "edges", lambda: edgestore.EdgeStore.build(V.edges(V.events(spark, sf_dir, True)), new_path(spark, "edges")))


def names(spark: SparkSession, sf_dir: str) -> textindex.TextIndex:
    def build():
        return textindex.index_nodes(V.named(V.events(spark, sf_dir, True)), new_path(spark, "names"))

    return _once(spark, sf_dir, "names", build)


def messages(spark: SparkSession, sf_dir: str) -> textindex.TextIndex:
    """Three batches by event, one of them given twice, merged."""

    def build():
        log, out = V.events(spark, sf_dir), textindex.TextIndex(spark, new_path(spark, "messages"), "grams", ("id",))
        for n in (0, 1, 2, 1):
            out.append(log.where(f"event_id % 3 = {n}"), "message", f"batch-{n}")
        out.merge()
        return out

    return _once(spark, sf_dir, "messages", build)


def documents(spark: SparkSession, sf_dir: str) -> textindex.TextIndex:
    """Two batches of texts, not merged."""

    def build():
        docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), textindex.TextIndex(spark, new_path(spark, "documents"), "words", ("doc_id",))
        for n in (0, 1):
            out.append(docs.where(f"doc_id % 2 = {n}"), "text", f"batch-{n}")
        return out

    return _once(spark, sf_dir, "documents", build)


def rolled(spark: SparkSession, sf_dir: str) -> rollup.RollUp:
    """Days in two batches, as they would come."""

    def build():
        log, out = V.events(spark, sf_dir, True), rollup.RollUp(spark, new_path(spark, "rollup"))
        for half, days in (("first", "day < '2024-01-15'"), ("second", "day >= '2024-01-15'")):
            own = log.where(days)
            out.append(own, V.mentions(own, rollup.HOT_TYPES), half)
        return out

    return _once(spark, sf_dir, "rollup", build)
