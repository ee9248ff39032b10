"""Completeness and accuracy of stored events against their originals, and backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions import normalize

from . import entities


def completeness(original: DataFrame, stored: DataFrame, file: str = "source_file", text: str = "raw") -> DataFrame:
    """For each file, records that are missing or extra, as multisets; only digests are shuffled."""
    def counted(df, name):
        return df.groupBy(F.col(file).alias("file"), F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256).alias("digest")).agg(F.count("*").alias(name))

    both = counted(original, "a").join(counted(stored, "b"), ["file", "digest"], "full").fillna(0, ["a", "b"])
    out = both.groupBy("file").agg(F.sum("a").alias("original"), F.sum("b").alias("stored"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("extra"))
    return out.withColumn("exact", (F.col("missing") == 0) & (F.col("extra") == 0))


def field_accuracy(log: DataFrame, raw: str = "raw_message") -> DataFrame:
    """Whether host and process stand in the original, how its severity is backed, and which addresses were missed or invented."""
    text = F.lower(raw)
    seen = lambda c: F.when(F.col(c).isNull() | F.col(c).startswith("unknown-"), "absent").when(F.instr(text, F.lower(c)) > 0, "confirmed").otherwise("mismatch")
    word = F.upper(F.regexp_extract(raw, r"(?i)\b(emergency|fatal|alert|critical|error|warning|notice|info|debug)\b", 1))
    severity = F.when(word == "", "inferred").when(word == F.col("severity"), "confirmed").otherwise("contradicted")
    there = F.array_distinct(F.regexp_extract_all(raw, F.lit(r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"), F.lit(1)))
    found = F.transform(F.filter("entities", lambda e: e["type"] == "ip"), lambda e: e["value"]) if "entities" in log.columns else there
    return log.select("id", seen("hostname").alias("hostname_check"), seen("process").alias("process_check"), severity.alias("severity_check"), F.size(F.array_except(there, found)).alias("ips_missed"), F.size(F.array_except(found, there)).alias("ips_invented"))


def verbatim(raw: DataFrame, log: DataFrame) -> DataFrame:
    """Share of events whose stored text is their original."""
    both = raw.join(log.select("source_file", "source_record", "raw_message"), ["source_file", "source_record"], "left")
    return both.agg(F.count("*").alias("records"), F.count_if(F.col("raw") == F.col("raw_message")).alias("verbatim"), F.every(F.coalesce(F.col("raw") == F.col("raw_message"), F.lit(False))).alias("all_verbatim"))


def backfill_by_id(log: DataFrame, lineage: DataFrame, columns: tuple[str, ...] = ("source_file", "source_record"), key: str = "id") -> DataFrame:
    """Fills empty columns of existing rows; unknown keys add none."""
    new = lineage.dropDuplicates([key]).select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return log.join(new, key, "left").select(*(F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in log.columns))


def backfill_by_raw(log: DataFrame, original: DataFrame, text: str = "raw_message") -> DataFrame:
    """Fills the file of events whose text is found in a single file; others stay as they are."""
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    one = original.groupBy(digest("raw").alias("_d")).agg(F.countDistinct("source_file").alias("_n"), F.min("source_file").alias("_file"), F.min("source_record").alias("_record")).where("_n = 1").drop("_n")
    out = log.withColumn("_d", digest(text)).join(one, "_d", "left")
    return out.withColumn("source_file", F.coalesce("source_file", "_file")).withColumn("source_record", F.coalesce("source_record", "_record")).select(*log.columns)


def backfill_skew(log: DataFrame, as_of: str, days: int = 730) -> DataFrame:
    """Whether a time lies over two years from ``as_of``; times that cannot be read do not."""
    ts = F.try_to_timestamp(F.col("timestamp"))
    off = F.coalesce(F.abs(F.datediff(F.lit(as_of).cast("date"), ts.cast("date"))) > days, F.lit(False))
    old = F.col("timestamp_anomalous") if "timestamp_anomalous" in log.columns else F.lit(None).cast("boolean")
    return log.withColumn("timestamp_anomalous", F.coalesce(old, off))


def backfill_timestamp_source(log: DataFrame, as_of: str, text: str = "raw_message") -> DataFrame:
    """Fills an empty ``timestamp_source`` by reading the raw text again; nothing else changes, and no row moves."""
    again = normalize.parse(log.select(F.struct(*log.columns).alias("_row"), F.col(text).alias("raw")), as_of)
    told = F.coalesce("_row.timestamp_source", "timestamp_source").alias("timestamp_source")
    return again.select(*(told if c == "timestamp_source" else F.col(f"_row.`{c}`").alias(c) for c in log.columns))


def reparse(log: DataFrame, as_of: str, text: str = "raw_message", file: str = "source_file") -> DataFrame:
    """Stored lines parsed anew, with their file, their old id, and how many entities they had and have now. Rows
    without text are left out; no row moves."""
    old = F.size(F.coalesce("entities", F.array().cast("array<struct<type:string,value:string>>"))) if "entities" in log.columns else F.lit(0)
    kept = log.where(F.coalesce(F.col(text), F.lit("")) != "")
    again = normalize.parse(kept.select(F.coalesce(file, F.lit("unknown_source")).alias("source_file"), F.col("id").alias("old_id"), old.alias("old_entities"), F.col(text).alias("raw")), as_of)
    return entities.extract(again).withColumn("new_entities", F.size("entities"))


def write_reparsed(events: DataFrame, path: str, per_file: int = 200_000) -> None:
    """Parts of JSON lines by file, compressed."""
    name = F.regexp_replace(F.regexp_replace("source_file", r"\.[^./\\\\]*$", ""), r"[/\\\\]", "_")
    events.withColumn("part", name).write.partitionBy("part").option("maxRecordsPerFile", per_file).option("compression", "gzip").json(path)


def reparse_report(events: DataFrame) -> DataFrame:
    """What the new parse gives beside the old one."""
    more, fewer = F.col("new_entities") > F.col("old_entities"), F.col("new_entities") < F.col("old_entities")
    return events.agg(
        F.count("*").alias("records"), F.countDistinct("source_file").alias("files"), F.sum("old_entities").alias("old_entities"), F.sum("new_entities").alias("new_entities"),
        F.count_if(more).alias("gained"), F.count_if(fewer).alias("lost"),
    )


def newest(view: DataFrame, rows: DataFrame, n: int = 500) -> DataFrame:
    """A live view with new rows: each id once, the latest ``n``."""
    return view.unionByName(rows.select(*view.columns)).dropDuplicates(["id"]).orderBy(F.desc("timestamp"), F.desc("id")).limit(n)
