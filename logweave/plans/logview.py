"""Events, mentions, nodes and edges over the ``events`` table, in Spark and as SQL.

The event view gives every operator a table that both engines can derive; it is a projection, so
filters and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators import entities, graph


def dealt(rows: DataFrame, key: str, each: int = 4) -> DataFrame:
    """``rows`` in at least ``each`` parts for each core, moved by ``key`` if they are read in fewer: one file of few row groups is few
    tasks, and patterns cost far more than moving the columns that are read."""
    parts = each * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts, key)


def events(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """``heavy`` deals the rows over all cores, for what runs many patterns on each."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = dealt(e, "event_id") if heavy else e
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    kind = F.col("event_type")
    score = F.when((kind == "error") & (k < 20), 2).when(kind == "error", 3).when((kind == "signup") & (k < 50), 4).when(kind == "signup", 5).when(kind.isin("purchase", "click"), 6).otherwise(7)
    e = e.select("event_id", "ts", "user_id", kind, "value", k.alias("k"), score.alias("severity_score"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    source = F.element_at(F.array(*map(F.lit, ("ESXi", "NSX", "CoreDNS", "PostgreSQL", "LinuxAudit"))), (user % 5 + 1).cast("int"))
    names = F.element_at(F.array(*map(F.lit, ("CRITICAL", "ERROR", "WARNING", "NOTICE", "INFO", "DEBUG"))), F.col("severity_score") - 1)
    host = F.concat(F.lit("node-"), F.lpad(((user + F.when(F.col("k") < 20, F.col("event_id") % 3).otherwise(0)) % 12).cast("string"), 2, "0"))
    process, component = F.concat(kind, F.lit("d")), F.concat(kind, F.lit("."), (F.col("k") % 4).cast("string"))
    message = F.concat(kind, F.lit(" request k="), F.col("k").cast("string"), F.lit(" from 10.20."), (user % 4).cast("string"), F.lit("."), user.cast("string"))
    form = F.element_at(F.array(*map(F.lit, ("pri_syslog", "rfc5424", "rfc3164_wrapper", "logfmt", "cef", "leef", "web_access", "json"))), (F.col("event_id") % 8 + 1).cast("int"))
    raw = F.concat_ws(" ", stamp, host, process, message)
    out = e.select(
        F.concat(F.lit("log-"), F.substring(F.md5(F.concat(F.col("event_id").cast("string"), F.lit("|"), kind)), 1, 16)).alias("id"),
        stamp.alias("timestamp"), F.substring(stamp, 1, 10).alias("day"), host.alias("hostname"), F.concat(F.lit("user-"), user.cast("string")).alias("user_name"),
        source.alias("source_type"), process.alias("process"), component.alias("component"), names.alias("severity"), "severity_score", message.alias("message"),
        F.concat(F.lit("["), source, F.lit("] "), host, F.lit("/"), process, F.lit(": "), F.substring(message, 1, 200)).alias("normalized_message"),
        form.alias("matched_format"), raw.alias("raw_message"), F.sha2(F.encode(raw, "UTF-8"), 256).alias("raw_hash"), "event_id", "ts", "k", "value",
        F.concat(F.lit("trace-"), F.floor(F.col("event_id") / 3).cast("string")).alias("trace"),
        F.when(F.col("k") < 10, F.concat(F.lit("/var/log/"), process, F.lit("/"), F.col("k").cast("string"), F.lit(".log"))).alias("file"),
    )
    return out


def _with_attributes(log: DataFrame) -> DataFrame:
    return log.withColumn("attributes", F.create_map(F.lit("user"), F.col("user_name"), F.lit("trace"), F.col("trace"), F.lit("fname"), F.col("file"), F.lit("opid"), F.regexp_extract("process", "^(.*)d$", 1)))


def mentions(log: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """Of all types, or of those that a query asks for: a store of mentions would be read by type."""
    return entities.mentions(_with_attributes(log), types)


def nodes(log: DataFrame, m: DataFrame) -> DataFrame:
    return graph.nodes(log, m)


def named(log: DataFrame) -> DataFrame:
    return graph.named(entities.extract(_with_attributes(log)))


def edges(log: DataFrame, rels: tuple[str, ...] | None = None) -> DataFrame:
    return graph.edges(entities.extract(_with_attributes(log), types=None if rels is None else graph.types_of(rels)), rels=rels)


SQL_EVENTS = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
ev2 AS (SELECT *, CASE WHEN event_type = 'error' AND k < 20 THEN 2 WHEN event_type = 'error' THEN 3 WHEN event_type = 'signup' AND k < 50 THEN 4
  WHEN event_type = 'signup' THEN 5 WHEN event_type IN ('purchase', 'click') THEN 6 ELSE 7 END AS severity_score, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS stamp,
  'node-' || lpad(CAST((user_id + CASE WHEN k < 20 THEN event_id % 3 ELSE 0 END) % 12 AS VARCHAR), 2, '0') AS host, CASE user_id % 5 WHEN 0 THEN 'ESXi' WHEN 1 THEN 'NSX' WHEN 2 THEN 'CoreDNS' WHEN 3 THEN 'PostgreSQL' ELSE 'LinuxAudit' END AS src,
  event_type || ' request k=' || k || ' from 10.20.' || (user_id % 4) || '.' || user_id AS msg FROM ev),
log AS (SELECT 'log-' || substr(md5(CAST(event_id AS VARCHAR) || '|' || event_type), 1, 16) AS id, stamp AS timestamp, substr(stamp, 1, 10) AS day, host AS hostname, 'user-' || user_id AS user_name,
  src AS source_type, event_type || 'd' AS process, event_type || '.' || (k % 4) AS component,
  CASE severity_score WHEN 2 THEN 'CRITICAL' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'WARNING' WHEN 5 THEN 'NOTICE' WHEN 6 THEN 'INFO' ELSE 'DEBUG' END AS severity, severity_score, msg AS message,
  '[' || src || '] ' || host || '/' || event_type || 'd: ' || substr(msg, 1, 200) AS normalized_message,
  CASE event_id % 8 WHEN 0 THEN 'pri_syslog' WHEN 1 THEN 'rfc5424' WHEN 2 THEN 'rfc3164_wrapper' WHEN 3 THEN 'logfmt' WHEN 4 THEN 'cef' WHEN 5 THEN 'leef' WHEN 6 THEN 'web_access' ELSE 'json' END AS matched_format,
  stamp || ' ' || host || ' ' || event_type || 'd ' || msg AS raw_message, sha256(stamp || ' ' || host || ' ' || event_type || 'd ' || msg) AS raw_hash, event_id, ts, k, value, 'trace-' || (event_id // 3) AS trace,
  CASE WHEN k < 10 THEN '/var/log/' || event_type || 'd/' || k || '.log' END AS file FROM ev2)"""

SQL_MENTIONS = SQL_EVENTS + """,
mentions AS (SELECT id AS log_id, 'user' AS type, user_name AS value FROM log UNION ALL SELECT id, 'trace', trace FROM log UNION ALL SELECT id, 'file', file FROM log WHERE file IS NOT NULL
  UNION ALL SELECT id, 'operation', substr(process, 1, length(process) - 1) FROM log UNION ALL SELECT id, 'ip', regexp_extract(message, '\\b([0-9]{1,3}([.][0-9]{1,3}){3})\\b', 1) FROM log WHERE regexp_matches(message, '\\b([0-9]{1,3}([.][0-9]{1,3}){3})\\b'))"""

SQL_GRAPH = SQL_MENTIONS + """,
nodes AS (
  SELECT 'Host' AS label, hostname AS value, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM log GROUP BY hostname
  UNION ALL SELECT 'Process', process, min(timestamp), max(timestamp) FROM log GROUP BY process
  UNION ALL SELECT 'Component', component, min(timestamp), max(timestamp) FROM log GROUP BY component
  UNION ALL SELECT 'SourceType', source_type, min(timestamp), max(timestamp) FROM log GROUP BY source_type
  UNION ALL SELECT 'Severity', severity, min(timestamp), max(timestamp) FROM log GROUP BY severity
  UNION ALL SELECT 'Day', day, min(timestamp), max(timestamp) FROM log GROUP BY day
  UNION ALL SELECT CASE type WHEN 'user' THEN 'User' WHEN 'trace' THEN 'Trace' WHEN 'file' THEN 'File' WHEN 'operation' THEN 'Operation' ELSE 'IPAddress' END, m.value, min(timestamp), max(timestamp)
    FROM mentions m JOIN log ON log.id = m.log_id GROUP BY type, m.value),
edges AS (
  SELECT DISTINCT 'Process' AS src_label, process AS src, 'RUNS_ON' AS rel, 'Host' AS dst_label, hostname AS dst FROM log
  UNION ALL SELECT DISTINCT 'Host', hostname, 'IS_TYPE', 'SourceType', source_type FROM log
  UNION ALL SELECT DISTINCT 'Component', component, 'PART_OF', 'Process', process FROM log
  UNION ALL SELECT DISTINCT 'User', user_name, 'ACCESSED', 'Host', hostname FROM log
  UNION ALL SELECT DISTINCT 'Operation', m.value, 'SEEN_ON', 'Host', hostname FROM log JOIN mentions m ON m.log_id = log.id AND m.type = 'operation')"""


def sql(body: str, base: str = SQL_EVENTS, recursive: bool = False) -> str:
    """A query over the view for the other engine."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{base.strip()}\n{body.strip()}"
