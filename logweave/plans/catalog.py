"""Every operator as a query over the driver's tables, with its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import normalize
from logweave.operators import aggregates as A
from logweave.operators import anomalies, entities, exports, filters, graph, ledger, quality, questions, retrieval, textindex
from logweave.operators.filters import LogFilter

from . import checks, stores
from . import logview as V
from . import shapes
from .question_sql import QUESTIONS as QUESTION_SQL
from .logview import SQL_EVENTS, SQL_GRAPH, SQL_MENTIONS, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, make: Callable[..., DataFrame], body: str | None = None, base: str = SQL_EVENTS, recursive: bool = False, needs: str = "l", types: tuple[str, ...] | None = None, rels: tuple[str, ...] | None = None, heavy: bool = False) -> None:
    """Registers ``make`` with the tables named in ``needs``: log, mentions, nodes, edges, or spark and folder. ``types``
    and ``rels`` say of which types and relationships it reads mentions and edges, if not of all; ``heavy``, whether it runs many patterns on each event, as mentions do."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if needs == "s":
            return make(spark, sf_dir)
        log = V.events(spark, sf_dir, heavy or bool(set(needs) & set("mne")))
        m = V.mentions(log, types) if set(needs) & set("mn") else None
        parts = {"l": log, "m": m, "n": V.nodes(log, m) if "n" in needs else None, "e": V.edges(log, rels) if "e" in needs else None}
        return make(*(parts[c] for c in needs))

    QUERIES[name] = run
    if body is not None:
        ORACLE[name] = body if body.lstrip().upper().startswith("WITH") else sql(body, base, recursive)


ERR, ALERT = "count(*) FILTER (severity_score <= 3) AS errors", "count(*) FILTER (severity_score <= 2) AS alerts"
COUNTS = f"count(*) AS total, {ERR}"
SOME = LogFilter(start="2024-01-05", end="2024-01-20", source_type="NSX", search="REQUEST")
SOME_SQL = "day >= '2024-01-05' AND day <= '2024-01-20' AND source_type = 'NSX' AND contains(lower(message), 'request')"

# --- filters and listings
ROWS = "id, timestamp, day, hostname, source_type, process, component, severity, severity_score, message, matched_format"
BAND = "CASE WHEN severity_score <= 2 THEN 'critical' WHEN severity_score = 3 THEN 'error' WHEN severity_score = 4 THEN 'warning' END AS alert_level"
query("f1_filtered", lambda log: SOME(log).select("id", "day", "hostname", "message"), f"SELECT id, day, hostname, message FROM log WHERE {SOME_SQL}")
query("f4_listing", lambda log: filters.list_logs(log, SOME, limit=50), f"SELECT {ROWS}, {BAND} FROM log WHERE {SOME_SQL} ORDER BY timestamp DESC, id DESC LIMIT 50")
query("f5_next_page", lambda log: filters.list_logs(log, newest=False, after="2024-01-10T00:00:00", limit=40, hostname="node-03"), f"SELECT {ROWS}, {BAND} FROM log WHERE hostname = 'node-03' AND timestamp > '2024-01-10T00:00:00' ORDER BY timestamp, id LIMIT 40")
query("f6_alerts", lambda log: filters.alerts(log, None, limit=75), f"SELECT {ROWS}, {BAND} FROM log WHERE severity_score BETWEEN 1 AND 4 ORDER BY timestamp DESC, id DESC LIMIT 75")
query("f7_bands", lambda log: log.groupBy(filters.band(F.col("severity_score")).alias("alert_level")).agg(F.count("*").alias("n")), f"SELECT {BAND}, count(*) AS n FROM log GROUP BY 1")
query("f8_time_window", lambda log: filters.time_window(log, "2024-01-03", "2024-01-04", "node-05"), f"SELECT {ROWS} FROM log WHERE timestamp BETWEEN '2024-01-03T00:00:00' AND '2024-01-04T23:59:59.999999' AND hostname = 'node-05' ORDER BY timestamp, id LIMIT 200")
_ONE = "(SELECT min(id) FROM log)"
query("f9_detail", lambda log, m: _detail(log, m), f"SELECT id, timestamp, message, (SELECT string_agg(type || '=' || value, ';' ORDER BY type, value) FROM mentions WHERE log_id = id) AS entities FROM log WHERE id = {_ONE}", SQL_MENTIONS, needs="lm")
query("f10_distinct", lambda log: filters.distinct_values(log, "component"), "SELECT DISTINCT component AS value FROM log ORDER BY 1 LIMIT 500")
query("f12_sample", lambda log: filters.sample(log, 30).select("id", "message"), "SELECT id, message FROM log ORDER BY md5(id), id LIMIT 30")
query("f12_stratified", lambda log: filters.stratified(log, 3).select("id", "source_type"), "SELECT id, source_type FROM (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY md5(id), id) AS n FROM log) WHERE n <= 3")
query("s12_ordered_export", lambda log: log.where("timestamp is not null").orderBy("timestamp", "id").select("id", "timestamp", "raw_message", "raw_hash"), "SELECT id, timestamp, raw_message, raw_hash FROM log")


def _first_id(log: DataFrame) -> str:
    return log.agg(F.min("id")).first()[0]


def _detail(log, m):
    out = filters.detail(log, m, _first_id(log))
    return out.select("id", "timestamp", "message", F.array_join(F.transform("entities", lambda e: F.concat(e["type"], F.lit("="), e["value"])), ";").alias("entities"))


# --- aggregates
OVER = "count(*) AS total_logs, count(DISTINCT hostname) AS total_hosts, count(DISTINCT source_type) AS total_sources, count(*) FILTER (severity_score <= 4) AS total_alerts, count(*) FILTER (severity_score <= 2) AS total_critical, count(*) FILTER (severity_score = 3) AS error_level, count(*) FILTER (severity_score <= 3) AS total_errors, count(*) FILTER (severity_score = 4) AS total_warnings, min(timestamp) AS earliest_timestamp, max(timestamp) AS latest_timestamp"
query("a1_overview", lambda log, m: A.overview(log, m), f"SELECT {OVER}, (SELECT count(DISTINCT value) FROM mentions WHERE type = 'user') AS total_users FROM log", SQL_MENTIONS, needs="lm", types=("user",))
query("a1_overview_filtered", lambda log, m: A.overview(log, m, SOME), f"SELECT {OVER}, count(DISTINCT user_name) AS total_users FROM log WHERE {SOME_SQL}", SQL_MENTIONS, needs="lm", types=("user",))
query("a2_by_day", lambda log: A.by_day(log, 14), f"SELECT * FROM (SELECT day AS bucket, count(*) AS total, {ALERT}, {ERR} FROM log GROUP BY day ORDER BY day DESC LIMIT 14) ORDER BY bucket")
query("a3_within_day", lambda log: A.within_day(log, "2024-01-03"), f"SELECT substr(timestamp, 1, 13) AS bucket, count(*) AS total, {ALERT}, {ERR} FROM log WHERE day = '2024-01-03' GROUP BY 1")
query("a3_within_day_minutes", lambda log: A.within_day(log, "2024-01-03", "minute"), f"SELECT substr(timestamp, 1, 16) AS bucket, count(*) AS total, {ALERT}, {ERR} FROM log WHERE day = '2024-01-03' GROUP BY 1")
query("a4_severity", A.severity_distribution, "SELECT severity, severity_score AS score, count(*) AS count FROM log GROUP BY 1, 2")
query("a5_by_source", A.by_source_type, f"SELECT source_type, {COUNTS} FROM log GROUP BY 1")
query("a6_top_hosts", A.top_hosts, f"SELECT hostname AS host, {COUNTS} FROM log GROUP BY 1 ORDER BY total DESC, host LIMIT 10")
query("a6_top_hosts_by_errors", lambda log: A.top_hosts(log, 5, "errors"), f"SELECT hostname AS host, {COUNTS} FROM log GROUP BY 1 ORDER BY errors DESC, host LIMIT 5")
query("a7_top_processes", A.top_processes, f"SELECT process, {COUNTS} FROM log GROUP BY 1 ORDER BY total DESC, process LIMIT 10")
query("a8_error_components", A.top_error_components, "SELECT component, count(*) AS errors FROM log WHERE severity_score <= 3 GROUP BY 1 ORDER BY errors DESC, component LIMIT 10")
query("a9_heat_map", A.heat_map, f"SELECT day, hour, total, errors, sum(total) OVER (PARTITION BY day)::BIGINT AS day_total, round(sqrt(total) / sqrt(max(total) OVER ()) * 4)::INTEGER AS bucket FROM (SELECT day, CAST(substr(timestamp, 12, 2) AS INTEGER) AS hour, {COUNTS} FROM log WHERE day IN (SELECT DISTINCT day FROM log ORDER BY day DESC LIMIT 14) GROUP BY 1, 2)")
query("a10_error_rate", lambda log: A.error_rate_by_day(log, 20), f"SELECT *, round(avg(error_rate) OVER (), 6) AS mean_rate FROM (SELECT day AS bucket, {COUNTS}, 100.0::DOUBLE * (count(*) FILTER (severity_score <= 3)) / count(*) AS error_rate FROM log GROUP BY day ORDER BY day DESC LIMIT 20)")
query("a11_top_messages", A.top_messages, "SELECT substr(message, 1, 120) AS pattern, count(*) AS occurrences, array_to_string(list_sort(list_distinct(list(hostname)))[1:4], ',') AS hosts, arg_min(severity, (timestamp, id)) AS severity FROM log WHERE severity_score <= 3 GROUP BY 1 ORDER BY occurrences DESC, pattern LIMIT 10")
query("a12_severity_by_source", A.severity_by_source, "SELECT source_type, count(*) AS total, count(*) FILTER (severity_score <= 2) AS critical, count(*) FILTER (severity_score = 3) AS errors, count(*) FILTER (severity_score = 4) AS warnings FROM log GROUP BY 1")
query("a13_formats", A.parse_coverage, "SELECT matched_format, count(*) AS count FROM log GROUP BY 1")
query("a14_fields", lambda log: A.field_coverage(log.withColumn("source_file", F.col("file"))), "SELECT f.field, f.required, f.present, round(100.0 * f.present / n, 2) AS percent, f.required AND f.present < n AS violation FROM (SELECT count(*) AS n, count(file) AS files FROM log), LATERAL (VALUES " + ", ".join(f"('{x}', true, n)" for x in ("id", "timestamp", "day", "hostname", "process", "component", "source_type", "severity", "severity_score", "message", "normalized_message", "raw_hash", "raw_message", "matched_format")) + ", ('source_file', false, files)) f(field, required, present)")
query("a15_ocsf_classes", lambda log: exports.ocsf_coverage(_with_attributes(log)), "SELECT class_uid, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM (SELECT CASE WHEN k % 5 = 0 THEN 3002 WHEN k % 5 = 1 THEN 4001 ELSE 1008 END AS class_uid FROM log) GROUP BY 1")
query("a16_parse_summary", A.parse_summary, "SELECT fact, key, count, round(100.0 * count / sum(count) OVER (PARTITION BY fact), 4) AS share FROM (SELECT 'source_type' AS fact, source_type AS key, count(*) AS count FROM log GROUP BY 2 UNION ALL SELECT 'matched_format', matched_format, count(*) FROM log GROUP BY 2 UNION ALL SELECT 'entity_type', type, count(*) FROM mentions GROUP BY 2)", SQL_MENTIONS, needs="lm")
query("a17_facts", A.facts, "SELECT 'total' AS fact, 'all' AS key, count(*) AS value FROM log UNION ALL SELECT 'severity', severity, count(*) FROM log GROUP BY 2 UNION ALL (SELECT 'source', source_type, count(*) AS v FROM log GROUP BY 2 ORDER BY v DESC, 2 LIMIT 10) UNION ALL (SELECT 'day', day, count(*) FROM log GROUP BY 2 ORDER BY 2 DESC LIMIT 14) UNION ALL (SELECT 'error_host', hostname, count(*) AS v FROM log WHERE severity_score <= 3 GROUP BY 2 ORDER BY v DESC, 2 LIMIT 10) UNION ALL (SELECT 'error_message', substr(message, 1, 90), count(*) AS v FROM log WHERE severity_score <= 3 GROUP BY 2 ORDER BY v DESC, 2 LIMIT 8)")
query("a18_hosts_by_severity", lambda log: A.template(log, "top_hosts_by_severity", "error"), "SELECT hostname, severity, count(*) AS count FROM log WHERE severity = 'ERROR' GROUP BY 1, 2 ORDER BY count DESC, 1, 2 LIMIT 20")
query("a18_count_by_severity", lambda log: A.template(log, "count_by_severity"), "SELECT severity, count(*) AS count FROM log GROUP BY 1")
query("a18_host_inventory", lambda log: A.template(log, "host_inventory"), "SELECT hostname, count(*) AS count, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM log GROUP BY 1 ORDER BY 1 LIMIT 20")
query("a19_dashboard", lambda log: _dashboard(log), f"SELECT * FROM (SELECT 'overview' AS panel, 1 AS n UNION ALL SELECT 'by_day', least(30, count(DISTINCT day)) FROM log WHERE {SOME_SQL} UNION ALL SELECT 'severity', count(DISTINCT severity) FROM log WHERE {SOME_SQL} UNION ALL SELECT 'sources', count(DISTINCT source_type) FROM log WHERE {SOME_SQL} UNION ALL SELECT 'hosts', least(10, count(DISTINCT hostname)) FROM log WHERE {SOME_SQL} UNION ALL SELECT 'formats', count(DISTINCT matched_format) FROM log WHERE {SOME_SQL})")
query("a20_composition", graph.composition, "SELECT label, count(*) AS nodes FROM nodes GROUP BY 1", SQL_GRAPH, needs="n")
query("a21_relationships", graph.relationship_counts, "SELECT rel, count(*) AS edges FROM edges GROUP BY 1", SQL_GRAPH, needs="e")
query("a22_top_entities", A.top_entities, "SELECT type, value, mentions, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY mentions DESC, value) AS rank FROM (SELECT type, value, count(*) AS mentions FROM mentions GROUP BY 1, 2)) WHERE rank <= 5", SQL_MENTIONS, needs="m")
query("a23_shares", lambda log: A.shares(A.top_hosts(log, 100), "host", "total", 5), "SELECT slice, sum(total)::BIGINT AS value, count(*) AS members, round(100.0 * sum(total) / sum(sum(total)) OVER (), 4) AS share FROM (SELECT CASE WHEN row_number() OVER (ORDER BY total DESC, host) <= 5 THEN host ELSE 'Other' END AS slice, total FROM (SELECT hostname AS host, count(*) AS total FROM log GROUP BY 1)) GROUP BY 1")


def _with_attributes(log: DataFrame) -> DataFrame:
    """Attributes and messages that make a fifth of the events logons and a fifth connections."""
    k = F.col("k") % 5
    address = F.concat(F.lit("10.0."), (F.col("event_id") % 250).cast("string"), F.lit(".1"))
    empty = F.create_map().cast("map<string,string>")
    attributes = F.when(k == 0, F.create_map(F.lit("user"), F.col("user_name"), F.lit("action"), F.lit("login failed"))).when(k == 1, F.create_map(F.lit("src"), address, F.lit("dst"), F.lit("10.9.9.9"), F.lit("spt"), F.lit("443"), F.lit("action"), F.lit("denied"))).otherwise(empty)
    return log.withColumn("attributes", attributes)


def _dashboard(log: DataFrame) -> DataFrame:
    panels = A.dashboard(log, SOME)
    out = None
    for name in ("overview", "by_day", "severity", "sources", "hosts", "formats"):
        one = panels[name].agg(F.lit(name).alias("panel"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


# --- questions
for _name, _text in QUESTION_SQL.items():
    _tables = sorted(questions.tables_of(_name))

    def _make(*frames, _name=_name, _tables=_tables):
        return questions.ask(_name, **dict(zip(_tables, frames, strict=True)))

    _base = SQL_GRAPH if set(_tables) & {"nodes", "edges"} else SQL_MENTIONS if "mentions" in _tables else SQL_EVENTS
    query(_name, _make, _text, _base, needs="".join({"log": "l", "mentions": "m", "nodes": "n", "edges": "e"}[t] for t in _tables), rels=questions.RELATIONSHIPS.get(_name))

# --- statistics
Z = """z AS (SELECT t.*, med AS baseline, n AS points, CASE WHEN n < 2 THEN 0.0 WHEN mad > 0 THEN 0.6745::DOUBLE * (v - med) / mad WHEN mean_off > 0 THEN (v - med) / (1.253314::DOUBLE * mean_off) ELSE 0.0 END AS z
  FROM t, (SELECT median(v) AS med, count(*) AS n FROM t), (SELECT median(abs(v - (SELECT median(v) FROM t))) AS mad, avg(abs(v - (SELECT median(v) FROM t))) AS mean_off FROM t))"""
query("w2_modified_z", lambda log: _z(log), SQL_EVENTS.strip().join(["WITH ", f""", t AS (SELECT day, count(*)::DOUBLE AS v FROM log GROUP BY 1), {Z} SELECT day, v AS total, baseline, points, round(z, 9) AS z FROM z"""]))
_FIND = "round(abs(z), 2) AS score, round(v, 2) AS observed, round(baseline, 2) AS baseline, CASE WHEN v >= baseline THEN 'above' ELSE 'below' END AS direction, CASE WHEN abs(z) >= 6 THEN 'high' ELSE 'medium' END AS severity"


def _z_named(name: str, table: str) -> str:
    return Z.replace("z AS (SELECT", f"{name} AS (SELECT", 1).replace("t.*", f"{table}.*").replace("FROM t", f"FROM {table}")


query("w3_findings", lambda log: anomalies.detect(log, threshold=1.5), SQL_EVENTS.strip().join(["WITH ", f""",
t1 AS (SELECT day AS subject, count(*)::DOUBLE AS v FROM log GROUP BY 1), t2 AS (SELECT day AS subject, (count(*) FILTER (severity_score <= 3))::DOUBLE / count(*)::DOUBLE * 100 AS v FROM log GROUP BY 1),
t3 AS (SELECT hostname AS subject, (count(*) FILTER (severity_score <= 3))::DOUBLE / count(*)::DOUBLE * 100 AS v FROM log GROUP BY 1 HAVING count(*) >= 50),
{_z_named('z1', 't1')}, {_z_named('z2', 't2')}, {_z_named('z3', 't3')}
SELECT * FROM (SELECT 'volume_spike' AS kind, subject, {_FIND} FROM z1 WHERE points >= 7 AND abs(z) >= 1.5 UNION ALL SELECT 'error_rate_spike', subject, {_FIND} FROM z2 WHERE points >= 7 AND abs(z) >= 1.5
UNION ALL SELECT 'noisy_host', subject, {_FIND} FROM z3 WHERE points >= 7 AND z >= 1.5 AND v > 0) ORDER BY score DESC, kind, subject LIMIT 25"""]))
query("w7_trend", lambda log: anomalies.trend(log, 3), """SELECT days, recent_rate, prior_rate, round(recent_rate - prior_rate, 1) AS change, CASE WHEN recent_rate > prior_rate THEN 'worsened' ELSE 'improved' END AS direction FROM (
SELECT count(*) AS days, round(100.0 * sum(errors) FILTER (n <= 3) / sum(total) FILTER (n <= 3), 1) AS recent_rate, round(100.0 * sum(errors) FILTER (n > 3 AND n <= 6) / sum(total) FILTER (n > 3 AND n <= 6), 1) AS prior_rate
FROM (SELECT day, count(*) AS total, count(*) FILTER (severity_score <= 3) AS errors, row_number() OVER (ORDER BY day DESC) AS n FROM log GROUP BY day)) WHERE days >= 6 AND prior_rate > 0 AND abs(round(recent_rate - prior_rate, 1)) >= 1""")


def _z(log: DataFrame) -> DataFrame:
    days = log.groupBy("day").agg(F.count("*").cast("double").alias("total"))
    return anomalies.modified_z(days, "total").withColumn("z", F.round("z", 9))


# --- entities and graph
query("g4_mentions", lambda m: m.select("log_id", "type", "value"), "SELECT * FROM mentions", SQL_MENTIONS, needs="m")
query("g6_nodes", lambda n: n, "SELECT label, value, first_seen, last_seen FROM nodes", SQL_GRAPH, needs="n")
query("g8_event_edges", lambda log, m: graph.event_edges(log, m).groupBy("rel", "dst_label").agg(F.count("*").alias("edges"), F.countDistinct("dst").alias("targets")), """SELECT rel, dst_label, count(*) AS edges, count(DISTINCT dst) AS targets FROM (
SELECT 'EMITTED' AS rel, 'Host' AS dst_label, hostname AS dst FROM log UNION ALL SELECT 'FROM_SOURCE', 'SourceType', source_type FROM log UNION ALL SELECT 'EMITTED_BY', 'Process', process FROM log UNION ALL SELECT 'FROM_COMPONENT', 'Component', component FROM log
UNION ALL SELECT 'HAS_SEVERITY', 'Severity', severity FROM log UNION ALL SELECT 'ON_DAY', 'Day', day FROM log
UNION ALL SELECT CASE type WHEN 'user' THEN 'PERFORMED_BY' WHEN 'trace' THEN 'HAS_TRACE' WHEN 'file' THEN 'TOUCHED_FILE' WHEN 'operation' THEN 'PART_OF_OPERATION' ELSE 'INVOLVES_IP' END, CASE type WHEN 'user' THEN 'User' WHEN 'trace' THEN 'Trace' WHEN 'file' THEN 'File' WHEN 'operation' THEN 'Operation' ELSE 'IPAddress' END, value FROM mentions) GROUP BY 1, 2""", SQL_MENTIONS, needs="lm")
query("g9_edges", lambda e: e, "SELECT * FROM edges", SQL_GRAPH, needs="e")
_TWO = """, both_ways AS (SELECT src_label AS al, src AS a, rel, dst_label AS bl, dst AS b FROM edges UNION ALL SELECT dst_label, dst, rel, src_label, src FROM edges)"""
query("g10_neighbours", lambda e: graph.neighbours(e, "Host", "node-03", 2), """, r0 AS (SELECT 'Host' AS label, 'node-03' AS value), r1 AS (SELECT DISTINCT bl AS label, b AS value FROM both_ways, r0 WHERE al = label AND a = value),
r2 AS (SELECT DISTINCT bl AS label, b AS value FROM both_ways, r1 WHERE al = label AND a = value)
SELECT label, value, min(hop)::INTEGER AS hop FROM (SELECT *, 1 AS hop FROM r1 UNION ALL SELECT *, 2 FROM r2) WHERE NOT (label = 'Host' AND value = 'node-03') GROUP BY 1, 2""", SQL_GRAPH + _TWO, needs="e")
query("g11_path", lambda e: graph.shortest_path(e, ("User", "user-1"), ("Component", "click.2")).select(F.array_join("nodes", ">").alias("nodes"), F.array_join("rels", ">").alias("rels"), "hops"), """, p(label, value, nodes, rels, hops) AS (SELECT 'User', 'user-1', ['User:user-1'], CAST([] AS VARCHAR[]), 0
UNION ALL SELECT label, value, nodes, rels, hops FROM (SELECT bl AS label, b AS value, list_append(nodes, bl || ':' || b) AS nodes, list_append(rels, rel) AS rels, hops + 1 AS hops, row_number() OVER (PARTITION BY bl, b ORDER BY list_append(nodes, bl || ':' || b), list_append(rels, rel)) AS n
FROM p JOIN both_ways ON al = label AND a = value WHERE hops < 3 AND NOT list_contains(nodes, bl || ':' || b)) WHERE n = 1)
SELECT array_to_string(nodes, '>') AS nodes, array_to_string(rels, '>') AS rels, hops FROM p WHERE label = 'Component' AND value = 'click.2' ORDER BY hops, p.nodes LIMIT 1""", SQL_GRAPH + _TWO, recursive=True, needs="e")
query("g12_resolve", lambda n: graph.resolve(n, "NODE-0"), "SELECT label, value, false AS exact FROM nodes WHERE contains(lower(value), 'node-0') ORDER BY label, value LIMIT 5", SQL_GRAPH, needs="n")
query("g13_correlated", lambda log, m: graph.correlated(log, m, _first_id(log)), f""", own AS (SELECT type, value FROM mentions WHERE log_id = {_ONE} AND type IN ('operation', 'trace', 'task'))
SELECT log.id, timestamp, hostname, message, min(m.type) AS via FROM log JOIN mentions m ON m.log_id = log.id JOIN own ON own.type = m.type AND own.value = m.value WHERE log.id <> {_ONE} GROUP BY ALL ORDER BY timestamp, id LIMIT 50""", SQL_MENTIONS, needs="lm")
query("g14_triples", graph.schema_triples, "SELECT src_label, rel, dst_label, count(*) AS edges FROM edges GROUP BY ALL", SQL_GRAPH, needs="e")
query("g15_blast_radius", lambda e, n: graph.blast_radius(e, n, "user-7", 1), "SELECT bl AS label, b AS value, 1 AS hop FROM both_ways WHERE al = 'User' AND a = 'user-7' GROUP BY ALL", SQL_GRAPH + _TWO, needs="en")
query("j5_related", lambda log, m: graph.related(log, m, log.where("severity_score = 2 and hostname = 'node-01'").select("id")), """, seeds AS (SELECT id FROM log WHERE severity_score = 2 AND hostname = 'node-01'), via AS (SELECT DISTINCT type, value FROM mentions WHERE log_id IN (SELECT id FROM seeds)),
hits AS (SELECT log_id, min((m.type, m.value)) AS v FROM mentions m JOIN via ON via.type = m.type AND via.value = m.value WHERE log_id NOT IN (SELECT id FROM seeds) GROUP BY 1)
SELECT id, severity_score, timestamp, v[1] AS via_type, v[2] AS via_value FROM log JOIN hits ON log_id = id ORDER BY severity_score, timestamp, id LIMIT 20""", SQL_MENTIONS, needs="lm")
query("j9_labels", lambda m: entities.labelled(m).groupBy("label", "rel").agg(F.count("*").alias("n")), "SELECT CASE type WHEN 'user' THEN 'User' WHEN 'trace' THEN 'Trace' WHEN 'file' THEN 'File' WHEN 'operation' THEN 'Operation' ELSE 'IPAddress' END AS label, CASE type WHEN 'user' THEN 'PERFORMED_BY' WHEN 'trace' THEN 'HAS_TRACE' WHEN 'file' THEN 'TOUCHED_FILE' WHEN 'operation' THEN 'PART_OF_OPERATION' ELSE 'INVOLVES_IP' END AS rel, count(*) AS n FROM mentions GROUP BY 1, 2", SQL_MENTIONS, needs="m")


# --- retrieval
def _vector(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = rows.where("vec_id = 7").first()["embedding"]
    return retrieval.vector_search(rows, list(q), 10, where=F.col("label") < 5).withColumn("score", F.round("score", 9))


query("r1_vectors", _vector, "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], e) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(e, e))), 9) AS score FROM embeddings, q WHERE label < 5 ORDER BY 2 DESC, 1 LIMIT 10", needs="s")
_WORDS = ("license", "public", "rights")
query("r2_keywords", lambda spark, sf_dir: retrieval.keyword_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), " ".join(_WORDS), 20), f"""WITH own AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: length(t) > 2) AS t FROM documents),
st AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM own), tf AS (SELECT doc_id, len(t) AS n, w, len(list_filter(t, lambda x: x = w)) AS tf FROM own, (SELECT unnest({list(_WORDS)}) AS w)), hit AS (SELECT * FROM tf WHERE tf > 0), df AS (SELECT w, count(*) AS df FROM hit GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score, count(*) AS words FROM hit JOIN df USING (w), st GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""", needs="s")
query("r3_substring", lambda log: retrieval.substring_search(log, "any error Purchase?"), "SELECT id, timestamp, hostname, severity, severity_score, message FROM log WHERE contains(lower(message), 'purchase') ORDER BY severity_score, timestamp, id LIMIT 20")
query("r6_signature", lambda log: retrieval.pattern_match(_isolated(log), "host_isolation").select("id", "message"), "SELECT id, message || ' - host was isolated' AS message FROM log WHERE k % 10 = 0")
query("r8_evidence", lambda log: _evidence(log), "SELECT id, score, pool FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pool, score DESC) AS n FROM (SELECT id, 1.0::DOUBLE / severity_score AS score, 0 AS pool FROM log WHERE hostname = 'node-02' UNION ALL SELECT id, 2.0::DOUBLE / severity_score, 1 FROM log WHERE process = 'errord')) WHERE n = 1 ORDER BY score DESC, id LIMIT 15")
query("r9_context", lambda log: retrieval.context(filters.list_logs(log, limit=40)), "SELECT substr(string_agg(line, chr(10) ORDER BY timestamp, line), 1, 12000) AS context FROM (SELECT timestamp, '[' || timestamp || '] ' || severity || ' ' || hostname || '/' || process || ': ' || message AS line FROM log ORDER BY timestamp DESC, id DESC LIMIT 40)")
query("r10_chart", lambda log: retrieval.chart_spec(A.by_day(log, 20)), "SELECT 'bucket' AS label, 'total,alerts,errors' AS measures, count(DISTINCT day) BETWEEN 2 AND 40 AS chartable, 'line' AS kind FROM (SELECT DISTINCT day FROM log ORDER BY day DESC LIMIT 20)")


def _isolated(log):
    return log.withColumn("message", F.concat("message", F.when(F.col("k") % 10 == 0, " - host was isolated").otherwise(" - Isolation of hosts ended")))


def _evidence(log):
    by = lambda w, n: log.where(w).select("id", (F.lit(float(n)) / F.col("severity_score")).alias("score"))
    return retrieval.evidence([by("hostname = 'node-02'", 1), by("process = 'errord'", 2)])


# --- exports
_LINE = "substr(message, 1, 120)"
query("x1_ndjson", lambda log: exports.ndjson(log, raw=False).select("id", F.get_json_object("value", "$.hostname").alias("hostname"), F.get_json_object("value", "$.message").alias("message"), F.get_json_object("value", "$.severity_score").cast("int").alias("severity_score")), "SELECT id, hostname, message, severity_score FROM log")
query("x2_ecs", lambda log: exports.ecs(log).select("id", F.get_json_object("value", "$.host.name").alias("host"), F.get_json_object("value", "$.event.original").alias("original"), F.get_json_object("value", "$.log.level").alias("level"), F.get_json_object("value", "$.ecs.version").alias("version")), "SELECT id, hostname AS host, raw_message AS original, severity AS level, '8.11.0' AS version FROM log")
query("x3_ocsf", lambda log: exports.with_ocsf(_with_attributes(log)).select("id", "class_uid", "activity_id", "type_uid", "status_id", "severity_id"), "SELECT id, c AS class_uid, a AS activity_id, c * 100 + a AS type_uid, s AS status_id, CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'ERROR' THEN 4 WHEN 'WARNING' THEN 3 WHEN 'NOTICE' THEN 2 ELSE 1 END AS severity_id FROM (SELECT *, CASE k % 5 WHEN 0 THEN 3002 WHEN 1 THEN 4001 ELSE 1008 END AS c, CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 6 ELSE 0 END AS a, CASE WHEN k % 5 < 2 THEN 2 END AS s FROM log)")
query("x4_ocsf_documents", lambda log: exports.ocsf(_with_attributes(log)).select("id", F.get_json_object("value", "$.type_uid").cast("int").alias("type_uid"), F.get_json_object("value", "$.src_endpoint.ip").alias("ip"), F.get_json_object("value", "$.user.name").alias("user_name"), F.get_json_object("value", "$.time").cast("long").alias("time")), "SELECT id, CASE k % 5 WHEN 0 THEN 300201 WHEN 1 THEN 400106 ELSE 100800 END AS type_uid, CASE WHEN k % 5 = 1 THEN '10.0.' || (event_id % 250) || '.1' END AS ip, CASE WHEN k % 5 = 0 THEN user_name END AS user_name, epoch_us(ts) // 1000 AS time FROM log")
query("x5_cef", lambda log: exports.cef(log, raw=False), f"""SELECT id, 'CEF:0|logweave|Event export|1.0|' || matched_format || '|' || {_LINE} || '|' || CASE severity_score WHEN 2 THEN 9 WHEN 3 THEN 7 WHEN 4 THEN 5 WHEN 5 THEN 4 WHEN 6 THEN 3 ELSE 1 END || '|rt=' || timestamp || ' dvchost=' || hostname || ' deviceProcessName=' || process || ' cat=' || source_type || ' msg=' || replace(message, '=', '\\=') || ' cs1Label=severity cs1=' || severity || ' cs2Label=component cs2=' || component || ' externalId=' || id AS value FROM log""")
query("x6_csv", lambda log: exports.csv(log, raw=False).select("id", "timestamp", "hostname", "severity_score", "http_status", "confidence"), "SELECT id, timestamp, hostname, severity_score, NULL::INTEGER AS http_status, NULL::DOUBLE AS confidence FROM log")
query("x8_syslog", lambda log: exports.syslog_frame(log), "SELECT id, octet_length(encode(line)) || ' ' || line AS value FROM (SELECT id, '<' || (128 + severity_score) || '>1 ' || timestamp || ' ' || hostname || ' ' || process || ' - - - CEF:0|logweave|' || source_type || '|1.0|' || matched_format || '|' || substr(message, 1, 200) || '|' || severity_score || '|' AS line FROM (SELECT * REPLACE (severity_score AS severity_score) FROM log))")
query("x13_upsert", lambda log: _upsert(log), "SELECT id, message, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS version FROM log WHERE k % 3 = 0 OR k % 2 = 0")


def _upsert(log):
    stored = log.where("k % 2 = 0").select("id", "message", F.lit(1).alias("version"))
    new = log.where("k % 3 = 0").select("id", "message", F.explode(F.array(F.lit(0), F.lit(2))).alias("version"))
    return exports.upsert(stored, new, order="version")


# --- ledger
query("i1_leaves", lambda log: ledger.leaves(log), f"SELECT (n - 1) // 500 AS height, (n - 1) % 500 AS idx, id AS event_id, sha256(unhex('00') || encode({checks.CANON})) AS hash FROM (SELECT *, row_number() OVER (ORDER BY timestamp, id) AS n FROM log)")
query("i8_match_raw", lambda log: ledger.match_raw(log.select(F.lit("f").alias("source_file"), F.col("event_id").alias("source_record"), F.col("raw_message").alias("raw")), log), "SELECT 'f' AS source_file, event_id AS source_record, raw_hash, id AS event_id FROM log")


# --- quality
def _originals(log):
    return log.select(F.concat(F.lit("file-"), (F.col("event_id") % 4).cast("string")).alias("source_file"), F.col("event_id").alias("source_record"), F.col("raw_message").alias("raw"))


query("d1_completeness", lambda log: quality.completeness(_originals(log), _originals(log.where("k <> 5")).unionByName(_originals(log.where("k = 7")))), "SELECT 'file-' || event_id % 4 AS file, count(*)::BIGINT AS original, (count(*) FILTER (k <> 5) + count(*) FILTER (k = 7))::BIGINT AS stored, (count(*) FILTER (k = 5))::BIGINT AS missing, (count(*) FILTER (k = 7))::BIGINT AS extra, count(*) FILTER (k = 5) = 0 AND count(*) FILTER (k = 7) = 0 AS exact FROM log GROUP BY 1")
query("d2_accuracy", lambda log: quality.field_accuracy(log).groupBy("hostname_check", "process_check", "severity_check").agg(F.count("*").alias("n")), "SELECT 'confirmed' AS hostname_check, 'confirmed' AS process_check, CASE WHEN process <> 'errord' THEN 'inferred' WHEN severity = 'ERROR' THEN 'confirmed' ELSE 'contradicted' END AS severity_check, count(*) AS n FROM log GROUP BY ALL")
query("d3_entity_quality", lambda m: entities.quality(m), "SELECT type, sum(n)::BIGINT AS total, count(*) AS distinct_values, 0::BIGINT AS misshapen, 0::BIGINT AS mistyped, sum(n) >= 200 AND count(*) / sum(n) > 0.95 AND type NOT IN ('operation', 'trace') AS alarm FROM (SELECT type, value, count(*) AS n FROM mentions GROUP BY 1, 2) GROUP BY 1", SQL_MENTIONS, needs="m")
query("d8_skew", lambda log: quality.backfill_skew(log, "2026-01-10").groupBy("timestamp_anomalous").agg(F.count("*").alias("n")), "SELECT abs(datediff('day', CAST(day AS DATE), DATE '2026-01-10')) > 730 AS timestamp_anomalous, count(*) AS n FROM log GROUP BY 1")
query("d9_backfill_by_id", lambda log: _backfilled(log), "SELECT id, CASE WHEN k < 50 THEN 'f-' || k END AS source_file, CASE WHEN k < 50 THEN event_id END AS source_record FROM log")
query("d9_backfill_by_raw", lambda log: quality.backfill_by_raw(_bare(log), _originals(log)).select("id", "source_file", "source_record"), "SELECT id, 'file-' || event_id % 4 AS source_file, event_id AS source_record FROM log")
query("d11_verbatim", lambda log: quality.verbatim(_originals(log), log.select(F.concat(F.lit("file-"), (F.col("event_id") % 4).cast("string")).alias("source_file"), F.col("event_id").alias("source_record"), "raw_message")), "SELECT count(*) AS records, count(*) AS verbatim, true AS all_verbatim FROM log")
query("d12_newest", lambda log: quality.newest(log.where("k < 50").select("id", "timestamp"), log.where("k > 40").select("id", "timestamp"), 100), "SELECT id, timestamp FROM log ORDER BY timestamp DESC, id DESC LIMIT 100")


def _bare(log):
    return log.select("id", "raw_message", F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("long").alias("source_record"))


def _backfilled(log):
    lineage = log.where("k < 50").select("id", F.concat(F.lit("f-"), F.col("k").cast("string")).alias("source_file"), F.col("event_id").alias("source_record"))
    return quality.backfill_by_id(_bare(log), lineage).select("id", "source_file", "source_record")


# --- normalisation: events rendered to lines of eight formats and read back


def rendered(log: DataFrame) -> DataFrame:
    """A line for each event, in the format of its number."""
    c, lit = F.col, F.lit
    cat = lambda *x: F.concat(*(v if not isinstance(v, str) else lit(v) for v in x))
    old = F.date_format("ts", "MMM d HH:mm:ss")
    iso = cat(c("timestamp"), "Z")
    words = F.replace("message", lit("="), lit(":"))
    shapes = (
        cat("<", (c("severity_score") + 8).cast("string"), ">", old, " ", c("hostname"), " ", c("process"), "[", c("k").cast("string"), "]: ", words),
        cat("<", (c("severity_score") + 8).cast("string"), ">1 ", iso, " ", c("hostname"), " ", c("process"), " ", c("k").cast("string"), " - - ", words),
        cat(old, " ", c("hostname"), " ", c("process"), "[", c("k").cast("string"), "]: ", words),
        cat("ts=", iso, " level=", F.lower("severity"), " host=", c("hostname"), " app=", c("process"), " msg=\"", words, "\""),
        cat("CEF:0|acme|", c("process"), "|1|", c("component"), "|", words, "|5|rt=", F.unix_millis(c("ts").cast("timestamp")).cast("string"), " dvchost=", c("hostname"), " act=seen"),
        cat("LEEF:1.0|acme|", c("process"), "|1|", words, "|devTime=", F.unix_millis(c("ts").cast("timestamp")).cast("string"), "\thost=", c("hostname"), "\tact=seen"),
        cat("10.1.1.", (c("k") % 250).cast("string"), " - ", c("user_name"), " [", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), " +0000] \"GET /", c("component"), " HTTP/1.1\" ", F.when(c("severity_score") <= 3, "503").otherwise("200"), " 12"),
        F.to_json(F.struct(iso.alias("timestamp"), "hostname", "process", F.lower("severity").alias("level"), words.alias("message"))),
    )
    return log.select("event_id", F.get(F.array(*shapes), (c("event_id") % 8).cast("int")).alias("raw"))


query("p1_normalised", lambda log: normalize.parse(rendered(log), "2024-06-01").select(
    "event_id", "matched_format", F.substring("timestamp", 1, 19).alias("timestamp"), "day", "hostname", "process", "severity", "http_status", "timestamp_source"),
    """SELECT event_id, matched_format, substr(timestamp, 1, 19) AS timestamp, day, CASE WHEN event_id % 8 = 6 THEN 'unknown-host' ELSE hostname END AS hostname, CASE WHEN event_id % 8 = 6 THEN 'httpd' ELSE process END AS process,
CASE WHEN event_id % 8 IN (0, 1) THEN CASE severity_score WHEN 2 THEN 'CRITICAL' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'WARNING' WHEN 5 THEN 'NOTICE' WHEN 6 THEN 'INFO' ELSE 'DEBUG' END
  WHEN event_id % 8 IN (2, 5) THEN CASE WHEN contains(message, 'error') AND event_id % 8 IN (2, 5) THEN 'ERROR' ELSE 'INFO' END WHEN event_id % 8 = 4 THEN 'WARNING' WHEN event_id % 8 = 6 THEN CASE WHEN severity_score <= 3 THEN 'ERROR' ELSE 'INFO' END ELSE severity END AS severity,
CASE WHEN event_id % 8 = 6 THEN CASE WHEN severity_score <= 3 THEN 503 ELSE 200 END END AS http_status, 'event' AS timestamp_source FROM log""", heavy=True)
query("p2_formats", lambda log: normalize.parse(shapes.lines(log), "2024-06-01").select("event_id", "matched_format", "source_type", "hostname", "process", "severity", "component"), shapes.expected_sql(), heavy=True)
query("p24_preview", lambda log: normalize.preview(normalize.parse(rendered(log), "2024-06-01")), "SELECT matched_format, count(*) AS events, CASE WHEN matched_format = 'web_access' THEN 0.0 ELSE 100.0 END::DOUBLE AS with_host, 100.0::DOUBLE AS with_process, 100.0::DOUBLE AS with_time FROM log GROUP BY 1", heavy=True)
query("p12_stable_ids", lambda log: _same_ids(log), "SELECT count(*) AS lines, count(*) AS same_ids, count(*) AS same_hashes FROM log", heavy=True)


def _same_ids(log: DataFrame) -> DataFrame:
    lines = rendered(log)
    a, b = (normalize.parse(lines, "2024-06-01").select("event_id", F.col("id").alias(f"id{n}"), F.col("raw_hash").alias(f"h{n}"), "raw_message") for n in (1, 2))
    both = a.join(b.drop("raw_message"), "event_id")
    return both.agg(F.count("*").alias("lines"), F.count_if(F.col("id1") == F.col("id2")).alias("same_ids"), F.count_if((F.col("h1") == F.col("h2")) & (F.col("h1") == F.sha2("raw_message", 256))).alias("same_hashes"))


query("s3_reassembled", lambda log: _reassembled(log), "SELECT source_file, count(*) AS records, sum(n)::BIGINT AS lines FROM (SELECT 'file-' || event_id % 4 AS source_file, 1 + k % 3 AS n FROM log WHERE k % 7 <> 1) GROUP BY 1")


def _reassembled(log: DataFrame) -> DataFrame:
    """Events as blocks of one to three lines, between blank ones, put together again."""
    from logweave.sources.readers import reassemble

    parts = F.concat(F.array(F.concat_ws(" ", "timestamp", "hostname", "message")), F.slice(F.array(F.lit("  at one"), F.lit("  at two")), 1, (F.col("k") % 3).cast("int")), F.array(F.lit("")))
    lines = log.where("k % 7 <> 1").select(F.concat(F.lit("file-"), (F.col("event_id") % 4).cast("string")).alias("source_file"), F.floor(F.col("event_id") / 1000).alias("block"), F.posexplode(parts).alias("p", "line"), "event_id")
    found = reassemble(lines.withColumn("line_no", F.col("event_id") * 10 + F.col("p")).select("source_file", "block", "line_no", "line"))
    return found.groupBy("source_file").agg(F.count("*").alias("records"), F.sum(F.size(F.split("raw", "\n"))).alias("lines"))


checks.register(query)


# --- the same questions from what jobs have left behind: stored edges, indexes and roll-ups
def beside(name: str, plain: str, make: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name], ORACLE[name] = make, ORACLE[plain]


beside("g10_stored", "g10_neighbours", lambda spark, d: stores.edges(spark, d).neighbours("Host", "node-03", 2))
beside("g11_stored", "g11_path", lambda spark, d: stores.edges(spark, d).shortest_path(("User", "user-1"), ("Component", "click.2")).select(F.array_join("nodes", ">").alias("nodes"), F.array_join("rels", ">").alias("rels"), "hops"))
beside("g12_indexed", "g12_resolve", lambda spark, d: textindex.resolve(stores.names(spark, d), "NODE-0"))
beside("g15_stored", "g15_blast_radius", lambda spark, d: stores.edges(spark, d).blast_radius(stores.names(spark, d), "user-7", 1))
beside("r2_indexed", "r2_keywords", lambda spark, d: stores.documents(spark, d).keywords(" ".join(_WORDS), 20))
beside("r3_indexed", "r3_substring", lambda spark, d: textindex.search_messages(stores.messages(spark, d), V.events(spark, d), "any error Purchase?"))
beside("n_insights_rolled", "n_insights", lambda spark, d: stores.rolled(spark, d).insights())
beside("a11_rolled", "a11_top_messages", lambda spark, d: A.top_messages(stores.rolled(spark, d).fact("message")))
beside("a9_rolled", "a9_heat_map", lambda spark, d: stores.rolled(spark, d).dashboard()["heat_map"])
beside("a6_rolled", "a6_top_hosts", lambda spark, d: stores.rolled(spark, d).dashboard()["hosts"])
beside("w3_rolled", "w3_findings", lambda spark, d: stores.rolled(spark, d).outliers(threshold=1.5))
