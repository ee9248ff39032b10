"""Queries whose SQL is longer than a line: ledger, observations, mining, jobs on stored events, files, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions import normalize
from logweave.operators import entities, exports, insights, ledger, mining, quality, retrieval, rollup
from logweave.schema import GENESIS
from logweave.sources import readers
from logweave.storage import new_path

from . import probes, shapes
from .logview import SQL_MENTIONS

SEALED_AT = "2024-02-01T00:00:00Z"

# --- ledger: leaves, nine levels of nodes, roots, and the chain of headers
_FIELDS = ("hostname", "id", "matched_format", "message", "process", "raw_message", "severity", "source_type", "timestamp")
CANON = "'{' || " + " || ',' || ".join(f"'\"{f}\":' || to_json({f})" for f in _FIELDS) + " || '}'"
_LEAVES = f"""lv AS (SELECT (n - 1) // 500 AS height, (n - 1) % 500 AS idx, id AS event_id, sha256(unhex('00') || encode({CANON})) AS hash FROM (SELECT *, row_number() OVER (ORDER BY timestamp, id) AS n FROM log)),
n0 AS (SELECT height, idx, hash FROM lv)"""
_LEVELS = ",\n".join(f"n{k + 1} AS (SELECT height, idx // 2 AS idx, CASE WHEN count(*) = 2 THEN sha256(unhex('01' || string_agg(hash, '' ORDER BY idx))) ELSE min(hash) END AS hash FROM n{k} GROUP BY 1, 2)" for k in range(9))
_HEADER = f"""sha256('{{"event_count":' || c || ',"height":' || h || ',"merkle_root":"' || r || '","prev_hash":"' || p || '","sealed_at":"{SEALED_AT}","version":"1.0"}}')"""


def _header(c: str, h: str, r: str, p: str) -> str:
    return _HEADER.replace("|| c ||", f"|| {c} ||").replace("|| h ||", f"|| {h} ||").replace("|| r ||", f"|| {r} ||").replace("|| p ||", f"|| {p} ||")


_CHAIN = f""", {_LEAVES}, {_LEVELS},
rt AS (SELECT n9.height, n9.hash AS merkle_root, c.event_count FROM n9 JOIN (SELECT height, count(*) AS event_count FROM lv GROUP BY 1) c ON c.height = n9.height),
ch(height, event_count, merkle_root, hash, prev_hash) AS (SELECT height, event_count, merkle_root, {_header("event_count", "height", "merkle_root", f"'{GENESIS}'")}, '{GENESIS}' FROM rt WHERE height = 0
UNION ALL SELECT rt.height, rt.event_count, rt.merkle_root, {_header("rt.event_count", "rt.height", "rt.merkle_root", "ch.hash")}, ch.hash FROM ch JOIN rt ON rt.height = ch.height + 1)"""


def _tampered(log: DataFrame):
    blocks, tree = ledger.seal(log, SEALED_AT)
    changed = tree.withColumn("hash", F.when((F.col("height") == 3) & (F.col("idx") == 5), F.sha2(F.col("hash"), 256)).otherwise(F.col("hash")))
    return blocks.withColumn("sealed_at", F.when(F.col("height") == 1, "2020").otherwise(F.col("sealed_at"))), changed


def _proofs(log: DataFrame) -> DataFrame:
    blocks, tree = ledger.seal(log, SEALED_AT)
    found = ledger.proofs(tree, tree.select("event_id"))
    return ledger.check_proofs(found, blocks).groupBy("height").agg(F.count("*").alias("events"), F.every("valid").alias("valid"), F.max(F.size("proof")).alias("longest"))


# --- observations: each rule of its own
_PCT = "round(100.0::DOUBLE * ({0}) / ({1}), 1)"
_INSIGHTS = f""", tot AS (SELECT count(*) AS n, count(*) FILTER (severity_score <= 3) AS e, count(*) FILTER (severity_score <= 4) AS a FROM log),
src AS (SELECT source_type, count(*) AS total, count(*) FILTER (severity_score <= 3) AS errors, count(*) FILTER (severity_score <= 2) AS critical, count(*) FILTER (severity_score = 3) AS three FROM log GROUP BY 1),
hst AS (SELECT hostname AS host, count(*) AS total, count(*) FILTER (severity_score <= 3) AS errors FROM log GROUP BY 1 ORDER BY errors DESC, host LIMIT 50),
dly AS (SELECT day, count(*) AS total, count(*) FILTER (severity_score <= 2) AS alerts, count(*) FILTER (severity_score <= 3) AS errors FROM log GROUP BY 1),
hrs AS (SELECT substr(timestamp, 12, 2) AS hour, count(*) AS total, count(*) FILTER (severity_score <= 3) AS errors FROM log GROUP BY 1),
trd AS (SELECT count(*) AS days, {_PCT.format("sum(errors) FILTER (r <= 7)", "sum(total) FILTER (r <= 7)")} AS late, {_PCT.format("sum(errors) FILTER (r > 7 AND r <= 14)", "sum(total) FILTER (r > 7 AND r <= 14)")} AS early FROM (SELECT *, row_number() OVER (ORDER BY day DESC) AS r FROM dly)),
msg AS (SELECT substr(message, 1, 120) AS p, count(*) AS c FROM log WHERE severity_score <= 3 GROUP BY 1 ORDER BY c DESC, p LIMIT 1),
ent AS (SELECT type, mentions, row_number() OVER (PARTITION BY type ORDER BY mentions DESC, value) AS r, lead(mentions) OVER (PARTITION BY type ORDER BY mentions DESC, value) AS second FROM (SELECT type, value, count(*) AS mentions FROM mentions WHERE type IN ('user', 'ip', 'device', 'vm') GROUP BY 1, 2))
SELECT 'empty' AS id, 'info' AS level, 'No logs yet' AS title, 0::DOUBLE AS value FROM tot WHERE n = 0
UNION ALL SELECT 'top-error-source', CASE WHEN v >= 40 THEN 'warning' ELSE 'info' END, source_type || ' produces the most errors', v FROM (SELECT source_type, {_PCT.format("errors", "e")} AS v FROM (SELECT * FROM src WHERE errors > 0 ORDER BY errors DESC, source_type LIMIT 1), tot)
UNION ALL SELECT 'riskiest-host', CASE WHEN v >= 25 THEN 'critical' ELSE 'warning' END, host || ' has the highest error rate', v FROM (SELECT host, {_PCT.format("errors", "total")} AS v FROM hst WHERE total >= 20 ORDER BY v DESC, host LIMIT 1) WHERE v > 0
UNION ALL SELECT 'error-concentration', CASE WHEN v >= 40 THEN 'warning' ELSE 'info' END, host || ' concentrates errors', v FROM (SELECT host, {_PCT.format("errors", "e")} AS v FROM (SELECT * FROM hst ORDER BY errors DESC, host LIMIT 1), tot) WHERE v >= 20
UNION ALL SELECT 'signal-to-noise', 'info', 'Signal and noise', {_PCT.format("(SELECT count(*) FROM log WHERE severity_score >= 6)", "n")} FROM tot WHERE n > 0
UNION ALL SELECT 'alert-volume', CASE WHEN {_PCT.format("a", "n")} >= 5 THEN 'critical' ELSE 'warning' END, a || ' alerts of warning or worse', {_PCT.format("a", "n")} FROM tot WHERE a > 0
UNION ALL (SELECT 'busiest-day', 'info', day || ' was the busiest day', total::DOUBLE FROM dly ORDER BY total DESC, day LIMIT 1)
UNION ALL (SELECT 'worst-day', CASE WHEN alerts >= 10 THEN 'critical' ELSE 'warning' END, day || ' had the most alerts', alerts::DOUBLE FROM dly WHERE alerts > 0 ORDER BY alerts DESC, day LIMIT 1)
UNION ALL SELECT 'error-trend', CASE WHEN late > early THEN 'warning' ELSE 'good' END, 'Error rate has ' || CASE WHEN late > early THEN 'worsened' ELSE 'improved' END, round(late - early, 1) FROM trd WHERE days >= 14 AND early > 0 AND abs(round(late - early, 1)) >= 1
UNION ALL SELECT 'dominant-error-message', CASE WHEN v >= 25 THEN 'warning' ELSE 'info' END, 'One message dominates the errors', v FROM (SELECT {_PCT.format("c", "e")} AS v FROM msg, tot) WHERE v >= 10
UNION ALL (SELECT 'peak-hour', 'info', 'Traffic peaks at ' || hour || ':00 UTC', total::DOUBLE FROM hrs ORDER BY total DESC, hour LIMIT 1)
UNION ALL SELECT 'worst-hour-rate', 'warning', hour || ':00 has a high error rate', v FROM (SELECT hour, {_PCT.format("errors", "total")} AS v FROM hrs WHERE total >= 50 ORDER BY v DESC, hour LIMIT 1), tot WHERE v > 1.5 * {_PCT.format("e", "n")}
UNION ALL SELECT 'unhealthiest-source', CASE WHEN v >= 15 THEN 'warning' ELSE 'info' END, source_type || ' is the least healthy source', v FROM (SELECT source_type, {_PCT.format("three + critical", "total")} AS v FROM src WHERE total >= 100 ORDER BY v DESC, source_type LIMIT 1) WHERE v >= 5
UNION ALL (SELECT 'entity-hotspot-' || type, 'info', 'One ' || type || ' dominates activity', round(mentions / second, 1)::DOUBLE FROM ent WHERE r = 1 AND second IS NOT NULL AND mentions >= greatest(20, second * 3) ORDER BY list_position(['user', 'ip', 'device', 'vm'], type) LIMIT 1)
UNION ALL SELECT 'timestamp-coverage', 'info', 'Logs without a usable date', {_PCT.format("n - d", "n")} FROM tot, (SELECT sum(total) AS d FROM dly) WHERE n > 0 AND d < 0.98 * n"""


def _loud(log: DataFrame) -> DataFrame:
    """Events of the last week fail more often, so that more rules have something to say."""
    last = F.lit("2024-01-24")
    worse = (F.col("day") >= last) & (F.col("k") % 3 == 0)
    return log.withColumn("severity_score", F.when(worse, 3).otherwise(F.col("severity_score"))).withColumn("severity", F.when(worse, "ERROR").otherwise(F.col("severity"))).withColumn("message", F.when(worse, "the disk is full").otherwise(F.col("message")))


_LOUD = "SELECT * REPLACE (CASE WHEN day >= '2024-01-24' AND k % 3 = 0 THEN 3 ELSE severity_score END AS severity_score, CASE WHEN day >= '2024-01-24' AND k % 3 = 0 THEN 'ERROR' ELSE severity END AS severity, CASE WHEN day >= '2024-01-24' AND k % 3 = 0 THEN 'the disk is full' ELSE message END AS message) FROM log"

# --- mining: lines of two shapes, and their tokens one by one
LINE_A = "timestamp || ' ' || hostname || ' ' || process || ': user=' || user_name || ' took ' || k || ' ms'"
LINE_B = "'<13> \"' || component || '\" code=' || k || ' end'"
#: Type, text, and what is told of a field: key, meaning, evidence, trust.
TOKENS_A = (
    ("iso_ts", "timestamp", None, "timestamp", "type", 0.75), ("space", "' '"), ("word", "hostname", None, "hostname", "host slot", 0.85), ("space", "' '"), ("word", "process", None, "process", "program slot", 0.8),
    ("punct", "':'"), ("space", "' '"), ("word", "'user'"), ("punct", "'='"), ("word", "user_name", "user", "user", "key", 0.95), ("space", "' '"), ("word", "'took'"), ("space", "' '"),
    ("int", "k::VARCHAR", None, None, "none", 0.2), ("space", "' '"), ("word", "'ms'"),
)
TOKENS_B = (
    ("priority", "'<13>'", None, None, "none", 0.2), ("space", "' '"), ("quoted", "'\"' || component || '\"'", None, None, "none", 0.2), ("space", "' '"), ("word", "'code'"), ("punct", "'='"),
    ("int", "k::VARCHAR", "code", "code", "own key", 0.6), ("space", "' '"), ("word", "'end'"),
)


def _mined(log: DataFrame) -> DataFrame:
    words = lambda *x: F.concat(*(F.lit(v) if n % 2 else F.col(v).cast("string") for n, v in enumerate(x)))
    a = words("timestamp", " ", "hostname", " ", "process", ": user=", "user_name", " took ", "k", " ms")
    b = F.concat(F.lit('<13> "'), "component", F.lit('" code='), F.col("k").cast("string"), F.lit(" end"))
    return log.select(F.when(F.col("event_id") % 3 != 0, a).otherwise(b).alias("raw"))


def _shape(tokens) -> str:
    return " ".join(t[0] for t in tokens)


def _slots_sql() -> str:
    q = lambda x: "NULL" if x is None else f"'{x}'"
    parts = []
    for tokens, own in ((TOKENS_A, "event_id % 3 <> 0"), (TOKENS_B, "event_id % 3 = 0")):
        for pos, (kind, text, *told) in enumerate(tokens):
            key, meaning, evidence, trust = told or (None, None, None, None)
            parts.append(
                f"SELECT '{_shape(tokens)}' AS shape, {pos} AS pos, '{kind}' AS type, count(*) AS lines, count(DISTINCT {text}) AS \"values\", min({text}) AS example, {q(key)}::VARCHAR AS key, {str(bool(told)).lower()} AS field, "
                f"{q(meaning)}::VARCHAR AS meaning, {q(evidence)}::VARCHAR AS evidence, {trust or 'NULL'}::DOUBLE AS trust, NULL::VARCHAR AS warning FROM log WHERE {own} HAVING count(*) > 0"
            )
    return " UNION ALL ".join(parts)


# --- stored events: an empty time source, stored raw text parsed anew
def _sourceless(log: DataFrame) -> DataFrame:
    raw = F.when(F.col("k") % 4 == 0, F.concat(F.lit("no time at all "), F.col("k").cast("string"))).otherwise(F.col("raw_message"))
    return log.select("id", raw.alias("raw_message"), F.when(F.col("k") % 5 == 0, "file").alias("timestamp_source"))


#: Entities of a line of each shape, by its number; those of the others are none. Stored events have one each.
ENTITIES = {n: size for size, numbers in (
    (1, (1, 4, 11, 12, 17, 20, 24, 26, 29, 30, 31, 32, 33, 34, 39, 53, 58, 66, 78)), (2, (0, 27, 47, 48, 56, 64)), (3, (18, 23, 28, 44, 46, 52, 67)), (4, (22, 55, 65)),
) for n in numbers}


def _reparsed(log: DataFrame) -> DataFrame:
    lines = shapes.lines(log).join(log.select("event_id", "id"), "event_id")
    stored = lines.select("id", F.concat(F.lit("dir/file-"), (F.col("event_id") % 4).cast("string"), F.lit(".log")).alias("source_file"), F.col("raw").alias("raw_message"), F.array(F.struct(F.lit("ip").alias("type"), F.lit("1.2.3.4").alias("value"))).alias("entities"))
    again = quality.reparse(stored, "2024-06-01")
    path = new_path(log.sparkSession, "reparsed")
    quality.write_reparsed(again, path)
    # the entities found are those written, so no line is parsed twice
    read = log.sparkSession.read.schema("part string, matched_format string, source_file string, old_entities int, new_entities int").json(path)
    report = quality.reparse_report(read)
    formats = read.groupBy("part").agg(F.count("*").alias("records"), F.countDistinct("matched_format").alias("formats"))
    return formats.join(F.broadcast(report.select(F.col("records").alias("all_records"), "files", "old_entities", "new_entities", "gained", "lost")))


# --- files: lines and rows written and read again
def _files(log: DataFrame):
    spark, path = log.sparkSession, new_path(log.sparkSession, "tree")
    return spark, path, log.withColumn("folder", F.concat(F.lit("h"), F.col("event_id") % 3))


def _scanned(log: DataFrame) -> DataFrame:
    spark, path, rows = _files(log)
    rows.select("folder", "raw_message").write.partitionBy("folder").text(path)
    found = readers.scan(spark, path)
    return found.groupBy(F.regexp_extract("source_folder", "h\\d", 0).alias("folder")).agg(F.count("*").alias("lines"), F.countDistinct("line").alias("different"))


def _csv_read(log: DataFrame) -> DataFrame:
    spark, path, rows = _files(log)
    rows.select("id", "hostname", F.concat(F.lit('a "quoted", text '), "k").alias("note")).write.option("header", True).option("escape", '"').csv(path)
    paths = [r.path for r in spark.read.format("binaryFile").load(f"{path}/*.csv").select("path").collect()]  # files of one write
    found = readers.read_csv(spark, paths, path)
    return found.select(*(F.get_json_object("raw", f"$.{c}").alias(c) for c in ("id", "hostname", "note")))


def _json_read(log: DataFrame) -> DataFrame:
    spark, path, rows = _files(log)
    rows.select("id", "hostname", "k").write.json(path)
    found = readers.read_lines(spark, f"{path}/*.json", path)
    return found.select(F.get_json_object("raw", "$.id").alias("id"), F.get_json_object("raw", "$.hostname").alias("hostname"), F.get_json_object("raw", "$.k").cast("int").alias("k"))


def _xml_read(log: DataFrame) -> DataFrame:
    spark, path, rows = _files(log)
    event = F.concat(F.lit("<Event><System><Provider Name='p'/><EventID>"), "k", F.lit("</EventID><Computer>"), "hostname", F.lit("</Computer></System><EventData><Data Name='User'>"), "user_name", F.lit("</Data><Data Name='Id'>"), "id", F.lit("</Data></EventData></Event>"))
    # documents of 500 events, a file each
    one = rows.groupBy(F.floor(F.col("event_id") / 500)).agg(F.concat(F.lit("<Events>"), F.array_join(F.collect_list(event), ""), F.lit("</Events>")).alias("value"))
    one.select("value").write.option("maxRecordsPerFile", 1).text(path)
    found = readers.read_xml(spark, f"{path}/*.txt", path)
    return found.select(F.get_json_object("raw", "$.Id").alias("id"), F.get_json_object("raw", "$.User").alias("user_name"), F.get_json_object("raw", "$.EventID").cast("int").alias("k"), F.get_json_object("raw", "$.Computer").alias("hostname"))


def _parsed_read(log: DataFrame) -> DataFrame:
    spark, path, rows = _files(log)
    out = rows.select("id", "hostname", "severity_score")
    whole = F.to_json(F.struct(*out.columns))
    out.select(F.when(F.col("severity_score") == 2, F.lit("{not json")).otherwise(whole)).write.option("compression", "gzip").text(path)
    return readers.read_parsed(spark, path, out.schema)


# --- exports: files of lines and of arrays, and the first events through a transport
def _exported(log: DataFrame) -> DataFrame:
    spark, path = log.sparkSession, new_path(log.sparkSession, "export")
    exports.export(log, "ndjson", f"{path}/lines", raw=False, per_file=300)
    exports.export(log, "ecs", f"{path}/arrays", raw=False, per_file=300, compression="none", array=True)
    exports.export(log, "csv", f"{path}/csv", raw=False, compression="none")
    files = spark.read.text(f"{path}/arrays/*.txt", wholetext=True)
    arrays = files.select(F.explode(F.from_json("value", "array<string>")).alias("v"))
    parts = {
        "lines": spark.read.json(f"{path}/lines").select("id"), "arrays": arrays.select(F.get_json_object("v", "$.event.id").alias("id")),
        "csv": spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{path}/csv").select("id"),
    }
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.lit(name).alias("kind"), F.count("*").alias("n"), F.countDistinct("id").alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


def _never(lines: list[str]) -> None:
    """A transport that takes all but batches that hold a purchase."""
    if any("purchase" in x for x in lines):
        raise OSError


# --- entities of accounts, texts and host names
def _account(log: DataFrame) -> DataFrame:
    number = F.col("k").cast("string")
    user = F.when(F.col("k") % 3 == 0, F.concat(F.lit("corp\\user-"), number)).when(F.col("k") % 3 == 1, F.concat(F.lit("user-"), number, F.lit("@corp.example"))).otherwise(F.concat(F.lit("auth:CORP\\user-"), number))
    return log.select("id", F.lit("plain").alias("hostname"), F.lit("no entity").alias("message"), F.create_map(F.lit("Acct"), user, F.lit("none"), F.lit("x"), F.lit("opID"), F.lit("unset")).alias("attributes"))


def _worded(log: DataFrame) -> DataFrame:
    k = F.col("k").cast("string")
    text = F.concat(F.lit("disk naa.6001438"), k, F.lit(" via vmnic3 for S-1-5-21-"), k, F.lit(" in GC("), k, F.lit(") at https://h.example/"), k, F.lit(" and vm-"), k, F.lit(" of 127.0.0.1"))
    return log.select("id", F.lit("web").alias("process"), F.concat(F.lit("web-"), k, F.lit("-6f577dd6c-ttv86")).alias("hostname"), text.alias("message"), F.create_map().cast("map<string,string>").alias("attributes"))


def _rows(m: DataFrame) -> DataFrame:
    return m.select("log_id", "type", "value")


# --- retrieval: the first search that finds anything, and vectors for rows that have none
def _cascade(log: DataFrame) -> DataFrame:
    name, found = retrieval.retrieve([("exact", log.where("message = 'nothing says this'")), ("words", retrieval.substring_search(log, "error", 30)), ("all", log)])
    return found.select("id", F.lit(name).alias("by"))


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), 1.0] for t in texts]


def _vectors(log: DataFrame) -> DataFrame:
    some = log.select("id", "message", F.when(F.col("k") % 2 == 0, F.array(F.lit(1.0).cast("float"))).alias("embedding"))
    return retrieval.embed_missing(some, _lengths, dimension=3).select("id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


# --- parsing of pairs
def _pairs(log: DataFrame) -> DataFrame:
    k = F.col("k").cast("string")
    text = F.concat(F.lit("a="), k, F.lit(" b='x y' c=\"z="), k, F.lit("\" (d=(v)); e=done. a=2 f.g-h="), k, F.lit(","))
    bag = normalize.kv_bag(text)
    return log.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(bag)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "|").alias("pairs"))


def register(query) -> None:
    probes.register(query)
    accounts = "CASE k % 3 WHEN 0 THEN 'corp' WHEN 1 THEN 'corp.example' ELSE 'CORP' END"
    query("g2_accounts", lambda log: _rows(entities.mentions(_account(log))), f"SELECT id AS log_id, 'user' AS type, 'user-' || k AS value FROM log UNION ALL SELECT id, 'domain', {accounts} FROM log UNION ALL SELECT id, 'user', 'auth' FROM log WHERE k % 3 = 2", heavy=True)
    found = {"device": "'naa.6001438' || k", "network_interface": "'vmnic3'", "security_id": "'S-1-5-21-' || k", "gc_cycle": "k::VARCHAR", "url": "'https://h.example/' || k", "vm": "'vm-' || k", "pod": "'web-' || k || '-6f577dd6c-ttv86'", "k8s_service": "'web'"}
    query("g3_worded", lambda log: _rows(entities.mentions(_worded(log))), " UNION ALL ".join(f"SELECT id AS log_id, '{t}' AS type, {v} AS value FROM log" for t, v in found.items()), heavy=True)
    query("r4_cascade", _cascade, "SELECT id, 'words' AS by FROM log WHERE contains(message, 'error') ORDER BY severity_score, timestamp, id LIMIT 30")
    query("r7_vectors", _vectors, "SELECT id, length(message) || ',1,0' AS vector FROM log WHERE k % 2 = 1")
    query("p6_pairs", _pairs, "SELECT event_id, 'a:2|b:x y|c:z=' || k || '|d:(v))|e:done|f.g-h:' || k AS pairs FROM log")
    query("i2_blocks", lambda log: ledger.seal(log, SEALED_AT)[0].select("height", "event_count", "merkle_root", "hash", "prev_hash"), f"{_CHAIN} SELECT height, event_count, merkle_root, hash, prev_hash FROM ch", recursive=True)
    query("i4_verify", lambda log: ledger.verify(*_tampered(log)), "SELECT height::BIGINT AS height, kind FROM (VALUES (1, 'header_altered'), (3, 'merkle_mismatch')) t(height, kind) WHERE (SELECT count(*) FROM log) > 1505")
    query("i6_proofs", _proofs, f", {_LEAVES} SELECT height, count(*) AS events, true AS valid, ceil(log2(count(*)))::INTEGER AS longest FROM lv GROUP BY 1")
    query("i7_status", lambda log: ledger.status(ledger.seal(log, SEALED_AT)[0]), f"{_CHAIN} SELECT count(*) AS blocks, sum(event_count)::BIGINT AS events, arg_max(hash, height) AS head FROM ch", recursive=True)
    query("n_insights", lambda log, m: insights.build(log, m), _INSIGHTS, SQL_MENTIONS, needs="lm", types=rollup.HOT_TYPES)
    query("n_insights_of_bad_week", lambda log, m: insights.build(_loud(log), m), _INSIGHTS, SQL_MENTIONS.replace("\nlog AS (", "\nlog0 AS (", 1).replace("FROM ev2)", f"FROM ev2),\nlog AS ({_LOUD.replace('FROM log', 'FROM log0')})", 1), needs="lm", types=rollup.HOT_TYPES)
    query("m2_shapes", lambda log: mining.shapes(_mined(log)), f"SELECT CASE WHEN event_id % 3 <> 0 THEN '{_shape(TOKENS_A)}' ELSE '{_shape(TOKENS_B)}' END AS shape, count(*) AS lines, min(CASE WHEN event_id % 3 <> 0 THEN {LINE_A} ELSE {LINE_B} END) AS example FROM log GROUP BY 1", heavy=True)
    query("m3_slots", lambda log: mining.slots(_mined(log)), _slots_sql(), heavy=True)
    query("m5_drafts", lambda log: mining.drafts(_mined(log)).select("lines", "fields", "slots", "resolved", "core", "confidence", "warnings", "over_fit", "coverage"), """SELECT lines, fields, slots::BIGINT AS slots, resolved::BIGINT AS resolved, core::BIGINT AS core, round(0.4 * resolved / slots + 0.6 * core / 5, 2)::DOUBLE AS confidence, '' AS warnings, lines < 4 AS over_fit, round(100.0 * lines / sum(lines) OVER (), 1)::DOUBLE AS coverage
FROM (SELECT count(*) AS lines, 'timestamp,hostname,process,user,?' AS fields, 5 AS slots, 4 AS resolved, 3 AS core FROM log WHERE event_id % 3 <> 0 UNION ALL SELECT count(*), '?,?,code', 3, 0, 0 FROM log WHERE event_id % 3 = 0)""", heavy=True)
    query("d6_entity_report", lambda log, m: entities.report(m, log).where("not unseen").select("type", "label", "total", "distinct_values", "top"), """SELECT type, CASE type WHEN 'user' THEN 'User' WHEN 'trace' THEN 'Trace' WHEN 'file' THEN 'File' WHEN 'operation' THEN 'Operation' ELSE 'IPAddress' END AS label, sum(n)::BIGINT AS total, count(*) AS distinct_values, string_agg(value, ', ' ORDER BY r) FILTER (r <= 5) AS top
FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, value) AS r FROM (SELECT type, value, count(*) AS n FROM mentions GROUP BY 1, 2)) GROUP BY 1""", SQL_MENTIONS, needs="lm")
    query("d6_unseen_types", lambda log, m: entities.report(m, log).groupBy("unseen").agg(F.count("*").alias("types")), f"SELECT unseen, types FROM (SELECT false AS unseen, count(DISTINCT type) AS types FROM mentions UNION ALL SELECT true, {len(entities.SPECS)} - count(DISTINCT type) FROM mentions)", SQL_MENTIONS, needs="lm")
    query("d7_timestamp_source", lambda log: quality.backfill_timestamp_source(_sourceless(log), "2024-06-01"), "SELECT id, CASE WHEN k % 4 = 0 THEN 'no time at all ' || k ELSE raw_message END AS raw_message, CASE WHEN k % 5 = 0 THEN 'file' WHEN k % 4 = 0 THEN 'ingest' ELSE 'event' END AS timestamp_source FROM log", heavy=True)
    formats = ", ".join(f"({k}, '{s[1]}', {ENTITIES.get(k, 0)})" for k, s in enumerate(shapes.SHAPES))
    query("d10_reparsed", _reparsed, f""", lines AS (SELECT event_id, f.format, f.entities FROM log JOIN (VALUES {formats}) f(n, format, entities) ON event_id % {len(shapes.SHAPES)} = f.n),
c AS (SELECT count(*) AS n, sum(entities)::BIGINT AS entities, count(*) FILTER (entities > 1) AS gained, count(*) FILTER (entities < 1) AS lost FROM lines)
SELECT 'dir_file-' || event_id % 4 AS part, count(*) AS records, count(DISTINCT format) AS formats, any_value(c.n) AS all_records, 4::BIGINT AS files, any_value(c.n) AS old_entities, any_value(c.entities) AS new_entities, any_value(c.gained) AS gained, any_value(c.lost) AS lost
FROM lines, c GROUP BY 1""", heavy=True)
    query("s1_scanned", _scanned, "SELECT 'h' || event_id % 3 AS folder, count(*) AS lines, count(DISTINCT raw_message) AS different FROM log GROUP BY 1")
    query("s5_csv_files", _csv_read, "SELECT id, hostname, 'a \"quoted\", text ' || k AS note FROM log")
    query("s6_xml_files", _xml_read, "SELECT id, user_name, k, hostname FROM log")
    query("s7_json_lines", _json_read, "SELECT id, hostname, k FROM log")
    query("s9_parsed_events", _parsed_read, "SELECT id, hostname, severity_score FROM log WHERE severity_score <> 2")
    query("x7_export_files", _exported, "SELECT kind, n, ids FROM (SELECT count(*) AS n, count(DISTINCT id) AS ids FROM log), (VALUES ('lines'), ('arrays'), ('csv')) t(kind)")
    query("x11_push_first", lambda log: exports.push_first(log, _never, 40, "cef", batch=1, retries=2, backoff=0), "SELECT (count(*) FILTER (NOT contains(message, 'purchase')))::BIGINT AS sent, (count(*) FILTER (contains(message, 'purchase')))::BIGINT AS dead FROM (SELECT * FROM log ORDER BY timestamp DESC, id DESC LIMIT 40)")
    query("p17_capped", lambda log: normalize.capped(normalize.parse(log.select("event_id", F.repeat("raw_message", 3).alias("raw")), "2024-06-01"), 120).select("event_id", "raw_message", "raw_hash", "raw_truncated", "raw_length"),
          "SELECT event_id, substr(r, 1, 120) AS raw_message, sha256(r) AS raw_hash, CASE WHEN length(r) > 120 THEN true END AS raw_truncated, (CASE WHEN length(r) > 120 THEN length(r) END)::INTEGER AS raw_length FROM (SELECT event_id, repeat(raw_message, 3) AS r FROM log)")

