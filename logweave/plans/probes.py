"""Queries on crafted lines and attributes of events, with their SQL: entities of keys and texts, lines of no known format,
message, confidence and attributes of parsed lines, formats of files, lines that no draft fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import normalize
from logweave.operators import batches, entities, exports, mining
from logweave.sources import readers, records
from logweave.storage import new_path

AS_OF = "2024-06-01"


def filled(template: str, **columns: str) -> Column:
    """A text with ``{name}`` replaced by columns."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.col(columns.get(name, name)).cast("string")]
    return F.concat(*parts, F.lit(rest))


def in_sql(template: str) -> str:
    """The same as an expression in SQL."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += ["'" + before.replace("'", "''") + "'", f"{name}::VARCHAR"]
    return " || ".join([*out, "'" + rest.replace("'", "''") + "'"])


# --- entities: attributes by their keys, and texts
KEYS = (
    ("client", "10.1.2.3:{k}", (("ip", "10.1.2.3"), ("port", "{k}"))), ("src", "pc-{k}.example.org", ()), ("dst", "127.0.0.1:80", (("port", "80"),)), ("Logon ID", "0x{k}", (("session", "0x{k}"),)),
    ("Subject.Account Name", "CORP\\user-{k}", (("domain", "CORP"), ("user", "user-{k}"))), ("Object.Object Name", "C:\\data\\{k}", (("file", "C:\\data\\{k}"),)),
    ("source-port", "{k}1", (("port", "{k}1"),)), ("Process Information.Process ID", "0x1", ()), ("operation", "open", ()), ("profile", "unconfined_u", ()), ("request.user", "eve", ()),
    ("Security_ID", "S-1-{k}", (("security_id", "S-1-{k}"),)),
)
TEXT = "from host-{k} mac 00-1A-2B-3C-4D-{k}E, see https://x.example/{k}., read /var/log/a{k}.log. and redis-1.redis-{k}.ns1.svc.cluster.local at 10.9.8.7:{k}; {k}"
FOUND = (
    ("managed_object", "host-{k}"), ("url", "https://x.example/{k}"), ("file", "/var/log/a{k}.log"), ("dns_name", "redis-1.redis-{k}.ns1.svc.cluster.local"), ("namespace", "ns1"),
    ("k8s_service", "redis-{k}"), ("ip", "10.9.8.7"),
)


def _keyed(log: DataFrame) -> DataFrame:
    attributes = F.create_map(*(x for key, value, _ in KEYS for x in (F.lit(key), filled(value))))
    own = log.select("id", F.lit("plain").alias("hostname"), F.lit("nothing").alias("message"), attributes.alias("attributes"))
    return entities.mentions(own).select("log_id", "type", "value")


def _told(log: DataFrame) -> DataFrame:
    own = log.select("id", F.lit("plain").alias("hostname"), filled(TEXT).alias("message"), F.create_map().cast("map<string,string>").alias("attributes"))
    return entities.mentions(own).select("log_id", "type", "value")


def _pairs_sql(pairs) -> str:
    return " UNION ".join(f"SELECT id AS log_id, '{kind}' AS type, {in_sql(value)} AS value FROM log" for kind, value in pairs)


# --- lines of no known format: (line, host, process, pid, time)
LOST = (
    ("2024/01/02 10:00:00 fw01-{k} paloalto: threat {k} seen", "fw01-{k}", "paloalto", None, "2024-01-02T10:00:00"), ("01/02/2024 10:00:00 gw-{k} vendor[{k}]: up", "gw-{k}", "vendor", "{k}", "2024-02-01T10:00:00"),
    ("Tue Jan  2 10:00:00 2023 ap-{k} radio: joined", "ap-{k}", "radio", None, "2023-01-02T10:00:00"), ("rotated archive app{k}.log.2024.gz", None, None, None, None), ("exception in com.acme{k}.web.Filter", None, None, None, None),
    ("seen at edge{k}.corp.example by nobody", "edge{k}.corp.example", None, None, None), ("peer{k}.corp.example told srv{k}.site.local of it", "srv{k}.site.local", None, None, None), ("HostName=box-{k} did proc=worker{k} a thing", "box-{k}", "worker{k}", None, None),
    ("the value of 10.0.0.{k} is E.mu", None, None, None, None),
)


def _lost(log: DataFrame) -> DataFrame:
    line = F.lit(None).cast("string")
    for n, x in enumerate(LOST):
        line = F.when(F.col("event_id") % len(LOST) == n, filled(x[0])).otherwise(line)
    parsed = normalize.parse(log.select("event_id", line.alias("raw")), AS_OF)
    time = F.when(F.col("timestamp_source") == "event", F.substring("timestamp", 1, 19))
    return parsed.select("event_id", "matched_format", "hostname", "process", "pid", time.alias("at"))


def _lost_sql() -> str:
    of = lambda at: "CASE event_id % {} {} END".format(len(LOST), " ".join(f"WHEN {n} THEN {in_sql(x[at])}" for n, x in enumerate(LOST) if x[at] is not None))
    return f"SELECT event_id, 'generic_fallback' AS matched_format, coalesce({of(1)}, 'unknown-host') AS hostname, coalesce({of(2)}, 'unknown-process') AS process, ({of(3)})::INTEGER AS pid, {of(4)} AS at FROM log"


# --- what a parsed line says: JSON without a message, Windows blocks, octal escapes, nested values
BARE = '{"level": "warn", "code": {k}, "user": "user-{k}", "nested": {"deep": "{k}", "list": [1, 2]}, "host": "h-{k}"}'


def _composed(log: DataFrame) -> DataFrame:
    line = F.concat(F.lit('{"level": "warn", "code": '), "k", F.lit(', "user": "'), "user_name", F.lit('", "host": "h-'), "k", F.lit('"}'))
    parsed = normalize.parse(log.select("event_id", line.alias("raw")), AS_OF)
    return parsed.select("event_id", "hostname", "severity", "message", "normalized_message", "confidence")


def _cleaned(log: DataFrame) -> DataFrame:
    text = F.concat(F.lit("\ufeff a#011b"), F.col("k").cast("string"), F.lit("#012\x00 "))
    return log.select("event_id", normalize.clean(text).alias("text"))


def _blocks(log: DataFrame) -> DataFrame:
    text = F.concat(F.lit("A logon failed.\n\nSubject:\n\tSecurity ID:\t\tS-1-"), "k", F.lit("\n\tAccount Name:\t\t"), "user_name", F.lit("\n\nNetwork Information:\n\tSource Port:\t\t"), "k", F.lit("\n"))
    bag = F.map_entries(normalize.sections(text))
    return log.select("event_id", F.explode(bag).alias("e")).select("event_id", "e.key", "e.value")


def _flattened(log: DataFrame) -> DataFrame:
    text = F.concat(F.lit('{"a": '), "k", F.lit(', "b": {"c": "x'), "k", F.lit('", "d": {"e": [1, 2], "f": {"g": 1}}}, "l": [{"m": 1}], "n": null}'))
    return log.select("event_id", F.explode(F.map_entries(normalize.flattened(text))).alias("e")).select("event_id", "e.key", "e.value")


# --- files of several formats by their contents
def _tree(log: DataFrame) -> tuple:
    spark, path = log.sparkSession, new_path(log.sparkSession, "tree")
    log.select(F.to_json(F.struct("id", "hostname")).alias("value")).repartition(2).write.text(f"{path}/a")
    log.select("id", "hostname", "process").coalesce(1).write.option("header", True).csv(f"{path}/b")
    log.select(F.concat("timestamp", F.lit(" "), "hostname", F.lit(" said"), F.lit("\n  and more")).alias("value")).coalesce(1).write.text(f"{path}/c")
    return spark, path


def _formats(log: DataFrame) -> DataFrame:
    spark, path = _tree(log)
    found = readers.file_formats(spark, path).where(F.col("path").rlike(r"part-[^/]*$"))
    return found.groupBy(F.regexp_extract("path", r"/([abc])/part", 1).alias("folder"), "format").agg(F.count("*").alias("files"))


def _any(log: DataFrame) -> DataFrame:
    spark, path = _tree(log)
    found = readers.read_any(spark, path).where("source_file like '%part-%'")
    return found.groupBy(F.substring("source_file", 1, 1).alias("folder")).agg(F.count("*").alias("records"), F.countDistinct("raw").alias("different"))


# --- records of several lines by ranges of bytes, and files rotated by bytes
def _records(log: DataFrame) -> DataFrame:
    spark, path = log.sparkSession, new_path(log.sparkSession, "lines")
    text = F.concat("timestamp", F.lit(" "), "hostname", F.lit(" said"), F.lit("\n  and more "), F.col("k").cast("string"), F.lit("\n\n  at last"))
    log.select("event_id", text.alias("value")).repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").coalesce(1).write.text(path)
    return records.read_records(spark, path, "*.txt", range_bytes=10_000, longest=500).select("source_record", "raw")


def _rotated(log: DataFrame) -> DataFrame:
    spark, path = log.sparkSession, new_path(log.sparkSession, "rotated")
    exports.forward(log, "ndjson", path, raw=False, largest=20_000)
    files = spark.read.format("binaryFile").load(f"{path}/*.jsonl").select(F.max("length").alias("largest"), F.count("*").alias("files"))
    rows = spark.read.json(f"{path}/*.jsonl").agg(F.count("*").alias("lines"), F.countDistinct("id").alias("ids"))
    return rows.join(files).select("lines", "ids", (F.col("largest") <= 20_000).alias("bounded"), (F.col("files") > 1).alias("rotated"))


def _dead(log: DataFrame) -> DataFrame:
    spark, path = log.sparkSession, new_path(log.sparkSession, "dead")

    def post(lines: list[str]) -> None:
        if any("purchase" in x for x in lines):
            raise OSError("refused")

    exports.send(log.select(F.col("message").alias("value")), post, batch=1, retries=2, backoff=0, dead_letters=path)
    return spark.read.parquet(path).select("value", "error")


# --- events sealed in two batches
def _sealed(log: DataFrame) -> DataFrame:
    out = batches.Ledger(log.sparkSession, new_path(log.sparkSession, "ledger"))
    for n, part in enumerate(("day < '2024-01-15'", "day >= '2024-01-15'")):
        if not log.where(part).isEmpty():
            out.seal(log.where(part), f"2024-02-0{n + 1}T00:00:00Z")
    proofs = batches.check(out.proofs(log.select(F.col("id").alias("event_id"))))
    each = proofs.groupBy("batch").agg(F.count("*").alias("events"), F.every("valid").alias("valid"))
    wrong = out.verify().groupBy("batch").agg(F.count("*").alias("wrong"))
    return each.join(wrong, "batch", "left").select("batch", "events", "valid", F.coalesce("wrong", F.lit(0)).alias("wrong"))


def _unmatched(log: DataFrame) -> DataFrame:
    lost = F.when(F.col("k") % 7 == 0, normalize.FALLBACK).otherwise(F.col("matched_format"))
    return mining.unmatched(log.withColumn("matched_format", lost))


def register(query) -> None:
    every = [(kind, value) for _, _, found in KEYS for kind, value in found]
    query("g1_keys", _keyed, _pairs_sql(every), heavy=True)
    mac = "SELECT id, 'mac_address', '00:1a:2b:3c:4d:' || k || 'e' FROM log WHERE k < 10"
    query("g3_forms", _told, f"{_pairs_sql(FOUND)} UNION {mac}", heavy=True)
    query("p3_lost", _lost, _lost_sql(), heavy=True)
    query("p14_cleaned", _cleaned, "SELECT event_id, 'a' || chr(9) || 'b' || k AS text FROM log")
    query("p22_flattened", _flattened, "SELECT event_id, 'a' AS key, k::VARCHAR AS value FROM log UNION ALL SELECT event_id, 'b.c', 'x' || k FROM log UNION ALL SELECT event_id, 'b.d.e', '1, 2' FROM log")
    query("p23_blocks", _blocks, """SELECT event_id, 'Subject.Security ID' AS key, 'S-1-' || k AS value FROM log UNION ALL SELECT event_id, 'Subject.Account Name', user_name FROM log
UNION ALL SELECT event_id, 'Network Information.Source Port', k::VARCHAR FROM log""")
    query("s3_records", _records, "SELECT row_number() OVER (ORDER BY event_id) AS source_record, timestamp || ' ' || hostname || ' said' || chr(10) || '  and more ' || k || chr(10) || '  at last' AS raw FROM log")
    query("x9_rotated", _rotated, "SELECT count(*) AS lines, count(DISTINCT id) AS ids, true AS bounded, true AS rotated FROM log")
    query("x10_dead_letters", _dead, "SELECT message AS value, 'OSError: refused' AS error FROM log WHERE contains(message, 'purchase')")
    query("i3_batches", _sealed, "SELECT (day >= '2024-01-15')::BIGINT AS batch, count(*) AS events, true AS valid, 0::BIGINT AS wrong FROM log GROUP BY 1")
    query("m6_unmatched", _unmatched, "SELECT raw_message AS raw FROM log WHERE k % 7 = 0")
    query("s4_formats", _formats, "SELECT * FROM (VALUES ('a', 'jsonl', 2), ('b', 'csv', 1), ('c', 'text', 1)) t(folder, format, files) WHERE (SELECT count(*) FROM log) > 0")
    query("s8_any_files", _any, "SELECT folder, count(*) AS records, count(DISTINCT raw) AS different FROM (SELECT 'a' AS folder, id AS raw FROM log UNION ALL SELECT 'b', id FROM log UNION ALL SELECT 'c', timestamp || hostname FROM log) GROUP BY 1")
    query("p5_composed", _composed, """SELECT event_id, 'h-' || k AS hostname, 'WARNING' AS severity, m AS message, '[Unknown] h-' || k || '/unknown-process: ' || m AS normalized_message, 0.35::DOUBLE AS confidence
FROM (SELECT *, 'level=warn code=' || k || ' user=' || user_name || ' host=h-' || k AS m FROM log)""", heavy=True)
