"""Events in the shapes that other systems read, and sinks for them. Every shape is a string column."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.sources.writers import LARGEST, write_rotating
from logweave.storage import stored
from logweave.schema import FIELDS

from .filters import ALL, LogFilter

VENDOR, PRODUCT = "logweave", "Event export"
#: Severity numbers of the other schemas.
OCSF_SEVERITY = {"DEBUG": 1, "INFO": 1, "NOTICE": 2, "WARNING": 3, "WARN": 3, "ERROR": 4, "CRITICAL": 5, "ALERT": 5, "FATAL": 6, "EMERGENCY": 6}
CEF_SEVERITY = {1: 10, 2: 9, 3: 7, 4: 5, 5: 4, 6: 3, 7: 1}
SYSLOG_SEVERITY = {"EMERGENCY": 0, "FATAL": 0, "ALERT": 1, "CRITICAL": 2, "ERROR": 3, "WARNING": 4, "NOTICE": 5, "INFO": 6, "DEBUG": 7}
FACILITY = 16
#: OCSF classes.
CLASSES = {3002: ("Authentication", 3, "Identity & Access Management"), 4001: ("Network Activity", 4, "Network Activity"), 1008: ("Event Log Activity", 1, "System Activity")}
#: Attribute names of an OCSF field, in order.
SRC_IP = ("src_ip", "src", "srcip", "sourceIPAddress", "ip_client", "ipAddress", "client.ipAddress", "sourceIPs", "forwarded_for")
DST_IP = ("dst_ip", "dst", "dstip", "destinationIP", "upstream_host")
SRC_PORT, DST_PORT = ("src_port", "spt", "srcPort", "srcport", "sport"), ("dst_port", "dpt", "dstPort", "dstport", "dport")
USER = ("user", "usr", "username", "userName", "db_user", "suser", "actor.alternateId", "TargetUserName", "SubjectUserName", "principalEmail", "caller", "duser")
PROTOCOL = ("proto", "protocol", "transport")
#: Words of a verdict.
AUTH = r"(?i)\b(auth|login|logon|sign[- ]?in|sshd|sudo|credential|password|mfa|session\.start|user\.session|account\.lock|kerberos|saml|oauth)\b"
FAILED = r"(?i)\b(failed|failure|invalid|denied|deny|lockout|locked_out|locked out|bad[_ ]credentials|authentication failure|unauthorized|incorrect)\b"
WORKED = r"(?i)\b(success|succeeded|accepted|logged in|login|logon|session opened|authenticated|sign[- ]in)\b"
LOGOFF = r"(?i)\b(logout|logoff|log off|session closed|sign[- ]out)\b"
DENIED, ALLOWED = r"(?i)\b(deny|denied|drop|dropped|block|blocked|reject|refused)\b", r"(?i)\b(allow|allowed|accept|accepted|permit|built|established)\b"


def lookup(table: dict, key: Column, default) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def first_of(attributes: Column, keys: tuple[str, ...]) -> Column:
    values = (F.try_element_at(attributes, F.lit(k)) for k in keys)
    return F.coalesce(*(F.when(~v.isin("", "-"), v) for v in values))


def column(log: DataFrame, name: str) -> Column:
    """A field of the schema, null of its type where the table lacks it."""
    types = {f.name: f.type for f in FIELDS}
    return F.col(name) if name in log.columns else F.lit(None).cast(types[name])


def ndjson(log: DataFrame, raw: bool = True) -> DataFrame:
    """Every field there is but the vector, attributes as an object."""
    names = [f.name for f in FIELDS if f.name in log.columns and f.name != "embedding" and (raw or f.name != "raw_message")]
    return log.select("id", F.to_json(F.struct(*names)).alias("value"))


def ecs(log: DataFrame, raw: bool = True) -> DataFrame:
    """Fields nested by their dotted names; null and empty ones, and derived ones, are left out."""
    tree: dict = {}
    for f in FIELDS:
        if f.ecs and f.name in log.columns and not f.ecs.startswith("labels.") and (raw or f.name != "raw_message"):
            *path, leaf = f.ecs.split(".") if not f.ecs.startswith("@") else [f.ecs]
            reduce(lambda t, p: t.setdefault(p, {}), path, tree)[leaf] = F.col(f.name) if f.type != "string" else F.when(F.col(f.name) != "", F.col(f.name))

    def nest(t: dict) -> list[Column]:
        return [(F.struct(*nest(v)) if isinstance(v, dict) else v).alias(k) for k, v in t.items()]

    labels = [F.col("attributes").alias("labels")] if "attributes" in log.columns else []
    return log.select("id", F.to_json(F.struct(*nest(tree), *labels, F.struct(F.lit("8.11.0").alias("version")).alias("ecs"))).alias("value"))


def _words(log: DataFrame, names: tuple[str, ...], keys: tuple[str, ...]) -> Column:
    a = column(log, "attributes")
    return F.concat_ws(" ", *(F.coalesce(column(log, n), F.lit("")) for n in names), *(F.coalesce(F.try_element_at(a, F.lit(k)), F.lit("")) for k in keys))


def ocsf_class(log: DataFrame) -> Column:
    """3002 with a sign of authentication and a user or a verdict, 4001 with both addresses, else 1008."""
    a = column(log, "attributes")
    words = _words(log, ("message", "component", "process", "source_type"), ("eventType", "action", "act", "deviceAction", "verdict", "outcome.result"))
    auth = words.rlike(AUTH) & (first_of(a, USER).isNotNull() | words.rlike(FAILED) | words.rlike(WORKED))
    return F.when(auth, 3002).when(first_of(a, SRC_IP).isNotNull() & first_of(a, DST_IP).isNotNull(), 4001).otherwise(1008)


def with_ocsf(log: DataFrame) -> DataFrame:
    """Class, activity, type and status of each event."""
    words = _words(log, ("message", "component"), ("eventType", "action", "verdict", "outcome.result", "outcome.reason", "act", "deviceAction"))
    out = log.withColumn("class_uid", ocsf_class(log)).withColumn("_w", words)
    w, c = F.col("_w"), F.col("class_uid")
    activity = F.when(c == 3002, F.when(w.rlike(LOGOFF), 2).when(w.rlike(AUTH), 1).otherwise(0)).when(c == 4001, F.when(w.rlike(DENIED), 6).when(w.rlike(ALLOWED), 1).otherwise(0)).otherwise(0)
    status = F.when(c == 3002, F.when(w.rlike(FAILED), 2).when(w.rlike(WORKED), 1).otherwise(0)).when(c == 4001, F.when(w.rlike(DENIED), 2).when(w.rlike(ALLOWED), 1).otherwise(0))
    out = out.withColumn("activity_id", activity).withColumn("type_uid", c * 100 + F.col("activity_id")).withColumn("status_id", status)
    return out.withColumn("severity_id", lookup(OCSF_SEVERITY, F.upper("severity"), 0)).drop("_w")


def ocsf(log: DataFrame, raw: bool = True) -> DataFrame:
    """Whole documents; what the class has no place for goes to ``unmapped``."""
    d, a = with_ocsf(log), column(log, "attributes")
    named = lambda k: lookup({u: v[k] for u, v in CLASSES.items()}, F.col("class_uid"), None)
    point = lambda ip, port: F.when(first_of(a, ip).isNotNull(), F.struct(first_of(a, ip).alias("ip"), first_of(a, port).try_cast("int").alias("port")))
    millis = lambda c: F.unix_millis(F.try_to_timestamp(c))
    meta = F.struct(F.lit("1.3.0").alias("version"), F.struct(F.coalesce("source_type", F.lit("Unknown")).alias("name"), F.coalesce(first_of(a, ("cef_vendor", "leef_vendor")), F.col("source_type"), F.lit("Unknown")).alias("vendor_name")).alias("product"), column(log, "matched_format").alias("log_name"), F.col("process").alias("log_provider"), F.col("id").alias("uid"))
    doc = [
        F.col("class_uid"), named(0).alias("class_name"), named(1).alias("category_uid"), named(2).alias("category_name"), F.col("activity_id"), F.col("type_uid"), F.col("severity_id"), F.col("severity"),
        millis(F.col("timestamp")).alias("time"), F.col("message"), meta.alias("metadata"), F.when(F.col("hostname") != "unknown-host", F.struct("hostname")).alias("device"), F.col("status_id"),
        F.when(F.col("class_uid") == 3002, F.struct(first_of(a, USER).alias("name"))).alias("user"), F.when(F.col("class_uid") != 1008, point(SRC_IP, SRC_PORT)).alias("src_endpoint"),
        F.when(F.col("class_uid") == 4001, point(DST_IP, DST_PORT)).alias("dst_endpoint"), F.when(F.col("class_uid") == 4001, F.struct(F.lower(first_of(a, PROTOCOL)).alias("protocol_name"))).alias("connection_info"), a.alias("unmapped"),
    ]
    if raw and "raw_message" in log.columns:
        doc.append(F.col("raw_message").alias("raw_data"))
    return d.select("id", F.to_json(F.struct(*doc)).alias("value"))


def ocsf_coverage(log: DataFrame) -> DataFrame:
    """Events of each class and their share."""
    out = log.groupBy(ocsf_class(log).alias("class_uid")).agg(F.count("*").alias("count"))
    return out.withColumn("pct", F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()), 4))


def cef_escape(value: Column, header: bool) -> Column:
    s = F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    s = F.translate(s, "\n\r", "  ")
    return F.replace(s, F.lit("|"), F.lit("\\|")) if header else F.replace(s, F.lit("="), F.lit("\\="))


def cef(log: DataFrame, raw: bool = True) -> DataFrame:
    """X5."""
    c = lambda n: column(log, n)
    header = F.concat_ws("|", F.lit("CEF:0"), F.lit(VENDOR), F.lit(PRODUCT), F.lit("1.0"), cef_escape(F.coalesce(c("matched_format"), F.lit("generic_fallback")), True), cef_escape(F.substring("message", 1, 120), True), lookup(CEF_SEVERITY, F.col("severity_score"), 3).cast("string"))
    fields = [("rt", c("timestamp")), ("dvchost", c("hostname")), ("deviceProcessName", c("process")), ("cat", c("source_type")), ("msg", c("message")), ("cs1", c("severity")), ("cs2", c("component")), ("cs3", c("source_file")), ("cn1", c("source_record")), ("externalId", c("id")), ("requestMethod", c("http_method")), ("cn2", c("http_status"))]
    labels = {"cs1": "severity", "cs2": "component", "cs3": "sourceFile", "cn1": "sourceRecord", "cn2": "httpStatus", "cs4": "rawEvent"}
    if raw:
        fields.append(("cs4", c("raw_message")))
    part = lambda k, v: F.concat(F.lit(f"{k}Label={labels[k]} " if k in labels else ""), F.lit(f"{k}="), cef_escape(v, False))
    body = F.concat_ws(" ", *(F.when(v.isNotNull() & (v.cast("string") != ""), part(k, v)) for k, v in fields))
    return log.select("id", F.concat(header, F.lit("|"), body).alias("value"))


def csv(log: DataFrame, raw: bool = True) -> DataFrame:
    """Flat columns in the schema's order, for ``write.csv``."""
    return log.select(*(column(log, f.name).alias(f.name) for f in FIELDS if f.name not in ("embedding", "attributes") and (raw or f.name != "raw_message")))


def syslog_frame(log: DataFrame, octets: bool = True) -> DataFrame:
    """An RFC 5424 line with a CEF header, with its length in front for streams."""
    code = lookup(SYSLOG_SEVERITY, F.upper(F.coalesce("severity", F.lit("INFO"))), 6)
    head = F.concat(F.lit(f"CEF:0|{VENDOR}|"), cef_escape(F.coalesce("source_type", F.lit("Unknown")), True), F.lit("|1.0|"), cef_escape(F.coalesce(column(log, "matched_format"), F.lit("event")), True), F.lit("|"), cef_escape(F.substring("message", 1, 200), True), F.lit("|"), code.cast("string"), F.lit("|"))
    line = F.concat(F.lit("<"), (code + FACILITY * 8).cast("string"), F.lit(">1 "), "timestamp", F.lit(" "), F.coalesce("hostname", F.lit("-")), F.lit(" "), F.coalesce("process", F.lit("-")), F.lit(" - - - "), head)
    return log.select("id", (F.concat(F.octet_length(line).cast("string"), F.lit(" "), line) if octets else line).alias("value"))


SHAPES = {"ndjson": ndjson, "ecs": ecs, "ocsf": ocsf, "cef": cef}


def export(log: DataFrame, shape: str, path: str, flt: LogFilter = ALL, raw: bool = True, per_file: int = 200_000, compression: str = "gzip", array: bool = False) -> None:
    """The filtered events in order as files of at most ``per_file`` lines, or, with ``array``, as files
    that each hold one JSON array. ``compression`` is a codec of Spark's text writer, or ``none``."""
    rows = flt(log).repartitionByRange("timestamp", "id").sortWithinPartitions("timestamp", "id")
    if shape == "csv":
        csv(rows, raw).write.option("header", True).option("escape", '"').option("maxRecordsPerFile", per_file).option("compression", compression).csv(path)
        return
    values = SHAPES[shape](rows, raw).select("value")
    if array:

        def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a line ahead, so that the last one is known; brackets and commas are written around whole records
            held, n = None, 0
            give = lambda x: pa.RecordBatch.from_pydict({"value": pa.array(x, pa.string())})
            for b in batches:
                out = []
                for v in b.column(0).to_pylist():
                    if held is not None:
                        out.append(held + ("]" if n % per_file == 0 else ","))
                    held, n = ("[" if n % per_file == 0 else "") + v, n + 1
                if out:
                    yield give(out)
            if held is not None:
                yield give([held + "]"])

        values = values.mapInArrow(arrays, "value string")
    values.write.option("maxRecordsPerFile", per_file).option("compression", compression).text(path)


def push_first(log: DataFrame, post: Callable[[list[str]], None], n: int, shape: str = "ecs", flt: LogFilter = ALL, raw: bool = False, **how) -> DataFrame:
    """X11: the first ``n`` filtered events, newest first, through the transport: a preview of what an export would send."""
    first = flt(log).orderBy(F.desc("timestamp"), F.desc("id")).limit(n)
    return send(SHAPES[shape](first, raw), post, **how)


def send(lines: DataFrame, post: Callable[[list[str]], None], batch: int = 200, retries: int = 5, backoff: float = 0.5, dead_letters: str | None = None) -> DataFrame:
    """Lines in batches through an injected transport, at least once; batches that failed each time are counted as
    dead, and with ``dead_letters`` their lines are added to a table there, with what the transport said."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # one batch of rows for each that came: lines that failed, and a row for all that were sent
            values, lost, faults, sent = b.column(0).to_pylist(), [], [], 0
            for k in range(0, len(values), batch):
                part, fault = values[k : k + batch], ""
                for n in range(retries):
                    try:
                        post(part)
                        fault = ""
                        break
                    except Exception as e:  # noqa: BLE001  any failure of the transport is retried
                        fault = f"{type(e).__name__}: {e}"
                        if n + 1 < retries and backoff:
                            time.sleep(backoff * 2**n)
                if fault:
                    lost += part
                    faults += [fault] * len(part)
                else:
                    sent += len(part)
            yield pa.RecordBatch.from_pydict({
                "sent": pa.array([sent] + [0] * len(lost), pa.int64()), "dead": pa.array([0] + [1] * len(lost), pa.int64()),
                "value": pa.array([None, *lost], pa.string()), "error": pa.array([None, *faults], pa.string()),
            })

    told = lines.select("value").mapInArrow(run, "sent long, dead long, value string, error string")
    if dead_letters is not None:
        told = stored(told, "sent")  # sent once, then read twice
        told.where("dead > 0").select("value", "error", F.current_timestamp().alias("given_up_at")).write.mode("append").parquet(dead_letters)
    counts = told.agg(F.sum("sent").alias("sent"), F.sum("dead").alias("dead"))
    return counts.select(F.coalesce("sent", F.lit(0)).alias("sent"), F.coalesce("dead", F.lit(0)).alias("dead"))


def forward(log: DataFrame, shape: str, path: str, flt: LogFilter = ALL, raw: bool = True, largest: int = LARGEST, compression: str = "none") -> None:
    """The filtered events in order as files of at most ``largest`` bytes, all of them or none."""
    rows = flt(log).repartitionByRange("timestamp", "id").sortWithinPartitions("timestamp", "id")
    write_rotating(SHAPES[shape](rows, raw), path, largest, compression)


def upsert(stored: DataFrame | None, new: DataFrame, key: str = "id", order: str = "created_at") -> DataFrame:
    """The latest row of each key; ``new`` wins over ``stored``, its last row over its others."""
    last = Window.partitionBy(key).orderBy(F.desc(order), F.desc(F.to_json(F.struct(*new.columns))))
    fresh = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return fresh if stored is None else stored.join(fresh.select(key), key, "left_anti").select(*fresh.columns).unionByName(fresh)


def upsert_days(spark, path: str, new: DataFrame, key: str = "id", order: str = "created_at", stable: bool = False) -> None:
    """X13 on a table by day: rewrites the days that ``new`` touches, and those on which its keys stood before.

    Which days these are is found by keys and days alone; the rows of these days are stored apart before
    anything is overwritten, so that a lost executor loses nothing. ``stable`` says that ``new`` is stored already.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        upsert(None, new, key, order).write.partitionBy("day").parquet(path)
        return
    new = new if stable else stored(new, "upsert_new")
    table = spark.read.parquet(path)
    moved = table.select(key, "day").join(new.select(key).distinct(), key, "left_semi").select("day")
    days = moved.unionByName(new.select("day")).distinct()
    old = table.join(days, "day", "left_semi").select(*new.columns)
    kept = stored(upsert(old, new, key, order), "upsert")
    # a day that lost all its rows to another one is left without files
    empty = [r.day for r in days.join(kept.select("day").distinct(), "day", "left_anti").collect()]  # days of one batch
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    for day in empty:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
