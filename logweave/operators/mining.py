"""Drafts of rules for lines that no rule knows: typed tokens, shapes, slots, and what slots mean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Token types, the most specific first.
TOKENS = (
    ("iso_ts", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"),
    ("bsd_ts", r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"),
    ("composite_ts", r"\d{4}[-/|.]\d{2}[-/|.]\d{2}[T |]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"),
    ("epoch_ms", r"\b\d{13}\b"),
    ("uuid", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    ("ipv4_port", r"\d{1,3}(?:\.\d{1,3}){3}:\d{1,5}"),
    ("ipv4", r"\d{1,3}(?:\.\d{1,3}){3}"),
    ("mac", r"(?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}"),
    ("priority", r"<\d{1,3}>"),
    ("quoted", r"\"[^\"]*\""),
    ("bracketed", r"\[[^\]]*\]"),
    ("level", r"\b(?:EMERG|EMERGENCY|ALERT|CRIT|CRITICAL|FATAL|ERROR|ERR|WARNING|WARN|NOTICE|INFO|DEBUG|TRACE)\b"),
    ("hexnum", r"\b0x[0-9a-fA-F]+\b"),
    ("float", r"\b\d+\.\d+\b"),
    ("int", r"\b\d+\b"),
    ("word", r"[A-Za-z_][\w.\-]*"),
    ("space", r"\s+"),
    ("punct", r"[^\w\s]"),
)
#: Types that are fields even where a sample has one value.
ALWAYS = ("iso_ts", "bsd_ts", "epoch_ms", "uuid", "ipv4", "ipv4_port", "mac", "quoted", "bracketed", "level", "hexnum", "float", "int", "priority")
TIMES = ("iso_ts", "bsd_ts", "epoch_ms", "composite_ts")
#: Names of keys for each field.
KEYS = {
    "hostname": ("hostname", "host", "dvchost", "devicehostname", "shost", "computername", "computer", "devname", "device", "node", "agent_host", "src_host", "server", "machine", "appliance"),
    "process": ("process", "proc", "program", "app", "appname", "application", "service", "processname", "process_name", "daemon", "prog"),
    "severity": ("severity", "sev", "level", "loglevel", "log_level", "levelname", "priority", "event_severity", "criticality"),
    "timestamp": ("timestamp", "time", "date", "datetime", "eventtime", "event_time", "devtime", "rt", "occurred", "logtime"),
    "component": ("component", "subsystem", "module", "category", "channel", "facility", "subtype", "type", "class"),
    "message": ("message", "msg", "description", "detail", "text", "reason", "event", "body", "summary"),
    "user": ("user", "usr", "username", "user_name", "account", "suser", "duser", "login", "principal", "actor", "uid_name"),
    "src_ip": ("src", "srcip", "src_ip", "source_ip", "sourceip", "saddr", "client_ip", "clientip", "ip_client", "remote_ip", "peer"),
    "dst_ip": ("dst", "dstip", "dst_ip", "dest_ip", "destip", "daddr", "target_ip", "server_ip", "remote_addr"),
    "src_port": ("spt", "srcport", "src_port", "source_port", "sport"),
    "dst_port": ("dpt", "dstport", "dst_port", "dest_port", "dport", "port"),
    "action": ("action", "act", "deviceaction", "verdict", "disposition", "outcome", "result", "status"),
    "protocol": ("proto", "protocol", "transport", "ipproto"),
    "session": ("sess", "session", "sessionid", "session_id", "connid", "conn_id", "flowid"),
    "rule": ("rule", "policy", "pol", "policyid", "ruleid", "rule_name", "signature", "sigid"),
    "bytes": ("bytes", "size", "len", "length", "sentbyte", "rcvdbyte"),
}
#: What a type says about its values, how sure each kind of evidence is, and words of severity.
TYPE_MEANS = {"iso_ts": "timestamp", "bsd_ts": "timestamp", "epoch_ms": "timestamp", "composite_ts": "timestamp", "level": "severity", "ipv4": "ip", "ipv4_port": "endpoint", "mac": "mac", "uuid": "uuid"}
TRUST = {"key": 0.95, "own key": 0.6, "host slot": 0.85, "program slot": 0.8, "severity word": 0.9, "type": 0.75, "address": 0.4, "none": 0.2}
SEVERITY_WORDS = "emerg|emergency|alert|crit|critical|fatal|err|error|warn|warning|notice|info|information|informational|debug|trace|verbose"
HOSTLIKE, PROCLIKE, IDENTIFIER = r"^(?=.*[\d\-.])[A-Za-z][\w.\-]{2,62}$", r"^[A-Za-z][\w.\-]{1,40}$", r"^(?=.*[\d\-])[\w.\-]{2,}$"
CORE = ("timestamp", "hostname", "process", "severity", "message")


def _by(pairs: dict, column: str) -> Column:
    return reduce(lambda c, kv: c.when(F.col(column) == kv[0], kv[1]), pairs.items(), F)


def tokenise(line: Column) -> Column:
    """M1: a line as (type, text) pairs."""
    master = "|".join(f"(?:{p})" for _, p in TOKENS)
    of = dict(TOKENS)
    is_a = lambda t, name: t.rlike(f"^(?:{of[name]})$")

    def kind(t: Column) -> Column:
        # most tokens are blanks, signs and words: no type before them takes a blank or a sign, and only two take a word
        near = F.when(is_a(t, "space"), "space").when((F.length(t) == 1) & is_a(t, "punct"), "punct")
        near = near.when(is_a(t, "word"), F.when(is_a(t, "uuid"), "uuid").when(is_a(t, "level"), "level").otherwise("word"))
        return reduce(lambda c, name: c.when(is_a(t, name), name), of, near)

    return F.transform(F.regexp_extract_all(line, F.lit(master), F.lit(0)), lambda t: F.struct(kind(t).alias("type"), t.alias("text")))


def _shaped(lines: DataFrame, text: str) -> DataFrame:
    typed = lines.where(F.trim(text) != "").withColumn("tokens", tokenise(F.col(text)))
    return typed.withColumn("shape", F.array_join(F.transform("tokens", lambda t: t["type"]), " "))


def shapes(lines: DataFrame, text: str = "raw") -> DataFrame:
    """M2: lines by the types of their tokens, largest group first; blank lines are left out."""
    return _shaped(lines, text).groupBy("shape").agg(F.count("*").alias("lines"), F.min(text).alias("example")).orderBy(F.desc("lines"), "shape")


def slots(lines: DataFrame, text: str = "raw") -> DataFrame:
    """M3, M4: for each shape and place: type, different values, whether it is a field, what it means, on what
    evidence, and how sure that is.

    A name before an equals sign says most; then the slots of host and program after a time; then severity words;
    then the type. A word that never changes but looks like an identifier is a field, with a warning.
    """
    each = _shaped(lines, text).select("shape", F.posexplode("tokens").alias("pos", "t")).select("shape", "pos", F.col("t.type").alias("type"), F.col("t.text").alias("value"))
    # different values are counted first, and tested once each
    each = each.groupBy("shape", "pos", "type", "value").agg(F.count("*").alias("n"))
    out = each.groupBy("shape", "pos", "type").agg(
        F.sum("n").alias("lines"), F.count("*").alias("values"), F.min("value").alias("example"), F.every(F.col("value").rlike(HOSTLIKE)).alias("_hosts"),
        F.every(F.col("value").rlike(PROCLIKE)).alias("_programs"), F.every(F.lower("value").rlike(f"^(?:{SEVERITY_WORDS})$")).alias("_levels"),
    )
    place = Window.partitionBy("shape").orderBy("pos")  # the places of one shape
    so_far = place.rowsBetween(Window.unboundedPreceding, 0)
    key = F.when((F.lag("example", 1).over(place) == "=") & (F.lag("type", 2).over(place) == "word"), F.lower(F.lag("example", 2).over(place)))
    counts = ~F.col("type").isin("space", "punct")
    out = out.withColumns({"key": key, "_rank": F.when(counts, F.sum(counts.cast("int")).over(so_far))})
    out = out.withColumn("_time", F.min(F.when(F.col("type").isin(*TIMES), F.col("_rank"))).over(Window.partitionBy("shape")))
    steady = (F.col("values") == 1) & ~F.col("type").isin(*ALWAYS)
    odd = steady & (F.col("type") == "word") & F.col("example").rlike(IDENTIFIER) & ~F.col("example").rlike(r"^\d+$")
    out = out.withColumn("warning", F.when(odd, "constant, but looks like an identifier")).withColumn("field", (F.col("type") != "space") & (~steady | odd))
    by_key = reduce(lambda c, kv: c.when(F.col("key").isin(*kv[1]), kv[0]), KEYS.items(), F)
    by_type = _by(TYPE_MEANS, "type")
    evidence = (
        F.when(by_key.isNotNull(), "key").when(F.col("key").isNotNull(), "own key").when((F.col("_rank") == F.col("_time") + 1) & F.col("_hosts"), "host slot")
        .when((F.col("_rank") == F.col("_time") + 2) & F.col("_programs"), "program slot").when((F.col("type") == "level") | F.col("_levels"), "severity word")
        .when(by_type == "ip", "address").when(by_type.isNotNull(), "type").otherwise("none")
    )
    out = out.withColumn("evidence", F.when(F.col("field"), evidence))
    means = F.when(F.col("evidence") == "key", by_key).when(F.col("evidence") == "own key", F.col("key")).when(F.col("evidence") == "host slot", "hostname").when(F.col("evidence") == "program slot", "process").when(F.col("evidence") == "severity word", "severity").otherwise(by_type)
    out = out.withColumns({"meaning": F.when(F.col("field"), means), "trust": F.when(F.col("field"), _by(TRUST, "evidence"))})
    return out.select("shape", "pos", "type", "lines", "values", "example", "key", "field", "meaning", "evidence", "trust", "warning")


def drafts(lines: DataFrame, text: str = "raw", most: int = 5) -> DataFrame:
    """M3, M5: a rule for each shape: pattern, fields, warnings, how much of it is understood, and whether it rests on
    fewer than four lines. ``coverage`` is the share of all lines, in per cent, that the pattern takes, for the
    ``most`` largest shapes: their patterns become literals of one more pass."""
    s = slots(lines, text)
    pattern = _by(dict(TOKENS), "type")
    literal = F.regexp_replace("example", r"([\\.^$|()\[\]{}*+?\"\-])", r"\\$1")
    part = F.when(F.col("type") == "space", r"\s+").when(F.col("field"), F.concat(F.lit("("), pattern, F.lit(")"))).otherwise(literal)
    in_order = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda e: e["x"])
    resolved = F.col("field") & F.col("meaning").isNotNull() & (F.col("evidence") != "own key")
    out = s.groupBy("shape").agg(
        F.max("lines").alias("lines"), F.array_join(in_order(F.struct("pos", part.alias("x"))), "").alias("pattern"),
        F.array_join(in_order(F.when(F.col("field"), F.struct("pos", F.coalesce("meaning", F.lit("?")).alias("x")))), ",").alias("fields"),
        F.count_if("field").alias("slots"), F.count_if(resolved).alias("resolved"), F.countDistinct(F.when(resolved & F.col("meaning").isin(*CORE), F.col("meaning"))).alias("core"),
        F.array_join(in_order(F.when(F.col("warning").isNotNull(), F.struct("pos", F.concat_ws(": ", "example", "warning").alias("x")))), "; ").alias("warnings"),
    )
    confidence = F.round(F.lit(0.4) * F.col("resolved") / F.greatest("slots", F.lit(1)) + F.lit(0.6) * F.col("core") / len(CORE), 2)
    out = out.withColumns({"confidence": confidence, "over_fit": F.col("lines") < 4})
    first = [(r.shape, r.pattern) for r in out.orderBy(F.desc("lines"), "shape").limit(most).select("shape", "pattern").collect()]
    if not first:
        return out.withColumn("coverage", F.lit(None).cast("double"))
    counts = lines.where(F.trim(text) != "").agg(*(F.round(100.0 * F.count_if(F.col(text).rlike(f"^{p}$")) / F.count("*"), 1).alias(f"c{k}") for k, (_, p) in enumerate(first))).first()
    covered = reduce(lambda c, ks: c.when(F.col("shape") == ks[1][0], counts[ks[0]]), enumerate(first), F)
    return out.withColumn("coverage", covered.cast("double")).orderBy(F.desc("lines"), "shape")


def unmatched(log: DataFrame) -> DataFrame:
    """M6: lines that only the fallback took."""
    return log.where(F.col("matched_format") == "generic_fallback").select(F.col("raw_message").alias("raw"))
