"""Lines of any known format to events of one schema, as column expressions.

A line is claimed by the first rule whose text and pattern it has. The claim is one CASE, and each branch
replaces the line with the groups of its rule: every pattern is a literal, compiled once, and a line's own
runs twice, however many fields there are. No step has state or moves rows: the same expressions
serve batch and streams.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.schema import SEVERITY_SCORES

from . import fallback
from .rules import ALIASES, BAD_STATES, FACILITIES, FIELDS, JSON_RULES, LEVELS, REDIS_MARKS, REDIS_ROLES, RULES, SD_SOURCES, TAGS

FALLBACK = "generic_fallback"
RAW_CAP = 32_768
_NAMES = sorted({g for r in RULES for g in r.groups.split(",")})
_CEF_WORDS = {**dict.fromkeys("0123", "INFO"), **dict.fromkeys("456", "WARNING"), **dict.fromkeys("78", "ERROR"), "9": "CRITICAL", "10": "CRITICAL", "Low": "INFO", "Medium": "WARNING", "High": "ERROR", "Very-High": "CRITICAL"}
_SYSLOG = ("EMERGENCY", "ALERT", "CRITICAL", "ERROR", "WARNING", "NOTICE", "INFO", "DEBUG")
#: Shapes of timestamps and their patterns, tried in order. A pattern is only tried on its
#: shape: a failed parse raises inside the engine, which costs more than all the rest of a line.
FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}T", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][XXX][XX][X]"), (r"^\d{4}-\d{2}-\d{2} ", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][XXX][XX][X]"),
    (r"^\d{1,2}/[A-Z][a-z]{2}/\d{4}:", "d/MMM/yyyy:HH:mm:ss Z"), (r"^[A-Z][a-z]{2} \d{1,2} \d{4} ", "MMM d yyyy HH:mm:ss[.SSS][ Z]"), (r"^\d{1,2} [A-Z][a-z]{2} \d{4} ", "d MMM yyyy HH:mm:ss[.SSS]"),
    (r"^[A-Z][a-z]{2} \d{1,2} \S+ \d{4}$", "MMM d HH:mm:ss yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4} [\d:]+$", "d/M/yyyy HH:mm:ss"), (r"^\d{4}/", "yyyy/MM/dd HH:mm:ss"),
    (r"^\d{1,2}/(?:1[3-9]|[23]\d)/\d{4} [\d:]+$", "M/d/yyyy HH:mm:ss"), (r"^\d{1,2}/\d{1,2}/\d{4} .*[AP]M$", "M/d/yyyy hh:mm:ss a"),
)


def _map(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.expr("map(" + ", ".join(_literal(x) for kv in pairs.items() for x in kv) + ")"), key)


def empty_as_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def clean(text: Column) -> Column:
    """Without byte order mark, NUL and octal escapes, trimmed."""
    out = F.translate(text, "﻿\x00", "")
    for code, char in (("#011", "\t"), ("#012", "\n"), ("#015", "\r"), ("#033", "\x1b"), ("#040", " ")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.btrim(out, F.lit(" \t\n\r\x0b\x0c"))


def to_map(entries: Column, last: bool = True) -> Column:
    """A map of (key, value) pairs, of equal keys the last or the first; evaluates ``entries`` once."""
    none = F.create_map().cast("map<string,string>")
    one = lambda e: F.create_map(e["key"], e["value"])
    if last:
        return F.aggregate(entries, none, lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), one(e)))
    return F.aggregate(entries, none, lambda m, e: F.when(F.map_contains_key(m, e["key"]), m).otherwise(F.map_concat(m, one(e))))


def kv_bag(text: Column) -> Column:
    """``k=v``, ``k="v"`` and ``k='v'`` as a map; the last value of a key wins; bare values lose the
    punctuation of prose."""
    pair = r"([\w][\w\-.]*)=(?:'([^']*)'|\"([^\"]*)\"|([^\s,'\"\]]+))"
    part = lambda g: F.regexp_extract_all(text, F.lit(pair), F.lit(g))
    bare = F.transform(part(4), lambda v: F.regexp_replace(F.when(v.contains("("), v).otherwise(F.regexp_replace(v, r"\)+$", "")), r"[;:,.]+$", ""))
    quoted = F.zip_with(part(2), part(3), lambda a, b: F.concat(a, b))
    values = F.zip_with(quoted, bare, lambda q, v: F.concat(q, v))
    entries = F.zip_with(part(1), values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return F.coalesce(to_map(entries), F.create_map().cast("map<string,string>"))


def extension(text: Column) -> Column:
    """A CEF extension, whose values run up to the next key."""
    pair = r"(\w[\w.]*)=((?:(?!\s+\w[\w.]*=)[\s\S])*)"
    keys, values = (F.regexp_extract_all(text, F.lit(pair), F.lit(g)) for g in (1, 2))
    entries = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), F.replace(F.trim(v), F.lit("\\="), F.lit("=")).alias("value")))
    return to_map(entries)


def leef_extension(text: Column) -> Column:
    """Pairs by a declared delimiter, or by the candidate that yields most pairs."""
    declared = F.regexp_extract(text, r"^(x[0-9A-Fa-f]{2,4}|[^\w\s])\|", 1)
    body = F.when(declared != "", F.regexp_replace(text, r"^(x[0-9A-Fa-f]{2,4}|[^\w\s])\|", "")).otherwise(text)
    delimiter = F.when(declared.rlike("^x"), F.chr(F.conv(F.substring(declared, 2, 4), 16, 10).cast("int"))).when(declared != "", declared)
    split = lambda d: F.filter(F.split(body, d), lambda p: p.contains("="))
    ways = F.array(*(F.struct(F.size(split(d)).alias("n"), split(d).alias("p")) for d in ("\t", r"\|", r"\^", ";")))
    best = F.array_max(ways)["p"]
    chosen = F.when(delimiter.isNotNull(), F.filter(F.split(body, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))), lambda p: p.contains("="))).otherwise(best)
    entries = F.transform(chosen, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, r"^[^=]*=", "").alias("value")))
    return to_map(entries, last=False)


def timestamp(text: Column, as_of: str) -> Column:
    """A time in any of the formats, in UTC; forms without a year are of ``as_of``'s year."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"(\d),(\d{3,})", "$1.$2"), r"\s+", " ")
    t = F.regexp_replace(t, r"^[A-Z][a-z]{2} (?=[A-Z][a-z]{2} \d)", "")
    year = as_of[:4]
    of = lambda shape, value, form: F.when(t.rlike(shape), F.try_to_timestamp(value, F.lit(form)))
    tries = [of(shape, t, form) for shape, form in FORMATS]
    tries.append(of(r"^[A-Z][a-z]{2} \d{1,2} [\d:.]+$", F.concat(F.lit(f"{year} "), t), "yyyy MMM d HH:mm:ss[.SSS]"))
    tries.append(of(r"^\d{4} \d{2}:", F.concat(F.lit(year), t), "yyyyMMdd HH:mm:ss[.SSSSSS]"))
    number = t.try_cast("double")
    tries.append(F.when(t.rlike(r"^\d{13}$"), F.timestamp_millis(t.try_cast("long"))).when(t.rlike(r"^\d{9,10}(\.\d+)?$"), F.timestamp_micros((number * 1_000_000).cast("long"))))
    return F.coalesce(*tries)


_CUT = "\x01"


def _literal(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def claim(line: str = "_line") -> Column:
    """Of the column ``line``, the number of the first rule that it belongs to, from 1, and its groups; or null. One
    expression, as a column for each step of each rule would take longer than the parse."""
    pair = _literal(r"[A-Za-z_][\w.\-]*=(?:\"(?:[^\"\\]++|\\.)*+\"|\S*)")
    covered = f"length(regexp_replace({line}, {pair}, '')) <= 0.25 * length({line})"  # P21: pairs are three quarters of a line
    cases = []
    for k, r in enumerate(RULES, 1):
        n = len(r.groups.split(","))
        whole = r.pattern if r.pattern.endswith("$") else rf"{r.pattern}[\s\S]*$"
        shown = _CUT.join([str(k), *(f"${g}" for g in range(1, n + 1))])
        more = f" AND {covered}" if r.name == "logfmt" else ""
        cases.append(f"WHEN contains({line}, {_literal(r.holds)}) AND {line} RLIKE {_literal(r.pattern)}{more} THEN split(regexp_replace({line}, {_literal(whole)}, {_literal(shown)}), {_literal(_CUT)}, {n + 1})")
    return F.expr(f"CASE {' '.join(cases)} END")


def _of_rule(values: list) -> Column:
    """The entry of the claimed rule. As one expression: a column for each literal would take longer than the parse."""
    return F.expr(f"get(array({', '.join(map(_literal, values))}), _rule - 1)")


def _groups() -> Column:
    """The claimed rule's groups by their names, without blank ones."""
    names = ", ".join("array(" + ", ".join(_literal(g or None) for g in ["", *r.groups.split(",")]) + ")" for r in RULES)
    pairs = F.zip_with(F.expr(f"get(array({names}), _rule - 1)"), "_found_parts", lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda e: e["key"].isNotNull() & (F.trim(e["value"]) != "")))


def _group(name: str) -> Column:
    """The group of the claimed rule that is called ``name``, or null."""
    return F.try_element_at("_groups", F.lit(name))


def _named() -> Column:
    """The claimed rule's groups that are no fields, by name."""
    return F.map_filter("_groups", lambda k, v: ~k.isin(*FIELDS) & (v != "-"))


def _said() -> Column:
    """The message that the claimed rule makes of its groups, or null."""
    import re

    def made(template: str) -> Column:
        parts = [F.coalesce(_group(x[1:-1]), F.lit("")) if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", template) if x]
        return F.concat(*parts)

    templates: dict[str, list[int]] = {}
    for k, r in enumerate(RULES):
        if r.says:
            templates.setdefault(r.says, []).append(k + 1)
    return reduce(lambda c, tk: c.when(F.col("_rule").isin(tk[1]), made(tk[0])), templates.items(), F)


def sections(text: Column) -> Column:
    """Blocks of ``Section:`` lines with tab-indented ``key: value`` lines, as section.key."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    heading = lambda x: F.regexp_extract(x, r"^([A-Z][\w \-/]*?)\s*:\s*$", 1)
    key = lambda x: F.regexp_extract(x, r"^\t+([A-Za-z][\w /()\\\-]*?)\s*:\s*(.*)$", 1)

    def step(acc: Column, x: Column) -> Column:
        entry = F.struct(F.concat_ws(".", acc["section"], key(x)).alias("key"), F.trim(F.regexp_extract(x, r"^\t+[A-Za-z][\w /()\\\-]*?\s*:\s*(.*)$", 1)).alias("value"))
        return F.struct(
            F.when(heading(x) != "", heading(x)).otherwise(acc["section"]).alias("section"),
            F.when((heading(x) == "") & (key(x) != ""), F.concat(acc["entries"], F.array(entry))).otherwise(acc["entries"]).alias("entries"),
        )

    found = F.aggregate(F.split(text, "\r?\n"), F.struct(F.lit("General").alias("section"), none.alias("entries")), step)
    return to_map(found["entries"])


def flattened(text: Column, cut: int = 300, depth: int = 3) -> Column:
    """A JSON object's values by their paths, of ``depth`` names at most; scalar lists are joined."""
    level = F.map_entries(F.from_json(text, "map<string,string>"))
    out = F.array().cast("array<struct<key:string,value:string>>")
    for k in range(depth):
        plain = F.filter(level, lambda e: e["value"].isNotNull() & ~F.ltrim(e["value"]).startswith("{"))
        lists = lambda v: F.from_json(v, "array<string>")
        value = lambda v: F.when(~F.ltrim(v).startswith("["), v).when(F.size(lists(v)) > 0, F.when(~F.exists(lists(v), lambda x: F.substring(F.ltrim(x), 1, 1).isin("{", "[")), F.array_join(lists(v), ", ")))
        here = F.transform(plain, lambda e: F.struct(e["key"].alias("key"), F.substring(value(e["value"]), 1, cut).alias("value")))
        out = F.concat(out, F.filter(here, lambda e: e["value"].isNotNull()))
        if k < depth - 1:
            deep = F.filter(level, lambda e: F.ltrim(e["value"]).startswith("{"))
            level = F.flatten(F.transform(deep, lambda e: F.transform(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda x: F.struct(F.concat_ws(".", e["key"], x["key"]).alias("key"), x["value"].alias("value")))))
    return to_map(out)


MINIO = "api struct<name:string,bucket:string,object:string,status:string,statusCode:int>, time string, trigger string, remotehost string, requestID string, userAgent string, accessKey string, parentUser string"


def minio(text: Column) -> Column:
    """An access record written as a Python literal."""
    words = (("None", "null"), ("True", "true"), ("False", "false"))
    return F.from_json(reduce(lambda t, w: F.regexp_replace(t, rf"(?<=[:,\[]\s?){w[0]}\b", w[1]), words, text), MINIO)


def tagged(text: Column) -> Column:
    """``key: value`` and ``key=value`` tags between semicolons or commas."""
    pair = r"(\w[\w-]*)\s*[:=]\s*([^;,\]]+)"
    keys, values = (F.regexp_extract_all(text, F.lit(pair), F.lit(g)) for g in (1, 2))
    return to_map(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), F.trim(v).alias("value"))))


def commanded(text: Column) -> Column:
    """The parts of a sudo record: its command also without arguments, the user it runs as as ``target_user``."""
    pair = lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("key"), F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("value"))
    found = F.filter(F.transform(F.filter(F.split(text, ";"), lambda p: p.contains("=")), pair), lambda e: e["value"] != "")
    named = F.transform(found, lambda e: F.struct(F.when(e["key"] == "user", "target_user").otherwise(e["key"]).alias("key"), e["value"].alias("value")))
    program = F.transform(F.filter(found, lambda e: e["key"] == "command"), lambda e: F.struct(F.lit("exe").alias("key"), F.substring_index(e["value"], " ", 1).alias("value")))
    return to_map(F.concat(named, program))


def with_own(bag: Column, own: Column) -> Column:
    """Both maps as one; of equal keys the entry of ``own``."""
    return F.map_concat(F.map_filter(bag, lambda k, v: ~F.map_contains_key(own, k)), own)


def parse(raw: DataFrame, as_of: str, text: str = "raw") -> DataFrame:
    """Events of the lines in ``text``; other columns of ``raw`` are kept.

    A null or empty line is an event of the fallback format with an empty message. ``raw_message`` is the whole
    line; ``capped`` cuts it for a store.
    """
    keep, c, empty = [x for x in raw.columns if x != text], F.col, F.create_map().cast("map<string,string>")
    line = F.coalesce(F.col(text), F.lit(""))
    is_json = F.trim(line).startswith("{") & F.trim(line).endswith("}")
    df = raw.select(*keep, line.alias("raw_message"), F.trim(line).alias("_line"), is_json.alias("_json"))
    df = df.withColumn("_found_parts", F.when(~c("_json"), claim()))
    df = df.withColumn("_rule", c("_found_parts")[0].try_cast("int"))
    df = df.withColumn("_groups", _groups())
    df = df.select(*keep, "raw_message", "_line", "_json", "_rule", *(_group(n).alias(f"g_{n}") for n in _NAMES), F.coalesce(_named(), empty).alias("_own"), _said().alias("_said"))

    # JSON records: a rule by the paths it needs, else by aliases of keys
    path = lambda p: F.get_json_object("_line", f"$.{p}")
    needs = lambda r: reduce(lambda a, b: a & b, (path(p).isNotNull() for p in r[2]))
    json_rule = reduce(lambda acc, kr: acc.when(needs(kr[1]), kr[0] + 1), enumerate(JSON_RULES), F)
    df = df.withColumn("_jrule", F.when(c("_json"), F.coalesce(json_rule, F.lit(0))))
    flat = F.transform_keys(F.coalesce(F.from_json("_line", "map<string,string>"), empty), lambda k, v: F.lower(F.replace(k, F.lit("-"), F.lit("_"))))
    df = df.withColumn("_flat", F.when(c("_json"), flat))

    def of_json(field: str) -> Column:
        at = [(k + 1, r[3][field]) for k, r in enumerate(JSON_RULES) if field in r[3]]
        named = reduce(lambda acc, kp: acc.when(c("_jrule") == kp[0], path(kp[1])), at, F) if at else F.lit(None).cast("string")
        plain = F.coalesce(*(F.try_element_at("_flat", F.lit(k)) for k in ALIASES.get(field, ()))) if field in ALIASES else F.lit(None).cast("string")
        return F.when(c("_jrule") > 0, named).when(c("_jrule") == 0, plain)

    # Attributes from the rule's groups, bag, extension, or the body
    name = _of_rule([r.name for r in RULES])
    source_of_rule = _of_rule([r.source for r in RULES])
    named_json = F.get(F.array(F.lit("json"), *(F.lit(r[0]) for r in JSON_RULES)), c("_jrule"))
    df = df.withColumn("matched_format", F.coalesce(name, named_json, F.lit(FALLBACK))).withColumn("_source", source_of_rule)
    form = c("matched_format")
    lost = form == FALLBACK
    binary = lost & (printable_share(c("_line")) < 0.85)
    bag = (
        F.when(form == "cef", extension(c("g_extension"))).when(form == "leef", leef_extension(c("g_extension"))).when(c("_jrule") > 0, flattened(c("_line"))).when(c("_json"), c("_flat"))
        .when(binary, F.create_map(F.lit("binary_content"), F.lit("true"))).when(form == "windows_security_event", with_own(sections(c("g_message")), kv_bag(c("g_kv"))))
        .when(c("g_tags").isNotNull(), tagged(c("g_tags"))).when(c("g_parts").isNotNull(), commanded(c("g_parts"))).otherwise(kv_bag(F.coalesce("g_kv", "g_message", F.when(c("_said").isNull(), c("_line")), F.lit(""))))
    )
    pri = F.when(c("g_pri").isNotNull(), F.map_filter(F.create_map(F.lit("syslog_priority"), c("g_pri"), F.lit("syslog_facility"), F.get(F.array(*map(F.lit, FACILITIES)), F.floor(c("g_pri").try_cast("int") / 8).cast("int"))), lambda k, v: v.isNotNull()))
    sd = F.when(c("g_sdid").isNotNull(), F.create_map(F.lit("sdid"), c("g_sdid")))
    df = df.withColumn("attributes", with_own(F.coalesce(bag, empty), with_own(c("_own"), F.coalesce(pri, sd, empty))))
    attribute = lambda *keys: F.coalesce(*(empty_as_null(F.try_element_at("attributes", F.lit(k))) for k in keys))
    of_kv = lambda *keys: F.when(form.isin("fortinet_kv", "sophos_kv", "logfmt", "cef", "leef", "aria_automation_springboot"), attribute(*keys))
    of_appliance = lambda *keys: F.when(form.isin("fortinet_kv", "sophos_kv"), attribute(*keys))
    df = df.withColumn("_binary", binary).withColumn("_minio", F.when(c("g_minio").isNotNull(), minio(c("g_minio"))))

    # Lines that no rule claims tell by place; none is guessed from binary
    guessed = lost & ~c("_binary")
    df = df.withColumn("_body", F.when(guessed, fallback.body(c("_line")))).withColumn("_lost_host", F.when(guessed, fallback.host(c("_body"), c("attributes"))))
    df = df.withColumn("_rest", F.when(guessed, fallback.behind(c("_body"), c("_lost_host"))))
    lost_process, lost_pid = (F.when(guessed, f(c("_rest"), c("attributes"))) for f in (fallback.process, fallback.pid))
    given = lambda x: F.when(F.col(x) != "-", F.col(x))
    host = F.coalesce(given("g_host"), of_json("host"), of_kv("host", "hostname", "devname", "device_name", "dvchost", "dhost", "devid", "device"), c("_lost_host"))
    of_process = F.coalesce(of_appliance("log_component", "log_type", "type"), F.when(form == "logfmt", attribute("app", "component", "process", "service", "program", "namespace")), of_kv("app", "process", "service", "program"))
    process = F.coalesce(given("g_process"), of_json("process"), of_process, _of_rule([r.process for r in RULES]), lost_process)
    two = F.when(form.isin("fortinet_kv", "sophos_kv") & attribute("date").isNotNull() & attribute("time").isNotNull(), F.concat_ws(" ", attribute("date"), attribute("time")))
    stated = of_kv("rt", "devTime", "eventtime", "ts", "time_stamp", "timestamp", "at")
    when = F.coalesce(given("g_timestamp"), of_json("timestamp"), c("_minio.time"), stated, two, of_kv("time"), F.when(lost, fallback.time(c("_line"))))
    of_component = F.coalesce(of_appliance("log_subtype", "subtype", "log_type", "type"), F.when(form == "windows_security_event", attribute("task")), F.when(form == "horizon_view_audit", attribute("Module")))
    component = F.coalesce(given("g_component"), of_json("component"), of_component, "g_logger", attribute("subcomp", "comp", "sub", "component"), _of_rule([r.component for r in RULES]))
    api = lambda f: F.coalesce(c(f"_minio.api.{f}"), F.lit(""))
    stored = F.when(c("_minio").isNotNull(), F.concat(api("name"), F.lit(" "), F.coalesce("_minio.trigger", F.lit("")), F.lit(" "), api("bucket"), F.lit("/"), api("object"), F.lit(" -> "), api("status")))
    body = F.coalesce("_said", stored, "g_message", of_json("message"), of_kv("msg", "message", "logdesc", "event"))
    kept = F.map_filter("attributes", lambda k, v: F.length(v) > 0)
    composed = F.array_join(F.slice(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), 1, 12), " ")  # P5
    message = F.coalesce(empty_as_null(clean(body)), F.when(c("_json"), empty_as_null(composed)), empty_as_null(clean(c("_line"))), F.substring("raw_message", 1, 500))
    df = df.withColumns({"_host": host, "_process": process, "_when": when, "_component": component, "message": message})

    # Severity by a level word, a status, a code, or a word of the text
    text_word = F.upper(F.regexp_extract("message", r"(?i)\b(FATAL|CRITICAL|ERROR|FAILED|FAILURE|FAULT|EXCEPTION|TIMED OUT|TIMEOUT|WARNING|WARN)\b", 1))
    guess = F.when(text_word.isin("FATAL", "CRITICAL"), text_word).when(text_word.isin("WARNING", "WARN", "TIMED OUT", "TIMEOUT"), "WARNING").when(text_word != "", "ERROR")
    level = _map(LEVELS, F.upper(F.trim(F.coalesce("g_level", of_json("level"), attribute("level", "severity", "lvl", "Severity")))))
    status = F.coalesce(c("g_http_status").try_cast("int"), of_json("http_status").try_cast("int"), c("_minio.api.statusCode"))
    http = F.when(status.isNotNull(), F.when(status >= 500, "ERROR").when(status >= 400, "WARNING").when(status == 0, "WARNING").otherwise("INFO"))
    code = lambda x: F.get(F.array(*map(F.lit, _SYSLOG)), x)
    number = c("g_pri").try_cast("int")
    syslog = F.when(number.between(0, 191), code((number % 8).cast("int")))  # P20
    mnemonic = code(c("g_cisco_severity").try_cast("int"))
    constant = _of_rule([r.severity or None for r in RULES])
    rcode = F.when(c("g_rcode").isNotNull(), F.when(c("g_rcode") == "NOERROR", "INFO").otherwise("WARNING"))
    result = F.upper(of_json("result"))
    verdict = F.when(result.isin("DENY", "DENIED", "FRAUD"), "ERROR").when(result.isin("FAILURE", "FAILED"), "WARNING")
    refused = F.when(of_json("error_code").isNotNull(), F.when(of_json("error_code").rlike("(?i)AccessDenied|Unauthorized|Forbidden"), "WARNING").otherwise("ERROR"))
    cef = _map(_CEF_WORDS, F.trim("g_cef_severity"))
    succeeded = F.lower(F.coalesce(attribute("keywords"), F.lit(""))).contains("success")
    windows = F.when(form == "windows_security_event", F.when(c("_source") == "WindowsEventLog", F.when(F.lower("g_process").contains("error"), "ERROR").when(~F.exists(F.map_keys("attributes"), lambda k: k.contains(".")), "WARNING")).otherwise(F.lit(None)))
    windows = F.coalesce(windows, F.when(form == "windows_security_event", F.when(succeeded, "NOTICE").otherwise("WARNING")))
    armor = F.upper(attribute("apparmor"))
    audit = F.when((c("_source") == "LinuxAudit") & c("g_audit_epoch").isNotNull(), F.when(armor.isin("DENIED", "AUDIT"), "WARNING").when(armor == "ALLOWED", "INFO").when(guess.isNotNull(), guess).when(attribute("res") != "success", "WARNING").otherwise("INFO"))
    redis = F.when(c("g_redis_mark").isNotNull(), F.coalesce(guess, _map(REDIS_MARKS, c("g_redis_mark"))))
    zeek = F.when(c("g_conn_state").isin(*BAD_STATES), "WARNING")
    view = F.when(form == "horizon_view_audit", F.when(F.upper(attribute("Severity")).rlike("FAILURE|ERROR"), "ERROR").when(F.upper(attribute("Severity")).contains("WARN"), "WARNING").when(attribute("Severity").isNotNull(), "INFO"))
    action = F.when(F.lower(attribute("action", "act", "request_status", "status")).isin("deny", "denied", "blocked", "drop", "dropped"), "WARNING")
    sophos = F.when(form == "sophos_kv", action)
    found = F.coalesce(cef, windows, audit, redis, zeek, view, sophos, mnemonic, level, http, syslog, rcode, verdict, refused, constant)
    found = F.when(~c("_binary"), found)
    df = df.withColumns({"_found": found, "severity": F.when(c("_binary"), "INFO").otherwise(F.coalesce(found, action, guess, F.lit("INFO"))), "http_status": status})
    df = df.withColumn("event_ts", timestamp(c("_when"), as_of))

    json_source = F.when(c("_jrule") > 0, F.get(F.array(F.lit(""), *(F.lit(r[1]) for r in JSON_RULES)), c("_jrule"))).when(c("_jrule") == 0, of_json("source_type"))
    tag = reduce(lambda acc, t: acc.when(c("g_process").rlike(f"(?i){t[0]}"), t[1]), TAGS, F)
    special = F.coalesce(
        _map(SD_SOURCES, c("g_sdid")), F.when(c("_source") == "NetworkDevice", tag), F.when(form == "sophos_kv", attribute("device")),
        F.when((form == "fortinet_kv") & attribute("devname", "devid").isNull(), "NetworkDevice"),
    )
    known = F.coalesce(special, "_source", json_source)
    stamp = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    df = df.withColumns({"_known": known, "_stamp": stamp})
    iso = F.coalesce("_stamp", "_when", F.lit(f"{as_of}T00:00:00.000000Z"))
    day = empty_as_null(F.regexp_extract(iso, r"^(\d{4}-\d{2}-\d{2})", 1))
    host, process = F.coalesce("_host", F.lit("unknown-host")), F.coalesce("_process", F.lit("unknown-process"))
    confidence = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in ((c("_when"), 0.25), (c("_host"), 0.2), (c("_known"), 0.25), (c("_process"), 0.15), (c("_found"), 0.15))), F.lit(0.0))
    identity = F.concat_ws("|", F.coalesce("_stamp", "_when", F.lit("no-time")), host, process, "_line")
    component = F.coalesce(F.when(c("g_redis_role").isNotNull(), _map(REDIS_ROLES, c("g_redis_role"))), F.when(F.map_contains_key("attributes", F.lit("apparmor")), F.lit("apparmor")), "_component", process)
    source = F.coalesce("_known", F.lit("Unknown"))
    return df.select(
        *keep, F.concat(F.lit("log-"), F.substring(F.md5(identity), 1, 16)).alias("id"), iso.alias("timestamp"), F.when(c("_when").isNotNull(), "event").otherwise("ingest").alias("timestamp_source"),
        F.coalesce(F.abs(F.datediff(F.lit(as_of).cast("date"), c("event_ts").cast("date"))) > 730, F.lit(False)).alias("timestamp_anomalous"), day.alias("day"), host.alias("hostname"),
        source.alias("source_type"), process.alias("process"), F.coalesce("g_pid", of_json("pid"), lost_pid).try_cast("int").alias("pid"), component.alias("component"),
        "severity", F.coalesce(_map(SEVERITY_SCORES, c("severity")), F.lit(6)).alias("severity_score"), "message",
        F.concat(F.lit("["), source, F.lit("] "), host, F.lit("/"), process, F.lit(": "), F.substring("message", 1, 200)).alias("normalized_message"),
        "attributes", F.coalesce("g_http_method", of_json("http_method")).alias("http_method"), "http_status", F.round(confidence, 2).alias("confidence"), "matched_format",
        "raw_message", F.sha2(F.encode("raw_message", "UTF-8"), 256).alias("raw_hash"), F.lit(None).cast("boolean").alias("raw_truncated"), F.lit(None).cast("int").alias("raw_length"), "event_ts",
    )


def capped(events: DataFrame, most: int = RAW_CAP) -> DataFrame:
    """Events for a store with a bound on a line's length; what is cut is told, and the hash stays that of all."""
    longer = F.length("raw_message") > most
    return events.withColumns({"raw_message": F.substring("raw_message", 1, most), "raw_truncated": F.when(longer, True), "raw_length": F.when(longer, F.length("raw_message"))})


def printable_share(text: Column) -> Column:
    """The share of printable letters in the first 400; below 0.85 a line counts as binary."""
    head = F.substring(text, 1, 400)
    return F.length(F.regexp_replace(head, r"[^\x20-\x7e\t\r\n]", "")) / F.greatest(F.length(head), F.lit(1))


def preview(events: DataFrame) -> DataFrame:
    """Events for each format, and the share whose host, process and time were found."""
    share = lambda cond: F.round(100.0 * F.count_if(cond) / F.count("*"), 2)
    return events.groupBy("matched_format").agg(F.count("*").alias("events"), share(F.col("hostname") != "unknown-host").alias("with_host"), share(F.col("process") != "unknown-process").alias("with_process"), share(F.col("timestamp_source") == "event").alias("with_time"))
