"""What can be told of a line that no rule claims: its time, host and process, by where they stand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of a time, in order. One with a year at its end is tried before the same one without.
TIMES = (
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?", r"\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}",
    r"[A-Z][a-z]{2}\s+[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\d{4}", r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    r"\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}", r"\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}",
)
#: Keys that name a host or a process, the most telling first, and endings of names that are files.
HOST_KEYS = ("hostname", "host", "dvchost", "devicehostname", "shost", "computername", "computer", "devname", "device", "node", "agent_host", "src_host", "server")
PROCESS_KEYS = ("process", "proc", "program", "app", "appname", "application", "service", "processname", "process_name")
FILES = r"(?i)\.(?:log|txt|json|xml|csv|conf|cfg|ini|py|sh|so|c|cpp|h|java|js|jar|gz|zip|tar|db|pid|sock|yaml|yml|html|php|exe|dll)$"
FULL_NAME = r"[A-Za-z0-9][\w\-]*(?:\.[A-Za-z0-9][\w\-]*)+"
#: A time leads a line if it begins within so many letters.
LEADING, SHORTEST, LONGEST_PROCESS = 32, 4, 64
#: Domains whose names are preferred to others.
SITE_DOMAINS = ("local",)
_PRIORITY, _SLOT = r"^<\d{1,3}>\s*", r"\s*(?:\d\s+)?([A-Za-z0-9][\w.\-]{1,62})\s"
_PROGRAM = r"^([\w./\-]{1,48})(?:\[(\d+)\])?\s*:\s*"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    value = F.regexp_extract(text, pattern, group)
    return F.when(value != "", value)


def body(line: Column) -> Column:
    """The first line, without a priority."""
    return F.regexp_replace(F.substring_index(line, "\n", 1), _PRIORITY, "")


def time(line: Column) -> Column:
    """The first time of the first shape that there is in the first line."""
    first = F.substring_index(line, "\n", 1)
    return F.coalesce(*(_found(first, rf"\b({t})\b") for t in TIMES))


def looks_like_host(token: Column) -> Column:
    """A full name whose first and last labels are of two letters or more, or a short one with a digit or dash; no
    file, address or number, and no class: a last label in capitals only at its head, after one in small letters."""
    full = token.rlike(rf"^(?![\d.]+$){FULL_NAME}$") & token.rlike(r"^[^.]{2,}\.") & token.rlike(r"\.[A-Za-z]{2,}$")
    short = token.rlike(r"^(?=.*[\d\-])[A-Za-z][\w\-]{1,62}$")
    sound = (F.length(token) >= SHORTEST) & ~token.rlike(FILES) & ~token.rlike(r"^[\d.]*$") & ~token.rlike(r"^[a-z].*\.[A-Z][a-z]\w*$")
    return sound & F.when(token.contains("."), full).otherwise(short)


def _of_key(bag: Column, keys: tuple[str, ...], fits) -> Column:
    """The value of the most telling key, in any case, whose value fits."""
    rank = lambda e: F.array_position(F.array(*map(F.lit, keys)), F.lower(e["key"]))
    known = F.filter(F.map_entries(bag), lambda e: F.lower(e["key"]).isin(*keys) & fits(e["value"]))
    return F.array_min(F.transform(known, lambda e: F.struct(rank(e).alias("rank"), e["value"].alias("value"))))["value"]


def host(text: Column, bag: Column, site_domains: tuple[str, ...] = SITE_DOMAINS) -> Column:
    """By a key that says so, the slot after a leading time, or a full name, of the site if there is one."""
    leading = [(rf"^[\s\S]{{0,{LEADING}}}?\b{t}\b", rf"^(?>[\s\S]{{0,{LEADING}}}?\b{t}\b){_SLOT}") for t in TIMES]
    slot = reduce(lambda c, x: c.when(text.rlike(x[0]), _found(text, x[1])), leading, F)
    names = F.filter(F.regexp_extract_all(text, F.lit(rf"\b(?![\d.]+\b)({FULL_NAME})\b"), F.lit(1)), looks_like_host)
    of_site = F.filter(names, lambda x: reduce(lambda a, d: a | F.lower(x).endswith(d), site_domains, F.lit(False)))
    return F.coalesce(_of_key(bag, HOST_KEYS, looks_like_host), F.when(looks_like_host(slot), slot), F.get(of_site, F.lit(0)), F.get(names, F.lit(0)))


def behind(text: Column, name: Column) -> Column:
    """What stands behind the first ``name``, or all."""
    at = F.coalesce(F.position(name, text), F.lit(0))
    return F.ltrim(F.when(at > 0, F.substr(text, at + F.length(name))).otherwise(text))


def process(rest: Column, bag: Column) -> Column:
    """By a key, or ``name[pid]:`` where ``rest``, the text behind the host, begins."""
    name = _found(rest, _PROGRAM)
    key = _of_key(bag, PROCESS_KEYS, lambda v: F.length(v) > 0)
    return F.coalesce(F.substring(key, 1, LONGEST_PROCESS), F.when(name.rlike("[A-Za-z]"), name))


def pid(rest: Column, bag: Column) -> Column:
    """The number in brackets, where the process is told by its place."""
    none = _of_key(bag, PROCESS_KEYS, lambda v: F.length(v) > 0).isNull()
    return F.when(none & _found(rest, _PROGRAM).rlike("[A-Za-z]"), _found(rest, _PROGRAM, 2))
