"""Fifty named questions over events, mentions, nodes and edges.

A question is a function of the tables that it reads, by the names of its parameters; ``ask`` binds them.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IS_ERROR = "severity = 'ERROR'"


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def _ranked(df: DataFrame, by: str, *ties: str, k: int, rarest: bool = False) -> DataFrame:
    return df.orderBy(F.asc(by) if rarest else F.desc(by), *ties).limit(k)


def _top(log: DataFrame, column: str, name: str, k: int, rarest: bool = False) -> DataFrame:
    return _ranked(log.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("logs")), "logs", name, k=k, rarest=rarest)


def _distinct(log: DataFrame, key: str, name: str, column: str, many: str, more_than: int = 0) -> DataFrame:
    return log.groupBy(F.col(key).alias(name)).agg(F.countDistinct(column).alias(many)).where(F.col(many) > more_than)


def _share(log: DataFrame, key: str, name: str, of: Column, part: str, rate: str, least: int, k: int) -> DataFrame:
    out = log.groupBy(F.col(key).alias(name)).agg(F.count_if(of).alias(part), F.count("*").alias("total")).where(F.col("total") >= least)
    return _ranked(out.withColumn(rate, F.col(part) / F.col("total")), rate, name, k=k)


def _failing(log: DataFrame) -> DataFrame:
    return log.where(IS_ERROR)


def _of_label(nodes: DataFrame, label: str) -> DataFrame:
    return _count(nodes.where(F.col("label") == label))


def _targets(edges: DataFrame, rel: str, name: str, more_than: int) -> DataFrame:
    return _distinct(edges.where(F.col("rel") == rel), "src", name, "dst", "hosts", more_than)


def _sharing(edges: DataFrame, rel: str, name: str) -> DataFrame:
    """Pairs of hosts of one source: the first 25, so of the first 25 sources with two hosts, and each source's 26 smallest
    hosts. Sources are found by their least and greatest host, and hosts ranked before any are gathered."""
    own = edges.where(F.col("rel") == rel).select("src", "dst")
    few = own.groupBy("src").agg(F.min("dst").alias("lo"), F.max("dst").alias("hi")).where("lo < hi").select("src").orderBy("src").limit(25)
    hosts = own.join(F.broadcast(few), "src").distinct().withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where("n <= 26")
    each = hosts.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("d")).select("src", "d", F.posexplode("d").alias("i", "host1"))
    pairs = each.select(F.col("src").alias(name), "host1", F.explode(F.expr("slice(d, i + 2, 26)")).alias("host2"))
    return pairs.orderBy(name, "host1", "host2").limit(25)


def q20_logs_per_host(log):
    return log.groupBy("hostname").count().agg(F.avg("count").alias("n"))


def q29_error_and_warning(log):
    return log.where("severity in ('ERROR', 'WARNING')").groupBy(F.col("hostname").alias("host")).agg(F.countDistinct("severity").alias("n")).where("n = 2").select("host")


def q36_logs_with_files(log, mentions):
    return log.join(mentions.where("type = 'file'").select(F.col("log_id").alias("id")), "id", "left_semi").agg(F.countDistinct("id").alias("n"))


def q37_top_users(log, mentions):
    own = mentions.where("type = 'user'").join(log.select(F.col("id").alias("log_id")), "log_id")
    return _ranked(own.groupBy(F.col("value").alias("user_name")).agg(F.count("*").alias("logs")), "logs", "user_name", k=5)


def q38_operations_of_errors(log, mentions):
    failed = _failing(log).select(F.col("id").alias("log_id"))
    return mentions.where("type = 'operation'").join(failed, "log_id", "left_semi").agg(F.countDistinct("value").alias("n"))


def q39_span_of_severity(log):
    return log.groupBy("severity").agg(F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest"))


def q41_users_of_failing_hosts(log, edges):
    own = edges.where("rel = 'ACCESSED'").select(F.col("src").alias("user_name"), F.col("dst").alias("host")).distinct()
    return own.join(_failing(log).select(F.col("hostname").alias("host")).distinct(), "host", "left_semi").orderBy("user_name", "host").limit(25).select("user_name", "host")


def q47_share_of_host(log):
    pairs = log.groupBy(F.col("hostname").alias("host"), "process").agg(F.count("*").alias("logs"))
    whole = pairs.groupBy("host").agg(F.sum("logs").alias("total"))
    return _ranked(pairs.join(whole, "host").withColumn("pct", F.col("logs") / F.col("total")), "logs", "host", "process", k=5).select("host", "process", "logs", "total", "pct")


def _grouped(log: DataFrame, *columns: tuple[str, str], where: str = "true", name: str = "logs") -> DataFrame:
    return log.where(where).groupBy(*(F.col(c).alias(n) for c, n in columns)).agg(F.count("*").alias(name))


QUESTIONS: dict[str, Callable[..., DataFrame]] = {
    "q01_logs": lambda log: _count(log),
    "q02_hosts": lambda nodes: _of_label(nodes, "Host"),
    "q03_errors": lambda log: _count(_failing(log)),
    "q04_sources": lambda log: log.agg(F.countDistinct("source_type").alias("n")),
    "q05_users": lambda nodes: _of_label(nodes, "User"),
    "q06_score_3": lambda log: _count(log.where("severity_score <= 3")),
    "q07_processes": lambda nodes: _of_label(nodes, "Process"),
    "q08_days": lambda nodes: nodes.where("label = 'Day'").agg(F.countDistinct("value").alias("n")),
    "q09_addresses": lambda nodes: _of_label(nodes, "IPAddress"),
    "q10_one_source": lambda log: _count(log.where("source_type = 'ESXi'")),
    "q11_top_host": lambda log: _top(log, "hostname", "host", 1),
    "q12_top_5_hosts": lambda log: _top(log, "hostname", "host", 5),
    "q13_top_source": lambda log: _top(log, "source_type", "source", 1),
    "q14_per_severity": lambda log: _grouped(log, ("severity", "severity")),
    "q15_top_process": lambda log: _top(log, "process", "process", 1),
    "q16_rare_sources": lambda log: _top(log, "source_type", "source", 3, rarest=True),
    "q17_busiest_day": lambda log: _top(log, "day", "day", 1),
    "q18_top_components": lambda log: _top(log, "component", "component", 5),
    "q19_quiet_hosts": lambda log: _top(log, "hostname", "host", 5, rarest=True),
    "q20_logs_per_host": q20_logs_per_host,
    "q21_hosts_with_errors": lambda log: _failing(log).select(F.col("hostname").alias("host")).distinct(),
    "q22_errors_per_host": lambda log: _ranked(_grouped(log, ("hostname", "host"), where=IS_ERROR, name="errors"), "errors", "host", k=10),
    "q23_users_of_hosts": lambda edges: _targets(edges, "ACCESSED", "user_name", 1),
    "q24_processes_on_hosts": lambda edges: _targets(edges, "RUNS_ON", "process", 2),
    "q25_hosts_of_sources": lambda log: _distinct(log, "hostname", "host", "source_type", "num_sources", 3),
    "q26_hosts_per_source": lambda log: _distinct(log, "source_type", "source", "hostname", "hosts"),
    "q27_error_components": lambda log: _ranked(_grouped(log, ("component", "component"), where=IS_ERROR, name="errors"), "errors", "component", k=10),
    "q28_processes_of_source": lambda log: log.where("source_type = 'CoreDNS'").select("process").distinct(),
    "q29_error_and_warning": q29_error_and_warning,
    "q30_processes_per_host": lambda log: _ranked(_distinct(log, "hostname", "host", "process", "processes"), "processes", "host", k=10),
    "q31_busiest_day_count": lambda log: _top(log, "day", "day", 1),
    "q32_error_share_of_source": lambda log: _share(log, "source_type", "source", F.col("severity") == "ERROR", "errors", "error_rate", 10, 5),
    "q33_hosts_on_days": lambda log: _distinct(log, "hostname", "host", "day", "days", 2),
    "q34_by_score": lambda log: _grouped(log, ("severity_score", "score")),
    "q35_error_share_of_host": lambda log: _share(log, "hostname", "host", F.col("severity") == "ERROR", "errors", "rate", 10, 5),
    "q36_logs_with_files": q36_logs_with_files,
    "q37_top_users": q37_top_users,
    "q38_operations_of_errors": q38_operations_of_errors,
    "q39_span_of_severity": q39_span_of_severity,
    "q40_host_process_pairs": lambda log: _ranked(_grouped(log, ("hostname", "host"), ("process", "process")), "logs", "host", "process", k=10),
    "q41_users_of_failing_hosts": q41_users_of_failing_hosts,
    "q42_hosts_sharing_users": lambda edges: _sharing(edges, "ACCESSED", "user_name"),
    "q43_score_per_source": lambda log: log.groupBy(F.col("source_type").alias("source")).agg(F.avg("severity_score").alias("avg_severity")),
    "q44_hosts_sharing_processes": lambda edges: _sharing(edges, "RUNS_ON", "process"),
    "q45_bad_per_source": lambda log: _grouped(log, ("source_type", "source"), ("severity", "severity"), where="severity in ('ERROR', 'WARNING')"),
    "q46_spread_components": lambda log: _ranked(_distinct(log, "component", "component", "hostname", "hosts"), "hosts", "component", k=5),
    "q47_share_of_host": q47_share_of_host,
    "q48_errors_per_day": lambda log: _grouped(log, ("day", "day"), where=IS_ERROR, name="errors"),
    "q49_largest_combination": lambda log: _ranked(_grouped(log, ("hostname", "host"), ("process", "process"), ("source_type", "source")), "logs", "host", "process", "source", k=1),
    "q50_bad_rate": lambda log: _share(log, "hostname", "host", F.col("severity").isin("ERROR", "CRITICAL"), "bad", "bad_rate", 101, 10),
}


#: Relationships that a question about edges asks for.
RELATIONSHIPS = {"q23_users_of_hosts": ("ACCESSED",), "q24_processes_on_hosts": ("RUNS_ON",), "q41_users_of_failing_hosts": ("ACCESSED",), "q42_hosts_sharing_users": ("ACCESSED",), "q44_hosts_sharing_processes": ("RUNS_ON",)}


def tables_of(name: str) -> set[str]:
    return set(inspect.signature(QUESTIONS[name]).parameters)


def ask(name: str, **tables: DataFrame) -> DataFrame:
    """The answer, from the tables that the question reads."""
    return partial(QUESTIONS[name], **tables)()
