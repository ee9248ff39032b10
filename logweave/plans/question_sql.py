"""The SQL of the fifty questions, for comparison."""

from __future__ import annotations

_BY = "SELECT {c} AS {n}, count(*) AS logs FROM log GROUP BY {c} ORDER BY logs {d}, {n} LIMIT {k}"


def _top(column: str, name: str, k: int, direction: str = "DESC") -> str:
    return _BY.format(c=column, n=name, d=direction, k=k)


QUESTIONS: dict[str, str] = {
    "q01_logs": "SELECT count(*) AS n FROM log",
    "q02_hosts": "SELECT count(*) AS n FROM nodes WHERE label = 'Host'",
    "q03_errors": "SELECT count(*) AS n FROM log WHERE severity = 'ERROR'",
    "q04_sources": "SELECT count(DISTINCT source_type) AS n FROM log",
    "q05_users": "SELECT count(*) AS n FROM nodes WHERE label = 'User'",
    "q06_score_3": "SELECT count(*) AS n FROM log WHERE severity_score <= 3",
    "q07_processes": "SELECT count(*) AS n FROM nodes WHERE label = 'Process'",
    "q08_days": "SELECT count(DISTINCT value) AS n FROM nodes WHERE label = 'Day'",
    "q09_addresses": "SELECT count(*) AS n FROM nodes WHERE label = 'IPAddress'",
    "q10_one_source": "SELECT count(*) AS n FROM log WHERE source_type = 'ESXi'",
    "q11_top_host": _top("hostname", "host", 1),
    "q12_top_5_hosts": _top("hostname", "host", 5),
    "q13_top_source": _top("source_type", "source", 1),
    "q14_per_severity": "SELECT severity, count(*) AS logs FROM log GROUP BY severity",
    "q15_top_process": _top("process", "process", 1),
    "q16_rare_sources": _top("source_type", "source", 3, "ASC"),
    "q17_busiest_day": _top("day", "day", 1),
    "q18_top_components": _top("component", "component", 5),
    "q19_quiet_hosts": _top("hostname", "host", 5, "ASC"),
    "q20_logs_per_host": "SELECT avg(c) AS n FROM (SELECT count(*) AS c FROM log GROUP BY hostname) t",
    "q21_hosts_with_errors": "SELECT DISTINCT hostname AS host FROM log WHERE severity = 'ERROR'",
    "q22_errors_per_host": "SELECT hostname AS host, count(*) AS errors FROM log WHERE severity = 'ERROR' GROUP BY hostname ORDER BY errors DESC, host LIMIT 10",
    "q23_users_of_hosts": "SELECT src AS user_name, count(DISTINCT dst) AS hosts FROM edges WHERE rel = 'ACCESSED' GROUP BY src HAVING count(DISTINCT dst) > 1",
    "q24_processes_on_hosts": "SELECT src AS process, count(DISTINCT dst) AS hosts FROM edges WHERE rel = 'RUNS_ON' GROUP BY src HAVING count(DISTINCT dst) > 2",
    "q25_hosts_of_sources": "SELECT hostname AS host, count(DISTINCT source_type) AS num_sources FROM log GROUP BY hostname HAVING count(DISTINCT source_type) > 3",
    "q26_hosts_per_source": "SELECT source_type AS source, count(DISTINCT hostname) AS hosts FROM log GROUP BY source_type",
    "q27_error_components": "SELECT component, count(*) AS errors FROM log WHERE severity = 'ERROR' GROUP BY component ORDER BY errors DESC, component LIMIT 10",
    "q28_processes_of_source": "SELECT DISTINCT process FROM log WHERE source_type = 'CoreDNS'",
    "q29_error_and_warning": "SELECT hostname AS host FROM log WHERE severity IN ('ERROR', 'WARNING') GROUP BY hostname HAVING count(DISTINCT severity) = 2",
    "q30_processes_per_host": "SELECT hostname AS host, count(DISTINCT process) AS processes FROM log GROUP BY hostname ORDER BY processes DESC, host LIMIT 10",
    "q31_busiest_day_count": _top("day", "day", 1),
    "q32_error_share_of_source": "SELECT source, errors, total, CAST(errors AS DOUBLE) / total AS error_rate FROM (SELECT source_type AS source, count(CASE WHEN severity = 'ERROR' THEN 1 END) AS errors, count(*) AS total FROM log GROUP BY source_type HAVING count(*) >= 10) t ORDER BY error_rate DESC, source LIMIT 5",
    "q33_hosts_on_days": "SELECT hostname AS host, count(DISTINCT day) AS days FROM log GROUP BY hostname HAVING count(DISTINCT day) > 2",
    "q34_by_score": "SELECT severity_score AS score, count(*) AS logs FROM log GROUP BY severity_score",
    "q35_error_share_of_host": "SELECT host, errors, total, CAST(errors AS DOUBLE) / total AS rate FROM (SELECT hostname AS host, count(CASE WHEN severity = 'ERROR' THEN 1 END) AS errors, count(*) AS total FROM log GROUP BY hostname HAVING count(*) >= 10) t ORDER BY rate DESC, host LIMIT 5",
    "q36_logs_with_files": "SELECT count(DISTINCT id) AS n FROM log WHERE EXISTS (SELECT 1 FROM mentions m WHERE m.log_id = log.id AND m.type = 'file')",
    "q37_top_users": "SELECT m.value AS user_name, count(*) AS logs FROM log JOIN mentions m ON m.log_id = log.id WHERE m.type = 'user' GROUP BY m.value ORDER BY logs DESC, user_name LIMIT 5",
    "q38_operations_of_errors": "SELECT count(DISTINCT m.value) AS n FROM log JOIN mentions m ON m.log_id = log.id WHERE m.type = 'operation' AND log.severity = 'ERROR'",
    "q39_span_of_severity": "SELECT severity, min(timestamp) AS earliest, max(timestamp) AS latest FROM log GROUP BY severity",
    "q40_host_process_pairs": "SELECT hostname AS host, process, count(*) AS logs FROM log GROUP BY hostname, process ORDER BY logs DESC, host, process LIMIT 10",
    "q41_users_of_failing_hosts": "SELECT DISTINCT e.src AS user_name, e.dst AS host FROM edges e WHERE e.rel = 'ACCESSED' AND EXISTS (SELECT 1 FROM log WHERE log.hostname = e.dst AND log.severity = 'ERROR') ORDER BY user_name, host LIMIT 25",
    "q42_hosts_sharing_users": "SELECT a.src AS user_name, a.dst AS host1, b.dst AS host2 FROM edges a JOIN edges b ON a.src = b.src AND a.dst < b.dst WHERE a.rel = 'ACCESSED' AND b.rel = 'ACCESSED' ORDER BY user_name, host1, host2 LIMIT 25",
    "q43_score_per_source": "SELECT source_type AS source, avg(severity_score) AS avg_severity FROM log GROUP BY source_type",
    "q44_hosts_sharing_processes": "SELECT a.src AS process, a.dst AS host1, b.dst AS host2 FROM edges a JOIN edges b ON a.src = b.src AND a.dst < b.dst WHERE a.rel = 'RUNS_ON' AND b.rel = 'RUNS_ON' ORDER BY process, host1, host2 LIMIT 25",
    "q45_bad_per_source": "SELECT source_type AS source, severity, count(*) AS logs FROM log WHERE severity IN ('ERROR', 'WARNING') GROUP BY source_type, severity",
    "q46_spread_components": "SELECT component, count(DISTINCT hostname) AS hosts FROM log GROUP BY component ORDER BY hosts DESC, component LIMIT 5",
    "q47_share_of_host": "SELECT host, process, logs, total, CAST(logs AS DOUBLE) / total AS pct FROM (SELECT hostname AS host, process, count(*) AS logs, sum(count(*)) OVER (PARTITION BY hostname) AS total FROM log GROUP BY hostname, process) t ORDER BY logs DESC, host, process LIMIT 5",
    "q48_errors_per_day": "SELECT day, count(*) AS errors FROM log WHERE severity = 'ERROR' GROUP BY day",
    "q49_largest_combination": "SELECT hostname AS host, process, source_type AS source, count(*) AS logs FROM log GROUP BY hostname, process, source_type ORDER BY logs DESC, host, process, source LIMIT 1",
    "q50_bad_rate": "SELECT host, bad, total, CAST(bad AS DOUBLE) / total AS bad_rate FROM (SELECT hostname AS host, count(CASE WHEN severity IN ('ERROR', 'CRITICAL') THEN 1 END) AS bad, count(*) AS total FROM log GROUP BY hostname HAVING count(*) > 100) t ORDER BY bad_rate DESC, host LIMIT 10",
}
