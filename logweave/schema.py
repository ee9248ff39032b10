"""The event schema: names, types, requirements, and the names of fields in other schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The severity ladder, 1 the worst.
SEVERITY_SCORES = {"EMERGENCY": 1, "FATAL": 1, "ALERT": 1, "CRITICAL": 2, "ERROR": 3, "WARNING": 4, "NOTICE": 5, "INFO": 6, "DEBUG": 7}
#: Alert bands by severity score.
BANDS = {"critical": (1, 2), "error": (3, 3), "warning": (4, 4)}
ALERT_MAX, ERROR_MAX, BAND_MAX = 2, 3, 4
GENESIS = "0" * 64


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = False
    ecs: str | None = None


#: Fields of a stored event, in order.
FIELDS = (
    Field("id", "string", True, "event.id"), Field("timestamp", "string", True, "@timestamp"), Field("day", "string", True), Field("timestamp_source", "string", True, "labels.timestamp_source"),
    Field("timestamp_anomalous", "boolean", False, "labels.timestamp_anomalous"), Field("hostname", "string", True, "host.name"), Field("process", "string", True, "process.name"), Field("pid", "int", False, "process.pid"),
    Field("component", "string", True, "labels.component"), Field("subcomponent", "string", False, "labels.subcomponent"), Field("source_type", "string", True, "event.dataset"), Field("severity", "string", True, "log.level"),
    Field("severity_score", "int", True, "event.severity"), Field("message", "string", True, "message"), Field("normalized_message", "string", True), Field("attributes", "map<string,string>", True),
    Field("http_method", "string", False, "http.request.method"), Field("http_status", "int", False, "http.response.status_code"), Field("raw_hash", "string", True, "event.hash"), Field("raw_message", "string", True, "event.original"),
    Field("raw_truncated", "boolean", False, "labels.raw_truncated"), Field("raw_length", "int", False, "labels.raw_length"), Field("source_file", "string", False, "log.file.path"), Field("source_record", "bigint", False, "log.offset"),
    Field("matched_format", "string", True, "event.module"), Field("confidence", "double", True, "labels.confidence"), Field("created_at", "timestamp", True, "event.ingested"), Field("embedding", "array<float>", False),
)


def band(score: Column) -> Column:
    """the alert band of a score, null above them."""
    return F.when(score <= ALERT_MAX, "critical").when(score == ERROR_MAX, "error").when(score == BAND_MAX, "warning")


def is_error(score: Column | None = None) -> Column:
    return (F.col("severity_score") if score is None else score) <= ERROR_MAX


def is_alert(score: Column | None = None) -> Column:
    return (F.col("severity_score") if score is None else score) <= ALERT_MAX
