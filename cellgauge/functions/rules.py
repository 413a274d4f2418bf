"""Quality rules as values: each has a reason code and says when a row is rejected.

A predicate that is NULL does not reject (three-valued logic), so an empty enum passes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

COUNT, FOUND = "_count_", "_ref_"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a SQL predicate; a table's rules become one expression, parsed once."""

    reason: str
    rejects: str


def literals(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def is_blank(name: str) -> str:
    return f"({name} IS NULL OR trim({name}) = '')"


def required(*names: str) -> list[Rule]:
    return [Rule(f"{n}_missing", is_blank(n)) for n in names]


def present(*names: str) -> list[Rule]:
    """For columns that are not text: NULL is missing."""
    return [Rule(f"{n}_missing", f"{n} IS NULL") for n in names]


def unique(name: str) -> list[Rule]:
    return [Rule(f"{name}_duplicate", f"{COUNT}{name} > 1")]


def known(*names: str) -> list[Rule]:
    """A value that is there but not among the parent's keys."""
    return [Rule(f"{n}_unknown", f"{n} IS NOT NULL AND {FOUND}{n} IS NULL") for n in names]


def one_of(name: str, allowed: tuple[str, ...]) -> list[Rule]:
    return [Rule(f"{name}_unsupported", f"{name} NOT IN ({literals(allowed)})")]


def members_of(name: str, allowed: tuple[str, ...], separator: str = "[|]") -> list[Rule]:
    """Every part of a delimited list is allowed."""
    return [Rule(f"{name}_invalid", f"size(array_except(split({name}, '{separator}'), array({literals(allowed)}))) > 0")]


def at_least(name: str, least: float, reason: str | None = None) -> list[Rule]:
    return [Rule(reason or f"{name}_negative", f"{name} < {least}")]


def at_most(name: str, most: float, reason: str) -> list[Rule]:
    return [Rule(reason, f"{name} > {most}")]


def between(name: str, least: float, most: float) -> list[Rule]:
    return [Rule(f"{name}_invalid", f"{name} < {least} OR {name} > {most}")]


def not_before(later: str, earlier: str, reason: str) -> list[Rule]:
    return [Rule(reason, f"{later} < {earlier}")]


def required_unless(name: str, status: str, value: str) -> list[Rule]:
    return [Rule(f"{name}_missing", f"{status} <> '{value}' AND {is_blank(name)}")]


def present_if(name: str, status: str, value: str) -> list[Rule]:
    return [Rule(f"{name}_missing", f"{status} = '{value}' AND {name} IS NULL")]


def reasons(rules: tuple[Rule, ...]) -> Column:
    """The reasons that apply, in the order of the rules."""
    return F.expr("array_compact(array(" + ", ".join(f"CASE WHEN {r.rejects} THEN '{r.reason}' END" for r in rules) + "))")


# Enumerations and bounds.
NETWORKS = ("4G", "5G", "LTE")
REGION_TYPES = ("metro", "urban", "coastal")
TOWER_TYPES = ("urban", "rural", "stadium", "airport", "business_district")
TOWER_STATUSES = ("active", "maintenance", "retired")
PLAN_TYPES = ("prepaid", "postpaid", "enterprise", "iot")
SUBSCRIBER_STATUSES = ("active", "suspended", "churned")
OS_TYPES = ("Android", "iOS")
DEVICE_STATUSES = ("active", "inactive")
NETWORK_EVENT_TYPES = ("connection_attempt", "handover", "signal_sample", "network_failure", "retry")
EVENT_STATUSES = ("success", "failed")
CALL_TYPES = ("voice", "volte", "wifi_call")
CALL_STATUSES = ("completed", "dropped", "failed")
SESSION_STATUSES = ("completed", "failed", "timeout")
ALARM_TYPES = ("POWER_FAILURE", "BACKHAUL_DOWN", "HIGH_TEMPERATURE", "EQUIPMENT_FAULT", "CONGESTION_ALERT")
SEVERITIES = ("info", "warning", "major", "critical")
ALARM_STATUSES = ("open", "resolved")
SIGNAL_DBM = (-130, -40)

RULES: dict[str, tuple[Rule, ...]] = {
    "regions": (
        *required("region_id"), *unique("region_id"), *required("region_name", "country", "state", "city", "timezone"),
        *one_of("region_type", REGION_TYPES), *present("is_active"),
    ),
    "service_plans": (
        *required("plan_id"), *unique("plan_id"), *required("plan_name"), *one_of("plan_type", PLAN_TYPES),
        *at_least("monthly_data_limit_gb", 0, "monthly_data_limit_negative"), *at_least("voice_limit_minutes", 0, "voice_limit_negative"),
        *between("priority_level", 1, 5), *present("is_5g_enabled"), *at_least("monthly_price", 0),
    ),
    "towers": (
        *required("tower_id"), *unique("tower_id"), *required("region_id"), *known("region_id"), *required("tower_name"),
        *between("latitude", -90, 90), *between("longitude", -180, 180), *one_of("tower_type", TOWER_TYPES),
        *required("supported_networks"), *members_of("supported_networks", NETWORKS), *between("capacity_score", 0, 100),
        *present("activation_date"), *one_of("tower_status", TOWER_STATUSES),
    ),
    "subscribers": (
        *required("subscriber_id"), *unique("subscriber_id"), *required("home_region_id"), *known("home_region_id"), *required("plan_id"), *known("plan_id"),
        *present("activation_date"), *one_of("subscriber_status", SUBSCRIBER_STATUSES), *required("customer_segment", "age_band"),
    ),
    "devices": (
        *required("device_id"), *unique("device_id"), *required("subscriber_id"), *known("subscriber_id"), *required("manufacturer", "model"),
        *one_of("os_type", OS_TYPES), *present("supports_5g"), *between("release_year", 2007, 2026), *one_of("device_status", DEVICE_STATUSES),
    ),
    "network_events": (
        *required("event_id", "subscriber_id", "device_id", "tower_id"), *present("event_timestamp", "ingestion_timestamp"),
        *one_of("network_type", NETWORKS), *one_of("event_type", NETWORK_EVENT_TYPES), *one_of("status", EVENT_STATUSES),
        *at_least("signal_strength_dbm", SIGNAL_DBM[0], "signal_strength_too_low"), *at_most("signal_strength_dbm", SIGNAL_DBM[1], "signal_strength_too_high"),
        *at_least("latency_ms", 0, "latency_negative"), *not_before("ingestion_timestamp", "event_timestamp", "ingestion_before_event"),
        *known("tower_id", "subscriber_id", "device_id"),
    ),
    "calls": (
        *required("call_id", "subscriber_id", "device_id", "tower_id"), *present("call_start_timestamp", "call_end_timestamp"),
        *at_least("duration_seconds", 0, "duration_negative"), *not_before("call_end_timestamp", "call_start_timestamp", "call_end_before_start"),
        *one_of("call_type", CALL_TYPES), *one_of("network_type", NETWORKS), *one_of("call_status", CALL_STATUSES),
        *required_unless("drop_reason", "call_status", "completed"), *known("tower_id", "subscriber_id", "device_id"),
    ),
    "data_sessions": (
        *required("session_id", "subscriber_id", "device_id", "tower_id"), *present("session_start_timestamp", "session_end_timestamp"),
        *at_least("duration_seconds", 0, "duration_negative"), *not_before("session_end_timestamp", "session_start_timestamp", "session_end_before_start"),
        *one_of("network_type", NETWORKS), *at_least("bytes_uploaded", 0), *at_least("bytes_downloaded", 0), *at_least("latency_ms", 0, "latency_negative"),
        *one_of("session_status", SESSION_STATUSES), *required_unless("failure_reason", "session_status", "completed"), *known("tower_id", "subscriber_id", "device_id"),
    ),
    "tower_alarms": (
        *required("alarm_id", "tower_id"), *known("tower_id"), *present("alarm_timestamp"), *one_of("alarm_type", ALARM_TYPES), *one_of("severity", SEVERITIES),
        *one_of("alarm_status", ALARM_STATUSES), *present_if("resolved_timestamp", "alarm_status", "resolved"),
        *not_before("resolved_timestamp", "alarm_timestamp", "resolved_before_alarm"), *required("description"),
    ),
}
