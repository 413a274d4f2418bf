"""The nine tables as data: columns, keys, references, time columns, history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


KINDS = {
    "string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


@dataclass(frozen=True)
class Table:
    """``columns`` lists names and types; ``references`` maps a column to (parent table, parent key)."""

    name: str
    key: str
    columns: str
    references: tuple[tuple[str, str, str], ...] = ()
    event_time: str | None = None

    @property
    def schema(self) -> T.StructType:
        fields = (c.split() for c in self.columns.split(","))
        return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in fields])

    @property
    def is_event(self) -> bool:
        return self.event_time is not None

    @property
    def parents(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(parent for _, parent, _ in self.references))


@dataclass(frozen=True)
class History:
    """A dimension's history: natural key, tracked columns and, if any, the column a version takes effect by."""

    key: str
    tracked: tuple[str, ...]
    effective: str | None = None


TOWER = ("tower_id", "towers", "tower_id")
SUBSCRIBER = ("subscriber_id", "subscribers", "subscriber_id")
DEVICE = ("device_id", "devices", "device_id")
ORIGIN = "batch_id string, source_file string, schema_version string"

# The raw contract.  Nullable are only error_code, drop_reason, failure_reason, resolved_timestamp.
TABLES = {
    t.name: t
    for t in (
        Table(
            "regions", "region_id",
            "region_id string, region_name string, country string, state string, city string, zone string, region_type string, timezone string, is_active boolean",
        ),
        Table(
            "towers", "tower_id",
            "tower_id string, region_id string, tower_name string, city string, latitude double, longitude double, tower_type string, "
            "supported_networks string, capacity_score int, activation_date date, tower_status string",
            (("region_id", "regions", "region_id"),),
        ),
        Table(
            "service_plans", "plan_id",
            "plan_id string, plan_name string, plan_type string, monthly_data_limit_gb int, voice_limit_minutes int, priority_level int, is_5g_enabled boolean, monthly_price int",
        ),
        Table(
            "subscribers", "subscriber_id",
            "subscriber_id string, home_region_id string, plan_id string, activation_date date, subscriber_status string, customer_segment string, age_band string",
            (("home_region_id", "regions", "region_id"), ("plan_id", "service_plans", "plan_id")),
        ),
        Table(
            "devices", "device_id",
            "device_id string, subscriber_id string, manufacturer string, model string, os_type string, supports_5g boolean, release_year int, device_status string",
            (SUBSCRIBER,),
        ),
        Table(
            "network_events", "event_id",
            "event_id string, subscriber_id string, device_id string, tower_id string, event_timestamp timestamp, ingestion_timestamp timestamp, event_type string, "
            f"network_type string, signal_strength_dbm int, latency_ms int, status string, error_code string, {ORIGIN}",
            (TOWER, SUBSCRIBER, DEVICE), "event_timestamp",
        ),
        Table(
            "calls", "call_id",
            "call_id string, subscriber_id string, device_id string, tower_id string, call_start_timestamp timestamp, call_end_timestamp timestamp, duration_seconds int, "
            f"call_type string, network_type string, call_status string, drop_reason string, ingestion_timestamp timestamp, {ORIGIN}",
            (TOWER, SUBSCRIBER, DEVICE), "call_start_timestamp",
        ),
        Table(
            "data_sessions", "session_id",
            "session_id string, subscriber_id string, device_id string, tower_id string, session_start_timestamp timestamp, session_end_timestamp timestamp, duration_seconds int, "
            f"network_type string, bytes_uploaded bigint, bytes_downloaded bigint, latency_ms int, session_status string, failure_reason string, ingestion_timestamp timestamp, {ORIGIN}",
            (TOWER, SUBSCRIBER, DEVICE), "session_start_timestamp",
        ),
        Table(
            "tower_alarms", "alarm_id",
            "alarm_id string, tower_id string, alarm_timestamp timestamp, alarm_type string, severity string, alarm_status string, resolved_timestamp timestamp, "
            f"description string, ingestion_timestamp timestamp, {ORIGIN}",
            (TOWER,), "alarm_timestamp",
        ),
    )
}
DIMENSIONS = tuple(t.name for t in TABLES.values() if not t.is_event)
EVENTS = tuple(t.name for t in TABLES.values() if t.is_event)
INGESTED = "ingestion_timestamp"
BATCH = "_pipeline_batch_id"
OPTIONAL_EVENT_COLUMNS = ("source_system", "producer_schema_version")
LATE_HOURS = 24

HISTORIES = {
    "regions": History("region_id", ("region_name", "country", "state", "city", "zone", "region_type", "timezone", "is_active")),
    "service_plans": History(
        "plan_id", ("plan_name", "plan_type", "monthly_data_limit_gb", "voice_limit_minutes", "priority_level", "is_5g_enabled", "monthly_price")
    ),
    "towers": History(
        "tower_id",
        ("region_id", "tower_name", "city", "latitude", "longitude", "tower_type", "supported_networks", "capacity_score", "activation_date", "tower_status"),
        "activation_date",
    ),
    "subscribers": History(
        "subscriber_id", ("home_region_id", "plan_id", "activation_date", "subscriber_status", "customer_segment", "age_band"), "activation_date"
    ),
    "devices": History("device_id", ("subscriber_id", "manufacturer", "model", "os_type", "supports_5g", "release_year", "device_status")),
}
