"""Star enrichment of events.  Contexts are built once and joined from the left, so no event is lost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import DIMENSIONS, EVENTS, TABLES
from ..functions.measures import megabytes
from .history import current_rows

# The columns that each event table takes from its contexts.
TOWER_COLUMNS = {
    "network_events": "region_id region_name state region_city zone region_type tower_name tower_city latitude longitude tower_type capacity_score tower_status",
    "calls": "region_id region_name state region_city zone region_type tower_name tower_type capacity_score",
    "data_sessions": "region_id region_name state region_city zone region_type tower_name tower_type capacity_score",
    "tower_alarms": "region_id region_name state region_city zone region_type tower_name tower_type capacity_score tower_status",
}
SUBSCRIBER_COLUMNS = {
    "network_events": "home_region_id plan_id subscriber_status customer_segment age_band manufacturer model os_type supports_5g release_year device_status "
    "plan_name plan_type monthly_data_limit_gb priority_level plan_is_5g_enabled",
    "calls": "home_region_id plan_id subscriber_status customer_segment manufacturer model os_type supports_5g plan_name plan_type priority_level",
    "data_sessions": "home_region_id plan_id subscriber_status customer_segment manufacturer model os_type supports_5g plan_name plan_type priority_level",
}


def tower_context(towers: DataFrame, regions: DataFrame) -> DataFrame:
    region = regions.select(
        F.col("region_id").alias("_region"), "region_name", "state", F.col("city").alias("region_city"), "zone", "region_type"
    )
    tower = towers.withColumnRenamed("city", "tower_city")
    return tower.join(region, tower["region_id"] == region["_region"], "left").select(
        *"tower_id region_id region_name state region_city zone region_type tower_name tower_city latitude longitude".split(),
        *"tower_type supported_networks capacity_score tower_status".split(),
    )


def subscriber_context(subscribers: DataFrame, devices: DataFrame, plans: DataFrame) -> DataFrame:
    """One row per device, with its subscriber and that one's plan."""
    subscriber = subscribers.select(
        "subscriber_id", "home_region_id", "plan_id", "subscriber_status", "customer_segment", "age_band"
    )
    device = devices.select(
        F.col("subscriber_id").alias("_owner"), "device_id", "manufacturer", "model", "os_type", "supports_5g", "release_year", "device_status"
    )
    plan = plans.select(
        F.col("plan_id").alias("_plan"), "plan_name", "plan_type", "monthly_data_limit_gb", "voice_limit_minutes", "priority_level",
        F.col("is_5g_enabled").alias("plan_is_5g_enabled"), "monthly_price",
    )
    both = device.join(subscriber, device["_owner"] == subscriber["subscriber_id"], "left")
    return both.join(plan, both["plan_id"] == plan["_plan"], "left").select(
        *"device_id subscriber_id home_region_id plan_id subscriber_status customer_segment age_band".split(),
        *"manufacturer model os_type supports_5g release_year device_status".split(),
        *"plan_name plan_type monthly_data_limit_gb voice_limit_minutes priority_level plan_is_5g_enabled monthly_price".split(),
    )


def date_parts(df: DataFrame, time: str) -> DataFrame:
    return df.withColumns({"event_date": F.to_date(time), "event_hour": F.hour(time), "event_day_of_week": F.date_format(time, "E")})


def derived(table: str) -> dict[str, Column]:
    size = F.col("bytes_uploaded") + F.col("bytes_downloaded")
    return {
        "network_events": {},
        "calls": {"is_dropped_call": F.col("call_status") == "dropped", "is_failed_call": F.col("call_status") == "failed"},
        "data_sessions": {"total_bytes": size, "total_mb": megabytes(size), "is_failed_session": F.col("session_status") != "completed"},
        "tower_alarms": {"is_critical_alarm": F.col("severity") == "critical"},
    }[table]


def enrich(events: DataFrame, table: str, towers: DataFrame, subscribers: DataFrame | None = None) -> DataFrame:
    """Events with their tower's context, their device's (if the table has one), date parts and derived columns."""
    tower = towers.select(F.col("tower_id").alias("_tower"), *TOWER_COLUMNS[table].split())
    out = events.join(tower, events["tower_id"] == tower["_tower"], "left").drop("_tower")
    if table in SUBSCRIBER_COLUMNS:
        who = subscribers.select(
            F.col("subscriber_id").alias("_subscriber"), F.col("device_id").alias("_device"), *SUBSCRIBER_COLUMNS[table].split()
        )
        same = (out["subscriber_id"] == who["_subscriber"]) & (out["device_id"] == who["_device"])
        out = out.join(who, same, "left").drop("_subscriber", "_device")
    out = date_parts(out, TABLES[table].event_time)
    return out.withColumns(derived(table) | {"_silver_enriched_at": F.current_timestamp()})


@dataclass(frozen=True)
class Star:
    """The contexts of a set of dimensions, current versions only."""

    towers: DataFrame
    subscribers: DataFrame

    @classmethod
    def of(cls, dimensions: dict[str, DataFrame]) -> "Star":
        now = {name: current_rows(dimensions[name]) for name in DIMENSIONS}
        return cls(tower_context(now["towers"], now["regions"]), subscriber_context(now["subscribers"], now["devices"], now["service_plans"]))

    def enrich(self, events: DataFrame, table: str) -> DataFrame:
        return enrich(events, table, self.towers, self.subscribers)


def enrich_all(dimensions: dict[str, DataFrame], events: dict[str, DataFrame], names: list[str] | None = None) -> dict[str, DataFrame]:
    """<table>_enriched for the selected event tables."""
    star = Star.of(dimensions)
    return {f"{t}_enriched": star.enrich(events[t], t) for t in EVENTS if t in events and (names is None or f"{t}_enriched" in names)}
