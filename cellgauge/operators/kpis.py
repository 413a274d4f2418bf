"""Daily KPIs.  Each base is one grouped pass over an enriched table; KPIs compose bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.measures import count_where, health_score, safe_rate

TOWER_KEYS = ("event_date", "tower_id")
CONTEXT = ("region_id", "region_name", "zone", "tower_type", "capacity_score")
CREATED = "_gold_created_at"


def _network(df: DataFrame, *keys: str) -> DataFrame:
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_network_events"),
        count_where(F.col("status") == "failed").alias("failed_network_events"),
        F.avg("latency_ms").alias("avg_network_latency_ms"),
        F.avg("signal_strength_dbm").alias("avg_signal_strength_dbm"),
    )
    return out.withColumn("network_failure_rate", safe_rate("failed_network_events", "total_network_events"))


def _calls(df: DataFrame, *keys: str) -> DataFrame:
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_calls"),
        count_where(F.col("is_dropped_call")).alias("dropped_calls"),
        count_where(F.col("is_failed_call")).alias("failed_calls"),
        F.avg("duration_seconds").alias("avg_call_duration_seconds"),
    )
    return out.withColumns(
        {"dropped_call_rate": safe_rate("dropped_calls", "total_calls"), "failed_call_rate": safe_rate("failed_calls", "total_calls")}
    )


def _sessions(df: DataFrame, *keys: str) -> DataFrame:
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_data_sessions"),
        count_where(F.col("is_failed_session")).alias("failed_data_sessions"),
        F.avg("latency_ms").alias("avg_session_latency_ms"),
        F.sum("total_mb").alias("total_data_mb"),
    )
    return out.withColumn("failed_session_rate", safe_rate("failed_data_sessions", "total_data_sessions"))


def network_tower_daily(events: DataFrame) -> DataFrame:
    return _network(events, *TOWER_KEYS, *CONTEXT)


def calls_tower_daily(calls: DataFrame) -> DataFrame:
    return _calls(calls, *TOWER_KEYS)


def sessions_tower_daily(sessions: DataFrame) -> DataFrame:
    return _sessions(sessions, *TOWER_KEYS)


def alarms_tower_daily(alarms: DataFrame) -> DataFrame:
    return alarms.groupBy(*TOWER_KEYS).agg(
        F.count(F.lit(1)).alias("total_alarms"), count_where(F.col("is_critical_alarm")).alias("critical_alarms")
    )


TOWER_FILLED = (
    "total_calls dropped_calls failed_calls dropped_call_rate failed_call_rate total_data_sessions failed_data_sessions "
    "total_data_mb failed_session_rate total_alarms critical_alarms"
).split()


def tower_daily(tables: dict[str, DataFrame]) -> DataFrame:
    """Towers with network events on a day; what else happened there joins from the left."""
    merged = network_tower_daily(tables["network_events_enriched"])
    for base in (
        calls_tower_daily(tables["calls_enriched"]),
        sessions_tower_daily(tables["data_sessions_enriched"]),
        alarms_tower_daily(tables["tower_alarms_enriched"]),
    ):
        merged = merged.join(base, list(TOWER_KEYS), "left")
    return merged.fillna(0, subset=TOWER_FILLED).withColumns({"tower_health_score": health_score(), CREATED: F.current_timestamp()})


def region_daily(towers: DataFrame) -> DataFrame:
    """The roll-up of tower_daily."""
    total = lambda c: F.sum(c).alias(c)
    out = towers.groupBy("event_date", "region_id", "region_name", "zone").agg(
        F.count_distinct("tower_id").alias("active_towers"),
        *map(total, ("total_network_events", "failed_network_events", "total_calls", "dropped_calls", "total_data_sessions", "failed_data_sessions")),
        F.round(F.sum("total_data_mb"), 3).alias("total_data_mb"),
        total("critical_alarms"),
        F.round(F.avg("tower_health_score"), 3).alias("avg_tower_health_score"),
    )
    return out.withColumns(
        {
            "network_failure_rate": safe_rate("failed_network_events", "total_network_events"),
            "dropped_call_rate": safe_rate("dropped_calls", "total_calls"),
            "failed_session_rate": safe_rate("failed_data_sessions", "total_data_sessions"),
            CREATED: F.current_timestamp(),
        }
    )


def _both(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of either side; a NULL key matches nothing, and what one side lacks is 0."""
    return left.join(right, keys, "full").fillna(0).withColumns({"total_data_mb": F.round("total_data_mb", 3), CREATED: F.current_timestamp()})


def network_type_daily(tables: dict[str, DataFrame]) -> DataFrame:
    keys = ["event_date", "network_type"]
    return _both(_network(tables["network_events_enriched"], *keys), _sessions(tables["data_sessions_enriched"], *keys), keys)


def segment_daily(tables: dict[str, DataFrame]) -> DataFrame:
    keys = ["event_date", "customer_segment", "plan_type"]
    calls = _calls(tables["calls_enriched"], *keys).drop("avg_call_duration_seconds")
    return _both(calls, _sessions(tables["data_sessions_enriched"], *keys).drop("avg_session_latency_ms"), keys)


KPIS = ("tower_daily_kpis", "region_daily_kpis", "network_type_daily_kpis", "subscriber_segment_daily_kpis")


def build_kpis(tables: dict[str, DataFrame], names: list[str] | None = None, persist_towers: bool = False) -> dict[str, DataFrame]:
    """The selected KPI tables; tower and region share one tower_daily."""
    names = list(KPIS) if names is None else names
    if unknown := [n for n in names if n not in KPIS]:
        raise ValueError(f"unknown KPI tables: {', '.join(unknown)}")
    out: dict[str, DataFrame] = {}
    if {"tower_daily_kpis", "region_daily_kpis"} & set(names):
        towers = tower_daily(tables)
        towers = towers.persist() if persist_towers else towers
        out |= {"tower_daily_kpis": towers, "region_daily_kpis": region_daily(towers)}
    if "network_type_daily_kpis" in names:
        out["network_type_daily_kpis"] = network_type_daily(tables)
    if "subscriber_segment_daily_kpis" in names:
        out["subscriber_segment_daily_kpis"] = segment_daily(tables)
    return {n: out[n] for n in KPIS if n in names}


def affected_dates(tables: list[DataFrame]) -> DataFrame:
    """Distinct event dates of several enriched tables."""
    out = tables[0].select("event_date")
    for t in tables[1:]:
        out = out.unionByName(t.select("event_date"))
    return out.distinct()
