"""Standing questions over the KPI tables, as data: what to show, of which rows, in which order.

Every order ends with the keys of the table, so that a limited answer is one answer.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Question:
    table: str
    show: str
    where: str | None = None
    group: str | None = None
    measures: dict[str, str] = field(default_factory=dict)
    order: str = ""
    limit: int | None = None
    least: int | None = None  # rows must have so much of what the predicate counts

    def answer(self, tables: dict[str, DataFrame], least: int | None = None) -> DataFrame:
        df = tables[self.table]
        if self.where:
            df = df.where(self.where.format(least=self.least if least is None else least))
        if self.measures:
            df = df.groupBy(*(self.group.split() if self.group else [])).agg(*[F.expr(e).alias(n) for n, e in self.measures.items()])
        if self.order:
            df = df.orderBy(*[F.col(c[1:]).desc() if c[0] == "-" else F.col(c).asc() for c in self.order.split()])
        if self.limit:
            df = df.limit(self.limit)
        return df.selectExpr(*[c.strip() for c in self.show.split(";")]) if self.show else df


def mean(*names: str, **renamed: str) -> dict[str, str]:
    return {new: f"round(avg({old}), 3)" for new, old in ({f"avg_{n}": n for n in names} | renamed).items()}


def total(*names: str, places: int | None = None) -> dict[str, str]:
    return {n: f"round(sum({n}), {places})" if places else f"CAST(sum({n}) AS BIGINT)" for n in names}


def distinct(**of: str) -> dict[str, str]:
    return {n: f"count(DISTINCT {c})" for n, c in of.items()}


TOWERS, REGIONS, NETWORKS, SEGMENTS = "tower_daily_kpis", "region_daily_kpis", "network_type_daily_kpis", "subscriber_segment_daily_kpis"
TOWER_KEYS = "event_date tower_id region_id"
RATES = ("network_failure_rate", "dropped_call_rate", "failed_session_rate")

QUESTIONS = {
    "q01_lowest_health": Question(
        TOWERS, "event_date; tower_id; region_name; tower_type; total_network_events; network_failure_rate; dropped_call_rate; failed_session_rate; critical_alarms; tower_health_score",
        order=f"tower_health_score {TOWER_KEYS}", limit=10),
    "q02_network_failures": Question(
        TOWERS, "event_date; tower_id; region_name; tower_type; total_network_events; failed_network_events; network_failure_rate; tower_health_score",
        "total_network_events >= {least}", order=f"-network_failure_rate {TOWER_KEYS}", limit=10, least=50),
    "q03_dropped_calls": Question(
        TOWERS, "event_date; tower_id; region_name; total_calls; dropped_calls; dropped_call_rate; tower_health_score",
        "total_calls >= {least}", order=f"-dropped_call_rate {TOWER_KEYS}", limit=10, least=10),
    "q04_busy_and_weak": Question(
        TOWERS, "event_date; tower_id; region_name; tower_type; total_network_events; total_data_mb; tower_health_score",
        "total_network_events >= {least}", order=f"tower_health_score -total_network_events {TOWER_KEYS}", limit=10, least=80),
    "q05_tower_types": Question(
        TOWERS, "", group="tower_type", order="avg_health_score tower_type",
        measures=distinct(towers="tower_id") | mean(avg_health_score="tower_health_score") | mean(*RATES)),
    "q06_worst_regions": Question(
        REGIONS, "event_date; region_id; region_name; zone; active_towers; avg_tower_health_score; network_failure_rate; dropped_call_rate; failed_session_rate; critical_alarms",
        order="avg_tower_health_score event_date region_id", limit=10),
    "q07_region_dropped_calls": Question(
        REGIONS, "event_date; region_name; total_calls; dropped_calls; dropped_call_rate; avg_tower_health_score",
        "total_calls >= {least}", order="-dropped_call_rate event_date region_id", limit=10, least=50),
    "q08_zones": Question(
        REGIONS, "", group="zone", order="avg_health_score zone",
        measures=distinct(regions="region_id") | mean(avg_health_score="avg_tower_health_score") | mean(*RATES) | total("critical_alarms")),
    "q09_network_types": Question(
        NETWORKS, "", group="network_type", order="-avg_network_failure_rate network_type",
        measures=total("total_network_events", "failed_network_events") | mean("network_failure_rate")
        | mean(avg_network_latency_ms="avg_network_latency_ms", avg_signal_strength_dbm="avg_signal_strength_dbm") | total("total_data_mb", places=3)),
    "q10_failed_sessions_by_day": Question(
        NETWORKS, "event_date; network_type; total_data_sessions; failed_data_sessions; failed_session_rate; round(avg_session_latency_ms, 3) AS avg_session_latency_ms; total_data_mb",
        order="-failed_session_rate event_date network_type", limit=10),
    "q11_segment_dropped_calls": Question(
        SEGMENTS, "event_date; customer_segment; plan_type; total_calls; dropped_calls; dropped_call_rate; failed_call_rate",
        "total_calls >= {least}", order="-dropped_call_rate event_date customer_segment plan_type", limit=10, least=20),
    "q12_data_by_segment": Question(
        SEGMENTS, "", group="customer_segment plan_type", order="-total_data_mb customer_segment plan_type", limit=10,
        measures=total("total_data_sessions") | total("total_data_mb", places=3) | mean("failed_session_rate")),
    "q13_enterprise": Question(
        SEGMENTS, "event_date; customer_segment; plan_type; total_calls; dropped_call_rate; failed_call_rate; total_data_sessions; failed_session_rate; total_data_mb",
        "customer_segment = 'enterprise' OR plan_type = 'enterprise'", order="event_date customer_segment plan_type"),
    "q14_summary": Question(
        TOWERS, "",
        measures=distinct(towers="tower_id", regions="region_id") | total("total_network_events", "failed_network_events") | mean("network_failure_rate")
        | total("total_calls", "dropped_calls") | mean("dropped_call_rate") | total("total_data_sessions", "failed_data_sessions") | mean("failed_session_rate")
        | total("total_data_mb", places=3) | total("critical_alarms") | mean("tower_health_score")),
    "q_bronze_event_type_counts": Question("bronze_network_events", "", group="event_type", measures={"records": "count(*)"}, order="-records event_type"),
    "q_bronze_network_type_counts": Question("bronze_network_events", "", group="network_type", measures={"records": "count(*)"}, order="-records network_type"),
    "q_bronze_time_range": Question(
        "bronze_network_events", "",
        measures={f"{f}_{c}": f"{f}({c})" for f in ("min", "max") for c in ("event_timestamp", "ingestion_timestamp")}),
    "q_silver_network_events": Question(
        "network_events_enriched", "event_id; event_date; event_hour; tower_id; region_name; tower_type; subscriber_id; customer_segment; plan_type; manufacturer; network_type; status",
        order="event_id", limit=10),
    "q_silver_calls_by_region_plan": Question(
        "calls_enriched", "", group="region_name plan_type", order="-calls region_name plan_type", limit=15,
        measures={"calls": "count(*)", "dropped_calls": "CAST(sum(CASE WHEN is_dropped_call THEN 1 ELSE 0 END) AS BIGINT)",
                  "failed_calls": "CAST(sum(CASE WHEN is_failed_call THEN 1 ELSE 0 END) AS BIGINT)"}),
    "q_silver_top_data_sessions": Question(
        "data_sessions_enriched", "session_id; event_date; tower_id; region_name; network_type; customer_segment; plan_type; total_mb; latency_ms; session_status",
        order="-total_mb session_id", limit=10),
    "q_silver_critical_alarms": Question(
        "tower_alarms_enriched", "alarm_id; event_date; tower_id; region_name; tower_type; alarm_type; severity; alarm_status; is_critical_alarm",
        "is_critical_alarm", order="alarm_id", limit=20),
    "q_quarantined_events": Question(
        "network_events_quarantine", "event_id; subscriber_id; device_id; tower_id; network_type; status; reasons", order="event_id reasons network_type status subscriber_id", limit=20),
}


def investigate_first(tables: dict[str, DataFrame], limit: int = 15) -> DataFrame:
    """Towers and regions by their mean score, worst first."""
    def risk(kind: str, table: str, key: str, score: str) -> DataFrame:
        out = tables[table].groupBy(F.col(key).alias("dimension_value")).agg(F.round(F.avg(score), 3).alias("score"))
        return out.select(F.lit(kind).alias("dimension_type"), "dimension_value", "score")

    both = risk("tower", TOWERS, "tower_id", "tower_health_score").unionByName(risk("region", REGIONS, "region_name", "avg_tower_health_score"))
    return both.orderBy("score", "dimension_type", "dimension_value").limit(limit)


INVESTIGATE_SQL = f"""
    SELECT * FROM (SELECT 'tower' AS dimension_type, tower_id AS dimension_value, round(avg(tower_health_score), 3) AS score FROM {TOWERS} GROUP BY tower_id
    UNION ALL SELECT 'region', region_name, round(avg(avg_tower_health_score), 3) FROM {REGIONS} GROUP BY region_name) u
    ORDER BY score, dimension_type, dimension_value LIMIT 15"""
