"""The same results in SQL for DuckDB, as common table expressions that build on each other.

r_<table>: as delivered; q_<table>: with reasons; v_<table>: valid rows; c_<table>: controlled
events; ctx_*: contexts; e_<table>: enriched; then the KPI tables by name.
"""

from __future__ import annotations

import re

from . import testbed
from .catalog import EVENTS, TABLES
from .oracle_questions import QUESTION_SQL
from .questions import INVESTIGATE_SQL


def blank(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) = '')"


def missing(*columns: str) -> list[tuple[str, str]]:
    return [(f"{c}_missing", blank(c)) for c in columns]


def null(*columns: str) -> list[tuple[str, str]]:
    return [(f"{c}_missing", f"{c} IS NULL") for c in columns]


def enum(c: str, values: str) -> list[tuple[str, str]]:
    return [(f"{c}_unsupported", f"{c} NOT IN ({', '.join(repr(v) for v in values.split())})")]


def unknown(*columns: str) -> list[tuple[str, str]]:
    out = []
    for c in columns:
        parent, key = {"home_region_id": ("regions", "region_id"), "region_id": ("regions", "region_id"), "plan_id": ("service_plans", "plan_id")}.get(
            c, (c.removesuffix("_id") + "s", c)
        )
        out.append((f"{c}_unknown", f"{c} IS NOT NULL AND {c} NOT IN (SELECT {key} FROM v_{parent} WHERE {key} IS NOT NULL)"))
    return out


def duplicate(c: str) -> list[tuple[str, str]]:
    return [(f"{c}_duplicate", f"{c} IS NOT NULL AND n_key > 1")]


NET = "4G 5G LTE"
# All rejection rules, in order.
REASONS = {
    "regions": missing("region_id") + duplicate("region_id") + missing("region_name", "country", "state", "city", "timezone")
    + enum("region_type", "metro urban coastal") + null("is_active"),
    "service_plans": missing("plan_id") + duplicate("plan_id") + missing("plan_name") + enum("plan_type", "prepaid postpaid enterprise iot")
    + [("monthly_data_limit_negative", "monthly_data_limit_gb < 0"), ("voice_limit_negative", "voice_limit_minutes < 0"),
       ("priority_level_invalid", "priority_level < 1 OR priority_level > 5")] + null("is_5g_enabled") + [("monthly_price_negative", "monthly_price < 0")],
    "towers": missing("tower_id") + duplicate("tower_id") + missing("region_id") + unknown("region_id") + missing("tower_name")
    + [("latitude_invalid", "latitude < -90 OR latitude > 90"), ("longitude_invalid", "longitude < -180 OR longitude > 180")]
    + enum("tower_type", "urban rural stadium airport business_district") + missing("supported_networks")
    + [("supported_networks_invalid", "len(list_filter(string_split(supported_networks, '|'), lambda x: x NOT IN ('4G', '5G', 'LTE'))) > 0"),
       ("capacity_score_invalid", "capacity_score < 0 OR capacity_score > 100")] + null("activation_date") + enum("tower_status", "active maintenance retired"),
    "subscribers": missing("subscriber_id") + duplicate("subscriber_id") + missing("home_region_id") + unknown("home_region_id") + missing("plan_id") + unknown("plan_id")
    + null("activation_date") + enum("subscriber_status", "active suspended churned") + missing("customer_segment", "age_band"),
    "devices": missing("device_id") + duplicate("device_id") + missing("subscriber_id") + unknown("subscriber_id") + missing("manufacturer", "model")
    + enum("os_type", "Android iOS") + null("supports_5g") + [("release_year_invalid", "release_year < 2007 OR release_year > 2026")] + enum("device_status", "active inactive"),
    "network_events": missing("event_id", "subscriber_id", "device_id", "tower_id") + null("event_timestamp", "ingestion_timestamp") + enum("network_type", NET)
    + enum("event_type", "connection_attempt handover signal_sample network_failure retry") + enum("status", "success failed")
    + [("signal_strength_too_low", "signal_strength_dbm < -130"), ("signal_strength_too_high", "signal_strength_dbm > -40"), ("latency_negative", "latency_ms < 0"),
       ("ingestion_before_event", "ingestion_timestamp < event_timestamp")] + unknown("tower_id", "subscriber_id", "device_id"),
    "calls": missing("call_id", "subscriber_id", "device_id", "tower_id") + null("call_start_timestamp", "call_end_timestamp")
    + [("duration_negative", "duration_seconds < 0"), ("call_end_before_start", "call_end_timestamp < call_start_timestamp")]
    + enum("call_type", "voice volte wifi_call") + enum("network_type", NET) + enum("call_status", "completed dropped failed")
    + [("drop_reason_missing", f"call_status <> 'completed' AND {blank('drop_reason')}")] + unknown("tower_id", "subscriber_id", "device_id"),
    "data_sessions": missing("session_id", "subscriber_id", "device_id", "tower_id") + null("session_start_timestamp", "session_end_timestamp")
    + [("duration_negative", "duration_seconds < 0"), ("session_end_before_start", "session_end_timestamp < session_start_timestamp")] + enum("network_type", NET)
    + [("bytes_uploaded_negative", "bytes_uploaded < 0"), ("bytes_downloaded_negative", "bytes_downloaded < 0"), ("latency_negative", "latency_ms < 0")]
    + enum("session_status", "completed failed timeout") + [("failure_reason_missing", f"session_status <> 'completed' AND {blank('failure_reason')}")]
    + unknown("tower_id", "subscriber_id", "device_id"),
    "tower_alarms": missing("alarm_id", "tower_id") + unknown("tower_id") + null("alarm_timestamp")
    + enum("alarm_type", "POWER_FAILURE BACKHAUL_DOWN HIGH_TEMPERATURE EQUIPMENT_FAULT CONGESTION_ALERT") + enum("severity", "info warning major critical")
    + enum("alarm_status", "open resolved") + [("resolved_timestamp_missing", "alarm_status = 'resolved' AND resolved_timestamp IS NULL"),
       ("resolved_before_alarm", "resolved_timestamp < alarm_timestamp")] + missing("description"),
}

CTES: dict[str, str] = {}
for name, spec in TABLES.items():
    CTES[f"r_{name}"] = testbed.duckdb(name)
    cases = ", ".join(f"CASE WHEN {p} THEN '{r}' END" for r, p in REASONS[name])
    CTES[f"q_{name}"] = (
        f"SELECT *, array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',') AS reasons "
        f"FROM (SELECT *, count(*) OVER (PARTITION BY {spec.key}) AS n_key FROM r_{name}) t"
    )
    CTES[f"v_{name}"] = f"SELECT * EXCLUDE (n_key, reasons) FROM q_{name} WHERE reasons = ''"
for name in EVENTS:
    spec = TABLES[name]
    ties = ", ".join(f"{c} ASC NULLS FIRST" for c in sorted(f.name for f in spec.schema.fields))
    delay = f"round(date_diff('second', {spec.event_time}, ingestion_timestamp) / 3600.0, 3)"
    CTES[f"c_{name}"] = (
        f"SELECT * EXCLUDE (rk), CAST(NULL AS VARCHAR) AS source_system, CAST(NULL AS VARCHAR) AS producer_schema_version, {delay} AS _arrival_delay_hours, "
        f"24 AS _late_arrival_threshold_hours, coalesce({delay} > 24, false) AS _is_late_arriving FROM (SELECT *, row_number() OVER (PARTITION BY {spec.key} ORDER BY "
        f"ingestion_timestamp DESC NULLS LAST, {spec.event_time} DESC NULLS LAST, {ties}) AS rk, count(*) OVER (PARTITION BY {spec.key}) > 1 AS _silver_was_deduplicated FROM v_{name}) t WHERE rk = 1"
    )
CTES["ctx_tower"] = """SELECT t.tower_id, t.region_id, region_name, r.state, r.city AS region_city, zone, region_type, tower_name, t.city AS tower_city, latitude, longitude, tower_type,
    supported_networks, capacity_score, tower_status FROM v_towers t LEFT JOIN v_regions r ON t.region_id = r.region_id"""
CTES["ctx_subscriber"] = """SELECT device_id, s.subscriber_id, home_region_id, s.plan_id, subscriber_status, customer_segment, age_band, manufacturer, model, os_type, supports_5g, release_year,
    device_status, plan_name, plan_type, monthly_data_limit_gb, voice_limit_minutes, priority_level, is_5g_enabled AS plan_is_5g_enabled, monthly_price
    FROM v_devices d LEFT JOIN v_subscribers s ON d.subscriber_id = s.subscriber_id LEFT JOIN v_service_plans p ON s.plan_id = p.plan_id"""
TOWER_PICK = "region_id, region_name, state, region_city, zone, region_type, tower_name, {}tower_type, capacity_score{}"
WHO_PICK = "home_region_id, plan_id, subscriber_status, customer_segment, {}manufacturer, model, os_type, supports_5g, {}plan_name, plan_type, {}priority_level{}"
PICKS = {
    "network_events": (
        TOWER_PICK.format("tower_city, latitude, longitude, ", ", tower_status"),
        WHO_PICK.format("age_band, ", "release_year, device_status, ", "monthly_data_limit_gb, ", ", plan_is_5g_enabled"),
        "",
    ),
    "calls": (TOWER_PICK.format("", ""), WHO_PICK.format("", "", "", ""), ", call_status = 'dropped' AS is_dropped_call, call_status = 'failed' AS is_failed_call"),
    "data_sessions": (
        TOWER_PICK.format("", ""),
        WHO_PICK.format("", "", "", ""),
        ", bytes_uploaded + bytes_downloaded AS total_bytes, round((bytes_uploaded + bytes_downloaded) / 1048576.0, 3) AS total_mb, session_status <> 'completed' AS is_failed_session",
    ),
    "tower_alarms": (TOWER_PICK.format("", ", tower_status"), "", ", severity = 'critical' AS is_critical_alarm"),
}
for name in EVENTS:
    tower, who, more = PICKS[name]
    at = TABLES[name].event_time
    picked = ", ".join(f"t.{c.strip()}" for c in tower.split(",")) + "".join(f", w.{c.strip()}" for c in who.split(",") if c)
    join = "LEFT JOIN ctx_subscriber w ON e.subscriber_id = w.subscriber_id AND e.device_id = w.device_id" if who else ""
    CTES[f"e_{name}"] = (
        f"SELECT e.*, {picked}, CAST({at} AS DATE) AS event_date, CAST(hour({at}) AS INTEGER) AS event_hour, strftime({at}, '%a') AS event_day_of_week{more} "
        f"FROM c_{name} e LEFT JOIN ctx_tower t ON e.tower_id = t.tower_id {join}"
    )


def rate(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round({part} / {whole} * 100, 3) ELSE 0.0 END"


NETWORK = f"""count(*) AS total_network_events, count(*) FILTER (status = 'failed') AS failed_network_events, avg(latency_ms) AS avg_network_latency_ms,
    avg(signal_strength_dbm) AS avg_signal_strength_dbm, {rate("count(*) FILTER (status = 'failed')", "count(*)")} AS network_failure_rate"""
CALLS = f"""count(*) AS total_calls, count(*) FILTER (is_dropped_call) AS dropped_calls, count(*) FILTER (is_failed_call) AS failed_calls, avg(duration_seconds) AS avg_call_duration_seconds,
    {rate("count(*) FILTER (is_dropped_call)", "count(*)")} AS dropped_call_rate, {rate("count(*) FILTER (is_failed_call)", "count(*)")} AS failed_call_rate"""
SESSIONS = f"""count(*) AS total_data_sessions, count(*) FILTER (is_failed_session) AS failed_data_sessions, avg(latency_ms) AS avg_session_latency_ms, sum(total_mb) AS total_data_mb,
    {rate("count(*) FILTER (is_failed_session)", "count(*)")} AS failed_session_rate"""
CONTEXT = "region_id, region_name, zone, tower_type, capacity_score"
CTES["k_network"] = f"SELECT event_date, tower_id, {CONTEXT}, {NETWORK} FROM e_network_events GROUP BY ALL"
CTES["k_calls"] = f"SELECT event_date, tower_id, {CALLS} FROM e_calls GROUP BY ALL"
CTES["k_sessions"] = f"SELECT event_date, tower_id, {SESSIONS} FROM e_data_sessions GROUP BY ALL"
CTES["k_alarms"] = "SELECT event_date, tower_id, count(*) AS total_alarms, count(*) FILTER (is_critical_alarm) AS critical_alarms FROM e_tower_alarms GROUP BY ALL"
ZERO = "total_calls dropped_calls failed_calls dropped_call_rate failed_call_rate total_data_sessions failed_data_sessions total_data_mb failed_session_rate total_alarms critical_alarms"
CTES["k_towers"] = f"""SELECT event_date, tower_id, {CONTEXT}, total_network_events, failed_network_events, avg_network_latency_ms, avg_signal_strength_dbm, network_failure_rate,
    avg_call_duration_seconds, avg_session_latency_ms, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ZERO.split())}
    FROM k_network LEFT JOIN k_calls USING (event_date, tower_id) LEFT JOIN k_sessions USING (event_date, tower_id) LEFT JOIN k_alarms USING (event_date, tower_id)"""
CTES["tower_daily_kpis"] = """SELECT *, greatest(0.0, round(100.0 - (network_failure_rate * 1.5 + dropped_call_rate * 2.0 + failed_session_rate * 1.5 + critical_alarms * 5.0), 3)) AS tower_health_score
    FROM k_towers"""
SUMS = "total_network_events failed_network_events total_calls dropped_calls total_data_sessions failed_data_sessions critical_alarms".split()
CTES["region_daily_kpis"] = f"""SELECT *, {rate("failed_network_events", "total_network_events")} AS network_failure_rate, {rate("dropped_calls", "total_calls")} AS dropped_call_rate,
    {rate("failed_data_sessions", "total_data_sessions")} AS failed_session_rate
    FROM (SELECT event_date, region_id, region_name, zone, count(DISTINCT tower_id) AS active_towers, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in SUMS)},
    round(sum(total_data_mb), 3) AS total_data_mb, round(avg(tower_health_score), 3) AS avg_tower_health_score FROM tower_daily_kpis GROUP BY ALL) t"""


def filled(columns: str) -> str:
    return ", ".join(f"coalesce({c}, 0) AS {c}" for c in columns.split())


CTES["network_type_daily_kpis"] = f"""SELECT event_date, network_type, {filled("total_network_events failed_network_events avg_network_latency_ms avg_signal_strength_dbm network_failure_rate "
    "total_data_sessions failed_data_sessions avg_session_latency_ms failed_session_rate")}, round(coalesce(total_data_mb, 0), 3) AS total_data_mb
    FROM (SELECT event_date, network_type, {NETWORK} FROM e_network_events GROUP BY ALL) a FULL JOIN (SELECT event_date, network_type, {SESSIONS} FROM e_data_sessions GROUP BY ALL) b
    USING (event_date, network_type)"""
CTES["subscriber_segment_daily_kpis"] = f"""SELECT event_date, customer_segment, plan_type, {filled("total_calls dropped_calls failed_calls dropped_call_rate failed_call_rate total_data_sessions "
    "failed_data_sessions failed_session_rate")}, round(coalesce(total_data_mb, 0), 3) AS total_data_mb
    FROM (SELECT event_date, customer_segment, plan_type, {CALLS} FROM e_calls GROUP BY ALL) a FULL JOIN
    (SELECT event_date, customer_segment, plan_type, {SESSIONS} FROM e_data_sessions GROUP BY ALL) b USING (event_date, customer_segment, plan_type)"""
CTES["r_plan_choices"] = testbed.duckdb("plan_choices")
CTES["h_hashed"] = """SELECT *, sha256(concat_ws('||', coalesce(plan_id, '<NULL>'), coalesce(subscriber_status, '<NULL>'))) AS _scd_record_hash,
    coalesce(CAST(try_strptime(regexp_extract(_pipeline_batch_id, '(20\\d{6})', 1), '%Y%m%d') AS DATE), DATE '1900-01-01') AS _scd_valid_from FROM r_plan_choices"""
LEAD = "lead(_scd_valid_from) OVER (PARTITION BY subscriber_id ORDER BY _scd_valid_from, _scd_record_hash)"
VERSION = f"SELECT *, CAST(coalesce({LEAD} - 1, DATE '9999-12-31') AS DATE) AS _scd_valid_to, {LEAD} IS NULL AS _scd_is_current FROM"
CTES["h_versions"] = f"{VERSION} h_hashed"
CTES["h_changes"] = """SELECT * EXCLUDE (same) FROM (SELECT *, lag(_scd_record_hash) OVER (PARTITION BY subscriber_id ORDER BY _scd_valid_from) IS NOT DISTINCT FROM _scd_record_hash AS same
    FROM h_hashed) t WHERE NOT same"""
CTES["h_collapsed"] = f"{VERSION} h_changes"
for name in EVENTS:
    CTES[f"{name}_enriched"] = f"SELECT * FROM e_{name}"
    CTES[f"{name}_quarantine"] = f"SELECT * FROM q_{name} WHERE reasons <> ''"
CTES["bronze_network_events"] = "SELECT * FROM r_network_events"

ORDER = {name: i for i, name in enumerate(CTES)}
USES = {name: {w for w in re.findall(r"\w+", text) if w in CTES and w != name} for name, text in CTES.items()}


def with_ctes(text: str) -> str:
    """The text after the expressions that it needs, and no others."""
    need: set[str] = set()
    todo = [w for w in re.findall(r"\w+", text) if w in CTES]
    while todo:
        name = todo.pop()
        if name not in need:
            need.add(name)
            todo += USES[name]
    parts = ", ".join(f"{n} AS ({CTES[n]})" for n in sorted(need, key=ORDER.__getitem__))
    return f"WITH {parts} {text}" if parts else text


SQL = {
    "scan_project": "SELECT l_orderkey, l_quantity * l_extendedprice AS gross FROM lineitem WHERE l_quantity > 45",
    "batch_partition_filter": "SELECT event_id, tower_id, batch_id FROM r_network_events WHERE batch_id = 'B_20260808'",
    "affected_date_filter": "SELECT event_date, tower_id, total_calls FROM k_calls WHERE event_date IN (DATE '1997-05-28', DATE '1998-10-03', DATE '1999-01-16')",
    "bronze_metadata": "SELECT *, 'regions' AS _bronze_table, 'testbed' AS _dataset_profile, 'B_20260801' AS _pipeline_batch_id, 'csv' AS _source_format FROM r_regions",
    "safe_rate": f"SELECT o_custkey, {rate('''count(*) FILTER (o_orderstatus = 'F')''', '''count(*) FILTER (o_orderpriority = '1-URGENT')''')} AS rate FROM orders GROUP BY o_custkey",
    "event_date_parts": "SELECT event_id, CAST(ts AS DATE) AS event_date, CAST(hour(ts) AS INTEGER) AS event_hour, strftime(ts, '%a') AS event_day_of_week FROM events",
    "schema_align": "SELECT event_id, CAST(NULL AS VARCHAR) AS source_system, CAST(NULL AS VARCHAR) AS producer_schema_version FROM r_network_events",
    "record_hash": "SELECT subscriber_id, _pipeline_batch_id, _scd_record_hash FROM h_hashed",
    "array_except_rule": """SELECT tower_id, array_to_string(list_filter(string_split(supported_networks, '|'), lambda x: x NOT IN ('4G', '5G', 'LTE')), '|') AS unsupported FROM r_towers""",
    "duplicate_key_count": "SELECT region_id, count(*) OVER (PARTITION BY region_id) AS copies FROM r_regions",
    "fk_existence_check": "SELECT tower_id, region_id, region_id IN (SELECT region_id FROM v_regions) AS known FROM r_towers WHERE region_id IS NOT NULL",
    "fk_orphans_anti": "SELECT tower_id, region_id FROM r_towers WHERE region_id IS NULL OR region_id NOT IN (SELECT region_id FROM v_regions)",
    **{f"quality_{t}": f"SELECT {spec.key}, reasons FROM q_{t}" for t, spec in TABLES.items()},
    "quality_valid_split": "SELECT * FROM v_network_events",
    "quality_quarantine": "SELECT call_id, subscriber_id, tower_id, reasons, 'calls' AS _source_table FROM q_calls WHERE reasons <> ''",
    "quality_counts": "SELECT reasons = '' AS _is_quality_valid, count(*) AS count FROM q_network_events GROUP BY ALL",
    "quality_cascade_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) FILTER (reasons = '') AS valid, count(*) FILTER (reasons <> '') AS invalid FROM q_{t}" for t in TABLES
    ),
    "rejection_reason_summary": "SELECT table_name, rejection_reason, count(*) AS count FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, unnest(string_split(reasons, ',')) AS rejection_reason FROM q_{t} WHERE reasons <> ''" for t in TABLES)
    + ") t GROUP BY ALL",
    "dedup_latest": "SELECT event_id, source_file, tower_id, _silver_was_deduplicated FROM c_network_events",
    "late_arrival": "SELECT call_id, _arrival_delay_hours, _is_late_arriving FROM c_calls",
    "silver_controls": "SELECT session_id, _silver_was_deduplicated, _arrival_delay_hours, _late_arrival_threshold_hours, _is_late_arriving, source_system FROM c_data_sessions",
    "silver_audit_metrics": """SELECT count(*) AS rows, CAST(sum(CAST(_is_late_arriving AS INT)) AS BIGINT) AS late_rows,
        CAST(sum(CAST(_silver_was_deduplicated AS INT)) AS BIGINT) AS deduplicated_rows FROM c_network_events""",
    "ctx_tower_region": "SELECT * FROM ctx_tower",
    "ctx_subscriber_device_plan": "SELECT * FROM ctx_subscriber",
    "enrich_network_events": """SELECT * REPLACE (CAST(priority_level AS VARCHAR) AS priority_level, CAST(monthly_data_limit_gb AS VARCHAR) AS monthly_data_limit_gb,
        CAST(release_year AS VARCHAR) AS release_year) FROM e_network_events""",
    **{f"enrich_{t}": f"SELECT * REPLACE (CAST(priority_level AS VARCHAR) AS priority_level) FROM e_{t}" for t in ("calls", "data_sessions")},
    "enrich_tower_alarms": "SELECT * FROM e_tower_alarms",
    "scd2_valid_from": "SELECT subscriber_id, _pipeline_batch_id, _scd_valid_from FROM h_hashed",
    "scd2_dimension": "SELECT subscriber_id, plan_id, _scd_record_hash, _scd_valid_from, _scd_valid_to, _scd_is_current FROM h_versions",
    "scd2_collapsed": "SELECT subscriber_id, plan_id, _scd_valid_from, _scd_valid_to, _scd_is_current FROM h_collapsed",
    "scd2_current": "SELECT subscriber_id, plan_id, subscriber_status FROM h_versions WHERE _scd_is_current",
    "scd2_metrics": "SELECT count(*) AS rows, CAST(sum(CAST(_scd_is_current AS INT)) AS BIGINT) AS current_rows FROM h_versions",
    "scd2_point_in_time_join": """SELECT o_orderkey, h.plan_id FROM (SELECT *, DATE '2026-08-01' + CAST(o_orderkey % 30 AS INTEGER) AS at, concat('SUB_', o_custkey) AS who FROM orders) o
        LEFT JOIN h_versions h ON h.subscriber_id = o.who AND o.at BETWEEN h._scd_valid_from AND h._scd_valid_to""",
    "network_event_tower_daily": "SELECT * REPLACE (round(avg_network_latency_ms, 6) AS avg_network_latency_ms, round(avg_signal_strength_dbm, 6) AS avg_signal_strength_dbm) FROM k_network",
    "calls_tower_daily": "SELECT * REPLACE (round(avg_call_duration_seconds, 6) AS avg_call_duration_seconds) FROM k_calls",
    "sessions_tower_daily": "SELECT * REPLACE (round(avg_session_latency_ms, 6) AS avg_session_latency_ms, round(total_data_mb, 6) AS total_data_mb) FROM k_sessions",
    "alarms_tower_daily": "SELECT * FROM k_alarms",
    "tower_daily_kpis": """SELECT * REPLACE (round(avg_network_latency_ms, 6) AS avg_network_latency_ms, round(avg_signal_strength_dbm, 6) AS avg_signal_strength_dbm,
        round(avg_call_duration_seconds, 6) AS avg_call_duration_seconds, round(avg_session_latency_ms, 6) AS avg_session_latency_ms, round(total_data_mb, 6) AS total_data_mb) FROM tower_daily_kpis""",
    "region_daily_kpis": "SELECT * FROM region_daily_kpis",
    "network_type_daily_kpis": """SELECT * REPLACE (round(avg_network_latency_ms, 6) AS avg_network_latency_ms, round(avg_signal_strength_dbm, 6) AS avg_signal_strength_dbm,
        round(avg_session_latency_ms, 6) AS avg_session_latency_ms) FROM network_type_daily_kpis""",
    "subscriber_segment_daily_kpis": "SELECT * FROM subscriber_segment_daily_kpis",
    "affected_event_dates": "SELECT event_date FROM e_calls UNION SELECT event_date FROM e_data_sessions",
    "documents_quality": """SELECT doc_id, array_to_string(list_filter([CASE WHEN text IS NULL OR trim(text) = '' THEN 'text_missing' END,
        CASE WHEN lang NOT IN ('de', 'en', 'es', 'fr') THEN 'lang_unsupported' END, CASE WHEN n_chars < 20 THEN 'n_chars_too_low' END,
        CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'doc_id_unknown' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents""",
    "documents_duplicate_hash": "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING count(*) > 1",
    "q15_investigate_first": INVESTIGATE_SQL,
    **QUESTION_SQL,
}


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(text) for name, text in SQL.items()}
