"""SQL of the standing questions, written by hand: nothing of it comes from the plans it is held against.

The order ends with the keys, and NULLs stand where Spark puts them.  The least numbers are those of the driver's sparse tables.
"""

QUESTION_SQL = {
    "q01_lowest_health": """
        SELECT event_date, tower_id, region_name, tower_type, total_network_events, network_failure_rate, dropped_call_rate, failed_session_rate, critical_alarms, tower_health_score
        FROM tower_daily_kpis ORDER BY tower_health_score NULLS FIRST, event_date NULLS FIRST, tower_id NULLS FIRST, region_id NULLS FIRST LIMIT 10""",
    "q02_network_failures": """
        SELECT event_date, tower_id, region_name, tower_type, total_network_events, failed_network_events, network_failure_rate, tower_health_score FROM tower_daily_kpis
        WHERE total_network_events >= 3 ORDER BY network_failure_rate DESC NULLS LAST, event_date NULLS FIRST, tower_id NULLS FIRST, region_id NULLS FIRST LIMIT 10""",
    "q03_dropped_calls": """
        SELECT event_date, tower_id, region_name, total_calls, dropped_calls, dropped_call_rate, tower_health_score FROM tower_daily_kpis
        WHERE total_calls >= 1 ORDER BY dropped_call_rate DESC NULLS LAST, event_date NULLS FIRST, tower_id NULLS FIRST, region_id NULLS FIRST LIMIT 10""",
    "q04_busy_and_weak": """
        SELECT event_date, tower_id, region_name, tower_type, total_network_events, total_data_mb, tower_health_score FROM tower_daily_kpis WHERE total_network_events >= 3
        ORDER BY tower_health_score NULLS FIRST, total_network_events DESC NULLS LAST, event_date NULLS FIRST, tower_id NULLS FIRST, region_id NULLS FIRST LIMIT 10""",
    "q05_tower_types": """
        SELECT tower_type, count(DISTINCT tower_id) AS towers, round(avg(tower_health_score), 3) AS avg_health_score, round(avg(network_failure_rate), 3) AS avg_network_failure_rate,
          round(avg(dropped_call_rate), 3) AS avg_dropped_call_rate, round(avg(failed_session_rate), 3) AS avg_failed_session_rate FROM tower_daily_kpis GROUP BY tower_type""",
    "q06_worst_regions": """
        SELECT event_date, region_id, region_name, zone, active_towers, avg_tower_health_score, network_failure_rate, dropped_call_rate, failed_session_rate, critical_alarms
        FROM region_daily_kpis ORDER BY avg_tower_health_score NULLS FIRST, event_date NULLS FIRST, region_id NULLS FIRST LIMIT 10""",
    "q07_region_dropped_calls": """
        SELECT event_date, region_name, total_calls, dropped_calls, dropped_call_rate, avg_tower_health_score FROM region_daily_kpis
        WHERE total_calls >= 2 ORDER BY dropped_call_rate DESC NULLS LAST, event_date NULLS FIRST, region_id NULLS FIRST LIMIT 10""",
    "q08_zones": """
        SELECT zone, count(DISTINCT region_id) AS regions, round(avg(avg_tower_health_score), 3) AS avg_health_score, round(avg(network_failure_rate), 3) AS avg_network_failure_rate,
          round(avg(dropped_call_rate), 3) AS avg_dropped_call_rate, round(avg(failed_session_rate), 3) AS avg_failed_session_rate, CAST(sum(critical_alarms) AS BIGINT) AS critical_alarms
        FROM region_daily_kpis GROUP BY zone""",
    "q09_network_types": """
        SELECT network_type, CAST(sum(total_network_events) AS BIGINT) AS total_network_events, CAST(sum(failed_network_events) AS BIGINT) AS failed_network_events,
          round(avg(network_failure_rate), 3) AS avg_network_failure_rate, round(avg(avg_network_latency_ms), 3) AS avg_network_latency_ms,
          round(avg(avg_signal_strength_dbm), 3) AS avg_signal_strength_dbm, round(sum(total_data_mb), 3) AS total_data_mb FROM network_type_daily_kpis GROUP BY network_type""",
    "q10_failed_sessions_by_day": """
        SELECT event_date, network_type, total_data_sessions, failed_data_sessions, failed_session_rate, round(avg_session_latency_ms, 3) AS avg_session_latency_ms, total_data_mb
        FROM network_type_daily_kpis ORDER BY failed_session_rate DESC NULLS LAST, event_date NULLS FIRST, network_type NULLS FIRST LIMIT 10""",
    "q11_segment_dropped_calls": """
        SELECT event_date, customer_segment, plan_type, total_calls, dropped_calls, dropped_call_rate, failed_call_rate FROM subscriber_segment_daily_kpis WHERE total_calls >= 2
        ORDER BY dropped_call_rate DESC NULLS LAST, event_date NULLS FIRST, customer_segment NULLS FIRST, plan_type NULLS FIRST LIMIT 10""",
    "q12_data_by_segment": """
        SELECT customer_segment, plan_type, CAST(sum(total_data_sessions) AS BIGINT) AS total_data_sessions, round(sum(total_data_mb), 3) AS total_data_mb,
          round(avg(failed_session_rate), 3) AS avg_failed_session_rate FROM subscriber_segment_daily_kpis GROUP BY customer_segment, plan_type
        ORDER BY 4 DESC NULLS LAST, customer_segment NULLS FIRST, plan_type NULLS FIRST LIMIT 10""",
    "q13_enterprise": """
        SELECT event_date, customer_segment, plan_type, total_calls, dropped_call_rate, failed_call_rate, total_data_sessions, failed_session_rate, total_data_mb
        FROM subscriber_segment_daily_kpis WHERE 'enterprise' IN (customer_segment, plan_type)""",
    "q14_summary": """
        SELECT count(DISTINCT tower_id) AS towers, count(DISTINCT region_id) AS regions, CAST(sum(total_network_events) AS BIGINT) AS total_network_events,
          CAST(sum(failed_network_events) AS BIGINT) AS failed_network_events, round(avg(network_failure_rate), 3) AS avg_network_failure_rate,
          CAST(sum(total_calls) AS BIGINT) AS total_calls, CAST(sum(dropped_calls) AS BIGINT) AS dropped_calls, round(avg(dropped_call_rate), 3) AS avg_dropped_call_rate,
          CAST(sum(total_data_sessions) AS BIGINT) AS total_data_sessions, CAST(sum(failed_data_sessions) AS BIGINT) AS failed_data_sessions,
          round(avg(failed_session_rate), 3) AS avg_failed_session_rate, round(sum(total_data_mb), 3) AS total_data_mb, CAST(sum(critical_alarms) AS BIGINT) AS critical_alarms,
          round(avg(tower_health_score), 3) AS avg_tower_health_score FROM tower_daily_kpis""",
    "q_bronze_event_type_counts": "SELECT event_type, count(*) AS records FROM bronze_network_events GROUP BY event_type",
    "q_bronze_network_type_counts": "SELECT network_type, count(*) AS records FROM bronze_network_events GROUP BY network_type",
    "q_bronze_time_range": """
        SELECT min(event_timestamp) AS min_event_timestamp, max(event_timestamp) AS max_event_timestamp, min(ingestion_timestamp) AS min_ingestion_timestamp,
          max(ingestion_timestamp) AS max_ingestion_timestamp FROM bronze_network_events""",
    "q_silver_network_events": """
        SELECT event_id, event_date, event_hour, tower_id, region_name, tower_type, subscriber_id, customer_segment, plan_type, manufacturer, network_type, status
        FROM network_events_enriched ORDER BY event_id LIMIT 10""",
    "q_silver_calls_by_region_plan": """
        SELECT region_name, plan_type, count(*) AS calls, count(*) FILTER (is_dropped_call) AS dropped_calls, count(*) FILTER (is_failed_call) AS failed_calls
        FROM calls_enriched GROUP BY region_name, plan_type ORDER BY calls DESC, region_name NULLS FIRST, plan_type NULLS FIRST LIMIT 15""",
    "q_silver_top_data_sessions": """
        SELECT session_id, event_date, tower_id, region_name, network_type, customer_segment, plan_type, total_mb, latency_ms, session_status
        FROM data_sessions_enriched ORDER BY total_mb DESC NULLS LAST, session_id LIMIT 10""",
    "q_silver_critical_alarms": """
        SELECT alarm_id, event_date, tower_id, region_name, tower_type, alarm_type, severity, alarm_status, is_critical_alarm
        FROM tower_alarms_enriched WHERE severity = 'critical' ORDER BY alarm_id LIMIT 20""",
    "q_quarantined_events": """
        SELECT event_id, subscriber_id, device_id, tower_id, network_type, status, reasons FROM network_events_quarantine
        ORDER BY event_id NULLS FIRST, reasons NULLS FIRST, network_type NULLS FIRST, status NULLS FIRST, subscriber_id NULLS FIRST LIMIT 20""",
}
