"""Single operators, with the rows that break naive versions: NULLs, blanks, ties, one-sided groups."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellgauge.catalog import TABLES, History
from cellgauge.functions.measures import safe_rate
from cellgauge.operators import controls, history, kpis, quality

DAY = dt.datetime(2026, 8, 1, 10)


def regions(spark, *rows):
    base = ("R", "name", "land", "state", "city", "zone", "metro", "UTC", True)
    return spark.createDataFrame([tuple(r.get(f.name, b) for f, b in zip(TABLES["regions"].schema, base)) for r in rows], TABLES["regions"].schema)


def reasons_of(classified, key):
    return {r[key]: r["_rejection_reasons"] for r in classified.rows.collect()}


def test_rules_and_nulls(spark):
    df = regions(spark, {"region_id": "A"}, {"region_id": "B", "city": "  ", "region_type": "moon"}, {"region_id": "C", "region_type": None}, {"region_id": None}, {"region_id": "D"}, {"region_id": "D"})
    got = quality.classify(df, "regions", {})
    found = reasons_of(got, "region_id")
    assert found["A"] == [] and found["C"] == []  # an empty enum passes
    assert found["B"] == ["city_missing", "region_type_unsupported"]
    assert found[None] == ["region_id_missing"]
    assert found["D"] == ["region_id_duplicate"]
    assert got.valid.count() + got.invalid.count() == 6
    assert got.invalid.where("_source_table = 'regions'").count() == 4


def test_unknown_reference_and_fan_out(spark):
    parent = regions(spark, {"region_id": "A"}, {"region_id": "A"})
    child = spark.createDataFrame([("x", "A"), ("y", "Z"), ("z", None), ("w", " ")], "id string, region_id string")
    probed = quality.with_reference(child, parent, "region_id", "region_id")
    assert {r["id"]: r["_ref_region_id"] for r in probed.collect()} == {"x": "A", "y": None, "z": None, "w": None}


def test_latest_per_key_settles_ties(spark):
    rows = [("k", DAY, DAY, "b"), ("k", DAY, DAY, "a"), ("k", None, DAY, "c"), ("m", None, None, "d")]
    df = spark.createDataFrame(rows, "id string, ingestion_timestamp timestamp, t timestamp, v string")
    got = {r["id"]: (r["v"], r["_silver_was_deduplicated"]) for r in controls.latest_per_key(df, "id", "t").collect()}
    assert got == {"k": ("a", True), "m": ("d", False)}


def test_late_is_flagged(spark):
    hours = lambda h: DAY + dt.timedelta(hours=h)
    df = spark.createDataFrame([(1, DAY, hours(24)), (2, DAY, hours(25)), (3, DAY, None)], "id int, t timestamp, ingestion_timestamp timestamp")
    assert {r["id"]: r["_is_late_arriving"] for r in controls.flag_late(df, "t").collect()} == {1: False, 2: True, 3: False}


def test_align_keeps_what_is_there(spark):
    df = spark.createDataFrame([("x",)], "source_system string")
    assert controls.align_columns(df).first().asDict() == {"source_system": "x", "producer_schema_version": None}


def test_safe_rate(spark):
    df = spark.createDataFrame([(1, 3), (1, 0), (1, None)], "a int, b int")
    assert [r[0] for r in df.select(safe_rate("a", "b")).collect()] == [33.333, 0.0, 0.0]


@pytest.fixture
def deliveries(spark):
    rows = [("a", "1", "B_20260801"), ("a", "1", "B_20260808"), ("a", "2", "B_20260815"), ("b", None, "manual")]
    return spark.createDataFrame(rows, "k string, v string, _pipeline_batch_id string")


def intervals(df):
    return sorted((r["k"], r["v"], str(r["_scd_valid_from"]), str(r["_scd_valid_to"]), r["_scd_is_current"]) for r in df.collect())


def test_history(deliveries):
    spec = History("k", ("v",))
    assert intervals(history.build_history(deliveries, spec)) == [
        ("a", "1", "2026-08-01", "2026-08-07", False),
        ("a", "1", "2026-08-08", "2026-08-14", False),
        ("a", "2", "2026-08-15", "9999-12-31", True),
        ("b", None, "1900-01-01", "9999-12-31", True),
    ]
    collapsed = history.build_history(deliveries, spec, collapse=True)
    assert [x[2] for x in intervals(collapsed) if x[0] == "a"] == ["2026-08-01", "2026-08-15"]
    assert history.current_rows(collapsed).count() == 2
    assert history.current_rows(deliveries).count() == 4


def test_history_keeps_the_last_of_a_day(spark):
    df = spark.createDataFrame([("a", "1", "B_20260801", 1), ("a", "2", "B_20260801", 2)], "k string, v string, _pipeline_batch_id string, _silver_loaded_at int")
    assert intervals(history.build_history(df, History("k", ("v",)), collapse=True)) == [("a", "2", "2026-08-01", "9999-12-31", True)]


def test_as_of(spark, deliveries):
    versions = history.build_history(deliveries, History("k", ("v",)))
    facts = spark.createDataFrame([(1, "a", dt.date(2026, 8, 14)), (2, "a", dt.date(2026, 8, 15)), (3, "a", dt.date(2020, 1, 1))], "id int, k string, day date")
    assert {r["id"]: r["v"] for r in history.as_of(facts, versions, "k", "day", ["v"]).collect()} == {1: "1", 2: "2", 3: None}


def enriched(spark):
    day = dt.date(2026, 8, 1)
    network = spark.createDataFrame(
        [(day, "T1", "R", "n", "z", "urban", 5, "failed", 10, -70, "4G"), (day, "T1", "R", "n", "z", "urban", 5, "success", 30, -90, None)],
        "event_date date, tower_id string, region_id string, region_name string, zone string, tower_type string, capacity_score int, status string, latency_ms int, signal_strength_dbm int, network_type string",
    )
    calls = spark.createDataFrame(
        [(day, "T1", True, False, 10, "s", "p"), (day, "T2", False, True, 20, None, "p")],
        "event_date date, tower_id string, is_dropped_call boolean, is_failed_call boolean, duration_seconds int, customer_segment string, plan_type string",
    )
    sessions = spark.createDataFrame(
        [(day, "T9", True, 5, 1.5, "5G", "s", "q"), (day, "T9", False, 7, 2.5, None, None, "p")],
        "event_date date, tower_id string, is_failed_session boolean, latency_ms int, total_mb double, network_type string, customer_segment string, plan_type string",
    )
    alarms = spark.createDataFrame([(day, "T1", True)], "event_date date, tower_id string, is_critical_alarm boolean")
    return {"network_events_enriched": network, "calls_enriched": calls, "data_sessions_enriched": sessions, "tower_alarms_enriched": alarms}


def test_kpis(spark):
    out = kpis.build_kpis(enriched(spark))
    tower = out["tower_daily_kpis"].collect()
    assert len(tower) == 1  # towers without network events are not there
    t = tower[0]
    assert (t["network_failure_rate"], t["dropped_call_rate"], t["total_data_mb"], t["avg_session_latency_ms"]) == (50.0, 100.0, 0.0, None)
    assert t["tower_health_score"] == 0.0
    region = out["region_daily_kpis"].first()
    assert (region["active_towers"], region["total_calls"], region["critical_alarms"]) == (1, 1, 1)
    # NULL keys match nothing, one-sided groups are filled with 0
    types = {(r["network_type"], r["total_network_events"], r["total_data_sessions"]) for r in out["network_type_daily_kpis"].collect()}
    assert types == {("4G", 1, 0), (None, 1, 0), ("5G", 0, 1), (None, 0, 1)}
    assert out["subscriber_segment_daily_kpis"].count() == 4
    with pytest.raises(ValueError):
        kpis.build_kpis(enriched(spark), ["nothing"])


def test_plans_are_native(spark):
    for df in kpis.build_kpis(enriched(spark)).values():
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    df = spark.range(10).select(F.col("id").alias("tower_id"))
    assert "Window" in quality.with_key_count(df, "tower_id")._jdf.queryExecution().executedPlan().toString()
