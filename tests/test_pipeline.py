"""From generated CSV to KPIs: planted rows, reruns, later batches, affected tables."""

import pytest
from pyspark.sql import functions as F

from cellgauge.catalog import BATCH, DIMENSIONS, TABLES
from cellgauge.functions.rules import RULES
from cellgauge.operators import kpis, quality
from cellgauge.plans.config import Settings
from cellgauge.plans.pipeline import Pipeline, run_batch, run_stage
from cellgauge.sources import generator
from cellgauge.streaming.controls import control_stream

SIZE = dict(regions=8, towers=12, service_plans=6, subscribers=60, devices=70, network_events=200, calls=100, data_sessions=100, tower_alarms=40)
B1, B2 = "BATCH_20260801_001", "BATCH_20260815_002"


@pytest.fixture(scope="module")
def config(tmp_path_factory):
    base = tmp_path_factory.mktemp("lake")
    zones = ("raw", "bronze", "silver", "gold", "quarantine")
    return {"paths": {z: str(base / z) for z in zones}, "incremental": {"registry_path": str(base / "runs.json")}}


@pytest.fixture(scope="module")
def clean(spark):
    return {t: df.coalesce(1).persist() for t, df in generator.clean_tables(spark, SIZE).items()}


def test_planted_rows(spark, clean):
    """One row per rule, and each rule rejects its own."""
    tables = generator.plant(clean, None)
    found = quality.classify_all(tables)
    for name in TABLES:
        rejected = {r for x in found[name].invalid.select("_rejection_reasons").collect() for r in x[0]}
        assert {rule.reason for rule in RULES[name]} <= rejected, name
        assert tables[name].count() - clean[name].count() == len(RULES[name]) + (TABLES[name].is_event)
    for name, judged in quality.classify_all(clean).items():
        if not name.endswith(("calls", "data_sessions", "tower_alarms")):
            assert judged.invalid.count() == 0, name


def test_run_and_rerun(spark, config, clean):
    tables = generator.plant(clean)
    assert {t: df.count() - clean[t].count() for t, df in tables.items()} == generator.PLANTED_ROWS
    generator.write_raw(tables, config["paths"]["raw"], "messy")
    first = run_batch(config, "messy", B1, spark=spark)
    assert first["status"] == "completed", first
    by = {w["table"]: w for w in first["stages"]["quality"]}
    for name in TABLES:
        assert by[name]["rows"] + by[name]["rejected"] == tables[name].count()
    pipeline = Pipeline(Settings.of(config), "messy", spark)
    store = pipeline.store
    for name in ("tower_alarms", "calls"):
        reasons = {r[TABLES[name].key]: r["_rejection_reasons"] for r in store.read("quarantine", name).collect()}
        for what, _ in generator.cases(name, generator.PLANTED_ROWS[name])[1:]:
            if what in {r.reason for r in RULES[name]} and not what.startswith(TABLES[name].key):
                assert what in reasons[f"{generator.KEYS[name]}-{what}"]
    # both copies of a duplicate region go, and its towers with them
    gone = {r["region_id"] for r in store.read("quarantine", "regions").where("array_contains(_rejection_reasons, 'region_id_duplicate')").collect()}
    assert len(gone) == 1 and store.read("silver", "towers").where(F.col("region_id").isin(*gone)).count() == 0
    events = store.read("silver", "network_events_enriched")
    assert events.count() == events.select("event_id").distinct().count()

    gold = store.read("gold", "tower_daily_kpis").drop("_gold_created_at")
    before = sorted(map(str, gold.collect()))
    assert before
    assert run_batch(config, "messy", B1, spark=spark)["status"] == "skipped"
    assert run_batch(config, "messy", B1, force=True, tables=["tower_alarms"], spark=spark)["status"] == "completed"
    assert sorted(map(str, store.read("gold", "tower_daily_kpis").drop("_gold_created_at").collect())) == before
    towers, regions = store.read("gold", "tower_daily_kpis"), store.read("gold", "region_daily_kpis")
    assert towers.agg(F.sum("total_calls")).first()[0] == regions.agg(F.sum("total_calls")).first()[0]


def test_change_of_dimensions(spark, config, clean):
    generator.write_raw(clean, config["paths"]["raw"], "change")
    first = Pipeline(Settings.of(config), "change", spark)
    first.bronze(B1)
    first.quality(B1)
    first.histories()
    assert {w.rejected for w in run_stage(Pipeline(Settings.of(config), "change", spark), "quality", B1, ["towers"])} == {0}
    generator.write_raw(generator.change_dimensions(clean), config["paths"]["raw"], "change")
    assert run_batch(config, "change", B2, spark=spark)["status"] == "completed"
    store = Pipeline(Settings.of(config), "change", spark).store
    for name, spec in ((n, TABLES[n]) for n in DIMENSIONS):
        versions = store.read("silver", f"{name}_scd2")
        key = versions.agg(F.min(spec.key)).first()[0]
        mine = {str(r["_scd_valid_from"]): (str(r["_scd_valid_to"]), r["_scd_is_current"]) for r in versions.where(F.col(spec.key) == key).collect()}
        assert mine["2026-08-15"] == ("9999-12-31", True)
        assert ("2026-08-14", False) in mine.values()
        assert versions.where("_scd_is_current").count() == versions.select(spec.key).distinct().count()
    # the second delivery of the same events does not count twice
    total = store.read("gold", "tower_daily_kpis").agg(F.sum("total_network_events")).first()[0]
    assert total == SIZE["network_events"]


def test_affected_tables(spark, config, clean):
    pipeline = Pipeline(Settings.of(config), "change", spark)
    stages = pipeline.run(B2, ["calls"])
    assert [w["table"] for w in stages["silver"]] == ["calls_enriched"]
    assert {w["table"] for w in stages["gold"]} == {"tower_daily_kpis", "region_daily_kpis", "subscriber_segment_daily_kpis"}
    assert "data_sessions" not in {w["table"] for w in stages["bronze"]}
    assert pipeline.gold("BATCH_WITHOUT_ROWS") == []


def test_moved_day(spark, config, clean):
    """Records delivered again with another day leave their old day: an incremental run and a full one agree."""
    profile = "moved"
    generator.write_raw(clean, config["paths"]["raw"], profile)
    assert run_batch(config, profile, B1, spark=spark)["status"] == "completed"
    times = {c: F.col(c) + F.expr("INTERVAL 10 DAYS") for c in ("event_timestamp", "ingestion_timestamp")}
    again = clean["network_events"].orderBy("event_id").limit(5).withColumns(times)
    generator.write_raw(clean | {"network_events": again}, config["paths"]["raw"], profile)
    assert run_batch(config, profile, B2, tables=["network_events"], spark=spark)["status"] == "completed"
    pipeline = Pipeline(Settings.of(config), profile, spark)
    rows = lambda t: sorted(map(str, pipeline.store.read("gold", t).drop("_gold_created_at").collect()))
    part = {t: rows(t) for t in kpis.KPIS}
    for t in kpis.KPIS:
        pipeline.store.remove("gold", t)
    pipeline.gold()
    assert part == {t: rows(t) for t in kpis.KPIS}
    assert pipeline.store.read("gold", "tower_daily_kpis").agg(F.sum("total_network_events")).first()[0] == SIZE["network_events"]


def test_failed_run_keeps_its_stages(spark, config, clean, monkeypatch):
    generator.write_raw(clean, config["paths"]["raw"], "broken")
    monkeypatch.setattr(Pipeline, "histories", lambda *a: 1 / 0)
    out = run_batch(config | {"audit": {"count_bronze_inputs": True, "count_quality_outputs": False}}, "broken", B1, spark=spark)
    assert out["status"] == "failed" and set(out["stages"]) == {"bronze", "quality"}
    assert {w["rows"] for w in out["stages"]["bronze"]} == set(SIZE.values()) and {w["rows"] for w in out["stages"]["quality"]} == {None}


def test_failure_is_recorded(spark, config):
    out = run_batch(config, "nothing_there", B1, spark=spark)
    assert out["status"] == "failed" and out["error_message"]


def test_malformed_cell_fails(spark, config, tmp_path):
    raw = tmp_path / "raw" / "bad"
    raw.mkdir(parents=True)
    header = ",".join(f.name for f in TABLES["service_plans"].schema)
    (raw / "service_plans.csv").write_text(f"{header}\nP,n,prepaid,many,1,1,true,1\n")
    pipeline = Pipeline(Settings.of({"paths": config["paths"] | {"raw": str(tmp_path / "raw")}}), "bad", spark)
    with pytest.raises(Exception, match="(?i)malformed|failfast|cannot"):
        pipeline.bronze(B1, ["service_plans"])


def test_batch_filter_prunes(spark, config):
    store = Pipeline(Settings.of(config), "messy", spark).store
    plan = store.read("bronze", "calls", B1)._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({BATCH}" in plan


def test_remove_stays_inside(spark, config):
    pipeline = Pipeline(Settings.of(config), "../other", spark)
    with pytest.raises(ValueError):
        pipeline.store.remove("gold")
    with pytest.raises(ValueError):
        run_stage(pipeline, "nonsense")


def test_stream(spark, config, clean, tmp_path):
    pipeline = Pipeline(Settings.of(config), "stream", spark)
    source = tmp_path / "in"
    clean["calls"].limit(50).write.parquet(str(source))
    stream = spark.readStream.schema(TABLES["calls"].schema).parquet(str(source))
    for _ in range(2):
        query = control_stream(stream, "calls", pipeline.store, str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        clean["calls"].limit(50).write.mode("append").parquet(str(source))  # delivered again
    assert pipeline.store.read("silver", "calls_stream").count() == 50
