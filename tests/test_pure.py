"""Parts that need no data: partitions, dependencies, registry, settings, catalogue."""

import fcntl
import json
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

import pytest

from cellgauge.catalog import DIMENSIONS, EVENTS, HISTORIES, TABLES
from cellgauge.functions.rules import RULES
from cellgauge.plans import graph
from cellgauge.plans.config import Settings
from cellgauge.plans.registry import COMPLETED, FAILED, RUNNING, RunLog, plain
from cellgauge.sources.partitions import MB, FileTarget
from cellgauge.sources.storage import join_path

KB = 1024


@pytest.mark.parametrize(
    "size, target, want",
    [
        (10 * KB, dict(min_partitions=2), 2),
        (10 * KB, dict(min_partitions=2, tiny_file_threshold_mb=1, tiny_file_partitions=1), 1),
        (512 * MB, dict(min_partitions=2), 4),
        (20 * KB * MB, {}, 64),
        (512 * MB, dict(strategy="none"), None),
        (None, {}, None),
    ],
)
def test_partitions(size, target, want):
    assert FileTarget(**target).partitions(size) == want


@pytest.mark.parametrize("bad", [dict(strategy="manual"), dict(target_file_size_mb=0), dict(min_partitions=0), dict(min_partitions=9, max_partitions=8), dict(tiny_file_threshold_mb=-1), dict(tiny_file_partitions=0)])
def test_bad_targets(bad):
    with pytest.raises(ValueError):
        FileTarget(**bad)


def test_graph():
    assert graph.with_parents(["network_events"]) == ["regions", "towers", "service_plans", "subscribers", "devices", "network_events"]
    assert graph.with_parents(["towers"]) == ["regions", "towers"]
    assert graph.affected_enriched(["subscribers"]) == list(graph.ENRICHED)
    assert graph.affected_enriched(["calls"]) == ["calls_enriched"]
    assert graph.affected_kpis(["calls_enriched"]) == ["tower_daily_kpis", "region_daily_kpis", "subscriber_segment_daily_kpis"]
    assert graph.affected_kpis(["tower_alarms_enriched"]) == ["tower_daily_kpis", "region_daily_kpis"]
    assert graph.parse_names(" calls, towers ", TABLES) == ["towers", "calls"]
    assert graph.parse_names("", TABLES) is None
    with pytest.raises(ValueError, match="nonsense"):
        graph.parse_names("nonsense", TABLES)


def test_catalogue():
    assert [len(RULES[t]) for t in TABLES] == [9, 13, 9, 10, 10, 16, 15, 17, 10]
    assert sum(map(len, RULES.values())) == 109
    assert [len(t.schema) for t in TABLES.values()] == [9, 11, 8, 7, 8, 15, 15, 17, 12]
    assert len(DIMENSIONS) == 5 and len(EVENTS) == 4
    for name, spec in HISTORIES.items():
        assert set(spec.tracked) | {spec.key} == {f.name for f in TABLES[name].schema}


def test_run_log(tmp_path):
    path = tmp_path / "deep" / "runs.json"
    log = RunLog(path)
    a = log.begin("p", "B1")
    assert log.run(a)["status"] == RUNNING and not log.finished("p", "B1")
    log.stage(a, "bronze", [3])
    assert log.end(a)["stages"] == {"bronze": [{"value": "3"}]}
    assert log.finished("p", "B1") and not log.finished("q", "B1")
    b = log.begin("p", "B2")
    log.stage(b, "bronze", [])
    ended = log.end(b, ValueError("no"))
    assert (ended["status"], ended["error_message"], ended["stages"]) == (FAILED, "no", {"bronze": []}) and ended["failed_at"] >= ended["started_at"]
    assert [r["status"] for r in log.runs()] == [COMPLETED, FAILED] and len(path.read_text().splitlines()) == 6
    c = log.begin("p", "B3")
    assert RunLog(path, stale_after=timedelta(0)).run(c)["status"] == FAILED and log.run(c)["status"] == RUNNING
    assert plain([a, 3])[1] == {"value": "3"}


def test_runs_at_the_same_time(tmp_path):
    log = RunLog(tmp_path / "runs.json")
    with ThreadPoolExecutor(8) as pool:
        ids = list(pool.map(lambda i: log.begin("p", f"B{i}"), range(40)))
        list(pool.map(log.end, ids))
    assert {r["run_id"]: r["status"] for r in log.runs()} == dict.fromkeys(ids, COMPLETED)


def test_reads_wait_for_a_line_being_written(tmp_path):
    log = RunLog(tmp_path / "runs.json")
    a = log.begin("p", "B1")
    line = json.dumps({"run_id": a, "event": COMPLETED, "at": "2026-01-01T00:00:00+00:00"}) + "\n"
    with log.path.open("a") as out, ThreadPoolExecutor(1) as pool:
        fcntl.flock(out, fcntl.LOCK_EX)
        out.write(line[:40])
        out.flush()
        got = pool.submit(log.run, a)
        time.sleep(0.3)
        out.write(line[40:])
        out.flush()
        fcntl.flock(out, fcntl.LOCK_UN)
        assert got.result()["status"] == COMPLETED


def test_settings():
    s = Settings.of({"paths": {"raw": "r"}, "spark": {"shuffle_partitions": 8}, "bronze": {"output_partitioning": {"strategy": "auto", "min_partitions": 2}}, "quality": {"output_partitions": 3}})
    assert s.shuffle_partitions == 8 and s.bronze.partitions(1) == 2 and s.quality.partitions(1) == 3 and s.silver.partitions(1) is None


def test_paths(tmp_path):
    assert join_path("s3a://b/x/", "p", "t") == "s3a://b/x/p/t"
    assert join_path(str(tmp_path), "p") == str(tmp_path / "p")
