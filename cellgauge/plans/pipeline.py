"""The stages from raw files to KPIs, for one batch.

A stage builds lazy plans from the operators and hands them to sinks that replace what
they write, so any stage may run again.  What a run touches follows the graph: the tables
given, their parents, the enriched tables and KPIs they change, and for KPIs only the days
of the batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import BATCH, DIMENSIONS, EVENTS, HISTORIES, TABLES
from ..operators import controls, enrichment, history, kpis, quality
from ..sources.partitions import dealt, stored_bytes
from ..sources.session import create_session
from ..sources.storage import Store, with_bronze_columns
from . import graph
from .config import Settings, load_config
from .registry import COMPLETED, RunLog, plain


@dataclass(frozen=True)
class Written:
    """Rows are None where they were not counted."""

    stage: str
    table: str
    rows: int | None = None
    rejected: int | None = None
    late: int | None = None
    removed: int | None = None


class Pipeline:
    def __init__(self, settings: Settings, profile: str, spark: SparkSession):
        self.settings, self.profile, self.spark = settings, profile, spark
        self.store = Store(spark, settings.paths, profile)

    # Bronze
    def bronze(self, batch: str, tables: list[str] | None = None) -> list[Written]:
        out = []
        for name in graph.checked(tables or TABLES, TABLES):
            size = stored_bytes(self.spark, self.store.path("raw", name))
            df = with_bronze_columns(self.store.read_raw(name), name, self.profile, batch)
            rows = self.store.write(dealt(df, self.settings.bronze.partitions(size)), "bronze", name, (BATCH,))
            out.append(Written("bronze", name, rows if self.settings.count_bronze else None))
        return out

    # Quality
    def quality(self, batch: str | None = None, tables: list[str] | None = None) -> list[Written]:
        """Valid rows to silver, rejected rows with their reasons to quarantine; parents are judged first and kept."""
        wanted = graph.with_parents(tables or TABLES)
        done: dict[str, quality.Classified] = {}
        kept: list[DataFrame] = []
        out = []
        try:
            for name in wanted:
                parents = {p: done[p].valid for p in TABLES[name].parents}
                judged = quality.classify(self.store.read("bronze", name, batch), name, parents)
                # Judged once for both writes; a dimension stays for its children.
                judged = quality.Classified(name, judged.rows.persist())
                kept.append(judged.rows)
                done[name] = judged
                size = stored_bytes(self.spark, self.store.path("bronze", name))
                files = self.settings.quality.partitions(size)
                valid = self.store.write(dealt(judged.valid, files, BATCH), "silver", name, (BATCH,))
                rejected = self.store.write(dealt(judged.invalid, files, BATCH), "quarantine", name, (BATCH,))
                out.append(Written("quality", name, *((valid, rejected) if self.settings.count_quality else ())))
                if name not in DIMENSIONS:
                    kept.pop().unpersist()
        finally:
            for df in kept:
                df.unpersist()
        return out

    # Histories of dimensions
    def histories(self, tables: list[str] | None = None) -> list[Written]:
        out = []
        for name in graph.checked(tables or HISTORIES, HISTORIES):
            built = history.build_history(self.store.read("silver", name), HISTORIES[name])
            rows = self.store.write(built, "silver", f"{name}_scd2")
            if not rows:
                raise RuntimeError(f"{name} has no rows to build a history of")
            out.append(Written("scd2", name, rows))
        return out

    # Enriched events
    def silver(self, batch: str | None = None, sources: list[str] | None = None) -> list[Written]:
        dimensions = {d: self.store.read_dimension(d) for d in DIMENSIONS}
        star = enrichment.Star.of(dimensions)
        out = []
        for target in graph.affected_enriched(sources):
            name = target.removesuffix("_enriched")
            events = self.store.read("silver", name, batch)
            controlled = controls.control_events(events, name)
            size = stored_bytes(self.spark, self.store.path("silver", name))
            files = self.settings.silver.partitions(size)
            rows = self.store.write(dealt(star.enrich(controlled, name), files, "event_date", BATCH), "silver", target, ("event_date", BATCH))
            late = removed = None
            if self.settings.count_silver:
                seen = self.store.read("silver", target, batch).agg(F.count_if("_is_late_arriving").alias("late")).first()
                late, removed = seen["late"], events.count() - rows
            out.append(Written("silver", target, rows, late=late, removed=removed))
        return out

    # KPIs
    def gold(self, batch: str | None = None, enriched: list[str] | None = None) -> list[Written]:
        """With a batch only the days it changes are computed again, its own and those on which its records were counted
        before; they are few, so their list prunes partitions."""
        targets = graph.affected_kpis(enriched)
        if not targets:
            return []
        tables = {t: self.store.read("silver", t) for t in graph.kpi_sources(targets)}
        if batch is not None:
            changed = []
            for t in (t for t in (enriched or tables) if t in tables):
                key, own = TABLES[t.removesuffix("_enriched")].key, tables[t].where(F.col(BATCH) == F.lit(batch))
                before = tables[t].where(F.col(BATCH) != F.lit(batch)).join(own.select(key).distinct(), key, "left_semi")
                changed += [own, before]
            days = [r["event_date"] for r in kpis.affected_dates(changed).where("event_date IS NOT NULL").collect()]
            if not days:
                return []
            tables = {t: df.where(F.col("event_date").isin(days)) for t, df in tables.items()}
        tables = {t: self.latest(df, t.removesuffix("_enriched")) for t, df in tables.items()}
        persist = self.settings.persist_towers and {"tower_daily_kpis", "region_daily_kpis"} <= set(targets)
        built = kpis.build_kpis(tables, targets, persist)
        out = []
        for name, df in built.items():
            rows = self.store.write(df, "gold", name, ("event_date",))
            if self.settings.count_gold and not rows:
                raise RuntimeError(f"{name} has no rows")
            out.append(Written("gold", name, rows))
        if persist:
            built["tower_daily_kpis"].unpersist()
        return out

    @staticmethod
    def latest(df: DataFrame, name: str) -> DataFrame:
        """One row per key over all batches: a record delivered again counts once."""
        spec = TABLES[name]
        return controls.latest_per_key(df, spec.key, spec.event_time, flag=False)

    def network_events_quality(self, batch: str | None = None) -> Written:
        """The quality stage of network events alone, with the parents it needs."""
        return next(w for w in self.quality(batch, ["network_events"]) if w.table == "network_events")

    def run(self, batch: str, tables: list[str] | None = None, done: Callable[[str, list[Written]], None] = lambda name, results: None) -> dict[str, list[dict]]:
        """All stages; each is told to ``done`` when it ends."""
        stages: dict[str, list[Written]] = {}

        def step(name: str, results: list[Written]) -> list[Written]:
            stages[name] = results
            done(name, results)
            return results

        delivered = None if tables is None else graph.with_parents(tables)
        step("bronze", self.bronze(batch, delivered))
        step("quality", self.quality(batch, tables))
        step("scd2", self.histories([t for t in (delivered or HISTORIES) if t in HISTORIES]))
        written = step("silver", self.silver(batch, tables))
        step("gold", self.gold(batch, [w.table for w in written] if tables else None))
        return {name: plain(results) for name, results in stages.items()}


def run_batch(config: dict | str, profile: str, batch: str, force: bool = False, tables: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """One registered run of a batch: skipped if it was completed before, unless forced; a failure is recorded and returned."""
    settings = Settings.of(load_config(config) if isinstance(config, str) else config)
    log = RunLog(settings.registry_path)
    about = {"profile": profile, "batch_id": batch}
    if log.finished(profile, batch) and not force:
        return {"status": "skipped", "message": "this batch was completed before; force a rerun to run it again"} | about
    tables = None if tables is None else graph.checked(tables, TABLES)
    run_id = log.begin(profile, batch)
    own = spark is None
    try:
        spark = spark or create_session(settings.app_name, settings.master, settings.adaptive, settings.bundled_spark, settings.shuffle_partitions)
        Pipeline(settings, profile, spark).run(batch, tables, lambda name, results: log.stage(run_id, name, results))
        ended = log.end(run_id)
    except Exception as error:
        ended = log.end(run_id, error)
    finally:
        if own and spark is not None:
            spark.stop()
    out = {"status": ended["status"], "run_id": run_id, "registry_path": str(log.path), "stages": ended["stages"]} | about
    return out if ended["status"] == COMPLETED else out | {"error_message": ended["error_message"]}


STAGES = ("bronze", "quality", "scd2", "silver", "gold")


def run_stage(
    pipeline: Pipeline, stage: str, batch: str | None = None, tables: list[str] | None = None, clean: bool = False, sources: list[str] | None = None, enriched: list[str] | None = None
) -> list[Written]:
    """One stage or all, without the log; ``clean`` first deletes what the stage wrote for this profile.
    ``sources`` (for silver) and ``enriched`` (for gold) say what changed where the tables given do not."""
    if stage not in (*STAGES, "all"):
        raise ValueError(f"unknown stage: {stage}")
    store = pipeline.store
    if clean and stage != "all":
        for zone, names in {
            "bronze": {"bronze": list(TABLES)},
            "quality": {"silver": list(TABLES), "quarantine": list(TABLES)},
            "scd2": {"silver": [f"{d}_scd2" for d in DIMENSIONS]},
            "silver": {"silver": [f"{e}_enriched" for e in EVENTS]},
            "gold": {"gold": list(kpis.KPIS)},
        }[stage].items():
            for name in names:
                store.remove(zone, name)
    steps = {
        "bronze": lambda: pipeline.bronze(batch, graph.with_parents(tables) if tables else None),
        "quality": lambda: pipeline.quality(batch, tables),
        "scd2": lambda: pipeline.histories(),
        "silver": lambda: pipeline.silver(batch, sources or tables),
        "gold": lambda: pipeline.gold(batch, enriched or (graph.affected_enriched(sources or tables) if sources or tables else None)),
    }
    return [w for s in (STAGES if stage == "all" else (stage,)) for w in steps[s]()]
