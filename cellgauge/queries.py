"""Every operator as a query over the driver's tables; ``oracle.py`` has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import testbed
from .catalog import DIMENSIONS, EVENTS, TABLES, History
from .functions.measures import safe_rate
from .functions.rules import Rule, at_least, known, one_of, reasons, required
from .operators import controls, enrichment, history, kpis, quality
from .questions import QUESTIONS, investigate_first
from .sources.storage import with_bronze_columns


def drop_times(df: DataFrame) -> DataFrame:
    """Without columns that hold the time of the run."""
    return df.drop("_silver_loaded_at", "_silver_enriched_at", "_gold_created_at", "_scd_loaded_at", "_quarantined_at", "_bronze_loaded_at")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def as_text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names if n in df.columns})


class Lake:
    """The layers over one folder of the driver's tables, each built lazily when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._classified: dict[str, quality.Classified] = {}
        self._valid: dict[str, DataFrame] = {}
        self._enriched: dict[str, DataFrame] = {}
        self._star: enrichment.Star | None = None

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def bronze(self, name: str) -> DataFrame:
        return testbed.bronze(self.spark, self.sf_dir, name)

    def classified(self, name: str) -> quality.Classified:
        if name not in self._classified:
            parents = {p: self.valid(p) for p in TABLES[name].parents}
            self._classified[name] = quality.classify(self.bronze(name), name, parents)
        return self._classified[name]

    def valid(self, name: str) -> DataFrame:
        """Valid rows; those of dimensions are kept, as all their children look them up."""
        if name not in self._valid:
            df = self.classified(name).valid
            self._valid[name] = df if TABLES[name].is_event else df.persist()
        return self._valid[name]

    def controlled(self, name: str) -> DataFrame:
        return controls.control_events(self.valid(name).drop("_silver_loaded_at"), name)

    def star(self) -> enrichment.Star:
        if self._star is None:
            self._star = enrichment.Star.of({d: self.valid(d) for d in DIMENSIONS})
        return self._star

    def enriched(self, name: str) -> DataFrame:
        if name not in self._enriched:
            star = self.star()
            self._enriched[name] = enrichment.enrich(self.controlled(name), name, star.towers, star.subscribers)
        return self._enriched[name]

    def tables(self, *events: str) -> dict[str, DataFrame]:
        return {f"{e}_enriched": self.enriched(e) for e in events or EVENTS}

    def named(self, name: str) -> DataFrame:
        """A table by the name that questions use."""
        if name in kpis.KPIS:
            needed = {"network_type_daily_kpis": ("network_events", "data_sessions"), "subscriber_segment_daily_kpis": ("calls", "data_sessions")}
            return kpis.build_kpis(self.tables(*needed.get(name, ())), [name])[name]
        if name.endswith("_enriched"):
            return self.enriched(name.removesuffix("_enriched"))
        if name.startswith("bronze_"):
            return self.bronze(name.removeprefix("bronze_"))
        rows = self.classified(name.removesuffix("_quarantine")).invalid
        return rows.withColumn("reasons", quality.joined_reasons())


# The driver's tables have a few events per tower and day, so its queries ask for less than the questions do by themselves.
SPARSE = {"q02_network_failures": 3, "q03_dropped_calls": 1, "q04_busy_and_weak": 3, "q07_region_dropped_calls": 2, "q11_segment_dropped_calls": 2}
PLAN_HISTORY = History("subscriber_id", ("plan_id", "subscriber_status"))


def _documents_quality(lake: Lake) -> DataFrame:
    rules: tuple[Rule, ...] = (
        *required("text"), *one_of("lang", ("de", "en", "es", "fr")), *at_least("n_chars", 20, "n_chars_too_low"), *known("doc_id"),
    )
    probed = quality.with_reference(lake.source("documents"), lake.source("labels"), "doc_id", "doc_id")
    return probed.select("doc_id", quality.joined_reasons(reasons(rules)).alias("reasons"))


def _cascade_counts(lake: Lake) -> DataFrame:
    parts = [
        lake.classified(t).rows.agg(F.count_if(quality.VALID).alias("valid"), F.count_if(~F.col(quality.VALID)).alias("invalid")).select(
            F.lit(t).alias("table_name"), "valid", "invalid"
        )
        for t in TABLES
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _fk_existence(lake: Lake) -> DataFrame:
    probed = quality.with_reference(lake.bronze("towers").where("region_id IS NOT NULL"), lake.valid("regions"), "region_id", "region_id")
    return probed.select("tower_id", "region_id", F.col("_ref_region_id").isNotNull().alias("known"))


def _point_in_time(lake: Lake) -> DataFrame:
    orders = lake.source("orders").select(
        "o_orderkey", F.concat(F.lit("SUB_"), F.col("o_custkey")).alias("subscriber_id"), F.expr("date_add(DATE '2026-08-01', CAST(o_orderkey % 30 AS INT))").alias("at")
    )
    versions = history.build_history(lake.bronze("plan_choices"), PLAN_HISTORY)
    return history.as_of(orders, versions, "subscriber_id", "at", ["plan_id"]).select("o_orderkey", "plan_id")


def _versions(lake: Lake, collapse: bool = False) -> DataFrame:
    return history.build_history(lake.bronze("plan_choices"), PLAN_HISTORY, collapse=collapse)


def _unsupported_networks(lake: Lake) -> DataFrame:
    extra = F.filter(F.split("supported_networks", r"\|"), lambda x: ~x.isin("4G", "5G", "LTE"))
    return lake.bronze("towers").select("tower_id", F.array_join(extra, "|").alias("unsupported"))


def _reasons_of(table: str) -> Callable[[Lake], DataFrame]:
    return lambda lake: lake.classified(table).rows.select(TABLES[table].key, quality.joined_reasons().alias("reasons"))


def _affected(lake: Lake) -> DataFrame:
    days = [F.lit(d).cast("date") for d in ("1997-05-28", "1998-10-03", "1999-01-16")]
    return kpis.calls_tower_daily(lake.enriched("calls").where(F.col("event_date").isin(*days))).select("event_date", "tower_id", "total_calls")


ON_LAKE: dict[str, Callable[[Lake], DataFrame]] = {
    "scan_project": lambda l: l.source("lineitem").where("l_quantity > 45").select("l_orderkey", (F.col("l_quantity") * F.col("l_extendedprice")).alias("gross")),
    "batch_partition_filter": lambda l: l.bronze("network_events").where(F.col("batch_id") == F.lit("B_20260808")).select("event_id", "tower_id", "batch_id"),
    "affected_date_filter": _affected,
    "bronze_metadata": lambda l: drop_times(with_bronze_columns(l.bronze("regions"), "regions", "testbed", "B_20260801")),
    "safe_rate": lambda l: l.source("orders")
    .groupBy("o_custkey")
    .agg(safe_rate(F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderpriority") == "1-URGENT")).alias("rate")),
    "event_date_parts": lambda l: enrichment.date_parts(l.source("events").select("event_id", "ts"), "ts").drop("ts"),
    "schema_align": lambda l: controls.align_columns(l.bronze("network_events")).select("event_id", "source_system", "producer_schema_version"),
    "record_hash": lambda l: history.with_record_hash(l.bronze("plan_choices"), PLAN_HISTORY.tracked).select("subscriber_id", "_pipeline_batch_id", "_scd_record_hash"),
    "array_except_rule": _unsupported_networks,
    "duplicate_key_count": lambda l: quality.with_key_count(l.bronze("regions"), "region_id").select("region_id", F.col("_count_region_id").alias("copies")),
    "fk_existence_check": _fk_existence,
    "fk_orphans_anti": lambda l: l.bronze("towers").join(l.valid("regions").select("region_id"), "region_id", "left_anti").select("tower_id", "region_id"),
    **{f"quality_{t}": _reasons_of(t) for t in TABLES},
    "quality_valid_split": lambda l: drop_times(l.valid("network_events")),
    "quality_quarantine": lambda l: l.classified("calls").invalid.select(
        "call_id", "subscriber_id", "tower_id", quality.joined_reasons().alias("reasons"), "_source_table"
    ),
    "quality_counts": lambda l: l.classified("network_events").counts(),
    "quality_cascade_counts": _cascade_counts,
    "rejection_reason_summary": lambda l: quality.reason_histogram({t: l.classified(t) for t in TABLES}),
    "dedup_latest": lambda l: l.controlled("network_events").select("event_id", "source_file", "tower_id", "_silver_was_deduplicated"),
    "late_arrival": lambda l: l.controlled("calls").select("call_id", "_arrival_delay_hours", "_is_late_arriving"),
    "silver_controls": lambda l: l.controlled("data_sessions").select(
        "session_id", "_silver_was_deduplicated", "_arrival_delay_hours", "_late_arrival_threshold_hours", "_is_late_arriving", "source_system"
    ),
    "silver_audit_metrics": lambda l: controls.audit(l.controlled("network_events")),
    "ctx_tower_region": lambda l: l.star().towers,
    "ctx_subscriber_device_plan": lambda l: l.star().subscribers,
    # A nullable integer goes out as text, so that the two engines' clients show it alike.
    **{f"enrich_{t}": (lambda l, t=t: as_text(drop_times(l.enriched(t)), "priority_level", "monthly_data_limit_gb", "release_year")) for t in EVENTS},
    "scd2_valid_from": lambda l: history.with_valid_from(l.bronze("plan_choices")).select("subscriber_id", "_pipeline_batch_id", "_scd_valid_from"),
    "scd2_dimension": lambda l: _versions(l).select("subscriber_id", "plan_id", "_scd_record_hash", "_scd_valid_from", "_scd_valid_to", "_scd_is_current"),
    "scd2_collapsed": lambda l: _versions(l, True).select("subscriber_id", "plan_id", "_scd_valid_from", "_scd_valid_to", "_scd_is_current"),
    "scd2_current": lambda l: history.current_rows(_versions(l)).select("subscriber_id", "plan_id", "subscriber_status"),
    "scd2_metrics": lambda l: history.history_metrics(_versions(l)),
    "scd2_point_in_time_join": _point_in_time,
    "network_event_tower_daily": lambda l: rounded(kpis.network_tower_daily(l.enriched("network_events")), "avg_network_latency_ms", "avg_signal_strength_dbm"),
    "calls_tower_daily": lambda l: rounded(kpis.calls_tower_daily(l.enriched("calls")), "avg_call_duration_seconds"),
    "sessions_tower_daily": lambda l: rounded(kpis.sessions_tower_daily(l.enriched("data_sessions")), "avg_session_latency_ms", "total_data_mb"),
    "alarms_tower_daily": lambda l: kpis.alarms_tower_daily(l.enriched("tower_alarms")),
    "tower_daily_kpis": lambda l: rounded(
        drop_times(l.named("tower_daily_kpis")), "avg_network_latency_ms", "avg_signal_strength_dbm", "avg_call_duration_seconds", "avg_session_latency_ms", "total_data_mb"
    ),
    "region_daily_kpis": lambda l: drop_times(l.named("region_daily_kpis")),
    "network_type_daily_kpis": lambda l: rounded(
        drop_times(l.named("network_type_daily_kpis")), "avg_network_latency_ms", "avg_signal_strength_dbm", "avg_session_latency_ms"
    ),
    "subscriber_segment_daily_kpis": lambda l: drop_times(l.named("subscriber_segment_daily_kpis")),
    "affected_event_dates": lambda l: kpis.affected_dates([l.enriched("calls"), l.enriched("data_sessions")]),
    "documents_quality": _documents_quality,
    "documents_duplicate_hash": lambda l: l.source("documents")
    .groupBy(F.sha2("text", 256).alias("hash"))
    .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))
    .where("copies > 1"),
    "q15_investigate_first": lambda l: investigate_first({n: l.named(n) for n in ("tower_daily_kpis", "region_daily_kpis")}),
    **{name: (lambda l, name=name, q=q: q.answer({q.table: l.named(q.table)}, SPARSE.get(name))) for name, q in QUESTIONS.items()},
}


def _on(build: Callable[[Lake], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Lake(spark, sf_dir))


QUERIES = {name: _on(build) for name, build in ON_LAKE.items()}
