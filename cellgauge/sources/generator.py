"""Generated telecom extracts: clean tables, planted bad and late rows, dimension changes.

Every value is a hash of the row's number, the column and a seed, so tables of any size are
generated in parallel and come out alike wherever they run.  Nothing is listed that the
engine knows already: values come from the enumerations of the quality rules, planted rows
break those rules one by one, and dimension changes touch the columns that histories track.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..catalog import DIMENSIONS, HISTORIES, TABLES
from ..functions import rules as R
from .storage import join_path

SEED = 42
START = "2026-08-01 00:00:00"
CHANGED_ON = "2026-08-15"
DAYS = 7
# Rows of each profile, rows planted into each table, hours by which the late ones are late.
PROFILES = {
    "tiny": dict(regions=8, towers=80, service_plans=6, subscribers=5_000, devices=5_500, network_events=50_000, calls=20_000, data_sessions=30_000, tower_alarms=800),
    "medium": dict(regions=8, towers=240, service_plans=6, subscribers=25_000, devices=30_000, network_events=250_000, calls=100_000, data_sessions=150_000, tower_alarms=4_000),
    "development": dict(regions=8, towers=480, service_plans=6, subscribers=50_000, devices=60_000, network_events=500_000, calls=200_000, data_sessions=300_000, tower_alarms=8_000),
}
PLANTED_ROWS = dict(regions=3, service_plans=3, towers=4, subscribers=4, devices=4, network_events=7, calls=6, data_sessions=6, tower_alarms=6)
LATE_BY = dict(network_events=49, calls=50, data_sessions=51, tower_alarms=52)
KEYS = dict(regions="R", service_plans="P", towers="T", subscribers="S", devices="D", network_events="E", calls="C", data_sessions="U", tower_alarms="A")


class Draw:
    """Values of one table's columns for the row in ``id``."""

    def __init__(self, table: str, size: dict[str, int], seed: int):
        self.table, self.size, self.seed = table, size, seed

    def below(self, name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(self.table), F.lit(name), F.col("id")), F.lit(n))

    def span(self, name: str, low: int, high: int) -> Column:
        return self.below(name, high - low + 1) + low

    def of(self, name: str, values: tuple[str, ...]) -> Column:
        """The first values are the most frequent: value i of n comes with a weight of n - i."""
        ranks = [i for i in range(len(values)) for _ in range(len(values) - i)]
        return F.element_at(F.array(*[F.lit(values[i]) for i in ranks]), (self.below(name, len(ranks)) + 1).cast("int"))

    def often(self, name: str, percent: int) -> Column:
        return self.below(name, 100) < percent

    def key(self, table: str | None = None, row: Column | None = None) -> Column:
        """The key of a row of a table, of any row by default."""
        table = table or self.table
        row = self.below(table, self.size[table]) if row is None else row
        return F.concat(F.lit(KEYS[table]), F.lpad((row + 1).cast("string"), 8, "0"))

    def name(self, kind: str, row: Column) -> Column:
        return F.concat(F.lit(kind + " "), (row + 1).cast("string"))

    def moment(self) -> Column:
        return after(F.lit(START), self.below("moment", DAYS * 86_400))

    def day(self) -> Column:
        return F.date_sub(F.lit(START).cast("date"), self.span("day", 30, 2000).cast("int"))


def after(time: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(time) + seconds)


def _regions(d: Draw) -> dict[str, Column]:
    row = F.col("id")
    place = {c: d.name(c.title(), row) for c in ("country", "state", "city", "zone")}
    return place | {"country": F.lit("Testland"), "zone": d.name("Zone", row % 4), "region_name": d.name("Region", row), "region_type": d.of("type", R.REGION_TYPES), "timezone": F.lit("UTC"), "is_active": F.lit(True)}


def _service_plans(d: Draw) -> dict[str, Column]:
    row = F.col("id")
    kind = F.element_at(F.array(*map(F.lit, R.PLAN_TYPES)), (row % len(R.PLAN_TYPES) + 1).cast("int"))
    limits = {"monthly_data_limit_gb": (row + 1) * 40, "voice_limit_minutes": row * 900, "monthly_price": row * 250 + 150, "priority_level": row % 5 + 1}
    return limits | {"plan_name": d.name("Plan", row), "plan_type": kind, "is_5g_enabled": row % 2 == 1}


def _towers(d: Draw) -> dict[str, Column]:
    return {
        "region_id": d.key("regions"), "tower_name": d.name("Tower", F.col("id")), "city": d.name("City", d.below("regions", d.size["regions"])), "latitude": d.span("lat", -8000, 8000) / 100,
        "longitude": d.span("lon", -17000, 17000) / 100, "tower_type": d.of("type", R.TOWER_TYPES), "supported_networks": F.when(d.often("5g", 60), "|".join(R.NETWORKS)).otherwise("|".join(n for n in R.NETWORKS if n != "5G")),
        "capacity_score": d.span("capacity", 20, 100), "activation_date": d.day(), "tower_status": d.of("status", R.TOWER_STATUSES[:2]),
    }


def _subscribers(d: Draw) -> dict[str, Column]:
    return {
        "home_region_id": d.key("regions"), "plan_id": d.key("service_plans"), "activation_date": d.day(), "subscriber_status": d.of("status", R.SUBSCRIBER_STATUSES),
        "customer_segment": d.of("segment", ("consumer", "student", "professional", "enterprise", "iot")), "age_band": d.of("age", ("18-25", "26-35", "36-50", "51-65", "65+")),
    }


def _devices(d: Draw) -> dict[str, Column]:
    # The first device of a subscriber has the subscriber's number.
    owner = F.when(F.col("id") < d.size["subscribers"], F.col("id")).otherwise(d.below("owner", d.size["subscribers"]))
    return {
        "subscriber_id": d.key("subscribers", owner), "manufacturer": d.name("Maker", d.below("maker", 6)), "model": d.name("Model", d.below("model", 50)), "os_type": d.of("os", R.OS_TYPES),
        "supports_5g": d.often("5g", 60), "release_year": d.span("year", 2016, 2026), "device_status": d.of("status", R.DEVICE_STATUSES),
    }


def _used(d: Draw) -> dict[str, Column]:
    who = d.below("who", d.size["subscribers"])
    return {"subscriber_id": d.key("subscribers", who), "device_id": d.key("devices", who), "tower_id": d.key("towers"), "network_type": d.of("net", R.NETWORKS)}


CAUSES = ("weak_signal", "congestion", "timeout", "tower_fault")


def _network_events(d: Draw) -> dict[str, Column]:
    kind = d.of("type", R.NETWORK_EVENT_TYPES)
    failed = (kind == "network_failure") | d.often("fails", 4)
    return _used(d) | {
        "event_timestamp": d.moment(), "event_type": kind, "signal_strength_dbm": d.span("dbm", -118, -52), "latency_ms": d.span("ms", 8, 220), "status": F.when(failed, "failed").otherwise("success"),
        "error_code": F.when(failed, F.upper(d.of("cause", CAUSES))),
    }


def _lasting(d: Draw, first: str, status: str, statuses: tuple[str, ...], reason: str) -> dict[str, Column]:
    """Columns of what has a start, an end and a status with a reason."""
    seconds = d.span("seconds", 3, 5400)
    state = F.when(d.often("good", 90), "completed").otherwise(d.of("state", statuses[1:]))
    times = {f"{first}_start_timestamp": d.moment(), f"{first}_end_timestamp": after(d.moment(), seconds), "duration_seconds": seconds}
    return times | {status: state, reason: F.when(state != "completed", d.of("cause", CAUSES))}


def _calls(d: Draw) -> dict[str, Column]:
    return _used(d) | _lasting(d, "call", "call_status", R.CALL_STATUSES, "drop_reason") | {"call_type": d.of("type", R.CALL_TYPES)}


def _data_sessions(d: Draw) -> dict[str, Column]:
    amounts = {"bytes_uploaded": d.below("up", 40_000_000), "bytes_downloaded": d.below("down", 600_000_000), "latency_ms": d.span("ms", 8, 180)}
    return _used(d) | _lasting(d, "session", "session_status", R.SESSION_STATUSES, "failure_reason") | amounts


def _tower_alarms(d: Draw) -> dict[str, Column]:
    kind, solved = d.of("type", R.ALARM_TYPES), d.often("solved", 85)
    return {
        "tower_id": d.key("towers"), "alarm_timestamp": d.moment(), "alarm_type": kind, "severity": d.of("severity", R.SEVERITIES), "alarm_status": F.when(solved, "resolved").otherwise("open"),
        "resolved_timestamp": F.when(solved, after(d.moment(), d.span("for", 300, 20_000))), "description": F.concat(F.lit("alarm: "), kind),
    }


MAKERS: dict[str, Callable[[Draw], dict[str, Column]]] = {
    "regions": _regions, "service_plans": _service_plans, "towers": _towers, "subscribers": _subscribers, "devices": _devices,
    "network_events": _network_events, "calls": _calls, "data_sessions": _data_sessions, "tower_alarms": _tower_alarms,
}


def clean_tables(spark: SparkSession, profile: str | dict[str, int] = "tiny", seed: int = SEED, batch: str = "BATCH_20260801_001") -> dict[str, DataFrame]:
    size = PROFILES[profile] if isinstance(profile, str) else profile
    out = {}
    for name, spec in TABLES.items():
        d = Draw(name, size, seed)
        made = MAKERS[name](d) | {spec.key: d.key(row=F.col("id"))}
        if spec.is_event:
            delay = F.when(d.often("slow", 5), d.span("long", 3_600, 20_000)).otherwise(d.span("short", 30, 900))
            made |= {"ingestion_timestamp": after(made[spec.event_time], delay), "batch_id": F.lit(batch), "source_file": F.lit(f"{name}.csv"), "schema_version": F.lit("v1")}
        out[name] = spark.range(size[name]).select(*[made[f.name].cast(f.dataType).alias(f.name) for f in spec.schema.fields])
    return out


# How a predicate of the rules is met: the first pattern that it matches gives the values to set.
BREAKS: tuple[tuple[str, Callable[[re.Match], dict[str, Column]]], ...] = (
    (r"_count_\w+ > 1", lambda m: {}),
    (r"_ref_(\w+) IS NULL", lambda m: {m[1]: F.lit("unheard of")}),
    (r"(\w+) <> '(\w+)' AND \((\w+) IS NULL", lambda m: {m[1]: F.lit("failed"), m[3]: F.lit(None)}),
    (r"(\w+) = '(\w+)' AND (\w+) IS NULL", lambda m: {m[1]: F.lit(m[2]), m[3]: F.lit(None)}),
    (r"\((\w+) IS NULL OR trim", lambda m: {m[1]: F.lit(" ")}),
    (r"(\w+) IS NULL", lambda m: {m[1]: F.lit(None)}),
    (r"(\w+) NOT IN", lambda m: {m[1]: F.lit("unsupported")}),
    (r"split\((\w+),", lambda m: {m[1]: F.lit("4G|other")}),
    (r"(\w+) < (-?[\d.]+)", lambda m: {m[1]: F.lit(float(m[2]) - 1)}),
    (r"(\w+) > (-?[\d.]+)", lambda m: {m[1]: F.lit(float(m[2]) + 1)}),
    (r"(\w+) < (\w+)", lambda m: {m[1]: after(F.col(m[2]), F.lit(-3600))}),
)


def breaking(rule: R.Rule) -> dict[str, Column]:
    """Values that make a valid row break a rule."""
    return next(values(m) for pattern, values in BREAKS if (m := re.search(pattern, rule.rejects)))


def cases(table: str, rows: int | None = None) -> list[tuple[str, dict[str, Column]]]:
    """(what it is, values to set) of the rows to plant: the late row of an event table, then one row per rule, of
    which ``rows`` in all are taken at even distances."""
    spec, hours = TABLES[table], LATE_BY.get(table)
    broken = [(rule.reason, breaking(rule)) for rule in R.RULES[table]]
    late = [("late", {"ingestion_timestamp": after(F.col(spec.event_time), F.lit(hours * 3600))})] if hours else []
    if rows is not None:
        keep = rows - len(late)
        broken = [broken[1 + i * (len(broken) - 1) // keep] for i in range(keep)]
    return late + broken


def plant(tables: dict[str, DataFrame], rows: dict[str, int] | None = PLANTED_ROWS) -> dict[str, DataFrame]:
    """The tables with bad and late rows added, each a changed copy of another clean row; without ``rows`` one for every rule."""
    out = {}
    for name, df in tables.items():
        spec, todo = TABLES[name], cases(name, rows and rows[name])
        kinds = {f.name: f.dataType for f in spec.schema.fields}
        donors = [r[0] for r in df.select(spec.key).orderBy(F.xxhash64(spec.key), spec.key).limit(len(todo)).collect()]
        for i, (what, values) in enumerate(todo):
            row = tables[name].where(F.col(spec.key) == donors[i % len(donors)])
            fresh = {} if what == f"{spec.key}_duplicate" else {spec.key: F.lit(f"{KEYS[name]}-{what}")}
            df = df.unionByName(row.withColumns({c: v.cast(kinds[c]) for c, v in (fresh | values).items()}))
        out[name] = df
    return out


def changed_columns(table: str) -> list[str]:
    """Tracked columns of a history that may take a new value freely: no reference, no enumeration, no bounds."""
    spec, bound = TABLES[table], " ".join(r.rejects for r in R.RULES[table] if "trim" not in r.rejects and not r.rejects.endswith("IS NULL"))
    kinds = {f.name: f.dataType for f in spec.schema.fields}
    free = [c for c in HISTORIES[table].tracked if c not in {r[0] for r in spec.references} and not re.search(rf"\b{c}\b", bound)]
    return [c for c in free if isinstance(kinds[c], (T.StringType, T.BooleanType))]


def change_dimensions(tables: dict[str, DataFrame], on: str = CHANGED_ON) -> dict[str, DataFrame]:
    """The tables with the row of the smallest key of each dimension changed as of a day."""
    out = dict(tables)
    for name in DIMENSIONS:
        spec, df = TABLES[name], tables[name]
        kinds = {f.name: f.dataType for f in spec.schema.fields}
        new = {c: ~F.col(c) if isinstance(kinds[c], T.BooleanType) else F.concat(c, F.lit(" changed")) for c in changed_columns(name)}
        new |= {c: F.lit(on).cast("date") for c, kind in kinds.items() if isinstance(kind, T.DateType)}
        mine = F.col(spec.key) == df.agg(F.min(spec.key)).first()[0]
        out[name] = df.where(~mine).unionByName(df.where(mine).withColumns(new))
    return out


def write_raw(tables: dict[str, DataFrame], base: str, profile: str) -> None:
    """CSV with a header, as the raw zone holds it."""
    for name, df in tables.items():
        path = join_path(base, profile, f"{name}.csv")
        df.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def write_profile(spark: SparkSession, base: str, profile: str, messy: bool = False) -> str:
    tables = clean_tables(spark, profile)
    name = f"{profile}_messy" if messy else profile
    write_raw(plant(tables) if messy else tables, base, name)
    return name
