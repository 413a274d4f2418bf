"""Controls of event tables: known optional columns, latest record per key, late arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..catalog import INGESTED, LATE_HOURS, OPTIONAL_EVENT_COLUMNS, TABLES


def align_columns(df: DataFrame, names: tuple[str, ...] = OPTIONAL_EVENT_COLUMNS) -> DataFrame:
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def latest_per_key(df: DataFrame, key: str, event_time: str, ingested: str = INGESTED, flag: bool = True) -> DataFrame:
    """One row per key, the last ingested (then the last that happened).

    Equal times are settled by the other columns in the order of their names, so reruns
    agree.  Without the flag the rank alone lets Spark drop most rows before the shuffle.
    """
    ties = sorted(c for c in df.columns if not c.startswith("_"))
    order = [F.col(ingested).desc_nulls_last(), F.col(event_time).desc_nulls_last(), *ties]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    if flag:
        ranked = ranked.withColumn("_silver_was_deduplicated", F.count(F.lit(1)).over(Window.partitionBy(key)) > 1)
    return ranked.where("_rank = 1").drop("_rank")


def flag_late(df: DataFrame, event_time: str, ingested: str = INGESTED, hours: int = LATE_HOURS) -> DataFrame:
    """Hours from event to ingestion; late rows are marked, never dropped."""
    delay = F.round((F.unix_timestamp(ingested) - F.unix_timestamp(event_time)) / 3600, 3)
    return df.withColumns(
        {
            "_arrival_delay_hours": delay,
            "_late_arrival_threshold_hours": F.lit(hours),
            "_is_late_arriving": F.coalesce(delay > hours, F.lit(False)),
        }
    )


def control_events(df: DataFrame, table: str) -> DataFrame:
    spec = TABLES[table]
    return flag_late(latest_per_key(align_columns(df), spec.key, spec.event_time), spec.event_time)


def audit(df: DataFrame) -> DataFrame:
    """Rows, late rows and deduplicated rows of controlled events, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.col("_is_late_arriving").cast("int")), F.lit(0)).alias("late_rows"),
        F.coalesce(F.sum(F.col("_silver_was_deduplicated").cast("int")), F.lit(0)).alias("deduplicated_rows"),
    )
