"""Event controls on a stream: each micro-batch goes through the batch operators.

A watermark would drop late records and keep the first of duplicates; the controls flag
late records and keep the last, so they run in foreachBatch.  A batch's days are merged
with what the sink has for them and replaced, which makes a replayed batch harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..catalog import TABLES
from ..operators.controls import control_events, latest_per_key
from ..sources.storage import Store


def merge_days(store: Store, table: str) -> Callable[[DataFrame, int], None]:
    """Writes controlled events by day into silver/<table>_stream, the last record of each key winning."""
    spec, name = TABLES[table], f"{table}_stream"

    def merge(batch: DataFrame, _: int) -> None:
        new = control_events(batch, table).withColumn("event_date", F.to_date(spec.event_time)).persist()
        try:
            days = [r[0] for r in new.select("event_date").distinct().collect()]
            if not days:
                return
            if store.exists("silver", name):
                old = store.read("silver", name).where(F.col("event_date").isin(days))
                merged = latest_per_key(old.unionByName(new, allowMissingColumns=True), spec.key, spec.event_time, flag=False)
                # Written in full before the days it came from are replaced: no task reads what another one replaces.
                store.write(merged, "silver", f"{name}_staged")
                merged = store.read("silver", f"{name}_staged")
            else:
                merged = new
            store.write(merged, "silver", name, ("event_date",))
            store.remove("silver", f"{name}_staged")
        finally:
            new.unpersist()

    return merge


def control_stream(events: DataFrame, table: str, store: Store, checkpoint: str) -> DataStreamWriter:
    return events.writeStream.foreachBatch(merge_days(store, table)).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Tumbling counts under a watermark, for dashboards that may drop what is later."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("events"))
