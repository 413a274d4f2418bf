"""Classification against rules, with keys and references looked up once each.

A duplicate count is a window over the key (no self-join) and a reference is a left join
with the parent's distinct keys.  No side carries a broadcast hint: Spark broadcasts one
that its statistics, or AQE's measured sizes, put under the session's threshold, and
else shuffles, so a dimension may outgrow memory.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..catalog import BATCH, TABLES, Table
from ..functions.rules import COUNT, FOUND, RULES, reasons

REASONS, VALID = "_rejection_reasons", "_is_quality_valid"


@dataclass(frozen=True)
class Classified:
    """One lazily classified table; ``valid`` and ``invalid`` are filters over it."""

    table: str
    rows: DataFrame

    @cached_property
    def valid(self) -> DataFrame:
        return self.rows.where(VALID).drop(REASONS, VALID).withColumn("_silver_loaded_at", F.current_timestamp())

    @cached_property
    def invalid(self) -> DataFrame:
        lineage = {"_quarantined_at": F.current_timestamp(), "_source_table": F.lit(self.table)}
        return self.rows.where(~F.col(VALID)).drop(VALID).withColumns(lineage)

    def counts(self) -> DataFrame:
        return self.rows.groupBy(VALID).count()


def with_key_count(df: DataFrame, key: str) -> DataFrame:
    """Rows that share the key within a batch; NULL for a NULL key."""
    per = [key, *([BATCH] if BATCH in df.columns else [])]
    return df.withColumn(COUNT + key, F.when(F.col(key).isNotNull(), F.count(F.lit(1)).over(Window.partitionBy(*per))))


def with_reference(df: DataFrame, parent: DataFrame, column: str, key: str) -> DataFrame:
    """The parent's key beside the column that refers to it, NULL if there is none.  Rows never multiply."""
    keys = parent.select(F.col(key).alias(FOUND + column)).where(F.col(FOUND + column).isNotNull()).distinct()
    return df.join(keys, F.col(column) == F.col(FOUND + column), "left")


def classify(df: DataFrame, table: Table | str, parents: dict[str, DataFrame]) -> Classified:
    """Reasons for every row; references go to the given parents."""
    table = TABLES[table] if isinstance(table, str) else table
    probed = df if table.is_event else with_key_count(df, table.key)
    for column, parent, key in table.references:
        probed = with_reference(probed, parents[parent], column, key)
    judged = probed.withColumn(REASONS, reasons(RULES[table.name])).withColumn(VALID, F.size(REASONS) == 0)
    return Classified(table.name, judged.select(*df.columns, REASONS, VALID))


def validate_network_events(events: DataFrame, towers: DataFrame, subscribers: DataFrame, devices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected network events against the given parents."""
    judged = classify(events, "network_events", {"towers": towers, "subscribers": subscribers, "devices": devices})
    return judged.valid, judged.invalid


def classify_all(tables: dict[str, DataFrame]) -> dict[str, Classified]:
    """All given tables in order, each against the valid rows of its parents (a rejected parent rejects its children)."""
    done: dict[str, Classified] = {}
    for name in TABLES:
        if name in tables:
            done[name] = classify(tables[name], name, {p: done[p].valid for p in TABLES[name].parents})
    return done


def reason_histogram(classified: dict[str, Classified]) -> DataFrame:
    """table_name, rejection_reason, count over all rejected rows."""
    parts = [
        c.rows.where(~F.col(VALID)).select(F.lit(c.table).alias("table_name"), F.explode(REASONS).alias("rejection_reason")) for c in classified.values()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("table_name", "rejection_reason").count()


def joined_reasons(column: str | Column = REASONS) -> Column:
    return F.concat_ws(",", column)
