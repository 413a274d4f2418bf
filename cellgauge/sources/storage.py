"""Paths, scans and sinks of the zones raw, bronze, silver, gold and quarantine.

Every partitioned sink overwrites the partitions it writes, so a rerun of a batch or a day
replaces it.  Row counts ride on the write as observations; they cost no further job.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..catalog import BATCH, TABLES

ZONES = ("raw", "bronze", "silver", "gold", "quarantine")
URI = re.compile(r"^[a-z][a-z0-9+.-]*://")


def join_path(base: str, *parts: str) -> str:
    """URIs are joined as text; local paths become absolute."""
    if URI.match(base):
        return "/".join([base.rstrip("/"), *(p.strip("/") for p in parts)])
    return str(Path(base).joinpath(*parts).resolve())


@dataclass(frozen=True)
class Store:
    """One profile's tables in all zones."""

    spark: SparkSession
    paths: dict[str, str]
    profile: str

    def path(self, zone: str, table: str) -> str:
        return join_path(self.paths[zone], self.profile, f"{table}.csv" if zone == "raw" else table)

    def read_raw(self, table: str) -> DataFrame:
        """CSV with a header under the fixed schema; a malformed cell fails the read."""
        reader = self.spark.read.option("header", True).option("mode", "FAILFAST")
        return reader.schema(TABLES[table].schema).csv(self.path("raw", table))

    def read(self, zone: str, table: str, batch: str | None = None) -> DataFrame:
        """Parquet; a batch is a filter on the partition column."""
        df = self.spark.read.parquet(self.path(zone, table))
        if "event_date" in df.columns:
            df = df.withColumn("event_date", F.col("event_date").cast("date"))
        return df if batch is None else df.where(F.col(BATCH) == F.lit(batch))

    def exists(self, zone: str, table: str) -> bool:
        try:
            self.spark.read.parquet(self.path(zone, table)).schema  # noqa: B018
            return True
        except AnalysisException:
            return False

    def read_dimension(self, table: str) -> DataFrame:
        """The history if there is one; else valid Silver, the latest row of each key."""
        if self.exists("silver", f"{table}_scd2"):
            return self.read("silver", f"{table}_scd2")
        df = self.read("silver", table)
        key = TABLES[table].key
        latest = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(BATCH, "_silver_loaded_at")).alias("row"))
        return latest.select(key, "row.*")

    def write(self, df: DataFrame, zone: str, table: str, by: tuple[str, ...] = ()) -> int:
        """Replaces the partitions that df has (or the table, without ``by``) and returns the rows written."""
        seen = Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
        if by:
            writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
        writer.parquet(self.path(zone, table))
        return seen.get["rows"]

    def remove(self, zone: str, table: str | None = None) -> None:
        """Deletes a table, or all of this profile's tables of a zone; nothing above the profile's own folder."""
        if not self.profile or not re.fullmatch(r"[\w.-]+", self.profile) or self.profile.strip(".") == "":
            raise ValueError(f"not a profile: {self.profile!r}")
        path = self.path(zone, table) if table else join_path(self.paths[zone], self.profile)
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def view(self, zone: str, table: str, name: str | None = None) -> str:
        name = name or f"{zone}_{table}"
        self.read(zone, table).createOrReplaceTempView(name)
        return name


def with_bronze_columns(df: DataFrame, table: str, profile: str, batch: str) -> DataFrame:
    return df.withColumns(
        {
            "_bronze_loaded_at": F.current_timestamp(),
            "_bronze_table": F.lit(table),
            "_dataset_profile": F.lit(profile),
            BATCH: F.lit(batch),
            "_source_format": F.lit("csv"),
        }
    )
