"""Histories of dimensions: versions with validity intervals (type 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..catalog import BATCH, HISTORIES, History

# Fixed values.
OPEN_END, FIRST_DAY, MISSING = "9999-12-31", "1900-01-01", "<NULL>"
BATCH_DATE = r"(20\d{6})"


def with_record_hash(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns]
    return df.withColumn("_scd_record_hash", F.sha2(F.concat_ws("||", *parts), 256))


def with_valid_from(df: DataFrame, effective: str | None = None) -> DataFrame:
    """The effective column, else the date in the batch id, else the first day."""
    batch = F.try_to_timestamp(F.regexp_extract(F.col(BATCH), BATCH_DATE, 1), F.lit("yyyyMMdd")).cast("date")
    choices = [*([F.col(effective)] if effective else []), batch, F.lit(FIRST_DAY).cast("date")]
    return df.withColumn("_scd_valid_from", F.coalesce(*choices))


def build_history(df: DataFrame, spec: History, loaded_at: str | None = "_silver_loaded_at", collapse: bool = False) -> DataFrame:
    """Versions of each key with _scd_valid_from, _scd_valid_to, _scd_is_current.

    By default every distinct (key, hash, day) is a version.  ``collapse`` drops versions
    equal to the one before and keeps the last of several on one day.
    """
    tie = [loaded_at] if loaded_at and loaded_at in df.columns else []
    rows = with_valid_from(with_record_hash(df, spec.tracked), spec.effective)
    per = Window.partitionBy(spec.key).orderBy("_scd_valid_from", *tie, "_scd_record_hash")
    rows = rows.dropDuplicates([spec.key, "_scd_record_hash", "_scd_valid_from"])
    if collapse:
        day = Window.partitionBy(spec.key, "_scd_valid_from").orderBy(*[F.col(t).desc() for t in tie], F.col("_scd_record_hash").desc())
        rows = rows.withColumn("_n", F.row_number().over(day)).where("_n = 1").drop("_n")
        before = F.lag("_scd_record_hash").over(per)
        rows = rows.withColumn("_same", before.eqNullSafe(F.col("_scd_record_hash"))).where("not _same").drop("_same")
    following = F.lead("_scd_valid_from").over(per)
    return (
        rows.withColumn("_next", following)
        .withColumns(
            {
                "_scd_valid_to": F.coalesce(F.date_sub("_next", 1), F.lit(OPEN_END).cast("date")),
                "_scd_is_current": F.col("_next").isNull(),
                "_scd_loaded_at": F.current_timestamp(),
            }
        )
        .drop("_next")
    )


def build_histories(tables: dict[str, DataFrame], collapse: bool = False) -> dict[str, DataFrame]:
    return {name: build_history(tables[name], spec, collapse=collapse) for name, spec in HISTORIES.items() if name in tables}


def current_rows(df: DataFrame) -> DataFrame:
    """Current versions of a history; any other table as it is."""
    return df.where("_scd_is_current") if "_scd_is_current" in df.columns else df


def as_of(facts: DataFrame, history: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """Facts with the columns of the version that held on their day: an equi-join with a range, not a range join."""
    versions = history.select(F.col(key).alias("_k"), "_scd_valid_from", "_scd_valid_to", *columns)
    day = F.to_date(facts[time])
    held = (facts[key] == versions["_k"]) & (day >= versions["_scd_valid_from"]) & (day <= versions["_scd_valid_to"])
    return facts.join(versions, held, "left").drop("_k", "_scd_valid_from", "_scd_valid_to")


def history_metrics(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("_scd_is_current").cast("int")), F.lit(0)).alias("current_rows"))
