"""The Spark session the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def create_session(
    app_name: str = "cellgauge", master: str | None = None, adaptive: bool = True, bundled_spark: bool = False, shuffle_partitions: int | None = None
) -> SparkSession:
    """UTC dates whatever the host's zone, adaptive plans, sinks that replace only the partitions they write.

    ``bundled_spark`` ignores another installation named by SPARK_HOME.
    """
    if bundled_spark:
        os.environ.pop("SPARK_HOME", None)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": str(adaptive).lower(),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=conf).getOrCreate()
