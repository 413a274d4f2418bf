"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset a temporary folder, but only of a session that runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cellgauge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each SparkContext, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_cellgauge_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(os.path.dirname(here))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="cellgauge-")), "cellgauge_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder in (os.path.dirname(here), here):
            for name in sorted(os.listdir(folder)):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), top))
    sc.addPyFile(path)
    sc._cellgauge_shipped = True


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session's setting for what is planned and run inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Written tables that cut lineage: a lost executor costs a reread, not a recomputation.

    Every SWEEP tables Spark's cleaner is let at what earlier plans left: their shuffle files, which
    otherwise lie on the executors' disks until the driver's heap is full, and their broadcasts.
    """

    SWEEP = 4

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.saved = 0
        ship(spark)
        self.root = f"{shared_folder(spark)}/{owner}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path, compression=compression)
        self.saved += 1
        if self.saved % self.SWEEP == 0:
            self.sweep()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def sweep(self) -> None:
        """Lets Spark's cleaner take the shuffle files and broadcasts of plans that nobody holds any more."""
        gc.collect()
        self.spark._jvm.java.lang.System.gc()

    def clear(self) -> None:
        """Deletes all tables, and what their plans left."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.sweep()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
