"""How many files a table should have, from the size of its input."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MB = 1 << 20


@dataclass(frozen=True)
class FileTarget:
    """Limits for the number of files; ``strategy`` is none (leave it to Spark) or auto."""

    strategy: str = "auto"
    target_file_size_mb: int = 128
    min_partitions: int = 1
    max_partitions: int = 64
    tiny_file_threshold_mb: int | None = None
    tiny_file_partitions: int | None = None

    def __post_init__(self):
        if self.strategy.lower() not in ("none", "auto"):
            raise ValueError(f"Unsupported partition strategy: {self.strategy}")
        if self.strategy.lower() == "none":
            return
        for name in ("target_file_size_mb", "min_partitions"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be greater than zero")
        if self.max_partitions < self.min_partitions:
            raise ValueError("max_partitions must be at least min_partitions")
        if self.tiny_file_threshold_mb is not None and self.tiny_file_threshold_mb < 0:
            raise ValueError("tiny_file_threshold_mb must not be negative")
        if self.tiny_file_partitions is not None and self.tiny_file_partitions <= 0:
            raise ValueError("tiny_file_partitions must be greater than zero")

    def partitions(self, size: int | None) -> int | None:
        """None where the strategy or an unknown size leaves the number open."""
        if self.strategy.lower() == "none" or size is None:
            return None
        tiny = self.tiny_file_threshold_mb is not None and self.tiny_file_partitions is not None
        if tiny and size <= self.tiny_file_threshold_mb * MB:
            return min(self.tiny_file_partitions, self.max_partitions)
        wanted = -(-size // (self.target_file_size_mb * MB))
        return max(self.min_partitions, min(wanted, self.max_partitions))


def dealt(df: DataFrame, partitions: int | None, *by: str) -> DataFrame:
    """df as it should be written, planned without running anything.

    What is written by columns is rebalanced by them, so that a value's rows are in few files of the advisory size and a
    large value is split; what needs no shuffle is only put together.
    """
    if partitions is None:
        return df
    return df.hint("rebalance", *by) if by else df.coalesce(partitions)


def stored_bytes(spark: SparkSession, path: str) -> int | None:
    """Size of a file or folder wherever Hadoop can read it; None if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(files.getContentSummary(target).getLength()) if files.exists(target) else None
