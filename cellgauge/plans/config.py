"""Settings of a run, from YAML or a dict."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from ..sources.partitions import FileTarget


def load_config(path: str | Path) -> dict[str, Any]:
    import yaml

    return yaml.safe_load(Path(path).read_text())


def _target(section: dict[str, Any], default: str, fallback: int | None = None) -> FileTarget:
    given = dict(section.get("output_partitioning") or {})
    if not given:
        return FileTarget(default, min_partitions=fallback or 1, max_partitions=max(64, fallback or 1)) if default == "auto" else FileTarget("none")
    return FileTarget(**given)


@dataclass
class Settings:
    app_name: str = "cellgauge"
    master: str | None = None
    adaptive: bool = True
    bundled_spark: bool = True
    shuffle_partitions: int | None = None
    paths: dict[str, str] = field(default_factory=dict)
    registry_path: str = "registry/batches.json"
    bronze: FileTarget = FileTarget("none")
    quality: FileTarget = FileTarget("none")
    silver: FileTarget = FileTarget("none")
    persist_towers: bool = False
    count_bronze: bool = False
    count_quality: bool = True
    count_silver: bool = True
    count_gold: bool = True
    default_profile: str | None = None
    default_batch: str | None = None
    default_tables: tuple[str, ...] = ()

    @classmethod
    def of(cls, config: dict[str, Any]) -> "Settings":
        spark, audit, dev = (config.get(k) or {} for k in ("spark", "audit", "dev_workflow"))
        quality = config.get("quality") or {}
        return cls(
            app_name=spark.get("app_name", cls.app_name),
            master=spark.get("master"),
            adaptive=bool(spark.get("adaptive_query_execution", True)),
            bundled_spark=bool(spark.get("use_pyspark_package", True)),
            shuffle_partitions=spark.get("shuffle_partitions"),
            paths=dict(config["paths"]),
            registry_path=(config.get("incremental") or {}).get("registry_path", cls.registry_path),
            bronze=_target(config.get("bronze") or {}, "none"),
            quality=_target(quality, "auto" if quality.get("output_partitions") else "none", quality.get("output_partitions")),
            silver=_target(config.get("silver") or {}, "none"),
            persist_towers=bool((config.get("gold") or {}).get("persist_tower_daily_for_region", False)),
            count_bronze=bool(audit.get("count_bronze_inputs", False)),
            count_quality=bool(audit.get("count_quality_outputs", True)),
            count_silver=bool(audit.get("count_silver_outputs", True)),
            count_gold=bool(audit.get("count_gold_outputs", True)),
            default_profile=dev.get("default_profile"),
            default_batch=dev.get("default_batch_id"),
            default_tables=tuple(dev.get("default_affected_tables") or ()),
        )
