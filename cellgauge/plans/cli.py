"""Command line: ``python -m cellgauge.plans.cli run|stage|generate``."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from ..catalog import TABLES
from ..sources.session import create_session
from .config import Settings, load_config
from .graph import ENRICHED, parse_names
from .pipeline import STAGES, Pipeline, run_batch, run_stage


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cellgauge", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("run", "stage"):
        p = commands.add_parser(name)
        p.add_argument("--config", required=True)
        p.add_argument("--profile", required=name == "run")
        p.add_argument("--batch-id", required=name == "run")
        p.add_argument("--tables", help="comma-separated tables that changed")
        if name == "run":
            p.add_argument("--force-rerun", action="store_true")
        else:
            p.add_argument("--stage", choices=(*STAGES, "all"), required=True)
            p.add_argument("--clean-stage-output", action="store_true")
            p.add_argument("--source-tables", help="comma-separated source tables that changed, for silver")
            p.add_argument("--enriched-tables", help="comma-separated enriched tables that changed, for gold")
    g = commands.add_parser("generate")
    g.add_argument("--out", required=True)
    g.add_argument("--profile", default="tiny")
    g.add_argument("--messy", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "generate":
        from ..sources import generator

        spark = create_session()
        generator.write_profile(spark, args.out, args.profile, messy=args.messy)
        return 0
    tables = parse_names(args.tables, TABLES)
    if args.command == "run":
        result = run_batch(args.config, args.profile, args.batch_id, args.force_rerun, tables)
        print(json.dumps(result, indent=2, default=str))
        return int(result["status"] == "failed")
    settings = Settings.of(load_config(args.config))
    spark = create_session(settings.app_name, settings.master, settings.adaptive, settings.bundled_spark, settings.shuffle_partitions)
    try:
        pipeline = Pipeline(settings, args.profile or settings.default_profile, spark)
        tables = tables or (list(settings.default_tables) or None)
        sources, enriched = parse_names(args.source_tables, TABLES), parse_names(args.enriched_tables, ENRICHED, "enriched tables")
        for w in run_stage(pipeline, args.stage, args.batch_id or settings.default_batch, tables, args.clean_stage_output, sources, enriched):
            print(json.dumps(asdict(w)))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
