"""Command line: python -m voxelith.plans.cli SAVE OUT [--config FILE] [--diagnose] [--fresh]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from voxelith.plans import params as p
from voxelith.plans.run import run
from voxelith.sources.world import diagnose


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="voxelith")
    parser.add_argument("save", nargs="?", help="folder of the world save")
    parser.add_argument("out", nargs="?", help="folder for the results")
    parser.add_argument("--config", help="JSON file of parameters")
    parser.add_argument("--diagnose", action="store_true", help="show the first chunks and stop")
    parser.add_argument("--fresh", action="store_true", help="forget earlier results")
    args = parser.parse_args(argv)
    chosen = {k: v for k, v in (("save_path", args.save), ("out_dir", args.out)) if v}
    params = p.read(args.config, **chosen) if args.config else p.Params(**chosen)
    if not params.save_path or not (args.diagnose or params.out_dir):
        parser.error("a save and an output folder are needed, as arguments or in the configuration")
    spark = SparkSession.builder.appName("voxelith").getOrCreate()
    if args.diagnose:
        diagnose(spark, params.save_path).show(truncate=False)
        return 0
    for stage, what in run(spark, params, args.fresh).items():
        print(f"{stage}: {what}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
