"""What the jobs share: config files and the command line."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def command_line(name: str, config: str, paths: dict[str, str], run: Callable[..., dict], argv: list[str] | None = None) -> dict:
    """Parses paths (name: help) and --config, makes a session, runs the job and stops the session."""
    parser = argparse.ArgumentParser(name)
    for path, told in paths.items():
        parser.add_argument(f"--{path}", required=True, help=told)
    parser.add_argument("--config", default=str(Path(__file__).with_name(config)), help="settings as JSON")
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        settings = json.loads(spark.read.text(given.pop("config"), wholetext=True).first().value)
        return run(spark, **{k.replace("-", "_"): v for k, v in given.items()}, **settings)
    finally:
        spark.stop()
