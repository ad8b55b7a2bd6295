"""What the command lines share: logging, the config file, a session, and counting while writing."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("tessera.jobs")


def defaults(job: str) -> dict:
    """The settings in the config file beside the job."""
    return json.loads(Path(__file__).with_name(f"{job}.json").read_text(encoding="utf-8"))


def settings(job: str, own: dict | None) -> dict:
    """The job's settings with ``own`` in place of those that it names; a name that the job doesn't know is an error."""
    known = defaults(job)
    if unknown := set(own or {}) - set(known):
        raise ValueError(f"{job} has no setting {', '.join(sorted(unknown))}")
    return known | (own or {})


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` and its number of rows, counted while something else reads it: no pass of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def run(job: str, about: str, paths: list[str], work: Callable[..., object]) -> None:
    """The command line of a job: its paths, and a config file with settings. Only this makes and stops a session."""
    parser = argparse.ArgumentParser(description=about)
    for p in paths:
        parser.add_argument(p)
    parser.add_argument("--config", help=f"JSON file; without it jobs/{job}.json")
    found = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    own = json.loads(Path(found.config).read_text(encoding="utf-8")) if found.config else None
    spark = SparkSession.builder.appName(job).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        work(spark, *[getattr(found, p) for p in paths], own)
    finally:
        spark.stop()
