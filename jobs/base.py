"""What the jobs share: their config files, their command lines, and counts taken while rows are written."""

from __future__ import annotations

import argparse
import logging
import os
import tomllib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("plenaria.jobs")


def config(path: str) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)


def observed(df: DataFrame, **more) -> tuple[DataFrame, Observation]:
    """``df`` and the counts (rows and ``more``) that are taken while it is written."""
    counts = Observation(f"written-{uuid.uuid4().hex}")
    return df.observe(counts, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in more.items())), counts


def command_line(job: Callable, default: str, argv: list[str] | None = None) -> None:
    """Run ``job(spark, **settings)`` in a session of its own; settings are those of the config file, or those given
    as ``--set name=value``."""
    p = argparse.ArgumentParser(prog=job.__module__, description=job.__doc__)
    p.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), default))
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="instead of what the config file says")
    args = p.parse_args(argv)
    settings = config(args.config)
    for name, _, value in (s.partition("=") for s in args.set):
        old = settings.get(name)
        settings[name] = type(old)(value) if isinstance(old, int | float) else value
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName(job.__name__).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        job(spark, **settings)
    finally:
        spark.stop()
