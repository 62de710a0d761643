"""Spark sessions for the engine."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution and fair shares; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName("flowscope").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.scheduler.mode", "FAIR")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return share_code(builder.getOrCreate())


def share_code(spark: SparkSession) -> SparkSession:
    """Python workers that start from now on find this package where it lies on the driver's path (clusters ship it with --py-files)."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark
