"""Session set-up: the settings under which the engine's semantics hold."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app_name: str = "ledgerloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with AQE, UTC and two's complement (non-ANSI) integer arithmetic.

    ``master`` and every other setting that spark-submit has given stay as they are;
    only a local session gets a number of shuffle partitions that suits its cores.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.ansi.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    if master and master.startswith("local"):
        conf["spark.sql.shuffle.partitions"] = str(os.cpu_count() or 8)
        conf["spark.ui.enabled"] = "false"
    conf.update(extra)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
