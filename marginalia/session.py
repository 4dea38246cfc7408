"""A session with the settings the plans are made for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | None = None, **conf: str) -> SparkSession:
    """The running session, or a local one.  On a cluster the master and memory come from its own settings;
    adaptive execution with skew handling is on everywhere."""
    b = SparkSession.builder.appName("marginalia")
    if not os.environ.get("SPARK_MASTER"):
        b = b.master(f"local[{cores or '*'}]").config("spark.sql.shuffle.partitions", str(cores or os.cpu_count() or 8))
    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
