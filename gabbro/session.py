"""Session defaults.

Everything here is a default for a session this library creates itself. A session handed in by the
caller (a cluster's) is never reconfigured.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",  # windows-1252 sources
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, app: str = "gabbro", driver_memory: str = "8g", **conf: str) -> SparkSession:
    """A local[cpus] session with the library's defaults; used by tests and the bench."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(cpus if isinstance(cpus, int) else 8),
        "spark.driver.memory": driver_memory,
        "spark.driver.host": "127.0.0.1",
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
