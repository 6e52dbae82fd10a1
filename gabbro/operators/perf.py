"""Measuring plans."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def measure(df: DataFrame) -> float:
    """Milliseconds for the whole plan, without a result to keep."""
    df.sparkSession.catalog.clearCache()
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - began) * 1000


def record(spark: SparkSession, scenario: str, variants: dict[str, DataFrame]) -> DataFrame:
    """(scenario, variant, duration_ms, rows_out) of variants that have to agree in rows."""
    rows = [(scenario, n, measure(df), df.count()) for n, df in variants.items()]
    if len({r[3] for r in rows}) > 1:
        raise ValueError(f"variants differ in rows: {rows}")
    return spark.createDataFrame(rows, "scenario string, variant string, duration_ms double, rows_out long")


def trend(measured: DataFrame, runs: int = 10) -> DataFrame:
    """The last run of each task against the mean of the runs before."""
    from pyspark.sql import Window

    w = Window.partitionBy("task").orderBy("started")
    last = Window.partitionBy("task").orderBy(F.col("started").desc())
    out = measured.withColumn("usual", F.avg("seconds").over(w.rowsBetween(-runs, -1))).withColumn("rn", F.row_number().over(last))
    return out.filter("rn = 1").select("task", "started", "seconds", "usual", (F.col("seconds") / F.nullif(F.col("usual"), F.lit(0.0))).alias("ratio"))


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)  # noqa: SLF001
