"""Data quality: checks as data, contract reports, expectations, rules over history, the gate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A scalar query `sql` whose value has to stand in the relation `op` to the threshold."""

    layer: str
    table: str
    name: str
    sql: str
    threshold: float
    op: str = "<="


OPS = {"<=": "value <= threshold", ">=": "value >= threshold", "=": "value = threshold", "<": "value < threshold", ">": "value > threshold"}


def run_checks(spark: SparkSession, checks: Sequence[Check], run_id: str) -> DataFrame:
    """(run_id, layer, table, name, value, threshold, op, passed): all checks in one plan, whose scalar
    subqueries Spark runs in parallel; a null value fails."""
    out = None
    for c in checks:
        row = spark.sql(f"SELECT cast(({c.sql}) AS double) AS value").select(
            F.lit(run_id).alias("run_id"), F.lit(c.layer).alias("layer"), F.lit(c.table).alias("table"), F.lit(c.name).alias("name"), "value", F.lit(float(c.threshold)).alias("threshold"), F.lit(c.op).alias("op")
        )
        row = row.withColumn("passed", F.coalesce(F.expr(OPS[c.op]), F.lit(False)))
        out = row if out is None else out.unionByName(row)
    return out


def contract_report(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, scope, violations, rate) of SQL conditions that each row should meet: one pass for all."""
    sums = df.agg(F.count("*").alias("_n"), *[F.count_if(~F.coalesce(F.expr(sql), F.lit(False))).alias(n) for n, sql in rules.items()])
    long = sums.unpivot(["_n"], list(rules), "rule", "violations")
    return long.select("rule", F.col("_n").alias("scope"), "violations", F.round(F.col("violations") / F.nullif(F.col("_n"), F.lit(0)), 6).alias("rate"))


def rescued_summary(**sources: tuple[DataFrame, str]) -> DataFrame:
    """(source, rows, kept_aside) for each (table, rescue or corrupt column)."""
    out = None
    for name, (df, column) in sources.items():
        row = df.agg(F.count("*").alias("rows"), F.count(column).alias("kept_aside")).withColumn("source", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("source", "rows", "kept_aside")


def volume_drop(now: DataFrame, before: DataFrame) -> DataFrame:
    """1 - rows now / rows before."""
    n, m = now.agg(F.count("*").alias("n")), before.agg(F.count("*").alias("m"))
    return n.join(F.broadcast(m), F.lit(True)).select("n", "m", (1 - F.col("n") / F.nullif(F.col("m"), F.lit(0))).alias("drop"))


def drift(metrics: DataFrame, runs: int = 7) -> DataFrame:
    """Each metric against the mean of its own earlier runs."""
    w = Window.partitionBy("name").orderBy("run_id").rowsBetween(-runs, -1)
    return metrics.withColumn("usual", F.avg("value").over(w)).withColumn("drift", F.col("value") / F.nullif(F.col("usual"), F.lit(0.0)))


class ExpectationFailed(RuntimeError):
    pass


class GateClosed(RuntimeError):
    pass


def gate(results: DataFrame) -> None:
    """Raises if a check failed: for use before anything is published."""
    bad = [r["name"] for r in results.filter("not passed").select("name").limit(20).collect()]
    if bad:
        raise GateClosed(f"failed checks: {bad}")
