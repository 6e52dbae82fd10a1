"""Structured Streaming flows: bronze files to tables, event-time windows, bounded deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, folder: str, fmt: str, schema: StructType | str, max_files: int | None = None, hints: dict[str, str] | None = None, **options) -> DataFrame:
    """New files of a folder as a stream, with their origin; hints override types of single columns."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if hints:
        kinds = StructType.fromDDL(", ".join(f"{c} {t}" for c, t in hints.items()))
        schema = StructType([next((h for h in kinds if h.name == f.name), f) for f in schema])
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).select("*", F.col("_metadata.file_path").alias("_source_file"), F.current_timestamp().alias("_ingested_at"))


def append_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes what is there, appends it and ends; a second run adds only files that came meanwhile."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def rows_in(q: StreamingQuery) -> int:
    return sum(p["numInputRows"] for p in q.recentProgress)


def tumbling(stream: DataFrame, at: str, size: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Counts by event-time window; rows later than `late` are no longer counted."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(stream: DataFrame, at: str, gap: str, by: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def dedup_recent(stream: DataFrame, key: str, at: str, within: str = "1 day") -> DataFrame:
    """The first row of each key; state is kept for `within` only."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def sliding(stream: DataFrame, at: str, size: str, every: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Counts by overlapping event-time windows."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size, every).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def interval_join(left: DataFrame, right: DataFrame, key: str, at: str, within: str, late: str = "400 days") -> DataFrame:
    """Rows of two streams with one key, the right one up to `within` later; the watermarks and the interval
    bound the state. Right columns are named right_*."""
    r = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns])
    near = F.expr(f"right_{at} >= {at} AND right_{at} <= {at} + interval {within}")
    return left.withWatermark(at, late).join(r.withWatermark(f"right_{at}", late), (F.col(key) == F.col(f"right_{key}")) & near)


def running_count(stream: DataFrame, key: str) -> DataFrame:
    """(key, n): rows of a key so far, whenever it grows; the state is one number a key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, batches, state: GroupState):
        import pandas as pd

        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "n": [n]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long", "n long", "update", GroupStateTimeout.NoTimeout)


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream of updates to the end of what is there; every micro-batch is a folder of its own, so a
    batch that is done again replaces itself."""
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def every(stream: DataFrame, path: str, checkpoint: str, interval: str) -> StreamingQuery:
    """A flow that goes on, a micro-batch each interval, until it is stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=interval).start()


def follow(table, each, checkpoint: str) -> StreamingQuery:
    """A stream over a versioned table: its source is the commit log, whose files never change, so every
    commit is taken once. each(rows, batch) gets the rows that the new appending commits added."""
    from gabbro.operators.store import APPENDING

    log = table.spark.readStream.schema("version long, op string, add array<string>").option("pathGlobFilter", "*.json").json(f"{table.path}/_log")

    def batch(commits: DataFrame, n: int) -> None:
        # versions of appending commits: as many as the log has new files
        for v in sorted(r["version"] for r in commits.filter(F.col("op").isin(*APPENDING)).select("version").collect()):
            each(table.added(v), n)

    q = log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
