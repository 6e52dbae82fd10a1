"""Tables laid out for their readers: partitions that a dimension's filter prunes at run time, buckets that meet
without a shuffle. Both are Spark's own, through its catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def laid_out(df: DataFrame, name: str, path: str, bucket_by: str, buckets: int, partition_by: Sequence[str] = ()) -> DataFrame:
    """Writes df as table `name` at `path`, partitioned and bucketed, sorted in buckets, and reads it. Rows are
    dealt by the bucket's own hash first, so a partition has one file a bucket, not one a bucket and task; a
    bucket is one task when it is joined, so take as many as the table has task-sized parts."""
    w = df.repartition(buckets, bucket_by).write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, bucket_by).sortBy(bucket_by)
    (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(name)
    return df.sparkSession.table(name)
