"""Keyed state that ends: sessions closed by event-time timers, a change feed with high-water marks and
tombstones that expire.

Both are stateful processors of Spark (transformWithState). Its state store has to be RocksDB: `run` sets that
for the stream it starts and sets the session back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _set(spark: SparkSession, **conf: str):
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Takes what is there and ends. Each micro-batch is a folder of its own that a second attempt replaces, so
    a batch done again after a failure counts once. In append mode a last batch without rows lets timers behind
    the watermark fire; state in processing time (update mode) would ask for such batches for ever."""
    with _set(stream.sparkSession, **{PROVIDER: ROCKS, IDLE: str(mode == "append").lower()}):
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return q


# ---------------------------------------------------------------- sessions


class Sessions(StatefulProcessor):
    """Open sessions of a key: a map from the start of each to its end, its number of rows and the first time of
    each step; a timer at the end of the first of them, plus `gap`, closes what the watermark has passed. Rows may come in
    any order within the watermark: a row that lies between two sessions makes them one."""

    def __init__(self, gap_ms: int, steps: Sequence[str]):
        self.gap, self.steps = gap_ms, list(steps)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start long", "end long, n long, firsts array<long>")

    def _expiry(self, end_us: int) -> int:
        return end_us // 1000 + self.gap + 1

    def _timer(self, was: dict, now: dict) -> None:
        """One timer a key, for the session that ends first."""
        old, new = (min((self._expiry(end) for end, _, _ in x.values()), default=None) for x in (was, now))
        if old != new and old is not None:
            self.handle.deleteTimer(old)
        if old != new and new is not None:
            self.handle.registerTimer(new)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        was = {k[0]: tuple(v) for k, v in self.open.iterator()}
        parts = [(start, end, n, list(firsts)) for start, (end, n, firsts) in was.items()]
        for r in rows:
            parts.append((r["at"], r["at"], 1, [r["at"] if r["step"] == s else -1 for s in self.steps]))
        merged: list[tuple] = []
        for start, end, n, firsts in sorted(parts):
            if merged and start - merged[-1][1] <= self.gap * 1000:
                a, b, m, f = merged[-1]
                merged[-1] = (a, max(b, end), m + n, [max(x, y) if min(x, y) < 0 else min(x, y) for x, y in zip(f, firsts)])
            else:
                merged.append((start, end, n, firsts))
        now = {start: (end, n, firsts) for start, end, n, firsts in merged}
        for start in was.keys() - now.keys():
            self.open.removeKey((start,))
        for start, value in now.items():
            if was.get(start) != value:
                self.open.updateValue((start,), value)
        self._timer(was, now)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        was = {k[0]: tuple(v) for k, v in self.open.iterator()}
        due = [(start, v) for start, v in was.items() if self._expiry(v[0]) <= timerValues.getCurrentWatermarkInMs()]
        for start, (end, n, firsts) in due:
            self.open.removeKey((start,))
            del was[start]
            reached, at = 0, -1
            for f in firsts:
                if f < max(at, 0):
                    break
                reached, at = reached + 1, f
            yield Row(key=key[0], first_us=start, last_us=end, n=n, reached=reached)
        self._timer({}, was)

    def close(self) -> None:
        pass


def sessions(stream: DataFrame, key: str, at: str, step: str, steps: Sequence[str], gap_ms: int, late: str) -> DataFrame:
    """key, first_us, last_us (microseconds), n, reached: sessions of rows at most `gap_ms` apart, when the watermark has
    passed them; `reached` counts the leading steps whose first times in the session follow each other. State
    holds open sessions only, one entry each, whatever the number of rows or of keys seen. Rows behind the
    watermark are dropped, null keys and times are not taken."""
    rows = stream.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(at), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(step).alias("step"))
    out = "key long, first_us long, last_us long, n long, reached int"
    return rows.groupBy("key").transformWithState(Sessions(gap_ms, steps), out, "append", "EventTime").withColumnRenamed("key", key)


# ---------------------------------------------------------------- change feeds


class Marks(StatefulProcessor):
    """The sequence of the last change of a key that was let through. A live key keeps its mark; a deleted one
    keeps it as a tombstone for `keep_ms`, then both are forgotten."""

    def __init__(self, out: Sequence[str], keep_ms: int):
        self.out, self.keep = list(out), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getValueState("live", "mark string")
        self.gone = handle.getValueState("gone", "mark string", ttlDurationMs=self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = max(rows, key=lambda r: r["_order"])  # one row is kept, however many a key has
        marks = [s.get()[0] for s in (self.live, self.gone) if s.exists()]
        if marks and best["_order"] <= max(marks):
            return
        keep, drop = (self.gone, self.live) if best["_gone"] else (self.live, self.gone)
        keep.update((best["_order"],))
        drop.clear()
        yield Row(**{c: best[c] for c in self.out})

    def close(self) -> None:
        pass


def changes(feed: DataFrame, keys: Sequence[str], sequence_by: str, delete_when: str | None = None, drop: Sequence[str] = (), keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """A stream of a change feed -> the changes that are news to their key, with `_gone` for deletes: in each
    micro-batch the last change of a key by (sequence, data), and only if it is later than all those before,
    deletes included. Order of arrival doesn't matter, and repeated rows are no news. A change older than a
    delete is known as such for `keep_ms` after it. Null sequences are not taken; keys may be null."""
    data = [c for c in feed.columns if c not in {*keys, sequence_by, *drop}]
    gone = F.coalesce(F.expr(delete_when), F.lit(False)) if delete_when else F.lit(False)
    kept = feed.filter(F.col(sequence_by).isNotNull()).select(*keys, sequence_by, *data, gone.alias("_gone"))
    marked = kept.withColumn("_order", _sortable(kept, sequence_by, data))
    out = [*keys, sequence_by, *data, "_gone"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.select(*out).schema)
    return marked.groupBy(*keys).transformWithState(Marks(out, keep_ms), schema, "update", "ProcessingTime")


def _sortable(df: DataFrame, sequence_by: str, data: Sequence[str]) -> F.Column:
    """A string that sorts as the sequence does, then a digest of the data for equal sequences."""
    kind = df.schema[sequence_by].dataType.simpleString()
    number = F.unix_micros(F.col(sequence_by).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(sequence_by).cast("long")
    # 2^63 is added in decimals, so that negative sequences sort before positive ones
    shifted = F.lpad((number.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(shifted, F.lit("|"), F.sha2(F.to_json(F.struct(*data)) if data else F.lit(""), 256))


def current(accepted: DataFrame, keys: Sequence[str], sequence_by: str) -> DataFrame:
    """The rows that live after the accepted changes: the last of each key, without deletes. Of equal sequences
    the one let through last counts (its batch is the later one)."""
    w = Window.partitionBy(*keys).orderBy(F.col(sequence_by).desc(), F.col("batch").desc())
    return accepted.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1 and not _gone").drop("_rn", "_gone", "batch")
