"""Records and triggers of operations: append-only logs, file and table triggers, schedules, secrets, guards."""

from __future__ import annotations

import datetime as dt
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gabbro.operators.store import VersionedTable
from gabbro.sources.files import Files


class OperationsLog:
    """An append-only table of entries with a time: incidents, deployments, runs."""

    def __init__(self, table: VersionedTable, schema: str):
        self.table, self.schema = table, StructType.fromDDL(schema)

    def add(self, **entry) -> int:
        unknown = set(entry) - set(self.schema.names)
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        text = StructType.fromDDL(", ".join(f"{c} string" for c in self.schema.names))
        row = self.table.spark.createDataFrame([tuple(None if entry.get(c) is None else str(entry[c]) for c in self.schema.names)], text)
        typed = row.select(F.lit(self.table.version() + 1).alias("at"), F.current_timestamp().alias("logged_at"), *[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        return self.table.append(typed)

    def rows(self) -> DataFrame:
        return self.table.read()


class FileTrigger:
    """Fires when a folder has files that it had not at the last firing."""

    def __init__(self, spark: SparkSession, folder: str, state: str):
        self.files, self.folder, self.state = Files(spark), folder, state.rstrip("/")

    def fired(self) -> bool:
        now = sorted([n, size, at] for n, size, at in self.files.list(self.folder))
        seen = [n for n, _, _ in self.files.list(self.state)]
        before = json.loads(self.files.read(seen[-1])) if seen else []
        if now == before:
            return False
        return self.files.create(f"{self.state}/{len(seen):08d}.json", json.dumps(now))


class TableTrigger:
    """Fires when a table has a version that it had not at the last firing."""

    def __init__(self, table: VersionedTable, last: int = -1):
        self.table, self.last = table, last

    def fired(self) -> bool:
        now = self.table.version()
        new, self.last = now > self.last, now
        return new


def due(schedule: str, last: dt.datetime, now: dt.datetime) -> bool:
    """Whether a schedule of five fields (minute hour day month weekday; numbers, lists, ranges, steps or *)
    has a time after last, up to now."""
    fields = schedule.split()
    if len(fields) != 5:
        raise ValueError("five fields: minute hour day month weekday")
    limits = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))

    def allowed(field: str, low: int, high: int) -> set[int]:
        out: set[int] = set()
        for part in field.split(","):
            span, _, step = part.partition("/")
            a, _, b = span.partition("-")
            first, end = (low, high) if span == "*" else (int(a), int(b) if b else (high if step else int(a)))
            out |= set(range(first, end + 1, int(step or 1)))
        return out

    want = [allowed(f, *lim) for f, lim in zip(fields, limits)]
    at = last.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    while at <= now:
        if at.month not in want[3] or at.day not in want[2] or (at.weekday() + 1) % 7 not in want[4]:
            at = at.replace(hour=0, minute=0) + dt.timedelta(days=1)
        elif at.hour not in want[1]:
            at = at.replace(minute=0) + dt.timedelta(hours=1)
        elif at.minute not in want[0]:
            at += dt.timedelta(minutes=1)
        else:
            return True
    return False


def secret(scope: str, key: str) -> str:
    """From the environment only: SCOPE_KEY in capitals; never written anywhere."""
    name = f"{scope}_{key}".upper().replace("-", "_")
    if name not in os.environ:
        raise KeyError(f"no secret {name}")
    return os.environ[name]


def guard_not_empty(df: DataFrame, what: str) -> DataFrame:
    """df, or an error if it has no rows."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df
