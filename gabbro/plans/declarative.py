"""Declarative pipelines: datasets as functions, a graph from what they read, expectations with counters."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gabbro.operators.quality import ExpectationFailed
from gabbro.operators.store import VersionedTable


@dataclass
class Dataset:
    name: str
    make: Callable[..., DataFrame]
    reads: tuple[str, ...]
    kind: str = "table"  # table: recomputed and stored; view: planned at each read; temporary: not published
    warn: dict[str, str] = field(default_factory=dict)
    drop: dict[str, str] = field(default_factory=dict)
    fail: dict[str, str] = field(default_factory=dict)
    comment: str | None = None


class Pipeline:
    """Functions register with @pipeline.dataset(reads=[...]) and get their inputs as arguments; nothing
    runs before run(), which goes in topological order. Expectations see the returned columns."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.datasets: dict[str, Dataset] = {}
        self.frames: dict[str, DataFrame] = {}

    def dataset(self, reads: Sequence[str] = (), kind: str = "table", comment: str | None = None, **expect: dict[str, str]):
        def keep(f):
            self.datasets[f.__name__] = Dataset(f.__name__, f, tuple(reads), kind, comment=comment, **expect)
            return f

        return keep

    def order(self) -> list[str]:
        done: list[str] = []
        open_: set[str] = set()

        def visit(n: str) -> None:
            if n in done:
                return
            if n not in self.datasets:
                raise KeyError(f"no dataset {n}")
            if n in open_:
                raise ValueError(f"{n} depends on itself")
            open_.add(n)
            for r in self.datasets[n].reads:
                visit(r)
            done.append(n)

        for n in self.datasets:
            visit(n)
        return done

    def events(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/_events")

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}")

    def run(self, update_id: str) -> dict[str, DataFrame]:
        rows = []
        for n in self.order():
            d = self.datasets[n]
            df = d.make(*[self.frames[r] for r in d.reads])
            rules = d.warn | d.drop | d.fail
            if rules:
                # one pass counts every rule; a condition that is null isn't met
                met = {k: F.coalesce(F.expr(sql), F.lit(False)) for k, sql in rules.items()}
                got = df.agg(F.count("*").alias("_n"), *[F.count_if(~c).alias(k) for k, c in met.items()]).first()
                for k in rules:
                    action = "fail" if k in d.fail else "drop" if k in d.drop else "warn"
                    rows.append((update_id, int(time.time() * 1000), n, k, action, got["_n"] - got[k], got[k]))
                bad = [k for k in d.fail if got[k]]
                if bad:
                    self._log(rows)
                    raise ExpectationFailed(f"{n}: {bad}")
                for k in d.drop:
                    df = df.filter(met[k])
            if d.kind == "table":
                t = self.table(n)
                t.replace(df, overwrite_schema=True)
                if d.comment:
                    t.comment(d.comment)
                df = t.read()
            self.frames[n] = df
        self._log(rows)
        return {n: f for n, f in self.frames.items() if self.datasets[n].kind != "temporary"}

    def _log(self, rows: list[tuple]) -> None:
        if rows:
            self.events().append(self.spark.createDataFrame(rows, "update_id string, at_ms long, dataset string, expectation string, action string, passed long, failed long"))

    def metrics(self) -> DataFrame:
        """Counters of the latest update only: those before are cumulative duplicates."""
        e = self.events().read()
        last = e.agg(F.max_by("update_id", "at_ms").alias("last_id"))
        return e.join(F.broadcast(last), F.col("update_id") == F.col("last_id")).drop("last_id")
