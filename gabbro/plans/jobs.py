"""A small job runner: a graph of tasks with retries, timeouts, conditions, for-each and task values."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from gabbro.operators.relational import within_intervals

RUN_IF = {
    "ALL_SUCCESS": lambda s: all(x == "SUCCESS" for x in s),
    "AT_LEAST_ONE_SUCCESS": lambda s: any(x == "SUCCESS" for x in s),
    "NONE_FAILED": lambda s: not any(x == "FAILED" for x in s),
    "ALL_DONE": lambda s: True,
    "AT_LEAST_ONE_FAILED": lambda s: any(x == "FAILED" for x in s),
    "ALL_FAILED": lambda s: all(x == "FAILED" for x in s),
}


@dataclass
class Task:
    name: str
    run: Callable
    after: tuple[str, ...] = ()
    run_if: str = "ALL_SUCCESS"
    retries: int = 0
    only_when: tuple[str, bool] | None = None  # (condition task, outcome)
    for_each: Sequence | None = None
    concurrency: int = 1
    timeout_s: float | None = None


@dataclass
class Context:
    """What tasks share: parameters (always strings) and values set by earlier tasks."""

    spark: SparkSession | None
    params: dict[str, str]
    values: dict[str, object] = field(default_factory=dict)


class JobFailed(RuntimeError):
    pass


class Job:
    def __init__(self, name: str, timeout_s: float = 7200, must_run: Sequence[str] = ()):
        self.name, self.timeout_s, self.must_run = name, timeout_s, tuple(must_run)
        self.tasks: dict[str, Task] = {}

    def task(self, name: str | None = None, **how):
        def keep(f):
            t = Task(name or f.__name__, f, **how)
            unknown = [a for a in t.after if a not in self.tasks]
            if unknown:
                raise ValueError(f"{t.name} comes after unknown tasks {unknown}")  # so there are no cycles
            self.tasks[t.name] = t
            return f

        return keep

    def run(self, spark: SparkSession | None = None, concurrency: int = 8, **params) -> list[tuple]:
        """(job, task, status, attempts, seconds, error) of every task, in order of definition. A task starts
        as soon as those it comes after have ended, so independent tasks run side by side; one that takes
        longer than its own or the job's timeout is cancelled with its Spark jobs. Raises JobFailed at the
        end if a task failed, or if one of must_run was skipped: a skipped gate isn't a success."""
        ctx = Context(spark, {k: str(v) for k, v in params.items()})
        state: dict[str, str] = {}
        log: dict[str, tuple] = {}
        end = time.time() + self.timeout_s
        with ThreadPoolExecutor(concurrency) as pool:
            running: dict = {}
            while len(state) < len(self.tasks):
                for t in self.tasks.values():
                    if t.name in state or t.name in running.values() or any(a not in state for a in (*t.after, *(t.only_when[:1] if t.only_when else ()))):
                        continue
                    ok = RUN_IF[t.run_if]([state[a] for a in t.after])
                    if ok and t.only_when:
                        ok = state.get(t.only_when[0]) == "SUCCESS" and bool(ctx.values.get(t.only_when[0])) is t.only_when[1]
                    if ok:
                        running[pool.submit(self._attempts, t, ctx, end)] = t.name
                    else:
                        state[t.name] = "SKIPPED"
                        log[t.name] = (self.name, t.name, "SKIPPED", 0, 0.0, None)
                for f in wait(running, return_when=FIRST_COMPLETED).done if running else ():
                    name = running.pop(f)
                    log[name] = f.result()
                    state[name] = log[name][2]
        self.last = [log[n] for n in self.tasks]
        bad = [n for n, s in state.items() if s == "FAILED"] + [n for n in self.must_run if state.get(n) == "SKIPPED"]
        if bad:
            raise JobFailed(f"{self.name}: {bad}")
        return self.last

    def _attempts(self, t: Task, ctx: Context, end: float) -> tuple:
        start, error, attempt = time.time(), None, 0
        for attempt in range(1, t.retries + 2):
            left = min(end - time.time(), t.timeout_s or float("inf"))
            if left <= 0:
                error = "timeout"
                break
            try:
                ctx.values[t.name] = self._once(t, ctx, left)
                error = None
                break
            except FutureTimeout:
                error = "timeout"
            except Exception as e:  # noqa: BLE001  any failure of a task is its result
                error = f"{type(e).__name__}: {e}"[:500]
        return self.name, t.name, "FAILED" if error else "SUCCESS", attempt, time.time() - start, error

    def _once(self, t: Task, ctx: Context, left: float):
        """One attempt, in a thread whose Spark jobs are a group of their own."""
        group, sc = uuid.uuid4().hex, ctx.spark.sparkContext if ctx.spark else None

        def go(*x):
            if sc:
                sc.setJobGroup(group, f"{self.name}.{t.name}", True)
            return t.run(ctx, *x)

        pool = ThreadPoolExecutor(1 if t.for_each is None else t.concurrency)
        try:
            if t.for_each is None:
                return pool.submit(go).result(left)
            return list(pool.map(go, t.for_each, timeout=left))
        except FutureTimeout:
            if sc:
                sc.cancelJobGroup(group)
            raise
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    def journal(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.last, "job string, task string, status string, attempts int, seconds double, error string")


def missing_runs(schedule: DataFrame, runs: DataFrame, width: int = 86_400_000_000) -> DataFrame:
    """Scheduled (job, due, until) without a run that started at or after its due time, before `until`. Due times
    and runs meet in cells of `width` (a day, in microseconds; units for numbers), not all with all."""
    return within_intervals(schedule, runs, "job", "due", "until", "started", width, "left_anti")


def profile(targets: dict[str, dict[str, str]], target: str, **override: str) -> dict[str, str]:
    """Variables of a deployment target: defaults, then the target's, then overrides."""
    if target not in targets:
        raise KeyError(target)
    return targets.get("default", {}) | targets[target] | override
