"""The store's commits, layout and retention, and records of operations, on small hand-checkable inputs."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from gabbro.operators import ops, scd, silver
from gabbro.operators import relational as R
from gabbro.operators.governance import Catalog
from gabbro.operators.store import ConstraintError, VersionedTable, partition_value
from gabbro.plans.jobs import Job, JobFailed
from gabbro.sources import ingest
from gabbro.sources.files import Files
from gabbro.streaming import flows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge_tells_of_new_columns(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.append(spark.createDataFrame([(1, "a")], "id int, v string"))
    wide = spark.createDataFrame([(1, "b", 7)], "id int, v string, extra int")
    with pytest.raises(ValueError, match="extra"):
        t.merge(wide, ["id"])
    t.merge(wide, ["id"], merge_schema=True)
    assert rows(t.read()) == [(1, "b", 7)]


def test_reading_what_is_no_table_says_so(spark, tmp_path):
    with pytest.raises(ValueError, match="no commits"):
        VersionedTable(spark, f"{tmp_path}/none").read()


def test_changes_rewrite_only_files_that_hold_rows(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    for k in range(4):
        t.append(spark.createDataFrame([(2 * k, "a"), (2 * k + 1, "a")], "id int, v string").coalesce(1))
    t.update("id = 3", {"v": "'z'"})
    t.delete("id = 4")
    t.merge(spark.createDataFrame([(7, "m"), (9, "n")], "id int, v string"), ["id"])
    t.delete("id = 99")
    assert [len(c.get("remove", [])) for c in t.log()] == [0, 0, 0, 0, 1, 1, 1, 0]
    assert rows(t.read()) == [(0, "a"), (1, "a"), (2, "a"), (3, "z"), (5, "a"), (6, "a"), (7, "m"), (9, "n")]
    feed = {(r["id"], r["v"], r["_change_type"], r["_commit_version"]) for r in t.changes(4, key=["id"]).collect()}
    assert feed == {(3, "a", "update_preimage", 4), (3, "z", "update_postimage", 4), (4, "a", "delete", 5), (7, "a", "update_preimage", 6), (7, "m", "update_postimage", 6), (9, "n", "insert", 6)}


def test_partitions(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.replace(spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "id int, p string"), partition_by=["p"])
    t.append(spark.createDataFrame([(4, "c")], "id int, p string"))
    assert rows(t.read(partitions={"p": ["c"]})) == [(2, "c"), (4, "c")] and rows(t.read(partitions={"p": [None, "a b"]})) == [(1, "a b"), (3, None)]
    assert {partition_value(f, "p") for f in t._state()["files"]} == {"a b", "c", None} and t.read().columns == ["id", "p"]
    t.delete("id = 2")
    assert rows(t.read(partitions={"p": ["c"]})) == [(4, "c")]
    with pytest.raises(ValueError):
        t.read(partitions={"id": [1]})


def test_vacuum_counts_from_the_removal(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.append(spark.createDataFrame([(1,)], "id int").coalesce(1))
    old = t._full(t._state()["files"][0])
    os.utime(old, (0, 0))  # written long ago
    t.delete("id = 1")  # but removed just now
    assert t.vacuum(retain_hours=1) == [] and t.read(0).count() == 1
    t.restore(0)
    t.delete("id = 1")
    clone_of = VersionedTable(spark, f"{tmp_path}/t")
    clone_of.restore(0)
    c = clone_of.clone(f"{tmp_path}/c")
    t.delete("id = 1")
    later = t.log()[-1]["timestamp_ms"] + 3_600_000 * 200
    assert not any(n.endswith(os.path.basename(old)) for n in t.vacuum(now_ms=later)) and c.read().count() == 1  # a clone uses the file
    c.drop()
    assert any(n.endswith(os.path.basename(old)) for n in t.vacuum(now_ms=later))
    with pytest.raises(ValueError, match="vacuumed"):
        t.restore(0)


def test_commits_appear_whole(spark, tmp_path):
    f = Files(spark)
    assert f.create(f"{tmp_path}/x.json", "one") and not f.create(f"{tmp_path}/x.json", "two")
    assert f.read(f"{tmp_path}/x.json") == "one" and [n for n in os.listdir(tmp_path) if n.endswith(".tmp")] == []


def test_state_from_a_checkpoint(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.append(spark.createDataFrame([(1,)], "id int"))
    for k in range(25):
        t.set_props(k=str(k))
    again = VersionedTable(spark, f"{tmp_path}/t")
    assert again._state() == t._state() and again._state()["props"]["k"] == "24" and again._state(3)["props"]["k"] == "2"
    assert len([n for n in again._read if n.endswith(".checkpoint")]) == 1 and len(again._read) < 20


def test_broken_rows_leave_no_files(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.append(spark.createDataFrame([(1,)], "id int"))
    t.add_constraint("positive", "id > 0")
    before = len(t.files.list(f"{tmp_path}/t/data", deep=True))
    with pytest.raises(ConstraintError):
        t.append(spark.createDataFrame([(-1,)], "id int"))
    assert len(t.files.list(f"{tmp_path}/t/data", deep=True)) == before


def test_create_analyze_zorder(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    assert t.create("a int, b int", {"a": "key"}) and not t.create("x int") and t.read().columns == ["a", "b"]
    with pytest.raises(ValueError):
        t.create("x int", if_absent=False)
    t.append(spark.range(1000).select((F.col("id") % 32).cast("int").alias("a"), (F.col("id") / 32).cast("int").alias("b")))
    t.optimize(files=16, zorder_by=["a", "b"])
    held, every = t.skipped("a < 4 and b < 4")
    assert every > 4 and held < every / 2
    stats = {r["column"]: (r["rows"], r["nulls"], r["least"], r["greatest"]) for r in t.analyze().collect()}
    assert stats == {"a": (1000, 0, "0", "31"), "b": (1000, 0, "0", "31")}
    assert json.loads(t._state()["props"]["stats.a"])[0] == 1000


def test_guarded_join_raises(spark):
    left, twice = spark.range(3), spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    assert silver.guarded_join(left, twice.limit(1), "id").count() == 3
    with pytest.raises(Exception, match="more than once"):
        silver.guarded_join(left, twice, "id").collect()


def test_integrity_finds_each_kind(spark):
    h = spark.createDataFrame([("a", 0, 5, True, "x"), ("a", 5, None, True, "x"), ("b", 0, 4, False, "y"), ("b", 5, 9, False, "z")], "k string, valid_from int, valid_to int, is_current boolean, h string")
    got = {r["check"]: r["violations"] for r in scd.integrity(h, "k", "h").collect()}
    assert got == {"several_current": 2, "no_current": 1, "gap_or_overlap": 1, "empty_interval": 0, "current_is_closed": 1, "equal_neighbours": 1}


def test_views_have_no_rules(spark):
    c = Catalog(groups={"all": {"bob"}})
    c.grant("SELECT", "gold", "bob")
    c.mask("gold.t", "v", "'***'", set())
    c.view("gold.v", "gold.t", lambda df: df.select("v"))
    df = spark.createDataFrame([(1, "x")], "id int, v string")
    assert rows(c.read_as("bob", "gold.v", df)) == [("***",)] and c.policies_on("gold") == [("gold.t.v", "mask", "'***'")]
    with pytest.raises(ValueError):
        c.row_filter("gold.v", {"all": "true"})


def test_schedules_triggers_secrets(spark, tmp_path, monkeypatch):
    at = lambda *x: dt.datetime(2026, 5, *x)
    assert ops.due("0 6 * * *", at(1, 5, 59), at(1, 6, 0)) and not ops.due("0 6 * * *", at(1, 6, 0), at(1, 23, 0))
    assert ops.due("*/15 8-17 * * 1-5", at(1, 7, 0), at(1, 8, 0)) and not ops.due("0 8 * * 1-5", at(1, 9, 0), at(3, 23, 0))  # a week-end follows
    with pytest.raises(ValueError):
        ops.due("0 6 * *", at(1), at(2))
    t = VersionedTable(spark, f"{tmp_path}/t")
    trigger = ops.TableTrigger(t)
    assert not trigger.fired()
    t.append(spark.range(1))
    assert trigger.fired() and not trigger.fired()
    monkeypatch.setenv("APP_DB_PASSWORD", "x")
    assert ops.secret("app", "db-password") == "x"
    with pytest.raises(KeyError):
        ops.secret("app", "other")
    with pytest.raises(ValueError):
        ops.guard_not_empty(spark.range(0), "delta")
    log = ops.OperationsLog(VersionedTable(spark, f"{tmp_path}/log"), "step string, amount decimal(10,2)")
    log.add(step="a", amount="1.5")
    with pytest.raises(ValueError):
        log.add(other=1)
    assert [(r["step"], str(r["amount"])) for r in log.rows().collect()] == [("a", "1.50")]


def test_read_files_and_snapshots(spark, tmp_path):
    for v in ("2026-01", "2026-02"):
        (tmp_path / f"in/orders_{v}").mkdir(parents=True)
        (tmp_path / f"in/orders_{v}/a.csv").write_text("id,v\n1,x\n")
    last = ingest.latest_snapshot(spark, f"{tmp_path}/in", "orders")
    assert last.endswith("orders_2026-02") and ingest.latest_snapshot(spark, f"{tmp_path}/in", "orders", "2026-01").endswith("2026-01")
    assert rows(ingest.read_files(spark, last, hints={"id": "int"}, header=True)) == [(1, "x")]
    with pytest.raises(FileNotFoundError):
        ingest.latest_snapshot(spark, f"{tmp_path}/in", "customers")


def test_event_time_windows_on_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [("a", "00:00"), ("a", "00:05"), ("b", "00:50"), ("a", "02:00"), ("a", "09:00")]
    (tmp_path / "in/a.json").write_text("".join(f'{{"k": "{k}", "ts": "2026-01-01T{t}:00"}}\n' for k, t in lines))
    read = lambda: flows.read_files(spark, f"{tmp_path}/in", "json", "k string, ts timestamp")
    flows.append_once(flows.tumbling(read(), "ts", "1 hour", ["k"]), f"{tmp_path}/t", f"{tmp_path}/ct")
    assert {(r["k"], r["start"].hour, r["n"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {("a", 0, 2), ("b", 0, 1), ("a", 2, 1)}
    flows.append_once(flows.sessions(read(), "ts", "30 minutes", "k"), f"{tmp_path}/s", f"{tmp_path}/cs")
    assert {(r["k"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/s").collect()} == {("a", 2), ("b", 1), ("a", 1)}
    q = flows.every(read(), f"{tmp_path}/e", f"{tmp_path}/ce", "1 second")
    q.processAllAvailable()
    assert flows.rows_in(q) == 5
    q.stop()


def test_salted_join_and_same_rows(spark):
    a = spark.createDataFrame([(1, k) for k in range(20)] + [(2, 0)], "k int, v int")
    j = R.salted_join(a, spark.createDataFrame([(1, "x"), (2, "y")], "k int, w string"), "k", 4)
    assert j.count() == 21 and R.same_rows(a, a).count() == 0 and R.same_rows(a, a.filter("v > 0")).count() == 2


def test_independent_tasks_run_together_and_stop_in_time(spark):
    import threading
    import time

    both, job = threading.Barrier(2, timeout=20), Job("side-by-side")
    job.task("a")(lambda ctx: both.wait())  # passes only if b runs at the same time
    job.task("b")(lambda ctx: both.wait())
    job.task("slow", timeout_s=2)(lambda ctx: ctx.spark.range(0, 600, 1, 4).filter(F.expr("reflect('java.lang.Thread', 'sleep', 40L) is null")).count())
    began = time.time()
    with pytest.raises(JobFailed):
        job.run(spark)
    assert {r[1]: (r[2], r[5]) for r in job.last} == {"a": ("SUCCESS", None), "b": ("SUCCESS", None), "slow": ("FAILED", "timeout")}
    assert time.time() - began < 60
    for _ in range(100):  # its Spark jobs were cancelled
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_a_store_is_followed_commit_by_commit(spark, tmp_path):
    t, got = VersionedTable(spark, f"{tmp_path}/t"), []
    t.append(spark.range(3))
    for _ in range(2):
        flows.follow(t, lambda rows, n: got.extend(r[0] for r in rows.collect()), f"{tmp_path}/ck")
    t.delete("id = 0")
    t.append(spark.range(7, 9))
    flows.follow(t, lambda rows, n: got.extend(r[0] for r in rows.collect()), f"{tmp_path}/ck")
    assert sorted(got) == [0, 1, 2, 7, 8]
