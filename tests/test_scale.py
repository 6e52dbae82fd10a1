"""Joins by sorting, in time cells and with heavy keys, against plain loops; state that expires."""

import datetime as dt
import glob
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from gabbro.operators import relational as R
from gabbro.streaming import flows, state

NONE = (True, 0)


def ordered(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda t: tuple(NONE if x is None else (False, x) for x in t))


def plain(rows):
    return sorted(rows, key=lambda t: tuple(NONE if x is None else (False, x) for x in t))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


# ------------------------------------------------------------------ as-of join


@pytest.fixture(scope="module")
def history():
    rng = random.Random(1)
    rows = []
    for k in ("a", "b", "c", "hot"):
        cuts = sorted(rng.sample(range(5, 95), 5))
        for i, (x, y) in enumerate(zip(cuts, [*cuts[1:], None])):
            if rng.random() < 0.8:  # gaps between versions
                rows.append((k, x, y, f"{k}{i}", i))
    return [*rows, ("closed", 10, 20, "only", 0), (None, 0, None, "nobody", 9)]


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("width", [None, 7, 1000])
def test_as_of_join_equals_plain_loops(spark, history, how, width):
    rng = random.Random(2)
    facts = [(rng.choice(["a", "b", "c", "closed", "new", None]), rng.choice([None, *range(100)]), n) for n in range(200)] + [("hot", rng.randrange(100), n) for n in range(200, 400)] + [("a", 50, 0)] * 3
    want = []
    for k, at, n in facts:
        hit = [h for h in history if k is not None and at is not None and h[0] == k and h[1] <= at and (h[2] is None or at < h[2])]
        want += [(k, at, n, h[3], h[4]) for h in hit] or ([(k, at, n, None, None)] if how == "left" else [])
    f = spark.createDataFrame(facts, "k string, at int, n int")
    h = spark.createDataFrame(history, "k string, valid_from int, valid_to int, plan string, version int")
    out = R.as_of_join(f, h, "k", "at", how, cell=R.cell_of(f, "at", width) if width else None)
    assert ordered(out, "k", "at", "n", "plan", "version") == plain(want)
    assert out.columns == ["k", "at", "n", "valid_from", "valid_to", "plan", "version"]
    assert "Join" not in plan_of(out)  # facts and versions never meet in pairs


def test_as_of_join_of_empty_tables(spark):
    f, h = spark.createDataFrame([], "k string, at int"), spark.createDataFrame([], "k string, valid_from int, valid_to int, plan string")
    assert R.as_of_join(f, h, "k", "at").count() == 0
    assert ordered(R.as_of_join(spark.createDataFrame([("a", 1)], "k string, at int"), h, "k", "at"), "k", "plan") == [("a", None)]


# ------------------------------------------------------------------ joins in cells


@pytest.mark.parametrize("width", [1, 10, 500])
def test_within_intervals_equals_plain_loops(spark, width):
    rng = random.Random(width)
    spans = [(rng.choice(["a", "b", None]), s := rng.randrange(-50, 100), rng.choice([None, s, s + rng.randrange(1, 40)])) for _ in range(150)]
    dots = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-60, 120)])) for _ in range(150)]
    hits = [(k, s, e, at) for k, s, e in spans for q, at in dots if k is not None and k == q and None not in (e, at) and s <= at < e]
    i, p = spark.createDataFrame(spans, "k string, s int, e int"), spark.createDataFrame(dots, "k string, at int")
    join = lambda how: R.within_intervals(i, p, "k", "s", "e", "at", width, how)
    assert ordered(join("inner"), "k", "s", "e", "at") == plain(hits)
    met = {h[:3] for h in hits}
    assert ordered(join("left_semi"), "k", "s", "e") == plain(x for x in spans if x in met)
    assert ordered(join("left_anti"), "k", "s", "e") == plain(x for x in spans if x not in met)


def test_rows_that_meet_grow_with_the_rows(spark):
    """One job, n due times and n runs: candidates in neighbouring cells, 3n at most, not n * n."""
    n = 2000
    i = spark.range(n).selectExpr("'j' as k", "id * 10 as s", "id * 10 + 10 as e")
    p = spark.range(n).selectExpr("'j' as k", "id * 10 + 3 as at")
    cut = i.withColumn("_cell", F.explode(F.sequence(R.cell_of(i, "s", 10), R.cell_of(i, "e", 10))))
    assert cut.join(p.withColumn("_cell", R.cell_of(p, "at", 10)), ["k", "_cell"]).count() <= 3 * n
    assert R.within_intervals(i, p, "k", "s", "e", "at", 10).count() == n
    assert "_cell" in plan_of(R.within_intervals(i, p, "k", "s", "e", "at", 10))


# ------------------------------------------------------------------ heavy keys


def test_heavy_keys_are_found_and_only_these_repeated(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, "warm").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))).alias("k"), "id")
    heavy = R.heavy_keys(rows, "k", 0.05)
    assert heavy[0] == "hot" and set(heavy) == {"hot", "warm"}
    dim = spark.createDataFrame([("hot", 1), ("warm", 2), ("k1", 3), ("k2", 4), ("none", 5), (None, 6)], "k string, w int")
    many = R.repeated(dim, "k", heavy, 8).groupBy("w").count()
    assert ordered(many, "w", "count") == [(1, 8), (2, 8), (3, 1), (4, 1), (5, 1), (6, 1)]
    for how in ("inner", "left", "left_semi", "left_anti"):
        cols = ["k", "id"] + ["w"] * (how in ("inner", "left"))
        assert ordered(R.split_join(rows, dim, "k", 0.05, 8, how), *cols) == ordered(rows.join(dim, "k", how), *cols)
    assert R.heavy_keys(rows.limit(0), "k", 0.1) == [] and R.split_join(rows.limit(0), dim, "k").count() == 0


# ------------------------------------------------------------------ state that expires


@pytest.fixture
def one_partition(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def redo_last(checkpoint):
    """The last batch counts as not done: its commit is removed, as after a failure between sink and commit."""
    last = max(glob.glob(f"{checkpoint}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    crc = f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"
    if os.path.exists(crc):
        os.remove(crc)


def test_sessions_close_merge_and_leave_the_state(spark, one_partition):
    top = tempfile.mkdtemp(prefix="gabbro-sessions-")
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    at = lambda m: t0 + dt.timedelta(minutes=m)

    def deliver(rows):
        spark.createDataFrame([(u, at(m) if m is not None else None, s) for u, m, s in rows], "u long, ts timestamp, step string").coalesce(1).write.mode("append").parquet(f"{top}/in")
        stream = flows.read_files(spark, f"{top}/in", "parquet", "u long, ts timestamp, step string")
        return state.run(state.sessions(stream, "u", "ts", "step", ["view", "buy"], 10 * 60_000, "30 minutes"), f"{top}/out", f"{top}/ck")

    def seen():
        us = lambda m: int((at(m) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)).total_seconds()) * 1_000_000
        minute = {us(m): m for m in range(-200, 300)}
        return sorted((r.u, minute[r.first_us], minute[r.last_us], r.n, r.reached) for r in spark.read.parquet(f"{top}/out").collect())

    # two sessions of user 1 at first; the row between them comes later, within the watermark's 30 minutes
    first = deliver([(1, 0, "view"), (1, 18, "buy"), (2, 5, "buy"), (2, 6, "view"), (3, 1, None), (None, 2, "view"), (4, None, "view")])
    assert seen() == []
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in first.recentProgress) >= 4
    second = deliver([(1, 9, "view"), (5, 100, "view")])
    assert seen() == [(1, 0, 18, 3, 2), (2, 5, 6, 2, 1), (3, 1, 1, 1, 0)]
    assert second.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < max(p["stateOperators"][0]["numRowsTotal"] for p in first.recentProgress)
    late = deliver([(1, 20, "view"), (5, 95, "buy"), (6, 250, "view")])  # minute 20 is behind the watermark of 70
    assert seen() == [(1, 0, 18, 3, 2), (2, 5, 6, 2, 1), (3, 1, 1, 1, 0), (5, 95, 100, 2, 1)]
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in late.recentProgress) == 1


def test_change_feed_out_of_order_repeated_and_done_twice(spark, one_partition):
    top = tempfile.mkdtemp(prefix="gabbro-cdc-")
    whole = []

    def deliver(rows):
        whole.extend(rows)
        spark.createDataFrame(rows, "k string, seq long, op string, v int").coalesce(1).write.mode("append").parquet(f"{top}/in")
        go()

    def go():
        feed = flows.read_files(spark, f"{top}/in", "parquet", "k string, seq long, op string, v int").drop("_source_file", "_ingested_at")
        state.run(state.changes(feed, ["k"], "seq", "op = 'delete'"), f"{top}/out", f"{top}/ck", "update")

    def now():
        return ordered(state.current(spark.read.parquet(f"{top}/out"), ["k"], "seq"), "k", "seq", "v")

    deliver([("a", 5, "put", 50), ("a", 3, "put", 30), ("b", 4, "delete", None), ("c", -2, "put", 1), (None, 1, "put", 7), ("e", None, "put", 9)])
    assert now() == [("a", 5, 50), ("c", -2, 1), (None, 1, 7)]
    deliver([("a", 4, "put", 40), ("b", 2, "put", 20), ("c", -5, "put", 0), ("d", 1, "put", 11), ("d", 2, "delete", None)])  # old updates, one after a delete
    assert now() == [("a", 5, 50), ("c", -2, 1), (None, 1, 7)]
    redo_last(f"{top}/ck")
    deliver([("b", 6, "put", 60), ("a", 5, "put", 50), ("c", 0, "delete", None)])  # the batch before is done again first
    assert now() == [("a", 5, 50), ("b", 6, 60), (None, 1, 7)]
    last = {}
    for k, seq, op, v in whole:
        if seq is not None and (k not in last or seq > last[k][0]):
            last[k] = (seq, op, v)
    assert now() == plain((k, s, v) for k, (s, op, v) in last.items() if op != "delete")
