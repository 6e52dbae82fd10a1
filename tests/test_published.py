"""Sketches against exact values, aggregates kept up against rebuilds, digests against multisets."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gabbro.operators import published as P

# ------------------------------------------------------------------ sketches


def test_merged_sketches_stay_within_their_errors(spark):
    """400,000 rows, beyond what theta and KLL hold exactly, in 24 parts merged twice."""
    rows = spark.range(400_000).select((F.col("id") % 24).alias("part"), F.pmod(F.xxhash64("id"), F.lit(150_000)).alias("who"), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)).alias("x"))
    parts = P.sketched(rows, ["part"], "who", "x")
    halves = P.merged(parts, [(F.col("part") % 2).alias("part")])
    got = P.estimated(P.merged(halves, [F.lit(0).alias("all")]), {"low": 0.1, "mid": 0.5, "high": 0.95}).first()
    exact = rows.select("who").distinct().count()
    assert got.n == 400_000
    assert abs(got.distinct_hll / exact - 1) < 0.05 and abs(got.distinct_theta / exact - 1) < 0.012
    for q, x in ((0.1, got.low), (0.5, got.mid), (0.95, got.high)):
        assert abs(rows.filter(F.col("x") <= x).count() / 400_000 - q) < 0.004
    per = {r.part: r for r in P.estimated(halves, {"mid": 0.5}).collect()}
    for part in (0, 1):
        truth = rows.filter(F.col("part") % 2 == part).select("who").distinct().count()
        assert abs(per[part].distinct_theta / truth - 1) < 0.012


def test_sketches_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", None, None), ("a", 1, 2.0), ("b", None, None), (None, 5, 1.0)], "g string, who int, x double")
    got = {r.g: (r.n, r.distinct_theta, r.distinct_hll, r.mid) for r in P.estimated(P.merged(P.sketched(df, ["g"], "who", "x"), ["g"]), {"mid": 0.5}).collect()}
    assert got["a"] == (2, 1, 1, 2.0) and got[None] == (1, 1, 1, 1.0) and got["b"][:3] == (1, 0, 0)
    assert P.merged(P.sketched(df.limit(0), ["g"], "who", "x"), ["g"]).count() == 0


# ------------------------------------------------------------------ deltas

COLS = "g string, h int, x decimal(10,2), y int"


def rebuilt(rows):
    groups = {}
    for g, h, x, y in rows:
        groups.setdefault((g, h), []).append((x, y))
    out = []
    for k, v in groups.items():
        xs, ys = [x for x, _ in v if x is not None], [y for _, y in v if y is not None]
        out.append((*k, len(v), sum(xs), len(xs), min(xs, default=None), max(xs, default=None), min(ys, default=None), max(ys, default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_aggregates_kept_up_equal_a_rebuild(spark, seed):
    rng = random.Random(seed)
    row = lambda: (rng.choice(["a", "b", "c", None]), rng.choice([1, None]), rng.choice([None, *range(1, 9)]), rng.choice([None, *range(5)]))
    as_df = lambda rows: spark.createDataFrame(rows, "g string, h int, x int, y int").select("g", "h", F.col("x").cast("decimal(10,2)").alias("x"), "y")
    rows = [row() for _ in range(60)]
    table = P.aggregate(as_df(rows), ["g", "h"], ["x"], ["x", "y"])
    for step in range(3):
        gone = rng.sample(range(len(rows)), min(len(rows), (15, 30, 40)[step]))
        came = [row() for _ in range((10, 0, 5)[step])]
        if step == 1:
            gone = [i for i, r in enumerate(rows) if r[0] == "a"]  # whole groups go
        deleted = [rows[i] for i in gone]
        rows = [r for i, r in enumerate(rows) if i not in set(gone)] + came
        new = P.kept_up(table, as_df(came), as_df(deleted), as_df(rows), ["g", "h"], ["x"], ["x", "y"])
        table = spark.createDataFrame(new.collect(), table.schema)
        got = sorted(((r.g, r.h, r.n, int(r.sum_x), r.cnt_x, *(None if v is None else int(v) for v in (r.min_x, r.max_x, r.min_y, r.max_y))) for r in table.collect()), key=str)
        assert got == rebuilt(rows)


def test_untouched_groups_are_not_read_again(spark):
    """The table as it is then holds only the group that lost its minimum: others don't need it."""
    before = spark.createDataFrame([("a", 1, 1, 1), ("a", 1, 5, 1), ("b", 1, 2, 2), ("b", 1, 7, 3)], "g string, h int, x int, y int")
    table = P.aggregate(before, ["g"], ["x"], ["x"])
    deleted, came = before.filter("x = 1"), before.filter("g = 'b'").withColumn("x", F.lit(9)).limit(1)
    only_a = spark.createDataFrame([("a", 1, 5, 1)], before.schema)
    got = {r.g: (r.n, r.sum_x, r.min_x, r.max_x) for r in P.kept_up(table, came, deleted, only_a, ["g"], ["x"], ["x"]).collect()}
    assert got == {"a": (1, 5, 5, 5), "b": (3, 18, 2, 9)}


# ------------------------------------------------------------------ digests


def test_differences_equal_the_multisets(spark):
    rng = random.Random(9)
    a = [(rng.randrange(30), rng.choice(["x", "y", None])) for _ in range(200)]
    b = rng.sample(a, 190) + [(99, "new"), (99, "new"), (None, "x")]
    da, db = spark.createDataFrame(a, "k int, v string"), spark.createDataFrame(b, "k int, v string")
    want = sorted([(k, v, "left", n) for (k, v), n in (Counter(a) - Counter(b)).items()] + [(k, v, "right", n) for (k, v), n in (Counter(b) - Counter(a)).items()], key=str)
    for buckets in (1, 7, 4096):
        assert sorted((tuple(r) for r in P.differences(da, db.select("v", "k"), ["k"], buckets).collect()), key=str) == want
    assert P.differences(da, da.repartition(5, "v"), ["k"]).count() == 0
    assert P.differences(da.limit(0), da.limit(0), ["k"]).count() == 0
    # a row twice here and another row twice there: sums of hashes tell them apart
    assert P.differences(spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (1, "y")], "k int, v string"), ["k"], 1).count() == 2


def test_equal_tables_move_digests_only(spark, sf):
    """The run over equal tables ends with the join gone: nothing of the tables is shuffled for the counts."""
    a = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    out = P.differences(a, a.repartition(3), ["l_orderkey"], 16)
    assert out.collect() == []
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]  # noqa: SLF001
    assert "LeftSemi" not in final


def test_exact_quantiles_beyond_what_a_sketch_keeps(spark):
    """Twenty thousand values a group, ties, nulls, a null group; with no slack at all the groups are ranked whole."""
    rng = random.Random(4)
    rows = [(g, rng.choice([None, float(rng.randrange(10**6)), 7.0, 500000.0])) for g in (1, None) for _ in range(20_000)] + [(2, None), (3, 1.0), (3, 2.0)]
    df = spark.createDataFrame(rows, "g long, v double")
    kept = P.sketched(df.withColumn("k", F.lit(1)), ["g"], "k", "v")
    for q in (0.5, 0.9):
        for slack in (0.005, 0.0):
            got = {r["g"]: r["quantile"] for r in P.exact_quantile(df, ["g"], "v", kept, q, slack).collect()}
            values = {g: sorted(v for h, v in rows if h == g and v is not None) for g in (1, 3, None)}
            assert got == {g: v[math.ceil(q * len(v)) - 1] for g, v in values.items()}


def test_approximations_keep_one_sketch_a_task(spark, sf):
    """The exact count stands by itself: nothing is grouped by customer with a sketch beside it."""
    from gabbro.plans import registry

    plan = registry.QUERIES["approximations_hold"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "Aggregate(keys=[o_custkey" in x.replace("#", " #").replace(" #", "#")]
    assert lines and not any("approx" in x for x in lines)
