"""Late journal rows, laid-out tables and variants."""

import random
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from gabbro.operators import scd
from gabbro.operators.layout import laid_out
from gabbro.plans import scale
from gabbro.sources import ingest

# ------------------------------------------------------------------ repair of late rows


def as_rows(df):
    return sorted((tuple(r) for r in df.select("k", "s", "valid_from", "valid_to", "is_current", "row_hash").collect()), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_repair_equals_a_rebuild(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abcdef"), rng.randrange(30), rng.choice("xy")) for _ in range(90)]
    late = [r for r in rows if rng.random() < 0.2 and r[0] != "f"] + [("new", 3, "x"), ("new", 1, "y"), ("b", -5, "x"), ("b", 99, "y")]
    on_time = [r for r in rows if r not in late]
    make = lambda x: spark.createDataFrame(x, "k string, at int, s string")
    before = scd.rebuild(make(on_time), "k", "at", ["s"])
    whole = make(on_time + late)
    assert as_rows(scd.repair(before, whole, make(late), "k", "at", ["s"])) == as_rows(scd.rebuild(whole, "k", "at", ["s"]))


def test_only_neighbours_of_late_rows_are_touched(spark):
    journal = [("a", t, "xy"[t % 2]) for t in range(0, 100, 10)] + [("b", t, "xy"[t % 2]) for t in range(50)]
    # version times of a: one state a time, as 0, 10, ... are all even; so states alternate by hand
    journal = [("a", t, "xy"[(t // 10) % 2]) for t in range(0, 100, 10)] + journal[10:]
    df = spark.createDataFrame(journal, "k string, at int, s string")
    late = spark.createDataFrame([("a", 45, "z")], df.schema)
    history = scd.rebuild(df, "k", "at", ["s"])
    touched, bounds = scd.islands(history, late, "k", "at")
    assert sorted(tuple(r) for r in touched.collect()) == [("a", 40), ("a", 50)]
    assert [tuple(r) for r in bounds.select("_key", "_lo", "_hi", "_end").collect()] == [("a", 40, 50, 60)]
    none = scd.repair(history, df, late.limit(0), "k", "at", ["s"])
    assert as_rows(none) == as_rows(history)


# ------------------------------------------------------------------ pruned and bucketed tables


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan()  # noqa: SLF001


def scans(plan):
    """(text, metrics) of the file scans of a plan that has run."""
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if p.nodeName().startswith("Scan"):
            m = p.metrics()
            out.append((p.toString(), {k: m.apply(k).value() for k in ("numFiles", "numPartitions") if m.contains(k)}))
        todo += [p.children().apply(i) for i in range(p.children().size())]
        if hasattr(p, "plan") and "QueryStage" in p.getClass().getSimpleName():
            todo.append(p.plan())
    return out


def test_the_filter_of_years_prunes_partitions_while_it_runs(spark, sf):
    fact, _, years = scale.pruned_fact(spark, sf)
    every = {r.ship_year for r in fact.select("ship_year").distinct().collect()}
    leap = {y for y in every if y % 4 == 0}
    out = fact.join(years.filter("kind = 'leap'"), F.col("ship_year") == F.col("year")).groupBy("ship_year").agg(F.sum("qty"))
    text = final_plan(out).toString()
    assert "dynamicpruning" in text
    [m] = [m for t, m in scans(out._jdf.queryExecution().executedPlan()) if "ship_year" in t and "fact" in t]  # noqa: SLF001
    assert m["numPartitions"] == len(leap) < len(every)
    assert m["numFiles"] <= 8 * len(leap)  # a file a bucket and partition


def test_bucketed_tables_meet_without_an_exchange(spark, sf):
    fact, suppliers, _ = scale.pruned_fact(spark, sf)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = fact.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select("s_name", "qty")._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_laid_out_tables_of_nothing(spark):
    df = spark.createDataFrame([], "k int, p int, v string")
    name = f"gabbro_empty_{uuid.uuid4().hex[:8]}"
    assert laid_out(df, name, tempfile.mkdtemp(prefix="gabbro-empty-") + "/t", "k", 4, ["p"]).count() == 0


# ------------------------------------------------------------------ variants

LINES = [
    ('{"k": 1, "n": {"a": "x"}, "extra": [1, 2]}', 1, "x", '{"extra":[1,2]}', None), ('{"k": "one", "n": {}}', None, None, '{"k":"one"}', None), ('{"k": 2', None, None, None, '{"k": 2'),
    ("[1, 2]", None, None, None, None), ("7", None, None, None, None), (None, None, None, None, None), ("", None, None, None, ""), ("{}", None, None, None, None), ('{"k": null, "z": 1}', None, None, '{"k":null,"z":1}', None),
]


def test_variants_give_types_rest_and_corrupt_lines(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LINES)], "i int, line string")
    out = ingest.variants(df, "line", {"k": ("$.k", "int"), "a": ("$.n.a", "string")})
    got = [tuple(r) for r in out.orderBy("i").select("k", "a", "_rescued", "_corrupt").collect()]
    assert got == [x[1:] for x in LINES]
    assert "k" in ingest.variant_schema(out.filter("i in (0, 8)"), "_v")
    assert ingest.variants(df.limit(0), "line", {"k": ("$.k", "int")}).count() == 0
