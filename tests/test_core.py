"""Operators of the core library, on small hand-checkable inputs."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gabbro.functions import clean
from gabbro.operators import relational as R
from gabbro.operators import scd
from gabbro.operators.governance import AccessDenied, Catalog
from gabbro.operators.quality import Check, GateClosed, contract_report, gate, run_checks, volume_drop
from gabbro.operators.store import ConflictError, ConstraintError, VersionedTable
from gabbro.plans.declarative import Pipeline
from gabbro.plans.jobs import Job, JobFailed, missing_runs
from gabbro.sources import ingest
from gabbro.streaming import flows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_cleaning(spark):
    df = spark.createDataFrame([("12,34 €", "3x", " paid "), (" 12.5", "-1", "PAID"), ("EUR 1,00", None, None), ("n/a", "abc", "x")], "p string, q string, s string")
    got = df.select(clean.clean_decimal(F.col("p")), clean.clean_int(F.col("q")), clean.clean_int(F.col("q"), strict=True), clean.clean_status(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(Decimal("12.34"), 3, None, "PAID"), (Decimal("12.50"), -1, -1, "PAID"), (Decimal("1.00"), None, None, None), (None, None, None, "X")]


def test_timestamps(spark):
    df = spark.createDataFrame([("2026-05-01 10:00:00",), ("0000-00-00 00:00:00",), ("2026-13-45 99:99:99",), ("1767225600000",), ("2026-01-01T00:00:00Z",), (None,)], "t string")
    strict = [r[0] for r in df.select(clean.parse_ts(F.col("t"))).collect()]
    assert strict[0] == dt.datetime(2026, 5, 1, 10) and strict[1:] == [None] * 5
    dual = [r[0] for r in df.select(F.date_format(clean.dual_ts(F.col("t")), "yyyy-MM-dd")).collect()]
    assert dual[3] == dual[4] == "2026-01-01" and dual[2] is None and dual[5] is None


def test_row_hash_tells_nulls_apart(spark):
    df = spark.createDataFrame([("Paris", None), (None, "Paris"), ("Paris", "")], "a string, b string")
    assert len({r[0] for r in df.select(clean.row_hash("a", "b")).collect()}) == 3


def test_workshop_medallion(spark):
    """Raw lines with a copy, a bad quantity and a bad price: counts add up and the copy goes once."""
    raw = spark.createDataFrame([("o1", "2", "10,00"), ("o1", "2", "10,00"), ("o2", "0", "5,00"), ("o3", "1", "x"), ("o4", "-1", "y"), ("o5", "3", "1,50")], "id string, q string, p string")
    once = R.dedup(raw, ["id"], R.total_order(raw, ["id"]))
    typed = once.select("id", clean.clean_int(F.col("q")).alias("q"), clean.clean_decimal(F.col("p")).alias("p"))
    ok, bad = R.split_quarantine(typed, clean.reasons(QTY=F.col("q") <= 0, PRICE=F.col("p").isNull()))
    assert (once.count(), ok.count(), bad.count()) == (5, 2, 3)
    assert {r["id"]: r["reasons"] for r in bad.collect()} == {"o2": ["QTY"], "o3": ["PRICE"], "o4": ["QTY", "PRICE"]}


def test_as_of_join_is_closed_open(spark):
    h = spark.createDataFrame([("s", 1, 0, 10), ("s", 2, 10, None)], "k string, plan int, valid_from int, valid_to int")
    f = spark.createDataFrame([("s", 9), ("s", 10), ("t", 1)], "k string, at int")
    assert rows(R.as_of_join(f, h, "k", "at").select("k", "at", "plan")) == [("s", 10, 2), ("s", 9, 1), ("t", 1, None)]


VERSIONS = st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 12), st.sampled_from("xyz")), min_size=1, max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(VERSIONS, st.integers(0, 12))
def test_history_by_steps_equals_rebuild(spark, versions, cut):
    j = spark.createDataFrame(versions, "k string, at int, v string")
    whole = scd.rebuild(j, "k", "at", ["v"])
    stepped = scd.apply(scd.rebuild(j.filter(F.col("at") <= cut), "k", "at", ["v"]), j, "k", "at", ["v"])
    assert rows(whole) == rows(stepped)
    assert all(r["violations"] == 0 for r in scd.integrity(whole, "k").collect())


def test_auto_cdc(spark):
    feed = spark.createDataFrame([(1, "a", 1, "I"), (1, "b", 3, "U"), (1, "b", 2, "U"), (2, "c", 1, "I"), (2, "c", 5, "D")], "id int, v string, seq int, op string")
    assert rows(scd.auto_cdc(feed, ["id"], "seq", 1, "op = 'D'", ["op"])) == [(1, "b")]
    two = rows(scd.auto_cdc(feed, ["id"], "seq", 2, "op = 'D'", ["op"]).select("id", "v", "valid_from", "valid_to"))
    assert two == [(1, "a", 1, 2), (1, "b", 2, None), (2, "c", 1, 5)]


def test_store_versions(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, v string")
    t.append(one)
    t.merge(spark.createDataFrame([(2, "B"), (3, "c"), (None, "m")], "id int, v string"), ["id"])
    assert rows(t.read()) == sorted([(1, "a"), (2, "B"), (3, "c"), (None, "n"), (None, "m")], key=str)
    t.update("id = 1", {"v": "'z'"})
    t.delete("id = 3")
    assert rows(t.read(0)) == rows(one) and t.read().count() == 4
    feed = {(r["id"], r["_change_type"]) for r in t.changes(1, 1, ["id"]).collect() if r["id"]}
    assert feed == {(2, "update_preimage"), (2, "update_postimage"), (3, "insert")}
    t.restore(1)
    assert t.read().count() == 5 and t.history().count() == 5
    with pytest.raises(ValueError):
        t.merge(spark.createDataFrame([(1, "x"), (1, "y")], "id int, v string"), ["id"])
    c = t.clone(f"{tmp_path}/c")
    c.delete("true")
    assert c.read().count() == 0 and t.read().count() == 5
    t.optimize(["id"], 1)
    assert t.detail().first()["num_files"] == 1 and t.read().count() == 5
    t.vacuum(0, now_ms=2**53)
    assert t.read().count() == 5


def test_store_conflict_and_constraints(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    t.append(spark.createDataFrame([(1,)], "id int"))
    with pytest.raises(ConflictError):
        t._commit("APPEND", -1, add=[])
    t.add_constraint("positive", "id > 0")
    with pytest.raises(ConstraintError):
        t.append(spark.createDataFrame([(-1,)], "id int"))
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(2, "x")], "id int, v string"))
    t.append(spark.createDataFrame([(2, "x")], "id int, v string"), merge_schema=True)
    assert rows(t.read()) == [(1, None), (2, "x")]


def test_copy_into_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("id;v\n1;x\n2;y;surplus\n")
    t = VersionedTable(spark, f"{tmp_path}/t")
    read = lambda s, paths: ingest.read_csv(s, paths, ["id", "v"], ";")
    assert ingest.copy_into(t, f"{tmp_path}/in", read, "b1") == 1
    assert ingest.copy_into(t, f"{tmp_path}/in", read, "b2") == 0
    (tmp_path / "in/b.csv").write_text("id;v\n3;z\n")
    assert ingest.copy_into(t, f"{tmp_path}/in", read, "b3") == 1
    t.truncate()
    assert ingest.copy_into(t, f"{tmp_path}/in", read, "b4") == 0
    assert ingest.copy_into(t, f"{tmp_path}/in", read, "b5", force=True) == 2
    assert {r["id"]: r["_rescued_data"] for r in t.read().collect()} == {"1": None, "2": "2;y;surplus", "3": None}


def test_windows_1252_and_repair(spark, tmp_path):
    (tmp_path / "o.csv").write_bytes("id;city\r\n1;Orl\xe9ans; bis\r\n2;Nice\r\n".encode("windows-1252"))
    lines = ingest.read_raw_lines(spark, f"{tmp_path}/o.csv", "windows-1252")
    assert rows(ingest.repaired_last_field(lines, 2)) == [("1", "Orl\xe9ans; bis")]


def test_json_rescue(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"id": "a", "n": 1}\n{"id": "b", "n": "x", "more": 5}\n{"id": \n')
    got = ingest.read_json(spark, f"{tmp_path}/e.json", "id string, n int").collect()
    by = {r["id"]: r for r in got}
    assert by["a"]["_rescued_data"] is None and by["a"]["n"] == 1
    assert "more" in by["b"]["_rescued_data"] and '"n":"x"' in by["b"]["_rescued_data"]
    assert any(r["_corrupt_record"] for r in got if r["id"] is None)


def test_schema_registry(spark, tmp_path):
    r = ingest.SchemaRegistry(spark, f"{tmp_path}/s")
    assert r.resolve(["a"]) == ["a"]
    with pytest.raises(ingest.UnknownFieldError):
        r.resolve(["a", "b"])
    assert r.resolve(["a", "b"]) == ["a", "b"]
    with pytest.raises(ingest.UnknownFieldError):
        r.resolve(["a", "b", "c"], "failOnNewColumns")
    assert r.resolve(["a", "b", "c"], "rescue") == ["a", "b"]


def test_incremental_extract(spark, tmp_path):
    j, m = VersionedTable(spark, f"{tmp_path}/j"), ingest.Watermarks(VersionedTable(spark, f"{tmp_path}/w"))
    src = spark.createDataFrame([(1, 10), (2, 20)], "id int, at int")
    assert ingest.incremental_extract(src, "at", "s", j, m, "b1") == 2
    src = src.union(spark.createDataFrame([(3, 20), (4, 30)], "id int, at int"))
    assert ingest.incremental_extract(src, "at", "s", j, m, "b2") == 3  # the border rows come again
    assert m.get("s") == "30"


def test_checks_and_gate(spark):
    spark.range(10).createOrReplaceTempView("ten")
    got = run_checks(spark, [Check("silver", "ten", "rows", "select count(*) from ten", 10, "="), Check("silver", "ten", "nothing", "select max(id) from ten where id > 99", 0)], "r1")
    assert {r["name"]: r["passed"] for r in got.collect()} == {"rows": True, "nothing": False}
    with pytest.raises(GateClosed):
        gate(got)
    rep = contract_report(spark.range(10).toDF("id"), {"small": "id < 8"}).first()
    assert (rep["scope"], rep["violations"], rep["rate"]) == (10, 2, 0.2)
    assert volume_drop(spark.range(5), spark.range(10)).first()["drop"] == 0.5


def test_pipeline_expectations(spark, tmp_path):
    p = Pipeline(spark, f"{tmp_path}/p")

    @p.dataset(kind="temporary")
    def raw():
        return spark.range(10).toDF("id")

    @p.dataset(reads=["raw"], drop={"small": "id < 8"}, warn={"even": "id % 2 = 0"})
    def silver(raw):
        return raw

    @p.dataset(reads=["silver"], kind="view")
    def gold(silver):
        return silver.agg(F.sum("id").alias("s"))

    out = p.run("u1")
    assert set(out) == {"silver", "gold"} and out["gold"].first()["s"] == 28
    assert {(r["expectation"], r["failed"]) for r in p.metrics().collect()} == {("small", 2), ("even", 5)}


def test_job(spark):
    job, tries = Job("daily"), []

    @job.task(retries=2)
    def flaky(ctx):
        tries.append(1)
        if len(tries) < 2:
            raise ValueError("new columns")
        return True

    @job.task(after=("flaky",), for_each=[1, 2, 3], concurrency=3)
    def each(ctx, x):
        return x * int(ctx.params["k"])

    @job.task(after=("flaky",), only_when=("flaky", False))
    def never(ctx):
        raise AssertionError

    @job.task(after=("each",), run_if="ALL_DONE")
    def last(ctx):
        return sum(ctx.values["each"])

    log = {r[1]: r[2:4] for r in job.run(spark, k=2)}
    assert log == {"flaky": ("SUCCESS", 2), "each": ("SUCCESS", 1), "never": ("SKIPPED", 0), "last": ("SUCCESS", 1)}
    job.must_run = ("never",)
    with pytest.raises(JobFailed):
        job.run(spark, k=2)
    sched = spark.createDataFrame([("a", 1, 2), ("a", 2, 3)], "job string, due int, until int")
    assert rows(missing_runs(sched, spark.createDataFrame([("a", 1)], "job string, started int"))) == [("a", 2, 3)]


def test_governance(spark):
    c = Catalog(groups={"finance": {"ann"}})
    df = spark.createDataFrame([(1, "a@x.org", "FR"), (2, "b@x.org", "DE")], "id int, mail string, country string")
    with pytest.raises(AccessDenied):
        c.read_as("ann", "gold.t", df)
    c.grant("SELECT", "gold", "ann")
    c.grant("SELECT", "gold.t", "bob")
    c.mask("gold.t", "mail", "'***'", {"finance"})
    c.row_filter("gold.t", {"finance": "true", "bob": "country = 'FR'"})
    assert rows(c.read_as("ann", "gold.t", df)) == rows(df)
    assert rows(c.read_as("bob", "gold.t", df)) == [(1, "***", "FR")]
    c.deny("SELECT", "gold.t", "bob")
    with pytest.raises(AccessDenied):
        c.read_as("bob", "gold.t", df)


def test_stream_adds_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": 1, "ts": "2026-01-01T00:00:00"}\n{"id": 2, "ts": "2026-01-01T00:01:00"}\n')
    run = lambda: flows.append_once(flows.read_files(spark, f"{tmp_path}/in", "json", "id int, ts timestamp"), f"{tmp_path}/out", f"{tmp_path}/ck")
    run()
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    (tmp_path / "in/b.json").write_text('{"id": 3, "ts": "2026-01-01T02:00:00"}\n')
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_entry_and_registry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_posexplode_takes_whole_tables(spark, tmp_path):
    import __spark_entry__ as e

    texts = {1: "a b", 2: " ".join(f"w{k}" for k in range(500)), 3: "c  d ", 4: None}
    rows = [(i, t, None if i == 3 else len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, e.queries()["posexplode_all_words"](spark, str(tmp_path)).collect()))
    assert got == [(i, k, w) for i, t in texts.items() if t is not None for k, w in enumerate(t.split(" "))]
