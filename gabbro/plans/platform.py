"""Platform features as queries over the driver tables: store, ingestion, streaming, quality, access,
change capture and SQL functions, each with its DuckDB oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gabbro.operators import scd
from gabbro.operators.governance import Catalog
from gabbro.operators.perf import trend
from gabbro.operators.quality import Check, contract_report, run_checks
from gabbro.operators.store import VersionedTable
from gabbro.plans.jobs import missing_runs
from gabbro.sources import ingest
from gabbro.streaming import flows
from gabbro.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the store that all executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/gabbro-core/{name}-{uuid.uuid4().hex}"


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, upper(c_mktsegment), c_nationkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0"""
)
def store_merge(spark, sf):
    """Two thirds of the customers, then an upsert of all even ones."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    t = VersionedTable(spark, scratch(spark, "merge"))
    t.append(c.filter("c_custkey % 3 <> 0"))
    t.merge(c.filter("c_custkey % 2 = 0").withColumn("c_mktsegment", F.upper("c_mktsegment")), ["c_custkey"])
    return t.read()


@query(
    """SELECT 0 AS version, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 1, count(*), sum(o_custkey)::BIGINT FROM orders
UNION ALL SELECT 2, count(*), sum(o_custkey)::BIGINT FROM orders WHERE o_orderpriority <> '1-URGENT'
UNION ALL SELECT 3, count(*), sum(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_custkey END)::BIGINT FROM orders WHERE o_orderpriority <> '1-URGENT'
UNION ALL SELECT 4, count(*), sum(o_custkey)::BIGINT FROM orders"""
)
def store_time_travel(spark, sf):
    """Append, delete, update and restore: every version stays readable."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    t = VersionedTable(spark, scratch(spark, "travel"))
    t.append(o.filter("o_orderstatus = 'F'"))
    t.append(o.filter("o_orderstatus <> 'F'"))
    t.delete("o_orderpriority = '1-URGENT'")
    t.update("o_orderstatus = 'O'", {"o_custkey": "0"})
    t.restore(1)
    out = None
    for v in range(5):
        row = t.read(v).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys")).select(F.lit(v).alias("version"), "n", "keys")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    """SELECT 'insert' AS _change_type, count(*) AS n FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT k, count(*) FROM supplier, (SELECT unnest(['update_preimage', 'update_postimage']) AS k) WHERE s_suppkey % 4 = 1 GROUP BY k"""
)
def store_change_feed(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    t = VersionedTable(spark, scratch(spark, "feed"))
    t.append(s.filter("s_suppkey % 4 <> 0"))
    t.merge(s.filter("s_suppkey % 4 < 2").withColumn("s_name", F.concat("s_name", F.lit("!"))), ["s_suppkey"])
    return t.changes(1, 1, ["s_suppkey"]).groupBy("_change_type").agg(F.count("*").alias("n"))


def events_as_json(spark: SparkSession, sf: str, folder: str) -> None:
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"))
    e.write.mode("append").option("compression", "gzip").json(folder)


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events GROUP BY ALL")
def copy_into_idempotent(spark, sf):
    """Gzip JSON files loaded twice: the second load finds nothing new."""
    top = scratch(spark, "copy")
    events_as_json(spark, sf, f"{top}/in")
    t = VersionedTable(spark, f"{top}/t")
    read = lambda s, paths: s.read.schema("event_id long, event_type string").json([p for p in paths if p.endswith(".gz")])
    ingest.copy_into(t, f"{top}/in", read, "b1")
    ingest.copy_into(t, f"{top}/in", read, "b2")
    return t.read().groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"))


@query("SELECT event_type, count(*) AS n, date_trunc('second', min(ts))::TIMESTAMP AS first_ts FROM events GROUP BY ALL")
def stream_bronze(spark, sf):
    """A file stream run twice over one folder: each file once."""
    top = scratch(spark, "stream")
    events_as_json(spark, sf, f"{top}/in")
    for _ in range(2):
        flows.append_once(flows.read_files(spark, f"{top}/in", "json", "event_id long, event_type string, ts timestamp_ntz"), f"{top}/out", f"{top}/ck")
    return spark.read.parquet(f"{top}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query(
    """SELECT count(*) + count(*) FILTER (o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')) AS n, max(o_orderdate)::VARCHAR AS watermark FROM orders"""
)
def incremental_extract(spark, sf):
    """Two extracts by cursor: rows at the border come again, none is missed."""
    top = scratch(spark, "extract")
    j, m = VersionedTable(spark, f"{top}/j"), ingest.Watermarks(VersionedTable(spark, f"{top}/w"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    ingest.incremental_extract(o.filter("o_orderdate < timestamp_ntz'1996-01-01'"), "o_orderdate", "orders", j, m, "b1")
    ingest.incremental_extract(o, "o_orderdate", "orders", j, m, "b2")
    return j.read().agg(F.count("*").alias("n"), F.max("o_orderdate").cast("string").alias("watermark"))


@query(
    """SELECT 'orders' AS "table", 'rows' AS name, count(*)::DOUBLE AS value, count(*) >= 1 AS passed FROM orders
UNION ALL SELECT 'orders', 'orphans', count(*)::DOUBLE, count(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem', 'duplicate_keys', sum(n - 1)::DOUBLE, sum(n - 1) <= 0 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
)
def check_engine(spark, sf):
    for n in ("orders", "customer", "lineitem"):
        table(spark, sf, n).createOrReplaceTempView(f"chk_{n}")
    checks = [
        Check("silver", "orders", "rows", "SELECT count(*) FROM chk_orders", 1, ">="),
        Check("silver", "orders", "orphans", "SELECT count(*) FROM chk_orders LEFT ANTI JOIN chk_customer ON o_custkey = c_custkey", 0, "="),
        Check("silver", "lineitem", "duplicate_keys", "SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM chk_lineitem GROUP BY l_orderkey, l_linenumber)", 0),
    ]
    return run_checks(spark, checks, "r1").select("table", "name", "value", "passed")


@query(
    """SELECT rule, count(*) AS scope, sum(bad)::BIGINT AS violations, round(sum(bad)::DOUBLE / count(*), 6) AS rate FROM (
  SELECT 'positive_total' AS rule, CASE WHEN o_totalprice > 1000 THEN 0 ELSE 1 END AS bad FROM orders
  UNION ALL SELECT 'known_status', CASE WHEN o_orderstatus IN ('F', 'O') THEN 0 ELSE 1 END FROM orders
  UNION ALL SELECT 'priority_form', CASE WHEN regexp_full_match(o_orderpriority, '[1-5]-[A-Z ]+') THEN 0 ELSE 1 END FROM orders) GROUP BY rule"""
)
def contract_violations(spark, sf):
    return contract_report(table(spark, sf, "orders"), {"positive_total": "o_totalprice > 1000", "known_status": "o_orderstatus in ('F', 'O')", "priority_form": "o_orderpriority rlike '^[1-5]-[A-Z ]+$'"})


@query("SELECT c_custkey, 'C-' || substr(sha256(c_name), 1, 8) AS c_name, c_mktsegment FROM customer")
def pii_mask(spark, sf):
    cat = Catalog(groups={"privacy": {"ann"}})
    cat.grant("SELECT", "gold.customer", "bob")
    cat.tag("gold.customer", "c_name", pii="name")
    cat.policy("pii", "name", "concat('C-', substr(sha2(c_name, 256), 1, 8))", {"privacy"})
    return cat.read_as("bob", "gold.customer", table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (3, 7)")
def row_filter(spark, sf):
    cat = Catalog(groups={"north": {"bob"}, "all": set()})
    cat.grant("SELECT", "gold", "bob")
    cat.row_filter("gold.customer", {"north": "c_nationkey in (3, 7)", "all": "true"})
    return cat.read_as("bob", "gold.customer", table(spark, sf, "customer").select("c_custkey", "c_nationkey"))


@query(
    """SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'"""
)
def auto_cdc_type1(spark, sf):
    feed = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return scd.auto_cdc(feed, ["user_id"], "event_id", 1, "event_type = 'error'")


@query(
    """WITH e AS (SELECT *, event_type = 'error' AS gone, lag(event_type) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT * FROM e WHERE was IS NULL OR was <> event_type), n AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to FROM c)
SELECT user_id, event_type, event_id AS valid_from, valid_to, valid_to IS NULL AS is_current FROM n WHERE NOT gone"""
)
def auto_cdc_type2(spark, sf):
    feed = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return scd.auto_cdc(feed, ["user_id"], "event_id", 2, "event_type = 'error'")


@query(
    """WITH h AS (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM (SELECT DISTINCT ON (user_id, ts) * FROM events ORDER BY user_id, ts, event_type DESC))
SELECT unnest(['several_current', 'no_current', 'gap_or_overlap', 'empty_interval', 'current_is_closed']) AS "check", 0::BIGINT AS violations"""
)
def scd2_integrity(spark, sf):
    j = table(spark, sf, "events").select("user_id", "ts", F.col("event_type").alias("status"))
    return scd.integrity(scd.rebuild(j, "user_id", "ts", ["status"]), "user_id")


@query(
    """WITH d AS (SELECT unnest(range(30)) AS k), u AS (SELECT DISTINCT user_id FROM events),
s AS (SELECT user_id, k, (SELECT min(ts) FROM events) + to_days(k::INTEGER) AS due FROM u, d)
SELECT user_id, count(*) AS n_missing FROM s WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = s.user_id AND e.ts >= due AND e.ts < due + INTERVAL 1 DAY) GROUP BY ALL"""
)
def missing_scheduled_runs(spark, sf):
    """Days of a month on which a user did nothing: an anti join with an inequality."""
    e = table(spark, sf, "events")
    start = e.agg(F.min("ts").alias("start"))
    sched = e.select("user_id").distinct().crossJoin(F.broadcast(start)).select(F.col("user_id").alias("job"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("k"), "start")
    sched = sched.select("job", (F.col("start") + F.make_dt_interval(days="k")).alias("due"), (F.col("start") + F.make_dt_interval(days=F.col("k") + 1)).alias("until"))
    return missing_runs(sched, e.select(F.col("user_id").alias("job"), F.col("ts").alias("started"))).groupBy(F.col("job").alias("user_id")).agg(F.count("*").alias("n_missing"))


@query(
    """SELECT task, seconds, round(usual, 4) AS usual, round(seconds / nullif(usual, 0), 4) AS ratio FROM (
  SELECT event_type AS task, value AS seconds, avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS usual,
    row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def job_perf_trend(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_type").alias("task"), F.col("event_id").alias("started"), F.col("value").alias("seconds"))
    return trend(runs).select("task", "seconds", F.round("usual", 4).alias("usual"), F.round("ratio", 4).alias("ratio"))


@query("SELECT o_orderstatus, count(*) AS n, sum(o_totalprice::DECIMAL(12,2) * 0.2)::DECIMAL(18,2) AS tax FROM orders WHERE o_totalprice >= 100000 GROUP BY ALL")
def sql_functions(spark, sf):
    """A scalar SQL function, a table function and a named parameter."""
    table(spark, sf, "orders").createOrReplaceTempView("fn_orders")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fn_tax(x DECIMAL(12,2)) RETURNS DECIMAL(14,3) RETURN x * 0.2")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fn_above(least DOUBLE) RETURNS TABLE (status STRING, price DECIMAL(12,2)) RETURN SELECT o_orderstatus, cast(o_totalprice AS DECIMAL(12,2)) FROM fn_orders WHERE o_totalprice >= least")
    return spark.sql("SELECT status AS o_orderstatus, count(*) AS n, cast(sum(fn_tax(price)) AS DECIMAL(18,2)) AS tax FROM fn_above(:least) GROUP BY status", args={"least": 100000.0})


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 3 = 0 THEN 'extra' END IS NOT NULL AS has_rescue FROM events WHERE event_id % 50 <> 0")
def json_rescue(spark, sf):
    """JSON lines with a field that no schema declares, and cut lines: both are kept aside."""
    top = scratch(spark, "rescue")
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    whole = F.to_json(F.struct("event_id", "k", F.when(F.col("event_id") % 3 == 0, F.lit("extra")).alias("more")))
    e.select(F.when(F.col("event_id") % 50 == 0, F.substring(whole, 1, 9)).otherwise(whole).alias("value")).write.text(top)
    got = ingest.read_json(spark, top, "event_id long, k string")
    return got.filter(F.col("_corrupt_record").isNull()).select("event_id", "k", F.col("_rescued_data").isNotNull().alias("has_rescue"))


@query("SELECT p_brand, count(*) AS n_files_rows FROM part WHERE p_size BETWEEN 10 AND 12 GROUP BY ALL")
def clustered_store_scan(spark, sf):
    """A table clustered by its filter column: row groups outside the range are skipped."""
    t = VersionedTable(spark, scratch(spark, "cluster"))
    t.append(table(spark, sf, "part"))
    t.optimize(["p_size"], 4)
    return t.read().filter(F.col("p_size").between(10, 12)).groupBy("p_brand").agg(F.count("*").alias("n_files_rows"))
