"""Tables, schemas, layout, SQL functions, streams and operations records as queries over the driver tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from gabbro.operators import governance, ops, perf
from gabbro.operators.store import VersionedTable
from gabbro.plans.platform import scratch
from gabbro.sources import ingest
from gabbro.streaming import flows
from gabbro.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- store and layout


@query("SELECT o_orderpriority, count(*) AS n, 1 AS files_of_others FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL")
def partitioned_store(spark, sf):
    """A table partitioned by status: a read of one status opens that partition's files only."""
    t = VersionedTable(spark, scratch(spark, "partitioned"))
    t.replace(table(spark, sf, "orders"), partition_by=["o_orderstatus"])
    got = t.read(partitions={"o_orderstatus": ["F"]})
    fewer = int(len(got.inputFiles()) < len(t.read().inputFiles()))
    return got.groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("files_of_others", F.lit(fewer))


@query("SELECT count(*) AS n, true AS most_files_skipped FROM part WHERE p_size BETWEEN 10 AND 12 AND p_retailprice BETWEEN 920 AND 960")
def zorder_skips_files(spark, sf):
    """Along a Z-order of two columns a filter on both needs few of the files."""
    t = VersionedTable(spark, scratch(spark, "zorder"))
    t.append(table(spark, sf, "part"))
    t.optimize(files=16, zorder_by=["p_size", "p_retailprice"])
    where = "p_size BETWEEN 10 AND 12 AND p_retailprice BETWEEN 920 AND 960"
    holding, every = t.skipped(where)
    return t.read().filter(where).agg(F.count("*").alias("n")).withColumn("most_files_skipped", F.lit(holding * 2 <= every))


@query("SELECT count(*) AS n, true AS most_files_skipped FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01'")
def clustering_skips_files(spark, sf):
    t = VersionedTable(spark, scratch(spark, "clustered"))
    t.append(table(spark, sf, "orders"))
    t.optimize(["o_orderdate"], 12)
    where = "o_orderdate < timestamp_ntz'1993-01-01'"
    holding, every = t.skipped(where)
    return t.read().filter(where).agg(F.count("*").alias("n")).withColumn("most_files_skipped", F.lit(holding * 2 <= every))


@query("SELECT 0::BIGINT AS untouched_rewritten, count(*) AS n, sum(CASE WHEN o_orderkey = 5 THEN 0 ELSE o_custkey END)::BIGINT AS keys FROM orders WHERE o_orderkey <> 7")
def file_level_changes(spark, sf):
    """An update and a delete of one key each rewrite one file of twelve."""
    t = VersionedTable(spark, scratch(spark, "files"))
    t.append(table(spark, sf, "orders").repartitionByRange(12, "o_orderkey"))
    t.update("o_orderkey = 5", {"o_custkey": "0"})
    t.delete("o_orderkey = 7")
    more = sum(max(0, len(c.get("remove", [])) - 1) for c in t.log()[1:])
    return t.read().agg(F.lit(more).cast("long").alias("untouched_rewritten"), F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


@query(
    """SELECT 'c_custkey' AS "column", count(*) AS "rows", 0::BIGINT AS nulls, min(c_custkey)::VARCHAR AS least, max(c_custkey)::VARCHAR AS greatest FROM customer
UNION ALL SELECT 'c_mktsegment', count(*), count(*) FILTER (c_custkey % 5 = 0), min(s), max(s) FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS s FROM customer)"""
)
def analyzed(spark, sf):
    t = VersionedTable(spark, scratch(spark, "analyzed"))
    t.append(table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment")))
    return t.analyze().drop("distinct_about")


@query("SELECT 'now' AS state, count(*) AS n FROM supplier UNION ALL SELECT 'clone', count(*) FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'restored', count(*) FROM supplier")
def restore_by_time(spark, sf):
    """Delete, clone, vacuum of nothing that is in use, then back to the time before."""
    t = VersionedTable(spark, scratch(spark, "restore"))
    t.append(table(spark, sf, "supplier"))
    before = t.log()[-1]["timestamp_ms"]
    t.delete("s_suppkey % 2 = 1")
    other = t.clone(scratch(spark, "restore-clone"))
    t.vacuum(retain_hours=1)
    clone = other.read().agg(F.lit("clone").alias("state"), F.count("*").alias("n"))
    t.restore(timestamp_ms=before)
    rows = t.read().agg(F.lit("restored").alias("state"), F.count("*").alias("n"))
    return clone.unionByName(rows).unionByName(t.read(0).agg(F.lit("now").alias("state"), F.count("*").alias("n")))


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'north' END AS area FROM supplier")
def merge_new_columns(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    t = VersionedTable(spark, scratch(spark, "widen"))
    t.create("s_suppkey bigint, s_name string", {"s_suppkey": "key"})
    t.append(s)
    t.merge(s.filter("s_suppkey % 3 = 0").withColumn("area", F.lit("north")), ["s_suppkey"], merge_schema=True)
    return t.read()


@query("SELECT k AS _change_type, n FROM (SELECT 'delete' AS k, count(*) AS n FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT 'insert', count(*) FROM orders)")
def change_feed_of_files(spark, sf):
    """The feed of an append and a delete, from the files that the commits name."""
    t = VersionedTable(spark, scratch(spark, "feed-files"))
    t.append(table(spark, sf, "orders"))
    t.delete("o_orderkey % 100 = 0")
    return t.changes(0).groupBy("_change_type").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- schemas, tables, views


@query("SELECT n_regionkey, count(*) AS n, 'of_nation, v_nation' AS objects, 'n_nationkey,n_name,n_regionkey' AS columns FROM nation GROUP BY ALL")
def catalog_ddl(spark, sf):
    """A schema, a table made from a query, a comment, a view over it, and what the catalog lists."""
    db = f"db_{uuid.uuid4().hex[:12]}"
    table(spark, sf, "nation").createOrReplaceTempView("ddl_nation")
    spark.sql(f"CREATE SCHEMA {db} COMMENT 'of a query' LOCATION '{scratch(spark, 'schema')}'")
    try:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {db}.of_nation USING parquet AS SELECT * FROM ddl_nation")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {db}.of_nation (x INT) USING parquet")
        spark.sql(f"CREATE OR REPLACE VIEW {db}.v_nation AS SELECT n_regionkey, count(*) AS n FROM {db}.of_nation GROUP BY n_regionkey")
        names = ", ".join(sorted(r["tableName"] for r in spark.sql(f"SHOW TABLES IN {db}").collect() if not r["isTemporary"]))
        listed = governance.table_columns(spark, db).filter("table = 'of_nation'").collect()
        assert db in [r[0] for r in spark.sql("SHOW SCHEMAS").collect()]
        assert spark.sql(f"DESCRIBE SCHEMA {db}").filter("info_name = 'Comment'").first()[1] == "of a query"
        spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ddl_twice(x INT) RETURNS INT RETURN 2 * x")
        assert [r[0] for r in spark.sql("SHOW USER FUNCTIONS LIKE 'ddl_*'").collect()]
        rows = spark.table(f"{db}.v_nation").collect()  # a row a region
    finally:
        spark.sql(f"DROP SCHEMA {db} CASCADE")
    return spark.createDataFrame([(r["n_regionkey"], r["n"], names, ",".join(c["column"] for c in listed)) for r in rows], "n_regionkey int, n long, objects string, columns string")


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey FROM nation")
def read_files_by_format(spark, sf):
    """Files of a folder by their extension, one column's type hinted."""
    top = scratch(spark, "read-files")
    table(spark, sf, "nation").write.option("header", True).csv(f"{top}/csv")
    table(spark, sf, "nation").limit(0).write.json(f"{top}/json")
    return ingest.read_files(spark, f"{top}/csv", hints={"n_regionkey": "int"}, header=True)


@query("SELECT r_regionkey AS id, r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'kept' END AS kept FROM region")
def read_modes(spark, sf):
    """PERMISSIVE keeps bad lines, DROPMALFORMED drops them, FAILFAST raises."""
    top = scratch(spark, "modes")
    r = table(spark, sf, "region")
    r.select(F.when(F.col("r_regionkey") % 2 == 0, F.concat_ws(",", F.col("r_regionkey").cast("string"), "r_name")).otherwise(F.concat(F.lit("x"), F.col("r_regionkey").cast("string"), F.lit(","), F.col("r_name"))).alias("value")).write.text(top)
    read = lambda mode: spark.read.schema("id int, name string, _bad string").options(mode=mode, columnNameOfCorruptRecord="_bad").csv(top)
    failed = False
    try:
        read("FAILFAST").select("id", "name").write.format("noop").mode("overwrite").save()
    except Exception as e:  # noqa: BLE001  the reader's own class of error
        failed = "MALFORMED" in str(e).upper()
    assert failed or not r.filter("r_regionkey % 2 = 1").limit(1).count()
    kept = spark.read.schema("id int, name string").options(mode="DROPMALFORMED").csv(top).withColumn("kept", F.lit("kept"))
    every = read("PERMISSIVE").select(F.coalesce("id", F.regexp_extract("_bad", r"x(\d+)", 1).try_cast("int")).alias("id"), "name")
    return every.join(kept.select("id", "kept"), "id", "left")


# ---------------------------------------------------------------- SQL functions and access


@query(
    """SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN c_name ELSE '***' END AS c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2))"""
)
def sql_mask_and_filter(spark, sf):
    """A mask and a row filter as SQL functions that look a policy table up."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    policy = n.select(F.col("n_nationkey").alias("nation"), (F.col("n_regionkey") == 1).alias("clear"), F.col("n_regionkey").isin(1, 2).alias("visible"))
    policy.createOrReplaceTempView("acc_policy")
    c.createOrReplaceTempView("acc_customer")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION acc_mask(v STRING, who INT) RETURNS STRING RETURN CASE WHEN who IN (SELECT nation FROM acc_policy WHERE clear) THEN v ELSE '***' END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION acc_sees(who INT) RETURNS BOOLEAN RETURN EXISTS (SELECT 1 FROM acc_policy WHERE nation = who AND visible)")
    return spark.sql("SELECT c_custkey, acc_mask(c_name, c_nationkey) AS c_name FROM acc_customer WHERE acc_sees(c_nationkey)")


@query("SELECT c_custkey, '***' AS c_name FROM customer WHERE c_nationkey = 3")
def view_inherits_access(spark, sf):
    """A view has no rules of its own: what it shows is what its table shows to the user."""
    cat = governance.Catalog(groups={"north": {"bob"}})
    cat.grant("SELECT", "gold", "bob")
    cat.mask("gold.customer", "c_name", "'***'", set())
    cat.row_filter("gold.customer", {"north": "c_nationkey = 3"})
    cat.view("gold.v_customer", "gold.customer", lambda df: df.select("c_custkey", "c_name"))
    return cat.read_as("bob", "gold.v_customer", table(spark, sf, "customer"))


@query("SELECT 'SELECT' AS privilege, 'gold' AS object, 'bob' AS principal, 'GRANT' AS kind UNION ALL SELECT 'SELECT', 'gold.secret', 'bob', 'DENY' UNION ALL SELECT 'ALL', 'silver', 'ann', 'GRANT'")
def privilege_audit(spark, sf):
    cat = governance.Catalog()
    cat.grant("SELECT", "gold", "bob")
    cat.grant("ALL", "silver", "ann")
    cat.grant("MODIFY", "silver", "bob")
    cat.revoke("MODIFY", "silver", "bob")
    cat.deny("SELECT", "gold.secret", "bob")
    stored = VersionedTable(spark, scratch(spark, "audit"))
    stored.append(cat.audit(spark))
    return stored.read().select("privilege", "object", "principal", "kind")


# ---------------------------------------------------------------- streams


def _event_files(spark, sf, top: str, parts: int = 1) -> str:
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    e.repartition(parts).write.parquet(f"{top}/in")
    return f"{top}/in"


EVENT = "event_id long, user_id long, event_type string, ts timestamp"


def _streamed(spark, stream, mode: str = "append"):
    """What a bounded run of a stream emits, all windows closed by its end."""
    top = scratch(spark, "emitted")
    flows.append_once(stream, f"{top}/out", f"{top}/ck")
    return spark.read.parquet(f"{top}/out")


@query(
    """SELECT epoch_us(s)::BIGINT AS start_us, event_type, count(*) AS n FROM (SELECT event_type, ts, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events)
WHERE s + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL"""
)
def stream_sliding(spark, sf):
    """Two-hour windows every hour over a stream; those that the watermark has closed."""
    e = flows.read_files(spark, _event_files(spark, sf, scratch(spark, "sliding")), "parquet", EVENT)
    out = _streamed(spark, flows.sliding(e, "ts", "2 hours", "1 hour", ["event_type"], late="1 day"))
    end = table(spark, sf, "events").agg((F.max("ts").cast("timestamp") - F.expr("interval 1 day")).alias("closed"))
    got = out.join(F.broadcast(end), F.col("start") + F.expr("interval 2 hours") <= F.col("closed"))
    return got.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("SELECT count(*) AS n_events, count(DISTINCT event_id) AS n_ids FROM events")
def stream_two_flows(spark, sf):
    """Two flows with checkpoints of their own over one folder: each sees every file once."""
    top = scratch(spark, "flows")
    folder = _event_files(spark, sf, top, 3)
    flows.append_once(flows.read_files(spark, folder, "parquet", EVENT), f"{top}/a", f"{top}/ck-a")
    flows.append_once(flows.read_files(spark, folder, "parquet", EVENT, max_files=1), f"{top}/b", f"{top}/ck-b")
    flows.append_once(flows.read_files(spark, folder, "parquet", EVENT), f"{top}/a", f"{top}/ck-a")
    a, b = spark.read.parquet(f"{top}/a"), spark.read.parquet(f"{top}/b")
    return a.agg(F.count("*").alias("n_events")).join(b.agg(F.countDistinct("event_id").alias("n_ids")), F.lit(True))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_dedup(spark, sf):
    """Events delivered twice, the second time in another file: one each."""
    top = scratch(spark, "sdedup")
    folder = _event_files(spark, sf, top)
    spark.read.parquet(folder).filter("event_id % 4 = 0").write.mode("append").parquet(folder)
    e = flows.read_files(spark, folder, "parquet", EVENT)
    return _streamed(spark, flows.dedup_recent(e, "event_id", "ts", "400 days")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    """SELECT s.user_id, s.event_id AS signup, p.event_id AS purchase FROM events s JOIN events p ON s.user_id = p.user_id AND p.ts >= s.ts AND p.ts <= s.ts + INTERVAL 2 HOUR
WHERE s.event_type = 'signup' AND p.event_type = 'purchase'"""
)
def stream_stream_join(spark, sf):
    """Sign-ups with purchases of the same user within two hours: state is kept for as long as that."""
    folder = _event_files(spark, sf, scratch(spark, "ssjoin"))
    side = lambda kind: flows.read_files(spark, folder, "parquet", EVENT).filter(F.col("event_type") == kind)
    joined = flows.interval_join(side("signup"), side("purchase"), "user_id", "ts", "2 hours")
    return _streamed(spark, joined.select("user_id", F.col("event_id").alias("signup"), F.col("right_event_id").alias("purchase")))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY ALL")
def stream_running_state(spark, sf):
    """A custom stateful operator: a running count by user over three micro-batches; its last value."""
    top = scratch(spark, "state")
    e = flows.read_files(spark, _event_files(spark, sf, top, 3), "parquet", EVENT, max_files=1)
    flows.run_updates(flows.running_count(e, "user_id"), f"{top}/out", f"{top}/ck")
    return spark.read.parquet(f"{top}/out").groupBy("user_id").agg(F.max("n").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL")
def kafka_shaped(spark, sf):
    """Rows as a Kafka source gives them, parsed."""
    e = table(spark, sf, "events").filter("event_id % 2 = 0")
    rows = e.select(
        F.col("user_id").cast("string").cast("binary").alias("key"), F.to_json(F.struct("event_id", "event_type")).cast("binary").alias("value"), F.lit("events").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )
    return ingest.kafka_values(rows, "event_id long, event_type string").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 3 <> 2 GROUP BY ALL")
def store_stream(spark, sf):
    """A versioned table as a stream, followed twice: every appending commit once, rewrites not at all."""
    top = scratch(spark, "follow")
    t, e = VersionedTable(spark, f"{top}/t"), table(spark, sf, "events").select("event_id", "event_type")
    out = VersionedTable(spark, f"{top}/out")
    t.append(e.filter("event_id % 3 = 0"))
    flows.follow(t, lambda rows, n: out.append(rows), f"{top}/ck")
    t.append(e.filter("event_id % 3 = 1"))
    t.optimize(files=1)
    flows.follow(t, lambda rows, n: out.append(rows), f"{top}/ck")
    return out.read().groupBy("event_type").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- databases


def _database(spark, sf) -> str:
    """A database in the memory of the driver's JVM with the orders, by the JDBC driver that Spark brings
    along: for sessions whose executors are in that JVM."""
    spark.sparkContext._jvm.System.setProperty("derby.stream.error.file", os.devnull)  # noqa: SLF001
    url = f"jdbc:derby:memory:db{uuid.uuid4().hex[:8]};create=true"
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"))
    o.write.jdbc(url, "orders", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver", "createTableColumnTypes": "o_orderstatus varchar(8)"})
    return url


@query("SELECT o_orderstatus, count(*) AS n, sum(o_totalprice::DECIMAL(12,2))::DECIMAL(18,2) AS total FROM orders WHERE o_custkey > 10 GROUP BY ALL")
def jdbc_partitioned(spark, sf):
    """A database table read in four ranges of its key; the filter is pushed to the database."""
    df = ingest.jdbc(spark, _database(spark, sf), "orders", ("o_orderkey", 0, 15000, 4), driver="org.apache.derby.jdbc.EmbeddedDriver")
    return df.filter("o_custkey > 10").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").cast("decimal(18,2)").alias("total"))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL")
def jdbc_pushed_query(spark, sf):
    """A subquery that the database computes, as the source of a frame."""
    df = ingest.jdbc(spark, _database(spark, sf), "", query="SELECT \"o_custkey\", count(*) AS n FROM orders WHERE \"o_orderstatus\" = 'F' GROUP BY \"o_custkey\"", driver="org.apache.derby.jdbc.EmbeddedDriver")
    return df.select("o_custkey", F.col("N").cast("long").alias("n"))


# ---------------------------------------------------------------- operations records


@query("SELECT 'revenue_drop' AS incident, 2::BIGINT AS n_entries, (SELECT sum(o_totalprice::DECIMAL(12,2)) FROM orders)::DECIMAL(18,2) AS amount")
def incident_log(spark, sf):
    """Two entries about one incident, amounts as decimals."""
    total = table(spark, sf, "orders").agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("decimal(18,2)")).first()[0]
    log = ops.OperationsLog(VersionedTable(spark, scratch(spark, "incidents")), "incident string, step string, amount decimal(18,2)")
    log.add(incident="revenue_drop", step="found", amount=total)
    log.add(incident="revenue_drop", step="closed", amount="0")
    return log.rows().groupBy("incident").agg(F.count("*").alias("n_entries"), F.sum("amount").cast("decimal(18,2)").alias("amount"))


@query("SELECT 'prod' AS target, 'v2' AS version, 2::BIGINT AS n_deployments")
def deployment_log(spark, sf):
    log = ops.OperationsLog(VersionedTable(spark, scratch(spark, "deployments")), "target string, version string, outcome string")
    for version, outcome in (("v1", "SUCCESS"), ("v2", "SUCCESS")):
        log.add(target="prod", version=version, outcome=outcome)
    rows = log.rows()
    return rows.groupBy("target").agg(F.max_by("version", "at").alias("version"), F.count("*").alias("n_deployments"))


@query("SELECT 'join' AS scenario, 2::BIGINT AS n_variants, 1::BIGINT AS n_results, true AS planned")
def measured_variants(spark, sf):
    """Two variants of a join, measured; they agree in rows."""
    li, su = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    on = F.col("l_suppkey") == F.col("s_suppkey")
    got = perf.record(spark, "join", {"broadcast": li.join(F.broadcast(su), on), "shuffle": li.join(su.hint("merge"), on)})
    planned = "SortMergeJoin" in perf.plan_text(li.join(su.hint("merge"), on))
    return got.groupBy("scenario").agg(F.count("*").alias("n_variants"), F.countDistinct("rows_out").alias("n_results")).withColumn("planned", F.lit(planned))


@query("SELECT count(*) AS n FROM events WHERE event_id >= 0")
def triggered_by_files(spark, sf):
    """A trigger that fires once for new files and once a schedule, and not again without news."""
    top = scratch(spark, "trigger")
    folder = _event_files(spark, sf, top)
    t = ops.FileTrigger(spark, folder, f"{top}/seen")
    fired = [t.fired(), t.fired()]
    assert fired == [True, False]
    return spark.read.parquet(folder).agg(F.count("*").alias("n"))
