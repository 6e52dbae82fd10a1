"""Metadata, journals, expectations, jobs and schema changes as queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gabbro.functions import clean
from gabbro.operators import governance, quality
from gabbro.operators.store import ConstraintError, VersionedTable
from gabbro.plans.declarative import Pipeline
from gabbro.plans.jobs import Job, profile
from gabbro.plans.platform import scratch
from gabbro.sources import ingest
from gabbro.streaming import flows
from gabbro.tables import table, tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- expressions over raw input


@query("SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY ALL")
def schema_discovery(spark, sf):
    """JSON text parsed by the schema that one example shows."""
    e = table(spark, sf, "events")
    example = e.select("props").first()[0]
    return e.select("event_type", F.from_json("props", ingest.schema_of(example)).alias("p")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


@query("SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS at FROM events")
def two_timestamp_formats(spark, sf):
    """Half of the times as ISO text, half as epoch milliseconds, one reader for both."""
    ts = F.date_trunc("second", F.col("ts")).cast("timestamp")
    raw = F.when(F.col("event_id") % 2 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.unix_millis(ts).cast("string"))
    return table(spark, sf, "events").select("event_id", clean.dual_ts(raw).cast("timestamp_ntz").alias("at"))


@query("SELECT n_nationkey AS k, n_name AS name, NULL::INTEGER AS region FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey >= 5")
def union_by_name(spark, sf):
    """By name a missing column raises, unless it may be missing: then it is null."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    short, whole = n.filter("k < 5").drop("region"), n.filter("k >= 5")
    try:
        short.unionByName(whole).collect()
        raise AssertionError("a missing column passed")
    except Exception as e:  # noqa: BLE001  the analyzer's own class of error
        if isinstance(e, AssertionError):
            raise
    return short.unionByName(whole, allowMissingColumns=True)


@query("SELECT true AS has_user, true AS has_time, true AS has_zone, count(*) AS n FROM region")
def session_identity(spark, sf):
    return table(spark, sf, "region").agg(
        F.count("*").alias("n"), F.first(F.length(F.current_user()) > 0).alias("has_user"), F.first(F.current_timestamp() > F.lit("2020-01-01").cast("timestamp")).alias("has_time"), F.first(F.length(F.current_timezone()) > 0).alias("has_zone")
    ).select("has_user", "has_time", "has_zone", "n")


@query("SELECT count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS m, 1 - count(*)::DOUBLE / count(*) FILTER (o_orderstatus <> 'F') AS drop FROM orders")
def reference_volume_drop(spark, sf):
    o = table(spark, sf, "orders")
    return quality.volume_drop(o, o.filter("o_orderstatus <> 'F'"))


# ---------------------------------------------------------------- tables and their metadata


@query(
    """SELECT 'comment' AS what, 'customers' AS value UNION ALL SELECT 'c_name', 'full name' UNION ALL SELECT 'tag', 'pii=name' UNION ALL SELECT 'owner', 'sales'
UNION ALL SELECT 'rows', count(*)::VARCHAR FROM customer UNION ALL SELECT 'files', '3'"""
)
def table_metadata(spark, sf):
    """Comments, properties, tags and the detail of a table."""
    t, cat = VersionedTable(spark, scratch(spark, "metadata")), governance.Catalog()
    t.append(table(spark, sf, "customer").repartition(3))
    t.comment("customers", c_name="full name")
    t.set_props(owner="sales")
    cat.tag("gold.customer", "c_name", pii="name")
    d, tag = t.detail().first(), cat.tagged(spark).first()
    rows = [("comment", d["comment"]), ("c_name", t._state()["column_comments"]["c_name"]), ("tag", f"{tag['tag']}={tag['value']}"), ("owner", d["props"]["owner"]), ("rows", str(t.read().count())), ("files", str(d["num_files"]))]
    return spark.createDataFrame(rows, "what string, value string")


@query("SELECT count(*) AS n, 2::BIGINT AS refused FROM supplier")
def constraints_refuse(spark, sf):
    """NOT NULL and CHECK: appends against them leave the table as it was."""
    s = table(spark, sf, "supplier")
    t = VersionedTable(spark, scratch(spark, "constraints"))
    t.append(s)
    t.add_constraint("named", "s_name IS NOT NULL")
    t.add_constraint("keyed", "s_suppkey >= 0")
    refused = 0
    for bad in (s.limit(1).withColumn("s_name", F.lit(None).cast("string")), s.limit(1).withColumn("s_suppkey", F.lit(-1).cast("long"))):
        try:
            t.append(bad)
        except ConstraintError:
            refused += 1
    return t.read().agg(F.count("*").alias("n"), F.lit(refused).cast("long").alias("refused"))


@query("SELECT 'APPEND' AS op, 1::BIGINT AS n UNION ALL SELECT 'DELETE', 1 UNION ALL SELECT 'RESTORE', 1 UNION ALL SELECT 'TRUNCATE', 1")
def table_history(spark, sf):
    t = VersionedTable(spark, scratch(spark, "history"))
    t.append(table(spark, sf, "nation"))
    t.delete("n_nationkey < 5")
    t.truncate()
    t.restore(0)
    return t.history().groupBy("op").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- pipelines and jobs


@query(
    """SELECT expectation, failed FROM (SELECT 'known_status' AS expectation, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS failed FROM orders
UNION ALL SELECT 'large', count(*) FILTER (o_totalprice <= 1000) FROM orders)"""
)
def expectation_metrics(spark, sf):
    """A declarative pipeline with a dropping and a warning expectation; its event log."""
    p = Pipeline(spark, scratch(spark, "expectations"))

    @p.dataset(kind="temporary")
    def raw():
        return table(spark, sf, "orders")

    @p.dataset(reads=["raw"], drop={"known_status": "o_orderstatus in ('F', 'O')"}, warn={"large": "o_totalprice > 1000"})
    def silver(raw):
        return raw

    p.run("u1")
    return p.metrics().select("expectation", F.col("failed").cast("long").alias("failed"))


@query(
    """SELECT * FROM (VALUES ('extract', 'SUCCESS', 2), ('load', 'SUCCESS', 1), ('repair', 'SKIPPED', 0), ('report', 'SUCCESS', 1)) t(task, status, attempts)"""
)
def job_journal(spark, sf):
    """A graph of tasks with a retry, a for-each, a branch not taken and values; its journal, appended."""
    job, tries = Job("daily"), []

    @job.task(retries=1)
    def extract(ctx):
        tries.append(1)
        if len(tries) < 2:
            raise ValueError("new columns")
        return False

    @job.task(after=("extract",), for_each=["nation", "region"], concurrency=2)
    def load(ctx, name):
        return table(ctx.spark, sf, name).count()

    @job.task(after=("extract",), only_when=("extract", True))
    def repair(ctx):
        raise AssertionError

    @job.task(after=("load", "repair"), run_if="NONE_FAILED")
    def report(ctx):
        return sum(ctx.values["load"])

    job.run(spark, day="2026-01-01")
    journal = VersionedTable(spark, scratch(spark, "journal"))
    journal.append(job.journal(spark))
    return journal.read().select("task", "status", F.col("attempts").cast("int").alias("attempts"))


@query("SELECT 'prod' AS target, 'main' AS catalog, '8' AS workers, count(*) AS n FROM region")
def deployment_profile(spark, sf):
    got = profile({"default": {"catalog": "main", "workers": "2"}, "dev": {"catalog": "dev"}, "prod": {"workers": "4"}}, "prod", workers="8")
    return table(spark, sf, "region").agg(F.count("*").alias("n")).select(F.lit("prod").alias("target"), F.lit(got["catalog"]).alias("catalog"), F.lit(got["workers"]).alias("workers"), "n")


@query("SELECT event_id, event_type, CASE WHEN event_id % 2 = 1 THEN user_id END AS user_id FROM events")
def schema_evolution(spark, sf):
    """A flow whose files gain a column: the run that meets it registers it and stops, the next one reads it."""
    top = scratch(spark, "evolution")
    e, registry = table(spark, sf, "events"), ingest.SchemaRegistry(spark, f"{top}/schema")
    kinds = {"event_id": "long", "event_type": "string", "user_id": "long"}

    def run() -> None:
        found = [c for c in kinds if c in spark.read.option("mergeSchema", "true").parquet(f"{top}/in").columns]
        columns = registry.resolve(found)
        stream = flows.read_files(spark, f"{top}/in", "parquet", ", ".join(f"{c} {kinds[c]}" for c in columns))
        flows.append_once(stream, f"{top}/out", f"{top}/ck")

    e.filter("event_id % 2 = 0").select("event_id", "event_type").write.mode("append").parquet(f"{top}/in")
    run()
    e.filter("event_id % 2 = 1").select("event_id", "event_type", F.col("user_id").cast("long").alias("user_id")).write.mode("append").parquet(f"{top}/in")
    try:
        run()
        raise AssertionError("a new column passed")
    except ingest.UnknownFieldError:
        run()
    return spark.read.option("mergeSchema", "true").parquet(f"{top}/out").select("event_id", "event_type", "user_id")


@query("SELECT 3::BIGINT AS batches, count(*) AS rows_in FROM events")
def stream_progress(spark, sf):
    """What a stream's progress says of the rows it read, a file a micro-batch."""
    top = scratch(spark, "progress")
    e = table(spark, sf, "events").select("event_id", "event_type")
    for k in range(3):
        e.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{top}/in")
    q = flows.append_once(flows.read_files(spark, f"{top}/in", "parquet", "event_id long, event_type string", max_files=1), f"{top}/out", f"{top}/ck")
    batches = len([p for p in q.recentProgress if p["numInputRows"]])
    return spark.createDataFrame([(batches, flows.rows_in(q))], "batches long, rows_in long")


@query("SELECT l_returnflag, n_brands, quantity FROM (SELECT l_returnflag, count(DISTINCT p_brand) AS n_brands, sum(l_quantity)::DOUBLE AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)")
def stored_dataset(spark, sf):
    """A stored dataset of a declarative pipeline, computed again by its second update."""
    p = Pipeline(spark, scratch(spark, "materialized"))
    li, part = tables(spark, sf, "lineitem", "part")

    @p.dataset(kind="temporary")
    def joined():
        return li.join(part, F.col("l_partkey") == F.col("p_partkey"))

    @p.dataset(reads=["joined"])
    def gold(joined):
        return joined.groupBy("l_returnflag").agg(F.countDistinct("p_brand").alias("n_brands"), F.sum("l_quantity").alias("quantity"))

    p.run("u1")
    return p.run("u2")["gold"]
