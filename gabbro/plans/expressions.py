"""Predicates, joins, aggregates, set operations and functions that the business queries don't use, each
with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gabbro.functions import clean
from gabbro.operators import quality, silver
from gabbro.operators import relational as R
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


@query(
    """SELECT p_partkey, p_name LIKE '%widget%' AS has_widget, p_name NOT LIKE 'c%' AS not_c, contains(p_name, 'small') AS holds_small, starts_with(p_name, 'cold') AS starts_cold, suffix(p_name, 'bolt') AS ends_bolt,
  p_brand ILIKE 'brand#1_' AS teens FROM part"""
)
def like_patterns(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey", n.like("%widget%").alias("has_widget"), (~n.like("c%")).alias("not_c"), n.contains("small").alias("holds_small"), n.startswith("cold").alias("starts_cold"),
        n.endswith("bolt").alias("ends_bolt"), F.col("p_brand").ilike("brand#1_").alias("teens"),
    )


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AND o_totalprice > (SELECT avg(o_totalprice) FROM orders) GROUP BY 1")
def subqueries(spark, sf):
    """EXISTS and a scalar subquery in SQL, grouped by ordinal."""
    for t in ("orders", "lineitem"):
        table(spark, sf, t).createOrReplaceTempView(f"sub_{t}")
    return spark.sql(
        """SELECT o_orderstatus, count(*) AS n FROM sub_orders
        WHERE EXISTS (SELECT 1 FROM sub_lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AND o_totalprice > (SELECT avg(o_totalprice) FROM sub_orders) GROUP BY 1"""
    )


@query("SELECT s_nationkey, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def forced_shuffle_join(spark, sf):
    """Both sides dealt by key though one could be broadcast: a hash join, as hinted."""
    li, su = tables(spark, sf, "lineitem", "supplier")
    return li.join(su.hint("shuffle_hash"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT (SELECT count(*) FROM orders) AS n_before, count(*) AS n_after, sum((c_custkey IS NULL)::INTEGER)::BIGINT AS n_missing FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c_custkey")
def join_keeps_rows(spark, sf):
    """A left join that raises if a parent key occurs twice; rows before and after."""
    o, c = tables(spark, sf, "orders", "customer")
    j = silver.guarded_join(o, c.filter("c_custkey % 10 <> 0").withColumnRenamed("c_custkey", "o_custkey").withColumn("known", F.lit(1)), "o_custkey")
    before = o.agg(F.count("*").alias("n_before"))
    return j.agg(F.count("*").alias("n_after"), F.count_if(F.col("known").isNull()).alias("n_missing")).join(before, F.lit(True)).select("n_before", "n_after", "n_missing")


@query("SELECT a.c_custkey AS k, sha256(a.c_name) = sha256(b.c_name) AS same_name, length(a.c_mktsegment) - length(b.c_mktsegment) AS longer FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1")
def self_comparison(spark, sf):
    """Each row against its neighbour, by hash and by length."""
    c = table(spark, sf, "customer")
    a, b = c.alias("a"), c.alias("b")
    return a.join(b, F.col("b.c_custkey") == F.col("a.c_custkey") + 1).select(
        F.col("a.c_custkey").alias("k"), (F.sha2("a.c_name", 256) == F.sha2("b.c_name", 256)).alias("same_name"), (F.length("a.c_mktsegment") - F.length("b.c_mktsegment")).cast("long").alias("longer")
    )


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS gid FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, sf):
    keys = [F.col("o_orderstatus"), F.col("o_orderpriority")]
    return table(spark, sf, "orders").groupingSets([(keys[0],), (keys[1],), ()], *keys).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, first(c_name ORDER BY c_custkey) AS sample FROM customer GROUP BY ALL")
def first_sample(spark, sf):
    """One example a group; by a key, so that reruns agree."""
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.min_by("c_name", "c_custkey").alias("sample"))


@query("SELECT name, count(*) AS n FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation WHERE n_nationkey < 3) GROUP BY ALL")
def union_all_sql(spark, sf):
    for t in ("nation", "region"):
        table(spark, sf, t).createOrReplaceTempView(f"ua_{t}")
    return spark.sql("SELECT name, count(*) AS n FROM (SELECT n_name AS name FROM ua_nation UNION ALL SELECT r_name FROM ua_region UNION ALL SELECT n_name FROM ua_nation WHERE n_nationkey < 3) GROUP BY name")


@query(
    """WITH a AS (SELECT l_returnflag AS f, l_linenumber AS n FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT l_returnflag AS f, l_linenumber AS n FROM lineitem WHERE l_orderkey % 2 = 1)
SELECT 'left' AS side, f, n, count(*) AS rows_more FROM (FROM a EXCEPT ALL FROM b) GROUP BY ALL UNION ALL SELECT 'right', f, n, count(*) FROM (FROM b EXCEPT ALL FROM a) GROUP BY ALL"""
)
def multiset_difference(spark, sf):
    """Rows that are in one multiset only, both ways."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("n"))
    return R.same_rows(li.filter("l_orderkey % 2 = 0").drop("l_orderkey"), li.filter("l_orderkey % 2 = 1").drop("l_orderkey")).groupBy("side", "f", "n").agg(F.count("*").alias("rows_more"))


@query("SELECT event_type, count(*) FILTER (user_id % 2 = 0) AS even, count(*) FILTER (user_id % 2 = 1) AS odd FROM events GROUP BY ALL")
def crosstab_events(spark, sf):
    return table(spark, sf, "events").withColumn("side", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")).groupBy("event_type").pivot("side", ["even", "odd"]).count().fillna(0)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def subtract_keys(spark, sf):
    c, o = tables(spark, sf, "customer", "orders")
    return c.select("c_custkey").subtract(o.select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT c_custkey, c_mktsegment AS segment, 2::BIGINT AS n_keys, c_nationkey > 12 AS is_high, CASE WHEN c_nationkey > 12 THEN 'high' ELSE 'low' END AS label FROM customer")
def map_functions(spark, sf):
    c = table(spark, sf, "customer")
    m = c.select("c_custkey", F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("m"))
    label = F.element_at(F.map_from_arrays(F.array(F.lit(True), F.lit(False)), F.array(F.lit("high"), F.lit("low"))), F.col("is_high"))
    out = m.select("c_custkey", F.col("m")["segment"].alias("segment"), F.size(F.map_keys("m")).cast("long").alias("n_keys"), (F.element_at("m", "nation").cast("int") > 12).alias("is_high"))
    return out.withColumn("label", label)


@query(
    """SELECT k, v, row_number() OVER (ORDER BY v ASC NULLS FIRST, k) AS asc_first, row_number() OVER (ORDER BY v ASC NULLS LAST, k) AS asc_last, row_number() OVER (ORDER BY v DESC NULLS FIRST, k) AS desc_first,
  rank() OVER (PARTITION BY k % 5 ORDER BY v DESC NULLS LAST) AS r FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS v FROM customer WHERE c_custkey < 200)"""
)
def null_ordering(spark, sf):
    c = table(spark, sf, "customer").filter("c_custkey < 200").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).alias("v"))
    v, k = F.col("v"), F.col("k")
    return c.select(
        "k", "v", F.row_number().over(Window.orderBy(v.asc_nulls_first(), k)).cast("long").alias("asc_first"), F.row_number().over(Window.orderBy(v.asc_nulls_last(), k)).cast("long").alias("asc_last"),
        F.row_number().over(Window.orderBy(v.desc_nulls_first(), k)).cast("long").alias("desc_first"), F.rank().over(Window.partitionBy(k % 5).orderBy(v.desc_nulls_last())).cast("long").alias("r"),
    )


@query("SELECT true AS distinct_close, true AS quartiles_close, count(DISTINCT o_custkey) AS exact FROM orders")
def approximations_hold(spark, sf):
    """Approximate answers lie within their stated error of the exact ones."""
    o = table(spark, sf, "orders")
    # the exact count by itself: beside it Spark would keep the buffers of both sketches for each customer
    exact = o.agg(F.count_distinct("o_custkey").alias("exact"))
    near = o.agg(F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.percentile_approx("o_totalprice", [0.25, 0.5, 0.75], 10000).alias("q"), F.count("*").alias("n"))
    below = o.join(near.select("q", "n"), F.lit(True)).agg(*[F.count_if(F.col("o_totalprice") <= F.col("q")[k]).alias(f"b{k}") for k in range(3)], F.first("n").alias("rows"))
    close = F.lit(True)
    for k, share in enumerate((0.25, 0.5, 0.75)):
        close = close & (F.abs(F.col(f"b{k}") / F.col("rows") - share) <= 2 / F.lit(10000) + 1 / F.col("rows"))
    return near.join(below, F.lit(True)).join(exact, F.lit(True)).select((F.abs(F.col("a") - F.col("exact")) <= 3 * 0.02 * F.col("exact")).alias("distinct_close"), close.alias("quartiles_close"), "exact")


@query("SELECT l_returnflag, l_linenumber, n_rows * k AS n FROM (SELECT l_returnflag, l_linenumber, count(*) AS n_rows FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL), (SELECT 5 AS k)")
def row_amplifier(spark, sf):
    """Every row five times, by a generator."""
    li = table(spark, sf, "lineitem").filter("l_linenumber <= 3").select("l_returnflag", "l_linenumber", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("copy"))
    return li.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, trim(regexp_replace('  ' || c_name || chr(9) || ' ' || chr(160) || c_mktsegment || ' ', '[\\s ]+', ' ', 'g')) AS label FROM customer")
def squeezed(spark, sf):
    raw = F.concat(F.lit("  "), F.col("c_name"), F.lit("\t  "), F.col("c_mktsegment"), F.lit(" "))
    return table(spark, sf, "customer").select("c_custkey", clean.squeeze(raw).alias("label"))


@query("SELECT c_mktsegment, round(avg((c_acctbal > 0)::INTEGER), 6) AS balance_complete, 1.0::DOUBLE AS name_complete FROM customer GROUP BY ALL")
def completeness_by_segment(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.col("c_name").alias("name"))
    done = c.groupBy("c_mktsegment").agg(*clean.completeness("balance", "name"))
    return done.withColumn("balance_complete", F.round("balance_complete", 6))


@query(
    """SELECT event_type AS name, event_id AS run_id, value, round(avg(value) OVER w, 6) AS usual, round(value / nullif(avg(value) OVER w, 0), 6) AS drift FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""
)
def metric_drift(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("run_id"), "value")
    return quality.drift(e).select("name", "run_id", "value", F.round("usual", 6).alias("usual"), F.round("drift", 6).alias("drift"))


@query(
    """SELECT 'orders' AS source, count(*) AS "rows", count(*) FILTER (o_orderstatus = 'F') AS kept_aside FROM orders UNION ALL SELECT 'events', count(*), count(*) FILTER (user_id % 3 = 0) FROM events
UNION ALL SELECT 'customer', count(*), 0 FROM customer"""
)
def rescued_rows(spark, sf):
    o, e, c = tables(spark, sf, "orders", "events", "customer")
    return quality.rescued_summary(
        orders=(o.withColumn("x", F.when(F.col("o_orderstatus") == "F", "text")), "x"), events=(e.withColumn("x", F.when(F.col("user_id") % 3 == 0, "text")), "x"), customer=(c.withColumn("x", F.lit(None).cast("string")), "x")
    )


@query("SELECT c_mktsegment AS segment, count(*) AS n_orders, round(avg(total), 2) AS avg_total FROM (SELECT o_orderkey, c_mktsegment, sum(l_quantity) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL) GROUP BY ALL")
def two_level_quantity(spark, sf):
    li, o, c = tables(spark, sf, "lineitem", "orders", "customer")
    lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_mktsegment", "segment")
    return R.two_level_average(lines, "o_orderkey", "segment", F.col("l_quantity")).select("segment", "n_orders", F.round("avg_total", 2).alias("avg_total"))
