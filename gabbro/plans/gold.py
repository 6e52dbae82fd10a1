"""Business queries over the driver tables: star-schema style aggregates, windows, joins and set
operations, each with the DuckDB statement that must give the same rows.

Money is double in the tables: it is cast to decimal before any sum, so results don't depend on the
order of partial sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gabbro.functions import clean
from gabbro.operators import relational as R
from gabbro.operators import scd
from gabbro.tables import table, tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with its oracle."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def net() -> F.Column:
    """The net amount of a line, in cents."""
    return F.round(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)")), 2)


SQL_NET = "round(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)), 2)"
LINE_COLUMNS = "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
SQL_LINES = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY {', '.join(LINE_COLUMNS)}) AS rn FROM lineitem) WHERE rn = 1)"""


def money(c) -> F.Column:
    return c.cast("decimal(18,2)")


def lines_once(spark: SparkSession, sf: str) -> DataFrame:
    """One row an order line, first by a total order over all columns."""
    # dealt by order: the window and every join or sum by order after it use this one exchange
    li = table(spark, sf, "lineitem").select(*LINE_COLUMNS).repartition("l_orderkey")
    return R.dedup(li, ["l_orderkey", "l_linenumber"], R.total_order(li, ["l_orderkey", "l_linenumber"]))


@query(
    f"""SELECT date_trunc('month', o_orderdate)::DATE AS month, c_mktsegment, sum({SQL_NET})::DECIMAL(18,2) AS net_revenue,
  count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders
FROM {SQL_LINES} l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
)
def monthly_revenue(spark, sf):
    orders, customer = tables(spark, sf, "orders", "customer")
    j = lines_once(spark, sf).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    # per order first: the distinct count needs no second shuffle of lines
    per = j.groupBy("o_orderkey", F.trunc("o_orderdate", "MM").alias("month"), "c_mktsegment").agg(F.sum(net()).alias("net"), F.count("*").alias("n"))
    return per.groupBy("month", "c_mktsegment").agg(money(F.sum("net")).alias("net_revenue"), F.sum("n").alias("n_lines"), F.count("*").alias("n_orders"))


@query(f"SELECT {', '.join(LINE_COLUMNS)} FROM {SQL_LINES}")
def dedup_first(spark, sf):
    return lines_once(spark, sf)


@query(
    f"""SELECT {', '.join(LINE_COLUMNS)} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY {', '.join(c + ' DESC' for c in LINE_COLUMNS)}) AS rn FROM lineitem) WHERE rn = 1"""
)
def dedup_last(spark, sf):
    # dealt by order: the window and every join or sum by order after it use this one exchange
    li = table(spark, sf, "lineitem").select(*LINE_COLUMNS).repartition("l_orderkey")
    return R.dedup(li, ["l_orderkey", "l_linenumber"], R.total_order(li, ["l_orderkey", "l_linenumber"]), last=True)


@query(
    """SELECT s_name, date_trunc('month', l_shipdate)::DATE AS month, count(*) AS n_lines,
  sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS n_returned,
  round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE / count(*), 4) AS return_rate
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"""
)
def status_rates(spark, sf):
    li, su = tables(spark, sf, "lineitem", "supplier")
    n = F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    # aggregated by key before the names are joined: the join then sees a row a supplier and month
    per = li.groupBy("l_suppkey", F.trunc("l_shipdate", "MM").alias("month")).agg(F.count("*").alias("n_lines"), n.alias("n_returned"))
    j = per.join(su, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_name", "month").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_returned").alias("n_returned"))
    return j.withColumn("return_rate", F.round(F.col("n_returned").cast("double") / F.col("n_lines"), 4))


@query(
    f"""SELECT c_mktsegment, count(*) AS n_orders, round((sum(total) / count(*))::DOUBLE, 2) AS avg_basket FROM (
  SELECT o_orderkey, c_mktsegment, sum({SQL_NET}) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey GROUP BY ALL) GROUP BY ALL"""
)
def basket_two_level(spark, sf):
    li, o, c = tables(spark, sf, "lineitem", "orders", "customer")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    out = j.groupBy("o_orderkey", "c_mktsegment").agg(F.sum(net()).alias("total")).groupBy("c_mktsegment").agg(F.count("*").alias("n_orders"), F.sum("total").alias("total"))
    return out.select("c_mktsegment", "n_orders", F.round((F.col("total") / F.col("n_orders")).cast("double"), 2).alias("avg_basket"))


@query(
    """WITH a AS (SELECT DISTINCT o_custkey AS who, date_trunc('month', o_orderdate)::DATE AS m FROM orders),
f AS (SELECT who, min(m) AS cohort_month FROM a GROUP BY who),
s AS (SELECT cohort_month, count(*) AS cohort_size FROM f GROUP BY ALL)
SELECT cohort_month, date_diff('month', cohort_month, m)::INTEGER AS month_offset, count(*) AS active, cohort_size
FROM a JOIN f USING (who) JOIN s USING (cohort_month) GROUP BY ALL"""
)
def cohort_retention(spark, sf):
    return R.cohorts(table(spark, sf, "orders"), "o_custkey", "o_orderdate")


@query(
    """SELECT (json_extract_string(props, '$.k')::INTEGER % 5) AS bucket,
  count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS viewed,
  count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS clicked,
  count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS bought FROM events GROUP BY ALL"""
)
def funnel_conversion(spark, sf):
    ev = table(spark, sf, "events").withColumn("bucket", F.get_json_object("props", "$.k").try_cast("int") % 5)
    kind = F.col("event_type")
    return R.funnel(ev, ["bucket"], "user_id", {"viewed": kind == "view", "clicked": kind == "click", "bought": kind == "purchase"})


@query(
    f"""SELECT p_partkey, p_name, p_brand, sum({SQL_NET})::DECIMAL(18,2) AS revenue, sum(l_quantity)::DOUBLE AS quantity,
  round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE / count(*), 4) AS return_rate
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_shipdate > (SELECT max(l_shipdate)::DATE - 90 FROM lineitem)
GROUP BY ALL ORDER BY revenue DESC, p_partkey LIMIT 20"""
)
def top_products_90d(spark, sf):
    li, part = tables(spark, sf, "lineitem", "part")
    # a scalar subquery: it runs first, and its value is pushed into the scan of the lines
    bound = li.agg(F.date_sub(F.max("l_shipdate"), 90).cast("timestamp_ntz").alias("after"))
    recent = li.filter(F.col("l_shipdate") > bound.scalar())
    per = recent.groupBy("l_partkey").agg(
        money(F.sum(net())).alias("revenue"), F.sum("l_quantity").alias("quantity"),
        F.round(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("double") / F.count("*"), 4).alias("return_rate"),
    )
    top = R.top_k(per.join(part, F.col("l_partkey") == F.col("p_partkey")), "revenue", "p_partkey", 20)
    return top.select("p_partkey", "p_name", "p_brand", "revenue", "quantity", "return_rate")


# The three commission rates of the plans.
SQL_PLANS = """(SELECT s_suppkey AS supp, v AS plan_version, CASE (s_suppkey + v) % 3 WHEN 0 THEN 0.150 WHEN 1 THEN 0.115 ELSE 0.085 END::DECIMAL(5,3) AS rate,
  CASE v WHEN 0 THEN TIMESTAMP '1900-01-01' WHEN 1 THEN TIMESTAMP '1995-06-01' ELSE TIMESTAMP '1997-03-15' END AS valid_from,
  CASE v WHEN 0 THEN TIMESTAMP '1995-06-01' WHEN 1 THEN TIMESTAMP '1997-03-15' END AS valid_to
FROM supplier, (SELECT unnest([0, 1, 2]) AS v))"""


def plan_history(spark: SparkSession, sf: str) -> DataFrame:
    """Three plan versions a supplier, with closed-open intervals."""
    v = F.col("plan_version")
    third = (F.col("s_suppkey") + v) % 3
    rate = F.when(third == 0, F.lit("0.150")).when(third == 1, F.lit("0.115")).otherwise(F.lit("0.085")).cast("decimal(5,3)")
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    return (
        table(spark, sf, "supplier")
        .select(F.col("s_suppkey").alias("supp"), "s_suppkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("plan_version"))
        .select(
            "supp", "plan_version", rate.alias("rate"),
            F.when(v == 0, day("1900-01-01")).when(v == 1, day("1995-06-01")).otherwise(day("1997-03-15")).alias("valid_from"),
            F.when(v == 0, day("1995-06-01")).when(v == 1, day("1997-03-15")).alias("valid_to"),
        )
    )


@query(
    f"""SELECT l_suppkey, plan_version, count(*) AS n_lines, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE round({SQL_NET} * rate, 2) END)::DECIMAL(18,2) AS commission
FROM lineitem LEFT JOIN {SQL_PLANS} h ON l_suppkey = supp AND l_shipdate >= valid_from AND (valid_to IS NULL OR l_shipdate < valid_to) GROUP BY ALL"""
)
def temporal_commission(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", net().alias("net"))
    j = R.as_of_join(li, plan_history(spark, sf).withColumnRenamed("supp", "l_suppkey"), "l_suppkey", "l_shipdate")
    # rounded by line to cents, then summed; 0, not null, for lines that are no revenue
    fee = F.when(F.col("l_returnflag") == "R", F.lit(0).cast("decimal(18,2)")).otherwise(F.round(F.col("net") * F.col("rate"), 2).cast("decimal(18,2)"))
    return j.groupBy("l_suppkey", "plan_version").agg(F.count("*").alias("n_lines"), money(F.sum(fee)).alias("commission"))


@query(
    f"""SELECT sum(CASE WHEN plan_version = 2 THEN round({SQL_NET} * rate, 2) END)::DECIMAL(18,2) AS current_plan_commission
FROM lineitem JOIN {SQL_PLANS} h ON l_suppkey = supp AND valid_to IS NULL WHERE l_returnflag <> 'R'"""
)
def current_plan_control(spark, sf):
    h = plan_history(spark, sf).filter("valid_to is null")
    li = table(spark, sf, "lineitem").filter("l_returnflag <> 'R'").select("l_suppkey", net().alias("net"))
    return li.join(h, F.col("l_suppkey") == F.col("supp")).agg(money(F.sum(F.round(F.col("net") * F.col("rate"), 2))).alias("current_plan_commission"))


@query(
    """WITH c AS (SELECT user_id, ts, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_type DESC) = 1),
d AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM c),
e AS (SELECT * FROM d WHERE was IS NULL OR was <> status)
SELECT user_id, status, ts AS valid_from, lead(ts) OVER w AS valid_to, lead(ts) OVER w IS NULL AS is_current FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)"""
)
def scd2_rebuild(spark, sf):
    j = table(spark, sf, "events").select("user_id", "ts", F.col("event_type").alias("status"))
    return scd.rebuild(j, "user_id", "ts", ["status"]).drop("row_hash")


@query("SELECT 0::BIGINT AS differing_rows, (SELECT count(*) FROM (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM (SELECT DISTINCT ON (user_id, ts) * FROM events ORDER BY user_id, ts, event_type DESC)) WHERE was IS NULL OR was <> event_type) AS history_rows")
def scd2_merge_equals_rebuild(spark, sf):
    j = table(spark, sf, "events").select("user_id", "ts", F.col("event_type").alias("status"))
    early = j.filter("ts < timestamp_ntz'2024-01-10' or user_id % 3 = 0").filter("user_id % 7 <> 0")
    whole = scd.rebuild(j, "user_id", "ts", ["status"])
    merged = scd.apply(scd.rebuild(early, "user_id", "ts", ["status"]), j, "user_id", "ts", ["status"])
    # group counts instead of two exceptAll: one shuffle
    diff = whole.select("*", F.lit(1).alias("side")).unionByName(merged.select("*", F.lit(-1).alias("side")))
    per = diff.groupBy("user_id", "status", "valid_from", "valid_to", "is_current").agg(F.sum("side").alias("d"), F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("n"))
    return per.agg(F.sum(F.abs("d")).cast("long").alias("differing_rows"), F.sum("n").cast("long").alias("history_rows"))


# The two impossible timestamps that raw deliveries hold.
RAW = {
    "price": "CASE l_orderkey % 7 WHEN 0 THEN replace({p}, '.', ',') || ' €' WHEN 1 THEN 'n/a' WHEN 2 THEN 'EUR ' || replace({p}, '.', ',') ELSE {p} END",
    "qty": "CASE l_orderkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '-2' ELSE cast(cast(l_quantity AS int) AS string) END",
    "status": "CASE l_linenumber % 3 WHEN 0 THEN lower(l_linestatus) WHEN 1 THEN ' ' || l_linestatus || ' ' ELSE l_linestatus END",
    "ts": "CASE l_orderkey % 11 WHEN 0 THEN '0000-00-00 00:00:00' WHEN 1 THEN '2026-13-45 99:99:99' ELSE date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss') END",
}


def dirty_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as raw text, with the defects of raw deliveries at fixed places."""
    li = lines_once(spark, sf)
    p = "cast(cast(l_extendedprice AS decimal(12,2)) AS string)"
    return li.selectExpr("l_orderkey", "l_linenumber", *[f"{v.format(p=p)} AS raw_{k}" for k, v in RAW.items()])


def cleaned_lines(spark: SparkSession, sf: str) -> tuple[DataFrame, F.Column]:
    d = dirty_lines(spark, sf).select(
        "l_orderkey", "l_linenumber", clean.clean_decimal(F.col("raw_price"), 12, 2).alias("price"), clean.clean_int(F.col("raw_qty")).alias("qty"),
        clean.clean_status(F.col("raw_status")).alias("status"), clean.parse_ts(F.col("raw_ts")).alias("ts"),
    )
    why = clean.reasons(BAD_PRICE=F.col("price").isNull(), BAD_QUANTITY=F.coalesce(F.col("qty") <= 0, F.lit(True)), BAD_TIMESTAMP=F.col("ts").isNull())
    return d, why


SQL_DIRTY = f"""(SELECT l_orderkey, l_linenumber, l_orderkey % 7 = 1 AS bad_price, l_orderkey % 5 < 2 OR l_quantity::INTEGER <= 0 AS bad_qty, l_orderkey % 11 < 2 AS bad_ts,
  upper(l_linestatus) AS status, l_extendedprice::DECIMAL(12,2) AS price FROM {SQL_LINES})"""


@query(
    f"""SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN bad_price THEN 'BAD_PRICE' END, CASE WHEN bad_qty THEN 'BAD_QUANTITY' END,
  CASE WHEN bad_ts THEN 'BAD_TIMESTAMP' END], lambda x: x IS NOT NULL)) AS reason FROM {SQL_DIRTY}) GROUP BY ALL"""
)
def quarantine_reasons(spark, sf):
    _, bad = R.split_quarantine(*cleaned_lines(spark, sf))
    return bad.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    f"""SELECT count(*) AS n_dedup, count(*) FILTER (NOT (bad_price OR bad_qty OR bad_ts)) AS n_silver, count(*) FILTER (bad_price OR bad_qty OR bad_ts) AS n_quarantine,
  sum(CASE WHEN NOT (bad_price OR bad_qty OR bad_ts) THEN price END)::DECIMAL(18,2) AS silver_amount FROM {SQL_DIRTY}"""
)
def silver_split(spark, sf):
    d, why = cleaned_lines(spark, sf)
    ok = F.size(why) == 0
    return d.agg(
        F.count("*").alias("n_dedup"), F.count_if(ok).alias("n_silver"), F.count_if(~ok).alias("n_quarantine"), money(F.sum(F.when(ok, F.col("price")))).alias("silver_amount")
    )


@query(
    """SELECT o_orderstatus, count(*) AS n, count(*) FILTER (c_custkey IS NULL) AS n_orphan
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c_custkey GROUP BY ALL"""
)
def orphan_flag(spark, sf):
    o, c = tables(spark, sf, "orders", "customer")
    flagged = R.flag_orphans(o, c.filter("c_custkey % 10 <> 0"), "o_custkey", "c_custkey", "is_orphan")
    return flagged.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if("is_orphan").alias("n_orphan"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') GROUP BY ALL")
def anti_join(spark, sf):
    c, o = tables(spark, sf, "customer", "orders")
    return c.join(o.filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n, sum(c_acctbal::DECIMAL(12,2))::DECIMAL(18,2) AS balance FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY ALL")
def semi_join(spark, sf):
    c, o = tables(spark, sf, "customer", "orders")
    kept = c.join(o.filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return kept.groupBy("c_mktsegment").agg(F.count("*").alias("n"), money(F.sum(F.col("c_acctbal").cast("decimal(12,2)"))).alias("balance"))


@query(
    """WITH a AS (SELECT o_orderdate::DATE AS d, count(*) AS ordered FROM orders GROUP BY ALL), b AS (SELECT l_shipdate::DATE AS d, count(*) AS shipped FROM lineitem GROUP BY ALL)
SELECT coalesce(a.d, b.d) AS d, coalesce(ordered, 0) AS ordered, coalesce(shipped, 0) AS shipped, coalesce(ordered, 0) - coalesce(shipped, 0) AS net_flow FROM a FULL JOIN b ON a.d = b.d"""
)
def full_outer_flow(spark, sf):
    o, li = tables(spark, sf, "orders", "lineitem")
    a = o.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("ordered"))
    b = li.groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count("*").alias("shipped"))
    return R.full_outer_zero(a, b, ["d"]).withColumn("net_flow", F.col("ordered") - F.col("shipped"))


@query("SELECT hour(ts)::INTEGER AS hour, count(*) AS n, round(avg(value), 2) AS avg_value, count(value) AS n_value FROM events GROUP BY ALL")
def hourly_demand(spark, sf):
    return table(spark, sf, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("avg_value"), F.count("value").alias("n_value"))


@query("SELECT hour(ts)::INTEGER AS peak_hour, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, peak_hour LIMIT 1")
def peak_hour(spark, sf):
    per = table(spark, sf, "events").groupBy(F.hour("ts").alias("peak_hour")).agg(F.count("*").alias("n"))
    return R.top_k(per, "n", "peak_hour", 1)


SQL_DAILY = "(SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY ALL)"


@query(
    f"""SELECT d, n, round(avg(n) OVER w, 4) AS trailing_mean, round(n / nullif(avg(n) OVER w, 0), 4) AS ratio FROM {SQL_DAILY}
WINDOW w AS (ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""
)
def rolling7_ratio(spark, sf):
    daily = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    return R.trailing_ratio(daily, "d", "n").withColumns({"trailing_mean": F.round("trailing_mean", 4), "ratio": F.round("ratio", 4)})


@query(
    f"""SELECT d, n, ratio, ratio NOT BETWEEN 0.5 AND 1.5 AS is_anomaly FROM (SELECT d, n, round(n / nullif(avg(n) OVER (ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0), 4) AS ratio
FROM {SQL_DAILY}) ORDER BY d DESC LIMIT 1"""
)
def anomaly_last(spark, sf):
    daily = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    last = R.trailing_ratio(daily, "d", "n").orderBy(F.col("d").desc()).limit(1)
    return last.select("d", "n", F.round("ratio", 4).alias("ratio"), (~F.round("ratio", 4).between(0.5, 1.5)).alias("is_anomaly"))


@query(
    """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice::DECIMAL(12,2))::DECIMAL(18,2) AS revenue FROM orders GROUP BY ALL)
SELECT month, revenue, sum(revenue) OVER (ORDER BY month)::DECIMAL(18,2) AS cumulative, round((revenue - lag(revenue) OVER (ORDER BY month))::DOUBLE / lag(revenue) OVER (ORDER BY month)::DOUBLE, 4) AS growth FROM m"""
)
def growth_cumulative(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(money(F.sum(F.col("o_totalprice").cast("decimal(12,2)"))).alias("revenue"))
    w = Window.orderBy("month")
    was = F.lag("revenue").over(w)
    return m.select(
        "month", "revenue", money(F.sum("revenue").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("cumulative"),
        F.round((F.col("revenue") - was).cast("double") / was.cast("double"), 4).alias("growth"),
    )


@query(
    """SELECT o_custkey, o_orderkey, rank() OVER w AS rnk, dense_rank() OVER w AS dense, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)"""
)
def rank_variants(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("dense"),
        F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("rn"),
    )


@query("SELECT c_custkey, c_nationkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quartile FROM customer")
def ntile4(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.ntile(4).over(w).cast("long").alias("quartile"))


@query(
    """SELECT o_orderstatus, o_orderpriority, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS share
FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)"""
)
def share_of_total(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return per.withColumn("share", F.round(F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("o_orderstatus")), 6))


@query(
    """SELECT user_id, event_id, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running_last,
  last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final_last,
  coalesce(lag(event_type, 2, 'none') OVER (PARTITION BY user_id ORDER BY ts, event_id), 'none') AS two_before FROM events"""
)
def last_value_frames(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf, "events").select(
        "user_id", "event_id", F.last("event_type").over(w).alias("running_last"), F.last("event_type").over(whole).alias("final_last"), F.lag("event_type", 2, "none").over(w).alias("two_before")
    )


@query(
    """SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) // 1000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS last_hour,
  count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS last_ten FROM events"""
)
def rows_and_range_frames(spark, sf):
    sec = F.unix_timestamp(F.col("ts").cast("timestamp"))
    e = table(spark, sf, "events").withColumn("sec", sec)
    by = Window.partitionBy("user_id")
    return e.select(
        "user_id", "event_id", F.count("*").over(by.orderBy("sec").rangeBetween(-3600, 0)).alias("last_hour"), F.count("*").over(by.orderBy("ts", "event_id").rowsBetween(-10, -1)).alias("last_ten")
    )


@query(
    """SELECT d::DATE AS date_day, year(d)::INTEGER AS year, quarter(d)::INTEGER AS quarter, month(d)::INTEGER AS month, strftime(d, '%Y-%m') AS year_month, day(d)::INTEGER AS day,
  isodow(d)::INTEGER AS weekday, isodow(d) >= 6 AS is_weekend, weekofyear(d)::INTEGER AS iso_week FROM (SELECT unnest(generate_series(TIMESTAMP '1992-01-01', TIMESTAMP '1998-12-31', INTERVAL 1 DAY)) AS d)"""
)
def dim_date(spark, sf):
    return R.calendar(spark, "1992-01-01", "1998-12-31")


@query(
    """SELECT c_mktsegment, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
)
def pivot_segment(spark, sf):
    o, c = tables(spark, sf, "orders", "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


SQL_AB = "(SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)", "(SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)"


@query(
    f"""SELECT (SELECT count(*) FROM (SELECT * FROM {SQL_AB[0]} UNION ALL SELECT * FROM {SQL_AB[1]})) AS union_all,
(SELECT count(*) FROM (SELECT * FROM {SQL_AB[0]} UNION SELECT * FROM {SQL_AB[1]})) AS union_distinct,
(SELECT count(*) FROM (SELECT * FROM {SQL_AB[0]} EXCEPT ALL SELECT * FROM {SQL_AB[1]})) AS except_all,
(SELECT count(*) FROM (SELECT * FROM {SQL_AB[0]} INTERSECT SELECT * FROM {SQL_AB[1]})) AS intersected"""
)
def set_operations(spark, sf):
    o = table(spark, sf, "orders")
    a, b = (o.filter(f"o_orderkey % {k} = 0").select("o_custkey") for k in (2, 3))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    rows = [n(a.union(b), "union_all"), n(a.unionByName(b).distinct(), "union_distinct"), n(a.exceptAll(b), "except_all"), n(a.intersect(b), "intersected")]
    out = rows[0]
    for r in rows[1:]:  # one-row results side by side
        out = out.join(F.broadcast(r), F.lit(True))
    return out


@query("SELECT json_extract_string(props, '$.k')::INTEGER AS k, event_type, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return e.groupBy("k", "event_type").agg(F.count("*").alias("n"))


def word_places(docs: DataFrame) -> DataFrame:
    words = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return words.withColumn("pos", F.col("pos").cast("long"))


@query(
    r"""SELECT doc_id, i AS pos, w AS word FROM (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents))"""
)
def posexplode_words(spark, sf):
    """Every word of every document with its place."""
    return word_places(table(spark, sf, "documents"))


@query()
def posexplode_all_words(spark, sf):
    """The same under its earlier name; tested on a fixture, without SQL."""
    return word_places(table(spark, sf, "documents"))


@query(
    """SELECT code, count(*) AS n FROM (SELECT unicode(unnest(string_split(p_name || '|' || p_type, ''))) AS code FROM part) GROUP BY ALL"""
)
def char_inventory(spark, sf):
    p = table(spark, sf, "part")
    chars = F.filter(F.split(F.concat_ws("|", "p_name", "p_type"), ""), lambda c: c != "")
    return p.select(F.explode(chars).alias("c")).groupBy(F.ascii("c").alias("code")).agg(F.count("*").alias("n"))


@query("SELECT url, string_split(url, '/')[3] AS host, array_to_string(list_slice(string_split(url, '/'), 4, 99), '/') AS rest, len(string_split(url, '/'))::INTEGER AS parts FROM pages")
def split_limit(spark, sf):
    p = table(spark, sf, "pages")
    parts = F.split("url", "/")
    return p.select("url", F.element_at(parts, 3).alias("host"), F.array_join(F.slice(parts, 4, 99), "/").alias("rest"), F.size(parts).alias("parts"))


@query(
    """SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS sd, min(l_quantity) AS low, max(l_quantity) AS high, round(quantile_cont(l_quantity, 0.5), 4) AS median
FROM lineitem GROUP BY ALL"""
)
def summary_stats(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.avg(q), 4).alias("mean"), F.round(F.stddev(q), 4).alias("sd"), F.min(q).alias("low"), F.max(q).alias("high"), F.round(F.percentile(q, 0.5), 4).alias("median")
    )


@query()
def approx_distinct(spark, sf):
    return table(spark, sf, "orders").agg(F.approx_count_distinct("o_custkey", 0.02).alias("approx_customers"))


@query()
def approx_percentile(spark, sf):
    return table(spark, sf, "orders").agg(F.percentile_approx("o_totalprice", [0.25, 0.5, 0.75], 10000).alias("quartiles"))


@query(
    """WITH l AS (SELECT l_suppkey, l_quantity FROM lineitem UNION ALL SELECT 1, l_quantity FROM lineitem WHERE l_orderkey % 2 = 0)
SELECT s_name, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM l JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"""
)
def skew_join(spark, sf):
    li, su = tables(spark, sf, "lineitem", "supplier")
    hot = li.select("l_suppkey", "l_quantity").unionByName(li.filter("l_orderkey % 2 = 0").select(F.lit(1).cast("long").alias("l_suppkey"), "l_quantity"))
    # sums by key before the join: a hot key is one row for each task
    per = hot.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    return per.join(su, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_name").agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity"))


@query("SELECT s_name, count(*) AS n, max(l_extendedprice) AS top_price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def salted_skew_join(spark, sf):
    li, su = tables(spark, sf, "lineitem", "supplier")
    j = R.salted_join(li.select("l_suppkey", "l_extendedprice"), su.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", 8)
    return j.groupBy("s_name").agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("top_price"))


@query("SELECT l_suppkey, max(n)::DOUBLE / sum(n)::DOUBLE AS top_share FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def top_share(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return per.groupBy("l_suppkey").agg((F.max("n").cast("double") / F.sum("n")).alias("top_share"))


@query("SELECT l_suppkey, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-03-31' AND l_suppkey IN (3, 5, 7) GROUP BY ALL")
def clustered_filter_scan(spark, sf):
    li = table(spark, sf, "lineitem")
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    kept = li.filter(F.col("l_shipdate").between(day("1996-03-01"), day("1996-03-31")) & F.col("l_suppkey").isin(3, 5, 7))
    return kept.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query(
    """SELECT p_brand, count(*) AS n_lines FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice / l_quantity > 1.5 * p_retailprice GROUP BY ALL HAVING count(*) > 1"""
)
def overpriced_brands(spark, sf):
    li, part = tables(spark, sf, "lineitem", "part")
    j = li.join(part, F.col("l_partkey") == F.col("p_partkey")).filter(F.col("l_extendedprice") / F.col("l_quantity") > 1.5 * F.col("p_retailprice"))
    return j.groupBy("p_brand").agg(F.count("*").alias("n_lines")).filter("n_lines > 1")


@query(
    """SELECT m.month, n_name, coalesce(n, 0) AS n FROM (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month FROM orders) m CROSS JOIN nation
LEFT JOIN (SELECT date_trunc('month', o_orderdate)::DATE AS month, c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) x ON x.month = m.month AND x.c_nationkey = n_nationkey"""
)
def month_country_skeleton(spark, sf):
    o, c, n = tables(spark, sf, "orders", "customer", "nation")
    months = o.select(F.trunc("o_orderdate", "MM").alias("month")).distinct()
    skeleton = months.crossJoin(n.select("n_nationkey", "n_name"))  # months x nations: two small dimensions
    per = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.trunc("o_orderdate", "MM").alias("month"), F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return skeleton.join(per, ["month", "n_nationkey"], "left").select("month", "n_name", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(
    """SELECT column_name, complete FROM (UNPIVOT (SELECT round(count(o_custkey)::DOUBLE / count(*), 4) AS o_custkey, round(count(nullif(o_orderstatus, 'P'))::DOUBLE / count(*), 4) AS o_orderstatus FROM orders)
ON o_custkey, o_orderstatus INTO NAME column_name VALUE complete)"""
)
def completeness_ratio(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"))
    one = o.agg(*[F.round(F.count(c) / F.count(F.lit(1)), 4).alias(c) for c in o.columns])
    return one.unpivot([], o.columns, "column_name", "complete")


@query(
    """SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus)::INTEGER AS g1, grouping(o_orderpriority)::INTEGER AS g2, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"""
)
def rollup_priority(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(
        F.grouping("o_orderstatus").cast("int").alias("g1"), F.grouping("o_orderpriority").cast("int").alias("g2"), F.count("*").alias("n")
    )


@query("SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds, count(*) AS n FROM events GROUP BY user_id")
def collected_kinds(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"), F.count("*").alias("n"))


@query(
    """SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"""
)
def event_time_tumbling(spark, sf):
    e = table(spark, sf, "events")
    per = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return per.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_gap(spark, sf):
    e = table(spark, sf, "events").groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")
