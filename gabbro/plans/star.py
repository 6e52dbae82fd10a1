"""The star schema and its silver builders over the driver tables, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from gabbro.operators import relational as R
from gabbro.operators import scd, silver
from gabbro.operators.store import VersionedTable
from gabbro.plans.gold import SQL_LINES, SQL_NET, SQL_PLANS, lines_once, money, net, plan_history
from gabbro.plans.platform import scratch
from gabbro.sources import ingest
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


# ---------------------------------------------------------------- silver


@query(
    f"""SELECT l_orderkey, l_linenumber, strftime(o_orderdate, '%Y-%m') AS order_month, o_custkey, c_mktsegment, n_name AS country, {SQL_NET} AS net_amount,
  l_returnflag = 'R' AS is_returned, c_custkey IS NULL AS unknown_customer, p_partkey IS NULL AS unknown_product
FROM {SQL_LINES} JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) c ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM part WHERE p_partkey % 17 <> 0) p ON l_partkey = p_partkey"""
)
def order_line(spark, sf):
    """Order lines, deduplicated, with their parents; lines without customer or product stay, flagged."""
    orders, customer, nation, part = tables(spark, sf, "orders", "customer", "nation", "part")
    lines = lines_once(spark, sf).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    out = silver.with_parents(
        lines,
        {
            "unknown_customer": (customer.filter("c_custkey % 10 <> 0"), "o_custkey", "c_custkey", ["c_mktsegment", "c_nationkey"]),
            "no_country": (nation, "c_nationkey", "n_nationkey", [F.col("n_name").alias("country")]),
            "unknown_product": (part.filter("p_partkey % 17 <> 0"), "l_partkey", "p_partkey", []),
        },
    )
    return out.select(
        "l_orderkey", "l_linenumber", F.date_format("o_orderdate", "yyyy-MM").alias("order_month"), "o_custkey", "c_mktsegment", "country",
        net().alias("net_amount"), (F.col("l_returnflag") == "R").alias("is_returned"), "unknown_customer", "unknown_product",
    )


@query("SELECT event_id, user_id, event_type, json_extract(props, '$.k')::INTEGER AS k FROM events")
def event_flatten(spark, sf):
    """Nested events, a twentieth of them delivered twice: one flat row each."""
    e = table(spark, sf, "events").select("event_id", "ts", F.struct("user_id", "event_type").alias("user"), F.from_json("props", "k int").alias("p"))
    twice = e.unionByName(e.filter("event_id % 20 = 0"))
    return silver.flat_events(twice, "event_id", ["event_id", "ts"], {"user_id": "user.user_id", "event_type": "user.event_type", "k": "p.k"})


@query(f"SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS pos, l_quantity AS qty FROM {SQL_LINES}")
def order_item_child(spark, sf):
    """Orders with an array of items, and back: a row an item with its place."""
    nested = lines_once(spark, sf).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("qty")))).alias("items"))
    return ingest.items_of(nested, "items", ["l_orderkey"]).withColumn("pos", F.col("pos").cast("long"))


@query(
    """SELECT CASE WHEN event_id % 40 = 0 THEN 'UNPARSED' ELSE 'NO_KEY' END AS reason, count(*) AS n, count(*) FILTER (event_id % 40 = 0) AS n_with_text FROM events
WHERE event_id % 40 = 0 OR event_id % 33 = 0 GROUP BY ALL"""
)
def malformed_quarantine(spark, sf):
    """Cut lines and lines without a key, stored aside with their text."""
    top = scratch(spark, "malformed")
    e = table(spark, sf, "events")
    whole = F.to_json(F.struct(F.when(F.col("event_id") % 33 != 0, F.col("event_id")).alias("event_id"), "event_type"))
    e.select(F.when(F.col("event_id") % 40 == 0, F.substring(F.concat(F.lit('{"event_id": '), F.col("event_type")), 1, 15)).otherwise(whole).alias("value")).write.text(f"{top}/in")
    raw = ingest.read_json(spark, f"{top}/in", "event_id long, event_type string")
    aside = VersionedTable(spark, f"{top}/quarantine")
    aside.append(silver.malformed(raw, "event_id"))
    return aside.read().groupBy("reason").agg(F.count("*").alias("n"), F.count("raw_text").alias("n_with_text"))


SQL_ADDRESS = "CASE WHEN c_custkey % 7 = 0 THEN c_custkey || ' rue A; bat. B, ' || c_mktsegment WHEN c_custkey % 11 = 0 THEN c_custkey || ' rue A' ELSE c_custkey || ' rue A, ' || c_mktsegment END"


def _addresses(spark, sf) -> str:
    """Lines key;segment;address without quotes: some addresses hold the separator, some were cut."""
    folder = scratch(spark, "addresses")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.expr(SQL_ADDRESS).alias("address"))
    c.select(F.concat_ws(";", F.col("c_custkey").cast("string"), "c_mktsegment", "address").alias("value")).write.text(folder)
    return folder


@query(f"SELECT c_custkey::VARCHAR AS id, c_mktsegment AS segment, {SQL_ADDRESS} AS address, c_custkey % 7 = 0 AS was_repaired FROM customer")
def address_repair(spark, sf):
    """The last field holds separators: read as CSV, then repaired from the raw lines and joined back."""
    folder = _addresses(spark, sf)
    rows = ingest.read_csv(spark, folder, ["id", "segment", "address"], ";", header=False).drop("_rescued_data")
    fixes = ingest.repaired_last_field(ingest.read_raw_lines(spark, folder), 3, ";")
    return silver.repaired(rows, fixes, "id", "address")


@query("SELECT CASE WHEN c_custkey % 7 = 0 THEN 4 ELSE 3 END AS n_fields, count(*) AS n_lines FROM customer GROUP BY ALL")
def field_count_histogram(spark, sf):
    return silver.field_counts(ingest.read_raw_lines(spark, _addresses(spark, sf)), ";")


@query(f"SELECT c_custkey, {SQL_ADDRESS} AS address FROM customer WHERE {SQL_ADDRESS} NOT LIKE '%,%'")
def truncated_addresses(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.expr(SQL_ADDRESS).alias("address"))
    return c.filter(silver.truncated(F.col("address")))


# lines of every 24th supplier are in cents; a list price is that of one piece
SQL_PRICED = """(SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, p_retailprice,
  CASE WHEN l_suppkey % 24 = 7 THEN 100 ELSE 1 END * l_extendedprice::DECIMAL(14,2) AS price FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 13 <> 0) ON l_partkey = p_partkey)"""


def _priced(spark, sf):
    # Fixed value: the suppliers whose prices come in cents.
    li = table(spark, sf, "lineitem").withColumn("price", F.when(F.col("l_suppkey") % 24 == 7, 100).otherwise(1) * F.col("l_extendedprice").cast("decimal(14,2)"))
    li = li.withColumn("piece", F.col("price") / F.col("l_quantity").cast("decimal(10,2)"))
    return silver.suspected_scale(li, table(spark, sf, "part").filter("p_partkey % 13 <> 0"), "l_partkey", "p_partkey", "piece", "p_retailprice")


@query(f"SELECT l_suppkey % 24 = 7 AS in_cents, coalesce(price / l_quantity > p_retailprice * 10, false) AS suspected_unit_scale, count(*) AS n FROM {SQL_PRICED} GROUP BY ALL")
def price_scale(spark, sf):
    return _priced(spark, sf).groupBy((F.col("l_suppkey") % 24 == 7).alias("in_cents"), "suspected_unit_scale").agg(F.count("*").alias("n"))


@query(
    f"""SELECT count(*) AS n_lines, sum(price)::DECIMAL(20,2) AS declared, sum(round(price * 0.01::DECIMAL(3,2), 2))::DECIMAL(20,2) AS plausible, (sum(price) - sum(round(price * 0.01::DECIMAL(3,2), 2)))::DECIMAL(20,2) AS excess
FROM {SQL_PRICED} WHERE coalesce(price / l_quantity > p_retailprice * 10, false)"""
)
def impact_estimate(spark, sf):
    return silver.impact(_priced(spark, sf), "suspected_unit_scale", F.col("price"), F.round(F.col("price") * F.lit("0.01").cast("decimal(3,2)"), 2))


# ---------------------------------------------------------------- dimensions and fact

@query(
    """WITH d AS (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM (SELECT DISTINCT ON (user_id, ts) * FROM events ORDER BY user_id, ts, event_type DESC)),
c AS (SELECT user_id, event_type AS segment, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM d WHERE was IS NULL OR was <> event_type)
SELECT user_id, segment, ts AS since FROM c WHERE rn = 1"""
)
def dim_customer(spark, sf):
    """The current rows of a history."""
    j = table(spark, sf, "events").select("user_id", "ts", F.col("event_type").alias("segment"))
    return scd.rebuild(j, "user_id", "ts", ["segment"]).filter("is_current").select("user_id", "segment", F.col("valid_from").alias("since"))


@query(
    f"""SELECT supp || '#' || strftime(valid_from, '%Y%m%d%H%M%S') AS seller_sk, supp, s_name, plan_version, valid_from, valid_to, valid_to IS NULL AS is_current
FROM {SQL_PLANS} h JOIN supplier ON supp = supplier.s_suppkey"""
)
def dim_seller(spark, sf):
    """Every version of a seller under a key of its own."""
    su = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supp"), "s_name")
    h = plan_history(spark, sf).join(su, "supp")
    return h.select(F.concat_ws("#", F.col("supp").cast("string"), F.date_format("valid_from", "yyyyMMddHHmmss")).alias("seller_sk"), "supp", "s_name", "plan_version", "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"))


@query("SELECT p_partkey, p_name, p_brand, b.label, p_retailprice::DECIMAL(10,2) AS list_price FROM part LEFT JOIN (SELECT p_brand AS brand, 'top ' || max(p_type) AS label FROM part WHERE p_brand <> 'Brand#13' GROUP BY 1) b ON p_brand = b.brand")
def dim_product(spark, sf):
    """Products with their category; one brand has none."""
    part = table(spark, sf, "part")
    category = part.filter("p_brand <> 'Brand#13'").groupBy(F.col("p_brand").alias("brand")).agg(F.concat(F.lit("top "), F.max("p_type")).alias("label"))
    return part.join(category, F.col("p_brand") == F.col("brand"), "left").select("p_partkey", "p_name", "p_brand", "label", F.col("p_retailprice").cast("decimal(10,2)").alias("list_price"))


SQL_FACT = f"""(SELECT l_orderkey, l_linenumber, o_orderdate::DATE AS date_day, o_custkey, l_partkey, supp || '#' || strftime(valid_from, '%Y%m%d%H%M%S') AS seller_sk, plan_version, l_returnflag, {SQL_NET} AS net_amount,
  CASE WHEN l_returnflag = 'R' THEN 0 ELSE round({SQL_NET} * rate, 2) END::DECIMAL(14,2) AS commission
FROM {SQL_LINES} JOIN orders ON l_orderkey = o_orderkey LEFT JOIN {SQL_PLANS} h ON l_suppkey = supp AND o_orderdate >= valid_from AND (valid_to IS NULL OR o_orderdate < valid_to))"""


def fact(spark, sf):
    """A row an order line, with the seller's version at the time of the order and its commission."""
    lines = lines_once(spark, sf).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = R.as_of_join(lines, plan_history(spark, sf).withColumnRenamed("supp", "l_suppkey").drop("s_suppkey"), "l_suppkey", "o_orderdate")
    fee = F.when(F.col("l_returnflag") == "R", F.lit(0).cast("decimal(14,2)")).otherwise(F.round(net() * F.col("rate"), 2).cast("decimal(14,2)"))
    return j.select(
        "l_orderkey", "l_linenumber", F.col("o_orderdate").cast("date").alias("date_day"), "o_custkey", "l_partkey",
        F.concat_ws("#", F.col("l_suppkey").cast("string"), F.date_format("valid_from", "yyyyMMddHHmmss")).alias("seller_sk"), "plan_version", "l_returnflag", net().alias("net_amount"), fee.alias("commission"),
    )


@query(f"SELECT * FROM {SQL_FACT}")
def fact_order_line(spark, sf):
    return fact(spark, sf)


@query(f"SELECT date_trunc('month', date_day)::DATE AS month, p_brand, seller_sk, sum(net_amount)::DECIMAL(18,2) AS revenue, sum(commission)::DECIMAL(18,2) AS commission, count(DISTINCT l_orderkey) AS n_orders FROM {SQL_FACT} LEFT JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY ALL")
def agg_revenue_monthly(spark, sf):
    """The published aggregate, from the fact and its dimensions. Orders are counted in two phases."""
    f = fact(spark, sf).filter("l_returnflag <> 'R'").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    per = f.groupBy(F.trunc("date_day", "MM").alias("month"), "p_brand", "seller_sk", "l_orderkey").agg(F.sum("net_amount").alias("revenue"), F.sum("commission").alias("commission"))
    return per.groupBy("month", "p_brand", "seller_sk").agg(money(F.sum("revenue")).alias("revenue"), money(F.sum("commission")).alias("commission"), F.count("*").alias("n_orders"))


@query("SELECT o_orderdate::DATE AS day, count(*) AS n, round(avg((c_custkey IS NULL)::INTEGER), 6) AS orphan_rate FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c_custkey GROUP BY ALL")
def orphan_rate_by_day(spark, sf):
    flagged = R.flag_orphans(table(spark, sf, "orders"), table(spark, sf, "customer").filter("c_custkey % 10 <> 0"), "o_custkey", "c_custkey", "orphan")
    return flagged.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("orphan").cast("int")), 6).alias("orphan_rate"))


@query(f"SELECT l_shipdate::DATE AS day, p_type AS category, sum({SQL_NET})::DECIMAL(18,2) AS revenue FROM {SQL_LINES} JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY ALL")
def revenue_by_day_category(spark, sf):
    li = lines_once(spark, sf).filter("l_returnflag <> 'R'").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy(F.col("l_shipdate").cast("date").alias("day"), F.col("p_type").alias("category")).agg(money(F.sum(net())).alias("revenue"))


@query(
    """SELECT unnest(['duplicate_lines', 'high_discount', 'late_lines', 'negative_balance']) AS issue,
unnest([(SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem), (SELECT count(*) FROM lineitem WHERE l_discount > 0.08), (SELECT count(*) FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-01-01'), (SELECT count(*) FROM customer WHERE c_acctbal < 0)]) AS n"""
)
def data_quality_report(spark, sf):
    """Four counts: one pass for each table, then one row an issue."""
    per = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c"), F.count_if(F.col("l_discount") > 0.08).alias("d"), F.count_if(F.col("l_shipdate") > F.lit("1998-01-01").cast("timestamp_ntz")).alias("l"))
    lines = per.agg(F.sum(F.col("c") - 1).alias("duplicate_lines"), F.sum("d").alias("high_discount"), F.sum("l").alias("late_lines")).unpivot([], ["duplicate_lines", "high_discount", "late_lines"], "issue", "n")
    customers = table(spark, sf, "customer").agg(F.count_if(F.col("c_acctbal") < 0).alias("negative_balance")).unpivot([], ["negative_balance"], "issue", "n")
    return lines.unionByName(customers)


@query(
    """WITH o AS (SELECT c_nationkey AS station, o_orderdate::DATE AS day, count(*) AS n_out FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
i AS (SELECT s_nationkey AS station, l_shipdate::DATE AS day, count(*) AS n_in FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT n_name, day, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(n_in, 0) - coalesce(n_out, 0) AS net_flow FROM o FULL JOIN i USING (station, day) JOIN nation ON station = n_nationkey"""
)
def daily_station_usage(spark, sf):
    """Departures and arrivals by place and day, 0 where there was none, and the difference."""
    orders, customer, li, su, nation = tables(spark, sf, "orders", "customer", "lineitem", "supplier", "nation")
    out = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("station"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n_out"))
    came = li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("station"), F.col("l_shipdate").cast("date").alias("day")).agg(F.count("*").alias("n_in"))
    both = R.full_outer_zero(out, came, ["station", "day"]).join(nation, F.col("station") == F.col("n_nationkey"))
    return both.select("n_name", "day", "n_out", "n_in", (F.col("n_in") - F.col("n_out")).alias("net_flow"))


# ---------------------------------------------------------------- history


@query(
    """SELECT t.c AS "check", (t.n * k.keys)::BIGINT AS violations FROM (VALUES ('several_current', 2), ('no_current', 1), ('gap_or_overlap', 1), ('empty_interval', 1), ('current_is_closed', 2), ('equal_neighbours', 1)) t(c, n),
  (SELECT count(*) AS keys FROM supplier) k"""
)
def scd2_integrity_finds(spark, sf):
    """For every supplier one broken history of each kind: each check finds its own."""
    v = "struct<kind:string,valid_from:int,valid_to:int,is_current:boolean,row_hash:string>"
    broken = [
        ("fine", 0, 5, False, "a"), ("fine", 5, None, True, "b"),
        ("two", 0, 5, True, "a"), ("two", 5, None, True, "b"),  # two current rows, of which one is closed
        ("none", 0, 5, False, "a"), ("none", 5, 9, False, "b"),
        ("gap", 0, 4, False, "a"), ("gap", 5, None, True, "b"),
        ("empty", 0, 0, False, "a"), ("empty", 0, None, True, "b"),
        ("shut", 0, 7, True, "a"),
        ("same", 0, 5, False, "a"), ("same", 5, None, True, "a"),
    ]
    rows = F.array(*[F.struct(*[F.lit(x) for x in r]).cast(v) for r in broken])
    h = table(spark, sf, "supplier").select("s_suppkey", F.explode(rows).alias("r")).select(F.concat_ws("-", F.col("s_suppkey").cast("string"), "r.kind").alias("k"), "r.valid_from", "r.valid_to", "r.is_current", "r.row_hash")
    return scd.integrity(h, "k", "row_hash")


@query("SELECT change, count(*) AS n FROM (SELECT CASE WHEN rn = 1 THEN 'opened' ELSE 'changed' END AS change FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM (SELECT DISTINCT ON (user_id, ts) * FROM events ORDER BY user_id, ts, event_type DESC)) WHERE was IS NULL OR was <> event_type) GROUP BY ALL")
def scd2_change_log(spark, sf):
    """A log table of what a history gained: new keys and changes."""
    j = table(spark, sf, "events").select("user_id", "ts", F.col("event_type").alias("status"))
    h = scd.rebuild(j, "user_id", "ts", ["status"])
    log = VersionedTable(spark, scratch(spark, "changelog"))
    log.append(scd.change_log(h, "user_id"))
    return log.read().groupBy("change").agg(F.count("*").alias("n"))
