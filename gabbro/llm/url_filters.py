"""URL filters by a temporal list join, in DataFrame operations only.

A list is a log of dated entries (list_name, scope, pattern, at, action), action being 'add' or
'remove'. Per entry the log becomes validity intervals [valid_from, valid_to), open at the end if
nothing follows. A capture (page_id, url, fetched_at) is looked up under every key its url has: its
host, its host and every parent domain of two labels or more, and every path prefix; an as-of join
evaluates it against the entries active when it was fetched. Prefixes and domains are made only at the
depths that the list has for the same host or last two labels, so a URL of very many segments costs its
length times the depths listed there, and a capture whose host is in no list has no keys.

Skew: the key join is an inner equi join with the interval as a residual, both sides dealt by key, so
Spark splits the partitions of a hot host; captures without any match don't pass through it. Entries
are broadcast only where Spark finds them under its threshold. Matches are counted before the shuffle
that gathers a capture.

Edge cases: a null url, or one without host, has no keys and is kept; a null fetched_at matches
nothing; null page_ids are values; repeated captures give repeated rows; of entries at the same time
'remove' wins over 'add'; repeated entries count once; entries with a null field are ignored; an empty
list keeps everything; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gabbro.tables import table

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)"


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, scope, pattern, valid_from, valid_to) of a log of entries."""
    key = ["list_name", "scope", "pattern"]
    log = entries.select(*key, "at", "action").dropna().withColumn("pattern", F.lower("pattern"))
    # one action a time: 'remove' sorts after 'add'
    log = log.groupBy(*key, "at").agg(F.max("action").alias("action"))
    w = Window.partitionBy(*key).orderBy("at")
    log = log.withColumn("was", F.lag("action").over(w)).filter(F.col("was").isNull() | (F.col("was") != F.col("action")))
    log = log.withColumn("valid_to", F.lead("at").over(w))
    return log.filter(F.col("action") == "add").select(*key, F.col("at").alias("valid_from"), "valid_to")


def keys_of(captures: DataFrame, live: DataFrame) -> DataFrame:
    """A row for each (capture, scope, pattern) under which the list live can hold the capture: of its parent
    domains and path prefixes only those as deep as the list has any, for prefixes of its host, for domains
    of its last two labels."""
    parts = F.when(F.col("scope") == "domain", F.size(F.split("pattern", r"\."))).when(F.col("scope") == "prefix", F.size(F.split("pattern", "/")) - 1).otherwise(1)
    place = F.when(F.col("scope") == "domain", F.substring_index("pattern", ".", -2)).when(F.col("scope") == "prefix", F.substring_index("pattern", "/", 1)).otherwise(F.col("pattern"))
    listed = live.select(F.col("scope").alias("l_scope"), place.alias("l_place"), parts.alias("parts")).filter("parts > 0").distinct()
    known = captures.withColumn("host", host_of(F.col("url"))).filter(F.col("host") != "")
    steps = F.filter(F.split(F.lower(F.regexp_extract("url", PATH, 1)), "/"), lambda x: x != "")
    known = known.withColumn("steps", steps).select(
        "page_id", "url", "fetched_at", "host", F.greatest(F.size("steps"), F.lit(1)).alias("n_steps"), F.concat("host", F.lit("/"), F.array_join("steps", "/")).alias("path")
    )
    own = [
        (F.lit("host"), F.col("host"), F.col("host"), F.lit(1)),
        (F.lit("domain"), F.substring_index("host", ".", -2), F.col("host"), F.size(F.split("host", r"\."))),
        (F.lit("prefix"), F.col("host"), F.col("path"), F.col("n_steps")),
    ]
    each = known.select("page_id", "url", "fetched_at", F.explode(F.array(*[F.struct(*[x.alias(c) for x, c in zip(o, ("scope", "place", "whole", "most"))]) for o in own])).alias("k"))
    met = each.select("page_id", "url", "fetched_at", "k.*").join(listed, (F.col("scope") == F.col("l_scope")) & (F.col("place") == F.col("l_place")) & (F.col("parts") <= F.col("most")))
    pattern = F.expr("CASE scope WHEN 'domain' THEN substring_index(whole, '.', -parts) WHEN 'prefix' THEN substring_index(whole, '/', parts + 1) ELSE whole END")
    return met.select("page_id", "url", "fetched_at", "scope", pattern.alias("pattern"))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every capture with n_active (entries active at its fetch), first_rule and blocked."""
    own = captures.select("page_id", "url", "fetched_at")
    live = intervals(entries)
    keys = keys_of(own, live)
    hit = keys.join(
        live.withColumnRenamed("scope", "l_scope").withColumnRenamed("pattern", "l_pattern"),
        (F.col("pattern") == F.col("l_pattern"))
        & (F.col("scope") == F.col("l_scope"))
        & (F.col("fetched_at") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))),
    )
    rule = F.concat_ws(":", "list_name", "scope", "pattern")
    rows = own.select("page_id", "url", "fetched_at", F.lit(1).alias("own"), F.lit(None).cast("string").alias("rule")).unionByName(
        hit.select("page_id", "url", "fetched_at", F.lit(0).alias("own"), rule.alias("rule"))
    )
    found = rows.groupBy("page_id", "url", "fetched_at").agg(F.sum("own").alias("copies"), F.count("rule").alias("hits"), F.min("rule").alias("first_rule"))
    return found.select(
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), "page_id", "url", "fetched_at", (F.col("hits") / F.col("copies")).cast("long").alias("n_active"), "first_rule"
    ).select("page_id", "url", "fetched_at", "n_active", "first_rule", (F.col("n_active") > 0).alias("blocked"))


def keep(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures that no active entry holds."""
    return evaluate(captures, entries).filter(~F.col("blocked")).select("page_id", "url", "fetched_at")


def _day(text: F.Column) -> F.Column:
    """A day of 2024 or 2025 from a string, for the query's list."""
    return F.date_add(F.lit("2024-01-01").cast("date"), (F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") % 720).cast("int")).cast("timestamp_ntz")


def query_inputs(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages as captures of 2024 and 2025, and a list log drawn from their hosts: of every host and its
    parent domain three dated entries each, add, remove, add, for a ninth of the patterns."""
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 720).cast("int")).cast("timestamp_ntz")
    captures = pages.select("page_id", "url", fetched.alias("fetched_at"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    scoped = hosts.select(
        F.explode(
            F.array(
                F.struct(F.lit("host").alias("scope"), F.col("host").alias("pattern")),
                F.struct(F.lit("domain").alias("scope"), F.substring_index("host", ".", -3).alias("pattern")),
                F.struct(F.lit("prefix").alias("scope"), F.concat("host", F.lit("/en")).alias("pattern")),
            )
        ).alias("k")
    ).select("k.scope", "k.pattern").distinct()
    pick = scoped.filter(F.conv(F.substring(F.md5(F.concat(F.col("scope"), F.col("pattern"))), 1, 7), 16, 10).cast("long") % 9 == 0)
    entries = pick.select(
        F.concat(F.lit("list-"), F.col("scope")).alias("list_name"), "scope", "pattern", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")
    ).select("list_name", "scope", "pattern", _day(F.concat_ws("#", F.col("pattern"), F.col("i").cast("string"))).alias("at"), F.when(F.col("i") == 1, "remove").otherwise("add").alias("action"))
    return captures, entries


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(*query_inputs(table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url")))


QUERIES = {"op7_url_filters": op7_url_filters}
ORACLE_SQL = {
    "op7_url_filters": r"""
WITH c AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days((page_id * 37 % 720)::INTEGER) AS fetched_at,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
         list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1)), '/'), lambda x: x <> '') AS steps
  FROM pages
), scoped AS (
  SELECT DISTINCT 'host' AS scope, host AS pattern FROM c WHERE host <> ''
  UNION SELECT DISTINCT 'domain', array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') FROM c WHERE host <> ''
  UNION SELECT DISTINCT 'prefix', host || '/en' FROM c WHERE host <> ''
), e AS (
  SELECT 'list-' || scope AS list_name, scope, pattern, CASE WHEN i = 1 THEN 'remove' ELSE 'add' END AS action,
         TIMESTAMP '2024-01-01' + to_days((('0x' || substr(md5(pattern || '#' || i), 1, 7))::BIGINT % 720)::INTEGER) AS day_at
  FROM scoped, (SELECT unnest([0, 1, 2]) AS i)
  WHERE ('0x' || substr(md5(scope || pattern), 1, 7))::BIGINT % 9 = 0
), g AS (
  SELECT list_name, scope, pattern, day_at, max(action) AS action FROM e GROUP BY ALL
), k AS (
  SELECT page_id, url, fetched_at, 'host' AS scope, host AS pattern FROM c WHERE host <> ''
  UNION SELECT page_id, url, fetched_at, 'domain', array_to_string(list_slice(string_split(host, '.'), i, 99), '.')
    FROM c, LATERAL (SELECT unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS i) WHERE host <> ''
  UNION SELECT page_id, url, fetched_at, 'prefix', host || '/' || array_to_string(list_slice(steps, 1, i), '/')
    FROM c, LATERAL (SELECT unnest(range(1, greatest(len(steps), 1) + 1)) AS i) WHERE host <> ''
), looked AS (
  SELECT k.*, g.list_name, g.action,
         row_number() OVER (PARTITION BY k.page_id, k.url, k.scope, k.pattern, g.list_name ORDER BY g.day_at DESC) AS rn
  FROM k JOIN g ON k.scope = g.scope AND k.pattern = g.pattern AND g.day_at <= k.fetched_at
), hit AS (
  SELECT page_id, url, count(*) AS n, min(list_name || ':' || scope || ':' || pattern) AS first_rule
  FROM looked WHERE rn = 1 AND action = 'add' GROUP BY ALL
)
SELECT c.page_id, c.url, c.fetched_at, coalesce(n, 0)::BIGINT AS n_active, first_rule, coalesce(n, 0) > 0 AS blocked
FROM c LEFT JOIN hit ON c.page_id = hit.page_id AND c.url = hit.url
"""
}
