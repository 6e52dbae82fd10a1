"""Published aggregates that are kept up: sketches that merge, sums that take deltas, tables compared by digests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- sketches

#: Sizes of the sketches: HLL 2^12 registers (standard error 1.6 %), theta 2^16 values (0.4 %, exact below 65,536),
#: KLL of 4,096 (rank error under 0.1 %, exact for about as many values).
HLL, THETA, KLL = 12, 16, 4096


def sketched(df: DataFrame, by: Sequence[Column | str], counted: str, measured: str) -> DataFrame:
    """by, n, hll and theta (distinct values of `counted`), kll (values of `measured`, as doubles): one pass, one
    exchange of sketches. Null values count in n only; a group without values has empty sketches."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(F.col(counted), HLL).alias("hll"), F.expr(f"theta_sketch_agg(`{counted}`, {THETA})").alias("theta"),
        F.expr(f"kll_sketch_agg_double(cast(`{measured}` AS double), {KLL})").alias("kll"),
    )


def merged(parts: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """Sketches of coarser groups from finer ones, without the rows; merged in each task first."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.expr(f"theta_union_agg(theta, {THETA})").alias("theta"), F.expr(f"kll_merge_agg_double(kll, {KLL})").alias("kll"))


def estimated(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """The sketches' columns replaced by distinct_hll, distinct_theta and the named quantiles (null without values)."""
    named = [F.expr(f"CASE WHEN kll_sketch_get_n_double(kll) > 0 THEN kll_sketch_get_quantile_double(kll, {q}D) END").alias(n) for n, q in quantiles.items()]
    rest = [c for c in sketches.columns if c not in ("hll", "theta", "kll")]
    return sketches.select(*rest, F.hll_sketch_estimate("hll").alias("distinct_hll"), F.expr("theta_sketch_estimate(theta)").alias("distinct_theta"), *named)


def exact_quantile(rows: DataFrame, by: Sequence[str], measured: str, sketches: DataFrame, q: float, slack: float = 0.005) -> DataFrame:
    """by, quantile: the value of rank ceil(q n) among the n values of each group that aren't null, as doubles. The
    groups' kll sketches only narrow the search to ranks within `slack` of q: values below are counted, those
    between are ranked. A group whose rank lies elsewhere, against the sketch's error bound, is ranked whole."""
    at = lambda p: F.expr(f"CASE WHEN kll_sketch_get_n_double(kll) > 0 THEN kll_sketch_get_quantile_double(kll, {p}D) END")
    bounds = sketches.select(*[F.col(c).alias(f"_by_{c}") for c in by], at(max(0.0, q - slack)).alias("_low"), at(min(1.0, q + slack)).alias("_high"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    values = rows.filter(F.col(measured).isNotNull()).select(*by, F.col(measured).cast("double").alias("_v"))
    counts = values.join(F.broadcast(bounds), same).groupBy(*by, "_low", "_high").agg(
        F.greatest(F.lit(1), F.ceil(F.lit(q) * F.count("*"))).alias("_rank"), F.count_if(F.col("_v") < F.col("_low")).alias("_below"), F.count_if(F.col("_v") <= F.col("_high")).alias("_upto")
    )
    inside = (F.col("_below") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto"))
    goal = counts.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.when(inside, F.col("_low")).otherwise(float("-inf")).alias("_low"), F.when(inside, F.col("_high")).otherwise(float("nan")).alias("_high"),
        F.when(inside, F.col("_rank") - F.col("_below")).otherwise(F.col("_rank")).alias("_rank"),
    )
    near = values.join(F.broadcast(goal), same).filter((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
    steps = near.groupBy(*by, "_v", "_rank").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_v"))
    return steps.withColumn("_upto", upto).filter(F.col("_upto") >= F.col("_rank")).groupBy(*by).agg(F.min("_v").alias("quantile"))


# ---------------------------------------------------------------- deltas


def aggregate(df: DataFrame, by: Sequence[str], sums: Sequence[str], extremes: Sequence[str]) -> DataFrame:
    """by, n, for each of sums sum_c and cnt_c (values that aren't null), min_c and max_c of each of extremes."""
    added = [x for c in sums for x in (F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}"), F.count(c).alias(f"cnt_{c}"))]
    ends = [x for c in extremes for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *added, *ends)


def kept_up(published: DataFrame, inserted: DataFrame, deleted: DataFrame, after: DataFrame, by: Sequence[str], sums: Sequence[str], extremes: Sequence[str]) -> DataFrame:
    """`aggregate` after the rows `deleted` went and `inserted` came (an update is one of each), from the published
    rows and the deltas alone. Counts and sums are added and retracted; a new least or greatest value is taken as
    it comes; only groups that lost a row at their minimum or maximum are read again from `after`, the table as it
    is then. Groups without rows go. Sums have to be exact (decimals or integers); groups may be null."""
    plus, minus = aggregate(inserted, by, sums, extremes), aggregate(deleted, by, sums, extremes)
    counts = ["n", *[f"{k}_{c}" for c in sums for k in ("sum", "cnt")]]
    ends = [f"{k}_{c}" for c in extremes for k in ("min", "max")]
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by])
    # one row a group: what was published, what came, what went
    rows = published.withColumn("_side", F.lit("was")).unionByName(plus.withColumn("_side", F.lit("plus"))).unionByName(minus.withColumn("_side", F.lit("minus")))
    of = lambda side, c: F.when(F.col("_side") == side, F.col(c))
    signed = [F.sum(F.when(F.col("_side") == "minus", -F.col(c)).otherwise(F.col(c))).cast(published.schema[c].dataType).alias(c) for c in counts]
    bounds = [(F.min if e.startswith("min_") else F.max)(F.when(F.col("_side") != "minus", F.col(e))).alias(e) for e in ends]
    # a row went that was at the end published or inserted: the end may be another now
    lost = [F.coalesce((F.max(of("minus", e)) == (F.min if e.startswith("min_") else F.max)(F.when(F.col("_side") != "minus", F.col(e)))), F.lit(False)) for e in ends]
    out = rows.groupBy(*by).agg(*signed, *bounds, reduce(lambda x, y: x | y, lost, F.lit(False)).alias("_lost")).filter("n > 0")
    if not ends:
        return out.drop("_lost")
    touched = out.filter("_lost").select(*by)
    again = after.alias("r").join(touched.alias("t"), same("r", "t"), "left_semi").groupBy(*by).agg(*[x for c in extremes for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))])
    joined = out.alias("o").join(again.alias("g"), same("o", "g"), "left")
    fresh = [F.when(F.col("o._lost"), F.col(f"g.{e}")).otherwise(F.col(f"o.{e}")).alias(e) for e in ends]
    return joined.select(*[F.col(f"o.{c}") for c in [*by, *counts]], *fresh)


# ---------------------------------------------------------------- digests


def digests(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """bucket, n and two sums of row hashes, for the rows of each bucket of keys: equal multisets of rows give equal
    digests in any order and layout. Sums of decimals, so repeated rows don't cancel out."""
    one = lambda salt: F.sum(F.xxhash64(F.lit(salt), *df.columns).cast("decimal(38,0)"))
    return df.groupBy(_bucket(keys, buckets).alias("bucket")).agg(F.count("*").alias("n"), one(1).alias("d1"), one(2).alias("d2"))


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def differences(a: DataFrame, b: DataFrame, keys: Sequence[str], buckets: int = 4096) -> DataFrame:
    """The rows that one table has oftener than the other, with `side` (left or right) and `surplus`. Digests are
    compared first, `buckets` rows a side; only rows of buckets that differ are shuffled and counted, so tables
    that are equal move their digests and nothing else. Both tables have the same columns and types."""
    b = b.select(*a.columns)
    da, db = digests(a, keys, buckets), digests(b, keys, buckets).select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("n", "d1", "d2")])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in ("n", "d1", "d2")])
    off = F.broadcast(da.join(db, "bucket", "full_outer").filter(~same).select(F.col("bucket").alias("_off")))  # at most `buckets` integers
    part = lambda df, sign: df.join(off, _bucket(keys, buckets) == F.col("_off"), "left_semi").withColumn("_sign", F.lit(sign))
    counted = part(a, 1).unionByName(part(b, -1)).groupBy(*a.columns).agg(F.sum("_sign").alias("_d")).filter("_d <> 0")
    return counted.select(*a.columns, F.when(F.col("_d") > 0, "left").otherwise("right").alias("side"), F.abs("_d").cast("long").alias("surplus"))
