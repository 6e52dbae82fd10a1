"""Relational building blocks. Each declares a plan only: no action, no collect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """One row a key, by a total order; Spark limits each partition before the shuffle (group limit)."""
    by = [c.desc() if last else c.asc() for c in order]
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return ranked.filter("_rn = 1").drop("_rn")


def total_order(df: DataFrame, first: Sequence[str] = ()) -> list[Column]:
    """first, then every other column: ties are then equal rows."""
    return [F.col(c) for c in [*first, *(c for c in df.columns if c not in first)]]


def split_quarantine(df: DataFrame, why: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with a `reasons` array): each input row is in exactly one of them."""
    marked = df.withColumn("reasons", why)
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def flag_orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str, flag: str) -> DataFrame:
    """All rows of df, with flag true where the key has no parent."""
    known = parent.select(F.col(parent_key).alias("_k")).distinct()
    return df.join(known, F.col(key) == F.col("_k"), "left").withColumn(flag, F.col("_k").isNull()).drop("_k")


def as_of_join(facts: DataFrame, history: DataFrame, key: str, at: str, how: str = "left", cell: Column | None = None) -> DataFrame:
    """Facts with the version of their key in force at `at`: [valid_from, valid_to), null = open; how: left or
    inner. Versions of a key must not overlap.

    By sorting, not by pairs: facts and versions are one table, sorted once by key and time, and the last version
    is carried forward, so no more rows than facts and versions are ever made. `cell` (of facts, by name `at`) cuts
    the time of a key into parts for keys so hot that one would fill a task: each cell starts with the version in
    force before it, which is carried to the cells in a sort of versions and cells alone.

    Facts with a null key or time have no version and take no part in the sort."""
    names = [c for c in history.columns if c != key]
    fact, version = F.struct(*[F.col(c) for c in facts.columns]), F.struct(*[F.col(c) for c in names])
    known = history.filter(F.col(key).isNotNull() & F.col("valid_from").isNotNull())
    timed = facts.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    placed = timed.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), (cell if cell is not None else F.lit(0)).alias("_cell"), fact.alias("_fact"))
    if cell is None:
        starts = known.select(F.col(key).alias("_key"), F.col("valid_from").alias("_at"), F.lit(0).alias("_kind"), F.lit(0).alias("_cell"), version.alias("_version"))
    else:
        # a version opens in the cell of its start; each cell's earliest fact asks for the version before it
        own = known.select(F.col(key).alias("_key"), F.col("valid_from").alias(at), version.alias("_version"))
        own = own.select("_key", F.col(at).alias("_at"), F.lit(0).alias("_kind"), cell.alias("_cell"), "_version")
        asks = placed.groupBy("_key", "_cell").agg(F.min("_at").alias("_at")).select("_key", "_at", F.lit(1).alias("_kind"), "_cell")
        before = own.unionByName(asks, allowMissingColumns=True)
        w = Window.partitionBy("_key").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
        seeds = before.withColumn("_version", F.last("_version", ignorenulls=True).over(w)).filter("_kind = 1 and _version is not null").withColumn("_kind", F.lit(0))
        starts = own.unionByName(seeds)
    w = Window.partitionBy("_key", "_cell").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = placed.unionByName(starts, allowMissingColumns=True).withColumn("_last", F.last("_version", ignorenulls=True).over(w)).filter("_kind = 1")
    open_ = F.col("_last").isNotNull() & (F.col("_last.valid_to").isNull() | (F.col("_at") < F.col("_last.valid_to")))
    out = carried.filter(open_) if how == "inner" else carried
    out = out.select("_fact.*", *[F.when(open_, F.col(f"_last.{c}")).alias(c) for c in names])
    if how == "inner":
        return out
    rest = facts.filter(F.col(key).isNull() | F.col(at).isNull())
    return out.unionByName(rest.select(*facts.columns, *[F.lit(None).cast(history.schema[c].dataType).alias(c) for c in names]))


def cell_of(df: DataFrame, c: str, width: int) -> Column:
    """The number of the cell of `width` (microseconds of a time, else units of the number) that c lies in."""
    number = F.unix_micros(F.col(c).cast("timestamp")) if df.schema[c].dataType.simpleString().startswith(("timestamp", "date")) else F.col(c).cast("long")
    return F.call_function("div", number - F.pmod(number, F.lit(width)), F.lit(width))


def within_intervals(intervals: DataFrame, points: DataFrame, key: str, start: str, end: str, at: str, width: int, how: str = "inner") -> DataFrame:
    """Intervals [start, end) with the points of their key that lie in them; how: inner, left_semi or left_anti
    (intervals with a point, or without one).

    Time is cut into cells of `width`: an interval is repeated for each cell it touches, a point is in one, and
    they meet by (key, cell), so a key compares neighbours only and never all with all. Choose a width near the
    usual length: an interval then has two cells or so. Null keys and bounds meet nothing; columns of points
    other than the key must have names of their own."""
    cells = F.sequence(cell_of(intervals, start, width), cell_of(intervals, end, width))
    cut = intervals.filter(F.col(start) < F.col(end)).withColumn("_cell", F.explode(cells))
    dots = points.withColumn("_cell", cell_of(points, at, width))
    if how == "inner":
        met = cut.join(dots, [key, "_cell"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
        return met.drop("_cell")
    p = dots.select(F.col(key).alias("_key"), F.col("_cell").alias("_c"), F.col(at).alias("_at"))
    inside = (F.col(key) == F.col("_key")) & (F.col("_cell") == F.col("_c")) & (F.col("_at") >= F.col(start)) & (F.col("_at") < F.col(end))
    hit = cut.join(p, inside, "left_semi").select(F.col(key).alias("_key"), F.col(start).alias("_start"), F.col(end).alias("_end")).distinct()
    return intervals.join(hit, (F.col(key) == F.col("_key")) & (F.col(start) == F.col("_start")) & (F.col(end) == F.col("_end")), how)


def heavy_keys(df: DataFrame, key: str, share: float, tracked: int = 10_000) -> list:
    """Keys that hold at least `share` of the rows, most frequent first, from one pass: each task keeps a summary
    of frequent items, and the summaries are merged. At most 1 / share keys, so the list is bounded. A summary of
    `tracked` items is off by at most 3.5 / tracked of the rows (8,192 slots hold three quarters as many): no key
    of `share` is missed, and a key below it may be taken, which costs nothing but its salts. Null is no key."""
    most = int(1 / share) + 1
    # counts are upper bounds: more than 1 / share of them may reach the line, by the summary's error
    top = df.filter(F.col(key).isNotNull()).agg(F.count("*").alias("n"), F.expr(f"approx_top_k(`{key}`, {min(tracked, 2 * most)}, {tracked})").alias("top")).first()
    return [r["item"] for r in top["top"] if r["count"] >= share * top["n"]]


def split_join(facts: DataFrame, dim: DataFrame, key: str, share: float = 0.01, salts: int = 32, how: str = "inner") -> DataFrame:
    """An equi join in which only heavy keys are salted: facts of a heavy key (or of null, which joins nothing) are
    dealt to `salts` parts by a hash of the row, the dimension is repeated for heavy keys only, and all other
    rows meet by key as they are. how: inner, left, left_semi or left_anti."""
    heavy = heavy_keys(facts, key, share)
    hot = F.col(key).isin(heavy) if heavy else F.lit(False)
    spread = F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int")
    left = facts.withColumn("_salt", F.when(hot | F.col(key).isNull(), spread).otherwise(0))
    return left.join(repeated(dim, key, heavy, salts), [key, "_salt"], how).drop("_salt")


def repeated(dim: DataFrame, key: str, heavy: list, salts: int) -> DataFrame:
    """dim with `_salt`: 0 to salts - 1 for rows of heavy keys, 0 for all others."""
    hot = F.col(key).isin(heavy) if heavy else F.lit(False)
    return dim.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))


def full_outer_zero(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join in which missing counts are 0."""
    return a.join(b, list(on), "full_outer").fillna(0)


def funnel(events: DataFrame, by: Sequence[str], unit: str, stages: dict[str, Column]) -> DataFrame:
    """Units that reach each stage, by group. One row a (group, unit) with flags, then sums: each row is
    shuffled once, where one distinct count a stage would multiply them. A null unit counts nowhere."""
    flags = events.groupBy(*by, unit).agg(*[F.max(F.when(c, 1).otherwise(0)).alias(s) for s, c in stages.items()])
    counted = [F.sum(F.when(F.col(unit).isNotNull(), F.col(s)).otherwise(0)).cast("long").alias(s) for s in stages]
    return flags.groupBy(*by).agg(*counted)


def cohorts(events: DataFrame, who: str, when: str) -> DataFrame:
    """cohort_month, month_offset, active, cohort_size: the size is the whole cohort's."""
    month = F.trunc(F.col(when), "MM")
    active = events.select(F.col(who).alias("who"), month.alias("m")).distinct()
    first = active.groupBy("who").agg(F.min("m").alias("cohort_month"))
    offset = F.months_between("m", "cohort_month").cast("int")
    cells = active.join(first, "who").groupBy("cohort_month", offset.alias("month_offset")).agg(F.count("*").alias("active"))
    sizes = first.groupBy("cohort_month").agg(F.count("*").alias("cohort_size"))
    return cells.join(sizes, "cohort_month")


def two_level_average(lines: DataFrame, order: str, by: str, measure: Column) -> DataFrame:
    """Average of per-order sums, by group."""
    orders = lines.groupBy(order, by).agg(F.sum(measure).alias("total"))
    return orders.groupBy(by).agg(F.count("*").alias("n_orders"), F.avg("total").alias("avg_total"))


def top_k(df: DataFrame, measure: str, tie: str, k: int) -> DataFrame:
    """The k largest by measure, ties by a key: a partial top k in every partition, then one merge."""
    return df.orderBy(F.col(measure).desc(), F.col(tie).asc()).limit(k)


def trailing_ratio(daily: DataFrame, day: str, value: str, rows: int = 7) -> DataFrame:
    """value against the mean of the rows before it, itself not included. The window has no partition:
    the input has to be pre-aggregated to a row a day."""
    w = Window.orderBy(day).rowsBetween(-rows, -1)
    return daily.withColumn("trailing_mean", F.avg(value).over(w)).withColumn("ratio", F.col(value) / F.nullif(F.col("trailing_mean"), F.lit(0)))


def salted_join(facts: DataFrame, dim: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """An equi join for keys so hot that one holds a large share: facts are dealt by key and salt, and the
    dimension is repeated for each salt. For joins Spark can't split itself (a full outer, or before a
    window)."""
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int"))
    right = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that are in one multiset only, with the side they are on."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def calendar(spark, first: str, last: str) -> DataFrame:
    """A row a day with the usual attributes; Monday is day 1."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))).alias("date_day"))
    weekday = F.weekday("date_day") + 1
    return days.select(
        "date_day", F.year("date_day").alias("year"), F.quarter("date_day").alias("quarter"), F.month("date_day").alias("month"),
        F.date_format("date_day", "yyyy-MM").alias("year_month"), F.dayofmonth("date_day").alias("day"), weekday.alias("weekday"),
        (weekday >= 6).alias("is_weekend"), F.weekofyear("date_day").alias("iso_week"),
    )
