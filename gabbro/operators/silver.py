"""Silver builders: typed order lines with their parents, flattened events, repaired and suspicious rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gabbro.functions import clean
from gabbro.operators import relational as R


def with_parents(lines: DataFrame, parents: dict[str, tuple[DataFrame, str, str, Sequence[str]]]) -> DataFrame:
    """Lines with columns of their parents and a flag for each parent that is missing: no line is lost and
    none is doubled, as a parent counts once. parents: flag -> (parent, line key, parent key, columns)."""
    out = lines
    for flag, (parent, key, parent_key, columns) in parents.items():
        one = parent.dropDuplicates([parent_key]).select(F.col(parent_key).alias(f"_{flag}"), *columns)
        out = out.join(one, F.col(key) == F.col(f"_{flag}"), "left").withColumn(flag, F.col(f"_{flag}").isNull()).drop(f"_{flag}")
    return out


def flat_events(raw: DataFrame, key: str, order: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """One row an event, the first by a total order, with nested fields (name -> path) as columns."""
    once = R.dedup(raw, [key], R.total_order(raw, [*order]))
    return once.select(key, *[F.col(path).alias(name) for name, path in fields.items()])


def malformed(raw: DataFrame, key: str, corrupt: str = "_corrupt_record") -> DataFrame:
    """What can't become an event: lines that don't parse, and parsed ones without a key; why, and the text."""
    why = F.when(F.col(corrupt).isNotNull(), "UNPARSED").when(F.col(key).isNull(), "NO_KEY")
    return raw.withColumn("reason", why).filter("reason is not null").select("reason", F.col(corrupt).alias("raw_text"))


def repaired(rows: DataFrame, repairs: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with a column replaced where repairs (key, repaired) has one."""
    fix = repairs.dropDuplicates(["key"]).select(F.col("key").alias("_k"), F.col("repaired").alias("_r"))
    return rows.join(fix, F.col(key) == F.col("_k"), "left").withColumn(column, F.coalesce("_r", column)).withColumn("was_repaired", F.col("_k").isNotNull()).drop("_k", "_r")


def field_counts(lines: DataFrame, sep: str) -> DataFrame:
    """(n_fields, n_lines): one line of another width shows at once."""
    return lines.groupBy(F.size(F.split("value", sep if sep != "|" else r"\|")).alias("n_fields")).agg(F.count("*").alias("n_lines"))


def truncated(c: Column) -> Column:
    """A complete address has a comma before the town."""
    return F.coalesce(~c.like("%,%"), F.lit(True))


def suspected_scale(lines: DataFrame, catalog: DataFrame, key: str, catalog_key: str, price: str, list_price: str, factor: int = 10) -> DataFrame:
    """Lines flagged where the price looks like cents against the catalogue; unknown products never are."""
    known = catalog.select(F.col(catalog_key).alias("_k"), F.col(list_price).alias("_list"))
    return lines.join(known, F.col(key) == F.col("_k"), "left").withColumn("suspected_unit_scale", clean.plausible_scale(F.col(price), F.col("_list"), factor)).drop("_k")


def impact(lines: DataFrame, flag: str, declared: Column, plausible: Column) -> DataFrame:
    """How much a defect moved: flagged lines, what they declare, what is plausible, the excess."""
    hit = lines.filter(F.col(flag))
    sums = hit.agg(F.count("*").alias("n_lines"), F.sum(declared).cast("decimal(20,2)").alias("declared"), F.sum(plausible).cast("decimal(20,2)").alias("plausible"))
    return sums.withColumn("excess", (F.col("declared") - F.col("plausible")).cast("decimal(20,2)"))


def guarded_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A join that may not change the number of left rows: a right key that occurs twice raises while the
    join runs, so no second pass counts rows."""
    n = F.count("*").over(_by(key))
    once = right.withColumn("_n", n).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{key} occurs more than once: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True))
    return left.join(once.filter("_ok").drop("_n", "_ok"), key, how)


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)
