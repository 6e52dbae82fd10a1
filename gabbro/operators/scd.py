"""History of slowly changing rows (type 2) from a journal of row versions.

A journal holds versions (key, updated_at, tracked columns); a history holds [valid_from, valid_to) and
is_current. Both directions give the same rows: a full rebuild, and applying the pending part of the
journal to an existing history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gabbro.functions.clean import row_hash
from gabbro.operators.relational import as_of_join


def rebuild(journal: DataFrame, key: str, at: str, tracked: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """The history of the whole journal. Of versions with the same time the one last in a total order
    counts; versions that change nothing tracked are collapsed into the one before."""
    every = [key, at, *tracked, *carried]
    w = Window.partitionBy(key).orderBy(at)
    one = journal.select(*every).withColumn("_rn", F.row_number().over(Window.partitionBy(key, at).orderBy(*[F.col(c).desc() for c in every]))).filter("_rn = 1").drop("_rn")
    new = one.withColumn("_hash", row_hash(*tracked)).withColumn("_was", F.lag("_hash").over(w)).filter("_was is null or _was <> _hash")
    return new.select(key, *tracked, *carried, F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to"), F.lead(at).over(w).isNull().alias("is_current"), F.col("_hash").alias("row_hash"))


def pending(journal: DataFrame, history: DataFrame, key: str, at: str) -> DataFrame:
    """Versions later than the current one of their key, all of them, or of keys without history."""
    current = history.filter("is_current").select(F.col(key).alias("_k"), F.col("valid_from").alias("_from"))
    return journal.join(current, F.col(key) == F.col("_k"), "left").filter(F.col("_from").isNull() | (F.col(at) > F.col("_from"))).drop("_k", "_from")


def apply(history: DataFrame, journal: DataFrame, key: str, at: str, tracked: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """The history after the journal's pending versions: closed versions stay untouched, the current one
    of each key that has news is chained with them. Late versions are ignored."""
    news = pending(journal, history, key, at)
    keys = news.select(F.col(key).alias("_k")).distinct()
    touched = history.filter("is_current").join(keys, F.col(key) == F.col("_k"), "left_semi")
    again = touched.select(key, F.col("valid_from").alias(at), *tracked, *carried).unionByName(news.select(key, at, *tracked, *carried))
    rest = history.filter("not is_current").unionByName(history.filter("is_current").join(keys, F.col(key) == F.col("_k"), "left_anti"))
    return rest.unionByName(rebuild(again, key, at, tracked, carried))


def islands(history: DataFrame, late: DataFrame, key: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(touched, bounds) of versions that arrive after later ones: touched has (key, valid_from) of the versions
    next to a late row, the one in force at its time and the one after it; bounds has a row for each run of
    neighbours: key, _island, _lo and _hi (times, _hi null where no version follows), _end (valid_to of its last version). Only the history of keys
    with late rows is sorted."""
    news = late.select(F.col(key).alias("_key"), F.col(at).alias("_at")).distinct()
    # a mark before and one behind: a version of the same time may go, and then both of its neighbours count
    marks = news.withColumn("_late", F.explode(F.array(F.lit(-1), F.lit(1))))
    mine = history.join(news.select("_key").distinct(), F.col(key) == F.col("_key"), "left_semi")
    rows = mine.select(F.col(key).alias("_key"), F.col("valid_from").alias("_at"), F.lit(0).alias("_late"), F.col("valid_to").alias("_to")).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("_key").orderBy("_at", "_late")
    near = (F.col("_late") != 0) | (F.coalesce(F.lag("_late").over(w), F.lit(0)) != 0) | (F.coalesce(F.lead("_late").over(w), F.lit(0)) != 0)
    run = rows.withColumn("_near", near).withColumn("_island", F.sum(F.when(F.col("_near"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_near")
    # behind a late row that no version follows all of the journal counts: it may part the current version, too
    last = lambda c: F.max_by(c, F.struct("_at", "_late"))
    bounds = run.groupBy("_key", "_island").agg(F.min("_at").alias("_lo"), last(F.when(F.col("_late") == 0, F.col("_at"))).alias("_hi"), last("_to").alias("_end"))
    return run.filter("_late = 0").select("_key", F.col("_at").alias("_from")), bounds


def repair(history: DataFrame, journal: DataFrame, late: DataFrame, key: str, at: str, tracked: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """The history of the whole journal, from a history made without its rows `late` (they are in journal, too):
    only the intervals next to a late row are made again, from the journal's rows between their bounds, as
    a late row can part versions that were collapsed. All other versions are taken as they are. The same as
    `rebuild(journal)`; keys must not be null."""
    touched, bounds = islands(history, late, key, at)
    # islands of a key don't overlap, so a row's island is the last one that starts before it: sorted, not paired
    starts = bounds.select(F.col("_key").alias(key), F.col("_lo").alias("valid_from"), F.lit(None).cast(journal.schema[at].dataType).alias("valid_to"), "_island", "_hi", "_end")
    mine = journal.select(key, at, *tracked, *carried).join(bounds.select("_key").distinct(), F.col(key) == F.col("_key"), "left_semi")
    pieces = as_of_join(mine, starts, key, at, "inner").filter(F.col("_hi").isNull() | (F.col(at) <= F.col("_hi")))
    pieces = pieces.select(F.struct(F.col(key).alias("_key"), "_island", "_end").alias("_piece"), at, *tracked, *carried)
    again = rebuild(pieces, "_piece", at, tracked, carried).withColumn(key, F.col("_piece._key")).withColumn("valid_to", F.coalesce("valid_to", F.col("_piece._end")))
    again = again.withColumn("is_current", F.col("valid_to").isNull()).select(*history.columns)
    rest = history.join(touched, (F.col(key) == F.col("_key")) & (F.col("valid_from") == F.col("_from")), "left_anti")
    return rest.unionByName(again)


def auto_cdc(feed: DataFrame, keys: Sequence[str], sequence_by: str, kind: int = 1, delete_when: str | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Type 1: the last state of each key, without those deleted last. Type 2: intervals of each state;
    a delete closes one and opens none."""
    data = [c for c in feed.columns if c not in {*keys, sequence_by, *drop}]
    gone = F.expr(delete_when) if delete_when else F.lit(False)
    w = Window.partitionBy(*keys)
    order = [F.col(sequence_by), *[F.col(c) for c in data]]
    marked = feed.withColumn("_gone", F.coalesce(gone, F.lit(False)))
    if kind == 1:
        last = marked.withColumn("_rn", F.row_number().over(w.orderBy(*[c.desc() for c in order])))
        return last.filter("_rn = 1 and not _gone").select(*keys, *data)
    chained = marked.withColumn("_hash", row_hash("_gone", *data)).withColumn("_was", F.lag("_hash").over(w.orderBy(*order))).filter("_was is null or _was <> _hash")
    closed = chained.withColumn("valid_to", F.lead(sequence_by).over(w.orderBy(*order)))
    return closed.filter("not _gone").select(*keys, *data, F.col(sequence_by).alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("is_current"))


def change_log(history: DataFrame, key: str) -> DataFrame:
    """A row for each version of a history: whether it opened its key or changed it, and when."""
    first = F.min("valid_from").over(Window.partitionBy(key))
    return history.select(key, F.when(F.col("valid_from") == first, "opened").otherwise("changed").alias("change"), F.col("valid_from").alias("changed_at"))


def integrity(history: DataFrame, key: str, state: str | None = None) -> DataFrame:
    """(check, violations) of a history: one aggregate over one window, no action for each check. With a
    digest of the state also neighbours that are equal, which a rebuild would have collapsed."""
    w = Window.partitionBy(key).orderBy("valid_from", F.col("valid_to").asc_nulls_last())
    seen = history.withColumn("_next", F.lead("valid_from").over(w)).withColumn("_same", (F.lead(state).over(w) == F.col(state)) if state else F.lit(False)).withColumn("_n", F.sum(F.col("is_current").cast("int")).over(Window.partitionBy(key)))
    bad = {
        "several_current": F.col("is_current") & (F.col("_n") > 1),
        "no_current": F.col("_next").isNull() & (F.col("_n") == 0),
        "gap_or_overlap": F.col("_next").isNotNull() & ~F.col("valid_to").eqNullSafe(F.col("_next")),
        "empty_interval": F.col("valid_to") <= F.col("valid_from"),
        "current_is_closed": F.col("is_current") != F.col("valid_to").isNull(),
    } | ({"equal_neighbours": F.coalesce(F.col("_same"), F.lit(False))} if state else {})
    sums = seen.agg(*[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n) for n, c in bad.items()])
    return sums.unpivot([], list(bad), "check", "violations").withColumn("violations", F.coalesce("violations", F.lit(0).cast("long")))
