"""Filter interaction audit: what each of five filters removes in each of their 120 orders.

A document's failures are a mask of five bits, and all that is asked about any order follows from how many
documents of a part have each mask: 32 cells of counts. The orders are visited by adjacent transpositions,
each of which swaps two neighbours of the order before; the prefixes before and behind the two stay, so only
these two steps are counted anew from the cells, and a filter's sum over all orders (its Shapley value times
120) accumulates along the walk. The walk runs once for a block of parts, as arrays over the parts.

Filters: A under 50 words; B fewer than 65 % distinct words; C more than 5 % of A-Z; D holds any of #$%&*|;
E has the text of a document with a smaller id.

Scale. Bits A to D are columns made where the text is read; a row of id, digest of the text, part and bits
is written, and the text is read no more. Copies are counted before they meet: rows of one digest and part
become one count in each task, so a text in a third of all rows is a few rows by the time its smallest id
is looked up. Equal SHA-256 counts as equal text.

Edge cases: null text is the empty text; an empty text fails A, and is a copy of any other empty text;
null source is part ''; a null id is no smaller id, and such a row never fails E; of rows that share a text
and the smallest id none fails E; labels without document or with nulls count for nothing, of several labels
of an id each counts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gabbro.llm.common import text_columns, written
from gabbro.tables import table

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
SPACE = r"[\x20\x09-\x0D]+"
#: Parts whose orders are walked at once: 600 rows each.
BLOCK = 64


def failures(text: F.Column) -> F.Column:
    """Bits of the filters that look at the text alone (A is bit 0). The words are bound by a lambda, so
    they are made once a row."""
    upper = F.length(text) - F.length(F.translate(text, string.ascii_uppercase, ""))
    def of_words(w: F.Column) -> F.Column:
        n, distinct = F.size(w), F.size(F.array_distinct(w))
        return F.when(n < 50, 1).otherwise(0) + F.when(100 * distinct < 65 * n, 2).otherwise(0)

    words = F.filter(F.split(text, SPACE), lambda x: x != "")
    own = F.when(100 * upper.cast("long") > 5 * F.length(text).cast("long"), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    return F.get(F.transform(F.array(words), of_words), F.lit(0)) + own


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: counts of documents by part and mask, for masks that occur."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = text_columns(docs, "doc_id", "text", "source").select("doc_id", F.sha2(text, 256).alias("digest"), F.coalesce("source", F.lit("")).alias("part"), failures(text).alias("bits"))
    rows = written(rows, "filters-rows")
    yes = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(yes("quality"), yes("toxic"))
    named = rows.filter(F.col("doc_id").isNotNull()).join(known, "doc_id", "left").fillna(0, ["quality", "toxic"])
    cell = ["digest", "part", "bits", "quality", "toxic"]
    # of the join's partitions by id: rows that share an id are one count; then copies are, in each task first
    by_id = named.groupBy("doc_id", *cell).agg(F.count("*").alias("c"))
    copies = by_id.groupBy(*cell).agg(F.sum("c").alias("n"), F.min(F.struct("doc_id", "c")).alias("first"))
    copies = copies.select(*cell, "n", F.col("first.doc_id").alias("least"), F.col("first.c").alias("at_least"))
    # a digest of one cell knows its smallest id already; only those of several cells are looked up
    shared = copies.groupBy("digest").agg(F.min("least").alias("smallest"), F.count("*").alias("cells")).filter("cells > 1").drop("cells")
    passed = F.when(F.col("smallest").isNull() | (F.col("least") == F.col("smallest")), F.col("at_least")).otherwise(0)
    split = copies.join(shared, "digest", "left").withColumn("passed", passed)
    parts = split.select("part", "quality", "toxic", F.inline(F.array(F.struct("bits", F.col("passed").alias("n")), F.struct((F.col("bits") + 16).alias("bits"), (F.col("n") - F.col("passed")).alias("n")))))
    nameless = rows.filter(F.col("doc_id").isNull()).select("part", F.lit(0).alias("quality"), F.lit(0).alias("toxic"), "bits", F.lit(1).cast("long").alias("n"))
    both = parts.unionByName(nameless)
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")]
    return both.groupBy("part", F.col("bits").alias("mask")).agg(*sums)


def transpositions(n: int) -> Iterator[int]:
    """Left places of the swaps that lead through all orders of n things, each order once: every item has a
    direction, and the greatest item with a smaller one before it in its direction moves; greater ones turn."""
    order, way = list(range(n)), [-1] * n
    while True:
        movable = [i for i in range(n) if 0 <= i + way[order[i]] < n and order[i + way[order[i]]] < order[i]]
        if not movable:
            return
        i = max(movable, key=lambda k: order[k])
        moved = order[i]
        j = i + way[moved]
        order[i], order[j] = order[j], order[i]
        for k in range(moved + 1, n):
            way[k] = -way[k]
        yield min(i, j)


def walk(cells: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Orders in the walk's order, and long values [part, order, step, column] for cells [part, mask, (n, good,
    toxic)]; columns: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    k, parts = len(FILTERS), len(cells)
    masks = np.arange(MASKS)
    fails = np.stack([cells[:, masks & (1 << f) > 0, 0].sum(1) for f in range(k)], 1)
    unique = np.stack([cells[:, 1 << f, 0] for f in range(k)], 1)

    def step(before: int, f: int) -> np.ndarray:
        """[part, (kept, removed, redundant, unique_fails, good_lost, toxic_lost)] of filter f behind the set `before`."""
        left = masks & before == 0
        gone = cells[:, left & (masks & (1 << f) > 0)].sum(1)
        kept = cells[:, left & (masks & (1 << f) == 0), 0].sum(1)
        return np.stack([kept, gone[:, 0], fails[:, f] - gone[:, 0], unique[:, f], gone[:, 1], gone[:, 2]], 1)

    order = list(range(k))
    before = lambda i: reduce(lambda s, f: s | 1 << f, order[:i], 0)
    now = np.stack([step(before(i), f) for i, f in enumerate(order)], 1)
    removed = np.stack([now[:, i, 1] for i in range(k)], 1)  # by filter, in the order at hand
    shapley, orders, blocks = removed.copy(), ["".join(FILTERS[f] for f in order)], [now]
    where = [list(order)]
    for i in transpositions(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        now = now.copy()
        for j in (i, i + 1):
            now[:, j] = step(before(j), order[j])
            removed[:, order[j]] = now[:, j, 1]
        shapley += removed
        orders.append("".join(FILTERS[f] for f in order))
        blocks.append(now)
        where.append(list(order))
    every = np.stack(blocks, 1)
    return orders, np.concatenate([every, shapley[:, np.array(where)].reshape(parts, len(orders), k, 1)], 3)


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS)


def interactions(cells: DataFrame) -> DataFrame:
    """A row for each part, order and step from mask_cells: at most 32 cells a part meet in a list."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(FILTERS)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                full = np.zeros((b.num_rows, MASKS, 3), np.int64)
                for i, listed in enumerate(b.column("cells").to_pylist()):
                    for c in listed:
                        full[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                orders, values = walk(full)
                n = b.num_rows * len(orders) * k
                names = b.column("part").take(pa.array(np.repeat(np.arange(b.num_rows), len(orders) * k)))
                which = pa.array(np.array(orders, object)[np.tile(np.repeat(np.arange(len(orders)), k), b.num_rows)], pa.string())
                steps = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n // k))
                yield pa.RecordBatch.from_arrays([names, which, steps, *[pa.array(np.ascontiguousarray(values[..., j]).ravel()) for j in range(len(COLUMNS))]], names=["part", "filter_order", "step", *COLUMNS])

    return parts.mapInArrow(run, SCHEMA)


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(mask_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES = {"op13_filter_interactions": op13_filter_interactions}
ORACLE_SQL = {
    "op13_filter_interactions": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(words) < 50 AS A, 100 * len(list_distinct(words)) < 65 * len(words) AS B,
  100 * (length(t.text) - length(regexp_replace(t.text, '[A-Z]', '', 'g'))) > 5 * length(t.text) AS C, regexp_matches(t.text, '[#$%&*|]') AS D,
  coalesce(t.doc_id > least, false) AS E FROM t JOIN m ON t.text = m.text LEFT JOIN l ON l.doc_id = t.doc_id),
f AS (SELECT part, good, toxic, (CASE WHEN A THEN 'A' ELSE '' END) || (CASE WHEN B THEN 'B' ELSE '' END) || (CASE WHEN C THEN 'C' ELSE '' END)
  || (CASE WHEN D THEN 'D' ELSE '' END) || (CASE WHEN E THEN 'E' ELSE '' END) AS fails, count(*) AS n FROM d GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step:step] AS x, filter_order[1:step - 1] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
j AS (SELECT part, filter_order, step, x, n, good, toxic, fails, contains(fails, x) AS hit, before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone FROM s, f),
r AS (SELECT part, filter_order, step, x, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN gone AND hit THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = x THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN NOT gone AND hit THEN n * good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND hit THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r"""
}
