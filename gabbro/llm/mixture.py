"""Mixing sources to target weights by cube-method balanced sampling.

A source's target gives each of its documents the rate target / source size, between 0 and 2. The
whole part of the rate is taken of every document; the fraction is an inclusion probability for one
more copy. The flight phase moves a vector of such probabilities inside the cube [0, 1]^N through the
null space of the balancing constraints (documents and words): p + 1 undecided documents at a time are
moved along a null vector until one of them is decided, so sums of words and of documents stay as they
are. At most p documents, and a dozen kept out of the flight, stay undecided in a cell; those of all cells
fly again together, level by level, until a source has one last cell, whose landing picks the best of
all outcomes of the dozen or so that are left.

Cells hold a bounded number of documents by hash of id and text, so a source with a third of all rows
flies in many tasks at once, whether its rows have ids of their own or not. Random numbers come from a
seed and the cell: reruns agree.

Edge cases: null text = size 0 (such documents are decided like others and take nothing); a null
source is a source of its own, last in order; a source without words has target 0; repeated rows are
documents of their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gabbro.llm.common import flat_utf8, slices, text_columns, word_counts, written
from gabbro.tables import table

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
CELL = 4096
#: Units of a cell that stay out of the flight, so that the landing has outcomes to choose from.
RESERVE = 12
EPS = 1e-9


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves p inside the cube while x.T @ p keeps its value, until at most x.shape[1] entries are
    undecided. x: the balancing variables, a row for each unit."""
    p = p.copy()
    m = x.shape[1]
    wait = np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist()
    held = [wait.pop() for _ in range(min(m + 1, len(wait)))]
    while len(held) > m:
        a = x[held].T  # m x (m + 1)
        if m == 2:
            u = np.array([a[0, 1] * a[1, 2] - a[0, 2] * a[1, 1], a[0, 2] * a[1, 0] - a[0, 0] * a[1, 2], a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]])
            if not np.abs(u).max() > 1e-12 * max(1.0, float(np.abs(a).max()) ** 2):
                u = np.linalg.svd(a)[2][-1]
        else:
            u = np.linalg.svd(a)[2][-1]
        now = p[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - now) / u, np.where(u < 0, -now / u, np.inf)).min()
            down = np.where(u > 0, now / u, np.where(u < 0, (now - 1) / u, np.inf)).min()
        step = up if rng.random() * (up + down) < down else -down
        now = now + step * u
        now[now < EPS] = 0.0
        now[now > 1 - EPS] = 1.0
        p[held] = now
        held = [k for k, v in zip(held, now.tolist()) if 0.0 < v < 1.0]
        while len(held) <= m and wait:
            held.append(wait.pop())
    return p


def land(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides the last few units (RESERVE + the constraints, at most): of all their outcomes the one
    nearest to the balance, the last constraint counting first."""
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    p = p.copy()
    n = len(open_)
    if n:
        outcomes = (np.arange(2**n)[:, None] >> np.arange(n)) & 1
        off = np.abs((outcomes - p[open_]) @ x[open_]) / np.maximum(np.abs(x[open_]).sum(0), 1)
        cost = off @ np.array([0.01] * (x.shape[1] - 1) + [1.0]) + 1e-12 * rng.random(2**n)
        p[open_] = outcomes[int(np.argmin(cost))]
    return np.round(p)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text), mark (a hash of the text: rows that agree in id and
    mark are alike, others are dealt apart)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 8 << 20):
                n = word_counts(*flat_utf8(b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("source"), pa.array(n, pa.int64()), b.column("mark")], names=["doc_id", "source", "size", "mark"])

    text = F.col("text").cast("string")
    typed = docs.select("doc_id", F.col("source").cast("string").alias("source"), text.alias("text"), F.xxhash64(text).alias("mark"))
    return typed.mapInArrow(run, "doc_id long, source string, size long, mark long")


def targets(by_source: DataFrame) -> DataFrame:
    """(source, source_size, n) with the target of each. Rows are as many as sources. Water filling in
    SQL: sources fill up in the order of size / weight; a source is capped exactly if its own level
    is at most what the rest could share, so a running sum finds the level without iteration."""
    one = Window.partitionBy(F.lit(1))
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("at"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    # by code point = by bytes of UTF-8, which is Spark's order of strings
    ranked = by_source.withColumn("at", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", w)
    ranked = ranked.withColumn("cap", F.col("source_size") * MOST).withColumn("ratio", F.col("cap") / F.col("w"))
    order = one.orderBy("ratio", "at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("goal", F.sum("source_size").over(one) * SHARE)
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(one) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.when(F.col("w_left") > 0, (F.col("goal") - F.col("cap_before")) / F.col("w_left")))
        # the first source in this order whose cap lies above the level: from there on all share it
        .withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "at", "level"))).over(one)["level"])
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return ranked.select("source", "source_size", "n", target.alias("target"))


def choose(units: DataFrame, seed: int = 1, cell: int = CELL) -> DataFrame:
    """units (doc_id, mark, stratum, n, size, p, copies), n being the stratum's documents, with p decided to
    0 or 1. n documents leave RESERVE + 2 a cell undecided, so three levels of cells end with one cell
    a stratum, of about (14 / 4096)^2 n units, which lands."""
    schema = "doc_id long, mark long, stratum int, n long, size long, p double, copies int"

    def fly(last: bool, level: int):
        def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            # rows that agree in doc_id and mark are alike, so this order makes reruns agree
            t = t.sort_by([("doc_id", "ascending"), ("mark", "ascending"), ("p", "ascending")])
            rng = np.random.default_rng([seed, level, zlib.crc32(repr([k.as_py() for k in key]).encode())])
            t = t.take(rng.permutation(t.num_rows))
            p = t["p"].to_numpy().copy()
            x = np.stack([np.ones(len(p)), t["size"].to_numpy().astype(np.float64)], 1)
            p[RESERVE:] = flight(p[RESERVE:], x[RESERVE:], rng)
            if last:
                p = land(p, x, rng)
            return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p)).select(schema_names)

        return run

    schema_names = [x.split()[0] for x in schema.split(", ")]
    decided, now, cells = [], units, F.greatest(F.lit(1), F.ceil(F.col("n") / cell))
    for level in range(3):
        last = level == 2
        at = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("doc_id", "mark", F.lit(level)), cells)
        flown = now.select(*schema_names, at.alias("cell")).groupBy("stratum", "cell").applyInArrow(fly(last, level), schema)
        flown = written(flown, f"cube-{level}")
        if last:
            decided.append(flown)
            break
        open_ = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        decided.append(flown.filter(~open_))
        now, cells = flown.filter(open_), F.ceil((RESERVE + 2) * cells / cell)
    return decided[0].unionByName(decided[1]).unionByName(decided[2])


def mix(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0, 1 or 2 whole copies), taken, mark."""
    sized = written(sizes(docs), "mix-sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    first = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    goal = written(targets(by_source).withColumn("stratum", F.row_number().over(first)), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # a row for each source: its file is small enough for a broadcast, or else skewed sources are split
    joined = sized.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    joined = joined.withColumn("rate", F.least(F.lit(MOST), F.round(rate, 12))).withColumn("copies", F.floor("rate").cast("int"))
    units = joined.select("doc_id", "mark", "stratum", "n", "size", (F.col("rate") - F.col("copies")).alias("p"), "copies")
    picked = choose(units, seed).select("doc_id", "mark", "stratum", "size", (F.col("copies") + F.round("p").cast("int")).alias("copies"))
    return picked.join(goal.drop("n"), "stratum").select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "mark")


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The documents as the mix takes them, all columns kept: a document taken twice is two rows, one
    taken not at all is gone. Rows that agree in id, source and text share their copies: each gets the
    rounded mean."""
    keys = ["mix_id", "mix_mark", "mix_source"]
    copies = mix(docs, seed).groupBy(F.col("doc_id").alias("mix_id"), F.col("mark").alias("mix_mark"), F.col("source").alias("mix_source")).agg(F.round(F.avg("copies")).cast("int").alias("mix_copies"))
    own = (F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")), F.col("source").cast("string"))
    same = F.lit(True)
    for c, k in zip(own, keys):
        same = same & c.eqNullSafe(F.col(k))
    out = docs.join(copies, same).select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(0), F.col("mix_copies"))).alias("mix_copy"))
    return out.filter("mix_copy > 0").drop("mix_copy")


def op6_cube_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(text_columns(table(spark, sf_dir, "documents"), "doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")
    )


QUERIES = {"op6_cube_mixture": op6_cube_mixture}
