"""Exact top-k by inner product with M-trees, best first.

Vectors are quantised to integers, so scores are exact. They are dealt to trees: a bounded sample
gives pivots, each vector goes to its nearest one, and a pivot with many vectors (a third of all rows,
say) is cut into several trees of bounded size. A tree is a set of arrays: paged nodes with a routing
vector, a covering radius and the distance to the parent's routing vector, and leaf pages whose
entries keep their distance to the leaf's routing vector. With d the Euclidean distance,
    q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2   and   d(q, x) >= |d(q, c) - d(c, x)|,
so a stored distance bounds a score from above without touching the vector. Nodes are taken from a
queue by their bound; search ends when no bound reaches the k-th score so far.

The stated query set meets the trees in blocks: every block of queries goes to every group of trees.
Each group returns k rows a query, and a window with a partial limit merges them. Scores are integers:
where the largest components allow sums beyond 2^53, they are made in Python's integers instead.

Edge cases: vectors null, or with null or non-finite components, take no part; shorter vectors are
padded with zeros; candidates that carry the query's own vec_id are left out (also repeated rows), and
a repeated query row gives one answer; ties go to the smaller vec_id; fewer candidates than k give all;
an empty table gives an empty table; rows with a null vec_id take no part; a component of 2^42 or more and
a score beyond 64 bits raise an error; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gabbro.llm.common import written
from gabbro.tables import table

LEAF, FANOUT = 256, 16
EXACT = 1 << 53  # integers that float64 holds; sums of products below it are exact in any order


def build(ids: np.ndarray, x: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """An M-tree over rows x (float64 holding integers), bulk loaded top down."""
    order = np.lexsort((ids,))
    ids, x = ids[order], x[order]
    rng = np.random.default_rng(seed)
    nodes, rows = [], []  # node: [routing row, radius, parent distance, first child, children, first entry, entries, max norm]
    norm = np.einsum("ij,ij->i", x, x)

    def far(members: np.ndarray, c: int) -> np.ndarray:
        return np.sqrt(np.maximum(norm[members] + norm[c] - 2 * (x[members] @ x[c]), 0))

    def routing(members: np.ndarray) -> int:
        centre = x[members].mean(0)
        return int(members[np.argmin(norm[members] - 2 * (x[members] @ centre))])

    todo = [(np.arange(len(ids)), -1)]
    while todo:
        nxt = []
        for members, parent in todo:
            c = routing(members)
            d = far(members, c)
            up = 0.0 if parent < 0 else float(far(np.array([c]), nodes[parent][0])[0])
            at = len(nodes)
            nodes.append([c, float(d.max()), up, 0, 0, 0, 0, float(norm[members].max())])
            if parent >= 0:
                if not nodes[parent][4]:
                    nodes[parent][3] = at
                nodes[parent][4] += 1
            parts = []
            if len(members) > LEAF:
                seeds = rng.choice(members, min(FANOUT, len(members)), replace=False)
                near = np.argmin(norm[seeds][None, :] - 2 * (x[members] @ x[seeds].T), 1)
                parts = [members[near == k] for k in range(len(seeds))]
                parts = [p for p in parts if len(p)]
                if max(map(len, parts)) > 0.9 * len(members):  # copies: any cut does
                    parts = np.array_split(members, min(FANOUT, -(-len(members) // LEAF)))
            if parts:
                nxt += [(p, at) for p in parts]
            else:
                nodes[at][5], nodes[at][6] = sum(map(len, rows)), len(members)
                rows.append(members)
        todo = nxt  # level by level: the children of a node follow each other
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    table_ = np.array(nodes, np.float64).reshape(-1, 8)
    dist = np.zeros(len(flat))
    for n in table_[table_[:, 6] > 0]:
        s = slice(int(n[5]), int(n[5] + n[6]))
        dist[s] = far(flat[s], int(n[0]))
    return {"nodes": table_, "routing": x[table_[:, 0].astype(np.int64)], "ids": ids[flat], "x": x[flat], "norm": norm[flat], "dist": dist}


class Forest:
    """Trees of one part, as one set of arrays: each tree is converted once, all are searched as one."""

    def __init__(self, trees: list[dict[str, np.ndarray]]):
        dims = max((t["x"].shape[1] for t in trees), default=0)
        nodes, rows = [t["nodes"].copy() for t in trees], 0
        self.roots, at = [], 0
        for t, n in zip(trees, nodes):
            n[n[:, 4] > 0, 3] += at
            n[n[:, 6] > 0, 5] += rows
            if len(n):
                self.roots.append(at)
            at += len(n)
            rows += len(t["ids"])
        put = lambda name: np.concatenate([padded(t[name], dims) for t in trees]) if trees else np.zeros((0, dims))
        flat = lambda name: np.concatenate([t[name] for t in trees]) if trees else np.zeros(0)
        self.nodes = np.concatenate(nodes) if nodes else np.zeros((0, 8))
        self.whole, self.routing = put("x"), put("routing").astype(np.float64)
        self.x = self.whole.astype(np.float64)
        self.ids, self.norm, self.dist = flat("ids"), flat("norm"), flat("dist")
        self.routing_norm = np.einsum("ij,ij->i", self.routing, self.routing)
        self.longest = max(1, int(np.abs(self.whole).max())) if self.whole.size else 1

    def scores(self, rows: np.ndarray, q: np.ndarray, whole: np.ndarray, exact: bool) -> np.ndarray:
        """Inner products as integers: in floating point where that is exact, else in Python's integers."""
        if exact:
            return (self.x[rows] @ q).astype(np.int64)
        out = [sum(a * b for a, b in zip(x, whole.tolist())) for x in self.whole[rows].tolist()]
        if any(not -(1 << 63) <= s < 1 << 63 for s in out):
            raise OverflowError("a score does not fit 64 bits")
        return np.array(out, np.int64)


def search(forest: Forest | dict, q_id: int, q: np.ndarray, k: int, stats: dict | None = None) -> list[tuple[int, int]]:
    """The k best (score, vec_id) of a forest for a query of integers, by falling score and rising id."""
    if isinstance(forest, dict):
        forest = Forest([forest])
    nodes, routing = forest.nodes, forest.routing
    if not forest.roots:
        return []
    whole = np.asarray(q).astype(np.int64)
    whole = padded(whole, max(len(whole), routing.shape[1]))
    if len(whole) > routing.shape[1]:  # components that no vector has count for the query's length only
        rest, whole = whole[routing.shape[1] :].astype(np.float64), whole[: routing.shape[1]]
    else:
        rest = np.zeros(0)
    q = whole.astype(np.float64)
    exact = len(q) * forest.longest * max(1, int(np.abs(whole).max(initial=0))) < EXACT
    qq = float(q @ q) + float(rest @ rest)
    margin = 1e-6 * (qq + float(nodes[forest.roots, 7].max())) + 0.5  # scores are whole; bounds carry rounding errors
    best: list[tuple[int, int]] = []  # heap of (score, -id), worst first
    seen = 0

    def distance(rows) -> np.ndarray:
        return np.sqrt(np.maximum(qq + forest.routing_norm[rows] - 2 * (routing[rows] @ q), 0))

    def push(rows: np.ndarray, low: float) -> None:
        d = distance(rows)
        n = nodes[rows]
        ub = (qq + n[:, 7] - np.maximum(d - n[:, 1], 0) ** 2) / 2
        for u, c, x in zip(ub.tolist(), rows.tolist(), d.tolist()):
            if u >= low:
                heapq.heappush(queue, (-u, c, x))

    queue: list[tuple[float, int, float]] = []
    push(np.array(forest.roots), -np.inf)
    while queue:
        up, at, d = heapq.heappop(queue)
        low = best[0][0] - margin if len(best) == k else -np.inf
        if -up < low:
            break
        _, _, _, first, kids_, entry, entries, _ = nodes[at].tolist()
        if kids_:
            a, b = int(first), int(first + kids_)
            kids = nodes[a:b]
            # first by the stored parent distance alone: d(q, child) >= |d - parent distance|
            quick = (qq + kids[:, 7] - np.maximum(np.abs(d - kids[:, 2]) - kids[:, 1], 0) ** 2) / 2
            keep = np.flatnonzero(quick >= low) + a
            if len(keep):
                push(keep, low)
            continue
        a, b = int(entry), int(entry + entries)
        keep = a + np.flatnonzero((qq + forest.norm[a:b] - (d - forest.dist[a:b]) ** 2) / 2 >= low)
        seen += len(keep)
        score, ids = forest.scores(keep, q, whole, exact), forest.ids[keep]
        ok = ids != q_id
        if len(best) == k:
            ok &= score >= best[0][0]
        score, ids = score[ok], ids[ok]
        if len(score) > k:
            order = np.lexsort((ids, -score))[:k]
            score, ids = score[order], ids[order]
        for s, i in zip(score.tolist(), ids.tolist()):
            item = (s, -i)
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
    if stats is not None:
        stats["seen"] = stats.get("seen", 0) + seen
        stats["all"] = stats.get("all", 0) + len(forest.ids)
    return [(s, -i) for s, i in sorted(best, reverse=True)]


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(1024 x) of each component; rows that take no part are gone. Components of 2^52 or
    more after that raise an error."""
    whole = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * 1024).cast("long"))
    fine = F.col("embedding").isNotNull() & F.forall(F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    huge = F.exists(F.col("embedding"), lambda x: F.abs(x.cast("double")) >= F.lit(2.0**42))
    v = F.when(huge, F.raise_error(F.lit("a component of an embedding is 2^42 or more")).cast("array<long>")).otherwise(whole)
    return vectors.filter(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrix(col: pa.Array) -> np.ndarray:
    """A list<int64> column as float64 rows, padded with zeros."""
    n = np.asarray(col.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(n), int(n.max()) if len(n) else 0))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def padded(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[-1] == dims else np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, dims - x.shape[-1])])


def to_blob(**arrays: np.ndarray) -> bytes:
    import io

    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def from_blob(raw: bytes) -> dict[str, np.ndarray]:
    import io

    return dict(np.load(io.BytesIO(raw)))


def small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int16) if len(x) == 0 or np.abs(x).max() < 32768 else x.astype(np.int64)


def index(vectors: DataFrame, pivots: int = 64, sample: int = 4096, tree_rows: int = 4096) -> DataFrame:
    """Trees over quantised vectors: (tree, content). Pivots come from a sample of at most `sample`
    rows, taken by hash; every row is indexed."""
    spark = vectors.sparkSession
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()["v"].combine_chunks()
    some = matrix(some)
    rng = np.random.default_rng(11)
    chosen = some[rng.choice(len(some), min(pivots, len(some)), replace=False)] if len(some) else np.zeros((1, 0))
    half = np.einsum("ij,ij->i", chosen, chosen) / 2

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"))
            dims = max(x.shape[1], chosen.shape[1])
            near = np.argmin(half[None, :] - padded(x, dims) @ padded(chosen, dims).T, 1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(near, pa.int32())], names=["vec_id", "v", "pivot"])

    dealt = written(vectors.mapInArrow(assign, "vec_id long, v array<long>, pivot int"), "mtree-dealt")
    # at most `pivots` rows: cut each pivot's vectors into trees of about tree_rows
    counts = {r["pivot"]: r["n"] for r in dealt.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    cuts = F.create_map(*[F.lit(z) for p, n in counts.items() for z in (p, -(-n // tree_rows))]) if counts else F.create_map(F.lit(0), F.lit(1))
    tree = F.concat_ws("-", "pivot", F.pmod(F.xxhash64("vec_id"), cuts[F.col("pivot")]))

    def grow(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x = matrix(t["v"].combine_chunks() if t["v"].num_chunks != 1 else t["v"].chunk(0))
        got = build(t["vec_id"].to_numpy(), x)
        blob = to_blob(nodes=got["nodes"], routing=small(got["routing"]), ids=got["ids"], x=small(got["x"]), norm=got["norm"], dist=got["dist"])
        return pa.table({"tree": [key[0].as_py()], "content": pa.array([blob], pa.binary())})

    trees = dealt.withColumn("tree", tree).groupBy("tree").applyInArrow(grow, "tree string, content binary")
    return written(trees, "mtree-trees")


def query_blocks(queries: DataFrame, rows: int = 256) -> DataFrame:
    """Queries as blocks of at most `rows`: (block, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                blob = to_blob(ids=b.column("vec_id").to_numpy(), x=small(matrix(b.column("v"))))
                yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["queries"])

    return queries.dropDuplicates(["vec_id"]).mapInArrow(run, "queries binary")


def top_k(trees: DataFrame, queries: DataFrame, k: int = 10, groups: int | None = None, trees_a_group: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score. Trees are dealt to groups, at most about trees_a_group each: a task
    holds the trees of its groups one group at a time and answers the blocks of queries as they stream by,
    a query's best of one tree bounding the search in the next. Every block goes to each group once."""
    spark = trees.sparkSession
    if groups is None:
        n = trees.count()
        groups = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // trees_a_group))))
    left = trees.select(F.pmod(F.xxhash64("tree"), F.lit(groups)).cast("int").alias("part"), F.lit(0).alias("turn"), "content")
    right = query_blocks(queries).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(1).alias("turn"), F.col("queries").alias("content"))
    schema = "query_id long, vec_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, forest = None, [], None
        for b in batches:
            for part, turn, raw in zip(b.column("part").to_pylist(), b.column("turn").to_pylist(), b.column("content")):
                if part != now:
                    now, held, forest = part, [], None
                if turn == 0:
                    held.append(from_blob(raw.as_py()))
                    continue
                if forest is None:
                    forest, held = Forest(held), []
                q = from_blob(raw.as_py())
                out = [(i, x, s) for i, v in zip(q["ids"].tolist(), q["x"]) for s, x in search(forest, i, v, k)]
                cols = list(zip(*out)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    dealt = left.unionByName(right).repartition(groups, "part").sortWithinPartitions("part", "turn")
    found = dealt.mapInArrow(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(index(vectors), vectors.filter(F.col("vec_id") % 100 == 0))


QUERIES = {"op9_mtree_topk": op9_mtree_topk}
ORACLE_SQL = {
    "op9_mtree_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
}
