"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text (shares of characters and words, lengths, repetition) are made in numpy over the
text's bytes. Trees are grown on quantile bins with logistic loss: one histogram of gradients for each
(leaf, feature, bin), the best cut by gain, level by level. The forest is flattened into arrays
(feature, cut, left child, value), and a batch of documents walks all its trees at once by index
arithmetic.

Fitting takes a bounded sample of labelled rows (`max_labelled`, by hash of doc_id, so reruns agree);
everything else covers all documents. Labels come only from rows with crc32(doc_id) mod 4 <> 2.

Edge cases: null text = empty; an empty text has all statistics 0 and is scored like any other; a
document without label is scored, a label without document or with null quality is ignored, and of
labels that contradict each other the mean is learned; of rows that share a labelled id one is learned from; fewer than LEAST labelled rows, or one class only,
fit no tree and give the share of ones (0.5 without any) as every score, and keep_good then rejects
nothing; a null doc_id is not held out; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gabbro.llm.common import SPACE, as_bytes, slices, text_columns
from gabbro.tables import table

CLASSES = {
    "upper": bytes(range(0x41, 0x5B)),
    "lower": bytes(range(0x61, 0x7B)),
    "digit": b"0123456789",
    "stop": b".,;:",
    "shout": b"!?",
    "symbol": b"#*$%&|<>",
    "other": bytes(set(range(0x21, 0x7F)) - set(b".,;:!?#*$%&|<>0123456789") - set(range(0x41, 0x5B)) - set(range(0x61, 0x7B))),
    "high": bytes(range(0x80, 0x100)),
}
NAMES = (
    *(f"share_{c}" for c in CLASSES), "log_bytes", "log_words", "mean_word", "long_words", "distinct_words", "top_word", "words_with_symbol",
    "words_with_digit", "upper_words", "words_a_line", "distinct_lines", "short_lines", "lines_with_stop", "repeated_pairs", "single_char_words", "low_then_up",
)
LEAST = 20  # labelled rows, to fit trees
LUT = np.full(256, len(CLASSES), np.uint8)
for _k, _b in enumerate(CLASSES.values()):
    LUT[list(_b)] = _k


def statistics(raw: bytes) -> np.ndarray:
    """The statistics of a text, in the order of NAMES."""
    out = np.zeros(len(NAMES))
    words = raw.split()
    if not words:
        return out
    a = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(LUT[a], minlength=len(CLASSES) + 1)[: len(CLASSES)]
    ink = max(1, int(kinds.sum()))
    n = len(words)
    inside = ~SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    length = edge[1::2] - edge[::2]
    marks = [np.concatenate([[0], np.cumsum(LUT[a] == k)]) for k in (0, 2, 5)]
    per = [m[edge[1::2]] - m[edge[::2]] for m in marks]
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:]))
    low, up = LUT[a[:-1]] == 1, LUT[a[1:]] == 0
    k = len(CLASSES)
    out[:k] = kinds / ink
    out[k:] = (
        np.log1p(len(raw)), np.log1p(n), ink / n, (length > 20).mean(), len(count) / n, max(count.values()) / n, (per[2] > 0).mean(),
        (per[1] > 0).mean(), ((per[0] > 1) & (per[0] * 2 > length)).mean(), n / len(lines), len(set(lines)) / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines), sum(x.rstrip()[-1:] in b".!?:;" for x in lines) / len(lines),
        1 - len(pairs) / max(1, n - 1), (length == 1).mean(), (low & up).sum() / ink,
    )
    return out


@dataclass(frozen=True)
class Settings:
    max_labelled: int = 20_000
    trees: int = 80
    depth: int = 4
    rate: float = 0.1
    bins: int = 64
    penalty: float = 1.0
    least: float = 4.0  # sum of second derivatives in a leaf


@dataclass
class Forest:
    """Complete trees as arrays [tree, node]: node i has the children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x: all trees of a block of rows walk together."""
        total = np.full(len(x), self.base)
        if len(self.feature) and len(x):
            at = np.zeros((len(x), len(self.feature)), np.int64)
            tree = np.arange(len(self.feature))[None, :]
            row = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.cut[tree, at])
            total = total + self.value[tree, at].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Forest:
    """Gradient boosting with logistic loss on histograms of quantile bins."""
    size = 2 ** (s.depth + 1) - 1
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(y) < LEAST or y.min() == y.max():
        return Forest(base, np.zeros((0, size), np.int64), np.zeros((0, size)), np.zeros((0, size)), s.depth)
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, s.bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b: edges[b-1] < x <= edges[b]
    flat = binned + np.arange(m)[None, :] * s.bins
    logit = np.full(n, base)
    features, cuts, values = [], [], []
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        feature, cut, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
        node = np.zeros(n, np.int64)
        for level in range(s.depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (m * s.bins) + flat).ravel()
            gh = [np.bincount(key, np.repeat(w, m), width * m * s.bins).reshape(width, m, s.bins) for w in (g, h)]
            gl, hl = (z.cumsum(2) for z in gh)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + s.penalty) + (gt - gl) ** 2 / (ht - hl + s.penalty) - gt**2 / (ht + s.penalty)
            gain[(hl < s.least) | (ht - hl < s.least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), s.bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[first + k], cut[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        first = 2**s.depth - 1
        num, den = (np.bincount(node - first, w, 2**s.depth) for w in (g, h))
        value[first:] = -s.rate * num / (den + s.penalty)
        logit += value[node]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Forest(base, np.stack(features), np.stack(cuts), np.stack(values), s.depth)


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Forest:
    """Fits on at most max_labelled labelled rows that are not held out."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_labelled)
    # at most max_labelled rows of two numbers: a proven bound for the broadcast
    rows = text_columns(docs, "doc_id", "text").join(F.broadcast(known), "doc_id")
    # of rows that share a labelled id one counts, the same in every run: so max_labelled bounds what is collected
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text").isNull())).alias("text"))
    got = rows.mapInArrow(_features("y"), "doc_id long, y double, x array<double>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    y = got["y"].to_numpy()
    x = np.array(got["x"].to_pylist()).reshape(len(y), len(NAMES))
    return fit(x, y, s)


def _features(extra: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 8 << 20):
                x = [statistics(t) for t in as_bytes(b.column("text"))]
                cols = [b.column("doc_id").cast(pa.int64())] + ([b.column(extra)] if extra else [])
                names = ["doc_id"] + ([extra] if extra else []) + ["x"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(x, pa.list_(pa.float64()))], names=names)

    return run


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, score for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 8 << 20):
                x = np.array([statistics(t) for t in as_bytes(b.column("text"))]).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(forest.score(x))], names=["doc_id", "score"])

    return text_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, forest: Forest, threshold: float = 0.7) -> DataFrame:
    """The documents, with all their columns, that the classifier does not reject. The mask is made
    batch by batch where the rows are, so nothing is joined and repeated ids are no matter. A forest
    without trees tells no documents apart and rejects none."""
    if not len(forest.feature):
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 8 << 20):
                x = np.array([statistics(t) for t in as_bytes(b.column("text"))]).reshape(-1, len(NAMES))
                yield b.filter(pa.array(forest.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op4_quality_gbdt": op4_quality_gbdt}
