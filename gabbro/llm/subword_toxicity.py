"""Toxicity: subword-bag embeddings, averaged, under a linear softmax.

A word is a bag of subwords: itself and its character n-grams, hashed into buckets. The vector of a word is
the mean of its subwords' embeddings, that of a text the mean of its words'; a linear layer and a softmax give
the classes. Embeddings and layer are trained jointly in numpy. A misspelling that no text had still shares
n-grams with the word that is meant, and with them its vector.

Training is on the whole sample at once. A text's logits are X S E W for the counts X (texts x words), the bags
S (words x subwords), the embeddings E and the layer W. With G the softmax's error, B = S'X'G has a row for
each subword, and the gradients are B W' for E and E' B for W: both need two sparse products only, whatever the
width of the embeddings. After each step all embeddings are shortened by a fixed length (group lasso), so
subwords that tell nothing end at zero and don't disturb short texts of words never seen.

Scoring needs a number a word: its bag's mean of E (W1 - W0). Words are looked up in a table of those met
already, which each worker keeps and empties at MEMORY bytes; a new word is hashed.

Fitting takes a bounded sample of labelled rows (`max_labelled`, by hash of doc_id, so reruns agree); everything
else covers all documents. Labels come only from rows with crc32(doc_id) mod 4 <> 2.

Edge cases: null text = empty; a text without words has the score of the layer's bias alone; a word of
punctuation only has no subwords and counts with a vector of zeros; words are taken whole, however long, for
their n-grams; a document without label is scored; a label without document or with null toxic is ignored; of
labels that contradict each other the mean is learned; of rows that share a labelled id one is learned from;
fewer than LEAST labelled rows, or one class only, train nothing and give the share of ones (0.5 without any) as
every score; a null doc_id is not held out; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gabbro.llm.common import mix64, slices, text_columns
from gabbro.llm.quality_gbdt import held_out
from gabbro.tables import table

LEAST = 20  # labelled rows, to train
#: Bytes of words whose numbers a worker keeps.
MEMORY = 64 << 20
#: Characters of new words that are hashed at once.
HASHED = 1 << 18


@dataclass(frozen=True)
class Settings:
    max_labelled: int = 8_000
    buckets: int = 1 << 18
    shortest: int = 3
    longest: int = 5
    least_docs: int = 3
    width: int = 8
    steps: int = 100
    rate: float = 0.6
    decay: float = 1e-7
    shrink: float = 0.25  # what each step takes from the length of a subword's embedding: few keep one
    floor: float = 0.015  # of the largest usual gradient: rarer ones are not scaled up to it
    seed: int = 11


def words_of(text: str | None) -> list[str]:
    """Lower-case words between white space."""
    return (text or "").lower().split()


BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))  # BASE times BACK is 1 in 64 bits


def bags(words: Sequence[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of its word) of all subwords: each word without the punctuation at its ends and its
    n-grams, between marks of its ends. One polynomial over the characters of all words gives the hash of
    any run of them as a difference of two of its sums."""
    marked = [f"<{c}>" if c else "" for c in (w.strip(string.punctuation) for w in words)]
    size = np.array([len(m) for m in marked], np.int64)
    n = int(size.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    of, first = np.repeat(np.arange(len(marked)), size), np.cumsum(size) - size
    left = (first + size)[of] - np.arange(n)  # characters of the word from here on
    power, back = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x)])) for x in (BASE, BACK))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(chars * power[:-1])])
    whole = np.flatnonzero(size)
    starts = [first[whole]] + [np.flatnonzero(left >= k) for k in range(s.shortest, s.longest + 1)]
    ends = [(first + size)[whole]] + [i + k for i, k in zip(starts[1:], range(s.shortest, s.longest + 1))]
    kinds = [0, *range(s.shortest, s.longest + 1)]
    hashes = [mix64((sums[j] - sums[i]) * back[i] + np.uint64(k)) % np.uint64(s.buckets) for i, j, k in zip(starts, ends, kinds)]
    return np.concatenate(hashes).astype(np.int64), np.concatenate([of[i] for i in starts])


def subwords(word: str, s: Settings) -> list[int]:
    """Buckets of one word's subwords."""
    return bags([word], s)[0].tolist()


@dataclass
class Model:
    """weight: what a bucket adds to the logit of class 1 against class 0; bias: the logit without words."""

    weight: np.ndarray
    bias: float
    settings: Settings

    def of_words(self, words: Sequence[str]) -> np.ndarray:
        bucket, of = bags(words, self.settings)
        return np.bincount(of, self.weight[bucket], len(words)) / np.maximum(np.bincount(of, minlength=len(words)), 1)

    def of_word(self, word: str) -> float:
        return float(self.of_words([word])[0])


class Scorer:
    """Scores texts; the numbers of words met before are kept up to MEMORY bytes of words."""

    def __init__(self, model: Model):
        self.model, self.known, self.held = model, {}, 0

    def learn(self, new: list[str]) -> None:
        """Looks up new words, some HASHED characters at once."""
        at = size = 0
        for i, w in enumerate(new):
            size += len(w) + 2
            if size > HASHED or i == len(new) - 1:
                self.known.update(zip(new[at : i + 1], self.model.of_words(new[at : i + 1]).tolist()))
                at, size = i + 1, 0
        self.held += sum(map(len, new)) + 200 * len(new)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.model.bias)
        if not len(self.model.weight):
            return out
        split = [words_of(t) for t in texts]
        self.learn(sorted(set().union(*split) - self.known.keys()))
        number = self.known.__getitem__
        for i, words in enumerate(split):
            if words:
                out[i] += sum(map(number, words)) / len(words)
        if self.held > MEMORY:
            self.known, self.held = {}, 0
        return out

    def logit(self, text: str | None) -> float:
        return float(self.logits([text])[0])


def fit(doc: np.ndarray, word: np.ndarray, count: np.ndarray, vocabulary: pa.Array, y: np.ndarray, s: Settings = Settings()) -> Model:
    """doc, word, count: entries of X; y: the share of class 1 of each text. Adam on the exact gradients.
    Words of fewer than `least_docs` texts have no bag here, or they would tell texts apart by heart; they
    stay in the count of words. A softmax's errors of two classes are opposite, so the products are made
    with those of class 1 only."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(y) < LEAST or y.min() == y.max():
        return Model(np.zeros(0), base, s)
    x = count / np.maximum(np.bincount(doc, count, len(y)), 1)[doc]
    often = np.bincount(word, minlength=len(vocabulary)) >= s.least_docs  # (a text has one entry a word)
    kept = often[word]
    doc, word, x = doc[kept], (np.cumsum(often) - 1)[word[kept]], x[kept]
    words = vocabulary.filter(pa.array(often)).to_pylist()
    sub, of = bags(words, s)
    sizes = np.bincount(of, minlength=len(words))
    used, sub = np.unique(sub, return_inverse=True)  # only buckets that occur have a gradient
    in_bag = 1 / np.maximum(sizes, 1)[of]
    rng = np.random.default_rng(s.seed)
    params = [rng.normal(0, 0.1, (len(used), s.width)), rng.normal(0, 0.1, (s.width, 2)), np.array([0.0, base])]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    sign = np.array([-1.0, 1.0])
    for t in range(1, s.steps + 1):
        e, w, b = params
        z = e @ (w @ sign)
        u = np.bincount(of, z[sub] * in_bag, len(words))
        logit = np.bincount(doc, u[word] * x, len(y)) + b @ sign
        g = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y) / len(y)
        back = np.bincount(word, g[doc] * x, len(words))
        back = np.bincount(sub, back[of] * in_bag, len(used))
        grads = np.outer(back, w @ sign) + s.decay * e, np.outer(e.T @ back, sign) + s.decay * w, g.sum() * sign
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.99 * v[i] + 0.01 * grad**2
            usual = np.sqrt(v[i] / (1 - 0.99**t))
            params[i] = params[i] - s.rate * (m[i] / (1 - 0.9**t)) / (usual + s.floor * usual.max() + 1e-15)
        params[0] *= np.maximum(0, 1 - s.shrink / np.maximum(np.linalg.norm(params[0], axis=1, keepdims=True), 1e-9))
    weight = np.zeros(s.buckets)
    weight[used] = params[0] @ (params[1] @ sign)
    return Model(weight, float(params[2] @ sign), s)


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Fits on at most max_labelled labelled rows that are not held out; their words are counted where they are."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("toxic").cast("double")).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_labelled)
    # at most max_labelled rows of two numbers: a proven bound for the broadcast
    rows = text_columns(docs, "doc_id", "text").join(F.broadcast(known), "doc_id")
    # of rows that share a labelled id one counts, the same in every run: so max_labelled bounds what is collected
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text").isNull())).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 8 << 20):
                bags = [Counter(words_of(t)) for t in b.column("text").to_pylist()]
                cols = [b.column("doc_id").cast(pa.int64()), b.column("y"), pa.array([list(c) for c in bags], pa.list_(pa.string())), pa.array([list(c.values()) for c in bags], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "y", "words", "counts"])

    got = rows.mapInArrow(run, "doc_id long, y double, words array<string>, counts array<long>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()
    y = got["y"].to_numpy()
    if not len(y):
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), pa.array([], pa.string()), y, s)
    lists = got["words"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    counts = got["counts"].combine_chunks().flatten().to_numpy().astype(np.float64)
    return fit(doc, coded.indices.to_numpy().astype(np.int64), counts, coded.dictionary, y, s)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (of class 1) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets numbers: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                logits = scorer.logits(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(logits, -500, 500))))], names=["doc_id", "score"])

    return text_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op11_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op11_subword_toxicity": op11_subword_toxicity}
