"""N-gram Jaccard join by vertical partitioning.

The global order of all n-grams is that of their 64-bit hashes, and it is cut into fragments. Two sets
with Jaccard similarity s or more differ in at most d = a (1 - s) / s n-grams, a being the smaller size;
cut into more than d fragments, one fragment at least is the same in both. So documents that share a
whole fragment are the candidates, without any bound on frequent n-grams, and nothing is missed. The
overlap of a candidate pair is then counted fragment by fragment, in separate rows, and summed.

Sizes fall into classes that grow by a quarter; a document is cut for its own class and for each one
below down to that of its smallest partner: one at most from 80 % on. A fragment without n-grams says nothing
and is left out, unless a document has so many of them that it could share no other.

Groups are connected, not expanded. Within a task, and then within a bucket, all that share a fragment
are paired with the smallest of them, and of these pairs each document keeps one; identical sets are
linked without being counted, and documents that have too many n-grams that no other candidate has are
put aside before. Links inside a component can't change it, so only fragments whose members still lie in
different components are looked at again, one of those that have the same members.

Fragments of a passage that many texts have make large groups of texts that have nothing else in common.
So the documents of these fragments are grouped anew by rare n-grams: with n-grams ordered by how many of
these documents have them, rarest first, a link shares one of the first n - ceil(s n) + 1 of either set,
and a frequent passage is not among these. Documents that are connected by such n-grams are a family, and
no link leaves a family. Its members are dealt into blocks, and where two blocks meet in a task all their
overlaps are counted at once: pairs of members are numbers in a task, never rows. Each family is sent as
often as it has blocks, which is once for all but the largest. Families of more than MOST blocks are
joined by chains of n-grams that the same members have: sets differ from nothing by a and b n-grams, so
x and y are a link only if they share at least
    k = (a + b - (n_x + n_y) (1 - s) / (1 + s)) / 2
n-grams; of these one at least is among the first a - k + 1 of x and the first b - k + 1 of y. Only pairs
that meet so are counted, by fragments again. The result is that of all pairs. Before the shuffle each
task sends one document a fragment, so a fragment in a third of all documents is a row for each flush of
a task.

Edge cases: null text = empty; an empty set is linked with nothing; a text of fewer than n words is one
n-gram, its whole sequence; rows that share a doc_id are one document, its set being the one with the
smallest digest, but each row keeps its own n_shingles; a null doc_id is never linked and has a null
component; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gabbro.llm.common import as_bytes, buckets_for, discard, mix64, release, slices, tables_made, written
from gabbro.llm.components import components
from gabbro.tables import table

LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
VERTICAL = 4  # fragments in which overlaps are counted
FLUSH = 600_000  # keys a task holds before it sends them
MANY = 16  # members of a chain of runs up to which they meet in pairs without a look at longer chains
BLOCK, MEMBER = 1 << 20, 512  # n-grams of a block of members, a member counting as so many more
PAIRED = 32  # documents with a rare n-gram up to which those of large families are compared in pairs
BINS = 256  # bins of a sketch
WAVE = 4  # blocks that a block is sent to at once
MOST = 64  # blocks of a family up to which all of them meet
HEAVY = 1 << 15  # pairs of members with an n-gram, beyond which it is counted by a product of matrices
BUCKET = 8 << 20  # bytes of input (as stored) whose keys meet in one task


class WordHashes(dict):
    """Word -> 64-bit hash, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes], n: int, words: WordHashes) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    if len(words) > 200_000:
        words.clear()
    get = words.__getitem__
    out = []
    odd = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) & (1 << 64) - 1 | 1) for k in range(n)]
    with np.errstate(over="ignore"):
        for text in texts:
            split = text.translate(LOWER).split()
            h = np.fromiter(map(get, split), np.uint64, len(split))
            if not len(h):
                out.append(h)
                continue
            k = min(n, len(h))  # a short text is one n-gram of its own length
            total = np.full(len(h) - k + 1, k, np.uint64)
            for i in range(k):
                total = mix64(total + h[i : len(h) - k + 1 + i] * odd[i])
            total.sort()
            keep = np.empty(len(total), bool)
            keep[0] = True
            np.not_equal(total[1:], total[:-1], out=keep[1:])
            out.append(total[keep])
    return out


def size_classes(percent: int) -> np.ndarray:
    """Lower ends of the classes of sizes that can have an unlike partner."""
    least = -(-percent // (100 - percent))
    ends = [least]
    while ends[-1] < 1 << 40:
        ends.append(ends[-1] + max(3, ends[-1] // 4))
    return np.array(ends)


def fragment_keys(s: np.ndarray, percent: int, ends: np.ndarray) -> np.ndarray:
    """The keys of a set's fragments, for its class and all down to the one of its smallest partner."""
    size = len(s)
    own = int(np.searchsorted(ends, size, "right")) - 1
    low = int(np.searchsorted(ends, -(-size * percent // 100), "right")) - 1
    keys = []
    with np.errstate(over="ignore"):
        mixed = mix64(s)
        for c in range(max(low, 0), own + 1):
            top = int(ends[c + 1]) - 1
            most = top * (100 - percent) // percent
            cuts = most + 2 + most // 64
            at = ((s >> np.uint64(32)) * np.uint64(cuts) >> np.uint64(32)).astype(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            key = mix64(np.add.reduceat(mixed, begin) + mix64(at[begin].astype(np.uint64) * np.uint64(2048) + np.uint64(c)))
            keys.append(key)
            differ = min(size, top) * (100 - percent) // percent
            if cuts - len(begin) >= cuts - differ:  # perhaps only empty fragments are shared
                none = np.setdiff1d(np.arange(cuts), at[begin]).astype(np.uint64)
                keys.append(mix64(none * np.uint64(2048) + np.uint64(c) + np.uint64(1 << 50)))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def digest(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return d >> 64, d & (1 << 64) - 1


def star(keys: tuple[np.ndarray, ...], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by key, the smallest document of each key first: (order, where a key begins)."""
    order = np.lexsort((docs, *keys))
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    return order, new


OUT = "kind int, key long, a long, b long"
INFO, SAME, MAYBE = 0, 1, 2


def candidates(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """kind INFO: document a has key n-grams; SAME: a and b have equal sets; MAYBE: they share a fragment."""
    buckets = buckets_for(docs, BUCKET)
    schema = "bucket long, key binary, doc binary, sig1 binary, sig2 binary, sig_doc binary, rest binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, words = size_classes(percent), WordHashes()
        seen: dict[tuple[int, int], int] = {}
        key, doc, sig, rest, held, turn = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            k = np.concatenate(key) if key else np.zeros(0, np.uint64)
            d = np.concatenate(doc) if doc else np.zeros(0, np.int64)
            order, new = star((k,), d)
            k, d = k[order], d[order]
            first = d[new][np.cumsum(new) - 1] if len(d) else d
            more = ~new & (first != d)
            pairs = np.stack([np.full(more.sum(), MAYBE), k[more].view(np.int64), first[more], d[more]], 1)
            k, d = k[new], d[new]
            s = np.array(sig, np.uint64).reshape(-1, 3)
            rest_ = np.concatenate([pairs, np.array(rest, np.int64).reshape(-1, 4)])
            # only the buckets that get something
            places = [(k % np.uint64(buckets)).astype(np.int64), (s[:, 0] % np.uint64(buckets)).astype(np.int64), (np.arange(len(rest_)) + turn) % buckets]
            used = np.unique(np.concatenate(places))
            parts = []
            for at in places:
                by = np.argsort(at, kind="stable")
                parts.append(np.split(by, np.searchsorted(at[by], used[1:])))
            rows = [
                (int(b), k[i].tobytes(), d[i].tobytes(), s[j, 0].tobytes(), s[j, 1].tobytes(), s[j, 2].tobytes(), rest_[r].tobytes()) for b, i, j, r in zip(used, *parts)
            ]
            key.clear(), doc.clear(), sig.clear(), rest.clear(), seen.clear()
            kinds = [pa.int64()] + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names=names)

        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                for i, s in zip(b.column("doc_id").to_pylist(), shingle_sets(as_bytes(b.column("text")), n, words)):
                    if i is None:
                        continue
                    rest.append((INFO, len(s), i, 0))
                    held += 4
                    if not len(s):
                        continue
                    d = digest(s)
                    if d in seen:
                        rest.append((SAME, 0, seen[d], i))
                        continue
                    seen[d] = i
                    sig.append((*d, i & (1 << 64) - 1))
                    if len(s) >= ends[0]:
                        k = fragment_keys(s, percent, ends)
                        key.append(k)
                        doc.append(np.full(len(k), i, np.int64))
                        held += len(k)
                if held > FLUSH:
                    yield flush()
                    held, turn = 0, turn + 1
                    release()
        if held:
            yield flush()
        words.clear()
        release()

    def meet(_: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list[np.ndarray]] = {c: [] for c in names[1:]}
        kinds = {"key": np.uint64, "sig1": np.uint64, "sig2": np.uint64}
        for b in batches:
            for c in got:
                got[c] += [np.frombuffer(x, kinds.get(c, np.int64)) for x in b.column(c).to_pylist()]
        v = {c: np.concatenate(x) if x else np.zeros(0, kinds.get(c, np.int64)) for c, x in got.items()}
        out = [v["rest"].reshape(-1, 4)]
        for kind, keys, d in ((SAME, (v["sig2"], v["sig1"]), v["sig_doc"]), (MAYBE, (v["key"],), v["doc"])):
            order, new = star(keys, d)
            if not len(order):
                continue
            d, k = d[order], (keys[0][order].view(np.int64) if kind == MAYBE else np.zeros(len(order), np.int64))
            first = d[new][np.cumsum(new) - 1]
            more = ~new & (first != d)
            out.append(np.stack([np.full(more.sum(), kind), k[more], first[more], d[more]], 1))
        rows = np.concatenate(out)
        del got, v, out
        release()
        for at in range(0, len(rows), 200_000):
            part = rows[at : at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(part[:, k])) for k in (1, 2, 3))], names=["kind", "key", "a", "b"])

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(typed.mapInArrow(send, schema).groupBy("bucket").applyInArrow(meet, OUT), "ngram-candidates")


def set_fragments(docs: DataFrame, n: int, unique: bool) -> DataFrame:
    """(doc_id, frag, n, part): each set in VERTICAL fragments of the global order; unique: no doc_id repeats."""
    schema = "doc_id long, frag int, n long, sig long, part array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                rows = []
                for i, s in zip(b.column("doc_id").to_pylist(), shingle_sets(as_bytes(b.column("text")), n, words)):
                    sig = digest(s)[0] >> 1
                    cut = np.searchsorted(s, [np.uint64(k << 62) for k in range(1, 4)])
                    rows += [(i, k, len(s), sig, part.view(np.int64)) for k, part in enumerate(np.split(s, cut))]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    sets = docs.mapInArrow(run, schema)
    if unique:
        return sets.drop("sig")
    one = sets.groupBy("doc_id", "frag").agg(F.min_by(F.struct("n", "part"), "sig").alias("s"))
    return one.select("doc_id", "frag", "s.n", "s.part")


def sets_of(docs: DataFrame, members: DataFrame, n: int, unique: bool) -> DataFrame:
    """The sets of all documents in members (node), in fragments, written."""
    ids = members.select(F.col("node").alias("doc_id")).distinct()
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(set_fragments(typed.join(ids, "doc_id", "left_semi"), n, unique), "ngram-sets")


def verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that are links: partial overlaps by fragment, summed by pair."""
    left = sets.select(F.col("doc_id").alias("a"), "frag", F.col("n").alias("n_a"), F.col("part").alias("part_a"))
    right = sets.select(F.col("doc_id").alias("b"), "frag", F.col("n").alias("n_b"), F.col("part").alias("part_b"))
    # every pair has its own row for each fragment: a large set's fragments meet in different tasks
    overlap = pairs.select("a", "b").join(left, "a").join(right, ["b", "frag"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).cast("long").alias("shared"))
    total = overlap.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    return total.filter(F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def alone(sets: DataFrame, buckets: int | None = None) -> DataFrame:
    """(doc_id, n, own): how many n-grams of a set no other of these sets has, or a few less: of a hash only 32 bits
    meet in a bucket, and n-grams that agree in these count as shared. If sets have a column key, only n-grams of sets
    with the same key are compared. Of an n-gram that several sets of a batch have two are sent, however many there are."""
    buckets, keyed = buckets or buckets_for(sets, BUCKET), "key" in sets.columns

    def packed(at: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        """A row for each bucket that gets something."""
        order = np.argsort(at, kind="stable")
        used = np.unique(at)
        rows = [(int(k), x[i].tobytes(), y[i].tobytes()) for k, i in zip(used, np.split(order, np.searchsorted(at[order], used[1:])))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "what", "docs"])

    def unpacked(batches: Iterator[pa.RecordBatch], kind: type) -> tuple[np.ndarray, np.ndarray]:
        x, d = [], []
        for b in batches:
            x += [np.frombuffer(v, kind) for v in b.column("what").to_pylist()]
            d += [np.frombuffer(v, np.int64) for v in b.column("docs").to_pylist()]
        return np.concatenate(x), np.concatenate(d)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column("part")
            h = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            lengths = part.value_lengths().to_numpy(zero_copy_only=False)
            d = np.repeat(b.column("doc_id").to_numpy(), lengths)
            if keyed:
                h = mix64(h ^ np.repeat(mix64(b.column("key").to_numpy().view(np.uint64)), lengths))
            order = np.argsort(h, kind="stable")
            new = np.ones(len(h), bool)
            new[1:] = h[order][1:] != h[order][:-1]
            new[1:] |= new[:-1] & ~new[1:]  # the second of each n-gram, too
            kept = np.sort(order[new])  # by document again: runs of equal ids are small in a shuffle
            h, d = h[kept], d[kept]
            yield packed((h % np.uint64(buckets)).astype(np.int64), (h >> np.uint64(32)).astype(np.uint32), d)

    def meet(_: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, d = unpacked(batches, np.uint32)
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        single = new & np.concatenate([new[1:], [True]])
        doc, count = np.unique(d[single], return_counts=True)
        yield packed((mix64(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), count.astype(np.int64), doc)

    def total(_: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, d = unpacked(batches, np.int64)
        doc, at = np.unique(d, return_inverse=True)
        own = np.zeros(len(doc), np.int64)
        np.add.at(own, at, count)
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(own)], names=["doc_id", "own"])

    schema = "bucket long, what binary, docs binary"
    counts = sets.select("doc_id", "part", *["key"] * keyed).mapInArrow(send, schema).groupBy("bucket").applyInArrow(meet, schema)
    own = counts.groupBy("bucket").applyInArrow(total, "doc_id long, own long")
    sizes = sets.filter("frag = 0").select("doc_id", "n", F.lit(0).cast("long").alias("own"))
    return sizes.unionByName(own.select("doc_id", F.lit(None).cast("long").alias("n"), "own")).groupBy("doc_id").agg(F.max("n").alias("n"), F.sum("own").alias("own"))


def once(members: DataFrame, *more: Column) -> DataFrame:
    """The keys of distinct members (key, node) that have several, with the aggregates `more`; of keys that have the
    same members only the smallest: near copies share hundreds of fragments, and one of them says it all."""
    who = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"who_{k}") for k in (1, 2)]
    sums = members.groupBy("key").agg(F.count("*").alias("members"), *who, *more).filter("members > 1")
    return sums.groupBy("members", "who_1", "who_2").agg(F.min_by(F.struct(*[c for c in sums.columns if not c.startswith("who_")]), "key").alias("one")).select("one.*")


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (key, node, ...) with the nodes' labels, of those keys whose members have different ones."""
    m = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = once(m, F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key", "members")
    return written(m.join(mixed, "key"), "ngram-mixed")


def rare_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node): two sets that are a link have a key in common. Keys are n-grams, those that the fewest of these sets
    have first, as many as a partner can't lack all, without those that nobody else has; of a hash 32 bits and its bucket
    count, n-grams that agree in these are one key. Hashes go to a bucket each, and from there back to the documents."""
    buckets = buckets_for(sets, BUCKET)
    schema = "bucket long, source long, what binary, often binary, docs binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def packed(at: np.ndarray, source: int, what: np.ndarray, often: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        """A row for each bucket that gets something."""
        order = np.argsort(at, kind="stable")
        used = np.unique(at)
        rows = [(int(k), source, what[i].tobytes(), often[i].tobytes(), docs[i].tobytes()) for k, i in zip(used, np.split(order, np.searchsorted(at[order], used[1:])))]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], names=names)

    def home(docs: np.ndarray) -> np.ndarray:
        return (mix64(docs.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column("part")
            h = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            d = np.repeat(b.column("doc_id").to_numpy(), part.value_lengths().to_numpy(zero_copy_only=False))
            yield packed((h % np.uint64(buckets)).astype(np.int64), 0, (h >> np.uint64(32)).astype(np.uint32), np.zeros(len(h), np.uint16), d)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.column("doc_id").to_numpy()
            yield packed(home(d), -1, b.column("n").to_numpy().astype(np.uint32), np.zeros(len(d), np.uint16), d)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        """(source, what, often, docs)"""
        got: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.int64, np.uint32, np.uint16, np.int64)]
        for b in batches:
            for source, *x in zip(*(b.column(c).to_pylist() for c in names[1:])):
                what, often, docs = (np.frombuffer(v, t) for v, t in zip(x, (np.uint32, np.uint16, np.int64)))
                for into, v in zip(got, (np.full(len(docs), source), what, often, docs)):
                    into.append(v)
        return tuple(np.concatenate(x) for x in got)

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, h, _, d = unpacked(batches)
        _, at, times = np.unique(h, return_inverse=True, return_counts=True)
        times = np.minimum(times, 65535)[at]
        more = np.flatnonzero(times > 1)
        more = more[np.argsort(d[more], kind="stable")]  # runs of equal ids are small in a shuffle
        out = packed(home(d[more]), key[0].as_py(), h[more], times[more].astype(np.uint16), d[more])
        del h, d, at, times
        release()
        yield out

    def choose(_: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, h, often, d = unpacked(batches)
        size = source < 0
        docs, n = d[size], h[size].astype(np.int64)
        docs, n = docs[np.argsort(docs)], n[np.argsort(docs)]
        source, h, often, d = (x[~size] for x in (source, h, often, d))
        order = np.lexsort((h, source, often, d))
        source, h, d = source[order], h[order], d[order]
        starts, ends = np.searchsorted(d, docs), np.searchsorted(d, docs, "right")
        # n-grams that nobody else has come first
        places = np.maximum(ends - starts - -(-n * percent // 100) + 1, 0)
        at = np.repeat(starts, places) + np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places)
        keys = mix64(source[at].astype(np.uint64) << np.uint64(32) | h[at].astype(np.uint64)).view(np.int64)
        nodes = np.repeat(docs, places)
        del source, h, often, d, order
        release()
        for low in range(0, len(keys), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[low : low + 200_000]), pa.array(nodes[low : low + 200_000])], names=["key", "node"])

    counts = sets.select("doc_id", "part").mapInArrow(send, schema).groupBy("bucket").applyInArrow(count, schema)
    all_ = counts.unionByName(sets.filter("frag = 0").select("doc_id", "n").mapInArrow(sizes, schema))
    return all_.groupBy("bucket").applyInArrow(choose, "key long, node long")


def runs(rows: DataFrame) -> DataFrame:
    """(grp, node, label, n, size, run, weight, at): the n-grams of rows (grp, node, label, n, size, differ) that
    two members of a group share. Those that the same members have are one run, `weight` n-grams long; `at` is
    the place of its first n-gram when a member's runs follow the rarest first."""
    each = rows.select("grp", "node", F.explode("differ").alias("gram"))
    who = [F.bit_xor(F.xxhash64("node", F.lit(k))) for k in (1, 2)]
    common = each.groupBy("grp", "gram").agg(F.count("*").alias("members"), *[x.alias(f"who_{k}") for k, x in enumerate(who)]).filter("members > 1")
    have = each.join(common, ["grp", "gram"]).groupBy("grp", "node", "members", "who_0", "who_1").agg(F.count("*").alias("weight"))
    one = Window.partitionBy("grp", "node")
    before = F.sum("weight").over(one.orderBy("members", "who_0", "who_1").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("weight")
    # n-grams that nobody else has come first
    have = have.withColumn("at", before - F.sum("weight").over(one) + 1).withColumn("run", F.xxhash64("members", "who_0", "who_1"))
    have = have.join(rows.select("grp", "node", "label", "n", "size"), ["grp", "node"])
    return have.select("grp", "node", "label", "n", "size", "run", "weight", (F.col("at") + F.col("size")).alias("at"))


def meeting(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (grp, node, label, n, size, differ) of one group and different labels, to be
    verified: they connect whatever the links among rows connect.

    A link shares at least k n-grams of its differences, so its first shared run lies among the rarest, and
    if that run is w long, k - w more follow, the first of them among the rarest again. Members with a run
    meet at that chain of one run. Where they are many, each goes on to chains of two runs, three, ..., as
    long as that makes fewer rows than pairs would be made. So members of templates with common values meet
    only at combinations of values, and rows don't grow with the square of the members.
    """
    every = written(runs(rows), "ngram-runs")
    most = F.floor(F.col("n") * F.lit(100 - percent) / F.lit(percent)) + 1  # the last place any partner lets a first shared run have
    chain = every.select("grp", "node", "label", "n", "size", "at", F.lit(0).cast("long").alias("done"), "weight", F.col("run").alias("chain")).filter(F.col("at") <= most)
    # 2 (100 + percent) k is the sum of two members' needs
    need = F.lit(100 + percent) * F.col("size") - F.lit(100 - percent) * F.col("n")
    key, found, read = ["grp", "chain"], None, []
    while True:
        # of members whose chain alone is enough, each with the one that needs least: all of them are links
        sums = chain.groupBy(*key).agg(
            F.count("*").alias("members"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct(need.alias("need"), F.col("node").alias("node"))).alias("least")
        ).filter("low < high")
        chain = written(chain.join(sums.drop("low", "high"), key), "ngram-chains")
        discard(*read)
        read = [chain]
        enough = chain.filter((F.col("node") != F.col("least.node")) & (need + F.col("least.need") <= F.lit(2 * (100 + percent)) * (F.col("done") + F.col("weight"))))
        pairs = enough.select(F.least("node", "least.node").alias("a"), F.greatest("node", "least.node").alias("b"))
        few, many = chain.filter(F.col("members") <= MANY), chain.filter(F.col("members") > MANY)
        longer = None
        if many.limit(1).count():
            step = every.select("grp", "node", F.col("run").alias("next"), F.col("weight").alias("w"), F.col("at").alias("next_at"))
            grown = many.join(step, ["grp", "node"]).filter((F.col("next_at") > F.col("at")) & (F.col("next_at") <= most + F.col("done") + F.col("weight")))
            grown = written(grown.select("grp", "chain", "members", "node", "label", "n", "size", "next_at", (F.col("done") + F.col("weight")).alias("done"), "w", "next"), "ngram-grown")
            read.append(grown)
            # where that makes more rows than there are pairs, the pairs are made
            dear = grown.groupBy(*key, "members").agg(F.count("*").alias("rows")).filter("2 * rows >= members * (members - 1)").select(*key)
            few = few.unionByName(many.join(dear, key, "left_semi"))
            longer = grown.join(dear, key, "left_anti").select(
                "grp", "node", "label", "n", "size", F.col("next_at").alias("at"), "done", F.col("w").alias("weight"), F.xxhash64("chain", "next").alias("chain")
            )
        pairs = written(pairs.unionByName(meet_at(few, percent)).distinct(), "ngram-pairs")
        found = pairs if found is None else found.unionByName(pairs)
        if longer is None:
            discard(every, *read)
            return found.distinct()
        chain = longer


def meet_at(chains: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one chain and different labels that can be links by place and size."""
    x, y = (chains.select("grp", "chain", "done", *[F.col(c).alias(f"{c}_{z}") for c in ("node", "label", "n", "size", "at")]) for z in "xy")
    s, both = F.col("n_x") + F.col("n_y"), F.col("size_x") + F.col("size_y")
    k = F.ceil((F.lit(100 + percent) * both - F.lit(100 - percent) * s) / F.lit(2 * (100 + percent))) - F.col("done")
    fits = (F.lit(100) * F.least("n_x", "n_y") >= F.lit(percent) * F.greatest("n_x", "n_y")) & (F.col("at_x") <= F.col("size_x") - k + 1) & (F.col("at_y") <= F.col("size_y") - k + 1)
    met = x.join(y.drop("done"), ["grp", "chain"]).filter((F.col("node_x") < F.col("node_y")) & (F.col("label_x") != F.col("label_y")) & fits)
    return met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))


def overlaps(x: tuple[np.ndarray, np.ndarray, int], y: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """How many n-grams each of x has in common with each of y; both are (n-grams, whose, members), a member's
    n-grams being distinct. N-grams of few are counted by pair, those of many by products of matrices."""
    (gram_x, of_x, m_x), (gram_y, of_y, m_y) = x, y
    shared = np.zeros(m_x * m_y, np.int64)
    both = np.intersect1d(gram_x, gram_y)
    if not len(both):
        return shared.reshape(m_x, m_y)
    sides = []
    for gram, of in ((gram_x, of_x), (gram_y, of_y)):
        at = np.minimum(np.searchsorted(both, gram), len(both) - 1)
        known = np.flatnonzero(both[at] == gram)
        known = known[np.argsort(at[known], kind="stable")]
        sides.append((at[known], of[known]))
    (at_x, of_x), (at_y, of_y) = sides
    starts, count = np.searchsorted(at_y, np.arange(len(both))), np.bincount(at_y, minlength=len(both))
    often = np.bincount(at_x, minlength=len(both)) * count > HEAVY
    rare = np.flatnonzero(~often[at_x])
    times = count[at_x[rare]]
    ends = np.cumsum(times)
    for low in range(0, int(ends[-1]) if len(ends) else 0, 1 << 21):
        i, j = np.searchsorted(ends, [low, low + (1 << 21)], "right")
        t = times[i:j]  # members of y that each n-gram of this part meets
        if len(t):
            place = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t) + np.repeat(starts[at_x[rare[i:j]]], t)
            shared += np.bincount(np.repeat(of_x[rare[i:j]], t) * m_y + of_y[place], minlength=m_x * m_y)
    heavy = np.flatnonzero(often)
    for low in range(0, len(heavy), 256):
        part = heavy[low : low + 256]
        grids = []
        for at, of, m in ((at_x, of_x, m_x), (at_y, of_y, m_y)):
            column = np.minimum(np.searchsorted(part, at), len(part) - 1)
            mine = part[column] == at
            grid = np.zeros((m, len(part)), np.float32)
            grid[of[mine], column[mine]] = 1
            grids.append(grid)
        shared += (grids[0] @ grids[1].T).astype(np.int64).ravel()
    return shared.reshape(m_x, m_y)


def connected(group: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among rows (grp, node, label, n, size, differ) of one group and different labels that connect
    what all such links connect.

    The members of a group are dealt into blocks of at most about BLOCK n-grams, and two blocks meet in one task,
    which knows all overlaps at once and sends a spanning forest of its links. A label with more than that has
    blocks of its own, which don't meet each other: where most of a group is one component already, the work
    grows with the group, not with its square. Blocks meet in waves, in each of which a block is sent to about WAVE
    others, and a wave's shuffle files go before the next: disk grows with the group, too."""
    sums = group.groupBy("grp", "label").agg(F.sum(F.col("size") + MEMBER).alias("load"))
    tag = F.when(F.col("load") > BLOCK, F.col("label").cast("string")).otherwise(F.lit(""))
    sums = written(sums.withColumn("tag", tag), "ngram-loads")
    kinds = sums.groupBy("grp", "tag").agg(F.ceil(F.sum("load") / F.lit(BLOCK)).alias("blocks"))
    one = Window.partitionBy("grp")
    kinds = kinds.withColumn("before", F.sum("blocks").over(one.orderBy("tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("blocks"))
    kinds = written(kinds.withColumn("waves", F.ceil(F.sum("blocks").over(one) / F.lit(WAVE))), "ngram-kinds")
    others = kinds.select("grp", F.col("tag").alias("other_tag"), F.col("before").alias("other_before"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k"))
    mine = group.join(sums.select("grp", "label", "tag"), ["grp", "label"]).join(kinds, ["grp", "tag"])
    mine = mine.withColumn("mine", F.pmod(F.xxhash64("node"), "blocks")).withColumn("block", F.concat_ws(":", "mine", "tag"))
    others = others.select("grp", "other_tag", F.concat_ws(":", "k", "other_tag").alias("other"), (F.col("other_before") + F.col("k")).alias("at"))
    met = mine.join(others, "grp").filter((F.col("tag") == "") | (F.col("tag") != F.col("other_tag")))
    met = met.withColumn("wave", (F.col("before") + F.col("mine") + F.col("at")) % F.col("waves"))  # the same for both blocks
    first, second = F.least("block", "other"), F.greatest("block", "other")
    met = met.select("grp", first.alias("x"), second.alias("y"), (F.col("block") == first).alias("left"), "node", "label", "n", "size", "differ", "wave")

    def links(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        one = key[1].as_py() == key[2].as_py()
        sides = []
        for of in (True,) if one else (True, False):
            t = whole.filter(whole["left"] if of else pc.invert(whole["left"]))
            columns = [t[c].to_numpy() for c in ("node", "label", "n", "size")]
            differ = t["differ"].combine_chunks()
            grams = differ.flatten().to_numpy(zero_copy_only=False)
            of_ = np.repeat(np.arange(t.num_rows), pc.list_value_length(differ).to_numpy(zero_copy_only=False))
            sides.append((*columns, (grams, of_, t.num_rows)))
        (node_x, label_x, n_x, size_x, x), (node_y, label_y, n_y, size_y, y) = sides[0], sides[-1]
        a = size_x[:, None] + size_y[None, :] - 2 * overlaps(x, y)  # n-grams that only one of two has
        n = n_x[:, None] + n_y[None, :]
        link = 100 * (n - a) >= percent * (n + a)
        found = []
        # a walk through all links; those of a tree are sent, if they connect different labels
        new_x, new_y = np.ones(len(node_x), bool), np.ones(len(node_y), bool)
        if one:
            new_y = new_x
        for start in range(len(node_x)):
            if not new_x[start]:
                continue
            new_x[start] = False
            open_ = [(True, start)]
            while open_:
                left, at = open_.pop()
                here, there, near = (node_x[at], node_y, link[at] & new_y) if left else (node_y[at], node_x, link[:, at] & new_x)
                label, labels = (label_x[at], label_y) if left else (label_y[at], label_x)
                (new_y if left else new_x)[near] = False
                for i in np.flatnonzero(near):
                    open_.append((not left or one, int(i)))
                    if labels[i] != label:
                        found.append((min(here, there[i]), max(here, there[i])))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        del whole, sides, a, n, link
        release()
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    waves = kinds.agg(F.max("waves")).first()[0] or 1
    parts = [written(met.filter(F.col("wave") == w).drop("wave").groupBy("grp", "x", "y").applyInArrow(links, "a long, b long"), "ngram-wave") for w in range(waves)]
    return reduce(DataFrame.unionByName, parts)


def families_of(keys: DataFrame) -> DataFrame:
    """(node, grp): nodes of rows (key, node) that keys connect."""
    first = keys.groupBy("key").agg(F.min("node").alias("a"))
    star = keys.join(first, "key").filter("node > a").select("a", F.col("node").alias("b")).distinct()
    return components(written(star, "ngram-pairs")).select("node", F.col("label").alias("grp"))


def paired(keys: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (key, node, label) with the same key, different labels, and sizes of a link."""
    sizes = sets.filter("frag = 0").select(F.col("doc_id").alias("node"), "n")
    each = keys.select("key", "node", "label").join(sizes, "node")
    x, y = (each.select("key", *[F.col(c).alias(f"{c}_{z}") for c in ("node", "label", "n")]) for z in "xy")
    fits = F.lit(100) * F.least("n_x", "n_y") >= F.lit(percent) * F.greatest("n_x", "n_y")
    met = x.join(y, "key").filter((F.col("node_x") < F.col("node_y")) & (F.col("label_x") != F.col("label_y")) & fits)
    return met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def likely(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that can be links by their sketches: how many n-grams of a set each of BINS ranges of hashes
    has. Where these numbers differ n-grams do, so no link is lost, and a pair is a kilobyte here instead of two sets."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column("part")
            h = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(b.num_rows), part.value_lengths().to_numpy(zero_copy_only=False))
            at = (h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)
            width = BINS // VERTICAL  # a fragment has its own bins
            bins = np.bincount(row * width + at.astype(np.int64) % width, minlength=b.num_rows * width)
            bins = np.minimum(bins, 65535).astype(np.uint16).reshape(b.num_rows, width)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("frag"), b.column("n"), pa.array([x.tobytes() for x in bins], pa.binary())], names=["doc_id", "frag", "n", "bins"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1).astype(np.int64) for c in ("bins_a", "bins_b"))
            apart, n = np.abs(x - y).sum(1), b.column("n").to_numpy()
            yield b.filter(pa.array(100 * (n - apart) >= percent * (n + apart))).select(["a", "b"])

    either = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    each = sets.join(either, "doc_id", "left_semi").mapInArrow(sketch, "doc_id long, frag int, n long, bins binary")
    whole = each.groupBy("doc_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("frag", "bins"))).alias("bins"))
    whole = written(whole.select("doc_id", "n", F.concat(*[F.col("bins")[k]["bins"] for k in range(VERTICAL)]).alias("bins")), "ngram-sketches")
    left, right = (whole.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bins").alias(f"bins_{x}")) for x in "ab")
    met = pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "bins_a", "bins_b")
    return met.mapInArrow(close, "a long, b long")


def linked(docs: DataFrame, members: DataFrame, same: DataFrame, n: int, percent: int, unique: bool) -> DataFrame:
    """(node, label) of all documents that have a link. members: (key, node) of shared fragments; same: pairs
    (a, b) of equal sets; unique: no doc_id repeats."""
    every = sets_of(docs, members, n, unique)
    # documents with more n-grams that no other candidate has than a link allows can't be linked
    nodes = written(alone(every).filter(F.lit(100) * F.col("own") <= F.lit(100 - percent) * F.col("n")).select("doc_id", "own"), "ngram-nodes")
    sets = written(every.join(nodes.select("doc_id"), "doc_id", "left_semi"), "ngram-sets")
    discard(every)
    members = written(members.join(nodes.withColumnRenamed("doc_id", "node"), "node"), "ngram-members")

    # first each document with the smallest one of those that stand for its fragments
    first = members.groupBy("key").agg(F.min("node").alias("a"))
    pairs = members.join(first, "key").filter("node > a").groupBy(F.col("node").alias("b")).agg(F.min("a").alias("a")).select("a", "b")
    links = written(same.unionByName(verified(sets, written(pairs, "ngram-pairs"), percent)), "ngram-links")
    labels = components(links)

    def more(new: DataFrame) -> bool:
        nonlocal links, labels
        if not new.limit(1).count():
            return False
        links = written(links.unionByName(new), "ngram-links")
        labels = components(links)
        return True

    # fragments whose members still lie in different components: families of their documents by rare n-grams
    open_ = labelled(members, labels)
    if not open_.limit(1).count():
        return labels
    nodes = written(open_.select(F.col("node").alias("doc_id")).distinct(), "ngram-ids")
    open_sets = written(sets.join(nodes, "doc_id", "left_semi"), "ngram-sets")
    discard(sets)
    sets = open_sets
    open_ = labelled(written(rare_keys(sets, percent), "ngram-keys"), labels)
    if not open_.limit(1).count():
        return labels
    families = written(families_of(open_), "ngram-families")
    sizes = sets.filter("frag = 0").select(F.col("doc_id").alias("node"), "n")
    wide = families.join(sizes, "node").groupBy("grp").agg(F.sum(F.col("n") + MEMBER).alias("load")).filter(F.col("load") > BLOCK)
    wide = written(families.join(wide, "grp").select("node", "grp"), "ngram-wide")
    if wide.limit(1).count():
        # families of several blocks: what few documents have connects none, these documents are compared in pairs
        keys = written(open_.join(wide.select("node"), "node"), "ngram-wide-keys")
        few = written(paired(keys.filter(F.col("members") <= PAIRED), sets, percent), "ngram-few")
        more(written(verified(sets, written(likely(sets, few, percent), "ngram-likely"), percent), "ngram-near"))
        rest = labelled(keys.filter(F.col("members") > PAIRED).select("key", "node"), labels)
        families = families.join(wide.select("grp").distinct(), "grp", "left_anti").select("node", "grp").unionByName(families_of(rest))
    placed = families.join(labels, "node", "left").select(F.col("node").alias("doc_id"), "grp", F.coalesce("label", "node").alias("label"))
    whole = sets.join(placed, "doc_id").groupBy("grp", F.col("doc_id").alias("node"), "label", "n").agg(F.flatten(F.collect_list("part")).alias("differ"))
    group = written(whole.select("grp", "node", "label", "n", F.col("n").alias("size"), "differ"), "ngram-differences")
    loads = group.groupBy("grp").agg(F.sum(F.col("size") + MEMBER).alias("load"))
    large = written(loads.filter(F.col("load") > MOST * BLOCK).select("grp"), "ngram-large")
    more(written(connected(group.join(large, "grp", "left_anti"), percent), "ngram-near"))
    if large.limit(1).count():
        rest = written(group.join(large, "grp", "left_semi"), "ngram-rest")
        more(written(verified(sets, written(meeting(rest, percent), "ngram-met"), percent), "ngram-near"))
    return labels


def near_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs."""
    with tables_made() as made:
        found = candidates(docs, n, percent)
        maybe = found.filter(F.col("kind") == MAYBE)
        every = written(maybe.select("key", F.col("a").alias("node")).unionByName(maybe.select("key", F.col("b").alias("node"))).distinct(), "ngram-members")
        members = written(every.join(once(every).select("key"), "key", "left_semi"), "ngram-members")
        known = written(found.filter(F.col("kind") != MAYBE), "ngram-known")
        discard(found, every)
        unique = not known.filter(F.col("kind") == INFO).groupBy("a").count().filter("count > 1").limit(1).count()
        labels = linked(docs, members, known.filter(F.col("kind") == SAME).select("a", "b"), n, percent, unique)
    discard(*[t for t in made if t.written_to not in (known.written_to, labels.written_to)])
    info = known.filter(F.col("kind") == INFO).select(F.col("a").alias("doc_id"), F.col("key").alias("n_shingles"))
    out = info.join(labels, info["doc_id"] == labels["node"], "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    no_id = docs.filter(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            sizes = [len(s) for s in shingle_sets(as_bytes(b.column("text")), n, words)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), b.column("doc_id")], names=["doc_id", "n_shingles", "component_id"])

    return out.unionByName(no_id.mapInArrow(count, "doc_id long, n_shingles long, component_id long"))


def keep_one(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row of each component: that with the smallest doc_id, a null one being the largest. Where ids
    repeat or are null, the rows are compared under numbers of their own."""
    known = docs.filter(F.col("doc_id").isNotNull())
    if not docs.filter(F.col("doc_id").isNull()).limit(1).count() and not known.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        parts = near_components(docs, n, percent)
        gone = parts.filter("component_id < doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
        return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    row = "_" * max(map(len, docs.columns)) + "row"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "ngram-rows")
    parts = near_components(rows.select(F.col(row).alias("doc_id"), "text"), n, percent)
    parts = parts.select(F.col("doc_id").alias(row), "component_id").join(rows.select(row, "doc_id"), row)
    stay = parts.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))).alias("m"))
    return rows.join(stay.select(F.col("m.row").alias(row)), row, "left_semi").select(*docs.columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), 3, 90)


QUERIES = {"op2_ngram_join": op2_ngram_join}
ORACLE_SQL = {
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
  FROM w
), n AS (
  SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY ALL
), l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id
  JOIN n na ON na.doc_id = x.doc_id JOIN n nb ON nb.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS label FROM n
  UNION
  SELECT e.b, r.label FROM r JOIN e ON r.node = e.a
)
SELECT n.doc_id, n.n AS n_shingles, min(r.label) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
}
