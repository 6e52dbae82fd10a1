"""Removal of repeated passages by suffix arrays.

A byte goes if it lies in a string of L bytes that also starts in a document with a smaller doc_id.

Sorting every suffix of a corpus in one order needs many times the corpus in shuffles, so suffixes are
sorted where a repeat is possible. Of each L-byte window the K-gram with the smallest hash is its anchor:
equal windows have equal anchors at equal places, so only contexts (the L + L - K bytes that windows
with this anchor can cover) of anchors that occur in two documents can hold a repeat. Their texts are
dealt to buckets by anchor. Contexts equal byte by byte are one, that of their smallest document, and
the others lose all their windows. What is left of an anchor are different contexts; they go to a shard
that is sorted by external induced sorting (induced_sort). Suffixes that have L bytes in common with
their neighbours are one string, whose smallest document is known then.

Blocks are packed runs of documents, some MB each. A block sends a context once, whatever the number of
its documents that have it, and can make its lists again, so answers name nothing. All tables between
the steps are written, so a lost executor repeats one step. A passage that a third of all documents
share is one row for each block; at its edges contexts differ in each document. So anchors are counted
with a sketch of their contexts: where many documents, or many places of a block, have an anchor in
different contexts, its windows are dealt by their own content, each one a context that is equal to
others or alone. An anchor that is left is in less than HOT documents, or its contexts agree in the
sketch, and so are equal but for chance. A shard is whole anchors of about
SHARD bytes; the sort's queues and sorted runs go to files beyond SORT entries.

Edge cases: null text = no bytes; a null doc_id counts as larger than all others; rows that share a
doc_id don't remove from each other; documents shorter than L lose nothing; repeats within one document
stay; an empty table gives an empty table; other columns are ignored by the digest and kept by `cleaned`.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gabbro.llm.common import flat_utf8, mix64, release, slices, written
from gabbro.llm.induced_sort import Stats, sorted_suffixes
from gabbro.tables import table

L, K = 50, 20
W = L - K + 1  # K-grams of a window
EVERY = np.int32((1 << W) - 1)  # a bit a window: W is 31 at most
NO_ID = np.iinfo(np.int64).max
HOT = 256  # documents, as estimated from blocks, or places in one block
BLOCK = 4 << 20
BUCKET = 16 << 20  # bytes of the corpus whose contexts meet in one task
SHARD = 1 << 20  # bytes of contexts in one suffix array, unless one key alone has more
SORT = 1 << 18  # entries that the sort's queues hold in memory
CHUNK = 1 << 18  # bytes hashed at once: the arrays stay in cache

_RNG = np.random.default_rng(20240229)
LUT = _RNG.integers(0, 1 << 32, 256, dtype=np.uint32)
ODD = _RNG.integers(0, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)
ODD32 = ODD.astype(np.uint32)
#: The lowest bits of an anchor's key: a class of how many documents (three), a sketch of the contexts (five).
LOW, CLASS, MIXED = np.uint64(255), np.uint64(7), np.uint64(31)
#: Where the classes begin, by documents of a block; the last class: HOT places or more. At most so many each.
CLASSES = (2, 4, 8, 16, 32, 64)
AT_MOST = np.array([1, 3, 7, 15, 31, 63, HOT - 1, HOT])


def gram_hash(a: np.ndarray) -> np.ndarray:
    """A hash of each K-gram of bytes a, to choose anchors by."""
    n = len(a) - K + 1
    with np.errstate(over="ignore"):
        h1 = LUT[a]
        h2 = h1[:-1] * ODD32[0] + h1[1:]
        h4 = h2[:-2] * ODD32[1] + h2[2:]
        h8 = h4[:-4] * ODD32[2] + h4[4:]
        h16 = h8[:-8] * ODD32[3] + h8[8:]
        h = h16[:n] * ODD32[4] + h4[16 : 16 + n] * ODD32[5]
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x7FEB352D)
        h ^= h >> np.uint32(15)
        return h


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w neighbours."""
    done = 1
    while done * 2 <= w:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (w - done)], x[w - done :]) if w > done else x


def anchors(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where an anchor starts, as a mask over the bytes of documents with these offsets."""
    mask = np.zeros(len(flat), bool)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1)
        base = off[i]
        a, cut = flat[base : off[j]], off[i : j + 1] - base
        i = j
        if len(a) < L:
            continue
        h = gram_hash(a)
        least = sliding(h, W, np.minimum)
        # windows across documents choose nothing
        for edge in cut[1:-1].tolist():
            least[max(0, edge - L + 1) : edge] = 0
        # a K-gram is an anchor if a window that holds it has it as least
        side = np.concatenate([np.zeros(W - 1, np.uint32), least, np.zeros(len(h) - len(least), np.uint32)])
        mask[base : base + len(h)] = sliding(side, W, np.maximum) == h
    return mask


def pack_block(ids: np.ndarray, flat: np.ndarray, off: np.ndarray) -> bytes:
    import zstandard

    out = io.BytesIO()
    np.savez(out, ids=ids, off=off, flat=flat, mask=np.packbits(anchors(flat, off)))
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


class Block:
    """Documents of a block with their anchors."""

    def __init__(self, raw: bytes):
        import zstandard

        v = np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(raw)))
        self.ids, self.off, self.flat = v["ids"], v["off"], v["flat"]
        pos = np.flatnonzero(np.unpackbits(v["mask"], count=len(self.flat)))
        doc = np.searchsorted(self.off, pos, "right") - 1
        # windows that hold the anchor begin in [low, high]
        low, high = pos - np.minimum(W - 1, pos - self.off[doc]), pos - np.maximum(0, pos + L - self.off[doc + 1])
        fits = low <= high
        self.pos, self.doc, self.low, self.high = pos[fits], doc[fits], low[fits], high[fits]
        self.words = words_of(self.flat)

    def keys(self) -> np.ndarray:
        """Hash of each anchor, the LOW bits free."""
        return hashed(gathered(self.words, self.pos, (0, 8, K - 8))) & ~LOW

    def sketches(self) -> np.ndarray:
        """Some bits of each anchor's context; MIXED is left for several."""
        return contexts_hash(self.words, self.low, self.high - self.low + L) % MIXED

    def records(self, shared: np.ndarray, hot: np.ndarray, keys: np.ndarray) -> dict[str, np.ndarray]:
        """Contexts of shared anchors, a row for each: begin, size, doc, the shard's key and a hash. The
        windows of hot anchors are contexts of their own, each once, with their own content as key."""
        cold = shared & ~hot
        begin, doc, key = self.low[cold], self.doc[cold], keys[cold]
        size = self.high[cold] - begin + L
        low, high = self.low[shared & hot], self.high[shared & hot]
        if len(low):
            n = len(self.flat) + 1
            single = np.flatnonzero(np.cumsum(np.bincount(low, minlength=n) - np.bincount(high + 1, minlength=n)) > 0)
            begin, size = np.concatenate([begin, single]), np.concatenate([size, np.full(len(single), L)])
            doc = np.concatenate([doc, np.searchsorted(self.off, single, "right") - 1])
        h = contexts_hash(self.words, begin, size)
        return {"begin": begin, "size": size, "doc": self.ids[doc], "key": np.concatenate([key, h[len(key) :] & ~LOW]), "hash": h}


def words_of(flat: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as rows."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([flat, np.zeros(8, np.uint8)]), 8)


def gathered(words: np.ndarray, begin: np.ndarray, at) -> Iterator[np.ndarray]:
    """The eight bytes at begin + a for each a, as numbers."""
    for a in at:
        yield words[begin + a].view(np.uint64).ravel()


def context_words(words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """All bytes of contexts of L to L + W - 1 bytes: 48 from the left and 32 from the right end."""
    yield from gathered(words, begin, range(0, 48, 8))
    yield from gathered(words, begin + size, range(-32, 0, 8))


def hashed(parts: Iterator[np.ndarray]) -> np.ndarray:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for w in parts:
            h = (h ^ w) * ODD[6]
            h = h ^ (h >> np.uint64(29))
    return mix64(h)


def contexts_hash(words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.empty(len(begin), np.uint64)
    for i in range(0, len(begin), 1 << 16):
        j = slice(i, i + (1 << 16))
        out[j] = mix64(hashed(context_words(words, begin[j], size[j])) + size[j].astype(np.uint64))
    return out


def equal_contexts(words: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, of): the contexts that differ, byte by byte, from all others of their key, each the one of its
    smallest document; and for every context which of them it equals."""
    h = h.copy()
    while True:
        order = np.lexsort((doc, h, key))
        k, x = key[order], h[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (x[1:] != x[:-1])]) if len(k) else np.zeros(0, bool)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        first = order[new]
        more = order[~new]
        differ = size[more] != size[first[of[more]]]
        for a, b in zip(context_words(words, begin[more], size[more]), context_words(words, begin[first[of[more]]], size[first[of[more]]])):
            differ |= a != b
        if not differ.any():
            return first, of
        with np.errstate(over="ignore"):
            h[more[differ]] = h[more[differ]] * ODD[7] + np.uint64(1)  # texts that only share a hash get another one


def blocks(docs: DataFrame) -> DataFrame:
    """(block, bytes, content): runs of documents as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def close() -> pa.RecordBatch:
            nonlocal turn
            ids = np.concatenate([h[0] for h in held])
            flat = np.concatenate([h[1] for h in held])
            off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[2]) for h in held]))]).astype(np.int64)
            turn += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([turn - 1]), pa.array([len(flat)]), pa.array([pack_block(ids, flat, off)], pa.binary())], names=["block", "bytes", "content"])

        for whole in batches:
            for b in slices(whole, "text", BLOCK):
                flat, off = flat_utf8(b.column("text"))
                held.append((b.column("doc_id").fill_null(NO_ID).to_numpy(), flat.copy(), off))
                size += len(flat)
                if size >= BLOCK:
                    yield close()
                    size = 0
        if held:
            yield close()

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(typed.mapInArrow(run, "block long, bytes long, content binary"), "suffix-blocks")


def by_bucket(at: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(at, kind="stable")
    cut = np.searchsorted(at[order], np.arange(buckets + 1))
    for k in range(buckets):
        if cut[k] < cut[k + 1]:
            yield k, order[cut[k] : cut[k + 1]]


class Lists:
    """What a block sends to each bucket, in an order it can make again: answers then follow that order
    and name nothing."""

    def __init__(self, block: Block, buckets: int):
        self.block, self.buckets = block, buckets
        self.keys = block.keys()
        self.order = np.argsort(self.keys, kind="stable")
        k = self.keys[self.order]
        self.begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        self.unique = k[self.begin]

    def entries(self) -> np.ndarray:
        """The different anchors, each with its class and sketch."""
        first = self.begin
        if not len(first):
            return self.unique
        places = np.diff(np.append(first, len(self.order)))
        ids, sketch = self.block.ids[self.block.doc][self.order], self.block.sketches()[self.order]
        low, high = np.minimum.reduceat(sketch, first), np.maximum.reduceat(sketch, first)
        docs = np.ones(len(first), np.int64)
        several = np.flatnonzero(places > 1)
        if len(several):
            at = ranges(first[several], places[several])
            group = np.repeat(np.arange(len(several)), places[several])
            by = np.lexsort((ids[at], group))
            new = np.concatenate([[True], (group[by][1:] != group[by][:-1]) | (ids[at][by][1:] != ids[at][by][:-1])])
            docs[several] = np.bincount(group[by][new], minlength=len(several))
        few = np.searchsorted(CLASSES, docs, "right").astype(np.uint64)
        few[places >= HOT] = CLASS
        return self.unique | np.where(low == high, low, MIXED) << np.uint64(3) | few

    @property
    def few(self) -> np.ndarray:
        """0 for anchors of one document, 1 or 2 for more, 3 for those with HOT places."""
        return np.searchsorted([1, 5, 7], self.entries() & CLASS, "right")

    def first(self) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, entries) of the anchors."""
        return by_bucket(((self.unique >> np.uint64(8)) % np.uint64(self.buckets)).astype(np.int64), self.buckets)

    def second(self, answers: dict[int, bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, entries) of the contexts of shared anchors; fills rec, the contexts of every anchor,
        one, the first (of the smallest document) of each different context of a key, and of."""
        shared, hot = np.zeros(len(self.unique), bool), np.zeros(len(self.unique), bool)
        for k, i in self.first():
            if k in answers:
                bits = np.unpackbits(np.frombuffer(answers[k], np.uint8), count=2 * len(i)).astype(bool)
                shared[i], hot[i] = bits[::2], bits[1::2]
        at = np.empty(len(self.keys), np.int64)
        at[self.order] = np.repeat(np.arange(len(self.unique)), np.diff(np.append(self.begin, len(self.order))))
        rec = self.rec = self.block.records(shared[at], hot[at], self.keys)
        # by key too: anchors at several places can have one context, and each key is met by others
        self.one, self.of = equal_contexts(self.block.words, rec["begin"], rec["size"], rec["key"], rec["doc"], rec["hash"])
        return by_bucket(((rec["key"][self.one] >> np.uint64(8)) % np.uint64(self.buckets)).astype(np.int64), self.buckets)


def shared_anchors(packed: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, bits): for each anchor of a block whether it occurs in another document, and
    whether in many. Blocks send an anchor once, with a class of how many documents have it."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw in zip(b.column("block").to_pylist(), b.column("content")):
                lists = Lists(Block(raw.as_py()), buckets)
                entries = lists.entries()
                rows = [(k, block, entries[i].tobytes()) for k, i in lists.first()]
                yield batch(rows, bucket=pa.int64(), block=pa.int64(), keys=pa.binary())

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys = [], []
        for b in batches:
            names += b.column("block").to_pylist()
            keys += [np.frombuffer(x, np.uint64) for x in b.column("keys").to_pylist()]
        k = np.concatenate(keys)
        order = np.argsort(k, kind="stable")
        pure, few, sketch = k[order] & ~LOW, (k[order] & CLASS).astype(np.int64), (k[order] & LOW) >> np.uint64(3)
        new = np.concatenate([[True], pure[1:] != pure[:-1]])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        n_blocks = np.diff(np.append(first, len(k)))
        many = np.add.reduceat(np.minimum(AT_MOST, HOT)[few], first)
        low, high = np.minimum.reduceat(sketch, first), np.maximum.reduceat(sketch, first)
        bits = np.zeros((len(k), 2), bool)
        bits[order, 0] = ((n_blocks > 1) | (np.maximum.reduceat(few, first) > 0))[group]
        bits[order, 1] = ((many >= HOT) & ((low < high) | (high == MIXED)))[group]
        cut = np.cumsum([0, *map(len, keys)])
        yield batch([(n, key[0].as_py(), np.packbits(bits[i:j].ravel()).tobytes()) for n, i, j in zip(names, cut, cut[1:])], block=pa.int64(), bucket=pa.int64(), bits=pa.binary())

    sent = packed.mapInArrow(send, "bucket long, block long, keys binary")
    return written(sent.groupBy("bucket").applyInArrow(meet, ANSWER), "suffix-shared")


ANSWER = "block long, bucket long, bits binary"


def batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values())], names=list(kinds))


def answered(t: pa.Table, kind: int) -> dict[int, bytes]:
    return {k: x for n, k, x in zip(t["kind"].to_pylist(), t["bucket"].to_pylist(), t["bits"].to_pylist()) if n == kind}


def visit(packed: DataFrame, answers: list[DataFrame], run, schema: str) -> DataFrame:
    """run(lists' block name, content, answers of it) where a block and all its answers meet."""
    union = None
    for kind, a in enumerate(answers):
        a = a.withColumn("kind", F.lit(kind))
        union = a if union is None else union.unionByName(a)

    def both(_: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.Table.from_batches([run(name, raw.as_py(), right) for name, raw in zip(left["block"].to_pylist(), left["content"])])
        release()
        return out

    return packed.groupBy("block").cogroup(union.groupBy("block")).applyInArrow(both, schema)


def window_masks(packed: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, bits): for each different context of a block which of its windows start in a smaller
    document: 32 bits a context, compressed."""

    def send(name: int, raw: bytes, t: pa.Table) -> pa.RecordBatch:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        lists = Lists(Block(raw), buckets)
        rows = []
        for k, i in lists.second(answered(t, 0)):
            rec, j = lists.rec, lists.one[i]
            rows.append((k, name, rec["key"][j].tobytes(), press(rec["doc"][j].tobytes()), rec["size"][j].astype(np.uint8).tobytes(), press(joined(lists.block, rec["begin"][j], rec["size"][j]).tobytes())))
        return batch(rows, bucket=pa.int64(), block=pa.int64(), keys=pa.binary(), docs=pa.binary(), sizes=pa.binary(), texts=pa.binary())

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_, press = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        names, keys, docs, sizes, texts = [], [], [], [], []
        for b in batches:
            names += b.column("block").to_pylist()
            keys += [np.frombuffer(x, np.uint64) for x in b.column("keys").to_pylist()]
            docs += [np.frombuffer(open_(x), np.int64) for x in b.column("docs").to_pylist()]
            sizes += [np.frombuffer(x, np.uint8) for x in b.column("sizes").to_pylist()]
            texts += [np.frombuffer(open_(x), np.uint8) for x in b.column("texts").to_pylist()]
        cut = np.cumsum([0, *map(len, keys)])
        k, d, size = np.concatenate(keys), np.concatenate(docs), np.concatenate(sizes).astype(np.int64)
        text = np.concatenate(texts)
        texts.clear()
        mask = masks(k, d, text, size)
        yield batch([(n, key[0].as_py(), press(mask[a:b].tobytes())) for n, a, b in zip(names, cut, cut[1:])], block=pa.int64(), bucket=pa.int64(), bits=pa.binary())
        del keys, docs, sizes, text, mask, k, d, size
        release()

    sent = visit(packed, [shared], send, "bucket long, block long, keys binary, docs binary, sizes binary, texts binary")
    return written(sent.groupBy("bucket").applyInArrow(meet, ANSWER), "suffix-windows")


def masks(key: np.ndarray, doc: np.ndarray, text: np.ndarray, size: np.ndarray, shard: int | None = None, stats: Stats | None = None) -> np.ndarray:
    """For each context (texts joined, with keys, documents and sizes): a bit for each of its windows that
    starts in a smaller document, too."""
    begin = np.cumsum(size) - size
    words = words_of(text)
    first, of = equal_contexts(words, begin, size, key, doc, contexts_hash(words, begin, size))
    # of equal contexts the one in the smallest document is sorted, if its key has others
    order = first[np.argsort(key[first], kind="stable")]
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    several = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
    order = order[several[np.cumsum(new) - 1]]
    own = np.zeros(len(key), np.int32)
    # runs of whole keys of about a shard's bytes: equal windows have equal keys
    edge = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(size[order])])
    edge = np.append(edge, len(order))
    i = 0
    while i < len(edge) - 1:
        j = max(i + 1, int(np.searchsorted(total[edge], total[edge[i]] + (shard or SHARD), "right")) - 1)
        part = order[edge[i] : edge[j]]
        which, least = smallest_holder(text[ranges(begin[part], size[part])], size[part], doc[part], stats)
        col = np.arange(len(which)) - np.searchsorted(which, which, "left")
        np.bitwise_or.at(own, part[which], np.where(least < doc[part[which]], np.int32(1) << col.astype(np.int32), np.int32(0)).astype(np.int32))
        i = j
    return np.where(doc > doc[first[of]], EVERY, own[first[of]])


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places in [begin, begin + size), one range after another."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def joined(x: Block, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return x.flat[ranges(begin, size)]


def smallest_holder(text: np.ndarray, size: np.ndarray, doc: np.ndarray, stats: Stats | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each L-byte window of texts (joined, with sizes and documents): the smallest document whose
    text has it, by the suffix array. Windows in order: (text, smallest)."""
    n, total = len(size), int(size.sum())
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(n), size)
    t = np.empty(total + n, np.int32)
    put = np.arange(total) + of  # an end mark behind each text, all different, the last the smallest
    t[put] = text.astype(np.int32) + n
    t[begin + size + np.arange(n)] = np.arange(n - 1, -1, -1)
    sa, same = sorted_suffixes(t, SORT, stats)
    back = np.full(total + n, -1, np.int64)
    back[put] = np.arange(total)
    at = back[sa]
    # neighbours with L bytes in common are one string; end marks have nothing in common
    first = np.flatnonzero(same < L)
    holder = np.where(at >= 0, doc[of[at]], NO_ID)
    least = np.minimum.reduceat(holder, first)
    low = np.empty(total, np.int64)
    low[at[at >= 0]] = np.repeat(least, np.diff(np.append(first, len(sa))))[at >= 0]
    win = np.flatnonzero((np.arange(total) - begin[of]) + L <= size[of])
    return of[win], low[win]


def covered(x: Block, t: pa.Table, buckets: int) -> np.ndarray:
    """The bytes of a block that go, from all answers."""
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    n = len(x.flat)
    starts = np.zeros(n + 1, bool)
    lists = Lists(x, buckets)
    windows = answered(t, 1)
    parts = list(lists.second(answered(t, 0)))
    mask = np.zeros(len(lists.one), np.int32)
    for k, i in parts:
        mask[i] = np.frombuffer(open_(windows[k]), np.int32)
    rec = lists.rec
    # documents above the block's smallest with a context lose all its windows
    own = np.where(rec["doc"] > rec["doc"][lists.one][lists.of], EVERY, mask[lists.of]) if len(lists.of) else mask
    for j in range(W):
        hit = ((own >> j) & 1 > 0) & (j + L <= rec["size"])
        starts[rec["begin"][hit] + j] = True
    total = np.concatenate([np.zeros(L, np.int32), np.cumsum(starts[:n], dtype=np.int32)])
    return total[L:] > total[:-L]


def whole_characters(gone: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The mask without characters that would go in part only."""
    lead = (flat & 0xC0) != 0x80
    first = np.flatnonzero(lead)
    if not len(first):
        return gone
    all_gone = np.logical_and.reduceat(gone, first)
    return np.repeat(all_gone, np.diff(np.concatenate([first, [len(flat)]])))


def dedup(docs: DataFrame, texts: bool = False, digests: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with texts also kept_text, in which a character
    that would be cut in part stays whole; with digests also old_sha256, of the text before."""
    packed = blocks(docs)
    # as many buckets as keep a task's contexts small, whatever the corpus
    size = packed.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    shared = shared_anchors(packed, buckets)
    windows = window_masks(packed, shared, buckets)
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"kept_text": pa.string()} if texts else {}) | ({"old_sha256": pa.string()} if digests else {})
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if texts else "") + (", old_sha256 string" if digests else "")

    def run(name: int, raw: bytes, t: pa.Table) -> pa.RecordBatch:
        rows = []
        x = Block(raw)
        gone = covered(x, t, buckets)
        for k, i in enumerate(x.ids.tolist()):
            a, b = int(x.off[k]), int(x.off[k + 1])
            g, part = gone[a:b], x.flat[a:b]
            n = int(g.sum())
            spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
            kept = (part[~g] if n else part).tobytes()
            row = (None if i == NO_ID else i, b - a, n, spans, hashlib.sha256(kept).hexdigest())
            if texts:
                row += ((part[~whole_characters(g, part)].tobytes() if n else kept).decode(),)
            if digests:
                row += (hashlib.sha256(part.tobytes()).hexdigest() if n else row[4],)
            rows.append(row)
        return batch(rows, **kinds)

    return visit(packed, [shared, windows], run, schema)


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents without repeated passages, all columns kept; n_chars, where there is one, is that
    of the new text. Blocks carry ids and texts only, so new texts are joined back by doc_id, null or not,
    and the old text's digest: what a row loses depends on these two only."""
    names = docs.columns
    given, null_id, digest, new_text = ("_" * max(map(len, names)) + c for c in ("given", "null_id", "digest", "new_text"))

    def keyed(df: DataFrame) -> DataFrame:
        i = F.col("doc_id").cast("long")
        return df.withColumns({given: F.coalesce(i, F.lit(0).cast("long")), null_id: i.isNull(), digest: F.sha2(F.col("text").cast("string").cast("binary"), 256)})

    cut = dedup(docs, texts=True, digests=True).filter("n_removed > 0")
    new = cut.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias(given), F.col("doc_id").isNull().alias(null_id), F.col("old_sha256").alias(digest), F.col("kept_text").alias(new_text))
    joined = keyed(docs).join(new.dropDuplicates([given, null_id, digest]), [given, null_id, digest], "left")
    text = F.coalesce(new_text, F.col("text"))
    put = {"text": text.alias("text")}
    if "n_chars" in names:
        put["n_chars"] = F.when(F.col("text").isNotNull(), F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return joined.select(*[put.get(c, F.col(c)) for c in names])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
