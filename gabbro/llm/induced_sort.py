"""Suffix arrays and common prefixes by external induced sorting.

The text's suffixes are of type S or L (smaller or larger than the next one). The suffixes at the left
ends of S runs (LMS) are sorted first: their substrings are named in order, and the string of names,
at most half as long, is sorted by the same procedure. All L suffixes are then induced from them in
rising order and all S suffixes from the L ones in falling order: taking a suffix from the queue puts
the one before it back, under its first symbol.

A queue entry is a suffix tuple: its position, and what it has in common with the entry before it under
the same symbol. Of two suffixes put back one after the other under a symbol, that is one more than the
least value passed between the two that made them, so common prefixes need no look at the text. Where
the recursion returns, common prefixes in names become lengths in the text: the names' own length, and
then the least common prefix of neighbouring names between the two that differ.

The queue is bulk: entries wait in ranges of symbols; beyond `most` entries in memory all ranges are
appended to files, and so are the sorted runs that leave it. Entries leave in the longest run that
can't receive one of the entries it makes. Common prefixes are counted up to CAP.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

CAP = 250
BASE = 1 << 19  # names that the recursion's end sorts in memory
NEVER = np.uint8(255)


class Stats:
    """What a sort did: entries written to files, deepest recursion."""

    def __init__(self) -> None:
        self.spilled, self.depth = 0, 0


class Folder:
    """A temporary folder of one sort, made when the first file is: a task's own, redone with the task."""

    def __init__(self) -> None:
        self.made: tempfile.TemporaryDirectory | None = None
        self.count = 0

    def path(self) -> str:
        if self.made is None:
            self.made = tempfile.TemporaryDirectory(prefix="induced-")
        self.count += 1
        return os.path.join(self.made.name, f"{self.count}")

    def close(self) -> None:
        if self.made is not None:
            self.made.cleanup()


class Runs:
    """Rows of arrays appended one after another, in files once spilled."""

    def __init__(self, kinds: tuple, folder: Folder, stats: Stats):
        self.kinds, self.folder, self.stats = kinds, folder, stats
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0
        self.file: str | None = None

    def add(self, *row: np.ndarray) -> None:
        self.held.append(row)
        self.size += len(row[0])

    def spill(self) -> None:
        if not self.held:
            return
        if self.file is None:
            self.file = self.folder.path()
        for k in range(len(self.kinds)):
            with open(f"{self.file}.{k}", "ab") as f:
                for row in self.held:
                    f.write(row[k].tobytes())
        self.stats.spilled += self.size
        self.held, self.size = [], 0

    def take(self) -> list[np.ndarray]:
        """All of them, in order; the files go."""
        parts = [[row[k] for row in self.held] for k in range(len(self.kinds))]
        if self.file is not None:
            for k, kind in enumerate(self.kinds):
                parts[k].insert(0, np.fromfile(f"{self.file}.{k}", kind))
                os.remove(f"{self.file}.{k}")
        self.held, self.size, self.file = [], 0, None
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, self.kinds)]


class BulkQueue:
    """Suffix tuples by range of symbols, each range in order of arrival; spills when it holds too many."""

    def __init__(self, ranges: int, most: int, folder: Folder, stats: Stats):
        self.parts = [Runs((np.int64, np.int32), folder, stats) for _ in range(ranges)]
        self.most, self.held = most, 0

    def push(self, at: np.ndarray, tuples: np.ndarray, key: np.ndarray) -> None:
        """Entries sorted by range."""
        cut = (np.flatnonzero(at[1:] != at[:-1]) + 1).tolist()
        for i, j in zip([0, *cut], [*cut, len(at)]):
            self.parts[at[i]].add(tuples[i:j], key[i:j])
        self.held += len(tuples)
        if self.held > self.most:
            for p in self.parts:
                p.spill()
            self.held = 0

    def pop(self, k: int) -> list[np.ndarray]:
        self.held -= self.parts[k].size
        return self.parts[k].take()


def stable_order(x: np.ndarray, span: int) -> np.ndarray:
    """Stable order of numbers in [0, span): radix passes of 16 bits."""
    if span <= 1 << 16:
        return np.argsort(x.astype(np.uint16), kind="stable")
    if span > 1 << 32:
        return np.argsort(x, kind="stable")
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((x >> 16).astype(np.uint16)[order], kind="stable")]


class RangeMin:
    """Least value of ranges of an array of uint8, up to a length."""

    def __init__(self, v: np.ndarray, longest: int):
        self.n = len(v)
        levels = [v]
        half = 1
        while 2 * half <= longest:
            low = levels[-1].copy()
            np.minimum(low[:-half], low[half:], out=low[:-half])
            levels.append(low)
            half *= 2
        self.flat = np.concatenate(levels) if len(levels) > 1 else v

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of [first, last], both in it."""
        level = LOG2[np.minimum(last - first + 1, LOG2.size - 1)] if self.n < LOG2.size else np.log2(last - first + 1).astype(np.int64)
        at = level * self.n
        return np.minimum(self.flat[at + first], self.flat[at + last + 1 - (1 << level)])


LOG2 = np.log2(np.maximum(np.arange(1 << 16), 1)).astype(np.int64)


def range_min(v: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return RangeMin(v, int((last - first).max()) + 1)(first, last) if len(first) else np.zeros(0, np.uint8)


def induce(seeds: np.ndarray, seed_lcp: np.ndarray, key: np.ndarray, want: np.ndarray, alike: np.ndarray, most: int, folder: Folder, stats: Stats) -> tuple[np.ndarray, np.ndarray]:
    """Seeds, in order of key, and all that follow from them, in order, with what each has in common with
    the one before it. The position before a taken one follows if wanted; its key is then not smaller.
    Within a key seeds come last. alike: how many equal symbols begin at a position.

    A suffix tuple is one number, position * 256 + common prefix, beside its symbol."""
    n, symbols = len(key), int(key.max()) + 1
    whole = np.cumsum(np.bincount(key, minlength=symbols))
    step = max(256, int(n**0.5))  # about as many runs end at a range as within one
    at_range = np.minimum(whole - 1, n - 1) // step
    ends = np.flatnonzero(np.diff(at_range, append=at_range[-1] + 1))
    range_of = np.searchsorted(ends, np.arange(symbols), "left").astype(np.int32)
    begins = np.concatenate([[0], ends[:-1] + 1])
    # the symbol before each position, or none that is wanted
    prev = np.empty(n, np.int32)
    prev[0] = symbols
    prev[1:] = np.where(want[:-1], key[:-1], symbols)
    seed_key = key[seeds]
    seeds = seeds << 8 | seed_lcp
    queue = BulkQueue(len(ends), most, folder, stats)
    out = Runs((np.int64,), folder, stats)
    # the least value since a symbol's last entry was made: that run and the least value of its rest, and
    # for each value the last run with one as small
    last_run, rest_of_run, small, run = np.zeros(symbols, np.int32), np.zeros(symbols, np.uint8), np.full(256, -1), 0
    seed_cut = np.concatenate([[0], np.searchsorted(seed_key, ends, "right")])
    last_pos, last_key, last_seed = -1, -1, False
    for k in range(len(ends)):
        low, high = int(begins[k]), int(ends[k])
        e, rank = queue.pop(k)
        a, b = seed_cut[k], seed_cut[k + 1]
        if a == b and not len(e):
            continue
        rank = 2 * (rank - np.int32(low))
        if b > a:
            e, rank = np.concatenate([e, seeds[a:b]]), np.concatenate([rank, 2 * (seed_key[a:b] - np.int32(low)) + np.int32(1)])
        span = 2 * (high - low + 1)
        if span > 2:
            order = stable_order(rank, span)
            e, rank = e[order], rank[order]
        look = 1024
        while len(e):
            # the longest run of which none comes after an entry that the run has made
            y = prev[e[:look] >> 8]
            bad = rank[1 : len(y)] > 2 * (np.minimum.accumulate(y)[:-1] - low)
            m = int(bad.argmax()) + 1 if bad.any() else len(y)
            look = 4 * look if m == len(y) else max(1024, 2 * m)
            taken, r = e[:m], rank[:m]
            p, c = taken >> 8, taken.astype(np.uint8)
            # the first of a key has nothing in common, its first seed as many equal symbols as both begin with
            turn = np.flatnonzero(r[1:] != r[:-1]) + 1
            if len(turn):
                c[turn] = 0
                turn = turn[(r[turn] >> 1) == (r[turn - 1] >> 1)]
                c[turn] = np.minimum(alike[p[turn]], alike[p[turn - 1]])
            if (r[0] >> 1) + low != last_key:
                c[0] = 0
            elif r[0] & 1 and not last_seed:
                c[0] = min(alike[p[0]], alike[last_pos])
            last_pos, last_key, last_seed = int(p[-1]), int(r[-1] >> 1) + low, bool(r[-1] & 1)
            out.add(taken & ~255 | c)
            if out.size > most:
                out.spill()
            src = np.flatnonzero(y[:m] < symbols)
            e, rank = e[m:], rank[m:]
            run += 1
            least_c = int(c.min())
            if not len(src):
                small[least_c:] = run
                continue
            new_key = y[src]
            least = int(new_key.min())
            order = stable_order(new_key - least, int(new_key.max()) - least + 1)
            src, new_key = src[order], new_key[order]
            first = np.concatenate([[True], new_key[1:] != new_key[:-1]])
            at_first = np.flatnonzero(first)
            value = np.empty(len(src), np.uint8)
            fresh = new_key[at_first]
            between = np.minimum(np.searchsorted(small, last_run[fresh], "right"), 255)
            value[at_first] = np.minimum(np.minimum(rest_of_run[fresh], between), np.minimum.accumulate(c)[src[at_first]])
            rest = np.flatnonzero(~first)
            value[rest] = range_min(c, src[rest - 1] + 1, src[rest])
            value = np.minimum(value, CAP - 1) + np.uint8(1)
            small[least_c:] = run
            at_last = np.append(at_first[1:], len(src)) - 1
            after = np.append(np.minimum.accumulate(c[::-1])[::-1], NEVER)
            last_run[fresh], rest_of_run[fresh] = run, after[src[at_last] + 1]
            new = (p[src] - 1) << 8 | value
            here = int(np.searchsorted(new_key, high, "right"))
            if here < len(new):
                queue.push(range_of[new_key[here:]], new[here:], new_key[here:])
            if here:
                new_rank = 2 * (new_key[:here] - np.int32(low))
                if not len(e):
                    e, rank = new[:here], new_rank
                else:
                    at = np.searchsorted(rank, new_rank, "right") + np.arange(here)
                    old = np.ones(len(e) + here, bool)
                    old[at] = False
                    both, both_rank = np.empty(len(old), np.int64), np.empty(len(old), np.int32)
                    both[at], both_rank[at], both[old], both_rank[old] = new[:here], new_rank, e, rank
                    e, rank = both, both_rank
    [e] = out.take()
    return e >> 8, e.astype(np.uint8)


def name_substrings(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings, equal for equal ones and in their order."""
    n = len(t)
    length = np.diff(np.concatenate([lms, [n - 1]])) + 1
    sym = t.astype(np.int64) * 2 + s_type + 1  # 0 stands for "after the end"
    wide = max(1, 63 // max(1, int(sym.max()).bit_length()))
    bits = 63 // wide
    name = np.zeros(len(lms), np.int64)
    live = np.arange(len(lms))
    done = 0
    while len(live):
        packed = np.zeros(len(live), np.int64)
        for i in range(done, done + wide):
            at = lms[live] + i
            packed = packed << bits | np.where(i < length[live], sym[np.minimum(at, n - 1)], 0)
        order = np.lexsort((packed, name[live])) if done else np.argsort(packed)
        a, b = name[live][order], packed[order]
        new_group = np.concatenate([[True], a[1:] != a[:-1]])
        new = new_group | np.concatenate([[True], b[1:] != b[:-1]])
        # a name is the number of substrings before its group, so names of other groups stay valid
        first = np.flatnonzero(new)
        inside = np.arange(len(order)) - np.maximum.accumulate(np.where(new_group, np.arange(len(order)), 0))
        name[live[order]] = a + inside[first][np.cumsum(new) - 1]
        size = np.diff(np.concatenate([first, [len(order)]]))[np.cumsum(new) - 1]
        done += wide
        tied = live[order][size > 1]
        live = tied[length[tied] > done]
    return name


def common(t: np.ndarray, s_type: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols a and b with different LMS substrings have in common, until their types differ:
    what follows an equal symbol of different type depends on the suffix and not on the name."""
    out = np.full(len(a), CAP)
    live = np.arange(len(a))
    d = 0
    while len(live) and d < CAP:
        x, y = a[live] + d, b[live] + d
        same = t[x] == t[y]
        split = same & (s_type[x] != s_type[y])
        out[live[split]] = d + 1
        out[live[~same]] = d
        live = live[same & ~split]
        d += 1
    return out.astype(np.uint8)


def extended(v: np.ndarray, s_type: np.ndarray, alike: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Common prefixes v of suffixes p and q that end at an equal symbol of different type go on as far as
    the shorter of the two runs of that symbol."""
    at = np.maximum(v.astype(np.int64) - 1, 0)
    split = (v > 0) & (s_type[p + at] != s_type[q + at])
    return np.minimum(np.where(split, at + np.minimum(alike[p + at], alike[q + at]), v), CAP).astype(np.uint8)


def suffix_array(t: np.ndarray, most: int = 1 << 20, base: int = BASE) -> np.ndarray:
    """The suffixes of t in order: see sorted_suffixes."""
    return sorted_suffixes(t, most, base=base)[0]


def sorted_suffixes(t: np.ndarray, most: int = 1 << 20, stats: Stats | None = None, folder: Folder | None = None, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, what each has in common with the one before it, up to CAP) of a string of
    integers whose last symbol is its smallest and occurs once. A queue, and a sorted run, hold up to
    `most` entries in memory. Strings of names up to `base` end the recursion."""
    n = len(t)
    if n < 2:
        return np.arange(n), np.zeros(n, np.uint8)
    stats = stats or Stats()
    if folder is not None and n <= base:
        return doubled(t)
    stats.depth += 1
    if folder is not None:
        return _sorted(t, most, stats, folder, base)
    folder = Folder()
    try:
        return _sorted(t, most, stats, folder, base)
    finally:
        folder.close()


def doubled(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The end of the recursion, in memory: suffixes by ranks of prefixes of 1, 2, 4, ... symbols, and common
    prefixes by stepping back through these ranks."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    ranks, h = [], 1
    while True:
        rank = np.empty(n + 1, np.int64)
        if ranks:
            new = packed[order][1:] != packed[order][:-1]
        else:
            new = t[order][1:] != t[order][:-1]
        rank[order] = np.concatenate([[1], np.cumsum(new) + 1])
        rank[n] = 0
        ranks.append(rank)
        if rank[order[-1]] == n:
            break
        packed = rank[:n] << 32 | rank[np.minimum(np.arange(n) + h, n)]
        order = np.argsort(packed)
        h *= 2
    a, b = order[:-1], order[1:]
    same = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        equal = ranks[k][np.minimum(a + same, n)] == ranks[k][np.minimum(b + same, n)]
        same += equal << k
    return order, np.concatenate([[0], np.minimum(same, CAP)]).astype(np.uint8)


def _sorted(t: np.ndarray, most: int, stats: Stats, folder: Folder, base: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(t)
    t = t.astype(np.int32)
    up = np.sign(t[1:] - t[:-1])
    # equal symbols take the type of the next unequal one
    nxt = np.where(up != 0, np.arange(n - 1), n - 1)
    nxt = np.append(np.minimum.accumulate(nxt[::-1])[::-1], n - 1)
    s_type = np.ones(n, bool)
    s_type[:-1] = up[np.minimum(nxt[:-1], n - 2)] > 0
    alike = np.minimum(nxt - np.arange(n) + 1, CAP).astype(np.uint8)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    name = name_substrings(t, s_type, lms)
    order = stable_order(name, len(lms))
    new = np.concatenate([[True], name[order][1:] != name[order][:-1]])
    chief = lms[order[new]]
    between = np.concatenate([np.zeros(1, np.uint8), common(t, s_type, chief[:-1], chief[1:])])
    if new.all():
        lcp = between
        lcp[1:] = extended(lcp[1:], s_type, alike, chief[:-1], chief[1:])
    else:
        dense = np.empty(len(lms), np.int64)
        dense[order] = np.cumsum(new) - 1
        order, same = sorted_suffixes(dense, most, stats, folder, base)
        # as many equal names, then the least common prefix between the two names that differ
        x, y = order[:-1] + same[1:], order[1:] + same[1:]
        names = extended(range_min(between, dense[x] + 1, dense[y]), s_type, alike, lms[x], lms[y])
        lcp = np.zeros(len(lms), np.uint8)
        lcp[1:] = np.minimum(lms[y] - lms[order[1:]] + names, CAP)
    rising, have = induce(lms[order], lcp, t, ~s_type, alike, most, folder, stats)
    large = ~s_type[rising]
    rising, have = rising[large][::-1], have[large]
    want = s_type.copy()
    want[-1] = False  # the last symbol precedes nothing: position -1
    falling, have = induce(rising, np.concatenate([have[:1] * 0, have[1:][::-1]]), t.max() - t, want, alike, most, folder, stats)
    return np.concatenate([[n - 1], falling[::-1]]), np.concatenate([np.zeros(2, np.uint8), have[1:][::-1]])[:n]
