"""BPE encoding by a tokenization automaton, decoding by its arc labels.

The merges are compiled, one gadget after another, into a deterministic automaton whose arcs are
labelled with tokens: at first one state loops on every symbol; the gadget of a merge (u, v) -> w
gives the target of u's arcs its own copy without the v arc, and adds a w arc wherever u's arc and
then v's was possible. A sequence of tokens is the BPE encoding of its string exactly if it is a path.

A state is "the last token was u"; a gadget (u, v) at time j took v from all states that were targets of
u then. Tokens made later inherit: the target of w = (u, v) is v's target at w's time, and the arcs of w
are u's at w's time. So w may follow u exactly if no gadget (y, x), at a time j, has y on the right spine
of u and x on the left spine of w, each before its parent on the spine was made. In a gadget of (u, u)
the arc goes before w's arcs are added, so no w = (u, u) starts right after a u.

Explicit rows of that table would take states x tokens bits (hundreds of MB for 49,000 merges), so rows
are compressed, all of them when the automaton is compiled. Tokens are numbered along their left
derivation: x, then what begins with x by the time it was made. What a gadget (y, x) takes from a state
is then x itself and one run of numbers behind it: the tokens made from x at j or later. A row is the
sorted list of its runs of missing arcs; a transition is one binary search in it.

A word is encoded by walking the tokens' prefixes from positions that the automaton has reached, long
arcs first: a prefix of the word has one path only, so a position has one state, is expanded once, and
the walk is linear in the word for a bounded token length. No merge loop runs over the text.

Edge cases: null text = empty, with no tokens and the digests of the empty string; words of any
length (their states are arrays, not recursion); repeated rows are encoded one by one; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import array
import bisect
import functools
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gabbro.llm.common import slices, text_columns
from gabbro.tables import table

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, the others for 256, 257, ... in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(other)) for b in range(256)]


class Automaton:
    """The automaton of a merge list over an alphabet of symbols (strings). Tokens in `last` end a word:
    they have no arcs and no rows."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], last: frozenset[int] = frozenset()):
        self.ids = vocab
        self.label = {i: t for t, i in vocab.items()}
        size = max(vocab.values(), default=-1) + 1
        gadgets: dict[int, dict[int, int]] = {}  # u -> v -> time
        made: dict[int, tuple[int, int, int]] = {}  # token -> (u, v, time)
        for time, (a, b) in enumerate(merges):
            u, v = vocab[a], vocab[b]
            gadgets.setdefault(u, {}).setdefault(v, time)
            made.setdefault(vocab[a + b], (u, v, time))
        # numbers along the left derivation: a token, then those made from it in order of time
        longer: dict[int, list[int]] = {}
        for w, (u, _, _) in made.items():  # merges come in order of time
            longer.setdefault(u, []).append(w)
        self.number, behind = [0] * size, [0] * size
        todo, at = [(i, False) for i in sorted(vocab.values(), reverse=True) if i not in made], 0
        while todo:
            w, done = todo.pop()
            if done:
                behind[w] = at
                continue
            self.number[w] = at
            at += 1
            todo.append((w, True))
            todo += [(c, False) for c in reversed(longer.get(w, ()))]
        born = {u: [made[c][2] for c in cs] for u, cs in longer.items()}
        # what each gadget of u takes, in order of time: v, and the tokens made from v since
        taken: dict[int, tuple[list[int], np.ndarray]] = {}
        for u, vs in gadgets.items():
            rows = []
            for v, time in sorted(vs.items(), key=lambda x: x[1]):
                k = bisect.bisect_left(born.get(v, ()), time)
                later = self.number[longer[v][k]] if k < len(longer.get(v, ())) else behind[v]
                rows.append((self.number[v], self.number[v] + 1, later, behind[v]))
            taken[u] = (sorted(vs.values()), np.array(rows, np.int64))
        # a state's row: what the gadgets on its token's right spine took, each before its parent was made
        state, parts = [], []
        for u in vocab.values():
            if u in last:
                continue
            y, until = u, 1 << 60
            while True:
                if y in taken:
                    k = bisect.bisect_left(taken[y][0], until)
                    if k:
                        state.append((u, 2 * k))
                        parts.append(taken[y][1][:k].reshape(-1, 2))
                if y not in made:
                    break
                _, y, until = made[y]
        runs = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
        of = np.repeat(np.array([u for u, _ in state], np.int64), np.array([n for _, n in state], np.int64)) if state else np.zeros(0, np.int64)
        keep = runs[:, 0] < runs[:, 1]
        wide = at + 1  # rows one after another: runs of different states never touch
        low, high = runs[keep, 0] + of[keep] * wide, runs[keep, 1] + of[keep] * wide
        order = np.argsort(low, kind="stable")
        low, high = low[order], np.maximum.accumulate(high[order]) if len(order) else high
        new = np.concatenate([[True], low[1:] > high[:-1]]) if len(low) else np.zeros(0, bool)
        end = np.append(np.flatnonzero(new)[1:], len(low)) - 1
        self.wide = wide
        self.low, self.high = array.array("q", low[new].tobytes()), array.array("q", high[end].tobytes() if len(low) else b"")
        self.begin = np.searchsorted(low[new], np.arange(size + 1) * wide, "left").tolist()

    def follows(self, u: int, w: int) -> bool:
        """Whether the state after token u has an arc labelled w: a look into the state's row."""
        a = self.begin[u]
        at = self.number[w] + u * self.wide
        k = bisect.bisect_right(self.low, at, a, self.begin[u + 1]) - 1
        return k < a or at >= self.high[k]


class Encoder:
    """Pre-split words to token ids, for a vocabulary whose last symbol of a word carries a suffix."""

    #: Words kept; beyond these the word table starts anew (bounded memory, same results).
    KEEP = 300_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.auto = Automaton(model["vocab"], merges, frozenset(i for t, i in model["vocab"].items() if t.endswith(self.suffix)))
        self.symbol = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.splits = {top: re.compile(python_pattern(pattern, top)).findall for top in (0xFF, 0xFFFF, sys.maxunicode)}
        # tokens by their symbols: inner ones, and those that end a word
        self.inner: dict[str, int] = {}
        self.last: dict[str, int] = {}
        for t, i in model["vocab"].items():
            if t.endswith(self.suffix):
                self.last[t[: -len(self.suffix)]] = i
            else:
                self.inner[t] = i
        self.prefixes = {t[:k] for t in self.inner for k in range(1, len(t) + 1)}
        self.longest_last = max(map(len, self.last), default=1)
        self.ids_of: dict[str, str] = _Words(self)
        self.labels_of: dict[str, str] = {s: s for s in self.special}
        self.stand_in = {b: ord(c) for b, c in enumerate(self.symbol) if b != ord(c)}

    def encode_word(self, word: bytes) -> list[int]:
        """The arc labels of the one path over the word's symbols, then its end."""
        s = word.decode("latin-1").translate(self.stand_in)
        n = len(s)
        inner, prefixes, last, follows = self.inner, self.prefixes, self.last, self.auto.follows
        state = [-1] * (n + 1)  # the token that reaches a position
        reached = bytearray(n + 1)
        reached[0] = 1
        # depth first, longest arcs first: a position that is reached has its one state for good
        todo = [(0, 0, -1)]
        while not reached[n]:
            i, j, w = todo.pop()
            if j:
                if reached[j] or (i and not follows(state[i], w)):
                    continue
                reached[j], state[j] = 1, w
                if j == n:
                    break
                i = j
            j = i + 1
            while j < n:  # an inner token never holds the last symbol
                part = s[i:j]
                if part not in prefixes:
                    break
                w = inner.get(part)
                if w is not None:
                    todo.append((i, j, w))
                j += 1
            if n - i <= self.longest_last:
                w = last.get(s[i:])
                if w is not None:
                    todo.append((i, n, w))
        out, at = [], n
        while at:
            out.append(state[at])
            label = self.auto.label[state[at]]
            at -= len(label) - (len(self.suffix) if at == n else 0)
        return out[::-1]

    def split(self, text: str) -> list[str]:
        return self.splits[width(text)](text)

    def pieces(self, text: str) -> list[str]:
        """The pre-split words of a text, and its special tokens, in order."""
        if len(self.ids_of) >= self.KEEP:
            self.ids_of.clear()
            self.labels_of.clear()
            self.labels_of.update({s: s for s in self.special})
            self.ids_of.update({s: str(i) for s, i in self.special.items()})
        if not (self.cut and "<|" in text):
            return self.split(normalized(text))
        return [w for k, part in enumerate(self.cut.split(text)) for w in ([part] if k % 2 else self.split(normalized(part)))]

    def encode(self, text: str) -> list[int]:
        return [int(i) for w in self.pieces(text) for i in self.ids_of[w].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Arc labels joined by one space, as a vocabulary without a decoder reads."""
        special = {i: s for s, i in self.special.items()}
        return " ".join(special.get(i) or self.auto.label[i] for i in ids)


@functools.cache
def unicode_tables() -> tuple[dict[str, list[tuple[int, int]]], dict[int, int]]:
    """The character classes of the tokenizers library's regular expressions, as ranges, and the capitals whose lower case Python's tables lack. Unicode grows: Python's tables
    and the library's are of different years."""
    from tokenizers import Regex, normalizers

    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    classes = {}
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        held = sorted(map(ord, normalizers.Replace(Regex(f"[^{kind}]+"), "").normalize_str("".join(every))))
        cuts = [0, *(k for k in range(1, len(held)) if held[k] != held[k - 1] + 1), len(held)]
        classes[kind] = [(held[i], held[j - 1]) for i, j in zip(cuts, cuts[1:])]
    old = [c for c in every if c.lower() == c]
    new = normalizers.Lowercase().normalize_str("".join(old))
    return classes, {ord(c): ord(d) for c, d in zip(old, new) if c != d}


def width(text: str) -> int:
    """A bound of the string's code points: one, two bytes, or any."""
    if text.isascii():
        return 0xFF
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return 0xFFFF if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else sys.maxunicode
    return 0xFF


def python_pattern(pattern: str, top: int = sys.maxunicode) -> str:
    r"""A vocabulary file's pattern for Python's re, which lacks \p and has a wider \s, for strings of
    code points up to top: re looks small classes up in a table, but walks through large ones."""
    letters = r"[\p{L}]+|"
    if letters in pattern and pattern[0] == "'":  # the alternatives before it begin with no letter: the order is free
        pattern = letters + pattern.replace(letters, "", 1)
    for kind, ranges in unicode_tables()[0].items():
        pattern = pattern.replace(kind, "".join(f"\\U{a:08x}-\\U{min(b, top):08x}" for a, b in ranges if a <= top))
    return pattern


class _Words(dict):
    """Word -> its ids as text; a new word is encoded and its labels kept beside."""

    def __init__(self, enc: Encoder):
        self.enc = enc
        self.update({s: str(i) for s, i in enc.special.items()})

    def __missing__(self, word: str) -> str:
        ids = self.enc.encode_word(word.encode())
        label = self.enc.auto.label
        self[word] = text = " ".join(map(str, ids))
        self.enc.labels_of[word] = " ".join([label[i] for i in ids])
        return text


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker: its tables and words serve all tasks that run there."""
    return Encoder(path)


def normalized(text: str) -> str:
    """NFC, then lower case character by character (no rule for a final sigma)."""
    text = unicodedata.normalize("NFC", text)
    if width(text) > 0xFF:
        text = text.translate(unicode_tables()[1])
    if "Σ" in text:
        text = text.replace("Σ", "σ")
    return text.lower()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, token_ids, decoded."""
    return _run(docs, path, "doc_id long, token_ids array<int>, decoded string", _full)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, made in the worker: the ids of a
    corpus are larger than the corpus, so the digest query doesn't send them through the JVM."""
    return _run(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)


def _full(enc: Encoder, text: str) -> tuple:
    ids = enc.encode(text)
    return ids, enc.decode(ids)


def _digest(enc: Encoder, text: str) -> tuple:
    words = enc.pieces(text)
    ids = " ".join(map(enc.ids_of.__getitem__, words))
    labels = " ".join(map(enc.labels_of.__getitem__, words))
    n = ids.count(" ") + 1 if ids else 0
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(labels.encode()).hexdigest()


def _run(docs: DataFrame, path: str, schema: str, of) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string  # noqa: PLC2701
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                rows = [of(enc, t or "") for t in b.column("text").to_pylist()]
                cols = list(zip(*rows)) or [()] * (len(arrow) - 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:]))],
                    names=arrow.names,
                )

    return text_columns(docs, "doc_id", "text").mapInArrow(run, schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op8_bpe": op8_bpe}
