"""Quality rules by compression bands.

A text that zstandard shrinks far more than ordinary prose of its length is repetitive, one that it
hardly shrinks is noise. Both the whole text and its fixed chunks are compressed, the shorter last one
too, and each ratio (compressed bytes / bytes) has to lie inside a band that depends on the length
compressed.

Edge cases: null text = empty text, which has no words and so fails the base rules; a text shorter
than the first band has no ratio limit; repeated rows are judged one by one; an empty table gives an
empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gabbro.llm.common import as_bytes, slices, text_columns
from gabbro.tables import table

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Bands:
    """(least bytes, lowest ratio, highest ratio), by rising length, at the given zstandard level.
    Whole texts and chunks share the table: a ratio depends on the bytes compressed, not on what
    they are part of. A document goes when more than bad_chunks of its chunks, or more than bad_bytes
    in all its chunks together, are out of band; no chunk of the documents labelled good is."""

    level: int = 3
    chunk: int = 2048
    bad_chunks: float = 0.25
    bad_bytes: int = 2048
    limits: tuple[tuple[int, float, float], ...] = (
        (64, 0.66, 1.30),
        (128, 0.50, 1.05),
        (256, 0.50, 0.92),
        (512, 0.46, 0.82),
        (1024, 0.44, 0.74),
        (2048, 0.42, 0.68),
        (4096, 0.40, 0.64),
        (8192, 0.385, 0.62),
        (16384, 0.37, 0.60),
        (32768, 0.36, 0.58),
        (65536, 0.32, 0.58),
    )

    def inside(self, n: int, ratio: float) -> bool:
        at = [x for x in self.limits if x[0] <= n]
        return not at or at[-1][1] <= ratio <= at[-1][2]


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text in UTF-8."""
    words = raw.split()  # of bytes: at the six ASCII white-space characters only
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "surrogatepass"))
    symbols = sum(joined.count(c.encode()) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = 0
    if len(words) > WINDOW:
        wins = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(wins)) < len(wins):
            first: dict[tuple, int] = {}
            hit = np.zeros(len(words) + 1, np.int64)
            for i, w in enumerate(wins):
                j = first.setdefault(w, i)
                if j != i:
                    for k in (i, j):
                        hit[k] += 1
                        hit[k + WINDOW] -= 1 if k + WINDOW <= len(words) else 0
            repeat = int((np.cumsum(hit)[: len(words)] > 0).sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat


def verdict(raw: bytes, bands: Bands, press) -> tuple[float | None, int, int, bool]:
    """(ratio of the whole, chunks, chunks out of band, in band)."""
    if not raw:
        return None, 0, 0, True
    ratio = len(press(raw)) / len(raw)
    bad = chunks = out = 0
    if len(raw) > bands.chunk:
        for at in range(0, len(raw), bands.chunk):
            part = raw[at : at + bands.chunk]
            chunks += 1
            if not bands.inside(len(part), len(press(part)) / len(part)):
                bad += 1
                out += len(part)
    return ratio, chunks, bad, bands.inside(len(raw), ratio) and bad <= bands.bad_chunks * chunks and out <= bands.bad_bytes


def judge(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row for each document: the base counts, the ratio, its chunks and the verdict."""
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=bands.level).compress
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                rows = []
                for raw in as_bytes(batch.column("text")):
                    n, chars, symbols, dup, repeat = base_counts(raw)
                    failed = n < 10 or 100 * repeat > 20 * n
                    ratio, chunks, bad, fine = verdict(raw, bands, press)
                    rows.append((n, chars, symbols, dup, repeat, failed, fine and not failed, ratio, chunks, bad))
                cols = list(zip(*rows)) or [()] * 10
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                    names=[x.split()[0] for x in schema.split(", ")],
                )

    return text_columns(docs, "doc_id", "text").mapInArrow(run, schema)


def op5_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def quality_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns and the base verdict alone, which SQL can express."""
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {"op5_compression_rules": op5_compression_rules, "quality_rules_base": quality_rules_base}
ORACLE_SQL = {
    "quality_rules_base": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 3)) AS i)
), r AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), h AS (
  SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n FROM r, (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id
)
SELECT b.doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words,
  n_words < 10 OR 100 * coalesce(h.n, 0) > 20 * n_words AS base_failed
FROM b LEFT JOIN h ON b.doc_id = h.doc_id
"""
}
