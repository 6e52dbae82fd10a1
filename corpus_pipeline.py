"""A training corpus from documents: quality, near duplicates, repeated passages, mixture, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's docs. All stages but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gabbro.llm import bpe_automaton, mixture, ngram_join, quality_gbdt, suffix_dedup
from gabbro.llm.common import discard, tables_made, written
from gabbro.tables import table

#: Near duplicates: five words a shingle, a similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The classifier learns from the labelled ones among docs."""
    forest = quality_gbdt.train(docs, table(spark, sf_dir, "labels"))
    return quality_gbdt.keep_good(docs, forest)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return ngram_join.keep_one(docs, WORDS, PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has already are cut from the texts."""
    return suffix_dedup.cleaned(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixture.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    return bpe_automaton.digest_documents(docs, bpe_automaton.vocabulary_path())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", source_mix),
    ("BPE encoding", tokens),
]

#: A boosted classifier, a seeded sample and a tokenizer have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage wrote on its way goes when its result is there, and so does its input."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with tables_made() as made:
            docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(*[t for t in made if t is not docs], *before)
        before = [docs]
    return docs
