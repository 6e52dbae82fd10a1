"""Source divergence audit: how far the sources of a language are from each other and from the language.

Plain relational. Matches of a pattern are exploded and counted by (lang, source, term); the terms in
enough documents of a language are its vocabulary; its groups (lang, source) are crossed with it, so that
terms that a group lacks have a row of count 0; the dense rows meet on lang and term; distances are summed
and ranked. Counts become smoothed shares in integers (parts of SCALE, at least 1), so all arithmetic is
exact: a share takes three steps of long division by 1,000, which holds up to 9e15 terms.

Scale. The text is read once: a document gives a row for each distinct term, these are summed in the task and written as a row for each
(lang, source, term). Groups meet the vocabulary by language and a salt of the term, so that no language
is one task; the dense rows meet by term, where a group has one row, so a pair of groups meets once a term
(the work that the report asks for: vocabulary x pairs of sources). The distance is symmetric, and only one
direction is joined. The sums are made in the task before they are shuffled. Ranks to `top` are cut in
each task before the shuffle.

Edge cases: null text, lang and source are ''; a document is a row, also where ids repeat or are null; a
group without terms has shares like any other (all counts 0); a language without vocabulary gives its
pairs with value 0 and no terms; a language with one source has no pairs; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gabbro.llm.common import text_columns, written
from gabbro.tables import table

#: What is no part of a term: ASCII without its letters.
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Shares are parts of this number.
SCALE = 1_000_000_000


def terms_of(text: F.Column) -> F.Column:
    """The terms of a text in order; only A-Z are lower-cased."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, NO_TERM), "")


def counted(terms: F.Column) -> F.Column:
    """Structs (term, n) of the distinct terms of an array; null for none. The sorted array and the places
    where its runs start are bound by lambdas, so each is made once a row."""
    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    runs = lambda a: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))
    each = lambda a, s: F.transform(s, lambda i, k: F.struct(F.get(a, i).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(a)) - i).alias("n")))
    return let(F.sort_array(terms), lambda a: F.when(F.size(a) > 0, let(runs(a), lambda s: each(a, s))))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it)."""
    named = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    rows = text_columns(docs, "lang", "source", "text").select(*named, F.explode(counted(terms_of(F.col("text")))).alias("t"))
    return rows.groupBy("lang", "source", F.col("t.term").alias("term")).agg(F.sum("t.n").alias("n"), F.count("*").alias("docs"))


def share(count: F.Column, total: F.Column, terms: F.Column) -> F.Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), without a product beyond 64 bits: count + 2 is
    at most the divisor, so each step's remainder times 1,000 is its next numerator."""
    div = lambda a, b: F.call_function("div", a, b)
    by, rest, out = total + 2 * terms, count + 2, F.lit(0).cast("long")
    for _ in range(3):
        out, rest = out * 1000 + div(rest * 1000, by), (rest * 1000) % by
    return out + 1


def distance(p: F.Column, q: F.Column) -> F.Column:
    """floor((p - q)^2 / (p + q)); at most SCALE + 1 each, so the square holds in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has the other sources of the language, part
    `term` the terms that the source uses more than its language, up to rank `top`."""
    spark = docs.sparkSession
    named = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    counts = written(term_counts(docs), "divergence-counts")
    kept = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "term", "all_n"), "divergence-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    used = counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = text_columns(docs, "lang", "source").select(*named).distinct()
    groups = written(groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0), "divergence-groups")

    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dense = kept.withColumn("salt", salt).join(spread, ["lang", "salt"])
    filled = dense.join(counts.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    shares = written(
        filled.select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("all_n"), F.col("all_total"), F.col("v")).alias("q")), "divergence-shares"
    )

    other = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"))
    once = shares.select("lang", "term", "source", "p").join(other, ["lang", "term"]).filter(F.col("source") < F.col("item"))
    sums = once.groupBy("lang", "source", "item").agg(F.sum(distance(F.col("p"), F.col("p2"))).alias("value"))
    sums = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    mine = groups.select("lang", "source")
    pairs = mine.join(mine.select("lang", F.col("source").alias("item")), "lang").filter(F.col("source") != F.col("item"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))

    terms = shares.filter((F.col("n") > 0) & (F.col("p") > F.col("q")))
    terms = terms.select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    best = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(by).alias("rank")).filter(F.col("rank") <= top)
    return ranked.unionByName(best)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op12_source_divergence": op12_source_divergence}

_SHARE = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * {v})"
ORACLE_SQL = {
    "op12_source_divergence": rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM d) GROUP BY ALL),
f AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
k AS (SELECT f.lang, f.term, sum(n)::HUGEINT AS n FROM f JOIN c USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n, l.v, l.total AS all_total
  FROM g JOIN k ON g.lang = k.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM x GROUP BY ALL),
s AS (SELECT x.lang, x.source, term, n, {_SHARE.format(n='n', total='t.total', v='v')} AS p, {_SHARE.format(n='all_n', total='all_total', v='v')} AS q
  FROM x JOIN t ON x.lang = t.lang AND x.source = t.source),
w AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM s WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 10"""
}
