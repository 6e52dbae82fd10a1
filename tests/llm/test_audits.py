"""Toxicity, source divergence and filter interactions against plain code."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gabbro.llm import filter_interactions as fi
from gabbro.llm import source_divergence as sd
from gabbro.llm import subword_toxicity as tox

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, term string"


def frame(spark, rows):
    """Documents with extra columns that clash with those of the operators."""
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS)


# ------------------------------------------------------------------ source divergence


def plain_audit(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, n, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = term.findall((text or "").translate(low))
        df.update((lang, w) for w in set(words))
        n.update((lang, source, w) for w in words)
    out = []
    for lang in {g for g, _ in groups}:
        kept = [w for (g, w), c in df.items() if g == lang and c >= least]
        sources = sorted(s for g, s in groups if g == lang)
        count = {s: {w: n[lang, s, w] for w in kept} for s in sources}
        whole = {w: sum(count[s][w] for s in sources) for w in kept}
        share = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p, q = {s: share(count[s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in sources if o != s]
            terms = [(w, f(p[s][w], q[w])) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:most])]
    return sorted(out)


def test_divergence_equals_plain_code(spark):
    rng = random.Random(4)
    words = "Alpha beta GAMMA délta Ünit ünit it's x9y 漢字 \U0001f600 z\x00w".split(" ")
    rows = [(i % 150, " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None, "z" * 40])) for i in range(300)]
    rows += [(None, None, None, None), (7, "", "de", "only"), (8, "rare words here", "it", "p"), (9, None, "it", "q"), (1, "beta " * 30_000, "en", "a")]
    rows += [(500 + i, "hot hot beta", "en", "a") for i in range(150)]  # a third of the rows in one group
    got = [tuple(r) for r in sd.audit(frame(spark, rows), 10, 4).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == plain_audit(rows, 10, 4)


def test_divergence_without_vocabulary_or_rows(spark):
    rows = [(1, "a b", "en", "s"), (2, "c", "en", "t"), (3, None, "en", "u"), (4, "d", "fr", None)]
    got = sorted(tuple(r) for r in sd.audit(frame(spark, rows)).collect())
    assert got == [("en", a, "pair", b, 0, k + 1) for a in "stu" for k, b in enumerate(x for x in "stu" if x != a)]
    assert sd.audit(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("count", "total", "terms"), [(0, 0, 1), (8_000_000_000_000, 8_000_000_000_001, 90_000_000), (5, 7, 2), (10**12, 10**12, 1)])
def test_shares_are_exact_beyond_a_product_of_64_bits(spark, count, total, terms):
    cols = [sd.F.lit(x).cast("long") for x in (count, total, terms)]
    assert spark.range(1).select(sd.share(*cols)).first()[0] == 1 + 10**9 * (count + 2) // (total + 2 * terms)


# ------------------------------------------------------------------ filter interactions


def plain_interactions(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    parts = defaultdict(list)
    for i, text, _, source in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text]}
        parts[source or ""].append(({k for k, v in fails.items() if v}, i in good, i in bad))
    out = []
    for part, docs in parts.items():
        mine, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, x in enumerate(order):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                shapley[x] += len(gone)
                mine.append((part, "".join(order), k + 1, len(left), len(gone), sum(x in d[0] for d in docs) - len(gone), sum(d[0] == {x} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in mine]
    return sorted(out)


def test_interactions_equal_plain_code(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(rng.choice([5, 300]))] + ["UP", "a|b", "é#"][: rng.randint(0, 3)], k=rng.choice([3, 49, 50, 60, 90]))) for _ in range(40)]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), "en", rng.choice(["s", "t", "", None])) for _ in range(150)]
    rows += [(i, "copy of one text", "en", "s") for i in range(100, 170)] + [(i, None if i % 2 else "", None, "u") for i in range(200, 206)] + [(None, None, None, None), (3, "word " * 100_000, "en", "t")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 160, 2), 4, 4, None]]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = fi.interactions(fi.mask_cells(frame(spark, rows), known)).select("part", "filter_order", "step", *fi.COLUMNS)
    assert sorted(tuple(r) for r in got.collect()) == plain_interactions(rows, labels)
    assert fi.interactions(fi.mask_cells(frame(spark, []), known)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_swaps_visit_each_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for i in fi.transpositions(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.add(tuple(order))
    assert len(seen) == len(list(itertools.permutations(range(n)))) == 1 + sum(1 for _ in fi.transpositions(n))


# ------------------------------------------------------------------ toxicity

BAD = ["grubber", "snivel", "blotsam", "wretchik"]


def made_texts(rng, n):
    """Texts of 5 to 60 invented words; a quarter holds a bad word or more."""
    part = ["ra", "lo", "mi", "ten", "sor", "ka", "vel", "du"]
    rows = []
    for i in range(n):
        w = ["".join(rng.choices(part, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            for _ in range(1 + len(w) // 15):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", ".", "!!"]))
        rows.append((i, " ".join(w), "en", "s"))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = made_texts(random.Random(3), 600)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)] + [(9999, 1, 1), (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    return rows, labels, tox.train(frame(spark, rows), labels, tox.Settings(steps=60))


def test_toxic_words_and_misspellings_never_seen(learned):
    _, _, model = learned
    scorer, rng = tox.Scorer(model), random.Random(77)
    clean = [scorer.logit(t) for i, t, *_ in made_texts(rng, 200) if i % 4]
    bad = [scorer.logit(t) for i, t, *_ in made_texts(rng, 200) if i % 4 == 0]
    line = np.log(0.3 / 0.7)
    assert np.mean(np.array(bad) >= line) > 0.95 and np.mean(np.array(clean) >= line) < 0.05
    for typo in ("grubbber", "snivell", "blottsam", "wretchikk", "GRUBBERS"):
        assert scorer.logit(f"ra lomi tensor {typo} kavel du mi") >= line


def test_gradients_are_those_of_the_loss():
    """One step's errors against differences of the loss, through plain dense products."""
    s = tox.Settings(buckets=64, steps=1, least_docs=1)
    vocabulary = ["ab", "abc", "x", "!!"]
    rng = np.random.default_rng(1)
    weight = rng.normal(0, 1, 64)
    bags = np.zeros((4, 64))
    for i, w in enumerate(vocabulary):
        for b in tox.subwords(w, s):
            bags[i, b] += 1 / len(tox.subwords(w, s))
    scorer = tox.Scorer(tox.Model(weight, 0.3, s))
    for text in ("ab abc x !!", "ab ab X", "!!", "abc, (abc) ab"):
        words = [w.strip("!,()") or "!!" for w in text.lower().split()]
        want = 0.3 + np.mean([bags[vocabulary.index(w)] @ weight for w in words])
        assert scorer.logit(text) == pytest.approx(want)


def test_scores_of_odd_texts(spark, learned):
    rows, labels, model = learned
    odd = [(None, "ra lo grubber", None, None), (-1, None, "en", None), (-2, "", "en", "s"), (-3, " \n\t", "en", "s"), (-4, "!!! ***", "en", "s"), (-5, "é" * 50_000, "en", "s"), (-6, "ra lo mi " * 60_000, "en", "s"), (-7, "ra ra", "en", "s"), (-7, "ra ra", "en", "s")]
    got = tox.score(frame(spark, odd), model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (-1, -2, -3)}) == 1
    assert tox.score(frame(spark, []), model).count() == 0
    few = tox.train(frame(spark, rows[:5]), labels)
    assert not len(few.weight) and len({r.score for r in tox.score(frame(spark, odd), few).collect()}) == 1
    assert tox.train(frame(spark, []), labels).bias == 0.0


def test_reruns_and_row_order_agree(spark, learned):
    rows, labels, model = learned
    again = tox.train(frame(spark, list(reversed(rows)) + rows[:50]).repartition(7), labels, tox.Settings(steps=60))
    assert np.allclose(again.weight, model.weight)


def test_held_out_labels_are_not_learned_from(spark, learned):
    rows, labels, model = learned
    F = tox.F
    turned = labels.withColumn("toxic", F.when(tox.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.allclose(tox.train(frame(spark, rows), turned, tox.Settings(steps=60)).weight, model.weight)


def test_the_workers_words_are_bounded(learned, monkeypatch):
    monkeypatch.setattr(tox, "MEMORY", 10_000)
    scorer, free = tox.Scorer(learned[2]), tox.Scorer(learned[2])
    for _, text, *_ in made_texts(random.Random(6), 100):
        assert scorer.logit(text) == free.logit(text)
        assert scorer.held <= 10_000
