"""Held-out accuracy and edge cases of the quality and toxicity scores."""

import pytest
from pyspark.sql import functions as F
from tremor.llm import quality_model as Q
from tremor.llm import toxicity as X

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("query", "label", "least"), [(Q.op1_quality_model, "quality", 0.97), (X.op9_toxicity, "toxic", 0.93)])
def test_held_out_accuracy(spark, query, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = query(spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    right, score = out.where("held_out").join(labels, "doc_id").select(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.corr("score", label)).first()
    assert right >= least and score > 0.5


@pytest.mark.parametrize(("scores", "label"), [(Q.quality_scores, "quality"), (X.toxicity_scores, "toxic")])
def test_edges(spark, scores, label):
    schema = "doc_id bigint, text string, score string, label int"
    good, bad = "Calm words in a plain line, and more of them. ", "### $$$ IDIOT !!! | "
    rows = [(i, (good if i % 2 else bad) * 3, "clash", 9) for i in range(40)] + [(None, good, "x", 1), (41, None, "x", 1), (42, "", "x", 1), (1, good * 3, "x", 1), (43, good * 20_000, "x", 1)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, (i % 2 if label == "quality" else 1 - i % 2), "x") for i in range(40)] + [(1, None, "x"), (99, 1, "x"), (None, 0, "x")], f"doc_id bigint, {label} int, text string")
    got = scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert (by[1] > by[0]) == (label == "quality")
    none = scores(docs, labels.where("false")).collect()
    assert len({r.score for r in none}) == 1
    assert scores(docs.where("false"), labels).count() == 0


def test_folding_and_exceptions():
    machine = X.automaton({" idiot": 3.0, " scum ": 2.0}, {" idiotic sum "})
    assert X.fold("Ӏ 1d10t, ѕсum!") == f" {'Ӏ'.lower()} idiot scum "
    assert X.features(machine, "1D10TS and ѕсum")[1] == pytest.approx(X.math.log1p(5))
    assert X.features(machine, "scumble")[1] == 0
    assert X.features(machine, "an idiotic sum")[1] == 0


def test_quality_features_of_nothing():
    assert Q.features(b"") == Q.features(b" \n") == [0.0] * len(Q.NAMES)


def test_a_match_anywhere_in_an_exception_phrase_counts_nothing():
    machine = X.automaton({" kill": 3.0}, {" the killing floor "})
    assert X.features(machine, "on the Killing floor")[1] == 0
    assert X.features(machine, "on the killing floor, killing")[1] == X.features(machine, "killing")[1] > 0
    assert X.phrases(X.automaton({" kill": 3.0}, set()), X.fold("a b killing c")) == {" b killing ", " killing c ", " a b killing ", " b killing c "}


def test_phrases_are_learnt_as_exceptions(spark):
    rows = [(i, f"you scum number{i} go", 1) for i in range(30)] + [(100 + i, f"the scum line of tank{i}", 0) for i in range(12)] + [(200 + i, f"calm text {i}", 0) for i in range(400)]
    sample = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    weights, words = X.learn_lexicon(sample)
    learnt = X.learn_phrases(sample, weights, words)
    assert any(" scum ".startswith(x) for x in weights) and " scum line " in learnt and " you scum " not in learnt
    machine = X.automaton(weights, words | learnt)
    assert X.features(machine, "a scum line")[1] == 0 < X.features(machine, "you scum")[1]


def brute_quality(docs, labels):
    """The ranking from its definition: gradient steps on pairs, no shared code but the features."""
    import zlib

    import numpy as np

    known = [(label, Q.features((docs[i] or "").encode())) for i, label in labels.items() if i in docs and label in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    good, bad = (np.array([x for y, x in known if y == k]) for k in (1, 0))
    draw, w = np.random.default_rng(5), np.zeros(good.shape[1])
    pairs = good[draw.integers(0, len(good), 4000)] - bad[draw.integers(0, len(bad), 4000)]
    for _ in range(3000):
        w += 0.5 * (pairs * (1 / (1 + np.exp(pairs @ w)))[:, None]).mean(axis=0) - 0.5 * 0.5 * w / 4000
    return {i: float(np.array(Q.features((t or "").encode())) @ w) for i, t in docs.items()}


def test_quality_ranks_like_brute_force(spark, sf):
    import numpy as np

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    want = brute_quality(docs, labels)
    got = {r.doc_id: r.score for r in Q.op1_quality_model(spark, sf).collect()}
    order = lambda x: np.argsort(np.argsort([x[i] for i in sorted(x)]))
    assert np.corrcoef(order(want), order(got))[0, 1] > 0.9


def plain_toxicity(weights, exceptions):
    """Features of a text by plain string search, word by word for the readings of signs."""
    import math

    def best(folded):
        spans = [(k, k + len(e)) for e in exceptions if e in folded for k in range(len(folded)) if folded.startswith(e, k)]
        out = {}
        for entry, weight in weights.items():
            k = folded.find(entry)
            while k >= 0:
                if not any(a <= k and k + len(entry) <= b for a, b in spans):
                    out[k] = max(weight, out.get(k, 0))
                k = folded.find(entry, k + 1)
        return out

    def total(folded):
        a, b = best(folded), best(folded.translate(X.BARE))
        return sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)

    def run(text):
        sum_of_all = total(X.fold(text))
        for word in text.split():
            word = word.strip(X.EDGES)
            if any(c in "$!|+1" for c in word) and any(c.isalpha() for c in word):
                signs = word.replace("$", "s").replace("!", "i").replace("+", "t")
                others = [total(X.fold(signs.replace("|", "i"))), total(X.fold(signs.replace("|", "l").replace("1", "l")))]
                sum_of_all += max(0, max(others) - total(X.fold(word)))
        return [math.log1p(sum_of_all), math.log1p(1000 * sum_of_all / (X.fold(text).count(" ") + 20))]

    return run


def test_toxicity_scores_like_a_plain_search(spark):
    """The query's scores of all documents, against plain search with the learnt lexicon and a curve fitted to it."""
    import numpy as np

    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    sample = X.labelled(docs, labels, "toxic", 3, 1, X.FIT_ROWS)
    weights, words = X.learn_lexicon(sample)
    exceptions = words | X.learn_phrases(sample, weights, words)
    assert weights
    features = plain_toxicity(weights, exceptions)
    x = {r.doc_id: features(r.text or "") for r in docs.collect()}
    fit = sorted((r.label, [1.0, *x[r.doc_id]]) for r in sample.select("label", "doc_id").collect())
    got = {r.doc_id: r.score for r in X.op9_toxicity(spark, SF).collect()}
    assert got.keys() == x.keys()
    w = X.logistic(np.array([v for _, v in fit]), np.array([y for y, _ in fit], float), 0.1)
    for i, v in x.items():
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(w @ [1.0, *v], -30, 30))), abs=1e-6)


def test_toxicity_by_plain_search_of_odd_words():
    weights, exceptions = {" idiot": 3.0, " kill": 2.5, " shit ": 4.0, " ass ": 1.5, " réeux": 2.0}, {" kilt ", " killing floor "}
    features, machine = plain_toxicity(weights, exceptions), X.automaton(weights, exceptions)
    words = "an ïdiot 𝐢𝐝𝐢𝐨𝐭 a$$ sh!t ki11 ki|| k!ll idiot! $100 US$5 Home|idiot réeuxa reeuxa 1d!0t a+b c++ killing floor sh!t! 1 + $ kil1ing -- Élan đ $h1t".split()
    for k in range(200):
        text = " ".join(words[(k * 7 + j * (k + 3)) % len(words)] for j in range(k % 12))
        assert X.features(machine, text)[1:] == pytest.approx(features(text)), text


@pytest.mark.parametrize("text", ["ïdiot", "𝐢𝐝𝐢𝐨𝐭", "🅸🅳🅸🅾🆃", "i\u0336d\u0336i\u0336o\u0336t", "1d!0t", "ｉｄｉｏｔ", "ідіот".replace("д", "d").replace("т", "t"), "(id|ot)", "i\u200bdiot"])
def test_disguises_of_one_word(text):
    machine = X.automaton({" idiot ": 3.0}, set())
    assert X.features(machine, text)[1] == pytest.approx(X.math.log1p(3.0))
    assert X.features(machine, "radio idol idi0+x")[1] == 0


@pytest.mark.parametrize(("text", "entry"), [("a$$", " ass "), ("$hit!", " shit "), ("sh!t", " shit "), ("ki11", " kill "), ("ki||er", " kill"), ("K!LL", " kill ")])
def test_signs_as_letters(text, entry):
    assert X.features(X.automaton({entry: 3.0}, set()), f"so {text} so")[1] == pytest.approx(X.math.log1p(3.0))


def test_signs_that_are_none():
    machine = X.automaton({" idiot": 3.0, " kill": 3.0, " wowi": 3.0, " sioo": 3.0}, set())
    assert X.features(machine, "Wow! $100 + 5 | 200 !!! | +")[1] == 0
    assert X.features(machine, "idiot!|moron")[1] == X.features(machine, "idiot moron")[1]
    assert X.features(machine, "x" * 500_000 + "!y" * 200_000)[1] == 0


def test_labels_that_contradict_each_other_and_texts_of_one_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "c"), (None, "d")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (2, 0, "x"), (3, 7, "x"), (3, None, "x"), (None, 1, "x"), (9, 1, "x")], "doc_id bigint, toxic int, text string")
    got = {tuple(r) for r in X.labelled(docs, labels, "toxic", 1, 1, 10).select("doc_id", "text", "label").collect()}
    assert got == {(1, "a", 1), (2, None, 0)}
