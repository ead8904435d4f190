"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: compatibility forms, lower case, homoglyphs and digit
substitutions to the letters that they stand for, everything else to blanks.
They are searched once more without diacritics, and words with a sign inside,
or with a 1, with the sign as a letter and the 1 as an l; the reading that
weighs most counts.  The lexicon is learnt from the plain reading.  It holds
beginnings of words, and whole words, that are much more frequent in toxic
documents of the labelled sample; each weighs its log odds.  Exceptions, words
and phrases of two or three words that hold an entry but are as common in
other documents, cancel the matches inside them.  The sum of weights, as it is
and by length, goes through a logistic curve fitted on the same sample.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import crc_of_id, labelled, logistic, table

FIT_ROWS = 20_000  # labelled documents that the lexicon is learnt from at most
MIN_TOXIC_DOCS, MIN_WEIGHT = 4, 2.3  # of an entry: documents, and log odds (ten times as frequent)
PREFIXES = range(3, 11)
EXCEPTION_DOCS, EXCEPTION_WEIGHT = 4, 1.0
PREDICT = 0.7

# Characters that look like a letter, digits that stand for one, and signs that may do so inside a word.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k", "η": "n", "ω": "w", "ɑ": "a", "ɡ": "g", "օ": "o", "ս": "u", "հ": "h", "ո": "n"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a"}
READINGS = [{"$": "s", "!": "i", "+": "t", "|": "i"}, {"$": "s", "!": "i", "+": "t", "|": "l", "1": "l"}]
HIDDEN = "​‌‍⁠﻿­"
BLANKS = " \t\n\x0b\x0c\r!\"#$%&'()*+,-./:;<=>?[\\]^_`{|}~«»“”„‘’…–—¡¿·• 　"
MARKS = [(0x0300, 0x0370), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100)]  # blocks of combining diacritics
LETTERS = [(0x00C0, 0x02B0), (0x1D00, 0x1D80), (0x1E00, 0x1F00), (0x2C60, 0x2C80), (0xA720, 0xA800), (0x1F100, 0x1F200)]  # of Latin letters


def _latin(diacritics: bool) -> dict[str, str]:
    """Letters by the Unicode names of their variants: those that decompose to a letter and
    diacritics, or all others (with a stroke or hook, small capital, in a square)."""
    name = re.compile(r"(?:.* )?(?:LATIN|SYMBOL) (?:SMALL |CAPITAL )?LETTER (?:SMALL CAPITAL |DOTLESS )?([A-Z])(?: WITH .*)?|REGIONAL INDICATOR SYMBOL LETTER ([A-Z])")
    found = {chr(c): name.fullmatch(unicodedata.name(chr(c), "")) for a, b in LETTERS for c in range(a, b)}
    return {c: (m[1] or m[2]).lower() for c, m in found.items() if m and bool(unicodedata.decomposition(c)) == diacritics}


FOLD = str.maketrans({**_latin(False), **HOMOGLYPHS, **DIGITS, **{chr(c): "" for a, b in MARKS for c in range(a, b)}, **dict.fromkeys(HIDDEN, ""), **dict.fromkeys(BLANKS, " ")})
BARE = str.maketrans(_latin(True))
SIGNED = re.compile(r"(?<!\S)[^\s$!|+1]*+[$!|+1]\S*+")
EDGES = BLANKS.replace("$", "")
SIGNS = [str.maketrans(x) for x in READINGS]


def fold(text: str) -> str:
    """Folded words, one blank before, between and after them."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return f" {' '.join(text.lower().translate(FOLD).split())} "


def readings(text: str) -> Iterator[tuple[str, list[str]]]:
    """(folded plainly, other readings) of each word with a letter and, inside, a sign or a 1.

    A dollar sign counts at a word's ends, too; others there are punctuation.
    """
    for found in SIGNED.finditer(text):
        word = found[0].strip(EDGES)
        if SIGNED.match(word) and any(map(str.isalpha, word)):
            plain = fold(word)
            others = {fold(word.translate(x)) for x in SIGNS}
            yield plain, sorted((others | {x.translate(BARE) for x in others}) - {plain})


def _candidates(folded: str) -> set[str]:
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        for k in PREFIXES:
            if k < len(word):
                out.add(f" {word[:k]}")
    return out


def _count(batches: Iterator) -> Iterator:
    import pyarrow as pa

    def rows():
        keys = list(counts.keys() | others.keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[k] for k in keys], pa.int64()), pa.array([others[k] for k in keys], pa.int64())], ["entry", "toxic", "other"])

    counts: Counter = Counter()
    others: Counter = Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            (counts if label else others).update(_candidates(fold(text or "")))
            if len(others) + len(counts) > 500_000:
                yield rows()
                counts.clear()
                others.clear()
    yield rows()


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], set[str]]:
    """(entries with weights, exceptions) from labelled documents."""
    n = dict(sample.groupBy("label").agg(F.count(F.lit(1))).collect())
    counts = sample.select("label", "text").mapInArrow(_count, "entry string, toxic bigint, other bigint").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("other") + 0.5) / (n.get(0, 0) + 1))
    counts = counts.where((F.col("toxic") >= MIN_TOXIC_DOCS) | F.col("entry").endswith(" ") & (F.col("other") >= EXCEPTION_DOCS)).withColumn("weight", odds)
    strong = counts.where((F.col("toxic") >= MIN_TOXIC_DOCS) & (F.col("weight") >= MIN_WEIGHT)).collect()
    # a longer entry that has nearly all documents of a shorter one is the more specific form of it
    support = {r[0]: r[1] for r in strong}
    vague = {e[:k] for e, n in support.items() for k in range(4, len(e)) if n >= 0.9 * support.get(e[:k], n + n)}
    weights: dict[str, float] = {}
    for entry, _, _, weight in sorted((r for r in strong if r[0] not in vague), key=lambda r: (len(r[0]), r[0])):
        # a shorter beginning that weighs nearly as much stands for this one
        if not any(weights.get(entry[:k], -9.0) >= weight - 0.7 for k in range(4, len(entry))):
            weights[entry] = weight
    roots = sorted({x[:4] for x in weights})
    weak = counts.where(F.col("entry").endswith(" ") & (F.col("other") >= EXCEPTION_DOCS) & (F.col("weight") < EXCEPTION_WEIGHT) & F.substring("entry", 1, 4).isin(roots)).select("entry").collect()
    exceptions = {r[0] for r in weak if any(r[0][:k] in weights for k in range(4, len(r[0]) + 1))}
    return weights, exceptions


def automaton(weights: dict[str, float], exceptions: set[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for entry, weight in weights.items():
        out.add_word(entry, (len(entry), weight))
    for entry in exceptions:
        out.add_word(entry, (len(entry), None))
    out.make_automaton()
    return out


def matches(machine, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the entries found, but for those that lie inside an exception."""
    if not len(machine):
        return []
    found, free = [], []
    for end, (size, weight) in machine.iter(folded):
        (free if weight is None else found).append((end - size + 1, end, weight))
    if free and found:
        free = sorted((a, b) for a, b, _ in free)
        starts, reach = [a for a, _ in free], list(accumulate((b for _, b in free), max))
        found = [x for x in found if not (k := bisect_right(starts, x[0])) or reach[k - 1] < x[1]]
    return found


def strength(machine, folded: str) -> float:
    """The sum of weights, with and without diacritics; of the entries that begin one word the strongest counts."""
    best: dict[int, float] = {}
    for reading in [folded] if folded.isascii() else {folded, folded.translate(BARE)}:
        for a, _, weight in matches(machine, reading):
            best[a] = max(weight, best.get(a, 0.0))
    return sum(best.values())


def features(machine, text: str) -> list[float]:
    """Weights found, as they are and by length; a match inside an exception counts nothing.

    Other readings of a word are tried by themselves, so that only exceptions
    of one word hold for them."""
    folded = fold(text)
    total = strength(machine, folded)
    for plain, others in readings(text):
        most = max((strength(machine, x) for x in others), default=0.0)
        if most:
            total += max(0.0, most - strength(machine, plain))
    return [1.0, math.log1p(total), math.log1p(1000 * total / (folded.count(" ") + 20))]


def phrases(machine, folded: str) -> set[str]:
    """The runs of two and three words with a match."""
    words = folded.split()
    out = set()
    place, at = 0, 0  # the word that begins behind the blank at ``at``
    for a in sorted({a for a, _, _ in matches(machine, folded)}):
        while at < a:
            at += len(words[place]) + 1
            place += 1
        for n in (2, 3):
            for k in range(max(0, place - n + 1), min(place, len(words) - n) + 1):
                out.add(f" {' '.join(words[k : k + n])} ")
    return out


def _count_phrases(weights, exceptions):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        machine = automaton(weights, exceptions)
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                for phrase in phrases(machine, fold(text or "")):
                    counts.setdefault(phrase, [0, 0])[1 - label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([x[0] for x in counts.values()], pa.int64()), pa.array([x[1] for x in counts.values()], pa.int64())], ["entry", "toxic", "other"])

    return run


def learn_phrases(sample: DataFrame, weights: dict[str, float], exceptions: set[str]) -> set[str]:
    """Phrases around matches that are as common in other documents; the bounded sample bounds their number."""
    n = dict(sample.groupBy("label").agg(F.count(F.lit(1))).collect())
    odds = F.log((F.col("toxic") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("other") + 0.5) / (n.get(0, 0) + 1))
    counts = sample.select("label", "text").mapInArrow(_count_phrases(weights, exceptions), "entry string, toxic bigint, other bigint").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    return {r[0] for r in counts.where((F.col("other") >= EXCEPTION_DOCS) & (odds < EXCEPTION_WEIGHT)).select("entry").collect()}


def _rows(weights, exceptions, model):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        machine = automaton(weights, exceptions)
        for batch in batches:
            rows = [features(machine, x or "") for x in batch.column("text").to_pylist()]
            if model is None:
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])
            else:
                scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * v for w, v in zip(model, x, strict=True)))))) for x in rows]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def toxicity_scores(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``documents``.

    ``exceptions``: phrases, besides those learnt, in which entries count
    nothing.  A null or empty text matches nothing; a null doc_id and repeated
    rows are scored like others; without toxic labels the lexicon is empty and
    all documents score the same; other columns are not read; an empty table
    gives an empty result.
    """
    import numpy as np

    docs = documents.select("doc_id", "text")
    sample = labelled(docs, labels, "toxic", 3, 1, rows)
    weights, learnt = learn_lexicon(sample)
    learnt |= {fold(x) for x in exceptions}
    learnt |= learn_phrases(sample, weights, learnt)
    fitted = sample.select("label", "text").mapInArrow(_rows(weights, learnt, None), "label int, x array<double>").collect()
    fitted.sort()
    x = np.array([r[1] for r in fitted], float).reshape(-1, 3)
    model = logistic(x, np.array([r[0] for r in fitted], float), 0.1).tolist() if len(x) else [0.0] * 3
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_rows(weights, learnt, model), f"doc_id {kind}, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
