"""Quality classifier: Bradley-Terry ranking of documents.

Documents are points of a few text statistics and of the shares of their
three-byte runs, hashed.  From labelled documents,
preference pairs (a good one over a bad one) give a linear score by logistic
loss on the differences of their features; a score quantile, the share of bad
documents in the sample, is the threshold.  Scoring is one pass without a
shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import crc_of_id, labelled, logistic, table

FIT_ROWS = 20_000  # labelled documents that the model is fitted on at most
PAIRS_PER_BAD = 10  # good documents that each bad one is compared with
L2 = 0.5
RUNS = 64  # values of the hash of three-byte runs
CUT = 0.3  # the score of a document at the threshold
SYMBOLS = b"#*$%&|<>{}[]~^_=+\\@"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NAMES = ["symbols", "bars", "capitals", "digits", "shouts", "stops", "distinct", "doubled", "word_length", "log_words", "long_words", "same_lines", *(f"run_{i}" for i in range(RUNS))]


def features(text: bytes) -> list[float]:
    """Statistics of a whole text, each between 0 and about 1; an empty text has zeros."""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(NAMES)
    lines = [x for x in text.split(b"\n") if x.strip()]

    def share(of: bytes) -> float:
        return math.sqrt((len(text) - len(text.translate(None, of))) / chars)

    lengths = [len(x) for x in words]
    return _statistics(text, words, lines, lengths, share) + runs(text)


def runs(text: bytes) -> list[float]:
    """Root shares of the hash values of all runs of three bytes, letters lower-cased."""
    import numpy as np

    raw = np.frombuffer(text.lower(), np.uint8)
    if len(raw) < 3:
        return [0.0] * RUNS
    counts = np.zeros(RUNS, np.int64)
    for k in range(0, len(raw) - 2, 1 << 20):
        x = raw[k : k + (1 << 20) + 2].astype(np.uint32)
        counts += np.bincount((((x[:-2] * 65599 + x[1:-1]) * 65599 + x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(26), minlength=RUNS)
    return np.sqrt(counts / counts.sum()).tolist()


def _statistics(text: bytes, words: list[bytes], lines: list[bytes], lengths: list[int], share) -> list[float]:
    n = len(words)
    return [
        share(SYMBOLS),
        math.sqrt(min(1.0, text.count(b"|") / n)),
        share(CAPITALS),
        share(b"0123456789"),
        share(b"!?"),
        math.sqrt(min(1.0, (text.count(b".") + text.count(b",")) / n)),
        len(set(words)) / n * math.log1p(n) / 10,
        math.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n),
        min(20.0, sum(lengths) / n) / 20,
        math.log1p(n) / 10,
        math.sqrt(sum(x > 25 for x in lengths) / n),
        math.sqrt(1 - len(set(lines)) / len(lines)),
    ]


def _features(batches: Iterator) -> Iterator:
    import pyarrow as pa

    from tremor.llm.common import binaries

    for batch in batches:
        rows = [features(x) for x in binaries(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, pairs_per_bad: int = PAIRS_PER_BAD) -> tuple[list[float], float]:
    """(weights, threshold).  Without documents of both labels all weights are
    0, so that every document scores the same."""
    import numpy as np

    found = labelled(documents, labels, "quality", 5, 0, rows).select("label", "text").mapInArrow(_features, "label int, x array<double>").collect()
    found.sort()
    y = np.array([r[0] for r in found], int)
    x = np.array([r[1] for r in found], float).reshape(-1, len(NAMES))
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return [0.0] * len(NAMES), 0.0
    draw = np.random.default_rng(1)
    a = draw.integers(0, len(good), len(bad) * pairs_per_bad)
    difference = good[a] - np.repeat(bad, pairs_per_bad, axis=0)
    w = logistic(difference, np.ones(len(difference)), L2)  # the other order of a pair says the same
    scores = np.sort(x @ w)
    k = len(bad)
    return w.tolist(), float((scores[k - 1] + scores[min(k, len(scores) - 1)]) / 2)


def _score(weights: list[float], threshold: float):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tremor.llm.common import binaries

        at_cut = math.log(CUT / (1 - CUT))
        for batch in batches:
            out = []
            for text in binaries(batch, "text"):
                rank = sum(w * v for w, v in zip(weights, features(text), strict=True)) - threshold
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, rank + at_cut)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return run


def quality_scores(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``documents``.

    A null or empty text scores as features of 0; a null doc_id and repeated
    rows are scored like others; labels other than 0 and 1 and those without a
    document are left out; other columns are not read; an empty table gives an
    empty result.
    """
    docs = documents.select("doc_id", "text")
    weights, threshold = fit(docs, labels, **options)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_score(weights, threshold), f"doc_id {kind}, score double")


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
