"""Training-data pipeline over the documents of a corpus.

Stages, in order: quality rules, near-duplicates, benchmark decontamination,
mixing to target weights, token ids.  Each one's rows are written as Parquet
to the folder that driver and executors share, and read again by the next.

All stages take columns of any name beside those of documents, judge rows with
a null doc_id like others, and give no rows for an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tremor.llm import decontaminate, mixing, near_dedup, quality_rules, token_output
from tremor.llm.common import park, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that failed.  Null and empty texts go; repeated rows are judged one by one."""
    return quality_rules.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the smallest doc_id, null
    last, of repeated rows one.  Null and empty texts are in no group and stay."""
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.  Null and empty texts hold none; repeated rows go or stay together."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, once for each time.  A null source is the last one; null and empty texts go with
    their source; repeated rows are taken one by one."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read from the files that hold the ids.  A null or empty text is the end id
    alone; null doc_ids come last; repeated rows follow one another."""
    path = f"{shared_dir(spark)}/pipeline-ids-{uuid.uuid4().hex}"
    token_output.write_tokens(docs, path)
    return token_output.read_tokens(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token_output", token_ids),
]

#: The mix draws documents at random and the ids come from a tokenizer: SQL
#: can't express them, see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = park(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
