"""A cleaning pipeline over ``documents``: each stage takes what the stage before kept.

Rules, near-duplicates and benchmark leaks remove rows, repeated passages are cut out
of texts, and the last stage packs what is left into token sequences. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from skyledger.llm import leaks, minhash, packing, passages, quality  # noqa: E402
from skyledger.llm.store import keep, table  # noqa: E402
from skyledger.llm.tokens import tokenizer_path  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass the current policy of the rule ledger, as they were.

    A null text is empty and fails; repeated rows, null ids and extra columns pass as they are; an
    empty table stays empty. No Python runs here.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near-duplicates: the row with the smallest id.

    Texts without words are in no group and stay; rows with a null id stay; all rows of the
    smallest id stay, rows of the other ids go. The columns and other values do not change.
    """
    return minhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; passages that a text with a smaller id has too are cut out of the others' texts.

    Null and empty texts and rows with a null id stay as they are; of several texts under one id the
    first in order is cut; a text may become empty, ``n_chars`` keeps its value.
    """
    return passages.without_passages(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no passage of the benchmark table.

    Null and empty texts stay; each row is judged by its own text and id; null benchmark items
    match nothing, and an empty benchmark removes nothing.
    """
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts and their places in token sequences.

    Null texts are empty and still have their end id; rows with one id are packed each; an empty
    table gives no pieces. Only the columns ``doc_id`` and ``text`` are read.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # chains and packing are not SQL; tests/llm holds the first two stages and the last against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: pieces of token sequences and their places."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
