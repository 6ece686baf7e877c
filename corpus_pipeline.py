"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, byte-level BPE.

Every stage works on all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm import bpe, decontaminate, line_dedup, near_copies, toxicity
from orogen.llm.common import discard, fresh, table, written
from orogen.llm.queries import tokenizer

#: A document is rejected from this score on, as in op3.
REJECT = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under REJECT; the model is learned as in op3, from labelled rows outside the held-out fold.

    Null and blank texts score as the model's bias, whole texts of any length are scored, rows that repeat are scored
    alike and all stay or go, and so do rows with a null doc_id, which only can't be learned from. Without labels
    nothing goes; an empty table stays empty.
    """
    (score,) = fresh(docs, "toxicity")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.remainder(3) != 1)
    return toxicity.score(docs, model, score).where(F.col(score) < REJECT).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more of them share, which stay in the one of the largest doc_id.

    Every row stays. A null text stays null, an empty one empty, however long the others. Rows of one doc_id are one
    document, and so are all rows with a null one, which stands below all others; where a line repeats within the
    document that keeps it, all of its places stay. n_chars is renewed.
    """
    return line_dedup.without_repeated_lines(docs, min_chars=20, min_docs=3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more of their five-word shingles), that of the smallest doc_id.

    Null and blank texts are copies of each other, texts of fewer than five words are near only if equal, and long ones
    are compared whole. Of rows that repeat a doc_id one stays, that of the least text hash; rows with a null doc_id
    are in no group and all stay.
    """
    return near_copies.without_near_copies(docs, width=5, least=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows.

    Texts without words, null ones included, stay; long ones are searched whole. Rows that repeat stay or go alike,
    whatever their doc_id, null included. Without items nothing goes.
    """
    (found,) = fresh(docs, "contamination")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), found).where(~decontaminate.is_contaminated(found)).drop(found)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number and digest, and the digest of the text decoded from them.

    A row for every row: null and empty texts have no tokens, long ones are encoded whole, a null doc_id stays null,
    rows that repeat give repeated results, and columns other than doc_id and text go.
    """
    return bpe.digests(docs, *tokenizer(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, folder = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            discard(spark, before)  # only the next stage read it
        before = folder
    return docs


#: Learned scores and near copies can't be expressed in SQL; tests/llm/test_pipeline.py holds each stage to brute force.
ORACLE_SQL = None
