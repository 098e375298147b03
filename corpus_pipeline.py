"""The corpus pipeline: from raw documents to packed training windows.

Five stages, each an operator applied to all that the one before kept. Every
stage but the last returns the columns of documents:

1. ``language``: documents in no known language go; ``lang`` is the language found.
2. ``lines``: lines that repeat an earlier line go (those too short to judge by edits if they repeat it exactly), and documents they leave blank.
3. ``near_duplicates``: one document of each group of near duplicates stays.
4. ``mixing``: rows come as often as the mixture of sources asks, by tokens of the vocabulary.
5. ``packing``: the windows that the rest is trained in, by tokens of the vocabulary.

Cases are those of the operators: a null text has no language and goes in the
first stage, as do empty ones; very long texts pass through all stages and are
cut into windows at the end; a null doc_id is neither a copy nor copied and is
packed as null; of rows that repeat a doc_id one is left by the third stage;
repeated rows are copies; ties go to the smallest doc_id; an empty table gives no
windows; extra columns come along up to the fourth stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veclume.llm.language import keep_identified
from veclume.llm.line_dedup import drop_repeated_lines
from veclume.llm.mixing import apply_mixture
from veclume.llm.near_dedup import drop_near_duplicates
from veclume.llm.packing import pack_documents
from veclume.llm.shared import materialise, table
from veclume.llm.tokens import VOCABULARY


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs, short=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_mixture(docs, tokenizer=VOCABULARY)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer=VOCABULARY)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Cross-parsing, the forest, the dual and the packing aren't SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each one's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
