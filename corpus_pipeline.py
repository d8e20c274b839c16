"""A corpus pipeline of five stages; each works on all that the one before it has kept.

Each stage takes documents of any further columns, whatever their names. Null and empty texts, null ids, sources and languages pass: an empty text is
not toxic, alone in its class, has no passage and no tokens, and is packed as its end id. Rows that repeat a document are
one document to near_duplicates, if they have an id, and stay as often as they occur in the others. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import Scratch, table
from tessera.llm.mixing import mixed
from tessera.llm.ngram_join import one_of_each
from tessera.llm.packing import pack
from tessera.llm.substrings import without_repeats
from tessera.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the ordinal model calls toxic."""
    return without_toxic(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each class of linked documents."""
    return one_of_each(spark, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that a document of a smaller doc_id has."""
    return without_repeats(spark, docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources have them, in the mixture's order of epochs and blocks."""
    return mixed(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packing", packing)]

#: Models and iterated joins are beyond SQL; tests/llm/test_pipeline_plain.py holds the stages and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
