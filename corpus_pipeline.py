"""From raw documents to token ids: quality rules, line dedup, near-dedup, decontamination, SentencePiece.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymeld.llm.common import table
from waymeld.llm.decontamination import decontaminate
from waymeld.llm.line_dedup import LONG_WORDS, dedup_lines
from waymeld.llm.near_dedup import keep_one
from waymeld.llm.quality import keep_good
from waymeld.llm.sentencepiece import encode, model_path
from waymeld.session import ship_package, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines and of single long lines are deleted; documents left without a word go."""
    return dedup_lines(docs, long_words=LONG_WORDS)


#: Documents of which 100 * shared >= SIMILAR * all shingles are near-duplicates.
SIMILAR = 80


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one(docs, percent=SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that mostly are such passages go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_ids, ids) of every remaining document."""
    return encode(docs, model_path(), keep=["doc_id", "lang", "source"]).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup),
          ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: The signatures and the Viterbi search have no SQL form. tests/llm/test_files_tokens.py replays the stages of run(); the
#: stages have plain versions in tests/llm, whole rows of run() have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table, each written as Parquet and read again."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
