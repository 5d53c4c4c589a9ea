"""The corpus pipeline: quality rules, language identification, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; what it decides takes effect.
All but the last return the columns of ``documents``. Odd input has the results that the operators' modules state; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm.language_id import UNKNOWN, fit_language_model, with_language
from docframe.llm.ngram_join import deduplicate
from docframe.llm.packing import pack_documents
from docframe.llm.quality_rules import keep_good
from docframe.llm.text import column_of, held_out, unnamed
from docframe.runtime import write_stage

#: A document goes if its n-grams are less than this share as likely, over chance, as those of its language's texts.
#: The posterior would not do: summed over hundreds of n-grams it is 1.0 for any text.
MIN_LANGUAGE_FIT = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without the lines that fail."""
    return keep_good(docs, cleaned=True)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; learned from the stage's own input.

    Where nothing can be learned, all documents with a letter stay.
    """
    model = fit_language_model(docs, learnable=~held_out(F.col("doc_id")))
    if not model.learned:
        return docs.where(F.col("text").rlike("\\p{L}"))
    told = with_language(unnamed(docs), model, column_of(docs, "text"), fit="fit")
    told = told.where((F.col("lang_pred") != UNKNOWN) & (F.col("fit") >= MIN_LANGUAGE_FIT))
    return told.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return deduplicate(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 tokens, as pieces of documents."""
    return pack_documents(docs, with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("ngram_join", ngram_join),
    ("packing", packing),
]

#: Packing and the learned language model have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
