"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) whose result is written as
Parquet and read again as the next one's documents. All but the last return the
columns of documents, with n_chars brought up to date.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight.llm import line_templates, packing, pii, quality, shingles
from acrelight.llm.common import documents, stage

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def as_given(docs: DataFrame) -> DataFrame:
    """The columns of documents alone; one that is missing is null."""
    return docs.select(*((F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name) for name, kind in COLUMNS.items()))


def as_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents alone, with n_chars as the text's length."""
    return as_given(docs).withColumn("n_chars", F.length("text").cast("long"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts, each row judged by its own text and metadata.

    Null and empty texts and null metadata are judged as such; equal rows have
    equal judgements; an empty table stays empty. Further columns go.
    """
    return as_documents(quality.keep_good(as_given(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of templates that recur across unrelated documents; every row stays, a null text null. Further columns go."""
    return as_documents(line_templates.drop_recurring_lines(as_given(docs)))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the least doc_id.

    A null doc_id comes last. Different texts that share a doc_id, or have none,
    are documents of their own; of equal rows one stays. Documents without words
    link with nothing and all stay. Further columns go.
    """
    return as_documents(shingles.keep_one_of_similar(as_given(docs)))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose personal data is replaced by its kind; every row stays, a null text null. Further columns go."""
    return as_documents(pii.redact(as_given(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every row, with their sequence and offset; a null or empty text is one piece of the end token. Further columns go."""
    return packing.packed_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("similar", keep_one_of_similar), ("pii", redact), ("packing", pack)]
#: Fitted models and hashes decide; SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
