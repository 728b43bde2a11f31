"""A corpus pipeline: language ID, near-duplicate removal, mixing of sources, packing into windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, language, mixing, packing
from millrace.llm.common import shared_folder, without

#: Bytes of words that a packing task keeps.
WORDS = 40_000_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a determined language stay; texts that are null, without letters or unlike every language go.

    Null ids and repeated rows are judged by their texts like all others; without any labelled text everything goes.
    """
    model = language.train_languages(docs, key=F.col("doc_id"))
    told = language.identify(docs, model, keep=docs.columns, names=("__lang", "__score", "__alike"))
    return told.where((F.col("__lang") != language.UNDETERMINED) & F.col("__alike")).drop("__lang", "__score", "__alike")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of documents linked by Jaccard similarity 0.8 of five-word shingles, the one with the smallest id stays.

    Documents without words, and those with a null id, stay. Rows that share the smallest id all stay: an id is one document.
    """
    classes = jaccard.join_similar(docs)
    return without(docs, "doc_id", classes.where("doc_id <> component_id").select(F.col("doc_id").alias("id")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, longer ones first.

    A null source is a source, a null id and a null text are a document's like any other, and repeated rows are taken alike.
    """
    return mixing.mixed(mixing.by_length(docs), importance_col="__importance").select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences and their token ids; a null text is its end mark, a null id is kept."""
    return packing.pack_documents(docs, remembered=WORDS)  # stages share an executor's memory


STAGES = [
    ("language ID", language_stage),
    ("near-duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned weights, hashed draws and token ids can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents`` of ``sf_dir``, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
