"""A corpus pipeline: quality, near-duplicates, benchmark leaks, mixing, then token ids. Each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.llm.common import read_table
from lodemark.llm.mixing import mix_documents
from lodemark.llm.quality import keep_good
from lodemark.llm.simhash import keep_one
from lodemark.llm.tiling import decontaminate
from lodemark.llm.token_planes import read_index, vocabulary, write_ids
from lodemark.storage import save


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; nulls, empty and long texts, repeated rows, clashing names and empty tables as in ``keep_good``."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; nulls, empty texts, ties, repeated rows, clashing names and empty tables as in ``keep_one``."""
    return keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go; nulls, empty and long texts, repeated rows, clashing names and empty tables as in ``decontaminate``."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null sources, empty texts, ties, repeated rows, clashing names and empty tables as in ``mix_documents``."""
    return mix_documents(docs, F.array("source"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the written ids: doc_id, start, n_tokens, ids_crc32 of each copy."""
    return read_index(write_ids(docs, vocabulary("byte_bpe_50k.json"), cache=200_000))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", leaks), ("mixing", mixing), ("token_ids", token_ids)]

#: A network, fingerprints and a tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
