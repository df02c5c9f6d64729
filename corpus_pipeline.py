"""A corpus pipeline of five stages, each on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe, decontaminate, lines, quality, registry, simhash
from pagewright.llm.common import new_path, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty texts are judged by the
    evidence of an empty text; null source or lang is a site or path of its own; repeated rows are
    judged alike; no labels give even rates; extra columns stay; an empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them share. A null text stays null, a text that loses
    all lines is empty; rows without doc_id keep their lines; rows of one doc_id are one document;
    extra columns stay; an empty table stays empty."""
    return lines.dedup_lines(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies. Rows without doc_id are
    in no group and stay, those of one doc_id stay or go together; texts without words are copies of
    each other; extra columns stay; an empty table stays empty."""
    classes = simhash.near_duplicates(docs)
    copies = classes.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark. Null and empty texts have no words and
    stay; repeated rows are judged alike; extra columns stay; an empty table stays empty."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and digest. Null and empty texts have no ids;
    repeated rows are encoded alike; other columns are left out; an empty table stays empty."""
    ranks = registry.tokenizer_path("byte_bpe_50k.tiktoken")
    e = bpe.encode(docs, ranks, registry.split_pattern())
    return e.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_near_copies),
    ("benchmark decontamination", without_test_items),
    ("byte-level BPE encoding and decoding", encoded),
]

#: SQL has no tokenizer and no fitted classifier; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
