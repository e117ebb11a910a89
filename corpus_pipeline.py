"""A training corpus from raw documents: quality, exact and near duplicates, source mixing, tokens.

``run`` applies the stages to ``documents``; each stage's result is a Parquet table in the shared folder and the next
one's input.  A document's id stands for it: rows that repeat an id are kept or dropped together.

Defined results: null and empty texts are scored by the classifier's bias, are equal to each other, and have no tokens;
rows with a null id are kept or dropped together, as one document; very long texts are like any others; columns beyond
the id, the text, the source and the language are passed on unread, whatever their names; an empty table, or one without
labels, gives what the stages give for it, at the end doc_id and the columns of the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import bpe, exact_dedup, mixing, quality, simhash
from lexiloom.llm.common import written
from lexiloom.llm.queries import read, tokenizer_path


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among ``ids``, null included."""
    keys = ids.select(ids["doc_id"].alias("kept_doc_id")).distinct().hint("shuffle_hash")
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["kept_doc_id"]), "left_semi")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def exact_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return _only(docs, exact_dedup.exact_duplicates(docs).filter("kept"))


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more in five-word shingles the one with the smallest id."""
    return _only(docs, simhash.similar_documents(docs).filter("doc_id <=> component_id"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target weights."""
    return _only(docs, mixing.mix(docs).filter("sampled"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", good_quality), ("exact_dedup", exact_unique), ("near_dedup", near_unique), ("mixing", mixed), ("bpe", tokenised)]

#: SQL cannot express the classifier, the fingerprints and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
