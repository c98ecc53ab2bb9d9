"""The corpus pipeline: language, fuzzy lines, near duplicates, mix and packing, each stage over all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder and read
again for the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import language, lines, mixing, ngram_join, packing, queries
from brindle.storage import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too), and those no language is sure enough for. Repeated rows
    share one verdict; extra columns pass; an empty table stays empty."""
    return language.keep_identified(docs, language.train_language_model(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one line of each class of alike lines; a document left without any line goes. Texts without a word stay as they
    are. Rows are told apart by id and text, so null and repeated ids lose no line of another; of rows equal in both one stays. Whole texts of any length; an empty table stays empty."""
    return lines.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, that of the least doc_id (null first); texts without words stay. Rows
    that share an id, or have none, are judged by their own texts; of rows equal in both one stays. An empty table stays empty."""
    return ngram_join.keep_one(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document. Null texts have no words and may be taken or not; a null source is a source; rows
    equal in all columns are one unit, others are drawn one by one. An empty table stays empty."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, a repeated row (the mix makes them) packed once for each time; a null text is only
    its end id. An empty table gives no piece."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("fuzzy_lines", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("source_mix", mix_to_targets),
    ("lexical_packing", pack_sequences),
]

#: Trained models, probing, sampling and packing have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
