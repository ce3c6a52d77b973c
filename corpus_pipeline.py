"""A corpus pipeline: toxicity, quality, near-duplicates, benchmark decontamination, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe_automaton, decontaminate, quality_classifier, simhash, toxicity
from lectern.llm.queries import tokenizer_path
from lectern.llm.shared import new_folder, remove, scratch, stored_at

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores as toxic go. A null text counts as empty and stays; repeated rows stay or go together;
    an empty table gives none; columns beside those of documents are cut."""
    return toxicity.drop_toxic(docs.select(COLUMNS), _labels(spark, sf_dir))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. A null text counts as empty, a null source or lang is a site of its own;
    repeated rows stay or go together; an empty table gives none; columns beside those of documents are cut."""
    return quality_classifier.drop_poor(docs.select(COLUMNS), _labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id. Rows without one come last; null and empty
    texts are one group; of repeated rows one stays; an empty table gives none; columns beside those of documents are cut."""
    return simhash.one_of_each(spark, docs.select(COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go. Null and empty texts stay; repeated rows stay or go together; an empty
    table gives none; columns beside those of documents are cut."""
    return decontaminate.drop_contaminated(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded texts as digests, as op3 returns them. A null text counts as empty; each of repeated rows gives a row; an
    empty table gives none."""
    return bpe_automaton.encode_decode(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_poor),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The first stages learn models, and fingerprints need XXH64 with a seed, which SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again; what a stage wrote is removed once the next one is written.

    Columns beside those of documents are cut. An empty table of documents gives no rows. Nulls, ties and repeated rows are as
    each stage says.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = new_folder(spark, f"stage-{name}")
        with scratch():
            docs = stored_at(stage(spark, docs, sf_dir), out)
        if before:
            remove(before)
        before = out
    return docs
