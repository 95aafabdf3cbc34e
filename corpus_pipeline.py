"""A corpus pipeline of five of the operators: documents in, sampled piece ids out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import mixing, neardup, pieces, quality, substring
from quillon.llm.common import Shelf, remainder
from quillon.runtime import ship, table

# Documents whose quality score is lower go.
LEAST_QUALITY = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the rule ensemble on the labelled documents and keep those that it scores LEAST_QUALITY or more."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return quality.accept(docs, model, LEAST_QUALITY)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id."""
    ship(spark)
    return neardup.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut paragraphs that repeat; every document stays, with what is left of its text and its new n_chars."""
    ship(spark)
    cleaned = substring.deduplicate(docs)
    return cleaned.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents towards the target weights of their sources, in a global random order."""
    return mixing.mix(docs).select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, as piece ids."""
    ship(spark)
    return pieces.encode(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

# The fitted classifier, the components and the sampled segmentations have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is stored as Parquet in the shared folder and read again."""
    shelf = Shelf(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        docs = shelf.put(stage(spark, docs, sf_dir), name.split()[0].lower())
        shelf.drop(before)
    return docs
