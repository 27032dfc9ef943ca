"""Corpus preparation: quality rules, quality classifier, near-duplicates, mixing, packing.

Each stage takes all that its predecessor kept, and all but the last return the
columns of documents, extra ones included, whatever their names. An empty table
gives an empty table at every stage. Null text is an empty one, which the rules
reject for its length. Rows alike in all columns are judged alike by the first
two stages; the third keeps one of each group, of rows alike one. Null ids,
languages and sources are values like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataweave.llm import mixing, packing, quality_classifier, quality_rules, simhash
from strataweave.llm.queries import MIX_WEIGHTS, mix_levels, vocabulary
from strataweave.llm.tables import load, stored
from strataweave.shipping import ship


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, whatever the rules' order; repeated rows stay as often as they came."""
    return quality_rules.filter_documents(docs)


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score at the threshold or above; a text of any length, empty ones too, has a score."""
    return quality_classifier.filter_documents(docs, load(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; the smallest doc_id of a group stays (null before all), and
    one of rows that are alike. Texts of fewer words count as one shingle; empty ones are alike."""
    return simhash.keep_one(ship(spark) and docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to each leaf's budget in tokens, in the order of seeded hashes (ties by row); texts without a token aren't selected."""
    return mixing.mixed_documents(ship(spark) and docs, mix_levels(), weights=MIX_WEIGHTS, budget_share=0.8, epochs=1.0, tokenizer=vocabulary("word_bpe_49k.json"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each document, with its sequence and place; repeated rows are packed row by row."""
    return packing.pack_documents(ship(spark) and docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_by_rules),
    ("quality classifier", keep_by_classifier),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: SQL can't express the fingerprints' candidate search or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
