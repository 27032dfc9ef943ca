"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import chunk_reuse, hard_negatives, html_text, mixing, neighbours, oracle, packing, quality_classifier, quality_rules, sharding, simhash, token_counts, warc, whitening
from strataweave.llm.tables import load


def vocabulary(name: str) -> str:
    """A public vocabulary file's place on this machine; every operator takes it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


#: <|endoftext|> of word_bpe_49k.json.
END_OF_TEXT = 49407


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_counts(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), END_OF_TEXT)


def op3_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(load(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(load(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def mix_levels() -> dict[str, Column]:
    """Sources fall into four domains by a checksum of their names."""
    domain = F.concat(F.lit("d"), (F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")) % 4).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


#: Two domains count double, and English three times as much as another language.
MIX_WEIGHTS = {("d0",): 2.0, ("d1",): 2.0, **{(f"d{i}", "en"): 3.0 for i in range(4)}}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), mix_levels(), weights=MIX_WEIGHTS, epochs=2.0, tokenizer=vocabulary("word_bpe_49k.json")).drop("_row", "_row2")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(load(spark, sf_dir, "pages"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond a long (from some million rows on) is null here; the operator's own decimal holds it."""
    return whitening.whiten(load(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_reuse.encode_documents(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_token_counts, op3_approximate_nearest_neighbours, op4_warc, op5_quality_rules,
        op6_quality_classifier, op7_sharding, op8_simhash_near_dedup, op9_mixing, op10_html_extraction,
        op11_embedding_whitening, op12_bpe_encoding,
        op13_hard_negatives,
    )
}
ORACLE_SQL: dict[str, str] = {"op5_quality_rules": oracle.OP5, "op7_sharding": oracle.OP7, "op4_warc": oracle.OP4}
