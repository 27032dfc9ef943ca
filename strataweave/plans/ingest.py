"""From pages to the tables of chunks, sources and code examples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions import text as T
from strataweave.functions import urls
from strataweave.operators import embedding as E
from strataweave.plans.config import EngineConfig


@dataclass(frozen=True)
class Corpus:
    chunks: DataFrame
    sources: DataFrame
    code_examples: DataFrame


def ingest(pages: DataFrame, config: EngineConfig, embedder: E.Embedder, crawl_type: str = "webpage") -> Corpus:
    """pages: url, markdown. Chunks of a URL are numbered from 0; a source's words
    are counted over all of its chunks; code examples only where asked for."""
    held = pages.withColumn("source_id", urls.source_id(F.col("url")))
    if config.contextual_embeddings:
        # Found before chunking: what goes into every chunk's row is the sentence, not the document.
        held = held.withColumn("context", E.first_sentence(F.substring("markdown", 1, 25000), F.lit("")))
    rows = T.with_section_info(T.chunk(held, "markdown", config.chunk_size))
    if config.contextual_embeddings:
        context = F.col("context")
        rows = rows.withColumn("raw_content", F.col("content")).withColumn("content", F.when(context == "", F.col("content")).otherwise(T.contextual_text(context, F.col("content"))))
    else:
        rows = rows.withColumn("raw_content", F.col("content"))
    meta = F.to_json(
        F.struct(
            "headers", "char_count", "word_count", F.col("chunk_number").alias("chunk_index"), "url", F.col("source_id").alias("source"), "source_id",
            F.lit(crawl_type).alias("crawl_type"), F.char_length("content").alias("chunk_size"), F.lit(config.contextual_embeddings).alias("contextual_embedding"),
            F.current_timestamp().alias("crawl_time"),
        )
    )
    chunks = rows.select(F.xxhash64("url", "chunk_number").alias("id"), "url", "chunk_number", "content", "raw_content", meta.alias("metadata"), "source_id", "word_count")
    return Corpus(E.embed(chunks, embedder), source_table(rows, held), code_examples(held, config, embedder))


def source_table(rows: DataFrame, pages: DataFrame) -> DataFrame:
    counts = rows.groupBy("source_id").agg(F.sum("word_count").alias("total_word_count"))
    first = pages.groupBy("source_id").agg(F.min_by(F.substring("markdown", 1, 5000), "url").alias("text"))
    summary = E.first_sentence(F.col("text"), F.concat(F.lit("Content from "), "source_id"))
    return counts.join(first, "source_id").select("source_id", summary.alias("summary"), "total_word_count")


def code_examples(pages: DataFrame, config: EngineConfig, embedder: E.Embedder) -> DataFrame:
    wanted = pages if config.agentic_rag else pages.limit(0)
    blocks = T.code_blocks(wanted.select("url", "source_id", "markdown"), "markdown", config.code_block_least)
    summary = E.first_sentence(F.col("context_before"), F.lit("Code example for demonstration purposes."))
    made = blocks.select(
        F.xxhash64("url", "block").alias("id"), "url", F.col("block").alias("chunk_number"), F.col("code").alias("content"), summary.alias("summary"),
        F.to_json(F.struct("language", F.char_length("code").alias("char_count"), F.col("source_id").alias("source"), "source_id")).alias("metadata"), "source_id",
    )
    made = made.withColumn("embedding", embedder(T.code_embedding_text(F.col("content"), F.col("summary"))))
    return E.repaired(made, embedder)
