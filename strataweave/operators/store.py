"""Loads, upserts and deletes, as queries that give a table's next version.

Parquet tables can't be changed in place; write() puts a version beside the
last and tells which one stands.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in this order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def upsert(table: DataFrame, batch: DataFrame, key: Sequence[str] = ("url", "chunk_number")) -> DataFrame:
    """Rows of the batch replace rows of the table with their key."""
    return table.join(batch.select(*key), list(key), "left_anti").unionByName(batch)


def replace_urls(table: DataFrame, batch: DataFrame) -> DataFrame:
    """All rows of the batch's URLs go before the batch comes in."""
    return table.join(batch.select("url").distinct(), "url", "left_anti").unionByName(batch)


def upsert_sources(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Summary and word count of a known source are overwritten, not added up."""
    new = batch.select("source_id", F.col("summary").alias("_s"), F.col("total_word_count").alias("_n"), F.lit(True).alias("_new"))
    met = table.join(new, "source_id", "full_outer")
    pick = lambda fresh, old: F.when(F.col("_new"), F.col(fresh)).otherwise(F.col(old)).alias(old)
    return met.select("source_id", pick("_s", "summary"), pick("_n", "total_word_count"))


def without_source(table: DataFrame, source: str) -> DataFrame:
    return table.filter(~F.col("source_id").eqNullSafe(source))


def orphans(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks of sources that aren't there."""
    return chunks.join(sources.select("source_id"), "source_id", "left_anti")


def write(table: DataFrame, folder: str, version: int) -> str:
    path = f"{folder.rstrip('/')}/v{version:08d}"
    table.write.mode("overwrite").parquet(path)
    return path


def create_tables(spark: SparkSession, database: str) -> None:
    """Empty tables of sources, chunks and code examples where there are none."""
    chunk = "id BIGINT, url STRING NOT NULL, chunk_number INT NOT NULL, content STRING NOT NULL, metadata STRING, source_id STRING NOT NULL, embedding ARRAY<FLOAT>, created_at TIMESTAMP"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.sources (source_id STRING, summary STRING, total_word_count BIGINT, created_at TIMESTAMP, updated_at TIMESTAMP) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.chunks ({chunk}) USING parquet PARTITIONED BY (source_id)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.code_examples ({chunk}, summary STRING) USING parquet PARTITIONED BY (source_id)")


def truncate(spark: SparkSession, table: str) -> None:
    spark.sql(f"TRUNCATE TABLE {table}")


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name and row_count of each."""
    found = None
    for name, table in tables.items():
        one = table.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("a table is wanted")
    return found


def head(table: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in this order."""
    return table.orderBy(*order).limit(n)


def delete_source(tables: Mapping[str, DataFrame], source: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the source, and how many rows of each go (table_name, row_count)."""
    gone = counts({name: t.filter(F.col("source_id").eqNullSafe(source)) for name, t in tables.items()})
    return {name: without_source(t, source) for name, t in tables.items()}, gone
