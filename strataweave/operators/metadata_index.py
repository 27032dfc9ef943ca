"""Posting lists over JSON metadata, for containment filters without parsing every row.

A posting says that a row's metadata holds a value at a path. Postings lie in
buckets by path and value, as a partition column, so a filter reads the buckets
of its own terms and no others. Rows that have postings for all terms are
candidates; the exact filter parses only their metadata, so a posting may be
stale (its row has changed) or too many, but none is missing.

Upkeep: add() the rows that are new or changed; compact() drops what is stale.
"""

from __future__ import annotations

import json as standard
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions import json

BUCKETS = 64


def text_of(value: Any) -> str:
    """A leaf's value as text: strings as they are, the rest as compact JSON."""
    return value if isinstance(value, str) else standard.dumps(value, separators=(",", ":"))


def leaves(value: Mapping, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, text) of every value that isn't an object."""
    for key, held in value.items() if isinstance(value, Mapping) else value:
        at = f"{path}.{key}"
        if isinstance(held, Mapping | _Pairs):
            yield from leaves(held, at)
        else:
            yield at, text_of(held)


class _Pairs(list):
    """An object's pairs, repeated names included."""


def postings(rows: DataFrame, id_col: str = "id", metadata: str = "metadata", buckets: int = BUCKETS) -> DataFrame:
    """bucket, path, value, id: one row for each value in each row's metadata. Metadata that isn't an object has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    value = standard.loads(text, object_pairs_hook=_Pairs) if text else None
                except ValueError:
                    continue
                if isinstance(value, _Pairs):
                    terms = sorted({*leaves(value)})
                    at += [i] * len(terms)
                    found += terms
            paths, values = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.string()), batch.column(0).take(pa.array(at, pa.int64()))], names=["path", "value", "id"])

    kind = rows.schema[id_col].dataType.simpleString()
    made = rows.select(F.col(id_col).alias("_id"), F.col(metadata).alias("_m")).mapInArrow(run, f"path string, value string, id {kind}")
    bucket = F.pmod(F.crc32(F.concat_ws("\n", "path", "value").cast("binary")), F.lit(buckets)).cast("int")
    return made.select(bucket.alias("bucket"), "path", "value", "id")


@dataclass(frozen=True)
class MetadataIndex:
    spark: SparkSession
    folder: str
    buckets: int = BUCKETS

    def add(self, rows: DataFrame, id_col: str = "id", metadata: str = "metadata") -> None:
        """Postings of rows that are new or changed."""
        made = postings(rows, id_col, metadata, self.buckets)
        # A term that very many rows have goes to several tasks and files.
        made.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("bucket", "path", "value").write.mode("append").partitionBy("bucket").parquet(self.folder)

    def candidates(self, wanted: Mapping) -> DataFrame:
        """id of every row that may contain wanted, which has a value at least."""
        terms = sorted({*leaves(wanted)})
        if not terms:
            raise ValueError("any row contains an empty object")
        mine = sorted({zlib.crc32(f"{path}\n{value}".encode()) % self.buckets for path, value in terms})
        hit = F.lit(False)
        for path, value in terms:
            hit |= (F.col("path") == path) & (F.col("value") == value)
        held = self.spark.read.parquet(self.folder).filter(F.col("bucket").isin(*mine) & hit)
        return held.groupBy("id").agg(F.count_distinct("path", "value").alias("_terms")).filter(F.col("_terms") == len(terms))

    def find(self, rows: DataFrame, wanted: Mapping, id_col: str = "id", metadata: str = "metadata") -> DataFrame:
        """The rows whose metadata contains wanted, as filtering by json.contains() gives them."""
        if not any(True for _ in leaves(wanted)):
            return rows.filter(json.contains(F.col(metadata), wanted))
        met = rows.join(self.candidates(wanted).withColumnRenamed("id", "_id"), F.col(id_col) == F.col("_id"))
        # The condition needs both sides, so it isn't taken below the join, where it would parse every row.
        return met.filter(F.when(F.col("_terms") > 0, json.contains(F.col(metadata), wanted))).select(*rows.columns)

    def compact(self, rows: DataFrame, folder: str, id_col: str = "id", metadata: str = "metadata") -> MetadataIndex:
        """A new index, in a new folder, of the rows as they are."""
        made = MetadataIndex(self.spark, folder, self.buckets)
        made.add(rows, id_col, metadata)
        return made


def build(rows: DataFrame, folder: str, id_col: str = "id", metadata: str = "metadata", buckets: int = BUCKETS) -> MetadataIndex:
    index = MetadataIndex(rows.sparkSession, folder, buckets)
    index.add(rows, id_col, metadata)
    return index
