"""Substring search over a column by posting lists of trigrams.

A row's text, lower-cased, holds trigrams: runs of three characters. A needle
(with the wildcards of LIKE, if any) has every trigram of its fixed parts, so
rows in the lists of all of them are candidates, and the exact test reads their
texts alone. A needle without a fixed part of three characters reads every row.

Rows are listed in blocks, by the task that reads them, and a task's lists are
committed with its ids: nothing is shuffled, and a list is the gaps between a
block's row numbers. Lists lie in buckets by trigram, as a partition column.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from strataweave.operators.retrieval import has_keyword

BUCKETS, SIZE, PIECE = 16, 3, 32
#: A block ends with the text that brings it to so many rows or postings.
BLOCK_ROWS, BLOCK_POSTINGS = 1 << 15, 1 << 19
#: Where the ids of blocks lie.
IDS = -1
#: Candidates are marked in bitmaps of so many bits, at most 8 MiB in all.
BITS, SLOTS = 8 * 4096, 1 << 26


def grams(text: Column, size: int = SIZE) -> Column:
    """All runs of so many characters, once each; none of a shorter text."""
    # A substring is counted off from the start: from that of a short piece, not of the whole text.
    pieces = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1, F.lit(PIECE)), lambda b: F.substring(text, b, F.lit(PIECE + size - 1)))
    runs = F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - size + 1), lambda i: F.substring(p, i, F.lit(size))))
    return F.when(F.length(text) >= size, F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<string>"))


def wanted(query: str) -> list[str]:
    """The trigrams that a text has which is like %query%."""
    parts = re.split(r"[%_\\]", query.lower())
    return sorted({p[i : i + SIZE] for p in parts for i in range(len(p) - SIZE + 1)})


def keys(text: bytes) -> np.ndarray:
    """The trigrams of a text as numbers, once each, in order; a long text's are made out piece by piece."""
    codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.int64)
    runs = (codes[i : i + BLOCK_POSTINGS + SIZE - 1] for i in range(0, max(1, len(codes) - SIZE + 1), BLOCK_POSTINGS))
    return reduce(np.union1d, (np.unique(r[:-2] << 42 | r[1:-1] << 21 | r[2:]) for r in runs))


def gaps(lists: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where each list starts, and its gaps as two-byte numbers, low bytes before high ones; lists and rows are in order."""
    starts = np.flatnonzero(np.diff(lists, prepend=-1))
    sizes = np.diff(starts, append=len(lists))
    gap = np.diff(rows, prepend=0)
    gap[starts] = rows[starts]
    at = np.arange(len(rows)) + np.repeat(starts, sizes)
    data = np.empty(2 * len(rows), np.uint8)
    data[at], data[at + np.repeat(sizes, sizes)] = gap & 255, gap >> 8
    return starts, pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(2 * starts, len(data)).astype("<i4")), pa.py_buffer(data)])


def rows_of(coded: bytes) -> np.ndarray:
    low, high = np.frombuffer(coded, np.uint8).reshape(2, -1).astype(np.int64)
    return np.cumsum(low | high << 8)


def block(ids: pa.Array, texts: Sequence[Sequence[np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """The lists of a block, by column and trigram, and its ids."""
    name = uuid.uuid4().hex

    def batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"bucket": pa.int32(), "gram": pa.string(), "c": pa.int32(), "block": pa.string(), "rows": pa.binary(), "ids": pa.list_(ids.type)}
        columns["block"] = pa.array([name] * n, pa.string())
        return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in kinds.items()], names=[*kinds])

    yield batch(1, bucket=pa.array([IDS], pa.int32()), ids=pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
    for c, found in enumerate(texts):
        held, rows = np.concatenate(found), np.repeat(np.arange(len(found), dtype=np.int32), [len(k) for k in found])
        order = np.argsort(held, kind="stable")
        held, rows = held[order], rows[order]
        starts, coded = gaps(held, rows)
        first = held[starts]
        letters = np.stack([first >> 42, first >> 21 & 0x1FFFFF, first & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
        made = [letters[i : i + SIZE] for i in range(0, len(letters), SIZE)]
        bucket = [zlib.crc32(g.encode()) % buckets for g in made]
        yield batch(len(made), bucket=pa.array(bucket, pa.int32()), gram=pa.array(made, pa.string()), c=pa.array([c] * len(made), pa.int32()), rows=coded)


def blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Lists of rows of an id and texts."""
    ids, texts, held, kind = [], [], 0, None
    for batch in batches:
        kind = batch.schema.field(0).type
        for values in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
            ids.append(values[0].as_py())
            texts.append([keys(t.as_py()) for t in values[1:]])
            held += sum(map(len, texts[-1]))
            if held >= BLOCK_POSTINGS or len(ids) == BLOCK_ROWS:
                yield from block(pa.array(ids, kind), [*zip(*texts, strict=True)], buckets)
                ids, texts, held = [], [], 0
    if ids:
        yield from block(pa.array(ids, kind), [*zip(*texts, strict=True)], buckets)


def in_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of rows in all of a block's lists."""
    for batch in batches:
        for ids, lists in zip(batch.column("ids"), batch.column("lists"), strict=True):
            rows = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), (rows_of(x) for x in lists.as_py()))
            yield pa.RecordBatch.from_arrays([ids.values.take(pa.array(rows))], names=["id"])


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    folder: str
    columns: tuple[str, ...] = ("content",)
    buckets: int = BUCKETS

    def add(self, rows: DataFrame, id_col: str = "id") -> None:
        """Lists of rows that are new or changed; stale ones cost a test."""
        buckets = self.buckets
        texts = rows.select(F.col(id_col).alias("id"), *(F.lower(F.coalesce(c, F.lit(""))).cast("binary").alias(f"t{i}") for i, c in enumerate(self.columns)))
        made = texts.mapInArrow(lambda batches: blocks(batches, buckets), self._fields(texts.schema["id"].dataType))
        made.sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").option("compression", "zstd").parquet(self.folder)

    def _fields(self, kind: DataType) -> str:
        return f"bucket int, gram string, c int, block string, rows binary, ids array<{kind.simpleString()}>"

    def candidates(self, terms: Sequence[str], kind: DataType | None = None) -> DataFrame:
        """id of rows one of whose columns has all these trigrams; kind is the type of ids, which an empty index can't tell."""
        terms = sorted(set(terms))
        kept = (self.spark.read if kind is None else self.spark.read.schema(self._fields(kind))).parquet(self.folder)
        mine = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        held = kept.filter(F.col("bucket").isin(*mine) & F.col("gram").isin(*terms)).groupBy("block", "c").agg(F.collect_list("rows").alias("lists"))
        full = held.filter(F.size("lists") == len(terms)).join(kept.filter(F.col("bucket") == IDS).select("block", "ids"), "block")
        return full.select("ids", "lists").mapInArrow(in_all, f"id {kept.schema['ids'].dataType.elementType.simpleString()}").distinct()

    def find(self, rows: DataFrame, query: str, id_col: str = "id") -> DataFrame:
        """The rows that has_keyword(query) finds, by their lists.

        Candidates are marked in a bitmap by the hash of their ids, which goes to
        the rows, so that no text is shuffled. Rows of an equal hash cost a test.
        """
        test, terms = has_keyword(query, self.columns), wanted(query)
        if not terms:
            return rows.filter(test)
        slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
        part, bit = (lambda s: F.floor(s / BITS).cast("int")), (lambda s: (s % BITS).cast("int"))
        marks = self.candidates(terms, rows.schema[id_col].dataType).select(slot("id").alias("s")).select(part(F.col("s")).alias("_part"), bit(F.col("s")).cast("bigint").alias("b"))
        marked = marks.repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg("b").alias("_bits"))
        met = rows.withColumn("_slot", slot(id_col)).join(F.broadcast(marked.withColumnRenamed("_part", "_p")), part(F.col("_slot")) == F.col("_p"))
        at = bit(F.col("_slot"))
        byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        # The condition needs both sides, so it isn't taken below the join, where it would test every row.
        return met.filter(F.when(F.getbit(byte, at % 8) == 1, test)).select(*rows.columns)


def build(rows: DataFrame, folder: str, columns: Sequence[str] = ("content",), id_col: str = "id", buckets: int = BUCKETS) -> TextIndex:
    index = TextIndex(rows.sparkSession, folder, tuple(columns), buckets)
    index.add(rows, id_col)
    return index


def containing(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """Pairs of rows of longer (long, and others) and shorter (short, and others) where long holds short, neither empty.

    A short name is looked for by the rarest of its trigrams (by one or two
    characters, if it has no more), which a long name's equal: as many rows as
    names have letters, and no pair is tested that has nothing in common.
    """
    sized = [grams(F.col("long"), n) for n in (1, 2, 3)]
    spread = longer.withColumn("_gram", F.explode(F.concat(*sized)))
    often = spread.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    own = F.when(F.length("short") >= 3, grams(F.col("short"), 3)).when(F.length("short") == 2, F.array("short")).otherwise(F.array_remove(F.array("short"), ""))
    asks = shorter.select("short").distinct().select("short", F.explode(own).alias("_gram")).join(often, "_gram")
    rarest = asks.groupBy("short").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    return spread.join(rarest, "_gram").filter(F.col("long").contains(F.col("short"))).drop("_gram").join(shorter, "short")
