"""Token counts of the documents in flat token files without an index.

A file is a run of fixed-width token ids; an end-of-document id closes every
document. Files come as blocks (file, block, tokens) that are cut anywhere.
Each block is searched for separators in one vector operation, which gives its
separators' places. What a block can't know - how many tokens and documents
come before it, and how long the document is that it continues - is found by
a prefix scan over one small row per block, in two levels, so that one long
file is not one task: within runs of RUN blocks, then over runs.

Defined results: two separators in a row close an empty document; tokens
after a file's last separator are a document that is not closed; a file
without a separator is one such document; empty blocks and null tokens hold
nothing; no blocks give no rows.
Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.llm.packing import encoder
from strataweave.llm.tables import stored

BLOCK_TOKENS = 1 << 16
RUN = 1024
#: Blocks that a task reads at a time from one file: 64 MB of two-byte ids.
RANGE_BLOCKS = 512


def blocks_of_files(spark: SparkSession, path: str, width: str = "<u2", block_tokens: int = BLOCK_TOKENS, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """file (its path), block, tokens of the flat files under path.

    Files are listed by Spark and read by byte ranges of range_blocks blocks,
    dealt out over tasks, so a file may be of any size; the store must be one
    that pyarrow opens. Bytes after the last whole token are not a token.
    """
    size = np.dtype(width).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        step = block_tokens * size
        for batch in batches:
            for name, first, end in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "end")), strict=True):
                store, at = FileSystem.from_uri(name)
                with store.open_input_file(at) as source:
                    for block in range(first, end):
                        source.seek(block * step)
                        data = source.read(step)
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([data[: len(data) // size * size]], pa.binary())], names=["file", "block", "tokens"])

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.ceil(F.col("length") / (block_tokens * size)).alias("blocks")).filter("blocks > 0")
    ranges = files.select("file", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1, F.lit(range_blocks).cast("long"))).alias("first"))
    ranges = ranges.select("file", "first", F.least(F.col("first") + range_blocks, "blocks").alias("end"))
    return ranges.repartition("file", "first").mapInArrow(run, "file string, block bigint, tokens binary")


def separators(blocks: DataFrame, end: int, width: str = "<u2") -> DataFrame:
    """file, block, n (its tokens), ends (the places of separators in it)."""
    kind = blocks.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends = [], []
            for data in batch.column("tokens"):
                ids = np.frombuffer(data.as_buffer(), dtype=width) if data.is_valid else np.empty(0, dtype=width)
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == end).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int32()))], names=["file", "block", "n", "ends"])

    return blocks.select("file", "block", "tokens").mapInArrow(run, f"file {kind}, block bigint, n bigint, ends array<int>")


def prefix_scan(found: DataFrame) -> DataFrame:
    """file, block and what comes before it in its file: _at (tokens), _docs
    (separators), _open (the place after the last separator)."""
    own = found.select("file", "block", "n", F.size("ends").cast("long").alias("m"), F.try_element_at("ends", F.lit(-1)).alias("last"), F.floor(F.col("block") / RUN).alias("run"))
    w = Window.partitionBy("file", "run").orderBy("block")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    own = own.withColumn("at", zero(F.sum("n").over(before))).withColumn("docs", zero(F.sum("m").over(before)))
    # The place after the block's last separator, within its run; null where it has none.
    own = own.withColumn("after", F.col("at") + F.col("last") + 1)
    own = own.withColumn("open", F.max("after").over(before))
    runs = own.groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.max("after").alias("after"))
    over = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_at", zero(F.sum("n").over(over))).withColumn("run_docs", zero(F.sum("m").over(over)))
    runs = runs.withColumn("run_open", zero(F.max(F.col("run_at") + F.col("after")).over(over)))
    met = own.join(runs.select("file", "run", "run_at", "run_docs", "run_open"), ["file", "run"])
    return met.select(
        "file", "block", (F.col("run_at") + F.col("at")).alias("_at"), (F.col("run_docs") + F.col("docs")).alias("_docs"),
        F.coalesce(F.col("run_at") + F.col("open"), F.col("run_open")).alias("_open"),
    )


def count_tokens(blocks: DataFrame, end: int, width: str = "<u2") -> DataFrame:
    """file, ordinal (from 0), start, n_tokens (without the separator), closed."""
    found = stored(separators(blocks, end, width), "separators")
    placed = found.join(prefix_scan(found), ["file", "block"])
    docs = placed.select("file", "_at", "_docs", "_open", "ends", F.posexplode("ends").alias("j", "e"))
    start = F.when(F.col("j") == 0, F.col("_open")).otherwise(F.col("_at") + F.try_element_at("ends", F.col("j")) + 1)
    closed = docs.select("file", (F.col("_docs") + F.col("j")).alias("ordinal"), start.alias("start"), (F.col("_at") + F.col("e") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    last = placed.groupBy("file").agg(F.max(F.col("_at") + F.col("n")).alias("n"), F.max(F.greatest(F.col("_open"), F.coalesce(F.col("_at") + F.try_element_at("ends", F.lit(-1)) + 1, F.lit(0)))).alias("start"), F.max(F.col("_docs") + F.size("ends")).alias("ordinal"))
    rest = last.filter(F.col("start") < F.col("n")).select("file", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def write_flat(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text: str = "text", width: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Encodes documents into flat token runs, one file per task, stored as
    blocks: file, block, tokens, and for checks first (ordinal) and ids of the
    documents that end in the block."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The separator is a special token, whose string in a text must stay ordinary text.
        encode, size = encoder(tokenizer, width, plain=True).encode, np.dtype(width).itemsize
        last, step = np.array([end], dtype=width).tobytes(), block_tokens * size
        file, block, first, ids, flat = TaskContext.get().partitionId(), 0, 0, [], bytearray()

        def out(n: int) -> pa.RecordBatch:
            nonlocal block, first
            made = pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([bytes(flat[:n])], pa.binary()), pa.array([first], pa.int64()), pa.array([list(ids)], pa.list_(id_type))], names=["file", "block", "tokens", "first", "ids"])
            block, first = block + 1, first + len(ids)
            ids.clear()
            del flat[:n]
            return made

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for doc, value in zip(batch.column(0), batch.column(1), strict=True):
                flat += encode(value.as_py())
                flat += last
                ids.append(doc.as_py())
                while len(flat) >= step:
                    yield out(step)
        if flat:
            yield out(len(flat))

    source = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_b"))
    return stored(source.mapInArrow(run, f"file bigint, block bigint, tokens binary, first bigint, ids array<{kind.simpleString()}>"), "token-files", compression="zstd")


def document_counts(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes documents to flat files, counts by scanning those, and names the documents again."""
    flat = write_flat(docs, tokenizer, end, id_col, text)
    order = flat.select("file", "first", F.posexplode("ids").alias("p", id_col)).select("file", (F.col("first") + F.col("p")).alias("ordinal"), id_col)
    counted = count_tokens(flat, end)
    return order.join(counted, ["file", "ordinal"], "full").select(id_col, "n_tokens", "closed")
