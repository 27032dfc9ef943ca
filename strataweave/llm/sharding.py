"""Sharding by extendible hashing [native].

A document's hash is the first 60 bits of the MD5 of its id. A directory maps
hash prefixes to shards: where the documents under a prefix exceed the byte
limit, the prefix is split on its next bit, and only there, until every shard
fits. Bytes are summed once for prefixes of a starting depth (chosen so that
there are several per shard); deeper bits are summed for crowded prefixes
alone. A document over the limit has a shard of its own. Documents of one id
share all bits: if they exceed the limit together, their shard is split on
bits of a second hash, which tells rows apart.

Defined results: null text has no bytes; a null id hashes as an empty string;
repeated rows go by the second hash, as above; an empty table gives no rows.
Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm.tables import stored

LIMIT_BYTES = 1 << 20
BITS = 60
STEP = 6


def bits(value: Column) -> Column:
    """60 bits as a string of 0 and 1, the first bit first."""
    return F.lpad(F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 2), BITS, "0")


def prefixes_of(cells: DataFrame, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """Every prefix (cell, p, d) of cells from low to high bits, and their sums (p, d, b, n)."""
    found = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("d")).withColumn("p", F.substring("cell", F.lit(1), F.col("d")))
    return found, found.groupBy("p", "d").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))


def settle(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """cell and s (d, p, b, n), the shortest of its prefixes from low to high bits that fits, for cells of high bits that fit at all."""
    found, sums = prefixes_of(cells, low, high)
    fits = (F.col("b") <= limit) | (F.col("n") == 1) | (F.col("d") == 2 * BITS)
    return found.select("cell", "p", "d").join(sums.filter(fits).hint("merge"), ["p", "d"]).groupBy("cell").agg(F.min(F.struct("d", "p", "b", "n")).alias("s"))


def directory(sizes: DataFrame, limit: int, depth: int) -> list[tuple[int, DataFrame]]:
    """(bits, table) pairs; a table has cell, a prefix of so many bits, and its
    shard, shard_bytes, n_docs. sizes: h (a string of bits) and bytes.

    A prefix that fits, under a parent that doesn't, is a shard. Prefixes of a
    cell are summed STEP bits at a time, upwards while the shortest still fits
    and downwards below crowded cells, so no key gathers more than 2**STEP cells.
    """
    longest = 2 * BITS
    low, todo, found = max(0, depth - STEP), sizes, []
    # None of these tables is broadcast: they grow with the corpus, however well they compress.
    while True:
        cells = stored(todo.groupBy(F.substring("h", 1, depth).alias("cell")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")), "shard-cells")
        settled = stored(settle(cells, low, depth, limit), "shard-settled")
        above = cells
        while not found and low > 0 and not settled.filter(F.col("s.d") == low).isEmpty():
            high, low = low, max(0, low - STEP)
            # Cells whose prefix of `high` bits fits may fit under a shorter one; others have found their shard.
            above = stored(above.groupBy(F.substring("cell", 1, high).alias("cell")).agg(F.sum("b").alias("b"), F.sum("n").alias("n")), "shard-cells")
            higher = settle(above, low, high, limit).select(F.col("cell").alias("_c"), F.col("s").alias("_s"))
            met = settled.join(higher.hint("merge"), (F.col("s.d") == high) & (F.col("s.p") == F.col("_c")), "left")
            settled = stored(met.select("cell", F.coalesce("_s", "s").alias("s")), "shard-settled")
        found.append((depth, settled.select("cell", F.col("s.p").alias("shard"), F.col("s.b").alias("shard_bytes"), F.col("s.n").alias("n_docs"))))
        crowded = stored(cells.select("cell").join(settled.select("cell").hint("merge"), "cell", "left_anti"), "shard-crowded")
        if crowded.isEmpty():
            return found
        todo = todo.withColumn("cell", F.substring("h", 1, depth)).join(crowded.hint("merge"), "cell", "left_semi").drop("cell")
        low, depth = depth + 1, min(longest, depth + STEP)


def shard(docs: DataFrame, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, bytes, shard (its prefix of bits), depth, shard_bytes, n_docs per document."""
    other = F.xxhash64(F.col(text), F.monotonically_increasing_id())
    rows = docs.select(F.col(id_col), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.concat(bits(F.col(id_col)), F.lpad(F.conv(F.hex(other.bitwiseAND(F.lit(2**BITS - 1))), 16, 2), BITS, "0")).alias("h"))
    rows = stored(rows, "shard-rows")
    total = rows.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    depth = min(BITS, max(1, math.ceil(math.log2(max(total / limit, 1))) + 3))
    placed, todo = None, rows
    tables = directory(rows, limit, depth)
    for at, (depth, table) in enumerate(tables):
        # Rows look their cell up; the few below a crowded cell go on to the next table, of longer cells.
        met = todo.withColumn("cell", F.substring("h", 1, depth)).join(table.hint("merge"), "cell", "left" if at < len(tables) - 1 else "inner")
        here = met.filter(F.col("shard").isNotNull()).select(id_col, "bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "n_docs")
        placed = here if placed is None else placed.unionByName(here)
        if at < len(tables) - 1:
            todo = stored(met.filter(F.col("shard").isNull()).select(id_col, "bytes", "h"), "shard-below")
    return placed
