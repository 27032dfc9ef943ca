"""Whitening of embeddings, with covariances merged pairwise.

Entries become integers, x = floor(scale * c) + shift. Every partition computes
its count, exact sums, and the scatter about its own mean; treeReduce merges
two such parts by the formula of Chan, Golub and LeVeque, so nothing is ever
subtracted from sums of squares. The driver gets the count, d sums and a d x d
matrix, whatever the number of rows, and takes the eigenvectors. A second pass
projects the rows, and a third, over the projections as they were stored,
merges their covariance in the same way and gives its distance from identity.

Defined results: vectors that are null, hold null or non-finite entries, or
entries of magnitude 2**20 and more, take no part; nor do empty vectors and
vectors of another length than the table's most common one (the smaller of two
as common). Repeated rows count, and are returned, row by row; a null id is an
id like another. Components whose eigenvalue is zero to double precision (as
all are of a single row) have no whitened value and are left out. An empty
table gives no rows. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm.tables import stored

SCALE, SHIFT = 1024, 100_000
#: Entries that are looked at together within a task.
BLOCK = 1 << 19
#: Eigenvalues below this share of the largest are rounding.
LEAST = 1e-12
#: treeReduce's depth: the driver merges as many parts as the third root of the number of partitions.
DEPTH = 3


@dataclass
class Moments:
    """Count, exact sums (Python integers, or doubles if the rows are), mean, and scatter about the mean."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        exact = x.dtype.kind == "i"
        sums = x.sum(axis=0).astype(object) if exact else x.sum(axis=0)
        mean = np.array(sums / len(x), dtype=np.float64)
        y = x - mean
        return cls(len(x), sums, mean, y.T @ y)

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        sums, delta = self.sums + other.sums, other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(delta, delta) * (self.n / n * other.n)
        return Moments(n, sums, np.array(sums / n, dtype=np.float64), scatter)


def moments(blocks: Iterator[np.ndarray]) -> Iterator[Moments]:
    """One Moments of all blocks, or none."""
    found = None
    for x in blocks:
        if len(x):
            one = Moments.of(x)
            found = one if found is None else found.merge(one)
    return iter(() if found is None else (found,))


def usable(vector: Column) -> Column:
    """Neither null nor empty, all entries finite and not huge."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1 << 20)
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fine), F.lit(False))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def whole(x: np.ndarray, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    return np.floor(scale * x).astype(np.int64) + shift


def squared_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sums over dimensions of (n * x - sums)**2, exact: in machine words where they are known to suffice."""
    far = max(1, *(abs(n * int(v) - s) for edge in (x.min(axis=0), x.max(axis=0)) for v, s in zip(edge, sums, strict=True)))
    if far * far * len(sums) < 1 << 62:
        off = n * x - np.array(sums, dtype=np.int64)
        return [int(v) for v in (off * off).sum(axis=1)]
    if far < 1 << 53 and len(sums) <= 512:
        # off = a * 2**27 + b, and each sum of products fits in a word.
        off = n * x - np.array(sums, dtype=np.int64)
        a, b = off >> 27, off & ((1 << 27) - 1)
        return [(int(p) << 54) + (int(q) << 28) + int(r) for p, q, r in zip((a * a).sum(axis=1), (a * b).sum(axis=1), (b * b).sum(axis=1), strict=True)]
    off = n * x.astype(object) - np.array(sums, dtype=object)
    return list((off * off).sum(axis=1))


def _each(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _reduced(df: DataFrame, d: int, read: Callable[[pa.Array], np.ndarray]) -> Moments:
    """The Moments of a table's only column, lists of d numbers. It must have rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [pickle.dumps(m) for m in moments(read(b.column(0)) for b in _each(batches, max(1, BLOCK // d)))]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["m"])

    # From each partition that has rows, d sums and a d x d matrix.
    return df.mapInArrow(part, "m binary").rdd.map(lambda r: pickle.loads(r["m"])).treeReduce(Moments.merge, DEPTH)


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """id_col, component, n, deviation (decimal(38,0)), whitened, explained, identity_error: a row per row and component."""
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = vectors.filter(usable(F.col(vector)))
    lengths = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    rows = rows.filter(F.size(vector) == d).select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"))
    fit = _reduced(rows.select("_v"), d, lambda column: whole(matrix(column, d), scale, shift))
    n, sums = fit.n, [int(s) for s in fit.sums]
    values, axes = np.linalg.eigh(fit.scatter / n)
    order = np.argsort(-values)[: min(components, d)]
    order = [k for k in order if values[k] > LEAST * max(values[-1], 0.0)]
    if not order:
        return spark.createDataFrame([], schema)
    turn, explained = axes[:, order] / np.sqrt(values[order]), values[order] / np.trace(fit.scatter / n)
    mean, kept = fit.mean, len(order)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _each(batches, max(1, BLOCK // d)):
            x = whole(matrix(batch.column(1), d), scale, shift)
            off = squared_deviation(x, n, sums) if len(x) else []
            y = ((x - mean) @ turn).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * kept), pa.array(y))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(off, pa.decimal128(38, 0)), lists], names=["_id", "deviation", "_w"])

    projected = stored(rows.mapInArrow(project, f"_id {kind}, deviation decimal(38,0), _w array<double>"), "whitened")
    seen = _reduced(projected.select("_w"), kept, lambda column: matrix(column, kept))
    error = float(np.abs(seen.scatter / n - np.eye(kept)).max())
    share = F.array(*(F.lit(float(e)) for e in explained))
    each = projected.select("_id", "deviation", F.posexplode("_w").alias("_at", "whitened"))
    return each.select(
        F.col("_id").alias(id_col), (F.col("_at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("_at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
