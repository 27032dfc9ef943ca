"""Inverted lists over a table of chunks, for search by cosine without a full scan.

Vectors of length one are clustered by k-means, fitted on a bounded sample; the
table is written with each row's list as its partition column, so the lists
that a search leaves out are never read (PartitionFilters). Rows added later go
to the lists of the same clusters, without refitting. Each list's size and
radius are kept beside it, one row per list and load.

A search takes the nearest `probes` lists, or, without a number, as many as an
exact answer needs: the best k of the nearest lists give a similarity to beat,
and a list whose centre's product with the question plus whose radius stays
below it can't hold a better row. Rows without a vector that could be listed
(null, zero, of another length) are list -1, read only where fewer than k rows
have a similarity at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strataweave.functions import vectors as V
from strataweave.operators.retrieval import match
from strataweave.shared import kept

SAMPLE_ROWS = 20_000
APART = -1
#: Rows and queries that a task multiplies at once.
BLOCK = 8192


def unit(v: Column, dimensions: int) -> Column:
    """A vector of length one; null if it is null, zero, of another length, or has components that are null or not finite."""
    values = V.doubles(v)
    finite = F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    length = V.norm(v)
    # The length as a variable: written into the inner function it would be summed up again for each component.
    once = F.transform(F.array(length), lambda n: F.transform(values, lambda x: x / n))[0]
    return F.when((F.size(values) == dimensions) & finite & (length > 0) & (length < float("inf")), once)


@dataclass(frozen=True)
class VectorIndex:
    """An index in a folder: model, rows (by list), sizes."""

    spark: SparkSession
    folder: str

    @property
    def model(self) -> KMeansModel:
        return KMeansModel.load(f"{self.folder}/model")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def lists(self) -> dict[int, tuple[int, float]]:
        """Rows and radius of each list: as many rows as lists and loads."""
        sizes = self.spark.read.parquet(f"{self.folder}/sizes").groupBy("list").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
        return {r["list"]: (r["n"], r["radius"]) for r in sizes.collect()}

    def add(self, chunks: DataFrame, vector: str = "embedding") -> None:
        """More rows, to the lists that there are."""
        _write(self.model, chunks, self.folder, vector, "append")

    def match(self, query: Sequence[float], k: int = 10, metadata: Mapping | None = None, source: str | None = None, probes: int | None = None) -> DataFrame:
        """As retrieval.match() over the whole table; over the nearest lists only if probes says how many."""
        centres = np.array(self.model.clusterCenters())
        q = np.array(query, dtype=np.float64)
        table = lambda lists: match(self.rows().filter(F.col("list").isin(*lists)).drop("list"), query, k, metadata, source)
        known = self.lists()
        if len(q) != centres.shape[1] or not np.isfinite(q).all() or not q.any():
            return table(sorted(known))
        near = centres @ (q / np.linalg.norm(q))
        order = sorted((c for c in known if c != APART), key=lambda c: -near[c])
        if probes is not None:
            return table(order[:probes] or [APART])
        first, held = [], 0
        while order[len(first) :] and held < k:
            first.append(order[len(first)])
            held += known[first[-1]][0]
        best = table(first or [APART]).agg(F.count("similarity").alias("n"), F.min("similarity").alias("least")).first()
        if best["n"] < k:
            return table(sorted(known))
        beat = best["least"] - 1e-9  # more than the rounding of sums in double precision
        return table([c for c in order if c in first or near[c] + known[c][1] >= beat])

    def match_all(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """queries: query_id, query. query_id, similarity and the rows of the k nearest rows with a
        vector, for each, exact: first from the query's nearest lists, then from all lists that may
        hold better ones. Queries meet lists by number, rows and lists in one equi-join."""
        centres, known = self.model.clusterCenters(), {c: v for c, v in self.lists().items() if c != APART}
        d = len(centres[0])
        table = F.array(*(F.struct(F.lit(c).alias("list"), F.array(*map(F.lit, map(float, centres[c]))).alias("centre"), F.lit(float(known[c][1])).alias("radius")) for c in sorted(known)))
        near = F.transform(table, lambda x: F.struct((-V.dot(F.col("_q"), x["centre"])).alias("away"), x["list"].alias("list"), x["radius"].alias("radius")))
        asked = queries.select("query_id", unit(F.col("query"), d).alias("_q")).filter("_q IS NOT NULL").withColumn("_near", F.array_sort(near))
        # Lists from the nearest on, until they hold k rows: how many that takes is at most this.
        sizes, need, held = sorted(n for n, _ in known.values()), 0, 0
        while need < len(sizes) and held < k:
            held += sizes[need]
            need += 1
        first = asked.select("query_id", "_q", F.explode(F.slice("_near", 1, max(need, 1))).alias("_l")).select("query_id", "_q", F.col("_l.list").alias("list"))
        best = kept(self._best(first, k), "nearest")
        least = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("similarity")).alias("_least"))
        beat = F.coalesce(F.col("_least"), F.lit(-2.0)) - 1e-9
        rest = asked.join(least, "query_id", "left").select("query_id", "_q", F.explode(F.filter(F.slice("_near", max(need, 1) + 1, len(known) + 1), lambda x: x["radius"] - x["away"] >= beat)).alias("_l"))
        more = self._best(rest.select("query_id", "_q", F.col("_l.list").alias("list")), k)
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return best.unionByName(more).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")

    def _best(self, probes: DataFrame, k: int) -> DataFrame:
        """The k best of the lists that each query probes: products in blocks of rows and queries, each block of bounded size."""
        known = {c: n for c, (n, _) in self.lists().items() if c != APART}
        parts = F.create_map(*(F.lit(x) for c, n in known.items() for x in (c, -(-n // BLOCK))))[F.col("list")] if known else F.lit(1)
        ways = max(1, -(-probes.select("query_id").distinct().count() // BLOCK))
        table = self.rows().filter(F.col("list") != APART).join(probes.select("list").distinct(), "list", "left_semi")
        table = table.withColumn("_b", F.pmod(F.xxhash64("id", "embedding"), parts).cast("int")).withColumn("_w", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
        asked = probes.withColumn("_w", F.pmod(F.xxhash64("query_id"), F.lit(ways)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), parts - 1)))
        taken = [f for f in table.schema.fields if f.name not in ("embedding", "list", "_b", "_w")]
        made = StructType([*taken, probes.schema["query_id"], StructField("similarity", DoubleType())])
        names = [f.name for f in taken]
        met = table.groupBy("list", "_b", "_w").cogroup(asked.groupBy("list", "_b", "_w")).applyInArrow(lambda rows, queries: _nearest(rows, queries, names, k), made)
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return met.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return pa.concat_arrays(column.chunks).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(rows: pa.Table, queries: pa.Table, names: list[str], k: int) -> pa.Table:
    """The k best rows for each query. A product picks those that may be among them; their similarity is summed in V.dot's order, so equal vectors tie."""
    blank = rows.select(names).slice(0, 0).append_column("query_id", queries["query_id"].slice(0, 0)).append_column("similarity", pa.array([], pa.float64()))
    if not len(rows) or not len(queries):
        return blank
    vectors, asked = _matrix(rows["embedding"]), _matrix(queries["_q"])
    dot = lambda a, b: sum((a[:, j] * b[..., j] for j in range(a.shape[1])), 0.0)
    norms, ids = np.sqrt(dot(vectors, vectors)), rows["id"].to_numpy()
    units, own = vectors / norms[:, None], np.sqrt(dot(asked, asked))
    picked, of, found = [], [], []
    for start in range(0, len(asked), 256):
        rough = asked[start : start + 256] @ units.T
        least = np.partition(rough, -k, axis=1)[:, -k] if k < len(ids) else np.full(len(rough), -np.inf)
        for i, r in enumerate(rough, start):
            near = np.flatnonzero(r >= least[i - start] - 1e-9)
            score = dot(vectors[near], asked[i]) / (norms[near] * own[i])
            best = np.lexsort((ids[near], -score))[:k]
            picked.append(near[best]), found.append(score[best]), of.append(np.full(len(best), i))
    held = rows.select(names).take(np.concatenate(picked))
    return held.append_column("query_id", queries["query_id"].take(np.concatenate(of))).append_column("similarity", pa.array(np.concatenate(found)))


def _write(model: KMeansModel, chunks: DataFrame, folder: str, vector: str, mode: str) -> None:
    centres = [list(map(float, c)) for c in model.clusterCenters()]
    held = chunks.withColumn("_unit", unit(F.col(vector), len(centres[0])))
    fine = model.transform(held.filter("_unit IS NOT NULL").withColumn("_v", array_to_vector("_unit"))).drop("_v")
    centre = F.array(*(F.array(*map(F.lit, c)) for c in centres))[F.col("list")]
    gap = F.zip_with("_unit", centre, lambda x, y: (x - y) * (x - y))
    distance = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)) * (1 + 1e-9) + 1e-9
    rows = fine.select(*chunks.columns, F.col("list"), distance.alias("_d"))
    rest = held.filter("_unit IS NULL").select(*chunks.columns, F.lit(APART).alias("list"), F.lit(0.0).alias("_d"))
    listed = kept(rows.unionByName(rest), "listed")
    # One shuffle puts a list's rows together; lists of many rows take several files.
    listed.drop("_d").repartition("list", F.pmod(F.xxhash64(F.col(vector)), F.lit(4))).write.mode(mode).partitionBy("list").parquet(f"{folder}/rows")
    listed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("_d").alias("radius")).write.mode(mode).parquet(f"{folder}/sizes")


def build(chunks: DataFrame, folder: str, lists: int = 64, vector: str = "embedding", dimensions: int | None = None, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
    """An index of the chunks, all their columns included, in a new folder."""
    spark = chunks.sparkSession
    if dimensions is None:
        usual = chunks.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
        dimensions = usual["d"] if usual else 1
    units = chunks.select(unit(F.col(vector), dimensions).alias("_unit")).filter("_unit IS NOT NULL")
    n = units.count()
    sample = units.sample(min(1.0, 1.2 * sample_rows / max(n, 1)), seed=1).limit(sample_rows) if n > sample_rows else units
    if not n:  # nothing to cluster: every row is apart, and so are those to come
        sample = spark.createDataFrame([([1.0] + [0.0] * (dimensions - 1),)], "_unit array<double>")
    fitted = KMeans(k=max(2, min(lists, n)), seed=1, maxIter=10, featuresCol="_v", predictionCol="list").fit(sample.select(array_to_vector("_unit").alias("_v")))
    fitted.save(f"{folder}/model")
    _write(fitted, chunks, folder, vector, "overwrite")
    return VectorIndex(spark, folder)
