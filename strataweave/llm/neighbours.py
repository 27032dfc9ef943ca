"""Approximate nearest neighbours with a forest of random-projection trees.

Trees are fitted on a sample of at most SAMPLE_ROWS vectors: a node splits at
the median of the projection on the difference of two random vectors. Every
vector then takes its leaf in every tree. A query walks all trees through one
queue ordered by margin, nearest leaf first, until the leaves seen hold
`share` of the sample; candidates are all vectors of those leaves, wherever
they lie, and are reranked exactly (cosine in double precision).

A vector doesn't travel once per tree: the table lies in cells, the leaves of
the first tree, and a vector carries its leaves in the other trees. A query
goes to the cells in which some leaf that it visits occurs, with those of its
leaves that occur there, and meets each vector that shares a visited leaf with
it, in whatever trees, once. So the work is a scan's at most, and a small part
of it on clustered vectors.

Skew. Equal vectors form one class: it is indexed and searched once, and only
its k + 1 smallest ids can be answers, so no more travel. Cells are dealt out
in chunks of about CHUNK_ROWS and queries in parts of about QUERY_ROWS, and a
task scores one chunk against one part, so neither a large cell nor many
queries make a large task. A vector goes to those parts only that hold a query
for its cell. No pair leaves a task but each query's best few in
the chunk.

Defined results: vectors that are null, zero, empty, of another length than
the table's most common one, or that hold null or non-finite components take
no part; a query without a candidate gives no row; ties, as of vectors that are
multiples of one another, go to the smaller id; rows that repeat id and vector
count once; other columns, whatever their names, take no part; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.tables import stored

SAMPLE_ROWS = 4096
LEAF_ROWS = 64
TREES = 6
SHARE = 0.75
CHUNK_ROWS = 4096
QUERY_ROWS = 4096
#: Rough scores, by matrix product, differ from exact ones by less than this.
ROUGH = 1e-9


class Forest:
    """Trees as flat arrays; leaves are numbered over the whole forest."""

    def __init__(self, sample: np.ndarray, trees: int, leaf_rows: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[tuple[int, int]] = []  # (-1, leaf) for a leaf
        self.members: list[np.ndarray] = []
        self.size = len(sample)
        self.roots = [self._grow(sample, np.arange(len(sample)), leaf_rows, rng) for _ in range(trees)]

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> int:
        me = len(self.children)
        self.normals.append(np.zeros(x.shape[1]))
        self.offsets.append(0.0)
        self.children.append((-1, len(self.members)))
        if len(rows) > leaf_rows:
            a, b = x[rng.choice(rows, 2, replace=False)]
            normal = (a - b) / max(float(np.linalg.norm(a - b)), 1e-12)
            at = x[rows] @ normal
            offset = float(np.median(at))
            right = at > offset
            if right.any() and not right.all():
                self.normals[me], self.offsets[me] = normal, offset
                left = self._grow(x, rows[~right], leaf_rows, rng)
                self.children[me] = (left, self._grow(x, rows[right], leaf_rows, rng))
                return me
        self.members.append(rows)
        return me

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """For unit vectors x: their leaf in every tree."""
        out = np.empty((len(x), len(self.roots)), dtype=np.int32)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                left, right = self.children[node]
                if left < 0:
                    out[rows, t] = right
                elif len(rows):
                    side = x[rows] @ self.normals[node] > self.offsets[node]
                    todo += [(left, rows[~side]), (right, rows[side])]
        return out

    def visit(self, q: np.ndarray, share: float) -> list[int]:
        """Leaves for the unit vector q, nearest first, over all trees at once."""
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        seen = np.zeros(self.size, dtype=bool)
        found: list[int] = []
        while queue and seen.sum() < share * self.size or queue and not found:
            bound, node = heapq.heappop(queue)
            while self.children[node][0] >= 0:
                margin = float(q @ self.normals[node]) - self.offsets[node]
                left, right = self.children[node]
                near, far = (right, left) if margin > 0 else (left, right)
                heapq.heappush(queue, (max(bound, abs(margin)), far))
                node = near
            leaf = self.children[node][1]
            seen[self.members[leaf]] = True
            found.append(leaf)
        return found


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", trees: int = TREES, share: float = SHARE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query row."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    rows = vectors.filter(usable(F.col(vector)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == lengths["d"]).withColumn("h", F.xxhash64("v"))

    # Classes of equal vectors: their k + 1 smallest ids; the row limit is taken before the shuffle too.
    order = Window.partitionBy("h", "v").orderBy("id")
    ids = rows.select("h", "v", "id").withColumn("n", F.dense_rank().over(order)).filter(F.col("n") <= k + 1).dropDuplicates(["h", "v", "id"])
    classes = stored(ids.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.monotonically_increasing_id().alias("c"), "h", "v", "ids"), "vector-classes")
    n = classes.count()
    picked = classes.select("v").sample(fraction=min(1.0, 1.3 * sample_rows / n), seed=3).limit(sample_rows).toArrow()
    sample = _unit(_matrix(picked.column(0).combine_chunks()) if picked.num_rows else _matrix(classes.limit(sample_rows).select("v").toArrow().column(0).combine_chunks()))
    forest = Forest(sample, trees, LEAF_ROWS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = forest.leaves(_unit(_matrix(batch.column("v"))))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(leaf) + 1, dtype=np.int32) * trees), pa.array(leaf.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(leaf[:, 0]), lists, *(batch.column(c) for c in ("c", "least", "v"))], names=["cell", "leaves", "c", "least", "v"])

    id_kind = classes.schema["ids"].dataType.elementType.simpleString()
    placed = stored(classes.select("c", F.col("ids")[0].alias("least"), "v").mapInArrow(place, f"cell int, leaves array<int>, c bigint, least {id_kind}, v array<double>"), "placed-vectors")
    # Both have as many rows as the forest has leaves, or pairs of them: bounded by sample_rows and trees.
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    chunks = {cell: -(-m // CHUNK_ROWS) for cell, m in counts.items()}
    occurs: dict[int, list[int]] = {}
    for r in placed.select("cell", F.explode("leaves").alias("leaf")).distinct().collect():
        occurs.setdefault(r["leaf"], []).append(r["cell"])
    inside: dict[int, set[int]] = {}
    for leaf, held in occurs.items():
        for cell in held:
            inside.setdefault(cell, set()).add(leaf)

    # The class of every query row, then each class searched once.
    asked = rows.filter("q").select(F.col("id").alias("query_id"), "h", F.col("v").alias("qv")).distinct()
    asked = stored(asked.join(classes.select("h", "c", "v"), "h").filter(F.col("qv") == F.col("v")).select("query_id", "c"), "asked")
    queries = classes.join(asked.select("c").distinct(), "c", "left_semi").select("c", "v")
    parts = -(-asked.count() // QUERY_ROWS)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell, chunk, visited = [], [], [], []
            for i, q in enumerate(_unit(_matrix(batch.column("v")))):
                seen = forest.visit(q, share)
                for x in sorted({y for leaf in seen for y in occurs.get(leaf, ())}):
                    here = [leaf for leaf in seen if leaf in inside[x]]
                    for part in range(chunks[x]):
                        row.append(i)
                        cell.append(x)
                        chunk.append(part)
                        visited.append(here)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(chunk, pa.int32()), pa.array(visited, pa.list_(pa.int32())), batch.column("c").take(at), batch.column("v").take(at)], names=["cell", "chunk", "visited", "c", "v"])

    part = F.pmod(F.xxhash64("c"), F.lit(max(parts, 1))).cast("int")
    probes = queries.mapInArrow(visit, "cell int, chunk int, visited array<int>, c bigint, v array<double>").withColumn("part", part)
    deal = F.create_map(*(x for cell, m in sorted(chunks.items()) for x in (F.lit(cell), F.lit(m))))
    # Vectors go where a query waits for them, and nowhere else.
    wanted = probes.select(*(F.col(c).alias(f"_{c}") for c in ("cell", "chunk", "part"))).distinct()
    chunked = placed.withColumn("chunk", F.pmod(F.hash("c"), deal[F.col("cell")]))
    dealt = chunked.join(wanted, (F.col("cell") == F.col("_cell")) & (F.col("chunk") == F.col("_chunk"))).select(*chunked.columns, F.col("_part").alias("part"))
    leaves_in_all = len(forest.members)

    def score(base: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"qc": [], "c": [], "score": []}).astype({"qc": "int64", "c": "int64", "score": "float64"})
        if not len(base) or not len(asks):
            return none
        base = base.sort_values("least")
        x, ids_, leaves = np.stack(base["v"].to_numpy()), base["c"].to_numpy(), np.stack(base["leaves"].to_numpy())
        ux, keep, out = _unit(x), k + 2, []  # the query's own class, and one more as its own id may lead it
        for at in range(0, len(asks), 256):
            some = asks.iloc[at : at + 256]
            q, qids = np.stack(some["v"].to_numpy()), some["c"].to_numpy()
            sees = np.zeros((len(q), leaves_in_all), dtype=bool)
            for i, seen in enumerate(some["visited"]):
                sees[i, seen] = True
            met = np.zeros((len(q), len(x)), dtype=bool)
            for t in range(leaves.shape[1]):
                met |= sees[:, leaves[:, t]]
            rough = np.where(met, _unit(q) @ ux.T, -np.inf)
            edge = np.partition(rough, rough.shape[1] - keep, axis=1)[:, -keep] if rough.shape[1] > keep else np.full(len(q), -np.inf)
            # All that may be among the best: those that tie with the last are told apart by their exact scores and ids.
            a, b = np.nonzero((rough >= edge[:, None] - ROUGH) & met)
            exact = cosine(q[a], x[b])
            order = np.lexsort((b, -exact, a))  # base is in order of ids
            nth = np.arange(len(order)) - np.searchsorted(a[order], a[order])
            order = order[nth < keep]
            out.append(pd.DataFrame({"qc": qids[a[order]], "c": ids_[b[order]], "score": exact[order]}))
        return pd.concat(out)

    keys = ("cell", "chunk", "part")
    best = dealt.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(score, "qc bigint, c bigint, score double")
    best = best.join(classes.select("c", "ids"), "c")
    by_score = Window.partitionBy("qc").orderBy(F.desc("score"), F.col("ids")[0])
    answers = best.withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= k + 2).select("qc", F.explode("ids").alias("id"), "score")
    answers = answers.withColumn("n", F.row_number().over(Window.partitionBy("qc").orderBy(F.desc("score"), "id"))).filter(F.col("n") <= k + 1)
    lists = answers.groupBy("qc").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("found"))
    own = asked.join(lists, asked["c"] == lists["qc"]).select("query_id", F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, alike for a pair wherever it is met."""
    scale = lambda x: x / np.abs(x).max(axis=1, keepdims=True)
    a, b = scale(a), scale(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
