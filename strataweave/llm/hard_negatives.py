"""Hard negatives, exact, through product quantisation with stored residual norms.

Vectors become integers, floor(scale * x), and scores are their inner products.
Each is stored with its codes (the nearest of CODES centroids in every pair of
dimensions) and the norm of what the codes leave over. For an anchor a, the sum
of its table's entries at the codes is the score but for the residual's part,
which is |a| times that norm at most. So the sum plus and minus that bound
tells for sure which vectors can't be in a window of scores; the others' exact
integer scores decide.

An anchor's positives are its best k of the same label; each opens a window,
from low percent of its score up to its score, for which the best k of another
label are returned. Both are one search, for the best k in each window. It is
run twice: over one in SEED rows first, and then over all with the windows'
lower ends raised to the k-th best found, which no answer lies below.

The table lies in cells around coarse centroids, with their radii, and an
anchor goes only to cells whose bounds meet its windows. Cells are dealt out in
chunks of about CHUNK_ROWS and anchors in parts of about PART_ROWS, and a task
scores one chunk against one part, so no label, cell or vector that is common
makes a large task. Vectors are sent only to parts with an anchor for their
cell. A task returns the best k in each window, never the pairs it looked at.
Without clusters every anchor meets every vector, in blocks: the work is then
anchors times rows. Centroids and codes are fitted on SAMPLE_ROWS vectors at
most; they affect time only.

Defined results: rows with a null id or label, and vectors that are null,
empty, hold null or non-finite components or such of magnitude 2**20 and more,
or are of another length than the table's most common one, take no part. Rows
that repeat id, label and vector count once; other rows are rows of another
id. Ties go to the smaller id. An anchor without positives, and a positive
without negatives, give no rows, nor does an empty table. Other columns,
whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.tables import stored
from strataweave.llm.whitening import matrix, usable

SAMPLE_ROWS = 4096
#: Dimensions coded together, and centroids for them: at most 256, as codes are bytes.
WIDTH, CODES = 2, 256
CELLS = 64
CHUNK_ROWS = 8192
PART_ROWS = 512
SEED = 16
#: Scores lie between these.
FAR = 1 << 62
#: Bytes of an anchors' table; pairs scored at once.
TABLE_BYTES, PAIRS = 1 << 26, 1 << 20


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """At most k centroids of rows that were drawn from x."""
    rng = np.random.default_rng(seed)
    at = np.unique(x, axis=0)
    at = at[rng.choice(len(at), min(k, len(at)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, at)
        n = np.bincount(own, minlength=len(at))
        sums = np.stack([np.bincount(own, weights=col, minlength=len(at)) for col in x.T], axis=1)
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
    return at


def nearest(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.argmin((at * at).sum(axis=1) - 2 * (x @ at.T), axis=1)


class Quantiser:
    """Codebooks for each WIDTH dimensions, and coarse cells, for vectors of d dimensions."""

    def __init__(self, sample: np.ndarray) -> None:
        self.d = sample.shape[1]
        self.books = [k_means(sample[:, at : at + WIDTH], CODES, seed=at) for at in range(0, self.d, WIDTH)]
        self.cells = k_means(sample, CELLS)

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (bytes) and norms of residuals, raised by more than sums in double precision can lose."""
        codes = np.stack([nearest(x[:, WIDTH * m : WIDTH * (m + 1)], book) for m, book in enumerate(self.books)], axis=1).astype(np.uint8)
        left = np.concatenate([x[:, WIDTH * m : WIDTH * (m + 1)] - book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return codes, np.sqrt((left * left).sum(axis=1)) * (1 + 1e-9) + 1e-9 * (1 + np.sqrt((x * x).sum(axis=1)))

    def table(self, q: np.ndarray) -> list[np.ndarray]:
        """For each WIDTH dimensions: a row for each code, a column for each anchor."""
        return [book @ q[:, WIDTH * m : WIDTH * (m + 1)].T for m, book in enumerate(self.books)]


def _ints(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, d).astype(np.int64)


def best_in_windows(quantiser: Quantiser, k: int, same: bool, base: dict[str, np.ndarray], asks: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of base (x, ids, labels, codes, slack), the best k in each window (lo to hi) of each of asks
    (x, ids, labels, lo, hi): the ask's number, the window's, the row of base and the score."""
    x, q, lo, hi = base["x"], asks["x"], asks["lo"].copy(), asks["hi"]
    norms = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    table = quantiser.table(q.astype(np.float64))
    kept = [np.empty(0, dtype=np.int64)] * 4
    tile = max(1, PAIRS // len(q))
    for at in range(0, len(x), tile):
        codes, slack = base["codes"][at : at + tile], base["slack"][at : at + tile]
        rough = np.zeros((len(codes), len(q)))
        for m, rows in enumerate(table):
            rough += rows[codes[:, m]]
        edge = slack[:, None] * norms
        alike = base["labels"][at : at + tile, None] == asks["labels"]
        may = (alike if same else ~alike) & (base["ids"][at : at + tile, None] != asks["ids"]) & (rough + edge >= lo.min(axis=1)) & (rough - edge <= hi.max(axis=1))
        b, a = np.nonzero(may)
        b += at
        exact = np.concatenate([np.empty(0, dtype=np.int64), *((x[b[i : i + (1 << 16)]] * q[a[i : i + (1 << 16)]]).sum(axis=1) for i in range(0, len(b), 1 << 16))])
        found = [kept]
        for w in range(lo.shape[1]):
            fits = (exact >= lo[a, w]) & (exact <= hi[a, w])
            found.append([a[fits], np.full(fits.sum(), w), b[fits], exact[fits]])
        a, w, b, exact = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((base["ids"][b], -exact, w, a))
        key = (a * lo.shape[1] + w)[order]
        nth = np.arange(len(key)) - np.searchsorted(key, key)
        last = order[nth == k - 1]
        order = order[nth < k]
        kept = [a[order], w[order], b[order], exact[order]]
        lo[a[last], w[last]] = exact[last]
    return tuple(kept)


def mine(vectors: DataFrame, is_anchor: Column, k: int = 5, low: int = 80, id_col: str = "vec_id", label: str | Column = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    named = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_col).alias("id"), named.alias("label"), F.col(vector).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.filter(usable(F.col("v")) & F.col("id").isNotNull() & F.col("label").isNotNull())
    result = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score bigint, negative_score bigint"
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], result)
    d, label_kind = lengths["d"], rows.schema["label"].dataType.simpleString()
    rows = rows.filter(F.size("v") == d)
    share = min(1.0, 1.3 * SAMPLE_ROWS / lengths["count"])
    drawn = rows.select("v").sample(fraction=share, seed=3).limit(SAMPLE_ROWS).toArrow()
    drawn = drawn if drawn.num_rows else rows.select("v").limit(SAMPLE_ROWS).toArrow()
    quantiser = Quantiser(np.floor(scale * matrix(drawn.column(0).combine_chunks(), d)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = np.floor(scale * matrix(batch.column(2), d))
                codes, slack = quantiser.codes(x)
                cell = nearest(x, quantiser.cells)
                radius = np.sqrt(((x - quantiser.cells[cell]) ** 2).sum(axis=1))
                flat = [pa.array([r.tobytes() for r in rows_], pa.binary()) for rows_ in (x.astype("<i4"), codes)]
                arrays = [batch.column(0), batch.column(1), batch.column(3), *flat, *map(pa.array, (slack, cell.astype(np.int32), radius))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "label", "asks", "x", "codes", "slack", "cell", "radius"])

    coded = stored(rows.mapInArrow(encode, f"id {kind}, label {label_kind}, asks boolean, x binary, codes binary, slack double, cell int, radius double"), "coded-vectors")
    # At most CELLS rows.
    cells = {r["cell"]: (r["n"], r["radius"]) for r in coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("radius")).collect()}
    chunks = {cell: -(-n // CHUNK_ROWS) for cell, (n, _) in cells.items()}
    deal = F.create_map(*(F.lit(v) for pair in sorted(chunks.items()) for v in pair))
    base = coded.select("id", "label", "x", "codes", "slack", "cell", F.pmod(F.xxhash64("id"), deal[F.col("cell")]).cast("int").alias("chunk"))

    anchors = coded.filter("asks").select("id", "label", "x").distinct().select(F.monotonically_increasing_id().alias("ask"), "id", "label", "x")
    anchors = stored(anchors, "anchors")
    parts = max(1, -(-anchors.count() // PART_ROWS))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = sorted(cells)
        centres, radii = quantiser.cells[which], np.array([cells[c][1] for c in which])
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _ints(batch.column(3), d).astype(np.float64)
            lo, hi = (batch.column(c).flatten().to_numpy().astype(np.float64).reshape(len(q), -1) for c in (4, 5))
            rough = q @ centres.T
            edge = np.sqrt((q * q).sum(axis=1))[:, None] * (radii * (1 + 1e-9) + 1e-9 * (1 + np.sqrt((centres**2).sum(axis=1))))
            a, c = np.nonzero((rough + edge >= lo.min(axis=1)[:, None]) & (rough - edge <= hi.max(axis=1)[:, None]))
            times = np.array([chunks[which[j]] for j in c], dtype=np.int64)
            at, cell = np.repeat(a, times), np.repeat(np.array(which, dtype=np.int32)[c], times)
            chunk = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell), pa.array(chunk.astype(np.int32))], names=[*batch.schema.names, "cell", "chunk"])

    def searched(asks: DataFrame, some: DataFrame, same: bool) -> DataFrame:
        """ask, w, n, id, score: the best k rows of some in each window of asks."""
        fields = f"ask bigint, id {kind}, label {label_kind}, x binary, lo array<bigint>, hi array<bigint>"
        probes = asks.mapInArrow(visit, f"{fields}, cell int, chunk int").withColumn("part", F.pmod(F.xxhash64("ask"), F.lit(parts)).cast("int"))
        # Vectors go where a probe waits for them, and nowhere else.
        wanted = probes.select(*(F.col(c).alias(f"_{c}") for c in ("cell", "chunk", "part"))).distinct()
        met = some.join(wanted, (F.col("cell") == F.col("_cell")) & (F.col("chunk") == F.col("_chunk"))).select(*some.columns, F.col("_part").alias("part"))

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [np.empty(0, dtype=np.int64)] * 4
            if left.num_rows and right.num_rows:
                left = left.select(["id", "label", "x", "codes", "slack"]).group_by(["id", "label", "x"]).aggregate([("codes", "one"), ("slack", "one")])
                codes = np.frombuffer(b"".join(left["codes_one"].to_pylist()), dtype=np.uint8).reshape(left.num_rows, -1)
                rows_ = {"x": _ints(left["x"], d), "ids": left["id"].to_numpy(), "labels": left["label"].to_numpy(), "codes": codes, "slack": left["slack_one"].to_numpy()}
                step, found = max(1, TABLE_BYTES // (8 * CODES * codes.shape[1])), []
                for at in range(0, right.num_rows, step):
                    some_ = right.slice(at, step)
                    lo, hi = (np.array(some_[c].to_pylist(), dtype=np.int64) for c in ("lo", "hi"))
                    a, w, b, s = best_in_windows(quantiser, k, same, rows_, {"x": _ints(some_["x"], d), "ids": some_["id"].to_numpy(), "labels": some_["label"].to_numpy(), "lo": lo, "hi": hi})
                    found.append((some_["ask"].to_numpy()[a], w, b, s))
                out = [np.concatenate(c) for c in zip(*found, strict=True)]
            ids = left["id"].take(pa.array(out[2])) if len(out[2]) else pa.array([], left.schema.field("id").type)
            return pa.table([pa.array(out[0]), pa.array(out[1].astype(np.int32)), ids, pa.array(out[3])], names=["ask", "w", "id", "score"])

        keys = ("cell", "chunk", "part")
        best = met.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(score, f"ask bigint, w int, id {kind}, score bigint")
        order = Window.partitionBy("ask", "w").orderBy(F.desc("score"), "id")
        return best.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)

    def answered(asks: DataFrame, same: bool) -> DataFrame:
        first = searched(asks, base.filter(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(SEED)) == 0), same).filter(F.col("n") == k)
        ends = first.groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("ends"))
        raised = F.transform("lo", lambda lo, w: F.greatest(lo, F.coalesce(F.col("ends")[w], lo)))
        again = stored(asks.join(ends, "ask", "left").select("ask", "id", "label", "x", raised.alias("lo"), "hi"), "windows")
        return searched(again, base, same)

    everywhere = anchors.select("*", F.array(F.lit(-FAR)).alias("lo"), F.array(F.lit(FAR)).alias("hi"))
    # k positives at most.
    positives = answered(everywhere, True).groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("positives"))
    hi = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda w: F.coalesce(F.get("positives", w)["score"], F.lit(-FAR)))
    # The least whole score of at least low percent; no score is both that and the positive's at most if that is negative.
    lo = F.transform(hi, lambda s: F.when(s >= 0, F.call_function("div", s * low + 99, F.lit(100))).otherwise(F.lit(FAR)).cast("bigint"))
    asks = stored(anchors.join(positives, "ask").select("*", lo.alias("lo"), hi.alias("hi")), "asks")
    found = answered(asks.select("ask", "id", "label", "x", "lo", "hi"), False)
    return found.join(asks.select("ask", F.col("id").alias("anchor_id"), "positives"), "ask").select(
        "anchor_id", F.col("positives")[F.col("w")]["id"].alias("positive_id"), F.col("n").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("positives")[F.col("w")]["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
