"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint holds, for each bit, the majority among the hashes of a text's
word shingles. Two fingerprints that differ in at most tau bits agree within
threshold t_i on some group i of bits, for any thresholds with
sum(t_i + 1) = tau + 1. Groups hold correlated bits together; thresholds are
dealt out by dynamic programming on candidate counts estimated from a bounded
sample of fingerprints (a group with t_i = -1 is not probed). Groups are
probed by an equi-join on their bits and each candidate is verified.

Similarities that 64 bits can't resolve take fingerprints of many words and the
same steps (wide_groups): groups of correlated bits within each word, thresholds
by the same program. tau is the number of differing bits up to which a pair
becomes a candidate for certain; it is as large as the asked recall for pairs
just similar enough needs, which differ in more bits. An exact check by the
sets of shingles follows.

Skew. Equal fingerprints become one row first. A bucket of more than CROWD
fingerprints is not expanded into pairs: two fingerprints within two bits of
each other have a common centre within one bit of both, so its members are
grouped by their 65 centres instead. Such a group holds 65 fingerprints at
most, all linked to one another, so a star stands for it and no link is lost.

Defined results: null text counts as empty; a text of fewer words than a
shingle is one shingle; a text of no words has fingerprint zero and links like
any other; repeated rows get the same result; a group whose ids are all null
has a null component; an empty table gives no rows.
Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm.components import components
from strataweave.llm.tables import boxed, stored
from strataweave.llm.text_stats import only

CROWD = 48
#: A probe is a row that is shuffled twice: the work of about so many verifications.
PROBE_WORK = 8
#: The same for wide fingerprints, where a bucket's pairs can't be replaced by centres.
BAND_CROWD = 16
#: Members of a crowded bucket are compared in squares of about this side.
CELL = 256
#: A group of a wide fingerprint has so many bits more than n fingerprints need to be told apart, and LEAST_BITS at least:
#: chance puts a quarter of another fingerprint into a bucket, whatever n is.
MARGIN_BITS, LEAST_BITS = 2, 16
#: Fingerprints from which bit groups and thresholds are planned.
PLAN_ROWS = 4000
#: Share of bits in which texts of fewer than FEW shingles may differ at a Jaccard similarity of 0.8 (4 of 5 shared; ties count).
FEW, FEW_DIFFER = 10, 3 / 16
#: Bits of the map of documents whose shingles are wanted: 2 MB at any size of the corpus.
WANTED_BITS = 24
LANES = np.uint64(0x0101010101010101)


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    import xxhash

    w = text.lower().split()
    if len(w) > shingle:
        parts = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    else:
        parts = iter([b" ".join(w)] if w else [])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, 42) for p in parts), dtype=np.uint64)


def _remix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of many independent hashes, from the first."""
    if not k:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * k) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For runs of h of these sizes (none zero): bits set in over half of a run.

    Bits are counted in byte lanes, 255 hashes at a time, so nothing overflows.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    blocks = -(-sizes // 255)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    within = np.arange(blocks.sum()) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 255 * within
    out = np.zeros(len(sizes), dtype=np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & LANES, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for lane, on in enumerate((2 * counts > sizes[:, None]).T):
            out |= on.astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, words: int = 1, once: bool = False) -> DataFrame:
    """id_col, bits, an array of `words` 64-bit parts of the fingerprint, and n, how many shingles
    it is made of. once: repeated shingles count once."""
    source = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held, n = [], [], 0
            sizes_ = np.zeros(batch.num_rows, dtype=np.int64)
            found = np.zeros((batch.num_rows, words), dtype=np.uint64)

            def close(parts=parts, held=held, found=found) -> None:
                if parts:
                    h, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
                    for k in range(words):
                        found[held, k] = majority(_remix(h, k), sizes)
                    parts.clear()
                    held.clear()

            for row, value in enumerate(batch.column(1)):
                h = _hashes(value.as_py(), shingle)
                h = np.unique(h) if once else h
                sizes_[row] = len(h)
                if len(h):
                    parts.append(h)
                    held.append(row)
                    n += len(h)
                if n > 200_000:
                    close()
                    n = 0
            close()
            flat = pa.array(found.reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, words, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(sizes_)], names=[id_col, "bits", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, bits array<bigint>, n bigint")


def groups_of_bits(sample: np.ndarray, n: int, width: int | None = None) -> list[np.uint64]:
    """n masks of a 64-bit part, correlated bits together, each of `width` bits
    (by default all 64 are shared out)."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    bits -= bits.mean(axis=0) if len(sample) else 0.0
    norm = np.sqrt((bits**2).sum(axis=0))
    corr = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9) if len(sample) else np.zeros((64, 64))
    np.fill_diagonal(corr, 0)
    left, masks = list(range(64)), []
    for g in range(n):
        size = width or -(-len(left) // (n - g))
        own = [max(left, key=lambda i: (corr[i, left].sum(), -i))]
        left.remove(own[0])
        while len(own) < size:
            best = max(left, key=lambda i: (corr[i, own].sum(), -i))
            own.append(best)
            left.remove(best)
        masks.append(np.uint64(sum(1 << i for i in own)))
    return masks


def _ball(width: int, t: int) -> int:
    """Values within t bits of one of this width."""
    size, c = 0, 1
    for j in range(t + 1):
        size += c
        c = c * (width - j) // (j + 1)
    return size


def allot(sample: np.ndarray, masks: list[np.uint64], tau: int, n: int, most: float = 65.0) -> list[int]:
    """Thresholds, least in estimated work for n fingerprints, with sum(t + 1) = tau + 1.

    sample: fingerprints, or a column of them for each mask. most: what a member of a
    crowded bucket costs at most, its 65 centres by default, whatever the bucket's size.
    """
    x = np.broadcast_to(sample if sample.ndim == 2 else sample[:, None], (len(sample), len(masks)))
    half = len(x) // 2
    near = []
    for g, m in enumerate(masks):
        left, right = x[:half, g], x[half : 2 * half, g]
        near.append(np.bitwise_count(np.concatenate([left ^ np.roll(right, s) for s in range(16)]) & m))

    def cost(g: int, t: int) -> float:
        width = int(masks[g]).bit_count()
        share = max(_ball(width, t) / 2.0**width, float((near[g] <= t).mean()) if near[g].size else 0.0)
        return PROBE_WORK * (_ball(width, t) if t else 1) + min(n * share, most)

    each, over = divmod(tau + 1, len(masks))
    even = sum(cost(g, each + (g < over) - 1) for g in range(len(masks)) if each + (g < over))
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in range(len(masks)):
        row = [0.0]
        # A threshold that alone costs more than dealing all evenly is in no best plan; higher ones cost more still.
        while len(row) < tau + 2 and (c := cost(g, len(row) - 1)) <= even:
            row.append(c)
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for units in range(min(tau + 2 - used, len(row))):
                found = (total + row[units], [*chosen, units - 1])
                if used + units not in step or found[0] < step[used + units][0]:
                    step[used + units] = found
        best = step
    return best[tau + 1][1]


def signed(x: int) -> int:
    return int(x) - 2**64 if int(x) >= 2**63 else int(x)


def _sample(fps: DataFrame, n: int, column: Column) -> np.ndarray:
    rows = fps.select(column.alias("x")).sample(fraction=min(1.0, 1.2 * PLAN_ROWS / max(n, 1)), seed=5).limit(PLAN_ROWS).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64).view(np.uint64)


def links(fps: DataFrame, tau: int = 2, fp: str = "fp", crowd: int = CROWD) -> DataFrame:
    """Edges (a, b), a < b, whose components are those of the graph that joins
    distinct fingerprints (fp, bigint) at tau or fewer differing bits; tau <= 2."""
    if not 0 <= tau <= 2:
        raise ValueError("crowded buckets are resolved exactly for tau up to 2")
    n = fps.count()
    sample = _sample(fps, n, F.col(fp))
    masks = groups_of_bits(sample, tau + 1)
    probes = []
    for g, (mask, t) in enumerate(zip(masks, allot(sample, masks, tau, n), strict=True)):
        bits = [1 << i for i in range(64) if int(mask) >> i & 1]
        flips = [0] if t >= 0 else []
        flips += bits if t >= 1 else []
        flips += [a | b for i, a in enumerate(bits) for b in bits[:i]] if t >= 2 else []
        key = F.col(fp).bitwiseAND(F.lit(signed(mask)))
        probes += [F.struct(F.lit(g).alias("g"), key.bitwiseXOR(F.lit(signed(x))).alias("key")) for x in flips]
    posts = fps.select(F.col(fp).alias("fp"), F.explode(F.array(*probes)).alias("p")).select("fp", "p.g", "p.key")
    sizes = posts.groupBy("g", "key").count().filter(F.col("count") > 1)
    shared = stored(posts.join(sizes, ["g", "key"]), "shared-buckets")

    close = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= tau
    pairs_of = lambda held: F.flatten(F.transform(held, lambda x: F.transform(F.filter(held, lambda y: (y > x) & close(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    few = shared.filter(F.col("count") <= crowd).groupBy("g", "key").agg(F.collect_set("fp").alias("held"))
    edges = few.select(F.explode(pairs_of(F.col("held"))).alias("e")).select("e.a", "e.b")

    many = shared.filter(F.col("count") > crowd).select("fp").distinct()
    centres = many.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)))).alias("centre"))
    around = centres.groupBy("centre").agg(F.collect_set("fp").alias("held")).filter(F.size("held") > 1)
    if tau < 2:
        stars = around.select(F.explode(pairs_of(F.col("held"))).alias("e")).select("e.a", "e.b")
    else:
        star = lambda held: F.transform(F.filter(held, lambda x: x > F.array_min(held)), lambda x: F.struct(F.array_min(held).alias("a"), x.alias("b")))
        stars = around.select(F.explode(star(F.col("held"))).alias("e")).select("e.a", "e.b")
    return edges.unionByName(stars).distinct()


def band_bits(n: int) -> int:
    """The bits of a wide fingerprint's group, for n fingerprints."""
    return max(LEAST_BITS, MARGIN_BITS + math.ceil(math.log2(max(n, 1))))


def plan_bands(similarity: float, width: int, recall: float = 0.96) -> tuple[int, float]:
    """(tau + 1, expected share of differing bits): as many groups of `width` bits
    with threshold zero as find a pair of just this similarity with the asked
    probability. More similar pairs are found more surely: 0.992 at 0.85 and
    0.999 at 0.9, for 0.8. A group of threshold t stands for t + 1 of them and
    finds a pair at least as surely as they do."""
    cosine = 2 * similarity / (1 + similarity)  # of shingle counts, for a Jaccard similarity
    differs = math.acos(cosine) / math.pi
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - differs) ** width)), differs


def _most(share: float, bits: int, deviations: float) -> int:
    """Bits in which fingerprints may differ that do so in this share on average."""
    return math.ceil(share * bits + deviations * math.sqrt(share * (1 - share) * bits))


def wide_groups(sample: np.ndarray, width: int, tau: int, n: int, most: float = math.inf) -> list[tuple[int, np.uint64, int]]:
    """(word, mask, threshold) of the groups to probe, of `width` bits each, for n wide
    fingerprints: pairs that differ in tau bits or fewer are within threshold in a group.

    sample: a row of words per fingerprint. Words are independent hashes of the same
    shingles, so correlated bits are sought, and put together, within a word.
    most: as allot() takes it.
    """
    words, per_word = sample.shape[1], 64 // width
    groups = [(w, m) for w in range(words) for m in groups_of_bits(sample[:, w], per_word, width)]
    thresholds = allot(sample[:, [w for w, _ in groups]], [m for _, m in groups], tau, n, most)
    return [(w, m, t) for (w, m), t in zip(groups, thresholds, strict=True) if t >= 0]


def plainly_probed(groups: list[tuple[int, np.uint64, int]], bits: Column) -> Column:
    """The buckets (bigint) of a wide fingerprint in the groups of threshold zero."""
    plain = [F.xxhash64(F.lit(g), bits[word].bitwiseAND(F.lit(signed(mask)))) for g, (word, mask, t) in enumerate(groups) if not t]
    return F.array(*plain).cast("array<bigint>")


def probed(groups: list[tuple[int, np.uint64, int]]) -> Column:
    """The buckets (bigint) of a wide fingerprint, bits: fingerprints within threshold in a group share one."""

    def around(g: int, word: int, mask: np.uint64, t: int) -> Column:
        own = [1 << i for i in range(64) if int(mask) >> i & 1]
        flips = [F.lit(signed(sum(bits))) for k in range(min(t, len(own)) + 1) for bits in combinations(own, k)]
        key = F.col("bits")[word].bitwiseAND(F.lit(signed(mask)))
        return F.transform(F.array(*flips), lambda x: F.xxhash64(F.lit(g), key.bitwiseXOR(x)))

    return F.concat(plainly_probed(groups, F.col("bits")), *(around(g, *group) for g, group in enumerate(groups) if group[2]))


def similar_groups(docs: DataFrame, key: Column, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, crowd: int = BAND_CROWD) -> DataFrame:
    """key, id_col and root for every row: rows of equal root are near-duplicates.

    For similarities that 64 bits can't resolve. Fingerprints of many words are
    cut into groups of correlated bits, wide enough for the number of documents
    to be told apart; thresholds are dealt out by estimated candidate counts
    (wide_groups). Candidates that meet in a group's bucket are verified, first
    on one word, then on the whole fingerprint, and at last by the exact Jaccard
    similarity of their sets of shingles. Groups are planned from the PLAN_ROWS
    fingerprints with the smallest hashes, so the plan repeats.

    All pairs of a bucket are candidates. In buckets of more than `crowd`
    members each member first meets one hub, the densest member of all its
    buckets (leaders); then it is compared with all members that it is not
    linked to by then, on whole fingerprints (unlinked). A pair that shares many
    buckets is a candidate in one of them. root is a hash of the group's first
    fingerprint.
    """
    tagged = docs.select(F.struct(key.alias("k"), F.col(id_col).alias("i")).alias("row"), F.col(text).alias("text"))
    n = docs.count()
    width = band_bits(n)
    units, differs = plan_bands(similarity, width)
    words = -(-units // (64 // width))
    bits = 64 * words
    few = max(differs, FEW_DIFFER)
    rough, most, most_few = _most(few, 64, 3.5), _most(differs, bits, 3.0), _most(few, bits, 4.5)
    own = stored(fingerprints(tagged, "row", "text", shingle, words, once=True).select("row.k", "row.i", "bits", "n").withColumn("node", F.xxhash64("bits")), "wide-fingerprints")
    nodes = stored(own.groupBy("node").agg(F.min("k").alias("k"), F.min("n").alias("n"), F.first("bits").alias("bits")), "wide-nodes")
    chosen = nodes.select("node", "bits").orderBy("node").limit(PLAN_ROWS).collect()
    sample = np.array([r["bits"] for r in chosen], dtype=np.int64).reshape(-1, words).view(np.uint64)
    groups = wide_groups(sample, width, units - 1, n, crowd)  # beyond a crowd, a member first meets one hub
    posts = nodes.select("node", F.col("bits")[words - 1].alias("w"), F.explode(probed(groups)).alias("bucket"))
    crowded = posts.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > crowd)
    # All posts meet the crowded buckets, few or many, so the work is alike at every size and skew.
    met = posts.join(stored(crowded, "crowded-buckets").hint("merge"), "bucket", "left")

    alike_word = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= rough
    held = only(met, F.col("m").isNull()).groupBy("bucket").agg(F.collect_list(F.struct("node", "w")).alias("held")).filter(F.size("held") > 1)
    pairs = F.flatten(F.transform("held", lambda x: F.transform(F.filter("held", lambda y: (y["node"] > x["node"]) & alike_word(x["w"], y["w"])), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    candidates = held.select(F.explode(pairs).alias("e")).select("e.a", "e.b")
    # A node has as many buckets as the plan has probes, so they are one row, which is joined once.
    hot = stored(only(met, F.col("m").isNotNull()).groupBy("node").agg(F.collect_list(F.struct("bucket", "m")).alias("posts")), "crowded-nodes")

    def close(x: Column, y: Column) -> Column:
        """By size, then by whole fingerprints."""
        small, large = F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"])
        apart = F.aggregate(F.zip_with(x["bits"], y["bits"], lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, d: a + d)
        return (small >= similarity * large - 1e-9) & (apart <= F.when(small < FEW, most_few).otherwise(most))

    def due(x: Column, y: Column, bucket: Column) -> Column:
        """Whether this crowded bucket is the one in which a pair counts: the first that both share. Where that isn't a
        crowded one the pair was a candidate there, if alike in a word."""
        shared = F.array_intersect(plainly_probed(groups, x["bits"]), plainly_probed(groups, y["bits"]))
        return (F.size(shared) == 0) | (F.array_min(shared) == bucket) | ~alike_word(x["bits"][words - 1], y["bits"][words - 1])

    left, right = (nodes.select(F.col("node").alias(c), F.col("k").alias(f"k{c}"), F.struct("bits", "n").alias(x)) for c, x in ("ax", "by"))

    def alike(pairs: DataFrame) -> DataFrame:
        near = pairs.distinct().join(left, "a").join(right, "b").filter(close(F.col("x"), F.col("y"))).select("a", "b", "ka", "kb")
        return verified(stored(near, "similar-pairs"), docs.select(key.alias("k"), F.col(text).alias("text")), shingle, similarity)

    edges = alike(candidates.unionByName(leaders(hot)))
    roots = components(edges)
    if not (more := alike(unlinked(hot, nodes.select("node", "n", "bits"), roots, close, due))).isEmpty():
        roots = components(edges.unionByName(more))
    roots = roots.withColumnRenamed("node", "_node")
    joined = own.join(roots, own["node"] == roots["_node"], "left")
    return joined.select(F.col("k").alias("key"), F.col("i").alias(id_col), F.coalesce("root", "node").alias("root"))


def leaders(hot: DataFrame) -> DataFrame:
    """A pair (a, b), a < b, for each node of hot (node, posts: its buckets and their sizes m): itself and its hub.

    A text that many others are near to meets more of them in its buckets than
    they meet of each other, so the member with the largest sum of sizes heads
    a bucket. A node's hub is the densest head of its buckets.
    """
    dense = F.aggregate("posts", F.lit(0).cast("bigint"), lambda d, p: d + p["m"])
    ranked = hot.select("node", dense.alias("d"), F.explode("posts.bucket").alias("bucket"))
    heads = ranked.groupBy("bucket").agg(F.max(F.struct("d", "node")).alias("head"))
    hubs = ranked.join(heads, "bucket").filter(F.col("head.node") != F.col("node")).groupBy("node").agg(F.max("head").alias("head"))
    return hubs.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"))


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b; ka and kb are keys of their texts) whose sets of shingles
    have this Jaccard similarity or more. texts: k (bigint) and text.

    Only shingles of texts that a map of 2**WANTED_BITS bits names are shuffled.
    """
    places = F.explode(F.array("ka", "kb")).alias("k")
    at = pairs.select(places).select(F.col("k").bitwiseAND(F.lit(2**WANTED_BITS - 1)).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).cast("int").alias("part")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).collect()
    wanted = np.zeros(2**WANTED_BITS // 64, dtype=np.int64)
    for r in rows:
        wanted[r["part"]] = r["bits"]
    named = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = np.unpackbits(named.value.view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for rows in np.array_split(at := np.flatnonzero(listed[keys & (2**WANTED_BITS - 1)]), len(at) // 500 + 1):
                sets = [np.unique(_hashes(batch.column(1)[int(r)].as_py(), shingle)).view(np.int64) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), pa.array(sets, pa.list_(pa.int64()))], names=["k", "held"])

    sets = texts.select("k", F.coalesce("text", F.lit("")).cast("binary").alias("_b")).mapInArrow(run, "k bigint, held array<bigint>")
    sets = stored(sets.groupBy("k").agg(F.first("held").alias("held")), "shingle-sets")
    both = pairs.join(sets.select(F.col("k").alias("ka"), F.col("held").alias("x")), "ka").join(sets.select(F.col("k").alias("kb"), F.col("held").alias("y")), "kb")
    shared = F.size(F.array_intersect("x", "y"))
    return stored(both.filter(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b"), "verified-pairs")


def unlinked(hot: DataFrame, nodes: DataFrame, roots: DataFrame, close: Callable[[Column, Column], Column], due: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Pairs (a, b), a < b, of all nodes that share a bucket, are close and are not of one root yet.

    hot: as leaders() takes it; nodes: node and what close reads; due: whether a
    pair counts in this bucket, of all that it shares. A pair within a
    bucket's largest group is linked already, so members are compared with
    those outside it only, CELL with CELL at a time: a bucket of many copies
    and a few others costs its size, not its square. Two cells meet under a key
    of their own, so a large bucket is no large task. Only close pairs become rows,
    once where they are due.
    """
    at = hot.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.explode("posts.bucket").alias("bucket"))
    groups = at.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("m"))
    mixed = groups.groupBy("bucket").agg(F.sum("m").alias("all"), F.max(F.struct("m", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    at = at.join(mixed.select("bucket", "all", F.col("all") - F.col("top.m"), F.col("top.root")).toDF("bucket", "all", "others", "top").hint("merge"), "bucket")
    at = at.groupBy("node").agg(F.first("root").alias("root"), F.collect_list(F.struct("bucket", "all", "others", "top")).alias("posts"))
    at = stored(at.join(nodes.hint("merge"), "node"), "unlinked-nodes")
    at = at.select("root", *nodes.columns, F.inline("posts"))
    member = F.struct("node", "root", (F.col("root") == F.col("top")).alias("in_top"), *(c for c in nodes.columns if c != "node"))
    cells = lambda n: F.ceil(F.col(n) / CELL).cast("int")

    def held(rows: DataFrame, own: str, opposite: str, seed: int, names: tuple[str, str, str]) -> DataFrame:
        """Cells of members under each cell that they meet: members (first name), own and opposite cell (the others)."""
        mine = F.pmod(F.xxhash64("node", F.lit(seed)), cells(own)).cast("int").alias(names[1])
        grouped = rows.groupBy("bucket", mine, cells(opposite).alias("_n")).agg(F.collect_list(member).alias(names[0]))
        return grouped.select("bucket", *names[:2], F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias(names[2]))

    xs = held(at, "all", "others", 0, ("xs", "cx", "cy"))
    met = xs.join(held(at.filter("root != top"), "others", "all", 1, ("ys", "cy", "cx")).hint("merge"), ["bucket", "cx", "cy"])
    pair = lambda x, y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b"))
    once = lambda x, y: x["in_top"] | (x["node"] < y["node"])
    found = F.flatten(F.transform("ys", lambda y: F.transform(F.filter("xs", lambda x: (x["root"] != y["root"]) & once(x, y) & close(x, y) & due(x, y, F.col("bucket"))), lambda x: pair(x, y))))
    return met.select(F.explode(found).alias("e")).select("e.a", "e.b")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The document of the smallest id of each group, with the columns docs came with."""
    key = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    groups = stored(similar_groups(docs, key, id_col, text, shingle, similarity), "similar-groups")
    kept = groups.groupBy("root").agg(F.min(F.struct(id_col, "key")).alias("first")).select(F.col(f"first.{id_col}").alias("_id"), F.col("first.key").alias("_key"))
    kept = stored(kept, "kept-rows")
    # Rows alike in every column share a key; they are told apart by nothing, so one stays.
    repeated = groups.groupBy("key", id_col).count().filter(F.col("count") > 1)
    # Texts are shuffled once, whatever the size: the list of kept rows grows with them.
    rows = boxed(docs, _key=key, _own=F.col(id_col))
    left = rows.join(kept.hint("merge"), (rows["_key"] == kept["_key"]) & rows["_own"].eqNullSafe(kept["_id"]), "left_semi")
    if repeated.isEmpty():
        return left.select("_doc.*")
    return left.dropDuplicates(["_key", "_own"]).select("_doc.*")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, tau: int = 2) -> DataFrame:
    """One row per document: id_col, fingerprint (hex), component_id."""
    own = stored(fingerprints(docs, id_col, text, shingle).select(id_col, F.col("bits")[0].alias("fp")), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(links(distinct.select("fp"), tau))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(named, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
