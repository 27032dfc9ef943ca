"""Mixing sources to target weights by hierarchical budgeting.

Leaves of a domain-language-source tree hold tokens. A total budget flows down
the tree by the weights of siblings. A leaf can give its tokens at most
`epochs` times; what a node can't take is a shortage, which its siblings take
up first, by weight and as far as they can, and only what the whole family
can't take goes back to the parent's siblings. Each leaf then gives the
prefix, in tokens, of a sequence of epochs, each a seeded order of its
documents: whole epochs, then documents of one more while their start lies
before the budget's end.

The prefix is found without ordering a leaf in one task: documents are dealt
into SLICES by their place in the seeded order, whole slices are summed, the
slice in which the budget ends is sliced again, and only what is left of it is
ordered.

Defined results: null lang, source or domain is a leaf name of its own; null
text has no tokens; documents without tokens are left out; a weight that is
not given is 1, a node of weight 0 gets nothing; repeated rows are documents
of their own; an empty table or budget 0 gives no rows.
Columns other than those named, whatever their names, only tell rows apart.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm import text_stats as S
from strataweave.llm.packing import counted
from strataweave.llm.tables import boxed, stored

SLICES = 512
#: The slice in which a leaf's budget ends is sliced again so often before it is ordered: a leaf
#: of 10**10 documents leaves some 40,000 to order.
LEVELS = 2
#: A tree of more leaves than this is refused: the driver deals budgets to all of them.
MAX_LEAVES = 1_000_000
Path = tuple[str | None, ...]


def share(budget: float, children: Mapping[Path, float], room: Mapping[Path, float]) -> dict[Path, float]:
    """Budget for each child by weight, none above its room; what the full ones
    can't take goes to the others by weight."""
    given = dict.fromkeys(children, 0.0)
    open_ = {c for c, w in children.items() if w > 0 and room[c] > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(children[c] for c in open_)
        full = {c for c in open_ if given[c] + left * children[c] / total >= room[c] - 1e-9}
        if not full:
            for c in open_:
                given[c] += left * children[c] / total
            break
        for c in full:
            left -= room[c] - given[c]
            given[c] = room[c]
        open_ -= full
    return given


def budgets(tokens: Mapping[Path, int], budget: float, weights: Mapping[Path, float] | None = None, epochs: float = 1.0) -> dict[Path, int]:
    """Tokens for each leaf. tokens: by leaf path; weights: by path of any node."""
    weights = weights or {}
    weight = lambda path: float(weights.get(path, 1.0))
    kids: dict[Path, dict[Path, None]] = {}
    for path in sorted(tokens, key=str):
        for n in range(len(path)):
            kids.setdefault(path[:n], {})[path[: n + 1]] = None
    room: dict[Path, float] = {}
    for path in sorted({*tokens, *kids}, key=len, reverse=True):
        inside = epochs * tokens[path] if path in tokens else sum(room[k] for k in kids[path])
        room[path] = inside if not path or weight(path) > 0 else 0.0
    found: dict[Path, int] = {}
    todo = [((), min(budget, room[()]))] if tokens else []
    while todo:
        path, amount = todo.pop()
        if path in tokens:
            found[path] = int(amount + 0.5)
        else:
            own = kids[path]
            todo += share(amount, {k: weight(k) for k in own}, {k: room[k] for k in own}).items()
    return found


def seeded(seed: int, epoch: Column, rows: Column) -> Column:
    """A document's place in the order of an epoch, from 0 to 2**62 - 1."""
    return F.xxhash64(F.lit(seed), epoch, rows).bitwiseAND(F.lit(2**62 - 1))


def mix(docs: DataFrame, levels: Mapping[str, Column], budget: float | None = None, budget_share: float = 0.8, weights: Mapping[Path, float] | None = None, epochs: float = 1.0, seed: int = 11, id_col: str = "doc_id", tokens: Column | None = None, tokenizer: str | None = None) -> DataFrame:
    """Rows (id_col, the levels, tokens, epoch) that are selected, with _row and
    _row2, hashes of the document's columns. levels: name and expression, from
    the root down. budget: in tokens; by default a share of all there are.
    tokenizer: a vocabulary file, by whose tokens a document counts, as packing
    counts them. tokens: what it counts for otherwise, its words by default."""
    if tokens is not None and tokenizer is not None:
        raise ValueError("a document counts by tokens or by a tokenizer")
    count = F.size(S.words(F.col("text"))) if tokens is None else tokens
    names = list(levels)
    # Rows alike in all columns would share their place; a number within the partition tells them apart.
    size = count.cast("long").alias("tokens") if tokenizer is None else F.col("text").alias("_text")
    slim = docs.select(F.col(id_col), *(e.cast("string").alias(f"_l{i}") for i, e in enumerate(levels.values())), size, *identity(docs))
    slim = slim if tokenizer is None else counted(slim, tokenizer, "_text")
    slim = stored(slim.filter(F.col("tokens") > 0).withColumn("_nth", F.monotonically_increasing_id()), "mixing")
    at = [f"_l{i}" for i in range(len(names))]
    rows = slim.groupBy(*at).agg(F.sum("tokens").alias("t")).limit(MAX_LEAVES + 1).collect()  # as many rows as the tree has leaves
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"the tree has more than {MAX_LEAVES} leaves")
    totals = {tuple(r[c] for c in at): r["t"] for r in rows}
    spark = docs.sparkSession
    amount = budget_share * sum(totals.values()) if budget is None else budget
    given = budgets(totals, amount, weights, epochs)
    plan = [(*leaf, given[leaf] // totals[leaf], given[leaf] % totals[leaf]) for leaf in sorted(totals, key=str) if given.get(leaf)]
    leaves = spark.createDataFrame(plan, ", ".join(f"{c} string" for c in at) + ", _full bigint, _rest bigint").withColumn("_leaf", F.monotonically_increasing_id())
    same = None
    for c in at:
        same = slim[c].eqNullSafe(leaves[c]) if same is None else same & slim[c].eqNullSafe(leaves[c])
    drawn = slim.join(F.broadcast(leaves), same).select(slim["*"], "_full", "_rest", "_leaf")
    whole = drawn.filter(F.col("_full") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_full") - 1)))
    part = drawn.filter(F.col("_rest") > 0).withColumn("epoch", F.col("_full"))
    part = part.withColumn("_place", seeded(seed, F.col("epoch"), F.col("_row")))
    keep = [id_col, *(F.col(c).alias(n) for c, n in zip(at, names, strict=True)), "tokens", F.col("epoch").cast("int").alias("epoch"), "_row", "_row2"]
    chosen = whole.select(*keep)
    for level in range(1, LEVELS + 1):
        # Documents are dealt into SLICES by the next bits of their place; sums of whole slices tell
        # which lie before the budget's end, and the slice in which it ends goes on to the next level.
        part = part.withColumn("_slice", F.floor(F.col("_place") / F.lit(2**62 // SLICES**level)).cast("bigint") % SLICES)
        sums = part.groupBy("_leaf", "_slice").agg(F.sum("tokens").alias("t"), F.first("_rest").alias("_rest"))
        before = F.sum("t").over(Window.partitionBy("_leaf").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.withColumn("_start", F.coalesce(before, F.lit(0))).filter(F.col("_start") + F.col("t") > F.col("_rest"))
        # One row for each leaf at most: the slice in which its budget ends, and what the slices before hold.
        ends = sums.groupBy("_leaf").agg(F.min(F.struct("_slice", "_start")).alias("_end"))
        met = part.join(F.broadcast(ends), "_leaf", "left")
        chosen = chosen.unionByName(met.filter(F.col("_end").isNull() | (F.col("_slice") < F.col("_end._slice"))).select(*keep))
        part = met.filter(F.col("_slice") == F.col("_end._slice")).withColumn("_rest", F.col("_rest") - F.col("_end._start")).drop("_end", "_slice")
        if level < LEVELS:
            part = stored(part, "mixing-edge")
    running = F.sum("tokens").over(Window.partitionBy("_leaf").orderBy("_place", "_nth").rowsBetween(Window.unboundedPreceding, -1))
    edge = part.withColumn("_at", F.coalesce(running, F.lit(0))).filter(F.col("_at") < F.col("_rest"))
    return chosen.unionByName(edge.select(*keep))


def identity(docs: DataFrame) -> list[Column]:
    """Two hashes of a row's columns: one of 64 bits would meet by chance among some 10**10 rows."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(*columns).alias("_row"), F.xxhash64(F.lit(1), *columns).alias("_row2")]


def mixed_documents(docs: DataFrame, levels: Mapping[str, Column], **options) -> DataFrame:
    """The selected documents with the columns they came with, once per epoch.

    Rows alike in all columns can't be told apart, so each gives an equal part
    of what was selected of them, and one stands for the remainder.
    """
    picked = mix(docs, levels, **options).groupBy("_row", "_row2").agg(F.count(F.lit(1)).alias("_times"))
    twins = docs.select(*identity(docs)).groupBy("_row", "_row2").agg(F.count(F.lit(1)).alias("_twins"))
    chosen = stored(picked.join(twins.hint("merge"), ["_row", "_row2"]), "mixed-rows")
    first, second = identity(docs)
    # The list of selected rows grows with the corpus, so it is never broadcast.
    met = boxed(docs, _row=first, _row2=second).join(chosen.hint("merge"), ["_row", "_row2"])
    each = F.floor(F.col("_times") / F.col("_twins")).cast("int")
    alike = lambda n: F.explode(F.sequence(F.lit(1), n)).alias("_e")
    result = met.filter(each > 0).select("_doc", alike(each)).select("_doc.*")
    left = chosen.withColumn("_left", (F.col("_times") % F.col("_twins")).cast("int")).filter("_left > 0")
    if left.isEmpty():
        return result
    # A group's rows are merged where they are read, so a large group is no large task.
    rest = boxed(docs, _row=first, _row2=second).join(left.hint("merge"), ["_row", "_row2"]).groupBy("_row", "_row2", "_left").agg(F.first("_doc").alias("_doc"))
    return result.unionByName(rest.select("_doc", alike(F.col("_left"))).select("_doc.*"))
